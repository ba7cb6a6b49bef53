"""Operators for preparing language-model training data.

Nothing outside this subpackage imports it.  The functions shipped to Python
workers are pickled by value, so executors need no copy of the repository.
"""

from pyspark import cloudpickle

import quorumlake.llm as _own

cloudpickle.register_pickle_by_value(_own)
