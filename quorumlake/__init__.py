"""quorumlake: evidence aggregation and evaluation as Spark DataFrame operators.

Functions shipped to Python workers are pickled by value, so executors need no
copy of the repository.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
