"""The driver contract, with and without the optional subpackage."""

import os
import shutil
import subprocess
import sys

import __spark_entry__ as contract

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def test_entry(spark):
    got = contract.entry(spark)
    assert got.columns == ["question_id", "option", "method", "score", "denominator", "decision"] and got.count() > 0


def test_every_sql_has_its_query():
    assert set(contract.oracle_sql()) <= set(contract.queries())
    assert len(contract.queries()) > 50


def test_without_the_optional_subpackage(tmp_path):
    name = "llm"
    copy = tmp_path / "repo"
    shutil.copytree(ROOT, copy, ignore=lambda d, names: [n for n in names if n in (name, ".git", "corpus_pipeline.py", "__pycache__")])
    code = "import __spark_entry__ as e; q = e.queries(); assert len(q) > 50 and not any(k.startswith('op') for k in q) and 'pipeline' not in q; print(len(q), len(e.oracle_sql()))"
    done = subprocess.run([sys.executable, "-c", code], cwd=copy, capture_output=True, text=True, timeout=120)
    assert done.returncode == 0, done.stderr
