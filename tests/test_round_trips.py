"""State calls of runs, seeds checked by counts, and CSV files of bounded size."""

import pandas as pd
from pyspark.sql import functions as F

from quorumlake.operators import uncertainty
from quorumlake.streaming.runs import RunReports


class Calls:
    def __init__(self):
        self.kept, self.n = {}, 0

    def __getattr__(self, name):
        def call(*a):
            self.n += name != "exists"
            return {"exists": lambda: bool(self.kept), "get": lambda: self.kept.get(0), "update": lambda v: self.kept.update({0: v}), "updateValue": lambda k, v: self.kept.update({k: v}), "containsKey": lambda k: k in self.kept, "getValue": lambda k: self.kept.get(k), "removeKey": lambda k: self.kept.pop(k), "keys": lambda: iter(self.kept), "registerTimer": lambda d: None}[name](*a)

        return call


def test_items_ended_at_once_are_written_once():
    p = RunReports(1000)
    p.counts, p.open, p.ended, p.handle = Calls(), Calls(), Calls(), Calls()
    at = pd.Timestamp("2026-01-01", tz="UTC")
    rows = [("r", k, str(i), None, None, at + pd.Timedelta(seconds=j)) for i in range(50) for j, k in enumerate(("START", "OK"))]
    (report,) = p.handleInputRows(("r",), iter([pd.DataFrame(rows, columns=["run_id", "kind", "item", "planned", "error", "at"])]), None)
    assert report.ok.iloc[-1] == 50 and p.ended.n == 50 and p.open.n == 0 and p.handle.n == 0


def test_whole(spark):
    rows = [("a", 1), ("a", 2), ("b", 1), ("b", 1), ("c", 1), ("c", 2), ("c", 3), ("d", 2)]
    got = spark.createDataFrame(rows, "k string, seed int").groupBy("k").agg(uncertainty.whole([1, 2]).alias("w"))
    assert {r.k: r.w for r in got.collect()} == {"a": True, "b": False, "c": False, "d": False}
    assert "collect_list" not in got._jdf.queryExecution().toString()


def test_samples_are_not_grouped(spark):
    from quorumlake.queries import QUERIES

    assert "Aggregate" not in QUERIES["freq_counts"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()


def test_files_are_bounded(spark, monkeypatch):
    from quorumlake import table_queries as T
    from quorumlake.queries import QUERIES

    seen = []
    load = T.loaders.uncertainty_table
    monkeypatch.setattr(T, "FILE_ROWS", 500)
    monkeypatch.setattr(T.loaders, "uncertainty_table", lambda s, at, keys: seen.append(s.read.text(at).groupBy(F.input_file_name()).count().agg(F.max("count")).first()[0]) or load(s, at, keys))
    QUERIES["uncertainty_file"](spark, "/root/testdata/sf0.001")
    assert seen[0] <= 501
