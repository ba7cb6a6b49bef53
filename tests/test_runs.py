"""Ranges resumed, metadata walked, and runs followed as a stream."""

import datetime as dt
import os

import pytest
from pyspark.sql import functions as F

from quorumlake.functions import frozen
from quorumlake.operators import ranges
from quorumlake.sources.versions import VersionedTable
from quorumlake.streaming import runs


def test_a_range_is_computed_once(spark, tmp_path):
    items, out = spark.range(95).select((F.col("id") * 3).alias("q")), str(tmp_path / "out")
    lineage = VersionedTable(spark, str(tmp_path / "lineage"))
    asked = []

    def compute(rows):
        asked.append(sorted({r.part for r in rows.select("part").distinct().collect()}))
        return rows.withColumn("failed", F.col("q") % 30 == 0)

    def go(run, **more):
        return ranges.resume(items, "q", 10, compute, out, lineage, run, identity={"model": "m"}, **more)

    assert go("one", most_parts=4) == {"before": 0, "now": 4, "left": 6}
    # A run that wrote parts and was stopped before it said so: they are computed again, and replaced.
    spark.createDataFrame([(777, True, 4)], "q long, failed boolean, part long").write.partitionBy("part").mode("append").parquet(out)
    stamp = {f: os.path.getmtime(f"{out}/part=0/{f}") for f in os.listdir(f"{out}/part=0")}
    assert go("two") == {"before": 4, "now": 6, "left": 0} and go("three") == {"before": 10, "now": 0, "left": 0}
    assert asked == [[0, 1, 2, 3], [4, 5, 6, 7, 8, 9]] and stamp == {f: os.path.getmtime(f"{out}/part=0/{f}") for f in os.listdir(f"{out}/part=0")}
    got = ranges.combined(spark, out, lineage)
    assert sorted(r.q for r in got.collect()) == [3 * i for i in range(95)]
    assert {(r.part, r.run) for r in got.collect()} == {(p, "one" if p < 4 else "two") for p in range(10)}
    entry = {r.part: (r.first, r.last, r.items, r.rows, r.failed) for r in lineage.read().collect()}
    assert entry[0] == ("0", "27", 10, 10, 1) and entry[9] == ("270", "282", 5, 5, 1)
    with pytest.raises(ValueError, match="other items"):
        ranges.resume(items.filter("q <> 30"), "q", 10, compute, out, lineage, "four", identity={"model": "m"})
    with pytest.raises(ValueError, match="identity"):
        ranges.resume(items, "q", 10, compute, out, lineage, "five", identity={"model": "n"})


def test_metadata_is_walked_to_any_depth(spark):
    rows = [
        (1, '{"a": 1, "b": [1, {"c": [true, null, "x", 1.5, {}]}]}'), (2, '{"a": {"b": [0, {"c": {"d": 1e999}}]}}'), (3, "[1]"), (4, '"text"'), (5, None), (6, '{"": 1, "x": {" ": {}}}'), (7, "{}"), (8, '{"l1": {"l2": {"l3": {"l4": {"l5": 1}}}}}'),
    ]
    df = spark.createDataFrame(rows, "k int, j string").select("k", F.try_parse_json("j").alias("m"))
    more = spark.sql("SELECT 9 AS k, to_variant_object(named_struct('d', DATE'2020-01-01', 'n', array(named_struct('x', double('NaN')), named_struct('x', double('-Infinity'))), 'ok', 1.25)) AS m")
    got = sorted((r.k, r.path, r.fault) for r in frozen.metadata_faults(df.unionByName(more), "k", "m").collect())
    inf = [(2, "$.a.b[1].c.d", "NOT_FINITE")] if df.filter("k = 2 AND m IS NOT NULL").count() else [(2, "$", "NOT_AN_OBJECT")]
    assert got == sorted([*inf, (3, "$", "NOT_AN_OBJECT"), (4, "$", "NOT_AN_OBJECT"), (5, "$", "NOT_AN_OBJECT"), (6, "$.", "BLANK_KEY"), (6, "$.x. ", "BLANK_KEY"), (9, "$.d", "NOT_JSON"), (9, "$.n[0].x", "NOT_FINITE"), (9, "$.n[1].x", "NOT_FINITE")])
    assert [(r.k, r.path, r.fault) for r in frozen.metadata_faults(df.filter("k = 8"), "k", "m", depth=3).collect()] == [(8, "$.l1.l2.l3", "TOO_DEEP")]
    assert sorted(r.k for r in frozen.frozen(df.unionByName(more), "k", "m").collect()) == [1, 7, 8]


@pytest.fixture
def rocksdb(spark):
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name)
    runs.use_rocksdb(spark)
    yield
    spark.conf.set(name, before)


def test_runs_are_followed(spark, tmp_path, rocksdb):
    at = lambda m: dt.datetime(2026, 1, 1) + dt.timedelta(minutes=m)
    batches = [
        [("r", "PLAN", None, 3, None, at(0)), ("r", "START", "a", None, None, at(1)), ("s", "PLAN", None, 1, None, at(1)), ("s", "START", "z", None, None, at(1))],
        [("r", "OK", "a", None, None, at(2)), ("r", "START", "b", None, None, at(3)), ("r", "FAIL", "b", None, "Timeout", at(4)), ("r", "START", "c", None, None, at(4)), ("r", "OK", "a", None, None, at(4))],
        [("s", "OK", "z", None, None, at(5)), ("t", "PLAN", None, 9, None, at(40))],
        [("t", "PLAN", None, 9, None, at(41))],
        [("r", "OK", "c", None, None, at(50)), ("r", "START", "c", None, None, at(51))],
    ]
    for k, rows in enumerate(batches):
        if k != 3:
            spark.createDataFrame(rows, runs.EVENT).coalesce(1).write.parquet(str(tmp_path / "in" / str(k)))
        # Started again for each batch: state, counts and timers are those of the batch before.
        stream = spark.readStream.schema(runs.EVENT).parquet(str(tmp_path / "in" / "*"))
        q = runs.run_reports(stream, "10 minutes").writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
        q.awaitTermination()
    rows = spark.read.schema(runs.REPORT).parquet(str(tmp_path / "out")).collect()
    notes = sorted((r.run_id, r.status, r.item, r.note) for r in rows if r.item)
    assert notes == [("r", "FAILED", "b", "Timeout"), ("r", "STALLED", "c", "not ended in time")]
    counts = [(r.run_id, r.status, r.ok, r.failed, r.stalled, r.open) for r in rows if not r.item]
    assert {("r", "IN_PROGRESS", 0, 0, 0, 1), ("r", "IN_PROGRESS", 1, 1, 0, 1), ("r", "COMPLETE_WITH_FAILURES", 1, 1, 1, 0), ("r", "COMPLETE_WITH_FAILURES", 2, 1, 0, 0), ("s", "COMPLETE", 1, 0, 0, 0), ("s", "IN_PROGRESS", 0, 0, 0, 1)} <= set(counts)
