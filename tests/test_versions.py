"""Versioned tables, exports and bounded collection: races, kills, damage and conflicts."""

import glob
import os
import threading

import pytest
from pyspark.sql import functions as F

from quorumlake.sources import exports as X
from quorumlake.sources.connectors import Retryable
from quorumlake.sources.versions import Conflict, Files, VersionedTable
from quorumlake.streaming import collect as S


def kv(spark, low, high, by=2):
    return spark.range(low, high).select(F.col("id").alias("k"), (F.col("id") * by).cast("string").alias("v"))


def values(df):
    return sorted((r.k, r.v) for r in df.collect())


def test_merge_is_idempotent_and_versions_stay(spark, tmp_path):
    t = VersionedTable(spark, str(tmp_path / "t"))
    with pytest.raises(ValueError):
        t.read()
    assert t.latest() == 0 and t.merge(kv(spark, 0, 5).union(kv(spark, 0, 5)), ["k"]) == 1
    pinned = t.read(1)
    assert t.merge(kv(spark, 3, 8, by=9), ["k"]) == 2 and t.merge(kv(spark, 3, 8, by=9), ["k"]) == 2
    assert values(pinned) == [(i, str(2 * i)) for i in range(5)]
    assert values(t.read()) == [(i, str(2 * i)) for i in range(5)] + [(i, str(9 * i)) for i in range(5, 8)]
    assert t.replace(kv(spark, 0, 2), 2) == 3 and t.compact() == 4
    assert values(t.read(3)) == values(t.read()) == [(0, "0"), (1, "2")] and t.manifest()["rows"] == 2 and t.read(2).count() == 8
    with pytest.raises(ValueError):
        t.commit(4, [t.write_part(spark.range(3))])


def test_one_of_many_writers_wins_and_readers_see_whole_versions(spark, tmp_path):
    t = VersionedTable(spark, str(tmp_path / "t"))
    t.merge(kv(spark, 0, 10), ["k"])
    parts, said, seen = [t.write_part(kv(spark, 100 * i, 100 * i + 10)) for i in range(1, 6)], [], []
    start = threading.Barrier(6)

    def write(part):
        start.wait()
        try:
            said.append(t.commit(1, [part]))
        except Conflict:
            said.append(None)

    def read():
        start.wait()
        for _ in range(3):
            seen.append(t.read().count())

    threads = [threading.Thread(target=write, args=(p,)) for p in parts] + [threading.Thread(target=read)]
    [x.start() for x in threads], [x.join() for x in threads]
    assert sorted(said, key=str) == [2, None, None, None, None] and t.read().count() == 20 and set(seen) <= {10, 20}
    assert not [x for x in os.listdir(tmp_path / "t" / "versions") if "tmp" in x.replace(".crc", "")]


def test_merging_writers_lose_nothing(spark, tmp_path):
    t = VersionedTable(spark, str(tmp_path / "t"))
    threads = [threading.Thread(target=t.merge, args=(kv(spark, 5 * i, 5 * i + 10), ["k"])) for i in range(4)]
    [x.start() for x in threads], [x.join() for x in threads]
    assert values(t.read()) == [(i, str(2 * i)) for i in range(25)]


def test_export_and_restore(spark, tmp_path):
    t = VersionedTable(spark, str(tmp_path / "t"))
    t.merge(kv(spark, 0, 300).withColumn("v", F.when(F.col("k") != 7, F.col("v"))), ["k"])
    at = str(tmp_path / "exports" / "a")
    m = X.export_table(t, at, ["k"], leaves=16)
    assert m["rows"] == 300 and X.verify_export(spark, at)[1] == []
    # Order and files do not matter to the tree.
    assert X.root_digest(X.told(X.digest_leaves(t.read().orderBy(F.desc("v")).repartition(7), ["k"], 16))) == m["root"]
    with pytest.raises(Conflict):
        X.export_table(t, at, ["k"])
    into = VersionedTable(spark, str(tmp_path / "u"))
    into.merge(kv(spark, 290, 310), ["k"])
    assert X.restore_table(at, into) == {"NEW": 290, "SAME": 10, "KEPT": 10} and into.read().count() == 310
    assert X.restore_table(at, into) == {"NEW": 0, "SAME": 300, "KEPT": 10} and into.latest() == 2
    clash = VersionedTable(spark, str(tmp_path / "c"))
    clash.merge(kv(spark, 5, 9, by=3), ["k"])
    with pytest.raises(Conflict, match="5, 6, 7, 8"):
        X.restore_table(at, clash)
    assert clash.latest() == 1


def test_damage_is_named(spark, tmp_path):
    t = VersionedTable(spark, str(tmp_path / "t"))
    t.merge(kv(spark, 0, 200), ["k"])
    X.export_table(t, str(tmp_path / "e" / "whole"), ["k"], leaves=4)
    X.export_table(t, str(tmp_path / "e" / "bad"), ["k"], leaves=4)
    bad = str(tmp_path / "e" / "bad")
    file = glob.glob(f"{bad}/rows/_leaf=2/*.parquet")[0]
    raw = bytearray(open(file, "rb").read())
    # Bytes of the values; one of the footer's texts would change no row, and be no damage.
    for at in (len(raw) // 3, len(raw) // 4):
        broken = bytearray(raw)
        broken[at] ^= 1
        open(file, "wb").write(broken)
        for crc in glob.glob(f"{bad}/rows/_leaf=2/.*.crc"):
            os.remove(crc)
        faults = X.verify_export(spark, bad)[1]
        assert len(faults) == 1 and faults[0].startswith("leaf 2:")
    os.remove(file)
    assert [x.split(":")[0] for x in X.verify_export(spark, bad)[1]] == ["leaf 2"]
    with pytest.raises(ValueError, match="leaf 2: 0 rows"):
        X.restore_table(bad, VersionedTable(spark, str(tmp_path / "n")))
    assert X.newest_export(spark, str(tmp_path / "e")).endswith("/whole")


def backend(log, broken_at=None, busy=()):
    """A client that writes down every call; the call for broken_at stops the run."""

    def client():
        def call(request):
            with open(log, "a") as f:
                f.write(request + "\n")
            if request == broken_at:
                raise KeyboardInterrupt("killed")
            if request in busy:
                raise Retryable("busy")
            return request.upper()

        return call

    return client


def run(spark, tmp_path, name, client, checkpoint=None, **more):
    t = VersionedTable(spark, str(tmp_path / "t"))
    stream = spark.readStream.schema("cache_key string, request string").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    q = S.collect_bounded(stream, t, client, str(tmp_path / f"ck-{checkpoint or name}"), run=name, pause=0, sleep=lambda s: None, **more)
    q.awaitTermination()
    return t


def calls(log):
    return sorted(open(log).read().split()) if os.path.exists(log) else []


def test_bounded_collection(spark, tmp_path):
    rows = spark.range(40).select(F.format_string("k%03d", "id").alias("cache_key"), F.format_string("q%03d", "id").alias("request"))
    rows.repartition(3).write.parquet(str(tmp_path / "in"))
    log = str(tmp_path / "log")
    t = run(spark, tmp_path, "one", backend(log, busy=("q003",)), most_new=12, every=5)
    assert len(set(calls(log))) == 12 and t.read().count() == 12 and t.manifest()["tags"]["admitted one"] == 12
    before = calls(log)
    t = run(spark, tmp_path, "one", backend(log), most_new=12, every=5, checkpoint="again")
    assert calls(log) == before
    t = run(spark, tmp_path, "two", backend(log), most_new=100, every=7)
    once = [c for c in calls(log) if c != "q003"]
    assert once == [f"q{i:03d}" for i in range(40) if i != 3]
    state = {r.cache_key: r.status for r in S.outcomes_of(t).collect()}
    tried = "k003" in {r.cache_key for r in t.read(1).collect()} or state["k003"] in ("FAILED", "VALID")
    assert len(state) == 40 and tried
    t = run(spark, tmp_path, "xthree", backend(log), most_new=100, every=7, retry_failed=True)
    assert {r.status for r in S.outcomes_of(t).collect()} == {"VALID"} and t.read().groupBy("cache_key").count().filter("count > 2").count() == 0


def test_a_killed_run_goes_on(spark, tmp_path):
    """The run stops in the third slice; started again, it gives the same table and no finished call is made twice."""
    rows = spark.range(20).select(F.format_string("k%03d", "id").alias("cache_key"), F.format_string("q%03d", "id").alias("request"))
    rows.coalesce(1).write.parquet(str(tmp_path / "in"))
    log = str(tmp_path / "log")
    with pytest.raises(Exception):
        run(spark, tmp_path, "r", backend(log, broken_at="q009"), most_new=15, every=4)
    t = VersionedTable(spark, str(tmp_path / "t"))
    assert t.latest() == 2 and t.read().count() == 8
    # Responses of the third slice that were written, but no version yet, are taken up.
    some = spark.createDataFrame([(f"k{i:03d}", f"q{i:03d}", "TAKEN UP", "VALID", 1, None, "r") for i in range(8, 12)], S.OUTCOMES)
    t.write_part(some, "r-after-2")
    open(log, "w").close()
    t = run(spark, tmp_path, "r", backend(log), most_new=15, every=4)
    assert calls(log) == ["q012", "q013", "q014"] and t.read().count() == 15 and t.read().filter("response = 'TAKEN UP'").count() == 4
    assert sorted(r.cache_key for r in t.read().collect()) == [f"k{i:03d}" for i in range(15)]
    with pytest.raises(ValueError):
        run(spark, tmp_path, "z", backend(log), most_new=0)


def test_put_if_absent(spark, tmp_path):
    f = Files(spark, f"file://{tmp_path}/f")
    assert f.put_if_absent("a", "first") and not f.put_if_absent("a", "second") and f.text("a") == "first"
