"""Runs over a range of items in parts: each part is computed by one run, and a later run computes only what is missing."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quorumlake.operators.evaluate import ranked
from quorumlake.shared import settled
from quorumlake.sources.versions import VersionedTable

LINEAGE = "part long, first string, last string, items long, run string, rows long, failed long"


def planned(items: DataFrame, key: str, size: int) -> DataFrame:
    """items with part: `size` items in the order of key to a part, from 0; and settled, as a plan is."""
    return settled(ranked(items, [key]).withColumn("part", F.floor((F.col("place") - 1) / size).cast("long")).drop("place"))


def resume(items: DataFrame, key: str, size: int, compute: Callable[[DataFrame], DataFrame], out: str, lineage: VersionedTable, run: str, *, identity: dict | None = None, most_parts: int | None = None) -> dict:
    """Compute the parts of a range that no run has done, at most so many; counts of parts done before, now and left.

    compute: from items (with part) to rows that keep part and key and may have
    `failed`.  What it fails on is a row as well and is not repaired by a later
    run.  Parts are folders of out, written whole by a dynamic partition
    overwrite, so those of a run that was killed before its lineage was put are
    computed anew and replaced, and no others are touched.  The lineage says
    which run wrote which part, from which item to which; a part whose items are
    no longer the planned ones, or a run of another identity, is refused.
    """
    base = lineage.latest()
    said = lineage.manifest(base)["tags"].get("identity")
    if base and said != (identity or {}):
        raise ValueError("the range was begun under another identity")
    plan = planned(items, key, size)
    text = F.col(key).cast("string")
    parts = plan.groupBy("part").agg(F.min_by(text, F.col(key)).alias("first"), F.max_by(text, F.col(key)).alias("last"), F.count(F.lit(1)).alias("items"))
    known = lineage.read(base, T.StructType.fromDDL(LINEAGE))
    both = settled(parts.join(known.select("part", F.col("first").alias("_f"), F.col("last").alias("_l"), F.col("items").alias("_n"), F.col("run").alias("_run")), "part", "full_outer"))
    moved = both.filter(F.col("_run").isNotNull() & ~(F.col("first").eqNullSafe(F.col("_f")) & F.col("last").eqNullSafe(F.col("_l")) & F.col("items").eqNullSafe(F.col("_n")))).orderBy("part").limit(5).collect()
    if moved:
        raise ValueError("other items than before in parts " + ", ".join(str(r.part) for r in moved))
    todo = both.filter("_run IS NULL").select("part", "first", "last", "items")
    if most_parts is not None:
        todo = todo.orderBy("part").limit(most_parts)
    todo = settled(todo)
    before, now = both.filter("_run IS NOT NULL").count(), todo.count()
    if now:
        rows = compute(plan.join(todo.select("part"), "part", "left_semi"))
        rows.write.partitionBy("part").mode("overwrite").option("partitionOverwriteMode", "dynamic").parquet(out)
        done = items.sparkSession.read.parquet(out).withColumn("part", F.col("part").cast("long"))
        failed = F.count_if("failed") if "failed" in done.columns else F.lit(0).cast("long")
        told = done.join(todo.select("part"), "part", "left_semi").groupBy("part").agg(F.count(F.lit(1)).alias("rows"), failed.alias("failed"))
        entries = todo.join(told, "part", "left").select("part", "first", "last", "items", F.lit(run).alias("run"), F.coalesce("rows", F.lit(0)).cast("long").alias("rows"), F.coalesce("failed", F.lit(0)).cast("long").alias("failed"))
        lineage.merge(entries, ["part"], tags={"identity": identity or {}})
    return {"before": before, "now": now, "left": both.count() - before - now}


def combined(spark, out: str, lineage: VersionedTable) -> DataFrame:
    """The rows of all parts that the lineage names, with the run that wrote each."""
    rows = spark.read.parquet(out).withColumn("part", F.col("part").cast("long"))
    return rows.join(lineage.read(schema=T.StructType.fromDDL(LINEAGE)).select("part", "run"), "part")
