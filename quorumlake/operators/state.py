"""Resumable inference as tables: attempts, states, journals, missing work and first writers."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quorumlake.operators.evaluate import ranked


def attempt_states(attempts: DataFrame, order: list[str], most: int = 3) -> DataFrame:
    """cache_key, status and attempts: VALID at the first success within `most` attempts, FAILED once that many failed, else INCOMPLETE.

    attempts: cache_key, ok and the order columns.  Later attempts do not count.
    """
    placed = attempts.withColumn("n", F.row_number().over(Window.partitionBy("cache_key").orderBy(*order))).filter(F.col("n") <= most)
    first, made = F.min(F.when(F.col("ok"), F.col("n"))), F.count(F.lit(1))
    got = placed.groupBy("cache_key").agg(first.alias("first"), made.alias("made"))
    status = F.when(F.col("first").isNotNull(), "VALID").when(F.col("made") >= most, "FAILED").otherwise("INCOMPLETE")
    return got.select("cache_key", status.alias("status"), F.coalesce("first", "made").cast("long").alias("attempts"))


def scan_states(expected: DataFrame, cached: DataFrame, failed: DataFrame, intents: DataFrame | None = None, keys: list[str] = ["cache_key"]) -> DataFrame:  # noqa: B006
    """Status of every expected key: VALID, FAILED, INTERRUPTED (an intent without an outcome) or MISSING."""
    mark = lambda df, name: df.select(*keys, F.lit(True).alias(name)).distinct()
    got = expected.join(mark(cached, "_valid"), keys, "left").join(mark(failed, "_failed"), keys, "left")
    got = got.join(mark(intents, "_intent"), keys, "left") if intents is not None else got.withColumn("_intent", F.lit(None).cast("boolean"))
    status = F.when(F.col("_valid"), "VALID").when(F.col("_failed"), "FAILED").when(F.col("_intent"), "INTERRUPTED").otherwise("MISSING")
    return got.withColumn("status", status).drop("_valid", "_failed", "_intent")


def pending(expected: DataFrame, states: DataFrame, retry_failed: bool = False, keys: list[str] = ["cache_key"]) -> DataFrame:  # noqa: B006
    """Keys still to be computed: what is not VALID and, unless asked for, not FAILED."""
    done = states.filter(F.col("status").isin("VALID", *([] if retry_failed else ["FAILED"])))
    return expected.join(done.select(*keys), keys, "left_anti")


def first_writer(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """One row for each key: the earliest, as a write-once cache keeps it."""
    rest = [c for c in rows.columns if c not in keys]
    return rows.groupBy(*keys).agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("_row")).select(*keys, "_row.*")


def fold_journal(entries: DataFrame, keys: list[str], value: str = "value", revision: str = "revision") -> DataFrame:
    """The value of the latest revision of each key."""
    return entries.groupBy(*keys).agg(F.max_by(value, revision).alias(value), F.max(revision).alias(revision))


def broken_links(revisions: DataFrame, revision: str = "revision", parent: str = "parent_sha", own: str = "sha") -> DataFrame:
    """Revisions whose parent is not the revision before them; the first must name none.

    Places in the order meet their neighbours in a join, so no task sees the whole chain.
    """
    placed = ranked(revisions, [revision])
    before = placed.select((F.col("place") + 1).alias("place"), F.col(own).alias("_before"))
    return placed.join(before, "place", "left").filter(~F.col(parent).eqNullSafe(F.col("_before"))).drop("_before", "place")


def overwritten_valid(entries: DataFrame, keys: list[str], value: str = "value", status: str = "status", revision: str = "revision") -> DataFrame:
    """Entries that change a value which an earlier revision had as VALID: a journal must have none."""
    w = Window.partitionBy(*keys).orderBy(revision).rowsBetween(Window.unboundedPreceding, -1)
    kept = F.first(F.when(F.col(status) == "VALID", F.col(value)), ignorenulls=True).over(w)
    return entries.withColumn("_kept", kept).filter(F.col("_kept").isNotNull() & ~F.col(value).eqNullSafe(F.col("_kept"))).drop("_kept")


def best_checkpoint(checkpoints: DataFrame, least_valid: int = 0) -> DataFrame:
    """The checkpoint with most valid, then most done, samples, then the newest; none under least_valid."""
    order = F.struct(F.col("valid"), F.col("valid") + F.col("failed"), F.col("created_at"), F.col("path"))
    ok = checkpoints.filter(F.col("valid") >= least_valid)
    return ok.agg(F.max_by(F.struct(*checkpoints.columns), order).alias("c")).filter("c IS NOT NULL").select("c.*")


def changed_files(before: DataFrame, after: DataFrame) -> DataFrame:
    """Paths whose sha differs, came or went between two inventories (path, sha)."""
    both = before.withColumnRenamed("sha", "sha_before").join(after.withColumnRenamed("sha", "sha_after"), "path", "full_outer")
    return both.filter(~F.col("sha_before").eqNullSafe(F.col("sha_after")))
