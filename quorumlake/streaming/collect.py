"""Attempts as a stream: a state table kept by idempotent micro-batches, and windowed counts of outcomes."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from quorumlake.operators.evaluate import ranked
from quorumlake.operators.state import attempt_states
from quorumlake.sources.connectors import AUDIT, call_all
from quorumlake.sources.versions import Conflict, VersionedTable

ATTEMPT = "cache_key string, cycle int, attempt int, ok boolean, response string, at timestamp"


def attempts_stream(spark: SparkSession, path: str, schema: str = ATTEMPT) -> DataFrame:
    return spark.readStream.schema(schema).parquet(path)


def collect(stream: DataFrame, table: str, checkpoint: str) -> StreamingQuery:
    """Append attempts to a Parquet table, once each, for what is there now.

    Every micro-batch owns one folder, overwritten if the batch is repeated
    after a failure; reading drops attempts that a source delivered twice.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{table}/batch={batch_id}")

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def collected(spark: SparkSession, table: str) -> DataFrame:
    """Distinct attempts of the table."""
    return spark.read.parquet(table).drop("batch").dropDuplicates(["cache_key", "cycle", "attempt"])


def states(spark: SparkSession, table: str, most: int = 3) -> DataFrame:
    """The state of each key in its latest cycle; an explicit retry starts a new cycle."""
    rows = collected(spark, table)
    last = rows.groupBy("cache_key").agg(F.max("cycle").alias("cycle"))
    return attempt_states(rows.join(last, ["cache_key", "cycle"]), ["attempt"], most)


def outcome_counts(stream: DataFrame, late: str = "10 minutes", width: str = "5 minutes") -> DataFrame:
    """Attempts and failures in tumbling windows; what is later than the watermark is left out."""
    return stream.withWatermark("at", late).groupBy(F.window("at", width)).agg(F.count(F.lit(1)).alias("attempts"), F.count_if(~F.col("ok")).alias("failures"))


OUTCOMES = AUDIT + ", run string"


def collect_bounded(requests: DataFrame, table: VersionedTable, backend, checkpoint: str, *, run: str, most_new: int, every: int = 25, retry_failed: bool = False, **given) -> StreamingQuery:
    """Call a service for the requests of a stream (cache_key, request) that the table has no outcome of: at most most_new in this run.

    Requests are admitted in order of their keys, `every` at a time.  Outcomes of
    such a slice, failures included, become one version of the table together
    with how many the run has admitted; so a run that is killed and started
    again with its name and checkpoint goes on where it was, a micro-batch that
    is repeated finds its keys done, and no more than most_new are ever called.
    Responses that were written but not yet a version are taken up, not asked
    for again: a part is named after the version it follows.  Only calls under
    way when everything stops are made again, `every` at most.  With
    retry_failed, keys whose outcomes are all failures are asked anew; a table
    is read by outcomes_of, where a valid outcome wins over failures.
    """
    if most_new < 1 or every < 1:
        raise ValueError("most_new and every are 1 or more")

    def write(batch: DataFrame, batch_id: int) -> None:
        here = VersionedTable(batch.sparkSession, table.path)
        schema = T.StructType.fromDDL(OUTCOMES)
        base = here.latest()
        rows = here.read(base, schema)
        # A key that this run has asked is not asked again by it, whatever came of it.
        done = rows.filter((F.col("status") == "VALID") | (F.col("run") == run) | F.lit(not retry_failed))
        wanted = batch.select("cache_key", "request").dropDuplicates(["cache_key"])
        room = most_new - here.manifest(base)["tags"].get(f"admitted {run}", 0)
        if room < 1:
            return
        # The limit keeps no more than most_new rows, which bounds the loop as well.
        admitted = wanted.join(done.select("cache_key").distinct(), "cache_key", "left_anti").orderBy("cache_key").limit(room)
        pending = ranked(admitted, ["cache_key"])
        for low in range(0, pending.count(), every):
            some = pending.filter((F.col("place") > low) & (F.col("place") <= low + every)).drop("place")
            name = f"{re.sub('[^A-Za-z0-9_-]', '_', run)}-after-{base}"
            found = here.has_part(name)
            if not found:
                here.write_part(call_all(some, backend, **given).withColumn("run", F.lit(run)), name)
            asked = {f"admitted {run}": here.manifest(base)["tags"].get(f"admitted {run}", 0) + here.part(name).count()}
            try:
                base = here.commit(base, [name], tags=asked)
            except Conflict:
                # Another run was first; what this one was told is kept beside it.
                base = here.merge(here.part(name), ["cache_key", "run"], tags=asked)
            if found:
                # It may hold other requests than this slice.
                return write(batch, batch_id)

    return requests.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def outcomes_of(table: VersionedTable, version: int | None = None) -> DataFrame:
    """One outcome of each key: a valid one if there is any, else the failure of the run with the last name, with the calls made in all."""
    rows = table.read(version, T.StructType.fromDDL(OUTCOMES))
    rest = [c for c in rows.columns if c != "cache_key"]
    best = F.max_by(F.struct(*rest), F.struct((F.col("status") == "VALID").alias("v"), "run"))
    return rows.groupBy("cache_key").agg(best.alias("o"), F.sum("attempts").alias("calls")).select("cache_key", "o.request", "o.response", "o.status", "o.error", "o.run", "calls")
