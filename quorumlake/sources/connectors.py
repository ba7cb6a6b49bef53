"""Calls to outside services behind an interface: cached, paced, retried and audited."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator
from email.utils import parsedate_to_datetime

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quorumlake.shared import settled

#: Least seconds between calls, calls for one request, ids in a request.
LEAST_PAUSE, ATTEMPTS, BATCH = 1 / 3, 3, 200
AUDIT = "cache_key string, request string, response string, status string, attempts int, error string"
AUDIT_COLUMNS = [x.split()[0] for x in AUDIT.split(", ")]


def retry_delay(attempt: int, retry_after: str | None = None, now: float | None = None) -> float:
    """Seconds before the next attempt: doubling up to 30, or what the service asks for, in seconds or as a date."""
    delay = min(2.0**attempt, 30.0)
    if retry_after:
        try:
            asked = float(retry_after)
        except ValueError:
            try:
                asked = parsedate_to_datetime(retry_after).timestamp() - (time.time() if now is None else now)
            except (TypeError, ValueError):
                asked = 0.0
        delay = max(delay, asked)
    return max(delay, 0.0)


class Retryable(Exception):
    """An outcome that may change: a busy or failing service.  retry_after: what it asks for."""

    def __init__(self, message: str, retry_after: str | None = None):
        super().__init__(message)
        self.retry_after = retry_after


def call_all(requests: DataFrame, backend: Callable[[], Callable[[str], str]], *, attempts: int = ATTEMPTS, pause: float = LEAST_PAUSE, sleep: Callable[[float], None] = time.sleep, lanes: int = 1) -> DataFrame:
    """Outcome of every request (cache_key, request): VALID with its response, or FAILED after its attempts.

    backend() makes the client inside the task.  Calls share `lanes` tasks, each
    pausing between calls, so the service's rate holds for the whole job.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        client, last = backend(), None
        for batch in batches:
            rows = []
            for key, request in zip(batch.column("cache_key").to_pylist(), batch.column("request").to_pylist()):
                response = error = None
                n = 0
                while n < attempts and response is None:
                    if last is not None and (wait := pause * lanes - (time.monotonic() - last)) > 0:
                        sleep(wait)
                    n, last = n + 1, time.monotonic()
                    try:
                        response = client(request)
                    except Retryable as e:
                        error = f"{type(e).__name__}: {e}"[:200]
                        if n < attempts:
                            sleep(retry_delay(n, e.retry_after))
                    except Exception as e:  # not worth another attempt, but recorded
                        error = f"{type(e).__name__}: {e}"[:200]
                        break
                rows.append((key, request, response, "VALID" if response is not None else "FAILED", n, None if response is not None else error))
            kinds = [pa.string()] * 4 + [pa.int32(), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(zip(*rows), kinds)] if rows else [pa.array([], k) for k in kinds], AUDIT_COLUMNS)

    return requests.select("cache_key", "request").repartition(lanes).mapInArrow(run, AUDIT)


def sealed(outcomes: DataFrame) -> DataFrame:
    """Outcomes with `digest`, the SHA-256 of their other columns: a row that was altered no longer fits it."""
    return outcomes.withColumn("digest", F.sha2(F.to_json(F.struct(*[F.col(c) for c in AUDIT_COLUMNS]), {"ignoreNullFields": "false"}), 256))


def intact(cache: DataFrame) -> DataFrame:
    """Rows of a sealed cache whose digest fits; the others count as not there."""
    return sealed(cache.withColumnRenamed("digest", "_given")).filter(F.col("digest") == F.col("_given")).drop("_given")


def reusable(cache: DataFrame, agrees: Column) -> tuple[DataFrame, DataFrame]:
    """(rows that may be used again, counts by reason of all others): intact, VALID and made under conditions that agree."""
    judged = sealed(cache.withColumnRenamed("digest", "_given"))
    why = F.when(~F.coalesce(F.col("digest") == F.col("_given"), F.lit(False)), "DIGEST").when(F.col("status") != "VALID", "STATUS").when(~F.coalesce(agrees, F.lit(False)), "CONDITIONS")
    judged = judged.withColumn("_why", why).drop("_given")
    return judged.filter("_why IS NULL").drop("_why"), judged.filter("_why IS NOT NULL").groupBy(F.col("_why").alias("reason")).agg(F.count(F.lit(1)).alias("n"))


def cached_calls(requests: DataFrame, cache: DataFrame, backend, retry_failed: bool = False, **given) -> tuple[DataFrame, DataFrame]:
    """(results of all requests, new outcomes to append to the cache): only keys without a usable outcome are called, each once.

    requests: cache_key and request; equal keys are called once.  Failures are
    kept and not repeated unless retry_failed.  The new outcomes are written out
    before either frame is returned, so using both, or losing an executor
    afterwards, calls nothing again.  A cache with digests gives its intact rows
    only, and the new outcomes are sealed likewise.
    """
    seal = "digest" in cache.columns
    usable = (intact(cache) if seal else cache).filter(F.col("status").isin("VALID", *([] if retry_failed else ["FAILED"])))
    called = call_all(requests.dropDuplicates(["cache_key"]).join(usable.select("cache_key"), "cache_key", "left_anti"), backend, **given)
    fresh = settled(sealed(called) if seal else called)
    known = usable.join(requests.select("cache_key").distinct(), "cache_key", "left_semi")
    return known.unionByName(fresh), fresh
