"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import ctypes
import gc
import sys
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Words of the contracts: runs of anything but ASCII white space.
SPACES = r"[\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir; where that is unset and the master is local, one of our own."""
    sc = spark.sparkContext
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not sc.getCheckpointDir():
        if not base and not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = base or tempfile.mkdtemp(prefix="quorumlake-")
        sc.setCheckpointDir(base)
    return base or sc.getCheckpointDir()


def fresh_path(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that no other run uses."""
    return f"{shared_dir(spark).rstrip('/')}/quorumlake-{name}-{uuid.uuid4().hex}"


def cut(df: DataFrame) -> DataFrame:
    """Write df to the shared checkpoint folder and continue from there: a lost executor costs no recomputation."""
    shared_dir(df.sparkSession)
    return df.checkpoint()


def lower_ascii(c: Column) -> Column:
    """A-Z to a-z and nothing else; pure ASCII strings take the fast built-in."""
    return F.when(F.octet_length(c) == F.length(c), F.lower(c)).otherwise(F.translate(c, UPPER, LOWER))


def kept_in_worker(key: tuple, make: Callable):
    """An object that a Python worker keeps from task to task; it keeps one at a time, as workers outlive stages."""
    store = sys.__dict__.setdefault("_quorumlake_worker", {})
    if key not in store:
        forget_in_worker()
        store[key] = make()
    return store[key]


def forget_in_worker() -> None:
    """Drop what earlier stages left in this worker and give its pages back: the stage that begins needs the memory."""
    store = sys.__dict__.setdefault("_quorumlake_worker", {})
    if store:
        store.clear()
        gc.collect()
        pa.default_memory_pool().release_unused()
        # glibc keeps freed memory otherwise; other C libraries have no such call.
        trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
        if trim is not None:
            trim(0)


def texts_of(batch: pa.RecordBatch, name: str = "text") -> list[bytes]:
    """UTF-8 bytes of a string column; null is empty."""
    return [x or b"" for x in batch.column(name).cast(pa.binary()).to_pylist()]


def pieces(batch: pa.RecordBatch, limit: int = 16 << 20, name: str = "text") -> Iterator[pa.RecordBatch]:
    """Slices of a batch with about limit bytes of text each, one row at least."""
    sizes = pa.compute.fill_null(pa.compute.binary_length(batch.column(name).cast(pa.binary())), 0).to_pylist()
    start = total = 0
    for i, n in enumerate(sizes):
        if total and total + n > limit:
            yield batch.slice(start, i - start)
            start, total = i, 0
        total += n
    if start < len(sizes):
        yield batch.slice(start)


def runs_of(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[tuple[tuple, pa.Table]]:
    """(key, rows) of input sorted by keys, one key at a time; a key may cross batches."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        cols = [batch.column(k).to_pylist() for k in keys]
        start = 0
        for i, now in enumerate(zip(*cols)):
            if now != last:
                if i > start:
                    held.append(batch.slice(start, i - start))
                if held:
                    yield last, pa.Table.from_batches(held)
                held, start, last = [], i, now
        if start < batch.num_rows:
            held.append(batch.slice(start))
    if held:
        yield last, pa.Table.from_batches(held)


def numbered(df: DataFrame, *order: Column) -> DataFrame:
    """df with `number`, its rows' places in order from 0: range partitions are numbered apart and shifted, no task sees all rows."""
    placed = cut(df.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()))
    ranked = placed.withColumn("_own", F.row_number().over(Window.partitionBy("_part").orderBy(*order)))
    # As many rows as there are partitions.
    sizes = placed.groupBy("_part").agg(F.count(F.lit(1)).alias("n"))
    before = F.coalesce(F.sum("n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    shifts = sizes.select(F.col("_part").alias("_of"), before.alias("_before"))
    return ranked.join(F.broadcast(shifts), F.col("_part") == F.col("_of")).withColumn("number", F.col("_before") + F.col("_own") - 1).drop("_part", "_own", "_of", "_before")
