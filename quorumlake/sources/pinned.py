"""Text files pinned to a digest tree of their bytes: leaves are ranges of a file, read by many tasks, whatever the splits."""

from __future__ import annotations

import hashlib
import struct
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quorumlake.shared import settled

#: Bytes of a file in a leaf: a line belongs to the leaf in which it begins.
LEAF = 1 << 20
#: Blocks whose starts are broadcast at once, about 40 bytes each.
BLOCKS = 100_000
#: Leaves that an error names.
NAMED = 10


class Unpinned(ValueError):
    """A file is not what it was pinned as."""


def raw_lines(spark: SparkSession, path: str) -> DataFrame:
    """file, block (where the task's part of the file begins), size (of the file) and value of every line, carriage returns kept."""
    text = spark.read.option("lineSep", "\n").text(path)
    return text.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.col("_metadata.file_size").alias("size"), "value")


def leaves(spark: SparkSession, path: str, leaf: int = LEAF) -> DataFrame:
    """file (its name), leaf, lines, bytes and digest of every leaf of the files under a path.

    Two passes over the bytes, neither of which moves a line: the first adds up
    the lines of each block, which tells where in the file a block's first line
    begins; the second hashes each line with its place.  A leaf's digest is made
    of the sums of its lines' SHA-256 in words of 32 bits, so it does not matter
    which task read which line.
    """
    lines = raw_lines(spark, path)
    sizes = lines.groupBy("file", "block").agg(F.sum(F.octet_length("value") + 1).alias("bytes"))
    earlier = F.coalesce(F.sum("bytes").over(Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    # One row for each block of a file; so many at most are broadcast, more come in turns.
    starts = settled(sizes.select(F.col("file").alias("_f"), F.col("block").alias("_b"), earlier.alias("at")))
    turns = max(1, -(-starts.count() // BLOCKS))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, place, sums = None, 0, {}

        def told() -> pa.RecordBatch:
            rows = [(f, k, *v) for (f, k), v in sums.items()]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), [pa.string()] + [pa.int64()] * 11)], ["file", "leaf", "lines", "bytes", *[f"w{k}" for k in range(8)]])

        for batch in batches:
            values = batch.column("value").cast(pa.binary()).to_pylist()
            for file, block, at, value in zip(batch.column("file").to_pylist(), batch.column("block").to_pylist(), batch.column("at").to_pylist(), values):
                if (file, block) != last:
                    last, place = (file, block), at
                s = sums.setdefault((file, place // leaf), [0] * 10)
                s[0] += 1
                s[1] += len(value) + 1
                for k, word in enumerate(struct.unpack(">8I", hashlib.sha256(struct.pack(">q", place) + value).digest())):
                    s[2 + k] += word
                place += len(value) + 1
            if len(sums) > 4096:
                yield told()
                sums = {}
        if sums:
            yield told()

    parts = None
    for turn in range(turns):
        mine = lambda c: F.pmod(F.xxhash64(c), F.lit(turns)) == turn  # noqa: B023,E731
        met = lines.filter(mine("file")).join(F.broadcast(starts.filter(mine("_f"))), (F.col("file") == F.col("_f")) & (F.col("block") == F.col("_b")))
        some = met.select("file", "block", "at", "value").mapInArrow(run, "file string, leaf long, lines long, bytes long, " + ", ".join(f"w{k} long" for k in range(8)))
        parts = some if parts is None else parts.unionByName(some)
    words = [f"w{k}" for k in range(8)]
    summed = parts.groupBy("file", "leaf").agg(*[F.sum(c).alias(c) for c in ("lines", "bytes", *words)])
    # The size tells a last line that is ended from one that is not.
    end = lines.groupBy("file").agg(F.first("size").alias("size"))
    whole = summed.join(end, "file")
    return whole.select(F.regexp_extract("file", "[^/]+$", 0).alias("file"), "leaf", "lines", "bytes", F.sha2(F.concat_ws(",", "lines", "bytes", "size", *words), 256).alias("digest"))


def pin(spark: SparkSession, path: str, to: str, leaf: int = LEAF) -> None:
    """Write the leaves of the files under a path as a table, once."""
    leaves(spark, path, leaf).write.mode("errorifexists").parquet(to)


def root(tree: DataFrame) -> str:
    """One digest of all leaves, added up as they are."""
    words = [F.sum(F.conv(F.substring(F.sha2(F.concat_ws("/", "file", "leaf", "digest"), 256), 8 * k + 1, 8), 16, 10).cast("long")).alias(f"w{k}") for k in range(8)]
    return tree.agg(F.count(F.lit(1)).alias("n"), *words).select(F.sha2(F.concat_ws(",", "n", *[f"w{k}" for k in range(8)]), 256).alias("d")).first().d


def differing(spark: SparkSession, path: str, pins: str, leaf: int = LEAF) -> DataFrame:
    """file, leaf and what is wrong with it: lost, added or altered."""
    now = leaves(spark, path, leaf).select("file", "leaf", F.col("digest").alias("_now"))
    both = spark.read.parquet(pins).select("file", "leaf", F.col("digest").alias("_then")).join(now, ["file", "leaf"], "full_outer")
    what = F.when(F.col("_now").isNull(), "lost").when(F.col("_then").isNull(), "added").when(F.col("_now") != F.col("_then"), "altered")
    return both.select("file", "leaf", what.alias("what")).filter("what IS NOT NULL")


def pinned_lines(spark: SparkSession, path: str, pins: str, leaf: int = LEAF) -> DataFrame:
    """The lines under a path, if its files are what they were pinned as; Unpinned names the ranges of bytes that are not."""
    wrong = differing(spark, path, pins, leaf).orderBy("file", "leaf").limit(NAMED).collect()
    if wrong:
        raise Unpinned("; ".join(f"{r.file} from byte {r.leaf * leaf}: {r.what}" for r in wrong))
    return raw_lines(spark, path)
