"""Token ids in Parquet: list columns with dictionary encoding, bounded row groups and page indexes."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quorumlake.llm.common import kept_in_worker, pieces
from quorumlake.llm.tokens import WhiteSpaceWords

#: Row groups small enough to skip, pages of few rows so that page indexes narrow a read to some documents.
LAYOUT = {"parquet.block.size": 32 << 20, "parquet.page.size": 256 << 10, "parquet.page.row.count.limit": 1024, "parquet.enable.dictionary": "true", "parquet.dictionary.page.size": 1 << 20, "compression": "zstd"}


def encoded(docs: DataFrame, path: str, end_id: int, id_col: str, text_col: str) -> DataFrame:
    """doc_id, local_start, n_tokens, tokens and shard, in ascending id over the shards."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = kept_in_worker(("words", path), lambda: WhiteSpaceWords(path))
        start = 0
        for whole in batches:
            for batch in pieces(whole, 4 << 20):
                tokens = coder.lists(batch.column("text").cast(pa.string()), end_id)
                offsets = tokens.offsets.to_numpy().astype(np.int64)
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(start + offsets[:-1]), pa.array(np.diff(offsets)), tokens], ["id", "local_start", "n_tokens", "tokens"])
                start += int(offsets[-1])

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    placed = rows.repartitionByRange("id").sortWithinPartitions("id", "text")
    return placed.mapInArrow(run, f"id {kind}, local_start long, n_tokens long, tokens array<int>").withColumnRenamed("id", id_col).withColumn("shard", F.spark_partition_id())


def write_tokens(docs: DataFrame, to: str, path: str, *, end_id: int = 2, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Encode every row's whole text with the vocabulary at path, append end_id, and write Parquet files to the folder `to`.

    Rows are in ascending id through the shards, null ids first; rows of one id
    are ordered by text.  Null and empty texts have the end id alone.  Repeated
    rows are written each; an empty table writes no rows; other columns are not
    read.  Each row holds the place of its first token in its shard.
    """
    encoded(docs, path, end_id, id_col, text_col).write.options(**LAYOUT).parquet(to)


def read_index(spark: SparkSession, at: str, id_col: str = "doc_id") -> DataFrame:
    """id, start (tokens of all rows before it), n_tokens: reads no token column."""
    rows = spark.read.parquet(at).select(id_col, "shard", "local_start", "n_tokens")
    return rows.join(shard_starts(spark, at), "shard").select(id_col, (F.col("shard_start") + F.col("local_start")).alias("start"), "n_tokens")


def read_tokens(spark: SparkSession, at: str, low, high, id_col: str = "doc_id") -> DataFrame:
    """id and tokens of the rows with low <= id <= high: row groups and pages outside are skipped."""
    return spark.read.parquet(at).filter(F.col(id_col).between(low, high)).select(id_col, "tokens")


def shard_starts(spark: SparkSession, at: str) -> DataFrame:
    """shard and the tokens of all shards before it; as many rows as the files have writers."""
    sums = spark.read.parquet(at).groupBy("shard").agg(F.sum("n_tokens").alias("n"))
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    return sums.select("shard", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("shard_start"))


def digests(spark: SparkSession, at: str, id_col: str = "doc_id") -> DataFrame:
    """id, start, n_tokens and ids_crc32 of every row, from the token lists in the files."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(3)
            offsets = lists.offsets.to_numpy()
            raw = memoryview(lists.values.to_numpy(zero_copy_only=False).astype("<u4")).cast("B")
            sums = [zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist())]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(2), pa.array(np.diff(offsets).astype(np.int64)), pa.array(sums, pa.int64())], ["id", "shard", "local_start", "n_tokens", "ids_crc32"])

    rows = spark.read.parquet(at).select(F.col(id_col).alias("id"), "shard", "local_start", "tokens")
    kind = rows.schema["id"].dataType.simpleString()
    found = rows.mapInArrow(run, f"id {kind}, shard int, local_start long, n_tokens long, ids_crc32 long")
    return found.join(shard_starts(spark, at), "shard").select(F.col("id").alias(id_col), (F.col("shard_start") + F.col("local_start")).alias("start"), "n_tokens", "ids_crc32")
