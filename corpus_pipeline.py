"""A corpus pipeline: quality rules, near duplicates, decontamination, mixing to target weights, token files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quorumlake.llm.common import fresh_path
from quorumlake.llm.decontam import decontaminate
from quorumlake.llm.fertility import quality_rules
from quorumlake.llm.mixture import mix
from quorumlake.llm.neardup import near_duplicates
from quorumlake.llm.queries import vocabulary
from quorumlake.llm.tokenfile import digests, write_tokens

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def keyed(docs: DataFrame) -> DataFrame:
    """docs with _key, which tells rows apart that differ in any column and sorts by id, null ids last."""
    absent, number = F.col("doc_id").isNull(), F.coalesce(F.col("doc_id"), F.lit(0))
    return docs.select(*COLUMNS, F.struct(absent.alias("absent"), number.alias("number"), F.xxhash64(*COLUMNS).alias("h")).alias("_key"))


def with_verdict(docs: DataFrame, verdicts: DataFrame, *columns: str) -> DataFrame:
    """Keyed docs with columns of the verdicts on them; equal rows have equal verdicts."""
    named = verdicts.select(F.col("_key").alias("_of"), *columns).dropDuplicates(["_of"])
    return docs.join(named, docs["_key"] == named["_of"])


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep, by bands fitted on all labelled good ones."""
    docs = keyed(docs)
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    verdicts = quality_rules(docs, vocabulary("piece_bpe_32k.model"), id_col="_key", labels=labels, match_col="doc_id")
    return with_verdict(docs, verdicts.filter("kept")).select(COLUMNS)


def keep_distinct(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: five-word shingles, similarity of 0.8 or more."""
    docs = keyed(docs)
    verdicts = near_duplicates(docs, shingle=5, percent=80, id_col="_key").filter("kept")
    return with_verdict(docs, verdicts).dropDuplicates(["_key"]).select(COLUMNS)


def keep_clean(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of ten words of the benchmark."""
    docs = keyed(docs)
    verdicts = decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), n=10, id_col="_key")
    return with_verdict(docs, verdicts.filter("NOT contaminated")).select(COLUMNS)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it."""
    docs = keyed(docs)
    taken = with_verdict(docs, mix(docs, id_col="_key").filter("copies > 0"), "copies")
    return taken.withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("copies")))).select(COLUMNS)


def token_files(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token files of the mix, read back: where each document's tokens start, how many they are and their checksum."""
    at = fresh_path(spark, "corpus")
    write_tokens(docs, at, vocabulary("word_bpe_49k.json"), end_id=2)
    return digests(spark, at)


STAGES = [("quality rules", keep_good), ("near duplicates", keep_distinct), ("decontamination", keep_clean), ("source mix", mix_sources), ("token files", token_files)]

#: Models, random rounding and token ids are beyond SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each is written and read again before the next.

    Rows are told apart by all their columns, so null ids are kept like others
    and texts that share an id are judged each on its own; of rows equal in every
    column one stays.  Null and empty texts fail the quality rules.  An empty
    table gives no rows; columns that documents do not have are not carried on.
    """
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            at = fresh_path(spark, f"stage{k}")
            docs.write.parquet(at)
            docs = spark.read.parquet(at)
    return docs
