"""One query for each operator, over whole tables, and SQL for those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quorumlake.llm import collocations, decontam, filteraudit, neardup


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def vocabulary(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quorumlake.llm.secrets import secret_report

    return secret_report(table(spark, sf_dir, "documents"))


def op2_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quorumlake.llm.neardup import near_duplicates

    return near_duplicates(table(spark, sf_dir, "documents"), shingle=3, percent=85)


def op3_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quorumlake.llm.common import fresh_path
    from quorumlake.llm.tokenfile import digests, write_tokens

    at = fresh_path(spark, "tokens")
    write_tokens(table(spark, sf_dir, "documents"), at, vocabulary("word_bpe_49k.json"), end_id=2)
    return digests(spark, at)


def op4_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quorumlake.llm.mixture import mix

    return mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken", "copies")


def op5_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quorumlake.llm.htmltext import main_text

    pages = table(spark, sf_dir, "pages")
    # Row by row, so the url comes along as part of the key.
    keyed = pages.select(F.struct("page_id", "url").alias("page"), "html")
    return main_text(keyed, id_col="page").select("page.page_id", "page.url", "text", "n_chars")


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quorumlake.llm.tokcount import token_counts

    return token_counts(table(spark, sf_dir, "documents"), vocabulary("piece_bpe_32k.model"))


def op7_language_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quorumlake.llm.ctw import language_scores

    return language_scores(table(spark, sf_dir, "documents"), folds=7, held=2)


def op8_repeated_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quorumlake.llm.suffixdedup import remove_repeats

    return remove_repeats(table(spark, sf_dir, "documents"), length=200, keep_first=False).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quorumlake.llm.decontam import decontaminate

    found = decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), n=10)
    return found.select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quorumlake.llm.fertility import quality_rules

    found = quality_rules(table(spark, sf_dir, "documents"), vocabulary("piece_bpe_32k.model"), labels=table(spark, sf_dir, "labels"))
    return found.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "chars_per_token", "tokens_per_word", "byte_share", "token_entropy")


def op11_languages(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quorumlake.llm.langid import languages

    return languages(table(spark, sf_dir, "documents"), folds=4, held=2)


def op12_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(table(spark, sf_dir, "documents"))


def op13_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filteraudit.filter_audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def queries() -> dict:
    return {k: f for k, f in globals().items() if k.startswith("op") and callable(f)}


SQL: dict[str, str] = {"op2_near_duplicates": neardup.SQL, "op9_decontamination": decontam.SQL, "op12_collocations": collocations.SQL, "op13_filter_audit": filteraudit.SQL}
