"""Strict scans: JSON lines with physical line numbers and rejects, questions, evidence, CSV, unions and overrides."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

EVIDENCE_VERSION = "2.0"


def lines(spark: SparkSession, path: str) -> DataFrame:
    """file, line (from 1, blank lines counted) and value of text files of any size.

    Blocks of a file are numbered apart and shifted by the lines of the blocks
    before them, so no file has to fit one task.
    """
    raw = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("_at"))
    inside = raw.withColumn("_n", F.row_number().over(Window.partitionBy("file", "block").orderBy("_at")))
    sizes = raw.groupBy("file", "block").agg(F.count(F.lit(1)).alias("_size"))
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    shifts = sizes.select("file", "block", F.coalesce(F.sum("_size").over(before), F.lit(0)).alias("_before"))
    return inside.join(shifts, ["file", "block"]).select("file", (F.col("_n") + F.col("_before")).alias("line"), "value")


def json_records(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Objects (file, line, value, record as variant) and rejects (file, line, reason) of JSON lines; blank lines are neither.

    Duplicate keys, trailing text and what is no object are rejected.
    """
    given = lines(spark, path).filter(F.trim("value") != "").withColumn("record", F.try_parse_json("value"))
    kind = F.schema_of_variant("record")
    reason = F.when(F.col("record").isNull(), "invalid JSON").when(~kind.startswith("OBJECT"), "not an object")
    checked = given.withColumn("reason", reason)
    return checked.filter("reason IS NULL").drop("reason"), checked.filter("reason IS NOT NULL").select("file", "line", "reason")


def text_field(name: str) -> Column:
    """A field that is a string and not blank; null otherwise."""
    v = F.try_variant_get("record", f"$.{name}", "string")
    return F.when((F.schema_of_variant(F.variant_get("record", f"$.{name}", "variant")) == "STRING") & (F.trim(v) != ""), v)


def options_field(name: str = "options") -> Column:
    """array of (label, text) in the order of the file: a mapping's own, or A, B, C... for a list."""
    raw = F.get_json_object("value", f"$.{name}")
    mapped = F.transform(F.map_entries(F.from_json(raw, "map<string,string>")), lambda e: F.struct(e["key"].alias("label"), e["value"].alias("text")))
    listed = F.transform(F.from_json(raw, "array<string>"), lambda t, i: F.struct(F.char(F.lit(65) + i).alias("label"), t.alias("text")))
    return F.when(raw.startswith("{"), mapped).when(raw.startswith("["), listed)


def answer_index(answer: Column, is_number: Column, labels: Column, texts: Column) -> Column:
    """0-based: a JSON integer is an index, a string is a label, else an option's text; null if none fits."""
    number = F.when(is_number, answer.try_cast("int"))
    place = F.coalesce(F.nullif(F.array_position(labels, answer), F.lit(0)), F.nullif(F.array_position(texts, answer), F.lit(0))) - 1
    found = F.when(is_number, number).otherwise(place).cast("int")
    return F.when((found >= 0) & (found < F.size(labels)), found)


def questions(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Questions (question_id, question, options, answer_index, relevant) and rejects with their reasons."""
    good, rejects = json_records(spark, path)
    ids = F.coalesce(text_field("id"), text_field("question_id"))
    answer = F.get_json_object("value", "$.answer")
    number = F.schema_of_variant(F.variant_get("record", "$.answer", "variant")) == "BIGINT"
    relevant = F.coalesce(F.from_json(F.get_json_object("value", "$.relevant_doc_ids"), "array<string>"), F.array().cast("array<string>"))
    parsed = good.select("file", "line", ids.alias("question_id"), text_field("question").alias("question"), options_field().alias("options"), answer.alias("_a"), number.alias("_n"), relevant.alias("relevant"))
    labels, texts = F.transform("options", lambda o: o["label"]), F.transform("options", lambda o: o["text"])
    parsed = parsed.withColumn("answer_index", answer_index(F.col("_a"), F.coalesce("_n", F.lit(False)), labels, texts))
    again = F.count(F.lit(1)).over(Window.partitionBy("question_id")) > 1
    blank = F.exists("options", lambda o: F.coalesce(F.trim(o["text"]) == "", F.lit(True)) | (F.trim(o["label"]) == ""))
    reason = (
        F.when(F.col("question_id").isNull(), "id must be a nonblank string").when(F.col("question").isNull(), "question must be a nonblank string")
        .when(F.col("options").isNull() | (F.size("options") < 2), "at least two options").when(blank, "blank option").when(F.size(F.array_distinct(labels)) < F.size(labels), "duplicate option label")
        .when(F.col("answer_index").isNull(), "answer is no option").when(again, "duplicate question id")
    )
    judged = parsed.withColumn("reason", reason)
    bad = judged.filter("reason IS NOT NULL").select("file", "line", "reason")
    return judged.filter("reason IS NULL").select("question_id", "question", "options", "answer_index", "relevant"), rejects.unionByName(bad)


def evidence(spark: SparkSession, path: str, version: str = EVIDENCE_VERSION) -> tuple[DataFrame, DataFrame]:
    """Evidence (question_id, doc_id, doc_rank, text, source, evidence_type, retrieval_score, stances) and rejects."""
    good, rejects = json_records(spark, path)
    rank = F.try_variant_get("record", "$.rank", "int")
    score_kind = F.schema_of_variant(F.variant_get("record", "$.retrieval_score", "variant"))
    score = F.when(~score_kind.isin("STRING", "BOOLEAN", "VOID"), F.try_variant_get("record", "$.retrieval_score", "double"))
    parsed = good.select(
        "file", "line", text_field("schema_version").alias("_version"), text_field("question_id").alias("question_id"), text_field("doc_id").alias("doc_id"), rank.alias("doc_rank"), text_field("text").alias("text"),
        text_field("source").alias("source"), text_field("evidence_type").alias("evidence_type"), score.alias("retrieval_score"), F.from_json(F.get_json_object("value", "$.annotated_stances"), "map<string,string>").alias("stances"),
    )
    same = lambda *k: F.count(F.lit(1)).over(Window.partitionBy(*k)) > 1
    missing = F.col("question_id").isNull() | F.col("doc_id").isNull() | F.col("text").isNull() | F.col("source").isNull()
    finite = F.col("retrieval_score").isNotNull() & ~F.isnan("retrieval_score") & (F.abs("retrieval_score") < float("inf"))
    reason = (
        F.when(~F.col("_version").eqNullSafe(F.lit(version)), "schema_version").when(missing, "blank field").when(F.col("doc_rank").isNull() | (F.col("doc_rank") < 1), "rank must be 1 or more")
        .when(~finite, "retrieval_score must be finite").when(same("question_id", "doc_id"), "duplicate document").when(same("question_id", "doc_rank"), "duplicate rank")
    )
    judged = parsed.withColumn("reason", reason)
    bad = judged.filter("reason IS NOT NULL").select("file", "line", "reason")
    return judged.filter("reason IS NULL").drop("file", "line", "_version", "reason"), rejects.unionByName(bad)


def first_lines(spark: SparkSession, path: str, limit: int) -> tuple[DataFrame, DataFrame]:
    """The first `limit` nonblank lines as records and rejects: a malformed line uses up its place."""
    given = lines(spark, path).filter(F.trim("value") != "")
    placed = given.withColumn("_place", F.row_number().over(Window.orderBy("file", "line"))).filter(F.col("_place") <= limit).drop("_place").withColumn("record", F.try_parse_json("value"))
    bad = F.col("record").isNull() | ~F.schema_of_variant("record").startswith("OBJECT")
    return placed.filter(~F.coalesce(bad, F.lit(True))), placed.filter(F.coalesce(bad, F.lit(True))).select("file", "line", F.lit("malformed record").alias("reason"))


def union_checked(frames: list[DataFrame], keys: list[str]) -> DataFrame:
    """Union by name; a key in more than one row is an error when the result is used."""
    total = frames[0]
    for f in frames[1:]:
        total = total.unionByName(f)
    n = F.count(F.lit(1)).over(Window.partitionBy(*keys))
    return total.withColumn("_n", n).filter(F.assert_true(F.col("_n") == 1, F.concat(F.lit("duplicate key: "), F.concat_ws("|", *keys))).isNull()).drop("_n")


def prefer(first: DataFrame, second: DataFrame, keys: list[str], value: str) -> DataFrame:
    """FULL OUTER join of two sources of a value: the second only fills what the first lacks; both with different values is an error."""
    both = first.select(*keys, F.col(value).alias("_a")).join(second.select(*keys, F.col(value).alias("_b")), keys, "full_outer")
    clash = F.col("_a").isNotNull() & F.col("_b").isNotNull() & (F.col("_a") != F.col("_b"))
    checked = both.filter(F.assert_true(~clash, F.concat(F.lit("conflict: "), F.concat_ws("|", *keys))).isNull())
    return checked.select(*keys, F.coalesce("_a", "_b").alias(value))


def exactly(df: DataFrame, columns: list[str]) -> DataFrame:
    """df, if it has these columns and no others; raises otherwise, so that no label slips in."""
    if sorted(df.columns) != sorted(columns):
        raise ValueError(f"columns {sorted(df.columns)} are not {sorted(columns)}")
    return df.select(*columns)


def csv_table(spark: SparkSession, path: str, schema: str, drop: list[str] = []) -> DataFrame:  # noqa: B006
    """A headed CSV with a fixed schema; malformed rows fail, columns in drop never leave the scan."""
    df = spark.read.option("header", True).option("mode", "FAILFAST").option("enforceSchema", False).option("multiLine", True).option("escape", '"').schema(schema).csv(path)
    return df.drop(*drop)


def overrides(spark: SparkSession, path: str) -> DataFrame:
    """question_id and query of a JSON mapping; duplicate keys and blank values fail."""
    raw = spark.read.text(path, wholetext=True).select("value", F.parse_json("value").alias("_strict"))
    each = raw.filter("_strict IS NOT NULL").select(F.explode(F.from_json("value", "map<string,string>")).alias("question_id", "query"))
    ok = (F.trim("question_id") != "") & (F.trim("query") != "")
    return each.filter(F.assert_true(F.coalesce(ok, F.lit(False)), F.lit("blank override")).isNull())
