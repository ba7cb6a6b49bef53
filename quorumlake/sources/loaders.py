"""Loaders that hand out inputs only once they are verified: open questions, hard stances, uncertainty tables and pinned inputs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quorumlake.functions.columns import STANCES
from quorumlake.operators.identity import ID_PREFIX
from quorumlake.operators.inputs import verified
from quorumlake.sources import pinned, records

#: The labels of a question's options, and the fields of an unlabelled input.
LABELS = ("A", "B", "C", "D", "E")
OPEN_FIELDS = ["question_id", "candidate_option_id", "evidence_doc_id", "question_stem", "candidate_option_text", "evidence_title", "evidence_abstract"]


def open_questions(spark: SparkSession, path: str, limit: int, prefix: str = ID_PREFIX) -> DataFrame:
    """question_id, question and options of the first `limit` lines, without their answers: the answer is not read at all.

    The k-th nonblank line must have the k-th id and options labelled A to E in
    that order, and no text may be blank; InputFault says which rule and where.
    """
    good, bad = records.first_lines(spark, path, limit)
    both = good.select("file", "line", "value", "record").unionByName(bad.select("file", "line"), allowMissingColumns=True)
    # At most `limit` lines, which bounds the window.
    placed = both.withColumn("_place", F.row_number().over(Window.orderBy("file", "line")))
    labels = F.transform("options", lambda o: o["label"])
    parsed = placed.select("file", "line", "_place", records.text_field("id").alias("question_id"), records.text_field("question").alias("question"), records.options_field().alias("options"), F.col("record").isNull().alias("_none"))
    faults = {
        "malformed": F.col("_none"), "id_differs": ~F.col("_none") & ~F.col("question_id").eqNullSafe(F.format_string(prefix + "%06d", "_place")),
        "options_differ": ~F.col("_none") & ~labels.eqNullSafe(F.array(*map(F.lit, LABELS))), "question_blank": ~F.col("_none") & F.col("question").isNull(),
        "option_blank": ~F.col("_none") & F.coalesce(F.exists("options", lambda o: F.coalesce(F.trim(o["text"]) == "", F.lit(True))), F.lit(False)),
    }
    done, counters = verified(parsed, faults, ["file", "line"])
    if counters["rows"] != limit:
        raise ValueError(f"{counters['rows']} questions for {limit}")
    return done.select("question_id", "question", "options")


def hard_stances(spark: SparkSession, folder: str, predictions: DataFrame, identity: dict, keys: list[str]) -> DataFrame:
    """keys, label, cache_key and source: one JSON file for each cached judgement, and a table that only fills what no file has.

    Every file must carry the identity (top-level fields, and those of
    model_metadata), a label that is a stance, and its own name as cache_key.
    Files that repeat a key, rows of the table that do, labels that are none and a
    file and a row that disagree are faults.  predictions: keys and label.
    """
    files = spark.read.option("multiLine", True).option("recursiveFileLookup", True).option("pathGlobFilter", "*.json").text(folder, wholetext=True).select(F.col("_metadata.file_name").alias("file"), F.try_parse_json("value").alias("v"))
    text = lambda name: F.try_variant_get("v", f"$.{name}", "string")
    same = F.lit(True)
    for name, want in identity.items():
        kind = "string" if isinstance(want, str) else "boolean" if isinstance(want, bool) else "double"
        at = [F.try_variant_get("v", f"$.{x}", kind) for x in (name, f"model_metadata.{name}")]
        same = same & F.coalesce(F.coalesce(*at) == F.lit(float(want) if kind == "double" else want), F.lit(False))
    cached = files.select("file", *[text(k).alias(k) for k in keys], text("argmax_label").alias("_label"), text("cache_key").alias("cache_key"), same.alias("_same"))
    first = cached.withColumn("_twins", F.count(F.lit(1)).over(Window.partitionBy(*keys)))
    rows = predictions.groupBy(*keys).agg(F.first("label").alias("_row"), F.count(F.lit(1)).alias("_rows"))
    both = first.join(rows, keys, "full_outer")
    there = F.col("file").isNotNull()
    stance = lambda c: F.coalesce(F.col(c).isin(*STANCES), F.lit(False))
    faults = {
        "identity_differs": there & ~F.col("_same"), "name_differs": there & ~F.coalesce(F.col("cache_key") == F.regexp_replace("file", r"\.json$", ""), F.lit(False)), "label_unknown": (there & ~stance("_label")) | (F.col("_rows").isNotNull() & ~stance("_row")),
        "key_repeated": F.coalesce(F.col("_twins") > 1, F.lit(False)) | F.coalesce(F.col("_rows") > 1, F.lit(False)), "labels_conflict": F.coalesce(F.col("_label") != F.col("_row"), F.lit(False)),
    }
    done, _ = verified(both, faults, keys)
    return done.select(*keys, F.coalesce("_label", "_row").alias("label"), "cache_key", F.when(there, F.col("file")).otherwise("predictions").alias("source"))


def uncertainty_table(spark: SparkSession, path: str, keys: list[str], total: int = 10) -> DataFrame:
    """A headed CSV of uncertainties with its checks: counts that add up to total, probabilities to one, numbers everywhere, each key once and included."""
    numbers = ["p_support", "p_contradict", "p_irrelevant", "u_3", "u_directional", "relevance", "directional_score"]
    counts = ["n_support", "n_contradict", "n_irrelevant"]
    raw = spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(path)
    values = {c: F.col(c).try_cast("double") for c in numbers} | {c: F.col(c).try_cast("int") for c in counts}
    rows = raw.withColumns(values).withColumn("_twins", F.count(F.lit(1)).over(Window.partitionBy(*keys)))
    blank = F.lit(False)
    for c in (*numbers, *counts):
        blank = blank | F.col(c).isNull() | F.isnan(F.col(c).cast("double"))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    faults = {
        "not_a_number": blank, "probabilities_off": F.abs(zero(numbers[0]) + zero(numbers[1]) + zero(numbers[2]) - 1) > 1e-9, "counts_off": zero(counts[0]) + zero(counts[1]) + zero(counts[2]) != total,
        "key_repeated": F.col("_twins") > 1, "excluded": ~F.col("evaluation_included").eqNullSafe("True"),
    }
    done, _ = verified(rows, faults, keys)
    return done.select(*keys, "pair_id", *numbers, *counts)


def unlabelled(spark: SparkSession, path: str, pins: str, fields: list[str] = OPEN_FIELDS, keys: int = 3) -> DataFrame:
    """JSON lines that are what they were pinned as, with exactly these fields, all strings, and each of the first `keys` of them together once."""
    lines = pinned.pinned_lines(spark, path, pins).filter(F.trim("value") != "")
    v = lines.select("file", F.monotonically_increasing_id().alias("_row"), F.try_parse_json("value").alias("v"), F.json_object_keys("value").alias("_names"))
    rows = v.select("*", *[F.try_variant_get("v", f"$.{f}", "string").alias(f) for f in fields], F.forall(F.array(*[F.schema_of_variant(F.variant_get("v", f"$.{f}", "variant")) == "STRING" for f in fields]), lambda x: F.coalesce(x, F.lit(False))).alias("_texts"))
    placed = rows.withColumn("_twins", F.count(F.lit(1)).over(Window.partitionBy(*fields[:keys])))
    faults = {
        "fields_differ": ~F.coalesce(F.array_sort("_names") == F.array(*map(F.lit, sorted(fields))), F.lit(False)), "not_text": ~F.col("_texts"), "key_repeated": F.col("_twins") > 1,
    }
    done, _ = verified(placed.drop("v"), faults, ["file", *fields[:keys]])
    return done.select(*fields)


def completion(reply: Column) -> Column:
    """struct(text, error) of a generation service's reply: complete, without an error, and with a text that is not blank."""
    v = F.try_parse_json(reply)
    kind = lambda name: F.schema_of_variant(F.variant_get(v, f"$.{name}", "variant"))
    text = F.try_variant_get(v, "$.response", "string")
    error = (
        F.when(v.isNull() | ~F.coalesce(F.schema_of_variant(v).startswith("OBJECT"), F.lit(False)), "invalid reply").when(kind("error").isNotNull(), "the service reports an error")
        .when(~F.coalesce(F.try_variant_get(v, "$.done", "boolean") & (kind("done") == "BOOLEAN"), F.lit(False)), "incomplete generation").when(~F.coalesce((kind("response") == "STRING") & (F.trim(text) != ""), F.lit(False)), "no generated text")
    )
    return F.struct(F.when(error.isNull(), text).alias("text"), error.alias("error"))


def evidence_lines(evidence: DataFrame) -> DataFrame:
    """value: one JSON object for each piece of evidence, nulls kept, without annotations of stances."""
    names = ["question_id", "doc_id", F.col("doc_rank").alias("rank"), "text", "source", "evidence_type", "retrieval_score", *(["metadata"] if "metadata" in evidence.columns else [])]
    return evidence.select(F.to_json(F.struct(F.lit(records.EVIDENCE_VERSION).alias("schema_version"), *names), {"ignoreNullFields": "false"}).alias("value"))
