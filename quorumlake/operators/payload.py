"""Summaries of whole runs: evaluation by group, comparison of runs, gates, inspection and flat exports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quorumlake.functions.columns import STANCES, TIE, ratio
from quorumlake.operators.evaluate import describe


def grouped_description(rows: DataFrame, fields: list[str], error: str = "error") -> DataFrame:
    """group (all, correct, incorrect), field and the description of the field in the group."""
    groups = F.array_compact(F.array(F.lit("all"), F.when(~F.col(error), "correct"), F.when(F.col(error), "incorrect")))
    each = F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).cast("double").alias("v")) for f in fields]))
    long = rows.withColumn("group", F.explode(groups)).select("group", each.alias("x")).select("group", "x.*")
    return describe(long, "v", ["group", "field"])


def by_reference(rows: DataFrame, fields: list[str], ref: str = "ref", error: str = "error") -> DataFrame:
    """For each of the three classes, absent ones included: rows, errors, accuracy (null without rows) and means of the fields."""
    got = rows.groupBy(ref).agg(F.count(F.lit(1)).alias("n"), F.count_if(error).alias("errors"), *[F.round(F.avg(f), 9).alias(f"mean_{f}") for f in fields])
    three = rows.sparkSession.createDataFrame([(s,) for s in STANCES], f"{ref} string")
    every = F.broadcast(three).join(got, ref, "left").na.fill(0, ["n", "errors"])
    return every.withColumn("accuracy", F.round(ratio(F.col("n") - F.col("errors"), F.col("n")), 9))


def run_gate(status: DataFrame, expected: int | None = None) -> DataFrame:
    """status (expected, valid, failed, missing) with mode: FINAL_EVALUATION only if all expected samples (and as many as given) are there and valid."""
    planned = F.col("expected") if expected is None else F.lit(expected)
    whole = (F.col("expected") == planned) & (F.col("valid") == planned) & (F.col("failed") == 0) & (F.col("missing") == 0)
    return status.withColumn("mode", F.when(whole, "FINAL_EVALUATION").otherwise("PARTIAL_DIAGNOSTIC"))


def compared(before: Column, after: Column, truncated: Column) -> list[Column]:
    """Aggregates of two runs side by side: rows, label changes, agreement and the share of truncated rows in percent."""
    n = F.count(F.lit(1))
    return [n.alias("n"), F.count_if(~before.eqNullSafe(after)).alias("changed"), F.count_if(before.eqNullSafe(after)).alias("agreed"), F.round(100 * ratio(F.count_if(truncated), n), 6).alias("truncated_percent")]


def inspected(questions: DataFrame) -> DataFrame:
    """By number of options: questions, claims and the least id.  questions: question_id, options."""
    return questions.groupBy(F.size("options").alias("n_options")).agg(F.count(F.lit(1)).alias("questions"), F.sum(F.size("options")).alias("claims"), F.min("question_id").alias("first_id"))


def cancelled(wide: DataFrame, n_weighted: Column, tolerance: float = TIE) -> DataFrame:
    """Claims with exactly one positive weight, where C and D must agree as the weight cancels: how many, and how many do not."""
    one = wide.filter((n_weighted == 1) & F.col("score_c").isNotNull() & F.col("score_d").isNotNull())
    return one.agg(F.count(F.lit(1)).alias("claims"), F.count_if(F.abs(F.col("score_c") - F.col("score_d")) > tolerance).alias("violations"))


def flat(df: DataFrame) -> DataFrame:
    """A table of text cells: nested values as JSON, null as an empty cell."""
    nested = lambda c: c.dataType.typeName() in ("array", "struct", "map")
    cell = lambda c: F.to_json(F.col(c.name)) if nested(c) else F.col(c.name).cast("string")
    return df.select(*[F.coalesce(cell(c), F.lit("")).alias(c.name) for c in df.schema])
