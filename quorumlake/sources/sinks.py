"""Writers: write-once folders, JSON lines, CSV checked by reading it back, and Markdown of small tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quorumlake.operators.evaluate import ranked


def write_json_lines(df: DataFrame, path: str, order: list[str] | None = None) -> None:
    """JSON lines with null fields kept; refuses an existing folder.  With an order, files follow it."""
    placed = df.repartitionByRange(*order).sortWithinPartitions(*order) if order else df
    placed.write.mode("errorifexists").option("ignoreNullFields", "false").json(path)


def write_csv_checked(df: DataFrame, path: str) -> None:
    """Headed CSV with null as an empty cell; reads it back and raises if any row differs as text."""
    text = df.select(*[F.col(c).cast("string").alias(c) for c in df.columns])
    text.write.mode("errorifexists").option("header", True).option("nullValue", "").option("emptyValue", '""').option("escape", '"').csv(path)
    back = df.sparkSession.read.option("header", True).option("multiLine", True).option("escape", '"').option("nullValue", "").option("emptyValue", "").schema(text.schema).csv(path)
    plain = lambda d: d.select(*[F.coalesce(F.col(c), F.lit("")).alias(c) for c in d.columns])
    a, b = plain(text), plain(back)
    if not a.exceptAll(b).isEmpty() or not b.exceptAll(a).isEmpty():
        raise ValueError(f"{path} does not hold what was written")


def claim_lines(claims: DataFrame, evidence: DataFrame) -> DataFrame:
    """One nested record for each claim, evidence in rank order."""
    listed = evidence.groupBy("question_id").agg(F.array_sort(F.collect_list(F.struct("doc_rank", "doc_id", "evidence_type", "quality"))).alias("evidence"))
    keep = [c for c in claims.columns if c not in ("question_id",)]
    return claims.withColumnRenamed("evidence", "evidence_count").join(listed, "question_id", "left").select("question_id", *["evidence_count" if c == "evidence" else c for c in keep], "evidence")


def write_questions(questions: DataFrame, path: str) -> None:
    """Questions (question_id, question, options as an array of (label, text), answer_index) as JSON lines that records.questions reads; options keep their order."""
    labels = F.transform("options", lambda o: o["label"])
    line = F.to_json(F.struct(F.col("question_id").alias("id"), "question", F.map_from_entries("options").alias("options"), F.get(labels, F.col("answer_index")).alias("answer")))
    questions.select(line.alias("value")).write.mode("errorifexists").text(path)


def markdown(df: DataFrame, title: str, most: int = 1000) -> str:
    """A Markdown table of a summary; raises over `most` rows, as a report is for reading."""
    rows = df.limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError("too many rows for a report")
    show = lambda v: "" if v is None else f"{v:.6g}" if isinstance(v, float) else str(v).replace("|", "\\|")
    out = [f"## {title}", "", "| " + " | ".join(df.columns) + " |", "|" + "---|" * len(df.columns)]
    return "\n".join([*out, *("| " + " | ".join(map(show, r)) + " |" for r in rows), ""])


def numbered(df: DataFrame, prefix: str, order: list[str]) -> DataFrame:
    """Sequential ids in the given order for annotation sheets."""
    return ranked(df, order).withColumn("pair_id", F.format_string(prefix + "%03d", F.col("place"))).drop("place")
