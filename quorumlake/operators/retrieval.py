"""Top-k evidence, canonical joins, coverage, relaxation cascade and rank metrics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def top_k(evidence: DataFrame, k: int, key: str = "question_id", order: tuple[str, ...] = ("doc_rank", "doc_id")) -> DataFrame:
    """The first k rows of each key by place in the order: ranks may have gaps, so this is not rank <= k."""
    place = F.row_number().over(Window.partitionBy(key).orderBy(*order))
    return evidence.withColumn("place", place).filter(F.col("place") <= k)


def canonical_join(evidence: DataFrame, n_options: int, *labels: DataFrame) -> DataFrame:
    """question x option x evidence with LEFT joined hard labels and uncertainties, from one or several sources; what is missing is named, not dropped."""
    keys = ["question_id", "idx", "doc_id"]
    grid = evidence.withColumn("idx", F.explode(F.array(*map(F.lit, range(n_options)))))
    joined = grid
    for source in labels:
        joined = joined.join(source, keys, "left")
    status = lambda c: F.when(F.col(c).isNull(), "MISSING").otherwise("AVAILABLE")
    pair = F.concat_ws("|", "question_id", F.char(F.lit(65) + F.col("idx")), "doc_id")
    return joined.withColumns({"pair_identity": pair, "hard_status": status("hard_label"), "soft_status": status("u_3")})


def coverage(questions: DataFrame, joined: DataFrame, k: int, n_options: int, calls: int = 10) -> DataFrame:
    """One row of counters over all questions, those without evidence included."""
    per = joined.groupBy("question_id").agg(
        F.count_distinct("doc_id").alias("docs"), F.count(F.lit(1)).alias("pairs"),
        F.count_if(F.col("soft_status") == "MISSING").alias("missing"), F.count_if(F.col("hard_status") == "MISSING").alias("hard_missing"),
        F.count_if(F.col("quality") == 0).alias("zero_rows"),
    )
    every = questions.select("question_id").join(per, "question_id", "left").na.fill(0)
    has = F.col("docs") > 0
    return every.agg(
        F.count(F.lit(1)).alias("questions"), F.count_if(has).alias("nonempty"), F.count_if(~has).alias("empty"), F.count_if(has & (F.col("docs") < k)).alias("fewer_than_k"),
        F.sum("docs").alias("evidence"), F.sum("pairs").alias("pairs"), F.sum("missing").alias("missing_soft"), F.sum("hard_missing").alias("missing_hard"),
        (F.sum("missing") * calls).alias("missing_calls"), F.count_if(has & (F.col("missing") == 0)).alias("ready_questions"),
        (F.sum("zero_rows") / n_options).cast("long").alias("zero_quality_rows"), F.count_if(has & (F.col("zero_rows") == F.col("pairs"))).alias("all_zero_questions"),
    )


def cascade_stage(counts: list[Column], names: list[str], enough: int = 5) -> Column:
    """The stage that is used: the first with enough matches, else the last; a null count is no match."""
    stage = F.lit(names[-1])
    for c, name in reversed(list(zip(counts[:-1], names[:-1]))):
        stage = F.when(F.coalesce(c, F.lit(0)) >= enough, name).otherwise(stage)
    return stage


def rank_metrics(questions: DataFrame, retrieved: DataFrame, k: int) -> DataFrame:
    """mrr and hit@k over questions with relevant documents (array relevant): first relevant place in the retrieved list.

    The reciprocal rank is not cut at k.  Both are null without such questions.
    """
    annotated = questions.filter(F.size("relevant") > 0)
    hits = retrieved.join(annotated.select("question_id", "relevant"), "question_id").filter(F.array_contains("relevant", F.col("doc_id")))
    first = hits.groupBy("question_id").agg(F.min("place").alias("first"))
    scored = annotated.select("question_id").join(first, "question_id", "left")
    total = questions.agg(F.count(F.lit(1)).alias("question_count"))
    found = scored.agg(
        F.count(F.lit(1)).alias("evaluated"), F.avg(F.coalesce(1 / F.col("first"), F.lit(0.0))).alias("mrr"),
        F.avg(F.when(F.col("first") <= k, 1.0).otherwise(0.0)).alias("hit"),
    )
    return total.crossJoin(found).withColumn("k", F.lit(k))


def first_per_group(rows: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The first row of each group in the order, by one aggregation and no sort of groups."""
    rest = [c for c in rows.columns if c not in keys]
    best = F.min_by(F.struct(*rest), F.struct(*[o.alias(f"o{j}") for j, o in enumerate(order)]))
    return rows.groupBy(*keys).agg(best.alias("_best")).select(*keys, "_best.*")
