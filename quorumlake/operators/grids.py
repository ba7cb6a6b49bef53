"""Controlled scenario grids: fixed cases, conflicts of counts and qualities, and confidence templates."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quorumlake.functions.columns import one_hot
from quorumlake.operators.aggregate import claims, scored

#: The axes of the grids.
RATIOS = [(9, 1), (7, 3), (5, 5), (3, 7), (1, 9)]
QUALITIES = [
    ("equal", 0.5, 0.5),
    ("support_small_gap", 0.55, 0.45),
    ("contradict_small_gap", 0.45, 0.55),
    ("support_large_gap", 0.9, 0.1),
    ("contradict_large_gap", 0.1, 0.9),
    ("support_extreme_gap", 0.95, 0.05),
    ("contradict_extreme_gap", 0.05, 0.95),
]
TEMPLATES = [("CONFIDENT", 2, 0.90, 0.05, 0.05), ("MODERATE", 1, 0.70, 0.20, 0.10), ("UNCERTAIN", 0, 0.45, 0.40, 0.15)]
#: Six fixed cases: qualities of supporting, contradicting and irrelevant evidence, and the decisions of A and B.
CASES = [
    ("scenario_1", [0.1, 0.1, 0.1], [0.9], [], "SUPPORT", "CONTRADICT"),
    ("scenario_2", [0.9], [0.1, 0.1, 0.1], [], "CONTRADICT", "SUPPORT"),
    ("scenario_3", [0.5, 0.5], [0.5, 0.5], [], "ABSTAIN", "ABSTAIN"),
    ("scenario_4", [], [], [0.1, 0.5, 0.9], "ABSTAIN", "ABSTAIN"),
    ("scenario_5a", [0.1, 0.1], [0.9], [], "SUPPORT", "CONTRADICT"),
    ("scenario_5b", [0.45, 0.45], [0.1], [], "SUPPORT", "SUPPORT"),
]


def fixed_cases(spark: SparkSession, cases: list = CASES) -> DataFrame:
    """Decisions of A and B for each fixed case beside the expected ones."""
    given = spark.createDataFrame(cases, "scenario string, s array<double>, c array<double>, i array<double>, expected_a string, expected_b string")
    tag = lambda col, label: F.transform(col, lambda q: F.struct(F.lit(label).alias("label"), q.alias("quality")))
    each = given.select("scenario", "expected_a", "expected_b", F.posexplode(F.concat(tag("s", "SUPPORT"), tag("c", "CONTRADICT"), tag("i", "IRRELEVANT"))).alias("doc_rank", "e"))
    p = one_hot(F.col("side"))
    rows = each.select("scenario", "expected_a", "expected_b", "doc_rank", F.col("doc_rank").cast("string").alias("doc_id"), F.col("e.label").alias("side"), F.col("e.quality").alias("quality")).withColumns({"p_s": p[0], "p_c": p[1], "p_i": p[2]})
    got = claims(scored(rows), ["scenario", "expected_a", "expected_b"])
    return got.select("scenario", "decision_a", "decision_b", F.round("b_support", 9).alias("support"), F.round("b_contradict", 9).alias("contradict"), "irrelevant", ((F.col("decision_a") == F.col("expected_a")) & (F.col("decision_b") == F.col("expected_b"))).alias("as_expected"))


def conflict_rows(spark: SparkSession, ratios: list = RATIOS, qualities: list = QUALITIES) -> DataFrame:
    """One evidence row for each count of each ratio x quality scenario: support first, ranks from 1."""
    r = spark.createDataFrame(ratios, "n_support int, n_contradict int").withColumn("ratio", F.concat_ws(":", "n_support", "n_contradict"))
    q = spark.createDataFrame(qualities, "quality_condition string, q_support double, q_contradict double")
    cases = r.crossJoin(F.broadcast(q)).withColumn("scenario", F.concat_ws("/", "ratio", "quality_condition"))
    rows = cases.withColumn("doc_rank", F.explode(F.sequence(F.lit(1), F.col("n_support") + F.col("n_contradict"))))
    side = F.col("doc_rank") <= F.col("n_support")
    label = F.when(side, "SUPPORT").otherwise("CONTRADICT")
    return rows.withColumns({"side": label, "quality": F.when(side, F.col("q_support")).otherwise(F.col("q_contradict")), "doc_id": F.concat_ws("-", "scenario", "doc_rank")})


def quality_direction():
    gap = F.col("q_support") - F.col("q_contradict")
    return F.when(gap > 0, "support_higher").when(gap < 0, "contradict_higher").otherwise("equal")


CASE = ["scenario", "ratio", "quality_condition", "quality_direction"]


def conflict_grid(spark: SparkSession, **axes) -> DataFrame:
    """A against B for each scenario."""
    p = one_hot(F.col("side"))
    rows = scored(conflict_rows(spark, **axes).withColumns({"quality_direction": quality_direction(), "p_s": p[0], "p_c": p[1], "p_i": p[2]}))
    got = claims(rows, CASE)
    a, b = F.col("decision_a"), F.col("decision_b")
    opposed = (a != "ABSTAIN") & (b != "ABSTAIN") & (a != b)
    return got.select(*CASE, "decision_a", "decision_b", (a != b).alias("disagree"), opposed.alias("reversal"), ((a == "ABSTAIN") != (b == "ABSTAIN")).alias("abstention_differs"))


def conflict_summary(grid: DataFrame) -> DataFrame:
    """Counts over all, by ratio and by direction of the quality gap."""
    n = F.count(F.lit(1))
    sets = grid.groupingSets([[], ["ratio"], ["quality_direction"]], "ratio", "quality_direction")
    d = lambda m, s: F.count_if(F.col(f"decision_{m}") == s).alias(f"{m}_{s.lower()}")
    return sets.agg(n.alias("scenarios"), F.count_if("disagree").alias("disagreements"), F.round(100.0 * F.count_if("disagree") / n, 6).alias("disagree_percent"), F.count_if("reversal").alias("reversals"), F.count_if("abstention_differs").alias("abstention_differences"), *[d(m, s) for m in "ab" for s in ("SUPPORT", "CONTRADICT", "ABSTAIN")])


def uncertainty_grid(spark: SparkSession) -> DataFrame:
    """B against D for each conflict scenario with a confidence template for either side; contradicting templates are mirrored."""
    t = spark.createDataFrame(TEMPLATES, "name string, level int, top double, second double, rest double")
    side = lambda s: t.select(F.col("name").alias(f"conf_{s}"), *[F.col(c).alias(f"{s}_{c}") for c in ("level", "top", "second", "rest")])
    base = conflict_rows(spark).withColumn("quality_direction", quality_direction())
    rows = base.crossJoin(F.broadcast(side("support"))).crossJoin(F.broadcast(side("contradict")))
    s = F.col("side") == "SUPPORT"
    pick = lambda a, b: F.when(s, F.col(a)).otherwise(F.col(b))
    rows = rows.withColumns({"p_s": pick("support_top", "contradict_second"), "p_c": pick("support_second", "contradict_top"), "p_i": pick("support_rest", "contradict_rest")})
    rows = rows.withColumns({"gap": F.col("support_level") - F.col("contradict_level"), "more": F.col("n_support") - F.col("n_contradict")})
    got = claims(scored(rows), [*CASE, "conf_support", "conf_contradict", "gap", "more"])
    gap, more = F.col("gap"), F.col("more")
    asymmetry = F.when(gap > 0, "support_more_confident").when(gap < 0, "contradict_more_confident").otherwise("equal_confidence")

    def relation(sign, none: str, with_: str, against: str):
        return F.when(sign == 0, none).when(gap == 0, "equal_confidence").when((gap > 0) == (sign > 0), with_).otherwise(against)

    majority = relation(more, "no_majority", "majority_more_confident", "minority_more_confident")
    q = F.when(F.col("quality_direction") == "support_higher", 1).when(F.col("quality_direction") == "contradict_higher", -1).otherwise(0)
    quality = relation(q, "no_quality_gap", "higher_quality_more_confident", "lower_quality_more_confident")
    extreme = F.abs(gap) == 2
    family = lambda relation_, value, name: F.when(extreme & (relation_ == value), name)
    families = F.array_compact(F.array(
        F.when(gap == 0, "equal_confidence"),
        family(majority, "minority_more_confident", "majority_uncertain_minority_confident"), family(majority, "majority_more_confident", "majority_confident_minority_uncertain"),
        family(quality, "lower_quality_more_confident", "higher_quality_uncertain_lower_quality_confident"), family(quality, "higher_quality_more_confident", "higher_quality_confident_lower_quality_uncertain"),
    ))
    return got.withColumns({"asymmetry": asymmetry, "majority_relation": majority, "quality_relation": quality, "families": families, "disagree": F.col("decision_b") != F.col("decision_d")}).select(
        *CASE, "conf_support", "conf_contradict", "decision_a", "decision_b", "decision_d", F.round("score_d", 9).alias("score_d"), "asymmetry", "majority_relation", "quality_relation", "families", "disagree"
    )


def uncertainty_summary(grid: DataFrame) -> DataFrame:
    """Counts by each dimension and, overlapping, by each family."""
    dims = ["ratio", "quality_direction", "asymmetry", "conf_support", "conf_contradict"]
    each = F.array(F.struct(F.lit("all").alias("dimension"), F.lit("all").alias("value")), *[F.struct(F.lit(d).alias("dimension"), F.col(d).alias("value")) for d in dims])
    family = F.transform("families", lambda f: F.struct(F.lit("family").alias("dimension"), f.alias("value")))
    rows = grid.select("disagree", "decision_d", F.explode(F.concat(each, family)).alias("g"))
    n = F.count(F.lit(1))
    return rows.groupBy(F.col("g.dimension").alias("dimension"), F.col("g.value").alias("value")).agg(n.alias("scenarios"), F.count_if("disagree").alias("disagreements"), F.round(100.0 * F.count_if("disagree") / n, 6).alias("disagree_percent"), F.count_if(F.col("decision_d") == "ABSTAIN").alias("d_abstains"))


def conflict_cells(wide: DataFrame, keys: list[str]) -> DataFrame:
    """Claims of real evidence (as aggregate.claims gives them) that have it on both sides, in the grid's terms: ratio of its rows, direction of the gap between the sides' mean qualities, decisions and how they differ."""
    both = wide.filter((F.col("a_support") > 0) & (F.col("a_contradict") > 0))
    gap = F.col("b_support") / F.col("a_support") - F.col("b_contradict") / F.col("a_contradict")
    direction = F.when(gap > 1e-9, "support_higher").when(gap < -1e-9, "contradict_higher").otherwise("equal")
    a, b = F.col("decision_a"), F.col("decision_b")
    return both.select(
        *keys, F.concat_ws(":", "a_support", "a_contradict").alias("ratio"), direction.alias("quality_direction"), "decision_a", "decision_b", "decision_d", (a != b).alias("disagree"), ((a != "ABSTAIN") & (b != "ABSTAIN") & (a != b)).alias("reversal"), ((a == "ABSTAIN") != (b == "ABSTAIN")).alias("abstention_differs")
    )


def with_claims(grid: DataFrame, cells: DataFrame, on: list[str]) -> DataFrame:
    """Scenarios with `claims`: how many real ones lie in the same cell."""
    counts = cells.groupBy(*on).agg(F.count(F.lit(1)).alias("claims"))
    return grid.join(counts, on, "left").withColumn("claims", F.coalesce("claims", F.lit(0)).cast("long"))
