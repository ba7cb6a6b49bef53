"""Leave-one-seed-out stability and overlapping strata."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quorumlake.functions.batches import stability
from quorumlake.functions.columns import TIE, ordered_values
from quorumlake.operators.aggregate import CLAIM


def seed_stability(pairs: DataFrame, stances, methods: tuple[str, ...] = ("C", "D"), order: tuple[str, ...] = ("doc_rank", "doc_id")) -> DataFrame:
    """By method C and D: claims whose decision or score changes when any one seed is left out, and the largest change.

    stances: a column, the seeds' stances of a pair as an array.  Each claim is
    grouped once; its full score and those without each seed are made from the
    same array of pairs, so nothing is copied or joined for the seeds.
    """
    value = F.struct("quality", "n_s", "n_c", "n_i", stances.alias("stances"))
    return claim_stability(pairs.groupBy(*CLAIM).agg(ordered_values([F.col(x) for x in order], value).alias("v")), methods)


def claim_stability(claims: DataFrame, methods: tuple[str, ...] = ("C", "D")) -> DataFrame:
    """seed_stability of rows that have a claim's pairs as an ordered array v each, with quality, n_s, n_c, n_i and stances."""
    per = claims.select(F.explode(stability(F.col("v"), methods)).alias("x")).select("x.*")
    return per.groupBy("method").agg(F.count(F.lit(1)).alias("claims"), F.count_if(F.col("n") > 0).alias("unstable"), F.sum("n").alias("decision_changes"), F.count_if(F.col("delta") > TIE).alias("score_changes"), F.round(F.max("delta"), 6).alias("largest_delta"))


def strata(wide: DataFrame, n_weighted: str = "weighted") -> DataFrame:
    """Decisions of each method in strata that overlap: all, one contributor, several, all weights zero."""
    w = F.col(n_weighted)
    names = [("all", F.lit(True)), ("single_evidence", F.col("evidence") == 1), ("multi_evidence", F.col("evidence") > 1), ("all_zero_quality", w == 0), ("one_positive_weight", w == 1), ("several_positive_weights", w >= 2)]
    each = F.explode(F.array_compact(F.array(*[F.when(c, n) for n, c in names]))).alias("stratum")
    n = lambda m, d: F.count_if(F.col(f"decision_{m}") == d).alias(f"{m}_{d.lower()}")
    return wide.select("*", each).groupBy("stratum").agg(F.count(F.lit(1)).alias("claims"), *[n(m, d) for m in "abcd" for d in ("SUPPORT", "CONTRADICT", "ABSTAIN")], F.count_if(F.col("score_d").isNull()).alias("undefined_d"))
