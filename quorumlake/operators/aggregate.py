"""Claim aggregation over (question, option): majority, quality-weighted, soft and entropy-weighted votes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quorumlake.functions.columns import TIE, argmax3, bound, decide, entropy_clamped, fsum, ordered_values, ratio

CLAIM = ["question_id", "idx"]
METHODS = ("A", "B", "C", "D")


def scored(dist: DataFrame) -> DataFrame:
    """Adds label, direction d and clamped entropy h to rows with p_s, p_c, p_i."""
    s, c, i = F.col("p_s"), F.col("p_c"), F.col("p_i")
    return dist.withColumns({"label": argmax3(s, c, i), "d": s - c, "h": entropy_clamped(s, c, i)})


def quality_conditions(rows: DataFrame) -> DataFrame:
    """Every row twice: with its quality, and with quality 1 for all."""
    both = F.array(F.struct(F.lit("original_quality").alias("condition"), F.col("quality").alias("q")), F.struct(F.lit("quality_disabled").alias("condition"), F.lit(1.0).alias("q")))
    return rows.withColumn("_c", F.explode(both)).withColumns({"condition": F.col("_c.condition"), "quality": F.col("_c.q")}).drop("_c")


def without_quality(v: Column) -> Column:
    """quality_conditions for arrays: the pairs of a claim with quality 1 for all."""
    return F.transform(v, lambda x: x.withField("quality", F.lit(1.0)))


def votes(v: Column) -> Column:
    """A claim's ordered pairs, an array with doc_id, quality, n_s, n_c and n_i, as scored makes them of rows; in steps, so that none is made twice."""
    total = lambda x: x["n_s"] + x["n_c"] + x["n_i"]
    shares = F.transform(v, lambda x: F.struct(x["doc_id"].alias("doc_id"), x["quality"].alias("q"), *[ratio(x[f"n_{k}"], total(x)).alias(f"p_{k}") for k in "sci"]))
    p = lambda x: (x["p_s"], x["p_c"], x["p_i"])
    kept = lambda x, *names: [x[n].alias(n) for n in names]
    told = F.transform(shares, lambda x: F.struct(*kept(x, "doc_id", "q", "p_s", "p_c"), (x["p_s"] - x["p_c"]).alias("d"), argmax3(*p(x)).alias("label"), entropy_clamped(*p(x)).alias("h")))
    return F.transform(told, lambda x: F.struct(*kept(x, "doc_id", "q", "p_s", "p_c", "d", "label", "h"), (x["q"] * (1 - x["h"])).alias("w")))


def _counts(v: Column) -> dict[str, Column]:
    n = lambda f: F.size(F.filter(v, f)).cast("long")
    return {
        "irrelevant": n(lambda x: x["label"] == "IRRELEVANT"), "unresolved": n(lambda x: x["label"].isNull()), "max_quality": F.array_max(F.transform(v, lambda x: x["q"])),
        "unresolved_weighted": n(lambda x: x["label"].isNull() & (x["q"] > 0)) > 0,
    }


def _sums(v: Column) -> dict[str, Column]:
    n = lambda s: F.size(F.filter(v, lambda x: x["label"] == s)).cast("long")
    hard = lambda s: fsum(F.transform(F.filter(v, lambda x: x["label"] == s), lambda x: x["q"]))
    return {
        "a_support": n("SUPPORT"), "a_contradict": n("CONTRADICT"), "evidence": F.size(v).cast("long"), "b_support": hard("SUPPORT"), "b_contradict": hard("CONTRADICT"),
        "q_total": fsum(F.transform(v, lambda x: x["q"])), "w_total": fsum(F.transform(v, lambda x: x["w"])),
    }


def _scores(v: Column, of) -> dict[str, Column]:
    """Scores from what _sums gave, under names that of resolves.  Weights are scaled first, so tiny ones do not vanish; null for a total of 0."""
    scaled = lambda w, total: F.when(total != 0, fsum(F.transform(v, lambda x: x[w] / total * x["d"])))
    gap = of("b_support") - of("b_contradict")
    return {
        "score_a": ratio(of("a_support") - of("a_contradict"), of("evidence")), "score_b": F.when(of("q_total") != 0, gap / of("q_total")),
        "score_c": scaled("q", of("q_total")), "score_d": scaled("w", of("w_total")),
    }


def _decisions(of) -> dict[str, Column]:
    return {
        "decision_a": decide(of("a_support") - of("a_contradict")), "decision_b": decide(of("b_support") - of("b_contradict"), TIE),
        "decision_c": decide(of("score_c")), "decision_d": decide(of("score_d")),
    }


def claims(rows: DataFrame, keys: list[str] = CLAIM) -> DataFrame:
    """All four methods for each claim in one grouping.

    rows: quality, p_s, p_c, p_i, label, d, h, doc_rank and doc_id.  Sums are made
    in rank order with compensation, so no shuffle changes them.  A compares
    counts; B sums quality of hard labels and ties within 1e-12; C and D decide
    by the exact sign of a soft direction weighted by quality, for D times
    1 - entropy; their score is null where all weights are 0.  Rows without a
    label count as unresolved and take no part in A and B.
    """
    q = F.col("quality")
    vote = F.struct(q.alias("q"), (q * (1 - F.col("h"))).alias("w"), "d", "label", "p_s", "p_c", "h", "doc_id")
    return decided(rows.groupBy(*keys).agg(ordered_values([F.col("doc_rank"), F.col("doc_id")], vote).alias("v")))


def decided(grouped: DataFrame) -> DataFrame:
    """claims of rows that have a claim's votes as an ordered array v each (see votes): nothing is grouped for it."""
    v = F.col("v")
    part = lambda f: F.transform(v, f)
    scores = grouped.withColumns(_counts(v) | _sums(v)).withColumns(_scores(v, F.col))
    return scores.withColumns(_decisions(F.col) | {
        "diagnostics": part(lambda x: F.struct(x["doc_id"].alias("doc_id"), x["q"].alias("quality"), x["d"].alias("direction"), x["h"].alias("entropy"), x["w"].alias("weight"))),
        "soft_support": fsum(part(lambda x: x["w"] * x["p_s"])), "soft_contradict": fsum(part(lambda x: x["w"] * x["p_c"])),
    }).drop("v")


def verdict(v: Column) -> Column:
    """struct of the four scores and decisions of a claim's votes, for claims that are elements of an array themselves."""
    named = lambda d: [c.alias(k) for k, c in d.items()]
    scored_ = lambda v, s: bound(F.struct(s["a_support"].alias("a_support"), s["a_contradict"].alias("a_contradict"), s["b_support"].alias("b_support"), s["b_contradict"].alias("b_contradict"), *named(_scores(v, s.__getitem__))), lambda x: F.struct(*[x[f"score_{m.lower()}"].alias(f"score_{m.lower()}") for m in METHODS], *named(_decisions(x.__getitem__))))
    return bound(v, lambda v: bound(F.struct(*named(_sums(v))), lambda s: scored_(v, s)))


def by_method(wide: DataFrame, keys: list[str] = CLAIM) -> DataFrame:
    """One row for each claim and method: score, decision, denominator and why it abstains."""
    denominator = {"A": F.col("evidence").cast("double"), "B": F.col("q_total"), "C": F.col("q_total"), "D": F.col("w_total")}
    each = F.array(*[F.struct(F.lit(m).alias("method"), F.col(f"score_{m.lower()}").alias("score"), F.col(f"decision_{m.lower()}").alias("decision"), denominator[m].alias("denominator")) for m in METHODS])
    kept = [*keys, "evidence", "max_quality", "q_total", "w_total", "a_support", "a_contradict", "unresolved", "unresolved_weighted"]
    long = wide.select(*kept, F.explode(each).alias("m")).select(*kept, "m.*")
    return long.withColumn("reason", abstention_reason())


def abstention_reason() -> Column:
    """Null unless the decision is ABSTAIN; the first cause that holds."""
    m, hard = F.col("method"), F.col("method").isin("A", "B")
    votes = F.col("a_support") + F.col("a_contradict")
    none = F.when(F.col("unresolved") > 0, "NO_DIRECTIONAL_HARD_VOTES_WITH_UNRESOLVED_ARGMAX").otherwise("NO_DIRECTIONAL_HARD_VOTES")
    why = (
        F.when((m != "A") & (F.coalesce("max_quality", F.lit(0.0)) == 0), "ALL_ANALYSIS_QUALITY_WEIGHTS_ZERO")
        .when((m == "D") & (F.col("w_total") == 0), "ZERO_ENTROPY_EFFECTIVE_WEIGHT")
        .when(hard & (votes > 0), "BALANCED_HARD_VOTES_OR_WEIGHT_TIE")
        .when(hard, none)
        .otherwise("ZERO_SOFT_DIRECTION")
    )
    return F.when(F.col("decision") == "ABSTAIN", why)


def contrast(left: DataFrame, right: DataFrame, keys: list[str], tolerance: float = TIE) -> DataFrame:
    """Claims of two sources side by side: delta, and whether score, definedness and decision changed."""
    r = right.select(*keys, F.col("score").alias("score_right"), F.col("decision").alias("decision_right"))
    return _contrasted(left.select(*keys, F.col("score").alias("score_left"), F.col("decision").alias("decision_left")).join(r, keys), tolerance)


def contrast_methods(wide: DataFrame, left: str, right: str, keys: list[str] = CLAIM, tolerance: float = TIE) -> DataFrame:
    """contrast of two methods of the same claims: both stand in one row, so nothing is joined."""
    both = [F.col(f"{what}_{m.lower()}").alias(f"{what}_{side}") for side, m in (("left", left), ("right", right)) for what in ("score", "decision")]
    return _contrasted(wide.select(*keys, *both), tolerance)


def _contrasted(both: DataFrame, tolerance: float) -> DataFrame:
    a, b = F.col("score_left"), F.col("score_right")
    defined = a.isNotNull() & b.isNotNull()
    return both.withColumns({
        "both_defined": defined, "delta": F.when(defined, b - a), "score_changed": F.coalesce(F.abs(b - a) > tolerance, F.lit(False)),
        "definedness_changed": a.isNull() != b.isNull(), "decision_changed": F.col("decision_left") != F.col("decision_right"),
        "tolerant_changed": decide(a, tolerance) != decide(b, tolerance),
    })
