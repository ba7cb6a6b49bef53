"""Column functions and aggregation against worked values."""

import math

import pytest
from pyspark.sql import functions as F

from quorumlake.functions import columns as C
from quorumlake.operators.aggregate import abstention_reason, by_method, claims, contrast, scored

S, X = "SUPPORT", "CONTRADICT"


def claim(spark, rows):
    df = spark.createDataFrame([("q", 0, f"d{i}", i + 1, *map(float, r)) for i, r in enumerate(rows)], "question_id string, idx int, doc_id string, doc_rank int, quality double, p_s double, p_c double, p_i double")
    return claims(scored(df)).first()


@pytest.mark.parametrize(
    ("rows", "score", "decision"),
    [
        ([(0.9, 1, 0, 0), (0.1, 0, 1, 0)], 0.8, S),
        ([(0.9, 1, 0, 0), (0.1, 0, 1, 0), (0.5, 0, 0, 1)], 0.8 / 1.5, S),
        ([(1.0, 1 / 3, 1 / 3, 1 / 3)], None, "ABSTAIN"),
        ([(0.8, 0.3333335, 0.3333335, 0.3333335)], None, "ABSTAIN"),
        ([(0.0, 1, 0, 0), (0.0, 0, 1, 0)], None, "ABSTAIN"),
        ([(0.8, 0.45, 0.45, 0.1)], 0.0, "ABSTAIN"),
        ([(0.7, 0.3, 0.1, 0.6)], 0.2, S),
        ([(1e-320, 0.5000000000001, 0.4999999999999, 0.0)], None, S),
        ([(0.6, 0.8, 0.1, 0.1), (0.6, 0.1, 0.8, 0.1)], 0.0, "ABSTAIN"),
        ([(0.3, 1, 0, 0), (0.9, 0.32, 0.36, 0.32)], None, S),
    ],
)
def test_entropy_weighted_votes(spark, rows, score, decision):
    got = claim(spark, rows)
    assert got.decision_d == decision
    if score is not None:
        assert got.score_d == pytest.approx(score, abs=1e-12)
    if decision == "ABSTAIN" and score is None:
        assert got.score_d is None


def test_methods_differ(spark):
    got = claim(spark, [(0.3, 1, 0, 0), (0.9, 0.32, 0.36, 0.32)])
    assert (got.decision_b, got.decision_d) == (X, S)
    got = claim(spark, [(1, 0.4, 0.2, 0.4), (1, 0, 0.1, 0.9)])
    assert (got.decision_c, got.decision_d) == (S, X)
    got = claim(spark, [(0.8, 0.4500000000002, 0.45, 0.0999999999998)])
    assert (got.unresolved, got.decision_d, got.decision_a) == (1, S, "ABSTAIN")
    assert got.score_a == 0


def test_abstention_reasons(spark):
    df = spark.createDataFrame([("z", 0, "a", 1, 0.0, 1.0, 0.0, 0.0), ("u", 0, "a", 1, 1.0, 1 / 3, 1 / 3, 1 / 3), ("b", 0, "a", 1, 0.5, 1.0, 0.0, 0.0), ("b", 0, "b", 2, 0.5, 0.0, 1.0, 0.0), ("i", 0, "a", 1, 0.5, 0.0, 0.0, 1.0)], "question_id string, idx int, doc_id string, doc_rank int, quality double, p_s double, p_c double, p_i double")
    got = {(r.question_id, r.method): r.reason for r in by_method(claims(scored(df))).collect()}
    assert got["z", "A"] is None and got["z", "B"] == got["z", "D"] == "ALL_ANALYSIS_QUALITY_WEIGHTS_ZERO"
    assert got["u", "D"] == "ZERO_ENTROPY_EFFECTIVE_WEIGHT" and got["u", "A"] == "NO_DIRECTIONAL_HARD_VOTES_WITH_UNRESOLVED_ARGMAX"
    assert got["b", "A"] == got["b", "B"] == "BALANCED_HARD_VOTES_OR_WEIGHT_TIE" and got["b", "C"] == "ZERO_SOFT_DIRECTION"
    assert got["i", "B"] == "NO_DIRECTIONAL_HARD_VOTES"
    assert abstention_reason() is not None


def test_one_hot_soft_votes_equal_hard_votes(spark):
    rows = [(0.7, 1, 0, 0), (0.2, 0, 1, 0), (0.4, 0, 0, 1), (0.1, 0, 1, 0)]
    got = claim(spark, rows)
    assert got.score_b == pytest.approx(got.score_c) == pytest.approx(got.score_d)
    base, more = claim(spark, rows), claim(spark, [*rows, (0.9, 1 / 3, 1 / 3, 1 / 3)])
    assert base.score_d == more.score_d


def test_contrast(spark):
    df = spark.createDataFrame([("q", 0, "a", 1, 1.0, 0.4, 0.2, 0.4), ("q", 0, "b", 2, 1.0, 0.0, 0.1, 0.9), ("r", 0, "a", 1, 1.0, 1 / 3, 1 / 3, 1 / 3)], "question_id string, idx int, doc_id string, doc_rank int, quality double, p_s double, p_c double, p_i double")
    long = by_method(claims(scored(df)))
    got = {r.question_id: r for r in contrast(long.filter("method = 'C'"), long.filter("method = 'D'"), ["question_id", "idx"]).collect()}
    assert got["q"].decision_changed and got["q"].score_changed and got["q"].both_defined
    assert got["r"].definedness_changed and not got["r"].decision_changed and not got["r"].score_changed


def test_distributions(spark):
    df = spark.createDataFrame([(0.5, 0.3, 0.2), (0.6, 0.2, 0.2), (0.0, 0.0, 1.0), (0.9, 0.0, 0.1), (0.5, 0.5, 0.0), (float("nan"), 0.5, 0.5), (None, 0.5, 0.5)], "s double, c double, i double")
    s, c, i = map(F.col, ("s", "c", "i"))
    got = df.select(C.valid_distribution(s, c, i).alias("v"), C.argmax3(s, c, i).alias("l"), C.entropy_frequency([s, c, i], 3).alias("h"), C.direction_conditional(s, c).alias("d")).collect()
    assert [r.v for r in got] == [True] * 5 + [False] * 2
    assert [r.l for r in got[:5]] == [S, S, "IRRELEVANT", S, None]
    assert got[3].h == pytest.approx(0.29590327428938457) and got[2].h == 0 and math.copysign(1, got[2].h) == 1
    assert got[1].d == pytest.approx(0.5) and got[2].d == 0 and got[3].d == 1


def test_softmax_does_not_overflow(spark):
    got = spark.range(1).select(*[x.alias(k) for k, x in zip("abc", C.softmax3(F.lit(1000.0), F.lit(999.0), F.lit(-1000.0)))]).first()
    assert got.a == pytest.approx(1 / (1 + math.exp(-1))) and got.c == 0


def test_compensated_sum(spark):
    df = spark.createDataFrame([([1e100, 1.0, -1e100],), ([0.1] * 10,), ([],)], "v array<double>")
    assert [r[0] for r in df.select(C.fsum(F.col("v"))).collect()] == [1.0, 1.0, 0.0]
