"""Claims and answers made of a question's evidence in one row, against those of grouped pairs."""

from pyspark.sql import functions as F

from quorumlake import queries as Q
from quorumlake.operators import aggregate, answer
from quorumlake.plans.projection import Tables

SF = "/root/testdata/sf0.001"


def rows(df, *names):
    return sorted(map(tuple, df.select(*names).collect()))


def test_claims_in_rows(spark):
    names = ["question_id", "idx", *[f"{x}_{m}" for x in ("score", "decision") for m in "abcd"], "a_support", "irrelevant", "unresolved", "max_quality", "b_support", "q_total", "w_total", "unresolved_weighted", "soft_support"]
    t = Tables(spark, SF)
    key = lambda df: df.select(*[F.col(n).cast("string") for n in names])
    assert rows(key(Q.wide(t)), *names) == rows(key(aggregate.claims(Q.pairs(t))), *names)


def test_answers_in_rows(spark):
    t = Tables(spark, SF)
    names = ["question_id", "method", "state", "reason", "answer", "ranking"]
    options = aggregate.by_method(aggregate.claims(Q.pairs(t))).withColumn("score", F.round("score", 12))
    wide = Q.question_answers(t)
    assert rows(answer.long_answers(wide).fillna(-1), *names) == rows(answer.select_answers(t.questions(), options).fillna(-1), *names)
    gold = t.questions()
    apart = answer.transitions(answer.with_gold(answer.long_answers(wide), gold), "C", "B")
    assert rows(answer.transitions_in_row(wide, gold, "C", "B").fillna(-1), "question_id", "transition") == rows(apart.fillna(-1), "question_id", "transition")


def test_nothing_is_grouped(spark):
    """No copy for an option, method or seed is sorted, hashed or dealt anew."""
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    t = Tables(spark, SF)
    assert "Aggregate" not in plan(Q.wide(t)) and plan(Q.wide(t)).count("Exchange hashpartitioning") == 1
    assert "Aggregate" not in plan(Q.question_answers(t)) and plan(Q.question_answers(t)).count("Exchange hashpartitioning") <= 2


def test_negative_keys(spark):
    """Label counts of negative keys, whose last digits do not add up, are counted out."""
    from quorumlake.plans.projection import option_pairs, option_stances

    e = spark.createDataFrame([(1, 7, -3, 1, 1.0), (1, -7, 3, 2, 1.0), (1, 12, 345, 6, 1.0)], "doc_rank int, pk long, sk long, ln long, quality double")
    of = lambda f, i: [(x["n_s"], x["n_c"]) for (v,) in e.select(f(F.array(F.struct("*")), F.lit(i))).collect() for x in v]
    for i in range(2, 5):
        pairs, direct = of(option_pairs, i), of(option_stances, i)
        assert pairs[2] == direct[2]
        assert all(s + c <= 10 for s, c in pairs)


def test_halves_at_twelve_digits(spark):
    """Twelve digits as DuckDB's round gives them; F.round goes by printed digits, and such halves made two equal scores differ in one engine only."""
    import duckdb

    from quorumlake.functions import columns as C

    xs = [(k * 0.0001234567 + 0.1) for k in range(20000)] + [(2 * k + 1) / 2e12 + 0.3 for k in range(20000)] + [-(2 * k + 1) / 2e12 - 0.7 for k in range(20000)]
    got = spark.createDataFrame([(x,) for x in xs], "x double").select("x", C.round12(F.col("x")).alias("r"), F.round("x", 12).alias("printed")).collect()
    want = dict(zip(xs, (r[0] for r in duckdb.sql(f"SELECT round(unnest({xs}::DOUBLE[]), 12)").fetchall())))
    assert all(want[g.x] == g.r for g in got) and any(want[g.x] != g.printed for g in got)
