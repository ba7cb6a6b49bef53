"""Arrow functions over claims and questions against the same sums in plain Python, and plans without interpreted scores."""

import math
import random

from pyspark.sql import functions as F

from quorumlake import queries as Q
from quorumlake.functions import batches
from quorumlake.functions.columns import STANCES

SF = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def decided(x):
    return 0 if x is None else (x > 0) - (x < 0)


def soft(pairs, gone=None, entropy=False):
    """The score of C or D with one seed left out; null where it is undefined."""
    rows = []
    for q, n_s, n_c, n_i, stances in pairs:
        left = stances[gone] if gone is not None and stances and gone < len(stances) else None
        n = [None if x is None else x - (left == s) for x, s in zip((n_s, n_c, n_i), STANCES)]
        if q is None or None in n or not sum(n):
            return None
        p = [x / sum(n) for x in n]
        h = 1.0 if p == [1 / 3] * 3 else min(1.0, max(0.0, -sum(x * math.log(x) for x in p if x) / math.log(3)))
        rows.append((q * (1 - h) if entropy else q, p[0] - p[1]))
    total = math.fsum(w for w, _ in rows)
    return math.fsum(w / total * d for w, d in rows) if total else None


def test_stability(spark):
    assert "aggregate(" not in plan(Q.QUERIES["loso_stability"](spark, SF))
    r, known = random.Random(1), [*STANCES, None, "MAYBE"]

    def pair():
        stances = r.choices(known, [4, 3, 3, 0.3, 0.3], k=r.choice([1, 3, 4, 4]))
        counts = [stances.count(x) for x in STANCES]
        if r.random() < 0.05:
            counts[r.randrange(3)] = None
        return (r.choice([0.0, 0.25, 0.5, 1.0, None if r.random() < 0.2 else 1e-300]), *counts, stances)

    claims = [(k, [pair() for _ in range(r.choice([0, 1, 2, 3, 5]))]) for k in range(300)]
    df = spark.createDataFrame([*claims, (300, None)], "k int, v array<struct<quality:double,n_s:int,n_c:int,n_i:int,stances:array<string>>>")
    got = {x.k: {y.method: (y.n, y.delta) for y in x.x} for x in df.select("k", batches.stability(F.col("v"), ("C", "D")).alias("x")).collect()}
    assert got[300] == {"C": (None, None), "D": (None, None)}
    for k, pairs in claims:
        for m in "CD":
            full = soft(pairs, entropy=m == "D") if pairs else None
            less = [soft(pairs, j, m == "D") for j in range(len(pairs[0][4]))] if pairs else []
            n, delta = got[k][m]
            deltas = [abs(x - full) for x in less if x is not None and full is not None]
            assert (delta is None) == (not deltas) and (not deltas or abs(delta - max(deltas)) < 1e-9)
            if m == "C":
                # Exact signs, up to sums that plain Python rounds otherwise.
                assert not pairs and n is None or pairs and abs(n - sum(decided(x) != decided(full) for x in less)) <= sum(x is not None and abs(x) < 1e-15 for x in [*less, full]) * len(less)


def test_answers(spark):
    """Answers by batches against those of the array functions, for pools of any size, and no question without its row."""
    from quorumlake.functions.columns import bound, round12
    from quorumlake.operators import aggregate, answer

    for name in ("answer_select", "question_accuracy"):
        assert "aggregate(" not in plan(Q.QUERIES[name](spark, SF))
    r = random.Random(2)

    def row(k):
        n = r.choice([1, 2, 3, 7])
        count = lambda: (lambda s: 16 * s + r.randint(0, 10 - s))(r.randint(0, 10))
        few = [count() for _ in range(2)]
        return k, [r.choice([0.0, 0.1111111111, 0.5, 1.0]) for _ in range(n)], [[r.choice(few) if r.random() < 0.5 else count() for _ in range(n)] for _ in range(5)]

    df = spark.createDataFrame([*map(row, range(500)), (500, None, None)], "k int, q array<double>, n array<array<int>>")
    pair = lambda q, n: F.struct(F.lit("x").alias("doc_id"), q.alias("quality"), F.shiftright(n, 4).alias("n_s"), n.bitwiseAND(15).alias("n_c"), (10 - F.shiftright(n, 4) - n.bitwiseAND(15)).alias("n_i"))
    made = F.transform("n", lambda n, i: F.struct(i.alias("idx"), aggregate.verdict(aggregate.votes(F.zip_with("q", n, pair))).alias("x")))
    of = lambda m: F.transform("made", lambda o: F.struct(o["idx"].alias("idx"), round12(o["x"][f"score_{m}"]).alias("score"), o["x"][f"decision_{m}"].alias("decision")))
    named = lambda m: lambda a: F.struct(F.lit(m.upper()).alias("method"), a["state"], a["reason"], a["answer"], a["ranking"])
    want = df.filter("k < 500").withColumn("made", made).select("k", F.array(*[bound(answer.chosen(of(m)), named(m)) for m in "abcd"]).alias("a"))
    rows = lambda x: {y.k: y.a and [tuple(z) for z in y.a] for y in x.collect()}
    got = rows(df.select("k", batches.answers(F.col("q"), F.col("n"), 10).alias("a")))
    assert got.pop(500) is None and got == rows(want)
