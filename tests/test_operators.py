"""Answers, evaluation, intervals, state, text, sampling and stances against worked values."""

import json
import math
import random
import re

import pytest
from pyspark.sql import functions as F

from quorumlake.functions import text as X
from quorumlake.operators import answer, evaluate, grids, intervals, retrieval, sampling, stance, state, uncertainty


def test_answer_cases(spark):
    q = spark.createDataFrame([(i,) for i in range(6)], "question_id int")
    rows = [(0, 0, 0.5, "SUPPORT"), (0, 1, 0.2, "SUPPORT"), (1, 0, -0.1, "CONTRADICT"), (1, 1, 0.0, "ABSTAIN"), (2, 0, 0.4, "SUPPORT"), (2, 1, 0.4 + 1e-13, "SUPPORT"), (3, 0, None, "ABSTAIN"), (5, 0, 0.9, "SUPPORT")]
    o = spark.createDataFrame([(*r, "C") for r in rows], "question_id int, idx int, score double, decision string, method string")
    got = {r.question_id: (r.state, r.reason, r.answer) for r in answer.select_answers(q, o, incomplete=spark.createDataFrame([(5,)], "question_id int")).collect()}
    assert got == {
        0: ("ANSWERED", "UNIQUE_HIGHEST_POSITIVE_SCORE", 0), 1: ("ABSTAIN", "NO_POSITIVE_ELIGIBLE_SCORE", None), 2: ("ABSTAIN", "TIED_HIGHEST_POSITIVE_SCORES", None),
        3: ("ABSTAIN", "NO_POSITIVE_ELIGIBLE_SCORE", None), 4: ("ABSTAIN", "EMPTY_EVIDENCE_POOL", None), 5: ("INCOMPLETE", "INCOMPLETE_SAMPLES", None),
    }
    gold = spark.createDataFrame([(i, 0) for i in range(6)], "question_id int, gold int")
    m = answer.answer_metrics(answer.with_gold(answer.select_answers(q, o.filter("question_id = 1")), gold)).first()
    assert m.answered == 0 and m.answered_accuracy is None and m.selective_risk is None and m.accuracy == 0


def test_pair_uncertainty(spark):
    rows = [("a", 5, 3, 2), ("b", 6, 2, 2), ("c", 0, 0, 10), ("d", 9, 0, 1)]
    got = {r.k: r for r in uncertainty.pair_uncertainty(spark.createDataFrame(rows, "k string, n_s int, n_c int, n_i int")).collect()}
    assert (got["a"].p_s, got["a"].p_c, got["a"].p_i, got["a"].relevance) == (0.5, 0.3, 0.2, 0.8)
    assert got["b"].directional_score == pytest.approx(0.5) and got["b"].u_directional == pytest.approx(0.8112781244591328)
    assert (got["c"].u_3, got["c"].u_directional, got["c"].directional_score) == (0, 1, 0)
    assert got["d"].u_3 == pytest.approx(0.29590327428938457) and got["d"].directional_score == 1


def errors(spark, us, es):
    return spark.createDataFrame([(i, float(u), bool(e)) for i, (u, e) in enumerate(zip(us, es))], "pair_id int, u double, error boolean")


@pytest.mark.parametrize(("us", "es", "auroc", "ap"), [((0.9, 0.8, 0.2, 0.1), (1, 1, 0, 0), 1, 1), ((0.5, 0.5), (1, 0), 0.5, 0.5), ((0.1, 0.2), (0, 0), None, None), ((0.1, 0.2), (1, 1), None, 1.0)])
def test_error_detection(spark, us, es, auroc, ap):
    got = evaluate.error_detection(errors(spark, us, es)).first()
    assert (got.auroc, got.average_precision) == (auroc, ap)
    assert got.auroc_status == ("OK" if auroc is not None else "NA")


def test_risk_coverage(spark):
    got = evaluate.risk_coverage(errors(spark, (0.5, 0.5, 2, 3, 4), (0, 1, 0, 0, 0)), [0.25, 0.5, 0.75, 1.0], ["u", "pair_id"]).orderBy("coverage").collect()
    assert [r.retained for r in got] == [2, 3, 4, 5]
    assert got[0].accuracy == 0.5 and got[-1].risk == pytest.approx(0.2)


def test_global_ranks(spark):
    r = random.Random(1)
    rows = [(i, float(r.randint(0, 20))) for i in range(500)]
    got = evaluate.ranked(spark.createDataFrame(rows, "k int, u double").repartition(5), ["u", "k"], 7).collect()
    assert [x.k for x in sorted(got, key=lambda x: x.place)] == [k for k, _ in sorted(rows, key=lambda x: (x[1], x[0]))]
    assert sorted(x.place for x in got) == list(range(1, 501))


@pytest.mark.parametrize("parts", [2, 4, 16])
def test_global_ranks_of_many_rows(spark, parts):
    """More rows than a range exchange samples: branches that keep other columns must still agree on the ranges."""
    n = 120_000
    rows = spark.range(n).select(((F.col("id") * 7919) % n).alias("k"), (F.col("id") % 1000 / 7.0).alias("u"), F.sha2(F.col("id").cast("string"), 256).alias("wide"))
    placed = evaluate.ranked(rows, ["k"], parts)
    assert placed.filter(F.col("place") != F.col("k") + 1).count() == 0 and placed.select("place").distinct().count() == n
    summed = evaluate.running(rows.withColumn("one", F.lit(1)), ["k"], ["one", "k"], parts)
    assert summed.filter((F.col("before_one") != F.col("k")) | (F.col("before_k") != F.col("k") * (F.col("k") - 1) / 2) | (F.col("all_one") != n)).count() == 0
    chain = rows.select(F.col("k").alias("revision"), F.col("k").cast("string").alias("sha"), F.when(F.col("k") > 0, (F.col("k") - 1).cast("string")).alias("parent_sha"))
    assert state.broken_links(chain).count() == 0
    wrong = chain.withColumn("parent_sha", F.when(F.col("revision") == 0, "x").when(F.col("revision") == 77_777, "lost").otherwise(F.col("parent_sha")))
    assert sorted(r.revision for r in state.broken_links(wrong).collect()) == [0, 77_777]


def test_rank_metrics(spark):
    q = spark.createDataFrame([("q1", ["a"]), ("q2", ["b"]), ("q3", [])], "question_id string, relevant array<string>")
    docs = spark.createDataFrame([("q1", "x", 1), ("q1", "y", 2), ("q1", "a", 3), ("q2", "z", 1)], "question_id string, doc_id string, place int")
    got = retrieval.rank_metrics(q, docs, 2).first()
    assert (got.question_count, got.evaluated, got.mrr, got.hit) == (3, 2, pytest.approx(1 / 6), 0)


def plain_interval(k, n, tail=0.025):
    """Bounds by halving, each chance summed from its terms."""
    terms = lambda m, p: min(1.0, math.fsum(math.comb(n, j) * p**j * (1 - p) ** (n - j) for j in range(m + 1)))

    def cross(chance):
        low, high = 0.0, 1.0
        for _ in range(60):
            mid = (low + high) / 2
            low, high = (mid, high) if chance(mid) else (low, mid)
        return (low + high) / 2

    return (0.0 if k == 0 else cross(lambda p: 1 - terms(k - 1, p) < tail)), (1.0 if k == n else cross(lambda p: terms(k, p) > tail))


def test_intervals(spark):
    cases = [(k, n) for n in (1, 2, 5, 20, 90) for k in sorted({0, 1, n // 3, n // 2, n - 1, n}) if 0 <= k <= n] + [(0, 0), (None, 5), (3, None)]
    got = spark.createDataFrame(cases, "k long, n long").select("k", "n", intervals.interval(F.col("k"), F.col("n")).alias("a"), intervals.interval(F.col("k"), F.col("n"), 0.0125).alias("b")).collect()
    for r in got:
        if not r.n or r.k is None:
            assert r.a is None and r.b is None
        else:
            assert tuple(r.a) == pytest.approx(plain_interval(r.k, r.n), abs=1e-9) and tuple(r.b) == pytest.approx(plain_interval(r.k, r.n, 0.0125), abs=1e-9)
    of = {(r.k, r.n): r for r in got}
    assert of[0, 20].a.high == pytest.approx(0.16843347098308534) and of[20, 20].a.low == pytest.approx(0.8315665290169146) and tuple(of[1, 1].a) == (pytest.approx(0.025), 1.0)
    big = spark.sql("SELECT 30L AS k, 4000L AS n").select(intervals.interval(F.col("k"), F.col("n")).alias("i")).first().i
    assert big.low == pytest.approx(0.005066, abs=2e-6) and big.high == pytest.approx(0.010688, abs=2e-6)
    got = spark.range(1).select(intervals.newcombe_paired(*[F.lit(float(x)) for x in (4, 3, 0, 13)]).alias("i")).first().i
    assert (got.low, got.high, got.difference) == (pytest.approx(-0.03714213705333805), pytest.approx(0.33130249931992706), pytest.approx(0.15))
    apart = spark.sql("SELECT 1L AS a, 5L AS b, 20L AS n").select(intervals.bonferroni_difference(intervals.interval(F.col("a"), F.col("n"), 0.0125), intervals.interval(F.col("b"), F.col("n"), 0.0125)).alias("d")).first().d
    assert (apart.low, apart.high) == (pytest.approx(-0.20661428711733376), pytest.approx(0.5219944465456091))


def test_grids(spark):
    grid = grids.conflict_grid(spark).collect()
    assert len(grid) == 35 and sum(r.disagree for r in grid) == 14 and sum(r.reversal for r in grid) == 6 and sum(r.abstention_differs for r in grid) == 8
    by = {}
    for r in grid:
        by[r.ratio] = by.get(r.ratio, 0) + r.disagree
    assert [by[k] for k in ("9:1", "7:3", "5:5", "3:7", "1:9")] == [2, 2, 6, 2, 2]
    families = [f for r in grids.uncertainty_grid(spark).collect() for f in r.families]
    assert sorted(families.count(f) for f in set(families)) == [28, 28, 30, 30, 105]
    assert all(r.as_expected for r in grids.fixed_cases(spark).collect())


def test_state(spark):
    rows = [("a", False, 1), ("a", True, 2), ("b", False, 1), ("b", False, 2), ("b", False, 3), ("b", True, 4), ("c", False, 1)]
    got = {r.cache_key: (r.status, r.attempts) for r in state.attempt_states(spark.createDataFrame(rows, "cache_key string, ok boolean, n_try int"), ["n_try"]).collect()}
    assert got == {"a": ("VALID", 2), "b": ("FAILED", 3), "c": ("INCOMPLETE", 1)}
    keys = lambda *k: spark.createDataFrame([(x,) for x in k], "cache_key string")
    states = state.scan_states(keys("a", "b", "c", "d"), keys("a"), keys("b"), keys("c", "a"))
    assert {r.cache_key: r.status for r in states.collect()} == {"a": "VALID", "b": "FAILED", "c": "INTERRUPTED", "d": "MISSING"}
    assert {r.cache_key for r in state.pending(keys("a", "b", "c", "d"), states).collect()} == {"c", "d"}
    assert {r.cache_key for r in state.pending(keys("a", "b", "c", "d"), states, retry_failed=True).collect()} == {"b", "c", "d"}
    journal = spark.createDataFrame([("k", "x", "VALID", 1), ("k", "y", "VALID", 2), ("m", "z", "FAILED", 1), ("m", "w", "VALID", 3)], "key string, value string, status string, revision int")
    assert {r.key: r.value for r in state.fold_journal(journal, ["key"]).collect()} == {"k": "y", "m": "w"}
    assert [r.value for r in state.overwritten_valid(journal, ["key"]).collect()] == ["y"]
    chain = spark.createDataFrame([(1, None, "s1"), (2, "s1", "s2"), (3, "zz", "s3")], "revision int, parent_sha string, sha string")
    assert [r.revision for r in state.broken_links(chain).collect()] == [3]


def test_samples_of_any_size(spark):
    """The same rows as the rules applied to lists on one machine."""
    r = random.Random(6)
    rows = [{"id": i, "score": r.randint(0, 40), "a": r.choice("xyz"), "b": r.choice([None, "p", "q"])} for i in range(400)]
    caps, keys = {"a": 9, "both": 4, "none": 50}, {"a": ("a",), "both": ("a", "b"), "none": ()}
    df = spark.createDataFrame([(x["id"], x["score"], x["a"], x["b"], "more") for x in rows], "id int, score int, a string, b string, other string").repartition(3)
    placed = sorted(rows, key=lambda x: (x["score"], x["id"]))
    for total, ahead in ((1, 4), (20, 3), (20, 500), (1000, 7)):
        want = [x["id"] for x in sampling.greedy(placed, caps, keys, total)]
        got = sampling.greedy_sample(df, ["score", "id"], caps, keys, total, ahead).orderBy("position").collect()
        assert [x.id for x in got] == want and [x.position for x in got] == list(range(1, len(want) + 1)) and all(x.other == "more" for x in got)
    assert sampling.greedy_sample(df.limit(0), ["score", "id"], caps, keys, 5).count() == 0
    pools = [(f"q{k:03d}", list("ABCDE"), [f"d{k}-{j}" for j in range(r.randint(0, 6))]) for k in range(80)]
    frame = spark.createDataFrame(pools, "question string, labels array<string>, docs array<string>").repartition(3)
    for seed in (1, 42):
        assert [tuple(x) for x in sampling.structural_sample(frame, seed).orderBy("pair_id").collect()] == sampling.structural_pairs(pools, seed)
    with pytest.raises(ValueError):
        sampling.structural_sample(frame.limit(3))


def test_text(spark):
    one = lambda c, v, kind="string": spark.createDataFrame([(v,)], f"v {kind}").select(c(F.col("v"))).first()[0]
    assert one(X.evidence_type, ["Review", " Randomized  Controlled Trial", "editorial"], "array<string>") == "randomized_controlled_trial"
    assert one(X.evidence_type, ["case reports", "controlled clinical trial"], "array<string>") == one(X.evidence_type, [], "array<string>") == "other"
    assert one(X.tokens, "The therapies for virus and glasses, CELLS of analysis; cells") == ["analysis", "cell", "glasse", "virus"]
    assert one(X.relations, "It increased and is NOT associated  with") == ["associated with", "increases", "not"]
    assert one(X.sentences, "Dr. Who went. It was 3.5 mg! J. Smith et al. said so") == ["Dr. Who went.", "It was 3.5 mg!", "J. Smith et al. said so"]
    assert one(X.sentences, None) == [] and one(X.sentences, "  ") == []
    assert X.canonical_json({"b": 1e-05, "a": "é"}) == '{"a":"é","b":1e-05}'
    assert one(X.digest_of, "sha256:" + "A" * 64) == "a" * 64 and one(X.digest_of, "xyz") is None


def plain_sentences(text):
    """The same rule as a scan over the marks."""
    guarded = re.compile(r"(?:^|\s)[(\[\"'“‘]*(?:(?i:" + "|".join(map(re.escape, X.ABBREVIATIONS)) + r")|(?:[A-Za-z]\.){2,}|[A-Z]\.)$")
    single = lambda m: m[0].strip("\"'”’)]") == "."
    ends = [m.end() for m in re.finditer(r"[.!?]+[\"'”’)\]]*(?=\s|$)", text) if not (single(m) and guarded.search(text, max(0, m.start() - 80), m.start() + 1))]
    return [s for a, b in zip([0, *ends], [*ends, len(text)]) if (s := text[a:b].strip())]


def test_sentences_of_many_texts(spark):
    r = random.Random(4)
    parts = ["Dr.", "al.", "e.g.", "U.S.A.", "J.", "it", "3.5", "mg", "end.", "end!", "so?!", "...", "..", ".", 'said."', "(Fig.", "[i.e.", "'No.", "x.)", "A.", "a.", "\n", "\t", "\xa0", "é.", "?.", ".?", "no. 5", "“Mr."]
    texts = ["".join(r.choice(parts) + r.choice([" ", " ", "", "  "]) for _ in range(r.randint(0, 14))) for _ in range(3000)]
    got = spark.createDataFrame(list(enumerate(texts)), "k int, v string").select("k", X.sentences(F.col("v")).alias("s")).collect()
    assert {x.k: x.s for x in got} == {k: plain_sentences(t) for k, t in enumerate(texts)}


def plain_answer(raw):
    """The same answer by a JSON parser that is told about every pair and constant."""

    def once(pairs):
        if len({k for k, _ in pairs}) < len(pairs):
            raise ValueError
        return dict(pairs)

    def never(name):
        raise ValueError

    try:
        got = json.loads((raw or "").strip(), object_pairs_hook=once, parse_constant=never)
        p = [got[s] for s in ("SUPPORT", "CONTRADICT", "IRRELEVANT")]
        if len(got) != 3 or any(isinstance(x, bool) or not isinstance(x, (int, float)) or not 0 <= x <= 1 for x in p) or abs(sum(p) - 1) > 1e-6:
            raise ValueError
        return tuple(map(float, p))
    except (ValueError, TypeError, KeyError, RecursionError):
        return None


def test_strict_output(spark):
    good = '{"SUPPORT": 0.5, "CONTRADICT": 0.25, "IRRELEVANT": 0.25}'
    bad = [None, "", "x " + good, "```" + good + "```", good.replace("0.5", "true"), good.replace("0.5", "NaN"), good.replace("0.5", "0.6"), '{"SUPPORT": 1, "SUPPORT": 1, "CONTRADICT": 0, "IRRELEVANT": 0}', "[1]", json.dumps({"SUPPORT": 1.0}), "null", good[:-1], good + good, good.replace("0.5", '"0.5"'), good.replace(":", "=")]
    odd = [" \n" + good + "\t", good.replace("SUPPORT", "\\u0053UPPORT"), good.replace("0.5", "5e-1"), good.replace("0.5", "05e-1"), good.replace("0.5", ".5"), good.replace("0.5", "1E400"), good.replace("0.5", "-0"), '{"SUPPORT":1,"CONTRADICT":0,"IRRELEVANT":0}', '{"SUPPORT":1,"CONTRADICT":0,"IRRELEVANT":0,"SUPPORT":1}', '{"SUPPORT":1,"CONTRADICT":0,"IRRELEVANT":0,"x":0}', '{"SUPPORT":1,"CONTRADICT":0,"irrelevant":0}', '{"SUPPORT":1,"CONTRADICT":0,"IRRELEVANT":0,}', "{}", "{" * 50, '{"SUPPORT":{"a":1},"CONTRADICT":0,"IRRELEVANT":0}', good.replace("0.25}", "0.2500001}"), good.replace("0.25}", "0.250002}")]
    r = random.Random(5)
    cut = lambda t: t[: (k := r.randint(0, len(t)))] + r.choice(['"', "0", ",", "}", "", " ", "\\", "e"]) + t[k + r.randint(0, 2) :]
    texts = [good, *bad, *odd, *(cut(r.choice([good, *odd[:3]])) for _ in range(1500))]
    got = spark.createDataFrame(list(enumerate(texts)), "k int, v string").select("k", stance.strict_distribution(F.col("v")).alias("x")).collect()
    for row in got:
        want = plain_answer(texts[row.k])
        assert (None if row.x.error else (row.x.p_s, row.x.p_c, row.x.p_i)) == want, texts[row.k]
        assert (row.x.p_s is None) == (row.x.error is not None)


def test_class_tokens():
    tokens = [("<think>", b"<think>"), ("1", b"1"), ("</think>", b"</think>"), ("\n", b"\n"), ("2", b"2"), ("\n", b"\n")]
    assert stance.class_token("<think>1</think>\n2\n", tokens) == 4
    with pytest.raises(ValueError):
        stance.class_token("other", tokens)
    p = stance.label_likelihoods("2", [("2", -0.1), (" 2", -5.0), ("1", -3.0), ("3", -4.0)])
    assert p[3] is None and sum(p[:3]) == pytest.approx(1) and max(p[:3]) == p[1]
    assert stance.label_likelihoods("2", [("2", -0.1), ("1", -3.0)])[3] == "LOGPROB_INCOMPLETE"


def test_sentence_max(spark):
    rows = [("a", 0, 0.1, 0.2, 0.7, "SUCCESS"), ("a", 1, 0.6, 0.1, 0.3, "SUCCESS"), ("a", 2, 0.1, 0.6, 0.3, "SUCCESS"), ("b", 0, 0.5, 0.2, 0.3, "SUCCESS"), ("b", 1, None, None, None, "FAILED"), ("c", 1, 0.5, 0.2, 0.3, "SUCCESS")]
    got = {r.pair: (r.status, r.sentence_index) for r in stance.sentence_max(spark.createDataFrame(rows, "pair string, sentence_index int, p_s double, p_c double, p_i double, status string"), ["pair"]).collect()}
    assert got == {"a": ("SUCCESS", 1), "b": ("FAILED", None), "c": ("FAILED", None)}


def test_samples(spark):
    pools = [(f"q{i:02d}", list("ABCDE"), [f"d{j}" for j in range(i % 5 + 1)]) for i in range(30)]
    a, b = sampling.structural_pairs(pools), sampling.structural_pairs(pools)
    assert a == b and len(a) == 30 and len({p[1] for p in a}) == 10 and a[0][0] == "pair-001"
    rows = [{"question_id": q, "option": o, "doc_id": d} for q in range(6) for o in "ABC" for d in range(3)]
    got = sampling.greedy(rows, sampling.CAPS, sampling.KEYS, 30)
    assert len(got) == 18 and all(sum(r["question_id"] == q for r in got) == 3 for q in range(6))
    pairs = spark.createDataFrame([(1, "aspirin reduces fever", "Aspirin trial", "Aspirin increases bleeding. Fever fell.\nNothing here.", 1), (2, "the of", "x", "", 2)], "pair_id int, candidate string, title string, abstract string, doc_rank int")
    f = {r.pair_id: r for r in sampling.pair_features(pairs, spark.createDataFrame([("aspirin", 1.5)], "token string, idf double")).collect()}
    assert f[1].shared == ["aspirin", "fever"] and f[1].overlap_weight == 2.5 and f[1].relations == ["increases"] and f[1].shared_title == ["aspirin"]
    assert f[2].coverage == 0 and f[2].overlap_weight == 0
