"""Inputs verified together, the batch split, and files pinned to their bytes."""

import os
import random

import pytest
from pyspark.sql import functions as F

from quorumlake.operators import evaluate, inputs
from quorumlake.sources import pinned

SEEDS = [1, 2, 3, 4]
STANCES = ("SUPPORT", "CONTRADICT", "IRRELEVANT")


def sources(change=None):
    """Two questions with three options and two documents; change alters the lists before they become frames."""
    r = random.Random(1)
    s = {"samples": [], "counts": [], "evidence": [], "texts": [], "weights": [("trial", 0.5), ("other", 0.0)]}
    for q in (1, 2):
        for rank, doc in enumerate(("x", "y"), 1):
            text = f"text {q} {doc}"
            s["evidence"].append([q, doc, rank, "trial" if rank == 1 else "other", 0.5 if rank == 1 else 0.0, text])
            s["texts"].append([q, doc, text])
            for idx in range(3):
                drawn = [r.choice(STANCES) for _ in SEEDS]
                s["samples"] += [[q, idx, doc, seed, x] for seed, x in zip(SEEDS, drawn)]
                s["counts"].append([q, idx, doc, *[drawn.count(x) for x in STANCES]])
    if change:
        change(s)
    return s


def load(spark, s):
    make = lambda name, schema: spark.createDataFrame(s[name], schema)
    evidence = make("evidence", "question_id int, doc_id string, doc_rank int, evidence_type string, quality double, text string").withColumn("text_sha", F.sha2("text", 256)).drop("text")
    return inputs.load_pairs(
        make("samples", "question_id int, idx int, doc_id string, seed int, stance string"), make("counts", "question_id int, idx int, doc_id string, n_s int, n_c int, n_i int"), evidence,
        make("texts", "question_id int, doc_id string, text string"), make("weights", "evidence_type string, quality double"), SEEDS,
    )


def set_at(name, i, k, value):
    def change(s):
        s[name][i][k] = value

    return change


@pytest.mark.parametrize(("change", "fault", "n"), [
    (lambda s: s["samples"].__delitem__(slice(0, 4)), "samples_missing", 1), (lambda s: s["counts"].pop(0), "counts_missing", 1), (lambda s: s["counts"].append(s["counts"][3]), "pair_repeated", 1),
    (lambda s: s["counts"].__setitem__(2, [*s["counts"][2][:3], 4, 4, 4]), "counts_differ", 1), (set_at("samples", 0, 3, 9), "seeds_differ", 1), (set_at("samples", 0, 4, "MAYBE"), "stance_unknown", 1),
    (lambda s: s["evidence"].pop(), "evidence_missing", 3), (lambda s: s["evidence"].append(s["evidence"][0]), "document_repeated", 3), (set_at("texts", 1, 2, "other"), "text_differs", 3),
    (set_at("evidence", 2, 4, 0.25), "weight_differs", 3), (set_at("evidence", 0, 2, 3), "ranks_broken", 6), (lambda s: (s["samples"].__delitem__(slice(0, 4)), s["counts"].pop(0)), "options_differ", 5),
])
def test_every_fault_is_named(spark, change, fault, n):
    with pytest.raises(inputs.InputFault) as e:
        load(spark, sources(change))
    assert e.value.counts[fault] == n and fault in str(e.value) and "|" in e.value.where[fault]


def test_sources_meet_where_they_are(spark):
    """Sources that are dealt by question are not dealt anew, and no vector of a question is gathered."""
    from quorumlake import table_queries as T
    from quorumlake.plans.projection import Tables

    placed, faults = inputs.matched_pairs(*T.five_sources(Tables(spark, "/root/testdata/sf0.001")), [1])
    plan = placed.select(*[c.alias(k) for k, c in faults.items()])._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") - plan.count("ReusedExchange") <= 4 and "Exchange hashpartitioning(question_id" not in plan
    assert "collect_list" not in plan and "to_json" not in plan


def test_planted_faults_shuffle_little(spark):
    """Pairs of sources with planted faults are not dealt anew either."""
    from quorumlake.queries import QUERIES

    plan = QUERIES["input_faults"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "Exchange hashpartitioning(question_id" not in plan


def test_keys_that_are_null(spark):
    """Rows without a whole key meet nothing, on either side."""
    def change(s):
        s["samples"] += [[1, 0, None, seed, "SUPPORT"] for seed in SEEDS]
        s["counts"].append([1, 0, None, 4, 0, 0])
        s["evidence"].append([1, None, 3, "trial", 0.5, "text"])
        s["texts"].append([1, None, "text"])

    with pytest.raises(inputs.InputFault) as e:
        load(spark, sources(change))
    # Both rows of the pair (a missing count is undecided on being repeated), and all of a question whose options differ by them.
    assert e.value.counts == {"samples_missing": 1, "counts_missing": 1, "pair_repeated": 1, "evidence_missing": 2, "options_differ": 8}


def test_inputs_that_agree(spark):
    pairs, counters = load(spark, sources())
    assert counters == {"rows": 12, "samples": 48} and pairs.count() == 12 and pairs.columns[-1] == "quality"


def test_reference_join(spark):
    ref = [("p1", "q1", "x", "a", "SUPPORT"), ("p2", "q1", "y", "b", " "), ("p3", "q2", "x", "b", "IRRELEVANT")]
    hard = [("p1", "q1", "x", "SUPPORT", ""), ("p2", "q1", "y", None, None), ("p3", "q2", "x", "CONTRADICT", "IRRELEVANT")]
    frame = lambda rows, last: spark.createDataFrame(rows, f"pair_id string, question_id string, doc_id string, {last}")
    run = lambda a, b: inputs.reference_join(frame(a, "batch string, stance string"), frame(b, "stance string, reference_stance string"), ["question_id", "doc_id"])
    rows, counters = run(ref, hard)
    assert counters == {"rows": 3, "missing_reference": 1, "missing_hard": 1}
    assert sorted((r.pair_id, r.batch, r.reference_stance, r.hard_stance) for r in rows.collect()) == [("p1", "a", "SUPPORT", "SUPPORT"), ("p2", "b", None, None), ("p3", "b", "IRRELEVANT", "CONTRADICT")]
    for a, b, fault in [
        (ref, hard[:2], "hard_missing"), (ref[:2], hard, "reference_missing"), ([*ref, ref[0]], hard, "pair_repeated"), (ref, [("p1", "q1", "z", "SUPPORT", ""), *hard[1:]], "identity_differs"),
        ([*ref[:2], ("p3", "q1", "x", "b", "")], [*hard[:2], ("p3", "q1", "x", "", "")], "identity_repeated"), (ref, [("p1", "q1", "x", "MAYBE", ""), *hard[1:]], "label_unknown"), (ref, [("p1", "q1", "x", "SUPPORT", "CONTRADICT"), *hard[1:]], "reference_differs"),
    ]:
        with pytest.raises(inputs.InputFault) as e:
            run(a, b)
        assert list(e.value.counts) == [fault]


def test_evaluate_samples(spark):
    rows = [(1, 0, "x", seed, "SUPPORT") for seed in SEEDS] + [(2, 0, "x", seed, STANCES[seed % 3]) for seed in SEEDS] + [(3, 0, "x", 1, "SUPPORT")] + [(4, 0, "x", seed, "IRRELEVANT") for seed in SEEDS]
    ref = [(1, 0, "x", "SUPPORT"), (2, 0, "x", "IRRELEVANT"), (3, 0, "x", "SUPPORT")]
    judged, metrics = inputs.evaluate_samples(spark.createDataFrame(rows, "question_id int, idx int, doc_id string, seed int, stance string"), spark.createDataFrame(ref, "question_id int, idx int, doc_id string, reference_stance string"), SEEDS)
    got = {r.question_id: (r.included, r.error, r.exclusion_reason) for r in judged.collect()}
    assert got == {1: (True, False, ""), 2: (True, True, ""), 4: (False, None, "missing reference stance")}
    m = metrics.first()
    assert (m.n, m.errors, m.auroc, m.incomplete) == (2, 1, 1.0, 1)


def test_batches_and_agreement(spark):
    r, methods = random.Random(2), ["a", "b", "c"]
    ref = [(i, r.choice(["structural", "directional"]), r.choice(STANCES)) for i in range(90)]
    guess = {(i, m): r.choice([x, *STANCES]) for i, _, x in ref for m in methods}
    p = spark.createDataFrame([(i, m, g) for (i, m), g in guess.items()], "pair_id int, method string, guess string")
    wide = evaluate.side_by_side(p, spark.createDataFrame(ref, "pair_id int, batch string, ref string"), ["pair_id"], methods)
    parts = {"combined": ref, **{b: [x for x in ref if x[1] == b] for b in ("structural", "directional")}}
    got = {(x.batch, x.method): (x.n, x.accuracy) for x in evaluate.batch_metrics(wide, methods).collect()}
    assert got == {(b, m): (len(rows), pytest.approx(sum(guess[i, m] == x for i, _, x in rows) / len(rows))) for b, rows in parts.items() for m in methods}
    one = {x.method: x.macro_f1 for x in evaluate.classification(p.join(spark.createDataFrame(ref, "pair_id int, batch string, ref string"), "pair_id"), ["method"]).collect()}
    assert {x.method: x.macro_f1 for x in evaluate.batch_metrics(wide, methods).filter("batch = 'combined'").collect()} == one
    right = lambda i, x: [guess[i, m] == x for m in methods]
    assert {x.batch: (x.pairs, x.all_right, x.all_wrong, x.differ) for x in evaluate.agreement(wide, methods).collect()} == {
        b: (len(rows), sum(all(right(i, x)) for i, _, x in rows), sum(not any(right(i, x)) for i, _, x in rows), sum(len({guess[i, m] for m in methods}) > 1 for i, _, _ in rows)) for b, rows in parts.items()
    }
    assert sum(x.pairs for x in evaluate.right_patterns(wide).filter("batch = 'combined'").collect()) == 90
    assert sum(x.pairs for x in evaluate.contradictions(wide, methods).collect()) == sum("CONTRADICT" in (x, guess[i, m]) for i, _, x in ref for m in methods)
    with pytest.raises(Exception, match="one guess of every method"):
        evaluate.side_by_side(p.filter("pair_id <> 5 OR method <> 'b'"), spark.createDataFrame(ref, "pair_id int, batch string, ref string"), ["pair_id"], methods).collect()


@pytest.fixture
def small_splits(spark):
    names = {"spark.sql.files.maxPartitionBytes": "700", "spark.sql.files.openCostInBytes": "1"}
    before = {k: spark.conf.get(k) for k in names}

    def use(small):
        for k, v in (names if small else before).items():
            spark.conf.set(k, v)

    yield use
    use(False)


def test_pinned_files(spark, tmp_path, small_splits):
    r = random.Random(3)
    folder = tmp_path / "in"
    folder.mkdir()
    for name in ("a.jsonl", "b.jsonl"):
        (folder / name).write_bytes(b"\n".join(("é" * r.randint(0, 60) + str(i)).encode() + r.choice([b"", b"\r"]) for i in range(150)) + (b"\n" if name == "a.jsonl" else b""))
    pinned.pin(spark, str(folder), str(tmp_path / "pins"), 512)
    tree = spark.read.parquet(str(tmp_path / "pins"))
    assert tree.agg(F.sum("lines")).first()[0] == 300 and tree.count() > 20
    root = pinned.root(tree)
    small_splits(True)
    # The tree does not depend on how the files are split.
    assert spark.read.text(str(folder)).rdd.getNumPartitions() > 8
    assert pinned.root(pinned.leaves(spark, str(folder), 512)) == root
    assert pinned.pinned_lines(spark, str(folder), str(tmp_path / "pins"), 512).count() == 300
    whole = (folder / "b.jsonl").read_bytes()
    for at in (0, 700, 701, len(whole) // 2, len(whole) - 1):
        if whole[at] in (10, 13):
            continue
        (folder / "b.jsonl").write_bytes(whole[:at] + bytes([whole[at] ^ 1]) + whole[at + 1 :])
        with pytest.raises(pinned.Unpinned, match="b.jsonl from byte .*altered"):
            pinned.pinned_lines(spark, str(folder), str(tmp_path / "pins"), 512)
    lines = whole.split(b"\n")
    for other in (whole + b"\n", whole[:-1], b"\n".join([*lines[:9], lines[10], lines[9], *lines[11:]]), whole + b"\nmore"):
        (folder / "b.jsonl").write_bytes(other)
        with pytest.raises(pinned.Unpinned, match="b.jsonl"):
            pinned.pinned_lines(spark, str(folder), str(tmp_path / "pins"), 512)
    os.remove(folder / "b.jsonl")
    with pytest.raises(pinned.Unpinned, match="b.jsonl from byte 0: lost"):
        pinned.pinned_lines(spark, str(folder), str(tmp_path / "pins"), 512)
