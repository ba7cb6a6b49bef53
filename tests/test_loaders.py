"""Loaders of verified inputs, and results that are checked against their logits."""

import json
import math

import pytest
from pyspark.sql import functions as F

from quorumlake.functions import columns as C
from quorumlake.operators.inputs import InputFault
from quorumlake.sources import loaders as L
from quorumlake.sources import pinned, records


def question(k, **more):
    return {"id": f"medqa-us-dev-{k:06d}", "question": f"what {k}", "options": {x: f"{x} {k}" for x in "ABCDE"}, "answer": "B", **more}


@pytest.mark.parametrize(("change", "fault"), [
    ({}, None), ({"id": "medqa-us-dev-000009"}, "id_differs"), ({"options": {"B": "x", "A": "y", "C": "z", "D": "v", "E": "w"}}, "options_differ"), ({"options": {x: "y" for x in "ABCD"}}, "options_differ"),
    ({"question": " "}, "question_blank"), ({"options": {x: "" if x == "C" else "y" for x in "ABCDE"}}, "option_blank"), (None, "malformed"),
])
def test_open_questions(spark, tmp_path, change, fault):
    rows = [json.dumps(question(k)) for k in (1, 2, 3, 4)]
    rows[1] = "{broken" if change is None else json.dumps(question(2, **change))
    (tmp_path / "q.jsonl").write_text("\n\n".join(rows))
    if fault:
        with pytest.raises(InputFault) as e:
            L.open_questions(spark, str(tmp_path / "q.jsonl"), 3)
        assert fault in e.value.counts and e.value.where[fault].endswith("|3")
        return
    got = L.open_questions(spark, str(tmp_path / "q.jsonl"), 3)
    assert got.columns == ["question_id", "question", "options"] and [r.question for r in got.orderBy("question_id").collect()] == ["what 1", "what 2", "what 3"]
    with pytest.raises(ValueError, match="4 questions for 9"):
        L.open_questions(spark, str(tmp_path / "q.jsonl"), 9)


KEYS = ["question_id", "candidate_option_id", "evidence_doc_id"]
IDENTITY = {"classifier_version": "v1", "model": "m", "temperature": 0.0, "seed": 42, "thinking": True}


def judged(k, **more):
    item = {"question_id": f"q{k}", "candidate_option_id": "A", "evidence_doc_id": str(k), "cache_key": f"key{k}", "classifier_version": "v1", "argmax_label": "SUPPORT", "model_metadata": {"model": "m", "temperature": 0.0, "seed": 42, "thinking": True}}
    return item | more


@pytest.mark.parametrize(("change", "rows", "fault"), [
    ({}, [("q1", "A", "1", "SUPPORT"), ("q7", "B", "7", "IRRELEVANT")], None), ({"argmax_label": "MAYBE"}, [], "label_unknown"), ({"cache_key": "other"}, [], "name_differs"), ({"model_metadata": {"model": "n", "temperature": 0.0, "seed": 42, "thinking": True}}, [], "identity_differs"),
    ({"model_metadata": {"model": "m", "temperature": 0.0, "seed": 42}}, [], "identity_differs"), ({"question_id": "q1", "evidence_doc_id": "1"}, [], "key_repeated"), ({}, [("q1", "A", "1", "CONTRADICT")], "labels_conflict"), ({}, [("q9", "A", "9", "SUPPORT")] * 2, "key_repeated"), ({}, [("q9", "A", "9", "")], "label_unknown"),
])
def test_hard_stances(spark, tmp_path, change, rows, fault):
    for k in (1, 2):
        (tmp_path / f"key{k}.json").write_text(json.dumps(judged(k, **(change if k == 2 else {})), indent=1))
    (tmp_path / "note.txt").write_text("no judgement")
    table = spark.createDataFrame(rows, "question_id string, candidate_option_id string, evidence_doc_id string, label string")
    if fault:
        with pytest.raises(InputFault) as e:
            L.hard_stances(spark, str(tmp_path), table, IDENTITY, KEYS)
        assert fault in e.value.counts
        return
    got = sorted((r.question_id, r.label, r.cache_key, r.source) for r in L.hard_stances(spark, str(tmp_path), table, IDENTITY, KEYS).collect() if r.cache_key)
    assert got == [("q1", "SUPPORT", "key1", "key1.json"), ("q2", "SUPPORT", "key2", "key2.json")]
    assert [(r.question_id, r.label, r.source) for r in L.hard_stances(spark, str(tmp_path), table, IDENTITY, KEYS).filter("cache_key IS NULL").collect()] == [("q7", "IRRELEVANT", "predictions")]


def test_uncertainty_table(spark, tmp_path):
    head = "question_id,candidate_option_id,evidence_doc_id,pair_id,evaluation_included,n_support,n_contradict,n_irrelevant,p_support,p_contradict,p_irrelevant,u_3,u_directional,relevance,directional_score\n"
    good = ["q1,A,1,p1,True,5,3,2,0.5,0.3,0.2,0.9,0.95,0.8,0.25", "q1,B,1,p2,True,10,0,0,1,0,0,0,0,1,1"]
    (tmp_path / "u.csv").write_text(head + "\n".join(good))
    got = L.uncertainty_table(spark, str(tmp_path / "u.csv"), KEYS)
    assert sorted((r.pair_id, r.n_support, r.u_3) for r in got.collect()) == [("p1", 5, 0.9), ("p2", 10, 0.0)]
    for row, fault in [(good[0].replace("0.9,", "x,"), "not_a_number"), (good[0].replace("0.3", "0.31"), "probabilities_off"), (good[0].replace("5,3,2", "5,3,3"), "counts_off"), (good[1], "key_repeated"), (good[0].replace("True", "False"), "excluded"), (good[0].replace("0.95", "NaN"), "not_a_number")]:
        (tmp_path / "u.csv").write_text(head + "\n".join([row, good[1]]))
        with pytest.raises(InputFault) as e:
            L.uncertainty_table(spark, str(tmp_path / "u.csv"), KEYS)
        assert fault in e.value.counts


def test_unlabelled(spark, tmp_path):
    row = lambda k, **more: json.dumps({f: f"{f} {k}" for f in L.OPEN_FIELDS} | more)
    at, pins = tmp_path / "in", tmp_path / "pins"
    at.mkdir()

    def load(*rows, pin=True):
        (at / "x.jsonl").write_text("\n".join(rows) + "\n")
        if pin:
            pinned.leaves(spark, str(at)).write.mode("overwrite").parquet(str(pins))
        return L.unlabelled(spark, str(at), str(pins))

    assert load(row(1), row(2)).count() == 2
    with pytest.raises(pinned.Unpinned):
        load(row(1), row(3), pin=False)
    for rows, fault in [((row(1), row(2, label="SUPPORT")), "fields_differ"), ((row(1), row(2, question_stem=5)), "not_text"), ((row(1), row(1, question_stem="other")), "key_repeated"), ((row(1), "{}"), "fields_differ")]:
        with pytest.raises(InputFault) as e:
            load(*rows)
        assert fault in e.value.counts


def test_completions(spark):
    replies = [('{"done": true, "response": "yes"}', "yes", None), ('{"done": true, "response": " "}', None, "no generated text"), ('{"done": "true", "response": "x"}', None, "incomplete generation"), ('{"response": "x"}', None, "incomplete generation"), ('{"done": true, "response": "x", "error": "busy"}', None, "the service reports an error"), ("[1]", None, "invalid reply"), ("<html>", None, "invalid reply"), (None, None, "invalid reply"), ('{"done": true, "response": 5}', None, "no generated text")]
    got = spark.createDataFrame([(k, r) for k, (r, _, _) in enumerate(replies)], "k int, r string").select("k", L.completion(F.col("r")).alias("c")).orderBy("k").collect()
    assert [(r.c.text, r.c.error) for r in got] == [(t, e) for _, t, e in replies]


def test_evidence_lines_read_back(spark, tmp_path):
    rows = spark.createDataFrame([("q", "d1", 1, "text é", "s", "other", 0.5), ("q", "d2", 2, "more", "s", "cohort_study", 0.25)], "question_id string, doc_id string, doc_rank int, text string, source string, evidence_type string, retrieval_score double")
    L.evidence_lines(rows.withColumn("stances", F.create_map(F.lit("A"), F.lit("SUPPORT")))).write.text(str(tmp_path / "e"))
    good, bad = records.evidence(spark, str(tmp_path / "e"))
    assert bad.count() == 0 and sorted((r.doc_id, r.doc_rank, r.text, r.stances) for r in good.collect()) == [("d1", 1, "text é", None), ("d2", 2, "more", None)]


def test_scored_results(spark):
    e = [math.exp(x) for x in (1.0, 2.0, 0.5)]
    good = [x / sum(e) for x in e]
    names = {"0": "CONTRADICT", "1": "SUPPORT", "2": "IRRELEVANT"}
    rows = [
        ([1.0, 2.0, 0.5], good, names), ([0.0, 0.0, -800.0], [0.5, 0.5, 0.0], names), ([1.0, 2.0, 0.5], [good[1], good[0], good[2]], names), ([1.0, 2.0], good, names), ([1.0, 2.0, float("nan")], good, names),
        ([1.0, 2.0, 0.5], [x * 0.99 for x in good], names), ([1.0, 2.0, 0.5], good, {"0": "SUPPORT", "1": "SUPPORT", "2": "IRRELEVANT"}), (None, good, names),
    ]
    df = spark.createDataFrame([(k, *r) for k, r in enumerate(rows)], "k int, l array<double>, s array<double>, m map<string,string>")
    got = [r.x for r in df.select("k", C.scored_result(F.col("l"), F.col("s"), F.col("m")).alias("x")).orderBy("k").collect()]
    assert (got[0].p_s, got[0].p_c, got[0].label, got[0].is_tied, got[0].error) == (good[1], good[0], "SUPPORT", False, None)
    assert (got[1].label, got[1].is_tied, got[1].entropy) == (None, True, pytest.approx(math.log(2) / math.log(3)))
    assert [x.error for x in got[2:]] == ["scores are not the softmax of the logits", *["three finite logits and scores are needed"] * 2, "scores must sum to one", "labels are not one to one onto the stances", "three finite logits and scores are needed"]
    assert all(x.p_s is None and x.label is None for x in got[2:])
    top = spark.sql("SELECT 0.4D AS a, 0.4D AS b, 0.2D AS c").select(C.top_probability(F.col("a"), F.col("b"), F.col("c")).alias("t"), C.is_tied(F.col("a"), F.col("b"), F.col("c")).alias("e")).first()
    assert (top.t, top.e) == (0.4, True)
