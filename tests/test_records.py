"""Operators of identity, searching, prompts and payloads: edge cases that the registered queries do not reach."""

import pytest
from pyspark.sql import functions as F

from quorumlake.functions import prompts
from quorumlake.operators import identity, payload, searching
from quorumlake.sources import articles


def test_identity(spark):
    rows = spark.createDataFrame([(1, "a"), (2, "b"), (3, "a")], "k int, name string")
    assert [r.k for r in identity.first_distinct(rows, ["k"], 2, "name").collect()] == [1, 2]
    with pytest.raises(Exception, match="repeated name"):
        identity.first_distinct(rows, ["k"], 3, "name").collect()
    assert [(r.position, r.found) for r in identity.chosen(rows, [(3,), (9,)], ["k"]).orderBy("position").collect()] == [(0, True), (1, False)]
    pair = spark.createDataFrame([("q", "q", "d", "d"), ("q", "x", "d", "d"), ("q", None, "d", "d")], "a string, b string, c string, d string")
    assert [r[0] for r in pair.select(identity.same_identity((F.col("a"), F.col("b")), (F.col("c"), F.col("d")))).collect()] == [True, False, False]
    none = spark.createDataFrame([(None,)], "v string")
    got = none.select(identity.match_count(F.col("v")), identity.search_result_ok(F.col("v")), identity.article_record_ok(F.col("v"), F.lit("1")), identity.payload_ok(F.col("v"), {"a": "b"}), identity.development_id(F.col("v"))).first()
    assert tuple(got) == (None, False, False, False, None)
    assert identity.leaks(rows, ["k", "name"], []).count() == 0


def test_empty_tables(spark):
    claims = spark.createDataFrame([], "question_id int, option string, claim string")
    questions = spark.createDataFrame([], "question_id int, options array<struct<label:string,text:string>>")
    assert identity.claim_status(claims, questions).count() == 0
    hits = spark.createDataFrame([], "question_id int, pmid string, position int")
    assert searching.ranked_records(hits, spark.createDataFrame([], "pmid string, t string"), 3).count() == 0
    assert identity.id_batches(hits, "pmid", ["position"]).count() == 0
    errors = spark.createDataFrame([], "ref string, error boolean, u double")
    assert [(r.n, r.accuracy) for r in payload.by_reference(errors, ["u"]).collect()] == [(0, None)] * 3


def test_searching(spark):
    requests = spark.createDataFrame([(1, "a"), (2, "a"), (3, None)], "k int, query string")
    got, made = searching.searched_once(requests, lambda q: q.withColumn("hits", F.lit(5)))
    assert {r.k: r.hits for r in got.collect()} == {1: 5, 2: 5, 3: None} and made.count() == 1
    keys = spark.createDataFrame([("a", "p", "r"), ("b", "p", "r"), ("a", "q", "r")], "f string, p string, r string").select(searching.key_space(F.col("f"), F.col("p"), F.col("r"))).collect()
    assert len(set(keys)) == 3
    cached = spark.createDataFrame([(1, "wrong")], "question_id int, stem_sha string")
    with pytest.raises(Exception, match="stem differs"):
        searching.stem_checked(cached, spark.createDataFrame([(1, "s")], "question_id int, question string")).collect()


def test_payload(spark):
    status = spark.createDataFrame([(600, 600, 0, 0), (600, 599, 1, 0), (590, 590, 0, 0)], "expected int, valid int, failed int, missing int")
    assert [r.mode for r in payload.run_gate(status, 600).collect()] == ["FINAL_EVALUATION", "PARTIAL_DIAGNOSTIC", "PARTIAL_DIAGNOSTIC"]
    table = spark.createDataFrame([(1, ["a"], None, {"k": 1.5})], "k int, a array<string>, n double, m map<string,double>")
    assert tuple(payload.flat(table).first()) == ("1", '["a"]', "", '{"k":1.5}')


def test_prompts(spark):
    row = spark.createDataFrame([("q", "o", "t", ["One.", "Two."])], "q string, o string, t string, s array<string>")
    got = row.select(prompts.stance_prompt(F.col("q"), F.col("o"), F.col("t"), F.lit(None).cast("string"), "Do."), prompts.search_prompt("primary", F.lit("1"), F.col("q")), prompts.evidence_sentences(F.col("t"), F.col("s"))).first()
    assert got[0] == 'Do.\n{"candidate_option_text":"o","evidence_abstract":null,"evidence_title":"t","question_stem":"q"}'
    assert got[1].endswith('{"question_id":"1","question_stem":"q"}')
    assert [(x.sentence_index, x.source, x.abstract_index, x.text) for x in got[2]] == [(0, "title", None, "t"), (1, "abstract", 0, "One."), (2, "abstract", 1, "Two.")]


def test_article_faults(spark, tmp_path):
    for name, text, fault in (("e.xml", "<PubmedArticleSet><ERROR>busy</ERROR></PubmedArticleSet>", "reports an error"), ("r.xml", "<html></html>", "root is not")):
        (tmp_path / name).write_text(text)
        with pytest.raises(Exception, match=fault):
            articles.articles(spark, str(tmp_path / name)).collect()
    (tmp_path / "ok.xml").write_text('<?xml version="1.0"?>\n<!DOCTYPE PubmedArticleSet>\n<PubmedArticleSet></PubmedArticleSet>')
    assert articles.articles(spark, str(tmp_path / "ok.xml")).count() == 0
