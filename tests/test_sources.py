"""Scans, rejects, archives, XML, connectors, writers and the attempt stream."""

import datetime
import json

import pytest
from pyspark.sql import functions as F

from quorumlake.sources import archive, articles, connectors, records, sinks
from quorumlake.streaming import collect

QUESTIONS = [
    {"id": "q1", "question": "Which?", "options": {"B": "two", "A": "one"}, "answer": "A", "relevant_doc_ids": ["d1"]},
    {"question_id": "q2", "question": "What?", "options": ["x", "y", "z"], "answer": 2},
    {"id": "q3", "question": "Text?", "options": ["x", "1"], "answer": "1"},
    {"id": "q4", "question": " ", "options": ["x", "y"], "answer": 0},
    {"id": "q5", "question": "One?", "options": ["x"], "answer": 0},
    {"id": "q6", "question": "None?", "options": ["x", "y"], "answer": "w"},
    {"id": "q7", "question": "Far?", "options": ["x", "y"], "answer": 5},
    {"id": "dup", "question": "a", "options": ["x", "y"], "answer": 0},
    {"id": "dup", "question": "b", "options": ["x", "y"], "answer": 0},
]


def write_lines(path, rows):
    path.write_text("\n".join(r if isinstance(r, str) else json.dumps(r) for r in rows) + "\n")
    return str(path)


def test_lines_are_numbered_across_blocks(spark, tmp_path):
    path = write_lines(tmp_path / "big.jsonl", [json.dumps({"k": i}) for i in range(2000)])
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4k")
    spark.conf.set("spark.sql.files.openCostInBytes", "1k")
    try:
        got = {r.line: json.loads(r.value)["k"] for r in records.lines(spark, path).collect()}
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
        spark.conf.unset("spark.sql.files.openCostInBytes")
    assert got == {i + 1: i for i in range(2000)}


def test_questions(spark, tmp_path):
    path = write_lines(tmp_path / "q.jsonl", [QUESTIONS[0], "", "not json", "[1]", '{"a": 1, "a": 2}', *QUESTIONS[1:]])
    good, bad = records.questions(spark, path)
    got = {r.question_id: r for r in good.collect()}
    assert {k: r.answer_index for k, r in got.items()} == {"q1": 1, "q2": 2, "q3": 1}
    assert [o.label for o in got["q1"].options] == ["B", "A"] and [o.label for o in got["q2"].options] == ["A", "B", "C"]
    assert got["q1"].relevant == ["d1"] and got["q2"].relevant == []
    assert {r.line: r.reason for r in bad.collect()} == {
        3: "invalid JSON", 4: "not an object", 5: "invalid JSON", 8: "question must be a nonblank string", 9: "at least two options", 10: "answer is no option", 11: "answer is no option", 12: "duplicate question id", 13: "duplicate question id",
    }


def test_evidence(spark, tmp_path):
    base = {"schema_version": "2.0", "question_id": "q1", "doc_id": "d1", "rank": 1, "text": "t", "source": "s", "evidence_type": "other", "retrieval_score": -1.5, "annotated_stances": {"A": "SUPPORT"}}
    rows = [base, base | {"doc_id": "d2", "rank": 0}, base | {"doc_id": "d3", "rank": 3, "retrieval_score": "1"}, base | {"doc_id": "d4", "rank": 4, "schema_version": "1"}, base | {"doc_id": "d5", "rank": 5}, base | {"doc_id": "d5", "rank": 6}, base | {"doc_id": "d7", "rank": 7, "text": " "}]
    good, bad = records.evidence(spark, write_lines(tmp_path / "e.jsonl", rows))
    assert [(r.doc_id, r.stances) for r in good.collect()] == [("d1", {"A": "SUPPORT"})]
    assert [r.reason for r in bad.orderBy("line").collect()] == ["rank must be 1 or more", "retrieval_score must be finite", "schema_version", "duplicate document", "duplicate document", "blank field"]


def test_first_lines_do_not_refill(spark, tmp_path):
    good, bad = records.first_lines(spark, write_lines(tmp_path / "f.jsonl", ['{"a":1}', "", "bad", '{"a":2}', '{"a":3}']), 3)
    assert good.count() == 2 and [r.line for r in bad.collect()] == [3]


def test_joins_that_check(spark):
    a = spark.createDataFrame([("k", "x"), ("m", "y")], "key string, v string")
    got = {r.key: r.v for r in records.prefer(a, spark.createDataFrame([("k", "x"), ("n", "z")], "key string, v string"), ["key"], "v").collect()}
    assert got == {"k": "x", "m": "y", "n": "z"}
    with pytest.raises(Exception, match="conflict"):
        records.prefer(a, spark.createDataFrame([("k", "other")], "key string, v string"), ["key"], "v").collect()
    with pytest.raises(Exception, match="duplicate key"):
        records.union_checked([a, a.limit(1)], ["key"]).collect()
    with pytest.raises(ValueError, match="columns"):
        records.exactly(a, ["key"])


def test_overrides(spark, tmp_path):
    (tmp_path / "o.json").write_text('{"q1": "a AND b", "q2": "c"}')
    assert {r.question_id: r.query for r in records.overrides(spark, str(tmp_path / "o.json")).collect()} == {"q1": "a AND b", "q2": "c"}
    (tmp_path / "p.json").write_text('{"q1": "a", "q1": "b"}')
    with pytest.raises(Exception):
        records.overrides(spark, str(tmp_path / "p.json")).collect()


ARTICLE = """<PubmedArticleSet><PubmedArticle><MedlineCitation><PMID>1</PMID><Article><Journal><Title>J</Title><JournalIssue><PubDate><Year>2020</Year><Month>May</Month></PubDate></JournalIssue></Journal>
<ArticleTitle>A <i>b</i>
 c</ArticleTitle><Abstract><AbstractText Label="AIM">To  see</AbstractText><AbstractText>that <b>it</b> works</AbstractText></Abstract><AuthorList><Author><LastName>Doe</LastName></Author></AuthorList>
<PublicationTypeList><PublicationType>Review</PublicationType><PublicationType>Editorial</PublicationType></PublicationTypeList></Article><MeshHeadingList><MeshHeading><DescriptorName>Heart</DescriptorName></MeshHeading></MeshHeadingList></MedlineCitation></PubmedArticle>
<PubmedArticle><MedlineCitation><PMID>2</PMID><Article><Journal><JournalIssue><PubDate><MedlineDate>Spring 1999</MedlineDate></PubDate></JournalIssue></Journal><ArticleTitle>T</ArticleTitle></Article>
<OtherAbstract Language="fre"><AbstractText>non</AbstractText></OtherAbstract><OtherAbstract Language="eng"><AbstractText>other</AbstractText></OtherAbstract></MedlineCitation></PubmedArticle>
<PubmedArticle><MedlineCitation><PMID>3</PMID></MedlineCitation></PubmedArticle></PubmedArticleSet>"""


def test_articles(spark, tmp_path):
    (tmp_path / "a.xml").write_text(ARTICLE)
    got = {r.pmid: r for r in articles.articles(spark, str(tmp_path / "a.xml")).collect()}
    assert set(got) == {"1", "2"}
    assert (got["1"].title, got["1"].abstract, got["1"].publication_date) == ("A b c", "AIM: To see\nthat it works", "2020-May")
    assert got["1"].publication_types == ["Review", "Editorial"] and got["1"].mesh_headings == ["Heart"] and got["1"].authors == ["Doe"]
    assert (got["2"].abstract, got["2"].abstract_source, got["2"].publication_date) == ("other", "other_abstract", "Spring 1999")


def test_a_large_article_file_is_read_in_splits(spark, tmp_path):
    one = lambda k: f"<PubmedArticle><MedlineCitation><PMID>{k}</PMID><Article><ArticleTitle>Title {k} é</ArticleTitle></Article></MedlineCitation></PubmedArticle>"
    (tmp_path / "many.xml").write_text('<?xml version="1.0"?>\n<!DOCTYPE PubmedArticleSet PUBLIC "x" "y">\n<PubmedArticleSet>\n' + "\n".join(map(one, range(400))) + "\n</PubmedArticleSet>\n")
    (tmp_path / "none.xml").write_text("<PubmedArticleSet></PubmedArticleSet>")
    names = ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")
    before = [spark.conf.get(n) for n in names]
    try:
        spark.conf.set(names[0], "3000")
        spark.conf.set(names[1], "1")
        got = articles.article_xml(spark, str(tmp_path))
        assert got.rdd.getNumPartitions() > 10
        assert sorted(int(r.pmid) for r in articles.articles(spark, str(tmp_path)).collect()) == list(range(400))
    finally:
        [spark.conf.set(n, b) for n, b in zip(names, before)]


@pytest.mark.parametrize("text, fault", [
    ("<eFetchResult><ERROR>no</ERROR></eFetchResult>", "reports an error"), ("<html><body>x</body></html>", "root is not"), ("<PubmedArticleSet><PubmedArticle><PMID>1</PMID></PubmedArticleSet>", "does not end"), ("plain words", "root is not"),
])
def test_article_files_that_are_none(spark, tmp_path, text, fault):
    (tmp_path / "a.xml").write_text(text)
    with pytest.raises(Exception, match=fault):
        articles.article_xml(spark, str(tmp_path / "a.xml")).collect()


def test_archives(spark, tmp_path):
    body = archive.write_archive({"a.txt": b"one", "b/c.txt": b"two"})
    assert body == archive.write_archive({"b/c.txt": b"two", "a.txt": b"one"})
    (tmp_path / "x.zip").write_bytes(body)
    assert {(r.member, bytes(r.content)) for r in archive.archive_members(spark, str(tmp_path / "x.zip")).collect()} == {("a.txt", b"one"), ("b/c.txt", b"two")}
    assert not any(map(archive.safe_member, ["/a", "../a", "a//b", "c:a", "a\\b", ""])) and archive.safe_member("a/b")
    with pytest.raises(ValueError):
        archive.verified_members(body.replace(b"one", b"two") if b"one" in body else body[:-30])


def test_weights():
    text = "top_k: 3\nevidence_type_weights:\n  a: 1.0  # best\n  b: 0.5\nother: 1\n"
    assert archive.yaml_weights(text, ["a", "b"]) == {"a": 1.0, "b": 0.5}
    with pytest.raises(ValueError):
        archive.yaml_weights(text, ["a", "b", "c"])


def test_calls(spark):
    def backend():
        seen = {}

        def call(request):
            seen[request] = seen.get(request, 0) + 1
            if request == "bad":
                raise ValueError("no")
            if request == "busy" and seen[request] < 3:
                raise connectors.Retryable("busy", "0")
            if request == "down":
                raise connectors.Retryable("down")
            return request.upper()

        return call

    requests = spark.createDataFrame([(r, r) for r in ("ok", "busy", "bad", "down", "old", "ok")], "cache_key string, request string")
    cache = spark.createDataFrame([("old", "old", "kept", "VALID", 1, None)], connectors.AUDIT)
    every, fresh = connectors.cached_calls(requests, cache, backend, pause=0.0, sleep=lambda s: None)
    got = {r.cache_key: (r.status, r.response, r.attempts) for r in every.collect()}
    assert got == {"ok": ("VALID", "OK", 1), "busy": ("VALID", "BUSY", 3), "bad": ("FAILED", None, 1), "down": ("FAILED", None, 3), "old": ("VALID", "kept", 1)}
    assert connectors.retry_delay(1) == 2 and connectors.retry_delay(9) == 30 and connectors.retry_delay(1, "7") == 7
    assert connectors.retry_delay(1, "Thu, 01 Jan 1970 00:01:00 GMT", now=0) == 60 and connectors.retry_delay(1, "soon") == 2


def test_each_request_is_called_once(spark, tmp_path):
    log = tmp_path / "calls"

    def backend():
        def call(request):
            with open(log, "a") as f:
                f.write(request + "\n")
            return request * 2

        return call

    requests = spark.createDataFrame([(r, r) for r in ("a", "b", "c", "a", "forged", "old")], "cache_key string, request string")
    cache = connectors.sealed(spark.createDataFrame([("old", "old", "kept", "VALID", 1, None), ("forged", "forged", "x", "VALID", 1, None)], connectors.AUDIT))
    cache = cache.withColumn("response", F.when(F.col("cache_key") == "forged", "y").otherwise(F.col("response")))
    every, fresh = connectors.cached_calls(requests, cache, backend, pause=0.0)
    for _ in range(2):
        assert {r.cache_key: r.response for r in every.collect()} == {"a": "aa", "b": "bb", "c": "cc", "forged": "forgedforged", "old": "kept"}
        assert fresh.count() == 4
    assert sorted(log.read_text().split()) == ["a", "b", "c", "forged"]
    again, none = connectors.cached_calls(requests, cache.filter("cache_key = 'old'").unionByName(fresh), backend, pause=0.0)
    assert again.count() == 5 and none.count() == 0 and len(log.read_text().split()) == 4
    good, why = connectors.reusable(every, F.length("request") > 1)
    assert {r.cache_key for r in good.collect()} == {"forged", "old"} and [tuple(r) for r in why.collect()] == [("CONDITIONS", 3)]


def test_writers(spark, tmp_path):
    df = spark.createDataFrame([(1, 'a "b", c', None), (2, "x\ny", 0.5)], "k int, t string, v double")
    sinks.write_csv_checked(df, str(tmp_path / "csv"))
    with pytest.raises(Exception):
        sinks.write_csv_checked(df, str(tmp_path / "csv"))
    sinks.write_json_lines(df, str(tmp_path / "json"), ["k"])
    assert spark.read.json(str(tmp_path / "json")).count() == 2
    assert sinks.markdown(df.limit(1), "T").startswith("## T\n\n| k | t | v |")


def test_attempt_stream(spark, tmp_path):
    at = datetime.datetime(2024, 1, 1)
    rows = [("a", 1, 1, False, None, at), ("a", 1, 2, True, "r", at), ("b", 1, 1, False, None, at), ("b", 1, 2, False, None, at), ("b", 1, 3, False, None, at)]
    source, table, mark = (str(tmp_path / x) for x in ("in", "table", "mark"))
    spark.createDataFrame(rows, collect.ATTEMPT).write.parquet(source)
    collect.collect(collect.attempts_stream(spark, source), table, mark).awaitTermination(60)
    spark.createDataFrame([rows[0], ("b", 2, 1, True, "late", at)], collect.ATTEMPT).write.mode("append").parquet(source)
    collect.collect(collect.attempts_stream(spark, source), table, mark).awaitTermination(60)
    assert collect.collected(spark, table).count() == 6
    assert {r.cache_key: (r.status, r.attempts) for r in collect.states(spark, table).collect()} == {"a": ("VALID", 2), "b": ("VALID", 1)}
    windows = collect.outcome_counts(collect.attempts_stream(spark, source))
    assert windows.isStreaming
