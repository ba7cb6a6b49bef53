"""Saved replies as a data source, whole results from pages, the negative cache and the composed retriever."""

import json

import pytest
from pyspark.sql import functions as F

from quorumlake.operators import searching
from quorumlake.sources import replies as R


def page(query, start, ids, total, **more):
    return {"query": query, "retstart": start, "reply": json.dumps({"esearchresult": {"count": str(total), "retstart": str(start), "idlist": [str(x) for x in ids], **more}})}


PAGES = [
    page("a", 0, range(100, 120), 45), page("a", 20, range(120, 140), 45), page("a", 40, range(140, 145), 45), page("a", 20, range(120, 140), 45),
    page("ü b", 0, [], 0), page("c", 0, [1, 2], 5), page("c", 3, [4, 5], 5), page("d", 0, [1], 2), page("d", 1, [2], 3), page("e", 0, [1], 1, ERROR="busy"), page("f", 0, ["x1"], 1),
    {"query": "g", "retstart": 0, "reply": "<html>"}, {"query": "h", "reply": json.dumps({"esearchresult": {"count": 3, "idlist": []}})}, page("i", 0, [7], 1),
]


@pytest.fixture(scope="module")
def pages(tmp_path_factory):
    at = tmp_path_factory.mktemp("pages")
    lines = [json.dumps(p, ensure_ascii=False) for p in PAGES]
    (at / "one.jsonl").write_text("\n".join(lines[:9]) + "\n")
    (at / "two.jsonl").write_text("\n\n".join([*lines[9:], "{broken", "[1]"]))
    (at / "_SUCCESS").write_text("not a reply")
    return str(at)


@pytest.mark.parametrize("size", [61, 500, 1 << 20])
def test_every_line_is_read_once(spark, pages, size):
    got = R.saved_replies(spark, pages, "search", size)
    want = [r for p in PAGES for r in R.search_rows(p)]
    rows = sorted((tuple(r) for r in got.collect() if r.error is None or not r.error.startswith("line at")), key=str)
    assert rows == sorted(want, key=str) and got.filter("error LIKE 'line at %'").count() == 2
    assert size > 500 or got.rdd.getNumPartitions() > 4


def test_filters_reach_the_source(spark, pages):
    got = R.saved_replies(spark, pages, "search")
    some = got.filter(F.col("query").isin("a", "i") & (F.col("position") < 2))
    assert sorted((r.query, r.pmid) for r in some.collect()) == [("a", "100"), ("a", "101"), ("i", "7")]
    reader = R.RepliesReader("search", pages, 1 << 20)
    from pyspark.sql.datasource import EqualTo, GreaterThan, In

    left = list(reader.pushFilters([In(("query",), ("a", "b")), GreaterThan(("position",), 3), EqualTo(("query",), "a")]))
    assert left == [GreaterThan(("position",), 3)] and reader.only == {"a"}


def test_whole_results(spark, pages):
    got = {r.query: (r.status, r.total, r.ids) for r in R.whole_results(R.saved_replies(spark, pages, "search").filter("query IS NOT NULL")).collect()}
    assert got["a"] == ("OK", 45, [str(x) for x in range(100, 145)]) and got["ü b"] == ("OK", 0, []) and got["i"] == ("OK", 1, ["7"])
    assert {k: v[0] for k, v in got.items() if v[0] != "OK"} == {"c": "TORN", "d": "MOVED", "e": "FAILED", "f": "FAILED", "g": "FAILED", "h": "FAILED"}


def test_fetches_and_absences(spark, tmp_path):
    record = lambda i, n=1: f"<PubmedArticle><MedlineCitation><PMID Version=\"1\">{i}</PMID><T>{'x' * n}</T></MedlineCitation></PubmedArticle>"
    whole = lambda *rs: "<PubmedArticleSet>" + "".join(rs) + "</PubmedArticleSet>"
    lines = [{"ids": ["1", "2", "1"], "reply": whole(record(1), record(99))}, {"ids": [1], "reply": whole(record(1, 5))}, {"ids": ["3"], "reply": whole(record(3))[:40]}, {"ids": ["4"], "reply": None}, {"ids": ["3"], "reply": whole()}]
    (tmp_path / "f.jsonl").write_text("\n".join(map(json.dumps, lines)))
    rows = R.saved_replies(spark, str(tmp_path), "fetch")
    assert sorted(((r.pmid, r.found, r.error) for r in rows.collect()), key=str) == [("1", True, None), ("1", True, None), ("2", False, None), ("3", False, "no complete reply"), ("3", False, None), ("4", False, "no complete reply")]
    best, gone = R.settled_fetches(rows, "2026-01-01 00:00:00")
    assert [(r.pmid, len(r.raw)) for r in best.collect()] == [("1", len(record(1, 5)))] and sorted(r.pmid for r in gone.collect()) == ["2", "3"]
    wanted = spark.createDataFrame([("1",), ("2",), ("3",), ("5",), ("5",), (None,)], "pmid string")
    later = lambda now: sorted(r.pmid for r in R.still_to_fetch(wanted, best, gone, now).collect())
    assert later("2026-01-15 00:00:00") == ["5"] and later("2026-02-15 00:00:00") == ["2", "3", "5"]


def test_retrieve_searches_each_query_once(spark, tmp_path):
    q = spark.createDataFrame([(1, "m", "x", "y"), (2, " ", "x", "y"), (3, None, None, "x"), (4, None, "", " "), (5, None, None, "none"), (6, None, None, "broken")], "question_id int, manual string, model string, keyword string")
    log = str(tmp_path / "log")

    def look(batches):
        import pyarrow as pa

        known = {"m": ["9", "8", "9", "7"], "x": ["1", "2", "3"], "none": [], "broken": None}
        for b in batches:
            for x in b.column("query").to_pylist():
                with open(log, "a") as f:
                    f.write(x + "\n")
            yield pa.RecordBatch.from_arrays([b.column("query"), pa.array([known[x] for x in b.column("query").to_pylist()], pa.list_(pa.string()))], ["query", "ids"])

    records = spark.createDataFrame([("9", "nine"), ("7", "seven"), ("1", "one"), ("2", "two")], "pmid string, title string")
    evidence, report = searching.retrieve(q, lambda distinct: distinct.mapInArrow(look, "query string, ids array<string>"), records, 3)
    assert sorted((r.question_id, r.doc_rank, r.title) for r in evidence.collect()) == [(1, 1, "nine"), (1, 3, "seven"), (2, 1, "one"), (2, 2, "two"), (3, 1, "one"), (3, 2, "two")]
    got = {r.question_id: (r.source, r.returned, r.distinct_ids, r.asked, r.found, r.missing, r.status) for r in report.collect()}
    assert got == {1: ("manual", 4, 3, 3, 2, 1, "INCOMPLETE"), 2: ("model", 3, 3, 3, 2, 1, "INCOMPLETE"), 3: ("keyword", 3, 3, 3, 2, 1, "INCOMPLETE"), 4: (None, 0, 0, 0, 0, 0, "NO_QUERY"), 5: ("keyword", 0, 0, 0, 0, 0, "EMPTY"), 6: ("keyword", 0, 0, 0, 0, 0, "SEARCH_FAILED")}
    assert report.count() == 6 and sorted(open(log).read().split()) == ["broken", "m", "none", "x"]
