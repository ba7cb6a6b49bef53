"""Decontamination against a brute-force search, with edge cases."""

import hashlib
import random
import re

import pytest

from quorumlake.llm import decontam
from quorumlake.llm.decontam import decontaminate, phrase_matches

SEP = re.compile(r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(t):
    low = (t or "").translate({i: i + 32 for i in range(65, 91)})
    return [w for w in SEP.split(low) if w]


def brute(docs, items, n):
    wins = set()
    for item, t in items:
        w = words(t)
        wins |= {(str(item), tuple(w[i : i + n])) for i in range(max(1, len(w) - n + 1)) if w}
    out = []
    for i, t in docs:
        w, hit, names = words(t), set(), set()
        for item, win in wins:
            for s in range(len(w) - len(win) + 1):
                if tuple(w[s : s + len(win)]) == win:
                    hit |= set(range(s, s + len(win)))
                    names.add(item)
        out.append((i, len(w), len(hit), len(names), hashlib.sha256(",".join(sorted(names)).encode()).hexdigest(), bool(hit)))
    return out


@pytest.mark.parametrize("bits, hot", [(18, 1000), (1, 1000), (18, 10**7)])
def test_equals_brute_force(spark, docs_of, monkeypatch, bits, hot):
    # A filter whose bits are all set, and every term dealt over many tasks, change nothing.
    monkeypatch.setattr(decontam, "SLOT_BITS", bits)
    monkeypatch.setattr(decontam, "HOT", hot if hot < 10**7 else 20)
    r = random.Random(5)
    vocab = ["a", "b", "É", "é", "c3", "D", "日本"]
    text = lambda k: r.choice([" ", ", ", "\n"]).join(r.choice(vocab) for _ in range(k))
    items = [(i, text(r.randint(1, 9))) for i in range(12)] + [(50, None), (51, ""), (52, "..."), (1, "a b"), (53, "b b b b b b")]
    docs = [(i, text(r.randint(0, 60))) for i in range(120)] + [(200, None), (201, ""), (202, "!?"), (3, "b b b b b b b"), (7, "same a b"), (7, "same a b"), (None, "a b a b"), (203, "a b " * 4000)]
    bench = spark.createDataFrame([(i, t, 1, "q") for i, t in items], "item_id long, text string, pos int, term string")
    got = decontaminate(docs_of(docs), bench, n=4).drop("h").collect()
    key = lambda x: (x[0] is None, x[0] or 0, x[1:])
    assert sorted(map(tuple, got), key=key) == sorted(brute(docs, items, 4), key=key)


def test_proximity(spark, docs_of):
    bench = spark.createDataFrame([(1, "red green blue white")], "item_id long, text string")
    docs = docs_of([(1, "x red green blue white y"), (2, "white red odd green blue"), (3, "red " + "z " * 40 + "green blue white")])
    got = {(r.doc_id if "doc_id" in r else r.id, r.exact) for r in phrase_matches(docs, bench, n=10, slack=2).collect()}
    assert got == {(1, True), (2, False)}


def test_lists_are_intersected(spark, docs_of):
    """Only starts at which both of a window's rarest terms stand are candidates."""
    bench = spark.createDataFrame([(1, "red green blue"), (2, "solo"), (3, "red red")], "item_id long, text string")
    docs = docs_of([(1, "red green blue"), (2, "red x blue green"), (3, "blue blue green red"), (4, "solo red"), (5, "red red red")])
    wins = decontam.anchored(decontam.windows_of(bench, "item_id", "text", 10), decontam.term_counts(docs, "text", spark.createDataFrame([(w,) for w in ("red", "green", "blue", "solo")], "term string")))
    terms = wins.select("term").union(wins.select("term2")).filter("term IS NOT NULL").distinct()
    index = decontam.postings(docs, terms, "doc_id", "text", 9)
    name = {r.wid: " ".join(r.win) for r in wins.collect()}
    got = sorted((r.id, r.start, name[r.wid]) for r in decontam.intersected(index, wins).collect())
    assert got == [(1, 0, "red green blue"), (2, 0, "red green blue"), (4, 0, "solo"), (5, 0, "red red"), (5, 1, "red red")] or got == [(1, 0, "red green blue"), (4, 0, "solo"), (5, 0, "red red"), (5, 1, "red red")]
    found = sorted((r.id, r.start, r.length) for r in phrase_matches(docs, bench, n=10).collect())
    assert found == [(1, 0, 3), (4, 0, 1), (5, 0, 2), (5, 1, 2)]


def test_empty_tables(spark, docs_of):
    bench = spark.createDataFrame([(1, "a b c")], "item_id long, text string")
    assert decontaminate(docs_of([]), bench).count() == 0
    got = decontaminate(docs_of([(1, "a b c")]), bench.limit(0)).first()
    assert (got.n_words, got.n_hit, got.contaminated) == (3, 0, False)


def test_no_document_crosses_the_network(spark, docs_of):
    bench = spark.createDataFrame([(1, "red green blue white")], "item_id long, text string")
    plan = decontam.postings(docs_of([(1, "red green")]), bench.selectExpr("text AS term"), "doc_id", "text", 9)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "ArrowEval" not in plan
    assert all("words" not in line for line in plan.split("\n") if "Exchange" in line)
