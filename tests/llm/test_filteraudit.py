"""The filter audit against a plain computation that walks through every order."""

import random
import re
from itertools import permutations

import numpy as np
import pyarrow as pa
import pytest

from quorumlake.llm import bytescan, filteraudit

DOCS = "doc_id long, text string, lang string, part string, mask int, n long, good string, _sha string"
LABELS = "doc_id long, quality int, toxic int, part string"


def fails(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    found = {"A": len(words) < 200, "B": 100 * len(set(words)) < 50 * len(words), "C": 100 * len(re.findall("[A-Z]", text)) > 3 * len(text), "D": bool(re.search(r"[#$%&*|]", text))}
    return {k for k, v in found.items() if v}


def plain(docs, labels):
    """Rows of the audit by walking every document through every order."""
    least = {}
    for i, t, _ in docs:
        if i is not None:
            least[t or ""] = min(i, least.get(t or "", i))
    rows = {}
    for i, t, lang in docs:
        bad, first = fails(t or ""), least.get(t or "")
        if first is not None and i != first:
            bad.add("E")
        mine = [x for x in labels if i is not None and x[0] == i]
        good, toxic = any(x[1] == 1 for x in mine), any(x[2] == 1 for x in mine)
        for order in permutations("ABCDE"):
            out = False
            for k, f in enumerate(order, 1):
                r = rows.setdefault((lang or "", "".join(order), k), [0] * 6)
                r[1] += f in bad and not out
                r[2] += f in bad and out
                r[3] += bad == {f}
                r[4] += f in bad and not out and good
                r[5] += f in bad and not out and toxic
                out |= f in bad
                r[0] += not out
    shapley = {}
    for (part, order, k), r in rows.items():
        shapley[part, order[k - 1]] = shapley.get((part, order[k - 1]), 0) + r[1]
    return {(part, order, k): (*r, shapley[part, order[k - 1]]) for (part, order, k), r in rows.items()}


def audited(spark, docs, labels):
    d = spark.createDataFrame([(i, t, lang, "x", 1, 2, "y", "z") for i, t, lang in docs], DOCS).repartition(3)
    got = filteraudit.filter_audit(d, spark.createDataFrame([(*x, "q") for x in labels], LABELS))
    return {(r.part, r.filter_order, r.step): (r.kept, r.removed, r.redundant, r.unique_fails, r.good_lost, r.toxic_lost, r.shapley) for r in got.collect()}


def test_against_walking(spark):
    r = random.Random(5)
    word = lambda: "".join(r.choice("abcdeéß中") for _ in range(r.randint(1, 12)))
    texts = [" ".join(r.choice([word(), "AB", "the", "#1"] if r.random() < 0.3 else [word()]) for _ in range(r.choice([0, 3, 199, 200, 260]))) for _ in range(40)]
    texts += [None, "", "word " * 300, "\x0b\x0c \t", "X" * 300_000, " ".join(str(i) for i in range(50_000)), "É" * 10, "A" + "b" * 32, "AA" + "b" * 64]
    docs = [(i, r.choice(texts), r.choice(["en", "de", None, ""])) for i in range(150)]
    docs += [(None, texts[0], "en"), (None, "only without an id", "en"), (None, "only without an id", "en"), (7, "same id and text", "de"), (7, "same id and text", "de"), (7, "same id and text", "fr"), (3, "same id and text", "fr"), (3, "same id and text", "fr"), (2, "word " * 300, None)]
    labels = [(i, r.choice([0, 1, None]), r.choice([0, 1])) for i in range(0, 150, 2)] + [(7, 0, 1), (7, 1, 0), (None, 1, 1), (999, 1, 1)]
    assert audited(spark, docs, labels) == plain(docs, labels)


def test_empty_and_hot(spark):
    assert audited(spark, [], []) == {}
    docs = [(i, "copy of one text", "en") for i in range(500)] + [(1000 + i, None, None) for i in range(200)]
    assert audited(spark, docs, []) == plain(docs, [])


def test_distinct_words_survive_equal_hashes(monkeypatch):
    """With hashes that say nothing every neighbour is held against the words, and the counts stay."""
    r = random.Random(6)
    texts = ["".join(r.choice(["a", "b", "aa", "ba" * 200, "ba" * 199 + "bb", "abcdefgh", "abcdefghi", "abcdefghj"]) + r.choice(" \n\t") for _ in range(r.randint(0, 60))) for _ in range(80)]
    b, offsets = bytescan.text_buffer(pa.array([*texts, None, ""], pa.string()).slice(0))
    starts, ends = bytescan.word_spans(filteraudit.CLASSES[b[:-8]] & filteraudit.BLANK == 0, offsets)
    n = np.array([len(t.split()) for t in texts] + [0, 0])
    want = [len(set(t.split())) for t in texts] + [0, 0]
    assert filteraudit.distinct_words(b, starts, ends, n).tolist() == want
    monkeypatch.setattr(filteraudit, "word_hashes", lambda b, s, e: np.zeros(len(s), np.uint64))
    assert filteraudit.distinct_words(b, starts, ends, n).tolist() == want


@pytest.mark.parametrize("cut", [0, 1, 5])
def test_spans_do_not_cross_rows(cut):
    column = pa.array(["drop", "ab", "", "cd ef", None, " g", "h "], pa.string()).slice(min(cut, 1))
    b, offsets = bytescan.text_buffer(column)
    starts, ends = bytescan.word_spans(filteraudit.CLASSES[b[:-8]] & filteraudit.BLANK == 0, offsets)
    assert [b[s:e].tobytes().decode() for s, e in zip(starts, ends)] == (["drop"] if cut == 0 else []) + ["ab", "cd", "ef", "g", "h"]
