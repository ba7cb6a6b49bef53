"""Collocations against plain counting of all sequences."""

import random
import re
from collections import Counter

import numpy as np
import pytest

from quorumlake.llm import collocations as C

DOCS = "text string, lang string, doc_id long, key string, k int, a long, n double"


def plain(rows, least, most):
    f, n = {}, Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        for piece in re.split("[.,;:!?\x0a-\x0d]", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")):
            w = [x for x in re.split("[\x20\x09]+", piece) if x]
            n[lang] += len(w)
            for k in range(1, 6):
                f.setdefault(lang, Counter()).update(tuple(w[i : i + k]) for i in range(len(w) - k + 1))
    out = []
    for lang, c in f.items():
        found = {p: a for p, a in c.items() if len(p) > 1 and a >= least}
        inside = {p[i : i + k] for p, a in found.items() for k in range(2, len(p)) for i in range(len(p) - k + 1) if 100 * a >= 100 * found[p[i : i + k]]}
        each = []
        for p, a in found.items():
            if p not in inside:
                score, k = min((1000 * a * n[lang] // (c[p[:k]] * c[p[k:]]), k) for k in range(1, len(p)))
                each.append((-score, -a, " ".join(p).encode(), c[p[:k]], c[p[k:]]))
        out += [(lang, r, p.decode(), -a, left, right, n[lang], -s) for r, (s, a, p, left, right) in enumerate(sorted(each)[:most], 1)]
    return sorted(out)


def found(spark, rows, least=3, most=50, parts=3):
    docs = spark.createDataFrame([(*r, i % 7, "x", 1, 2, 0.5) for i, r in enumerate(rows)], DOCS).repartition(parts)
    return sorted(tuple(r) for r in C.collocations(docs, least=least, most=most).collect())


@pytest.fixture(scope="module")
def rows():
    r = random.Random(8)
    vocabulary = ["the", "The", "of", "Über", "über", "a", "b", "c", "中文", "x" * 400, "x" * 399 + "y", "night\x0e", "end"]
    text = lambda n: "".join(r.choice(vocabulary) + r.choice([" ", " ", "\t ", ". ", ",", "\n", "  "]) for _ in range(n))
    made = [(text(r.randint(0, 60)), r.choice(["en", "de", None, "", "und"])) for _ in range(120)]
    return [*made, (None, "en"), ("", "en"), (None, None), ("same words again and again " * 300, "en"), *[("one passage that is copied", "fr")] * 80, *[("one passage that is copied", "fr")] * 3, ("new york " * 5 + "only new here", "es")]


def test_against_counting(spark, rows):
    assert found(spark, rows) == plain(rows, 3, 50)


def test_small_chunks_and_ranges(spark, rows, monkeypatch):
    """Keys of many chunks, runs across ranges, and counters that are emptied often."""
    monkeypatch.setattr(C, "CHUNK", 2048)
    monkeypatch.setattr(C, "HELD", 5)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "17")
    try:
        assert found(spark, rows, 2, 10) == plain(rows, 2, 10)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_ids_are_proven(spark, monkeypatch):
    """Where the first seed gives words of two languages one id, the next is taken."""
    rows = [("new york is new york in new york", "en"), ("new york ist new york", "de")] * 3
    right = C.lang_seed
    monkeypatch.setattr(C, "lang_seed", lambda lang, seed: 0 if seed == 0 else right(lang, seed))
    assert found(spark, rows) == plain(rows, 3, 50)
    words = spark.createDataFrame([(x, lang) for x, lang in rows], "text string, lang string")
    assert C.dictionary(words, 3)[2] == 1


def test_full_filter(spark, rows, monkeypatch):
    """Filters that let every word and pair pass change no count."""
    monkeypatch.setattr(C, "bit_filter", lambda ids: np.full(4, -1, np.int64).view(np.uint64))
    assert found(spark, rows) == plain(rows, 3, 50)


def test_products_beyond_64_bits(spark):
    words = spark.createDataFrame([(bytearray(b"\0" * 7 + b"\1"), 9 * 10**12, "en", 4 * 10**15), (bytearray(b"\0" * 7 + b"\2"), 7 * 10**12, "en", 4 * 10**15)], "key binary, f long, lang string, n long")
    phrases = spark.createDataFrame([(2, bytearray(b"\0" * 7 + b"\1" + b"\0" * 7 + b"\2"), 6 * 10**12)], "k int, key binary, a long")
    assert C.scored(phrases, words).first().score == 1000 * 6 * 10**12 * 4 * 10**15 // (9 * 10**12 * 7 * 10**12)


def test_empty(spark):
    assert found(spark, []) == [] and found(spark, [(None, None), ("", "en"), ("once", "en")]) == []
