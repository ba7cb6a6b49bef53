"""Language identification against the kernel written out with sets, and on invented languages it has not seen."""

import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from quorumlake.llm import langid as L

DOCS = "doc_id long, text string, lang string, source string, held_out int, score string, _text string"
SYLLABLES = {"en": "th er on an re he in ed nd ha", "de": "sch ein ich der und ung ge ver zu ü", "fr": "le la que ou ai eau ent é è un", "xx": "κα λο με τη νο ρι σα το"}


def text(r, lang, n):
    return " ".join("".join(r.choice(SYLLABLES[lang].split()) for _ in range(r.randint(1, 4))) for _ in range(n))


def grams_of(t, n):
    raw = bytes(c if c >= 128 or chr(c).isalpha() else 32 for c in t.lower().encode())
    return {raw[i : i + n] for i in range(len(raw) - n + 1)}


def kernel(x, y, words):
    """Common n-grams over the geometric mean of how many each has, summed over lengths, n-grams of the vocabulary only."""
    k = 0.0
    for n, known in zip(L.GRAMS, words):
        a, b = grams_of(x, n) & known, grams_of(y, n) & known
        k += len(a & b) / np.sqrt(max(len(a), 1) * max(len(b), 1))
    return k


def test_against_the_kernel_written_out():
    r = random.Random(1)
    langs = [r.choice(["en", "de", "fr"]) for _ in range(60)]
    texts = [text(r, x, r.randint(3, 60)) + r.choice(["", " 123 #!", " ÄÉ", "\0\0"]) for x in langs]
    new = [text(r, x, 20) for x in ("en", "de", "fr", "xx")] + ["", "a", "12345", "ß" * 9]
    model = L.train(texts, langs, landmarks=25, width=150)
    words = [{int(c).to_bytes(n, "little") for c in codes} for n, codes in zip(L.GRAMS, model.grams)]
    for n, known in zip(L.GRAMS, words):
        times = {}
        for t in texts[:25]:
            for g in grams_of(t, n):
                times[g] = times.get(g, 0) + 1
        at_least = sorted((times[g] for g in known), reverse=True)[-1]
        assert len(known) <= 150 and at_least >= 2 and all(g in known for g, c in times.items() if c > at_least)
    marks = texts[:25]
    k_ll = np.array([[kernel(a, b, words) for b in marks] for a in marks])
    values, vectors = np.linalg.eigh(k_ll)
    good = values > L.LEAST_EIGEN * values.max()
    to = vectors[:, good] / np.sqrt(values[good])
    phi = np.array([[kernel(a, b, words) for b in marks] for a in texts]) @ to
    y = np.array([[1.0 if x == c else -1.0 for c in model.langs] for x in langs])
    z = phi - phi.mean(axis=0)
    w = np.linalg.solve(z.T @ z + L.RIDGE * len(texts) * np.eye(z.shape[1]), z.T @ (y - y.mean(axis=0)))
    want = (np.array([[kernel(a, b, words) for b in marks] for a in new]) @ to - phi.mean(axis=0)) @ w + y.mean(axis=0)
    got = L.presence(new, model.grams, model.tables()) @ model.weights[:-1] + model.weights[-1]
    assert got == pytest.approx(want, abs=2e-3)


def test_parts_have_what_the_text_has(monkeypatch):
    r = random.Random(2)
    texts = [text(r, r.choice(list(SYLLABLES)), n) for n in (0, 1, 5, 400, 3000)]
    model = L.train(texts, ["a", "b", "a", "b", "a"], landmarks=5)
    want = L.presence(texts, model.grams, model.tables())
    for limit in (4, 7, 64, 1000):
        monkeypatch.setattr(L, "CHUNK", limit)
        assert np.array_equal(L.presence(texts, model.grams, model.tables()), want)


@pytest.fixture(scope="module")
def rows():
    r = random.Random(3)
    made = [(i, text(r, x, r.randint(15, 80)), x) for i in range(600) for x in [r.choice(list(SYLLABLES))]]
    long = " ".join(text(r, "de", 40_000) for _ in range(2))
    return [*made, (1000, None, "en"), (1001, "", "en"), (1002, " 12 #\n", "de"), (1003, long, "de"), (1004, text(r, "fr", 30), None), (None, text(r, "en", 30), "zz"), (1005, "日本語", "en"), (5, made[5][1], made[5][2])]


def run(spark, rows, **more):
    docs = spark.createDataFrame([(*x, "s", 1, "y", "z") for x in rows], DOCS).repartition(3)
    return docs, L.languages(docs, **more)


def test_held_out_languages(spark, rows):
    docs, out = run(spark, rows)
    got = sorted(((r.doc_id, r.held_out, r.lang_pred, r.score) for r in out.collect()), key=str)
    want = {i: lang for i, _, lang in rows}
    assert out.columns == ["doc_id", "held_out", "lang_pred", "score"] and len(got) == len(rows)
    assert all(h == (i is not None and zlib.crc32(str(i).encode()) % 4 == 2) for i, h, _, _ in got)
    assert all(0 <= s <= 1 for _, _, _, s in got)
    assert [x for x in got if x[0] in (1000, 1001, 1002)] == [(i, zlib.crc32(str(i).encode()) % 4 == 2, "und", 0.0) for i in (1000, 1001, 1002)]
    told = {i: p for i, _, p, _ in got}
    assert told[1003] == "de" and told[1004] == "fr" and told[None] == "en" and told[1005] in SYLLABLES
    held = [(p, want[i]) for i, h, p, _ in got if h and i is not None and i < 1000]
    assert len(held) > 100 and sum(p == w for p, w in held) >= 0.99 * len(held)


def test_the_answer_comes_from_the_text_alone(spark, rows):
    """Held-out labels, other languages' names and ids do not change a prediction."""
    docs, out = run(spark, rows)
    other = docs.withColumn("lang", F.when(L.fold("doc_id", 4) == 2, "wrong").otherwise(F.col("lang")))
    a, b = (sorted(((r.doc_id, r.lang_pred, r.score) for r in x.collect()), key=str) for x in (out, L.languages(other)))
    assert a == b


def test_bounded_and_empty(spark, rows):
    docs, _ = run(spark, rows)
    model = L.fit(docs, order=F.xxhash64("doc_id"), each=2, sample=5)
    assert len(model.langs) <= 5
    assert L.languages(docs.limit(0)).count() == 0
    none = L.languages(docs.withColumn("lang", F.lit(None).cast("string")))
    assert {(r.lang_pred, r.score) for r in none.collect()} == {("und", 0.0)}
    one = L.languages(docs.filter("lang = 'de'"))
    assert {r.lang_pred for r in one.filter("doc_id < 1000").collect()} == {"de"}
