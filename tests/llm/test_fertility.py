"""Rejections by the fertility bands: long lists, short texts, languages without a band."""

import random

import numpy as np
import public_tokenizers as P
import pytest
import sentencepiece

from quorumlake.llm.fertility import BANDS, fit_bands, quality_rules

SYLLABLES = "th er on an re he in ed nd ha at en es of or nt ea ti to it st is ou ing ion tion ble wh sh ly".split()
SMALL = "the of and to in that is for with on as by this at an from it or be are".split()


def words(r, n):
    """Invented English: half small words, half syllables."""
    return [r.choice(SMALL) if r.random() < 0.4 else "".join(r.choice(SYLLABLES) for _ in range(r.randint(1, 4))) for _ in range(n)]


@pytest.fixture(scope="module")
def kept_of(spark):
    def run(rows):
        docs = spark.createDataFrame([(i, t, lang) for i, (t, lang) in enumerate(rows)], "doc_id long, text string, lang string")
        return [x.kept for x in sorted(quality_rules(docs, P.path("piece_bpe_32k.model")).collect(), key=lambda x: x.doc_id)]

    return run


def listed(r, n):
    return " | ".join("".join(r.choice(SYLLABLES) for _ in range(r.randint(2, 4))) for _ in range(n))


@pytest.mark.parametrize("n", [60, 150, 600, 2000])
def test_lists_of_any_length(kept_of, n):
    r = random.Random(n)
    assert kept_of([(listed(r, n), "en"), (" ".join(words(r, n)), "en")]) == [False, True]


def test_short_texts(kept_of):
    """A secret raises a short text's tokens per word over the limit of long texts; marks after all words raise it more."""
    r = random.Random(1)
    secret = " ".join([*words(r, 52), 'token = "49c25cfcc734f18e8b849c25cfcc734f18e8b8bbad1ecab5a43ebe9e8f8ce17ceff21e10f09c08"'])
    marked = " ".join(w + r.choice(["%%%", "&&&", "***", "$$$", "###"]) for w in words(r, 52))
    assert kept_of([(secret, "en"), (marked, "en")]) == [True, False]


def test_no_language(kept_of):
    """Latin letters without a known language: lists go; marks after all words go where no language is named."""
    r = random.Random(2)
    marked = " ".join(w + r.choice(["%%%", "&&&", "***", "$$$", "###"]) + r.choice(["", "##", "%&"]) for w in words(r, 300))
    good, greek = " ".join(words(r, 300)), " ".join(r.choice(["λόγος", "και", "η", "θάλασσα", "μέρα", "πολύ", "νερό"]) + r.choice("αεο") for _ in range(90))
    rows = [(listed(r, 300), None), (listed(r, 300), "xx"), (marked, None), (good, None), (good, "xx"), (greek, None)]
    assert kept_of(rows) == [False, False, False, True, True, True]


def test_fitted_bands(spark):
    """Medians and spreads of the labelled good documents alone; languages with too few keep what they had."""
    r = random.Random(3)
    rows = [(i, " ".join(words(r, r.randint(60, 300))), "qq" if i % 2 else "en") for i in range(160)] + [(200 + i, " ".join(words(r, 100)), "zz") for i in range(9)] + [(300 + i, listed(r, 100), "qq") for i in range(60)]
    rows += [(400, None, "qq"), (401, "", "qq"), (402, " ".join(words(r, 80)), None), (403, "too short", "qq")]
    labels = [(i, 1) for i in (*range(160), *range(200, 209), 400, 401, 402, 403, 999)] + [(300 + i, 0) for i in range(60)] + [(None, 1), (5, 1)]
    docs = spark.createDataFrame([(*x, 1, "x") for x in rows], "doc_id long, text string, lang string, n long, script string")
    label = spark.createDataFrame(labels, "doc_id long, quality int")
    path = P.path("piece_bpe_32k.model")
    got = fit_bands(docs, label, path)
    assert set(got) == {*BANDS, "qq"} and got["de"] == BANDS["de"]
    model = sentencepiece.SentencePieceProcessor(model_file=path)
    mine = [t for i, t, lang in rows[:160] if lang == "qq"]
    n = np.array([len(t.split()) for t in mine])
    cpt, tpw = (np.array(x) for x in zip(*[(len(t) / len(model.encode(t)), len(model.encode(t)) / len(t.split())) for t in mine]))
    assert (got["qq"].cpt, got["qq"].tpw) == pytest.approx((np.median(cpt), np.median(tpw)))
    assert (got["qq"].cpt_spread, got["qq"].tpw_spread) == pytest.approx(tuple(np.sqrt(np.mean((x - np.median(x)) ** 2 * n)) for x in (cpt, tpw)))
    assert got["qq"].script == "latin"
    kept = {x.doc_id: x.kept for x in quality_rules(docs, path, bands=got).collect()}
    assert all(kept[i] for i in range(160)) and not any(kept[300 + i] for i in range(60))
    assert fit_bands(docs, label.limit(0), path) == BANDS and fit_bands(docs.limit(0), label, path) == BANDS
    # The sample is bounded, and the bound decides which languages have enough.
    assert "qq" not in fit_bands(docs, label, path, most=60)


def test_odd_rows(spark):
    """Nulls, empty, repeated and very long texts, null ids, clashing columns."""
    r = random.Random(4)
    long = " ".join(words(r, 60000))
    rows = [(1, None, "en"), (2, "", None), (3, " \n\t", "en"), (None, " ".join(words(r, 90)), None), (4, "again and again " * 40, "en"), (4, "again and again " * 40, "en"), (5, long, "en")]
    docs = spark.createDataFrame([(*x, 7, "z", 0.5, True) for x in rows], "doc_id long, text string, lang string, id long, kept string, n_words double, base_failed boolean")
    got = sorted(((x.doc_id, x.n_words, x.base_failed, x.kept) for x in quality_rules(docs, P.path("piece_bpe_32k.model")).collect()), key=str)
    assert got == sorted([(1, 0, True, False), (2, 0, True, False), (3, 0, True, False), (None, 90, False, True), (4, 120, True, False), (4, 120, True, False), (5, 60000, False, True)], key=str)
    assert quality_rules(docs.limit(0), P.path("piece_bpe_32k.model")).count() == 0
