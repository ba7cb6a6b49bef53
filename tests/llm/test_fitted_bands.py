"""Bands are fitted on all labelled good documents, by exact quantiles that no task holds whole."""

import os
import random
import sys

import numpy as np
import public_tokenizers as P
import pytest
import sentencepiece

sys.path.insert(0, os.path.dirname(__file__))

from test_fertility import listed, words  # noqa: E402

from quorumlake.llm.fertility import fit_bands, quality_rules  # noqa: E402


def test_bands_of_all_good_documents(spark):
    """Over 4,000 labelled good documents: medians and spreads of all of them, and a language with just enough."""
    r = random.Random(5)
    lines = [" ".join(words(r, 12)) for _ in range(400)]
    rows = [(i, " ".join(r.sample(lines, 5 + i % 3)), "qq" if i % 90 == 0 else "en") for i in range(4500)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(4)
    got = fit_bands(docs, spark.createDataFrame([(i, 1) for i, *_ in rows], "doc_id long, quality int"), P.path("piece_bpe_32k.model"))
    model = sentencepiece.SentencePieceProcessor(model_file=P.path("piece_bpe_32k.model"))
    for lang in ("en", "qq"):
        mine = [t for _, t, x in rows if x == lang]
        n = np.array([len(t.split()) for t in mine])
        ids = [model.encode(t) for t in mine]
        assert len(mine) == (50 if lang == "qq" else 4450)
        for name, x in {"cpt": np.array([len(t) / len(i) for t, i in zip(mine, ids)]), "tpw": np.array([len(i) / k for k, i in zip(n, ids)])}.items():
            assert getattr(got[lang], name) == pytest.approx(np.median(x), rel=1e-9)
            assert getattr(got[lang], f"{name}_spread") == pytest.approx(np.sqrt(np.mean((x - np.median(x)) ** 2 * n)), rel=1e-9)
        bits = [-sum(c * np.log2(c) for c in np.unique(i, return_counts=True)[1] / len(i)) for i in ids]
        assert got[lang].entropy == pytest.approx(np.percentile(bits, 0.1) - 0.3, rel=1e-9)


def test_quantiles(spark):
    """Ties, one row, negative values and groups over several ranges, against numpy."""
    from quorumlake.llm.fertility import quantiles

    r = random.Random(8)
    sets = {"a": [float(r.randint(-3, 3)) for _ in range(701)], "b": [r.gauss(0, 9) for _ in range(500)], "c": [2.5], "d": [1.0] * 900, "e": [4.0, -1.0]}
    rows = [(k, x, -x) for k, v in sets.items() for x in v]
    r.shuffle(rows)
    got = {x.g: x for x in quantiles(spark.createDataFrame(rows, "g string, x double, y double").repartition(5), "g", {"x": 0.5, "y": 0.001}).collect()}
    assert set(got) == set(sets)
    for k, v in sets.items():
        assert (got[k].x, got[k].y) == pytest.approx((np.percentile(v, 50), np.percentile(-np.array(v), 0.1)), rel=1e-9), k


def test_rules_with_labels(spark):
    """One reading for bands and verdicts: the rows that bands fitted apart give, also under another key."""
    r = random.Random(9)
    rows = [(i, " ".join(words(r, r.randint(60, 200))), r.choice(["en", "qq", None])) for i in range(200)] + [(300 + i, listed(r, 100), r.choice(["en", "qq", None])) for i in range(40)] + [(None, "few words", "qq"), (7, None, "qq")]
    docs = spark.createDataFrame([(*x, f"k{k}") for k, x in enumerate(rows)], "doc_id long, text string, lang string, own string")
    labels = spark.createDataFrame([(i, int(i < 200)) for i, *_ in rows if i is not None] + [(None, 1)], "doc_id long, quality int")
    path = P.path("piece_bpe_32k.model")
    bands = fit_bands(docs, labels, path)
    assert "qq" in bands
    want = quality_rules(docs, path, id_col="own", bands=bands).collect()
    got = quality_rules(docs, path, id_col="own", labels=labels, match_col="doc_id").collect()
    assert sorted(want) == sorted(got) and len(got) == len(rows) and got[0].__fields__[0] == "own"
    assert {x.own for x in got if x.kept} == {f"k{k}" for k in range(200)}
