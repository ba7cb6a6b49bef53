"""The corpus pipeline against a plain computation of each stage, and the fertility rules against the library."""

import math
import os
import random
import re
import sys
import unicodedata
import zlib
from collections import Counter

import numpy as np
import public_tokenizers as P
import pytest
import sentencepiece
from tokenizers import Tokenizer

sys.path.insert(0, os.path.dirname(__file__))

from test_decontam import brute as brute_contaminated  # noqa: E402
from test_neardup import brute as brute_components  # noqa: E402

import corpus_pipeline  # noqa: E402
from quorumlake.llm.fertility import BANDS, quality_rules  # noqa: E402

#: Too few to fit bands on, so the given ones hold.
LABELS = [(1, 1, 0), (2, 0, 0), (None, 1, 0), (99999, 1, 0)]
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def fits(figures, ids, n, text, lang):
    """The rules of the bands, written out again."""
    letters = [c for c in text if c.isalpha()]
    latin = 2 * sum(unicodedata.name(c, "").startswith("LATIN") or c in "ªº" for c in letters) > len(letters)
    near = [BANDS[lang]] if lang in BANDS else list(BANDS.values()) if latin else []
    cpt, tpw, share, entropy = figures
    if not near:
        return 0.25 <= cpt <= 12 and share <= 0.95 and entropy >= 3
    root = math.sqrt(n)
    inside = any(abs(cpt - b.cpt) <= 6 * b.cpt_spread / root + 0.12 * b.cpt and tpw <= b.tpw + 6 * b.tpw_spread / root + 0.12 * b.tpw and share <= b.share and entropy >= b.entropy for b in near)
    if not inside and (lang is None or lang in BANDS):
        return False
    w = min(128, len(ids))
    starts = [int(x) for x in np.linspace(0, len(ids) - w, math.ceil(len(ids) / w))]
    bits = sum(-sum(k / w * math.log2(k / w) for k in Counter(ids[a : a + w]).values()) for a in starts) / len(starts)
    return bits >= min(b.bits for b in near) - 0.25 - 0.2 * math.sqrt(128 / len(ids)) - 0.8 * max(0, math.log2(128 / len(ids)))


def verdict(text, lang, model):
    text = text or ""
    words = WORD.findall(text)
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    times = Counter(windows)
    hit = {i + k for i, w in enumerate(windows) if times[w] > 1 for k in range(3)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    ids = model.encode(text)
    failed = len(words) < 50 or 100 * len(hit) > 50 * len(words)
    low = next(i for i in range(model.get_piece_size()) if model.is_byte(i)) + 128
    p = [n / len(ids) for n in Counter(ids).values()]
    figures = (len(text) / len(ids), len(ids) / max(1, len(words)), sum(low <= i < low + 128 for i in ids) / len(ids), -sum(x * math.log2(x) for x in p)) if ids else (0.0, 0.0, 0.0, 0.0)
    good = not failed and fits(figures, ids, len(words), text, lang)
    return len(words), sum(map(len, words)), sum(text.count(x) for x in "#*$%&|<>"), len(lines) - len(set(lines)), len(hit), failed, good, figures


@pytest.fixture(scope="module")
def documents():
    r = random.Random(6)
    syllables = "th er on an re he in ed nd ha at en es of or nt ea ti to it st".split()
    vocab = ["".join(r.choice(syllables) for _ in range(r.randint(1, 4))) for _ in range(600)]
    text = lambda n: " ".join(r.choice(vocab) for _ in range(n)).capitalize() + "."
    docs = [(i, text(r.randint(20, 260)), r.choice(["en", "fr", None, "xx"]), r.choice(["a", "b", "c"]), 5) for i in range(120)]
    docs += [(200 + i, docs[i][1] + " again", "en", "a", 5) for i in range(0, 40, 4)]
    bench = [(1, text(14)), (2, text(30))]
    docs += [(300 + i, text(60) + " " + bench[i % 2][1] + " " + text(60), "en", "b", 5) for i in range(8)]
    docs += [(400, None, "en", "a", 0), (401, "", None, None, 0), (402, "a b c " * 80, "en", "a", 5), (403, "line one is here\n" * 30 + text(40), "en", "a", 5), (404, "x |%&*$ " * 70, "en", "c", 5), (405, "éé ßß " + text(90), "de", None, 5)]
    return docs, bench


def test_quality_rules(spark, documents):
    docs, _ = documents
    model = sentencepiece.SentencePieceProcessor(model_file=P.path("piece_bpe_32k.model"))
    got = {r.doc_id: r for r in quality_rules(spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long"), P.path("piece_bpe_32k.model")).collect()}
    for i, t, lang, *_ in docs:
        want, r = verdict(t, lang, model), got[i]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed, r.kept) == want[:7], i
        assert (r.chars_per_token, r.tokens_per_word, r.byte_share, r.token_entropy) == pytest.approx(want[7])


def test_pipeline(spark, documents, tmp_path):
    docs, bench = documents
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(bench, "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    spark.createDataFrame(LABELS, "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    model = sentencepiece.SentencePieceProcessor(model_file=P.path("piece_bpe_32k.model"))
    now = spark.read.parquet(str(tmp_path / "documents.parquet"))
    kept = [d for d in docs if verdict(d[1], d[2], model)[6]]
    distinct = {i for i, _, _, keep in brute_components([d[:2] for d in kept], 5, 80) if keep}
    kept2 = [d for d in kept if d[0] in distinct]
    clean = {r[0] for r in brute_contaminated([d[:2] for d in kept2], bench, 10) if not r[5]}
    wanted = [{d[0] for d in kept}, distinct, clean]
    for (name, stage), want in zip(corpus_pipeline.STAGES, wanted):
        now = stage(spark, now, str(tmp_path))
        assert now.columns == corpus_pipeline.COLUMNS
        assert sorted(r.doc_id for r in now.collect()) == sorted(want), name
    assert 0 < len(clean) < len(distinct) < len(kept) < len(docs)
    by_id = {d[0]: d for d in docs}
    mixed = [r.doc_id for r in corpus_pipeline.mix_sources(spark, now, str(tmp_path)).collect()]
    assert max(Counter(mixed).values()) <= 3 and set(mixed) <= clean
    assert sum(len(by_id[i][1].split()) for i in mixed) == pytest.approx(sum(len(by_id[i][1].split()) for i in clean), rel=0.1)
    tk, start = Tokenizer.from_file(P.path("word_bpe_49k.json")), 0
    rows = corpus_pipeline.run(spark, str(tmp_path)).orderBy("start").collect()
    assert [r.doc_id for r in rows] == sorted(mixed)
    for r in rows:
        ids = tk.encode(by_id[r.doc_id][1], add_special_tokens=False).ids + [2]
        assert (r.start, r.n_tokens, r.ids_crc32) == (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)


def test_null_and_repeated_ids_through_all_stages(spark, documents, tmp_path):
    docs, bench = documents
    good = [d for d in docs if d[0] < 120 and len(d[1].split()) >= 60 and d[2] in ("en", None)][:8]
    a, b, c, d, e, f, *_ = (x[1] for x in good)
    rows = [(None, a, "en", "a", 5), (None, b, "en", "a", 5), (7, c, "en", "a", 5), (7, d, "en", "a", 5), (7, "too short", "en", "a", 5), (8, e, "en", "a", 5), (8, e, "en", "a", 5), (9, f + " " + bench[0][1] + " " + f[:50], "en", "a", 5), (9, f[::-1].replace("  ", " "), "en", "a", 5)]
    clash = [(*r, 1, "x", 2.5) for r in rows]
    schema = "doc_id long, text string, lang string, source string, n_chars long, id long, h string, size double"
    spark.createDataFrame(bench, "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    spark.createDataFrame(LABELS, "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    now = spark.createDataFrame(clash, schema)
    want = Counter([(None, a), (None, b), (7, c), (7, d), (8, e)])
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES[:4]):
        now = stage(spark, now, str(tmp_path))
        got = Counter((r.doc_id, r.text) for r in now.collect())
        got = Counter({x: n for x, n in got.items() if x[0] != 9})
        assert got == (want + Counter({(8, e): 1}) if k == 0 else want), k
    files = corpus_pipeline.token_files(spark, now, str(tmp_path)).collect()
    assert Counter(r.doc_id for r in files)[None] == 2 and Counter(r.doc_id for r in files)[7] == 2


def test_empty_table_through_all_stages(spark, tmp_path):
    none = spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
    none.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, "a b c")], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_empty(spark):
    none = spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
    assert quality_rules(none, P.path("piece_bpe_32k.model")).count() == 0
