"""Repeated substrings against brute force; suffix and LPF arrays against their definitions."""

import hashlib
import random
from collections import defaultdict

import numpy as np
import pytest

from quorumlake.llm import suffixdedup
from quorumlake.llm.suffixdedup import longest_previous, remove_repeats, suffix_array


def brute(docs, length, keep_first):
    at = defaultdict(list)
    texts = [(t or "").encode() for _, t in docs]
    for d, b in enumerate(texts):
        for i in range(len(b) - length + 1):
            at[b[i : i + length]].append((docs[d][0] or -1, d, i))
    gone = [bytearray(len(b)) for b in texts]
    for places in at.values():
        for _, d, i in sorted(places)[1 if keep_first else 0 :] if len(places) > 1 else []:
            gone[d][i : i + length] = b"\1" * length
    out = []
    for (i, _), b, g in zip(docs, texts, gone):
        kept = bytes(c for c, x in zip(b, g) if not x)
        spans = sum(1 for k in range(len(g)) if g[k] and not (k and g[k - 1]))
        out.append((i, len(b), sum(g), spans, hashlib.sha256(kept).hexdigest()))
    return out


def documents(r):
    words = ["the ", "of\n", "é ", "ation", "x", "日本 "]
    text = lambda n: "".join(r.choice(words) + str(r.randint(0, 99)) for _ in range(n))
    passages = [text(r.choice([30, 60, 120])) for _ in range(5)]
    docs = []
    for i in range(1, 60):
        parts = [text(r.randint(0, 40))]
        for _ in range(r.randint(0, 3)):
            p = r.choice(passages)
            a = r.randint(0, len(p) // 2)
            parts += [p[a : a + r.randint(40, len(p))], text(r.randint(0, 30))]
        docs.append((i, "".join(parts)))
    docs += [(100 + i, docs[i][1]) for i in range(0, 20, 5)]
    line = "All rights reserved in this very long line which is the same everywhere and goes on. " * 2
    return docs + [(200, None), (201, ""), (202, "short"), (203, "ab" * 900), (204, line * 40), (205, "z " + line * 3), (None, line + text(5))]


@pytest.mark.parametrize(("keep_first", "hot", "segment", "salts"), [(False, 20_000, 4 << 20, 64), (True, 20_000, 4 << 20, 64), (False, 3, 700, 64), (True, 3, 700, 64), (False, 20_000, 700, 2), (True, 20_000, 700, 2)])
def test_equals_brute_force(spark, docs_of, monkeypatch, keep_first, hot, segment, salts):
    # With two parts and a share that any gram reaches, all repeated grams are dealt by context.
    if salts == 2:
        monkeypatch.setattr(suffixdedup, "HOT", 10**6)
    monkeypatch.setattr(suffixdedup, "SALTS", salts)
    monkeypatch.setattr(suffixdedup, "HOT_RUNS", hot)
    monkeypatch.setattr(suffixdedup, "SEGMENT", segment)
    docs = documents(random.Random(8))
    got = remove_repeats(docs_of(docs), length=150, keep_first=keep_first).drop("h", "kept").collect()
    assert sorted(map(tuple, got), key=str) == sorted(brute(docs, 150, keep_first), key=str)


def test_arrays():
    r = random.Random(2)
    raw = bytes(r.choice(b"ab") for _ in range(300))
    flat, length = np.frombuffer(raw, np.uint8), 20
    starts = np.arange(len(raw) - length + 1)
    order, lcp = suffix_array(flat, starts, length)
    cuts = [raw[s : s + length] for s in starts[order]]
    assert cuts == sorted(cuts)
    match = lambda x, y: next((k for k in range(length) if x[k] != y[k]), length)
    assert lcp[1:].tolist() == [match(a, b) for a, b in zip(cuts, cuts[1:])]
    lpf = longest_previous(order, lcp, np.arange(len(starts)))
    want = [max((match(raw[i : i + length], raw[j : j + length]) for j in range(i)), default=0) for i in range(len(starts))]
    assert lpf.tolist() == want


def test_empty(spark, docs_of):
    assert remove_repeats(docs_of([])).count() == 0
