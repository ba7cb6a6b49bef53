"""Context-tree weighting against a direct sequential computation, and the word model against brute force."""

import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest

from quorumlake.llm import ctw
from quorumlake.llm.ctw import DEPTH, EDGE, code_logs, crown_of, crown_sums, language_scores, log_gamma, places_of


def test_log_gamma():
    x = np.array([0.5, 1, 2.5, 10, 1e3, 1e9])
    assert np.allclose(log_gamma(x), [math.lgamma(v) for v in x], rtol=1e-12)
    n = np.array([0, 1, 5, 4095, 4096, 10**7])
    assert np.allclose(ctw.factorials(n, True), [math.lgamma(v + 0.5) for v in n]) and np.allclose(ctw.factorials(n, False), [math.lgamma(v + 1) for v in n])


class Slow:
    """The same model by its definition: nested nodes, one bit at a time."""

    def __init__(self, train):
        self.counts, self.children = Counter(), {}
        for t in train:
            b = EDGE * DEPTH + t + EDGE
            for i in range(DEPTH, len(b)):
                for d in range(DEPTH + 1):
                    if d:
                        self.children.setdefault(b[i - d + 1 : i], set()).add(b[i - d : i])
                    node = 1
                    for k in range(7, -1, -1):
                        bit = b[i] >> k & 1
                        self.counts[b[i - d : i], node, bit] += 1
                        node = 2 * node + bit
        self.known = {}

    def block(self, c, node):
        a, b = self.counts[c, node, 0], self.counts[c, node, 1]
        return math.lgamma(a + 0.5) + math.lgamma(b + 0.5) - math.log(math.pi) - math.lgamma(a + b + 1)

    def whole(self, c, node):
        if (c, node) not in self.known:
            below = sum(self.whole(x, node) for x in self.children.get(c, ()))
            self.known[c, node] = self.block(c, node) if len(c) == DEPTH else math.log(0.5) + np.logaddexp(self.block(c, node), below)
        return self.known[c, node]

    def p_one(self, ctx, d, node):
        c = ctx[DEPTH - d :]
        a, b = self.counts[c, node, 0], self.counts[c, node, 1]
        own = (b + 0.5) / (a + b + 1)
        # The mixture ends where the deeper node was never seen.
        if d == DEPTH or not any(self.counts[ctx[DEPTH - d - 1 :], node, x] for x in (0, 1)):
            return own
        w = math.exp(math.log(0.5) + self.block(c, node) - self.whole(c, node))
        return w * own + (1 - w) * self.p_one(ctx, d + 1, node)

    def score(self, text):
        total, b = 0.0, EDGE * DEPTH + text + EDGE
        for i in range(DEPTH, len(b)):
            node = 1
            for k in range(7, -1, -1):
                p = self.p_one(b[i - DEPTH : i], 0, node)
                bit = b[i] >> k & 1
                total += math.log10(p if bit else 1 - p)
                node = 2 * node + bit
        return total


def test_places(monkeypatch):
    monkeypatch.setattr(ctw, "PIECE", 7)
    texts = [b"", b"abcdefghijkl", b"xy"]
    got = sorted((int(of), int(code)) for codes, places in places_of(texts) for code, of in zip(codes, places))
    want = []
    for k, t in enumerate(texts):
        b = EDGE * DEPTH + t + EDGE
        want += [(k, int.from_bytes(b[i - DEPTH : i][::-1] + b[i : i + 1], "big")) for i in range(DEPTH, len(b))]
    assert got == sorted(want)


@pytest.mark.parametrize("forest, block", [(1 << 19, 16 << 20), (40, 300)])
def test_equals_definition(spark, docs_of, monkeypatch, forest, block):
    # Small forests and blocks: the figures must not depend on how the work is cut.
    monkeypatch.setattr(ctw, "FOREST", forest)
    monkeypatch.setattr(ctw, "BLOCK", block)
    monkeypatch.setattr(ctw, "PIECE", 64)
    r = random.Random(8)
    docs = [(i, "".join(r.choice(["abra", "cad", "banana ", "é", " x", "Zz"]) for _ in range(r.randint(0, 12)))) for i in range(60)]
    # Counts of over a byte, in several blocks.
    docs += [(i, "ab " * 150) for i in range(60, 64)]
    lower = lambda t: t.encode().lower()
    slow = Slow([lower(t) for i, t in docs if zlib.crc32(str(i).encode()) % 7 != 2])
    got = {x.doc_id: (x.score, x.bits_per_byte) for x in language_scores(docs_of(docs)).collect()}
    for i, t in docs:
        want = slow.score(lower(t))
        assert got[i] == pytest.approx((want, -want / math.log10(2) / (len(lower(t)) + 1)), rel=1e-4), i


def test_probabilities_sum_to_one(spark):
    contexts = [b"the c", b"zzzzz", b"\xff\xff\xff\xffd"]
    found = Counter(int(c) for codes, _ in places_of([b"the cat sat on the mat", b"dog"]) for c in codes)
    found.update({int.from_bytes(c[::-1] + bytes([x]), "big"): 0 for c in contexts for x in range(256)})
    code = np.array(sorted(found))
    n = np.array([found[int(c)] for c in code])
    tree = code >> 24
    low = lambda c: bytearray((int(c) & 0xFFFFFF).to_bytes(3, "little"))
    rows = [(0, int(t), bytearray().join(map(low, code[tree == t])), bytearray(int(x) for x in n[tree == t]), []) for t in np.unique(tree)]
    table = spark.createDataFrame(rows, "block long, tree int, low binary, few binary, many array<long>").coalesce(1).sortWithinPartitions("tree")
    logs = dict(zip(code.tolist(), code_logs(code, n, crown_of(crown_sums(table).toPandas()))))
    for c in contexts:
        assert sum(10 ** logs[int.from_bytes(c[::-1] + bytes([x]), "big")] for x in range(256)) == pytest.approx(1)


@pytest.mark.parametrize("heavy", [1e-5, 0.05, 2.0])
def test_word_model(spark, docs_of, monkeypatch, heavy):
    monkeypatch.setattr(ctw, "HEAVY", heavy)
    r = random.Random(4)
    docs = [(i, " ".join(r.choice(["the", "The", "of", f"w{r.randint(0, 60)}", "É", "é"]) for _ in range(r.randint(0, 40)))) for i in range(150)]
    docs += [(900, None), (901, ""), (902, " \n"), (None, "the x"), (3, "the repeated row"), (3, "the repeated row"), (903, "the of " * 20000)]
    out = lambda i: zlib.crc32(str(i if i is not None else "").encode()) % 7 == 2
    tokens = lambda t: [*(t or "").encode().lower().split(), None]
    c = Counter(w for i, t in docs if not out(i) for w in tokens(t))
    n, v = sum(c.values()), len(c)
    want = [(i, out(i), len(tokens(t)), sum(c[w] > 0 for w in tokens(t)), n, round(sum(math.log10((c[w] + 1) / (n + v + 1)) for w in tokens(t)), 6)) for i, t in docs]
    got = [(x.doc_id, x.held_out, x.n_tokens, x.n_known, x.train_tokens, round(x.base_score, 6)) for x in language_scores(docs_of(docs)).collect()]
    assert sorted(got, key=str) == sorted(want, key=str)


def test_word_hashes_tell_words_apart(monkeypatch):
    monkeypatch.setattr(ctw, "PIECE", 50)
    r = random.Random(2)
    words = ["".join(r.choice("abé") for _ in range(r.randint(1, 8))).encode() for _ in range(800)] + [b"x" * 300 + bytes([97 + k]) for k in range(9)]
    texts = [b"", b" \n", *(r.choice([b" ", b"\t\n", b"\x0b"]).join(r.choice(words) for _ in range(r.randint(0, 60))) for _ in range(50)), b" ".join(words)]
    h, n = ctw.word_hashes(texts)
    assert n.tolist() == [len(t.split()) for t in texts]
    every = [w for t in texts for w in t.split()]
    assert len(set(zip(every, h.tolist()))) == len(set(every)) == len(set(h.tolist()))


def test_empty_tables(spark, docs_of):
    assert language_scores(docs_of([])).count() == 0
    none = [i for i in range(60) if zlib.crc32(str(i).encode()) % 7 == 2]
    got = language_scores(docs_of([(i, "a b") for i in none])).collect()
    assert {(x.n_known, x.train_tokens) for x in got} == {(0, 0)}
