"""Near duplicates against brute force, split groups included."""

import random

import pytest

from quorumlake.llm.components import components
from quorumlake.llm.neardup import near_duplicates


def brute(docs, k, percent):
    sets = []
    for _, t in docs:
        w = (t or "").encode().lower().split()
        sets.append({tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else set())
    root = list(range(len(docs)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            both = len(a & sets[j])
            if both and 100 * both >= percent * len(a | sets[j]):
                root[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(docs):
        if d is not None:
            least[find(i)] = min(least.get(find(i), d), d)
    return [(d, len(s), c := least.get(find(i)), d is not None and d == c) for i, ((d, _), s) in enumerate(zip(docs, sets))]


def near_copies(r, n):
    vocab = [f"w{i}" for i in range(400)]
    docs, at = [], 0
    for _ in range(4):
        base = [r.choice(vocab) for _ in range(r.choice([12, 40, 150]))]
        for _ in range(n):
            t = list(base)
            for _ in range(r.choice([0, 0, 1, 2, 4, 8])):
                t[r.randrange(len(t))] = r.choice(vocab)
            if r.random() < 0.1:
                base = t
            docs.append((at, r.choice([" ", "  ", "\n"]).join(t)))
            at += 1
    return docs


@pytest.mark.parametrize("block", [4000, 10])
def test_equals_brute_force(spark, docs_of, block):
    docs = near_copies(random.Random(3), 45) + [(900, None), (901, ""), (902, " \n"), (903, "One"), (904, "one"), (905, "one two"), (906, "ÉÉ x y"), (907, "éé x y"), (None, "one"), (3, "other text of a repeated id"), (908, "a " * 30000)]
    got = near_duplicates(docs_of(docs), shingle=3, percent=85, block=block).collect()
    key = lambda x: (str(x[0]), x[1], str(x[2]))
    assert sorted(map(tuple, got), key=key) == sorted(brute(docs, 3, 85), key=key)


def test_long_chain_is_one_component(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(100, 160)] + [(1, None), (7, 8)], "a long, b long")
    got = {r.node: r.label for r in components(edges).collect()}
    assert got == {i: 100 for i in range(100, 161)} | {7: 7, 8: 7}


def test_empty(spark, docs_of):
    assert near_duplicates(docs_of([])).count() == 0
