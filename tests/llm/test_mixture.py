"""Pivotal rounding: targets, bounds, unbiasedness and edge cases."""

import random

import pytest

from quorumlake.llm.mixture import mix, round_group


def test_words_stay_and_copies_are_unbiased():
    rows = sorted(((random.Random(i).randint(1, 400), 0, 0.3) for i in range(60)), reverse=True)
    total, seen = sum(s * p for s, _, p in rows), [0] * 60
    for k in range(600):
        copies, held = round_group(rows, random.Random(k))
        words = sum(s * c for (s, _, _), c in zip(rows, copies)) + (rows[held[0]][0] * held[1] if held else 0)
        assert words == pytest.approx(total)
        for j, c in enumerate(copies):
            seen[j] += c + (held[1] if held and held[0] == j else 0)
    assert all(abs(x / 600 - 0.3) < 0.1 for x in seen)


def test_a_long_row_is_rounded_against_all_others():
    copies, held = round_group([(5000, 0, 0.3)] + [(100, 0, 0.3)] * 150, random.Random(4))
    assert held is None or held[0] > 0


@pytest.mark.parametrize("apart", [8.0, float("inf")])
def test_long_rows_keep_expectations_as_by_pairs(apart):
    rows = [(4000, 0, 0.35), (900, 1, 0.6)] + [(60 - k, 0, 0.2 + 0.01 * k) for k in range(40)]
    total, runs, seen, off = sum(s * (w + p) for s, w, p in rows), 3000, [0.0] * 42, []
    for k in range(runs):
        copies, held = round_group(rows, random.Random(k), apart)
        words = sum(s * c for (s, _, _), c in zip(rows, copies)) + (rows[held[0]][0] * held[1] if held else 0)
        off.append(abs(words - total))
        for j, c in enumerate(copies):
            seen[j] += c + (held[1] if held and held[0] == j else 0)
    # Five standard errors of a coin thrown so often.
    assert all(abs(x / runs - (w + p)) < 5 * (0.25 / runs) ** 0.5 for x, (_, w, p) in zip(seen, rows))
    assert max(off) < 1e-6


def water_level(sizes, most=3.0):
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: 1 + i % 3 for i, s in enumerate(names)}
    total, capped = sum(sizes.values()), {}
    while True:
        free = [s for s in names if s not in capped]
        left = total - sum(capped.values())
        share = {s: left * weight[s] / sum(weight[t] for t in free) for s in free}
        over = [s for s in free if share[s] > most * sizes[s] + 1e-9]
        if not over:
            return share | capped
        capped |= {s: most * sizes[s] for s in over}


def test_targets_bounds_and_edges(spark, docs_of):
    r = random.Random(1)
    rows = [(i, " ".join(["w"] * r.randint(1, 60)), r.choice(["a", "b", "c", "d", None])) for i in range(900)]
    rows += [(1000, None, "a"), (1001, "", "b"), (1002, " \t\n", "e"), (None, "x y", "a"), (5, "same", "z"), (5, "same", "z"), (7, "w " * 9, "small")]
    docs = docs_of(rows)
    got = mix(docs, leaf=64, fan=2).toPandas()
    again = mix(docs, leaf=64, fan=2).toPandas()
    assert len(got) == len(rows)
    key = ["doc_id", "h", "size", "copies"]
    assert sorted(map(tuple, got[key].fillna(-1).values.tolist())) == sorted(map(tuple, again[key].fillna(-1).values.tolist()))
    sizes: dict = {}
    for _, t, s in rows:
        sizes[s] = sizes.get(s, 0) + len((t or "").split())
    assert got.taken.sum() == pytest.approx(sum(sizes.values()), rel=0.02)
    targets = water_level(sizes)
    for (n, t), g in got.groupby(["source_size", "target"]):
        assert any(sizes[s] == n and targets[s] == pytest.approx(t) for s in sizes)
    assert (got.taken <= 3 * got["size"]).all()
    big = got[got.source_size > 1000].groupby(["source_size", "target"]).taken.sum()
    for (_, target), taken in big.items():
        assert taken == pytest.approx(target, abs=60)


def test_empty(spark, docs_of):
    assert mix(docs_of([])).count() == 0
