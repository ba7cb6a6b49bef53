"""Arrow functions over batches of claims and questions: what array functions of Spark would interpret element by element."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F

from quorumlake.functions.columns import STANCES, TIE


def _folding():
    """fold(values, starts, sizes): the sum of each run of values, in its order, with Neumaier's compensation, as columns.fsum makes it."""

    def fold(values, starts, sizes):
        s = np.zeros((len(sizes), *values.shape[1:]))
        c = np.zeros_like(s)
        for step in range(int(sizes.max(initial=0))):
            at = np.flatnonzero(sizes > step)
            x, a = values[starts[at] + step], s[at]
            t = a + x
            c[at] += np.where(np.abs(a) >= np.abs(x), (a - t) + x, (x - t) + a)
            s[at] = t
        return s + c + 0.0

    return fold


def stability(v: Column, methods: tuple[str, ...]) -> Column:
    """array of struct(method, n, delta) of a claim's pairs v (quality, n_s, n_c, n_i, stances): how many seeds change the decision when left out, and the largest change of the score.

    Scores are those of methods C and D; n and delta are null without pairs,
    delta also where no two scores are defined.
    """
    stances, fold = STANCES, _folding()

    def run(pairs: pa.Array) -> pa.Array:
        sizes = pc.fill_null(pc.list_value_length(pairs), 0).to_numpy().astype(np.int64)
        starts = np.cumsum(sizes) - sizes
        owner = np.repeat(np.arange(len(sizes)), sizes)
        by = dict(zip([f.name for f in pairs.type.value_type], pairs.flatten().flatten()))
        number = lambda c: pc.cast(c, pa.float64()).to_numpy(zero_copy_only=False)
        missing = lambda c: c.is_null().to_numpy(zero_copy_only=False)
        q, counts = number(by["quality"]), [number(by[f"n_{k}"]) for k in "sci"]
        unknown = np.logical_or.reduce([missing(by[k]) for k in ("quality", "n_s", "n_c", "n_i")])
        length = pc.fill_null(pc.list_value_length(by["stances"]), -1).to_numpy().astype(np.int64)
        first = np.full(len(sizes), -1)
        first[sizes > 0] = length[starts[sizes > 0]]
        length = np.maximum(length, 0)
        # An empty list of stances still has the score without any seed's sample taken out.
        seeds = np.where(first < 0, 0, np.maximum(first, 1))
        places = np.arange(int(seeds.max(initial=0)))
        flat, base = by["stances"].flatten(), np.cumsum(length) - length
        inside = places < length[:, None]
        at = np.where(inside, base[:, None] + places, 0)
        gone = []
        for s in stances:
            same = pc.fill_null(pc.equal(flat, s), False).to_numpy(zero_copy_only=False)
            gone.append(inside & same[at] if len(same) else inside & False)

        def score(method, n):
            total = n[0] + n[1] + n[2]
            with np.errstate(all="ignore"):
                p = [x / total for x in n]
                none = (total == 0) | (unknown if total.ndim == 1 else unknown[:, None])
                w = q if total.ndim == 1 else q[:, None]
                if method == "D":
                    top, low = np.maximum(np.maximum(p[0], p[1]), p[2]), np.minimum(np.minimum(p[0], p[1]), p[2])
                    middle = np.maximum(np.minimum(p[0], p[1]), np.minimum(np.maximum(p[0], p[1]), p[2]))
                    h = -sum((np.where(x > 0, x * np.log(np.where(x > 0, x, 1.0)), 0.0) for x in (middle, low)), np.where(top > 0, top * np.log(np.where(top > 0, top, 1.0)), 0.0)) / math.log(3)
                    third = 1.0 / 3.0
                    w = w * (1 - np.where((p[0] == third) & (p[1] == third) & (p[2] == third), 1.0, np.clip(h, 0.0, 1.0)))
                    whole = fold(w, starts, sizes)
                else:
                    whole = fold(q, starts, sizes)
                    whole = whole if total.ndim == 1 else whole[:, None]
                found = fold(w / whole[owner] * (p[0] - p[1]), starts, sizes)
            null = (fold(none.astype(float), starts, sizes) > 0) | (whole == 0)
            return found, null

        sign = lambda x, null: np.where(null, 0, np.where((x > 0) | np.isnan(x), 1, np.where(x < 0, -1, 0)))
        used = places < seeds[:, None]
        empty = first < 0
        parts = []
        for m in methods:
            full, full_null = score(m, counts)
            less, less_null = score(m, [n[:, None] - g for n, g in zip(counts, gone)])
            changed = (used & (sign(less, less_null) != sign(full, full_null)[:, None])).sum(axis=1)
            either = ~used | less_null | full_null[:, None]
            with np.errstate(all="ignore"):
                delta = np.where(either, -1.0, np.abs(less - full[:, None])).max(axis=1, initial=-1.0)
            parts.append((changed, delta))
        n, delta = np.stack([p[0] for p in parts], axis=1).ravel(), np.stack([p[1] for p in parts], axis=1).ravel()
        none = np.repeat(empty, len(methods))
        rows = pa.StructArray.from_arrays([pa.array(list(methods) * len(sizes), pa.string()), pa.array(n, pa.int64(), mask=none), pa.array(delta, pa.float64(), mask=none | (delta < 0))], ["method", "n", "delta"])
        return pa.ListArray.from_arrays(np.arange(len(sizes) + 1, dtype=np.int32) * len(methods), rows)

    return F.arrow_udf(run, "array<struct<method:string,n:bigint,delta:double>>")(v)


def answers(quality: Column, counts: Column, drawn: int) -> Column:
    """array of struct(method, state, reason, answer, ranking) of a question by methods A to D, null for null.

    quality: of its evidence in rank order; counts: for each option the label
    counts of its pairs with that evidence, as 16 * n_s + n_c of `drawn` samples
    each (15 at most).  Claims and answers are those of aggregate.verdict and
    answer.chosen over scores of twelve digits.
    """
    tie, fold = TIE, _folding()

    def run(quality: pa.Array, counts: pa.Array) -> pa.Array:
        plogp = lambda p: p * math.log(p) if p > 0 else 0.0
        # By packed counts: the hard vote (1, -1, 0 for neither), direction, and 1 - entropy.
        vote, d, sure = np.zeros(256), np.zeros(256), np.zeros(256)
        for n_s in range(drawn + 1):
            for n_c in range(drawn + 1 - n_s):
                p, at = [n_s / drawn, n_c / drawn, (drawn - n_s - n_c) / drawn], 16 * n_s + n_c
                won = [max(p) - x <= tie for x in p]
                third = 1.0 / 3.0
                h = 1.0 if p == [third] * 3 else min(1.0, max(0.0, -sum(map(plogp, sorted(p)[1::-1]), plogp(max(p))) / math.log(3)))
                vote[at], d[at], sure[at] = (won[0] - won[1]) * (sum(won) == 1), p[0] - p[1], 1 - h
        there = counts.is_valid().to_numpy(zero_copy_only=False)
        sizes = pc.fill_null(pc.list_value_length(quality), 0).to_numpy().astype(np.int64)
        q = quality.flatten().to_numpy(zero_copy_only=False)
        lists = counts.flatten()
        # Claims of a question stand side by side; each has all of its question's evidence.
        claims = pc.fill_null(pc.list_value_length(counts), 0).to_numpy().astype(np.int64)
        options = int(claims.max(initial=0))
        asked = np.flatnonzero(there)
        n = lists.flatten().to_numpy(zero_copy_only=False)
        size = np.repeat(sizes[asked], options)
        starts = np.cumsum(size) - size
        base = np.repeat((np.cumsum(sizes) - sizes)[asked], options)
        owner = np.repeat(np.arange(len(size)), size)
        q = q[base[owner] + np.arange(len(owner)) - starts[owner]]
        sums = lambda x: fold(x, starts, size)
        w, hard = q * sure[n], vote[n]
        q_total, w_total, b_s, b_c = sums(q), sums(w), sums(np.where(hard > 0, q, 0.0)), sums(np.where(hard < 0, q, 0.0))
        gap_a, gap_b = sums(hard), b_s - b_c
        sign = lambda x, slack=0.0: (x > slack).astype(int) - (x < -slack).astype(int)
        with np.errstate(all="ignore"):
            soft = lambda x, total: np.where(total != 0, sums(x / total[owner] * d[n]), np.nan)
            c, e = soft(q, q_total), soft(w, w_total)
            each = [("A", gap_a / size, sign(gap_a)), ("B", np.where(q_total != 0, gap_b / q_total, np.nan), sign(gap_b, tie)), ("C", c, sign(c)), ("D", e, sign(e))]
        letters = [chr(65 + k) for k in range(options)]
        states, reasons = pa.array(["ANSWERED", "ABSTAIN"]), pa.array(["UNIQUE_HIGHEST_POSITIVE_SCORE", "TIED_HIGHEST_POSITIVE_SCORES", "NO_POSITIVE_ELIGIBLE_SCORE"])
        parts = []
        for _, score, decision in each:
            x = score.reshape(-1, options) * 1e12
            low = np.floor(np.abs(x))
            x = np.copysign(low + (np.abs(x) - low >= 0.5), x) / 1e12
            known = ~np.isnan(x)
            order = np.argsort(np.where(known, -x, np.inf), axis=1, kind="stable")
            # Undefined options go last and are not named.
            code = np.zeros(len(x), np.int64)
            for k in range(options):
                code = code * (options + 1) + np.where(k < known.sum(axis=1), order[:, k] + 1, 0)
            found, at = np.unique(code, return_inverse=True)
            digits = lambda y: [int(y) // (options + 1) ** k % (options + 1) for k in range(options - 1, -1, -1)]
            named = pa.array(["".join(letters[k - 1] for k in digits(y) if k) for y in found], pa.string()).take(pa.array(at.ravel()))
            good = known & (x > 0) & (decision.reshape(-1, options) > 0)
            best = np.where(good, x, -np.inf).max(axis=1, initial=-np.inf)
            near = (good & (x >= best[:, None] - tie)).sum(axis=1)
            first = np.argmax(good & (x == best[:, None]), axis=1)
            parts.append((states.take(pa.array((near != 1).astype(int))), reasons.take(pa.array(np.where(near == 1, 0, np.where(near > 1, 1, 2)))), pa.array(first, pa.int32(), mask=near != 1), named))
        m = len(each)
        # Methods of a question stand side by side.
        shuffled = pa.array((np.arange(len(asked))[:, None] + np.arange(m) * len(asked)).ravel())
        column = lambda k: pa.concat_arrays([p[k] for p in parts]).take(shuffled)
        rows = pa.StructArray.from_arrays([pa.array([e[0] for e in each] * len(asked), pa.string()), *[column(k) for k in range(4)]], ["method", "state", "reason", "answer", "ranking"])
        ends = np.concatenate([[0], np.cumsum(there * m)]).astype(np.int32)
        return pa.ListArray.from_arrays(pa.array(ends), rows, mask=pa.array(~there))

    return F.arrow_udf(run, "array<struct<method:string,state:string,reason:string,answer:int,ranking:string>>")(quality, counts)
