"""Exact binomial intervals and intervals for paired differences."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The 97.5 % quantile of the normal distribution.
Z = 1.959963984540054
#: Halvings of an interval's bounds: to less than the last bit.
STEPS = 60


def binomial_tail(k: Column, n: Column, p: Column) -> Column:
    """P(X <= k) for n trials of chance 0 < p < 1: terms by their logarithms, each from the one before."""
    odds, first = F.ln(p) - F.log1p(-p), n * F.log1p(-p)

    def add(a: Column, j: Column) -> Column:
        term = F.when(j == 0, first).otherwise(a["term"] + F.ln((n - j + 1) / F.greatest(j, F.lit(1))) + odds)
        return F.transform(F.array(term), lambda x: F.struct(x.alias("term"), (a["sum"] + F.exp(x)).alias("sum")))[0]

    total = F.aggregate(F.sequence(F.lit(0).cast("long"), k.cast("long")), F.struct(F.lit(0.0).alias("term"), F.lit(0.0).alias("sum")), add, lambda a: a["sum"])
    return F.least(total, F.lit(1.0))


def interval(k: Column, n: Column, tail: float = 0.025) -> Column:
    """struct(low, high), the exact (Clopper-Pearson) interval for k successes of n; null for n of 0 or null.

    The bounds are found by halving: no quantile of the beta distribution is
    built in.  The work is about k steps for each of STEPS halvings.
    """

    def cross(chance) -> Column:
        def halve(b: Column, _: Column) -> Column:
            mid = (b["low"] + b["high"]) / 2
            return F.transform(F.array(F.struct(mid.alias("mid"), chance(mid).alias("up"))), lambda m: F.struct(F.when(m["up"], m["mid"]).otherwise(b["low"]).alias("low"), F.when(m["up"], b["high"]).otherwise(m["mid"]).alias("high")))[0]

        return F.aggregate(F.sequence(F.lit(1), F.lit(STEPS)), F.struct(F.lit(0.0).alias("low"), F.lit(1.0).alias("high")), halve, lambda b: (b["low"] + b["high"]) / 2)

    trials = n.cast("double")
    low = F.when(k == 0, 0.0).otherwise(cross(lambda p: 1 - binomial_tail(k - 1, trials, p) < tail))
    high = F.when(k == n, 1.0).otherwise(cross(lambda p: binomial_tail(k, trials, p) > tail))
    return F.when(k.isNotNull() & (n > 0), F.struct(low.alias("low"), high.alias("high")))


def bonferroni_difference(first: Column, second: Column) -> Column:
    """Bounds of second - first from two marginal intervals."""
    return F.struct((second["low"] - first["high"]).alias("low"), (second["high"] - first["low"]).alias("high"))


def wilson(k: Column, n: Column, z: float = Z) -> tuple[Column, Column]:
    centre, spread = 2 * k + z * z, z * F.sqrt(z * z + 4 * k * (1 - k / n))
    return (centre - spread) / (2 * (n + z * z)), (centre + spread) / (2 * (n + z * z))


def newcombe_paired(a: Column, b: Column, c: Column, d: Column, z: float = Z) -> Column:
    """Interval for the difference of two paired proportions, method 10: Wilson limits and a continuity-corrected correlation.

    a: both right, b: the first only, c: the second only, d: neither; the
    difference is first less second.
    """
    n = (a + b + c + d).cast("double")
    p1, p2 = (a + b) / n, (a + c) / n
    l1, u1 = wilson(a + b, n, z)
    l2, u2 = wilson(a + c, n, z)
    product = (a + b) * (c + d) * (a + c) * (b + d)
    raw = a * d - b * c
    corrected = F.when(raw > n / 2, raw - n / 2).when(raw >= 0, 0.0).otherwise(raw.cast("double"))
    phi = F.when(product > 0, corrected / F.sqrt(F.greatest(product, F.lit(1)).cast("double"))).otherwise(0.0)
    low = F.sqrt((p1 - l1) ** 2 - 2 * phi * (p1 - l1) * (u2 - p2) + (u2 - p2) ** 2)
    high = F.sqrt((u1 - p1) ** 2 - 2 * phi * (u1 - p1) * (p2 - l2) + (p2 - l2) ** 2)
    return F.struct((p1 - p2 - low).alias("low"), (p1 - p2 + high).alias("high"), (p1 - p2).alias("difference"))
