"""Column functions: distributions over three stances, entropies, directions, decisions and exact sums."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Stances in the order in which ties are scanned, and the tolerances.
STANCES = ("SUPPORT", "CONTRADICT", "IRRELEVANT")
TIE, SUM_TOLERANCE, FREQUENCY_TOLERANCE = 1e-12, 1e-6, 1e-9


def ratio(a: Column, b: Column) -> Column:
    """a / b as double; null where b is 0 or either is null."""
    return F.try_divide(a.cast("double"), b.cast("double"))


def plus_zero(c: Column) -> Column:
    """c without a negative zero."""
    return c + F.lit(0.0)


def valid_distribution(s: Column, c: Column, i: Column, tolerance: float = SUM_TOLERANCE) -> Column:
    """Finite, in [0, 1] and of sum 1 within the tolerance; null counts as invalid."""
    inside = [(~F.isnan(p)) & (p >= 0) & (p <= 1) for p in (s, c, i)]
    return F.coalesce(inside[0] & inside[1] & inside[2] & (F.abs(s + c + i - 1) <= tolerance), F.lit(False))


def winners(s: Column, c: Column, i: Column, tolerance: float) -> list[Column]:
    top = F.greatest(s, c, i)
    return [(top - p <= tolerance) for p in (s, c, i)]


def argmax3(s: Column, c: Column, i: Column, tolerance: float = TIE) -> Column:
    """The stance of the one largest probability; null if several are within the tolerance of it."""
    won = winners(s, c, i, tolerance)
    n = sum((w.cast("int") for w in won[1:]), won[0].cast("int"))
    label = F.when(won[0], STANCES[0]).when(won[1], STANCES[1]).when(won[2], STANCES[2])
    return F.when(n == 1, label)


def one_hot(label: Column) -> list[Column]:
    return [F.when(label == x, 1.0).otherwise(0.0) for x in STANCES]


def softmax3(a: Column, b: Column, c: Column) -> list[Column]:
    """Softmax shifted by the largest logit, so no finite logit overflows."""
    top = F.greatest(a, b, c)
    e = [F.exp(x - top) for x in (a, b, c)]
    return [x / (e[0] + e[1] + e[2]) for x in e]


def top_probability(s: Column, c: Column, i: Column) -> Column:
    return F.greatest(s, c, i)


def is_tied(s: Column, c: Column, i: Column, tolerance: float = TIE) -> Column:
    """Whether more than one probability is within the tolerance of the largest."""
    won = winners(s, c, i, tolerance)
    return sum((w.cast("int") for w in won[1:]), won[0].cast("int")) > 1


def scored_result(logits: Column, scores: Column, mapping: Column) -> Column:
    """struct(p_s, p_c, p_i, label, is_tied, entropy, error) of a model's logits and scores, arrays of three in its own label order.

    mapping: a map of index, as text, to stance.  Scores must be finite, in
    [0, 1], of sum one within 1e-12 and the softmax of the logits within 1e-12;
    otherwise all is null but the error.  The label is that of the one score that
    is exactly the largest.
    """
    finite = lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < float("inf")), F.lit(False))
    three = lambda xs: F.coalesce((F.size(xs) == 3) & F.forall(xs, finite), F.lit(False))
    # Each step is bound to a name of its own, so that no expression is written out again inside the next.
    bound = lambda x, then: F.transform(F.array(x), then)[0]
    each = lambda xs: [xs[k] for k in range(3)]
    stances = F.transform(F.array(*[F.lit(str(k)) for k in range(3)]), lambda k: F.try_element_at(mapping, k))

    def judged(x: Column) -> Column:
        l, s, m = x["l"], x["s"], x["m"]
        apart = F.exists(F.zip_with(s, F.array(*softmax3(*each(l))), lambda a, b: F.abs(a - b)), lambda d: d > TIE)
        ranged = F.forall(s, lambda p: p.between(0, 1)) & (F.abs(s[0] + s[1] + s[2] - 1) <= TIE)
        error = (
            F.when(~(three(l) & three(s)), "three finite logits and scores are needed").when(~F.array_sort(m).eqNullSafe(F.array(*map(F.lit, sorted(STANCES)))), "labels are not one to one onto the stances")
            .when(~ranged, "scores must sum to one").when(apart, "scores are not the softmax of the logits")
        )
        return F.struct(error.alias("error"), F.transform(F.array(*map(F.lit, STANCES)), lambda name: F.get(s, F.array_position(m, name).cast("int") - 1)).alias("p"))

    def told(x: Column) -> Column:
        ok, p = x["error"].isNull(), each(x["p"])
        return F.struct(
            *[F.when(ok, v).alias(f"p_{k}") for k, v in zip("sci", p)], F.when(ok, argmax3(*p, 0.0)).alias("label"), F.when(ok, is_tied(*p, 0.0)).alias("is_tied"), F.when(ok, entropy_metric(*p)).alias("entropy"), x["error"].alias("error")
        )

    return bound(bound(F.struct(logits.alias("l"), scores.alias("s"), stances.alias("m")), judged), told)


def log_likelihoods3(a: Column, b: Column, c: Column) -> list[Column]:
    """Normalised likelihoods of three label log probabilities; all null if one is missing."""
    known = a.isNotNull() & b.isNotNull() & c.isNotNull()
    return [F.when(known, p) for p in softmax3(a, b, c)]


def _plogp(p: Column) -> Column:
    return F.when(p > 0, p * F.ln(F.when(p > 0, p))).otherwise(F.lit(0.0))


def entropy_sum(*p: Column) -> Column:
    """-sum p ln p, largest p first so that permuted distributions agree to the last bit."""
    if len(p) == 3:
        # Missing ones add nothing, as 0 does; three are put in order without an array.
        a, b, c = [F.coalesce(x.cast("double"), F.lit(0.0)) for x in p]
        middle = F.greatest(F.least(a, b), F.least(F.greatest(a, b), c))
        return -(_plogp(F.greatest(a, b, c)) + _plogp(middle) + _plogp(F.least(a, b, c)))
    ordered = F.array_sort(F.array(*p), lambda x, y: F.when(x > y, -1).when(x < y, 1).otherwise(0))
    return -F.aggregate(ordered, F.lit(0.0), lambda a, x: a + _plogp(x))


def entropy_frequency(p: list[Column], classes: int) -> Column:
    """Normalised entropy of observed frequencies: null unless they sum to 1 within 1e-9; not clamped."""
    total = sum(p[1:], p[0])
    return F.when(F.abs(total - 1) <= FREQUENCY_TOLERANCE, plus_zero(entropy_sum(*p) / math.log(classes)))


def entropy_clamped(s: Column, c: Column, i: Column) -> Column:
    """Normalised entropy for weighting: exactly 1 for the exact uniform triple, else clamped to [0, 1]."""
    third = F.lit(1.0) / F.lit(3.0)
    uniform = (s == third) & (c == third) & (i == third)
    return F.when(uniform, 1.0).otherwise(F.least(F.lit(1.0), F.greatest(F.lit(0.0), entropy_sum(s, c, i) / math.log(3))))


def entropy_scores(s: Column, c: Column, i: Column, tolerance: float = TIE) -> Column:
    """Normalised entropy of model scores: null unless they sum to 1 within 1e-12."""
    return F.when(F.abs(s + c + i - 1) <= tolerance, plus_zero(entropy_sum(s, c, i) / math.log(3)))


def entropy_metric(s: Column, c: Column, i: Column) -> Column:
    """Normalised entropy inside metrics: nothing is checked."""
    return plus_zero(entropy_sum(s, c, i) / math.log(3))


def direction(s: Column, c: Column) -> Column:
    """Unconditional direction: what aggregation uses."""
    return s - c


def direction_conditional(s: Column, c: Column) -> Column:
    """Direction among directional mass; 0 where there is none."""
    return F.coalesce(ratio(s - c, s + c), F.lit(0.0))


def decide(score: Column, tolerance: float = 0.0) -> Column:
    """SUPPORT or CONTRADICT by sign; ABSTAIN for null and for what is within the tolerance of 0."""
    return F.when(score > tolerance, "SUPPORT").when(score < -tolerance, "CONTRADICT").otherwise("ABSTAIN")


def bound(value: Column, then) -> Column:
    """then(value), with value made once however often then names it."""
    return F.transform(F.array(value), then)[0]


def round12(c: Column) -> Column:
    """c to twelve digits as products and quotients of doubles give it; F.round goes by the decimal digits that are printed, which differs at halves."""
    return F.round(c * 1e12, 0) / 1e12


def fsum(values: Column) -> Column:
    """Sum of an array of doubles in its order with Neumaier's compensation; 0 for an empty one."""
    start = F.struct(F.lit(0.0).alias("s"), F.lit(0.0).alias("c"))

    def add(a: Column, x: Column) -> Column:
        t = a["s"] + x
        lost = F.when(F.abs(a["s"]) >= F.abs(x), (a["s"] - t) + x).otherwise((x - t) + a["s"])
        return F.struct(t.alias("s"), (a["c"] + lost).alias("c"))

    return F.aggregate(values, start, add, lambda a: plus_zero(a["s"] + a["c"]))


def ordered_values(order: list[Column], value: Column) -> Column:
    """Aggregate: an array of value in the given order, whatever the partitions did."""
    keys = [o.alias(f"k{j}") for j, o in enumerate(order)]
    return F.transform(F.array_sort(F.collect_list(F.struct(*keys, value.alias("v")))), lambda x: x["v"])
