"""Error detection, risk-coverage, classification and description of distributions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quorumlake.functions.columns import STANCES, entropy_metric, ratio
from quorumlake.shared import settled


def in_ranges(rows: DataFrame, order: list, parts: int | None = None) -> DataFrame:
    """rows with _range, the number of their range partition in the order, settled before anything else reads it.

    A range exchange draws its bounds from a sample, so two branches of a plan
    that each make their own would not agree on which row is in which range.
    """
    n = parts or int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return settled(rows.repartitionByRange(n, *order).withColumn("_range", F.spark_partition_id()))


def running(rows: DataFrame, order: list, sums: list[str], parts: int | None = None) -> DataFrame:
    """rows with before_x and all_x for each x of sums: its total over all rows before, in the order, and over all rows.

    Ranges are summed apart and shifted; rows that tie in the order must not matter.
    """
    dealt = in_ranges(rows, order, parts)
    inside = Window.partitionBy("_range").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    whole = dealt.groupBy("_range").agg(*[F.sum(x).alias(f"_t_{x}") for x in sums])
    # One row for each range.
    earlier, every = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy()
    shifts = whole.select("_range", *[F.coalesce(F.sum(f"_t_{x}").over(earlier), F.lit(0)).alias(f"_s_{x}") for x in sums], *[F.sum(f"_t_{x}").over(every).alias(f"all_{x}") for x in sums])
    found = dealt.withColumns({f"_o_{x}": F.coalesce(F.sum(x).over(inside), F.lit(0)) for x in sums}).join(F.broadcast(shifts), "_range")
    return found.withColumns({f"before_{x}": F.col(f"_o_{x}") + F.col(f"_s_{x}") for x in sums}).drop("_range", *[f"_o_{x}" for x in sums], *[f"_s_{x}" for x in sums])


def by_score(rows: DataFrame, score: str, error: str) -> DataFrame:
    """Each distinct score with its errors e and correct rows c, those below it and those of all."""
    by = rows.groupBy(score).agg(F.count_if(error).alias("e"), F.count_if(~F.col(error)).alias("c"))
    return running(by, [F.col(score)], ["e", "c"])


def area(e: str = "e", c: str = "c") -> Column:
    """Of by_score's rows: errors meet the correct rows below them, those of their own score by half."""
    return ratio(F.sum(F.col(e) * (F.col(f"before_{c}") + F.col(c) / 2.0)), F.sum(e) * F.sum(c))


def precision_sum(e: str = "e", c: str = "c") -> Column:
    """Of by_score's rows: recall steps times the precision from a score upwards."""
    caught = F.col(f"all_{e}") - F.col(f"before_{e}")
    return ratio(F.sum(F.col(e) * caught / (caught + F.col(f"all_{c}") - F.col(f"before_{c}"))), F.sum(e))


def auroc(rows: DataFrame, score: str = "u", error: str = "error") -> DataFrame:
    """P(score of an error > score of a correct row), ties one half; null if a class is absent.

    By distinct score, not by pairs; running sums are made by ranges of scores.
    """
    return by_score(rows, score, error).agg(area().alias("auroc"))


def average_precision(rows: DataFrame, score: str = "u", error: str = "error") -> DataFrame:
    """Sum of recall steps times precision over falling scores, equal scores as one step; null without errors."""
    return by_score(rows, score, error).agg(precision_sum().alias("average_precision"))


def error_detection(rows: DataFrame, score: str = "u", error: str = "error") -> DataFrame:
    """AUROC and average precision with their status, and prevalence, from one pass over the distinct scores."""
    n, errors = F.coalesce(F.sum(F.col("e") + F.col("c")), F.lit(0)), F.coalesce(F.sum("e"), F.lit(0))
    both = by_score(rows, score, error).agg(n.alias("n"), errors.alias("errors"), ratio(errors, n).alias("prevalence"), area().alias("auroc"), precision_sum().alias("average_precision"))
    status = lambda c: F.when(F.col(c).isNull(), "NA").otherwise("OK")
    reason = F.when(F.col("errors") == 0, "no errors").when(F.col("errors") == F.col("n"), "no correct rows")
    return both.withColumns({"auroc_status": status("auroc"), "ap_status": status("average_precision"), "reason": reason})


def retained(rows: DataFrame, order: list, coverages: list[float], keep) -> DataFrame:
    """Each row with every coverage that keeps it; keep(n, coverage) is how many rows stay.

    The place comes from a count by range partition and a window inside each, so
    no single task sorts all rows: see ranked.
    """
    placed = ranked(rows, order)
    n = placed.agg(F.count(F.lit(1)).alias("n"))
    grid = placed.crossJoin(F.broadcast(n)).withColumn("coverage", F.explode(F.array(*map(F.lit, coverages))))
    return grid.filter(F.col("place") <= keep(F.col("n"), F.col("coverage")))


def ranked(rows: DataFrame, order: list[str], parts: int | None = None) -> DataFrame:
    """place, 1 to n in the order: ranges are numbered apart and shifted by what stands before them."""
    dealt = in_ranges(rows, order, parts)
    inside = dealt.withColumn("_at", F.row_number().over(Window.partitionBy("_range").orderBy(*order)))
    sizes = dealt.groupBy("_range").agg(F.count(F.lit(1)).alias("_n"))
    # One row for each range.
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    shifts = sizes.select("_range", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    return inside.join(F.broadcast(shifts), "_range").withColumn("place", F.col("_at") + F.col("_before")).drop("_range", "_at", "_before")


def risk_coverage(rows: DataFrame, coverages: list[float], order: list[str], score: str = "u", error: str = "error") -> DataFrame:
    """Accuracy and risk of the least uncertain ceil(n * coverage) rows."""
    kept = retained(rows, order, coverages, lambda n, c: F.ceil(n * c - 1e-9))
    wrong = F.avg(F.col(error).cast("double"))
    return kept.groupBy("coverage").agg(F.count(F.lit(1)).alias("retained"), F.round(1 - wrong, 9).alias("accuracy"), F.round(wrong, 9).alias("risk"), F.max(score).alias("max_score"))


def selective(rows: DataFrame, coverages: list[float], order: list[str]) -> DataFrame:
    """Accuracy and macro-F1 of the least uncertain rows, their number rounded half to even."""
    kept = retained(rows, order, coverages, lambda n, c: F.bround(n * c))
    return classification(kept, ["coverage"])


def classification_columns(ref: str = "ref", guess: str = "guess") -> list[Column]:
    """n, accuracy and macro_f1 over the three stances; an absent class has F1 0."""
    r, g = F.col(ref), F.col(guess)
    parts = [F.coalesce(ratio(2 * F.count_if((r == s) & (g == s)), F.count_if(r == s) + F.count_if(g == s)), F.lit(0.0)) for s in STANCES]
    return [F.count(F.lit(1)).alias("n"), F.round(ratio(F.count_if(r == g), F.count(F.lit(1))), 9).alias("accuracy"), F.round((parts[0] + parts[1] + parts[2]) / 3, 9).alias("macro_f1")]


def classification(rows: DataFrame, keys: list[str], ref: str = "ref", guess: str = "guess") -> DataFrame:
    """Count, accuracy and macro-F1 over the three stances; an absent class has F1 0."""
    return rows.groupBy(*keys).agg(*classification_columns(ref, guess))


def side_by_side(predictions: DataFrame, reference: DataFrame, keys: list[str], methods: list[str]) -> DataFrame:
    """One row for each pair: batch, ref, each method's guess, `right` (a bit for each method that is right) and `differ`.

    predictions: keys, method, guess; reference: keys, batch, ref.  A pair without
    a guess of every method, or with two, is an error when the result is used.
    """
    wide = predictions.groupBy(*keys).pivot("method", methods).agg(F.struct(F.min("guess").alias("guess"), F.count("guess").alias("n")))
    whole, right, guesses = F.lit(True), F.lit(0), []
    for k, m in enumerate(methods):
        whole = whole & F.coalesce(F.col(m)["n"] == 1, F.lit(False))
        right = right + F.when(F.col(m)["guess"] == F.col("ref"), F.lit(1 << k)).otherwise(0)
        guesses.append(F.col(m)["guess"])
    both = reference.join(wide, keys, "left").filter(F.assert_true(whole, F.lit("a pair needs one guess of every method")).isNull())
    return both.select(*keys, "batch", "ref", *[g.alias(m) for m, g in zip(methods, guesses)], right.alias("right"), (F.size(F.array_distinct(F.array(*guesses))) > 1).alias("differ"))


def _batch() -> Column:
    return F.when(F.grouping("batch") == 1, F.lit("combined")).otherwise(F.col("batch")).alias("batch")


def batch_metrics(wide: DataFrame, methods: list[str]) -> DataFrame:
    """batch and method with n, accuracy and macro_f1: each batch and all together (`combined`) from one aggregation."""
    each = wide.select("batch", "ref", F.explode(F.array(*[F.struct(F.lit(m).alias("method"), F.col(m).alias("guess")) for m in methods])).alias("x")).select("batch", "ref", "x.*")
    sets = each.groupingSets([["batch", "method"], ["method"]], "batch", "method").agg(_batch().alias("part"), *classification_columns())
    return sets.drop("batch").withColumnRenamed("part", "batch").select("batch", "method", "n", "accuracy", "macro_f1")


def agreement(wide: DataFrame, methods: list[str]) -> DataFrame:
    """By batch and combined: pairs, those that all methods have right or wrong, and those on which they differ."""
    every = (1 << len(methods)) - 1
    sets = wide.groupingSets([["batch"], []], "batch").agg(_batch().alias("part"), F.count(F.lit(1)).alias("pairs"), F.count_if(F.col("right") == every).alias("all_right"), F.count_if(F.col("right") == 0).alias("all_wrong"), F.count_if("differ").alias("differ"))
    return sets.drop("batch").withColumnRenamed("part", "batch")


def right_patterns(wide: DataFrame) -> DataFrame:
    """How many pairs of each batch, and combined, have each pattern of right methods."""
    sets = wide.groupingSets([["batch", "right"], ["right"]], "batch", "right").agg(_batch().alias("part"), F.count(F.lit(1)).alias("pairs"))
    return sets.drop("batch").withColumnRenamed("part", "batch").select("batch", "right", "pairs")


def contradictions(wide: DataFrame, methods: list[str]) -> DataFrame:
    """ref, method, guess and pairs where either is CONTRADICT."""
    each = wide.select("ref", F.explode(F.array(*[F.struct(F.lit(m).alias("method"), F.col(m).alias("guess")) for m in methods])).alias("x")).select("ref", "x.*")
    return each.filter((F.col("ref") == "CONTRADICT") | (F.col("guess") == "CONTRADICT")).groupBy("ref", "method", "guess").agg(F.count(F.lit(1)).alias("pairs"))


def confusion(rows: DataFrame, keys: list[str], ref: str = "ref", guess: str = "guess") -> DataFrame:
    return rows.groupBy(*keys, ref).agg(*[F.count_if(F.col(guess) == s).alias(f"as_{s.lower()}") for s in STANCES])


def per_class(rows: DataFrame, ref: str = "ref", guess: str = "guess") -> DataFrame:
    """Precision, recall, F1 and support of each stance; 0 where undefined."""
    r, g, c = F.col(ref), F.col(guess), F.col("class")
    each = rows.select(ref, guess, F.explode(F.array(*map(F.lit, STANCES))).alias("class"))
    tp, fp, fn = F.count_if((r == c) & (g == c)), F.count_if((r != c) & (g == c)), F.count_if((r == c) & (g != c))
    zero = lambda x: F.round(F.coalesce(x, F.lit(0.0)), 9)
    return each.groupBy("class").agg(zero(ratio(tp, tp + fp)).alias("precision"), zero(ratio(tp, tp + fn)).alias("recall"), zero(ratio(2 * tp, 2 * tp + fp + fn)).alias("f1"), (tp + fn).alias("support"))


def probability_metrics(rows: DataFrame, ref: str, s: Column, c: Column, i: Column) -> DataFrame:
    """Multiclass Brier, negative log likelihood (infinite if a right class has probability 0), entropies, one-hot and distinct triplets."""
    right = F.when(F.col(ref) == "SUPPORT", s).when(F.col(ref) == "CONTRADICT", c).otherwise(i)
    brier = sum(((p - F.when(F.col(ref) == x, 1.0).otherwise(0.0)) ** 2 for p, x in zip((s, c, i), STANCES)), F.lit(0.0))
    h = entropy_metric(s, c, i)
    r = lambda x: F.round(x, 6)
    nll = F.when(F.count_if(right == 0) > 0, F.lit("Infinity")).otherwise(F.format_string("%.6f", F.avg(F.when(right > 0, -F.ln(F.when(right > 0, right))))))
    return rows.agg(
        F.count(F.lit(1)).alias("n"), r(F.avg(brier)).alias("brier"), nll.alias("nll"), r(F.avg(h)).alias("mean_entropy"), r(F.median(h)).alias("median_entropy"),
        F.count_if(F.greatest(s, c, i) == 1).alias("one_hot"), F.count_distinct(F.struct(s.alias("s"), c.alias("c"), i.alias("i"))).alias("triplets"),
    )


def describe(rows: DataFrame, value: str, keys: list[str]) -> DataFrame:
    """count, mean, median, least, largest, sample deviation: 0 for one value, null for none."""
    v = F.col(value)
    r = lambda x: F.round(x, 9)
    spread = F.when(F.count(v) == 1, 0.0).otherwise(F.stddev_samp(v))
    return rows.groupBy(*keys).agg(F.count(v).alias("n"), r(F.avg(v)).alias("mean"), r(F.median(v)).alias("median"), F.min(v).alias("least"), F.max(v).alias("largest"), r(spread).alias("deviation"))


def entropy_bucket(h: Column) -> Column:
    return F.when(h < 0.05, "[0,0.05)").when(h < 0.25, "[0.05,0.25)").when(h <= 0.5, "[0.25,0.5]").otherwise("(0.5,1]")


def exact_match(pairs: DataFrame, ref: str, guess: str) -> DataFrame:
    """Share of pairs equal but for case and surrounding white space."""
    norm = lambda c: F.lower(F.trim(F.col(c)))
    return pairs.agg(F.count(F.lit(1)).alias("n"), F.round(F.avg((norm(ref) == norm(guess)).cast("double")), 9).alias("exact_match"))
