"""Checks on records: frequencies, queries, key sets, references and paths."""

from __future__ import annotations

import math
import os
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quorumlake.functions.columns import TIE, argmax3, direction_conditional, entropy_frequency


def require(df: DataFrame, ok: Column, message: str) -> DataFrame:
    """df; a row that is not ok (or undecided) is an error when the result is used."""
    return df.filter(F.assert_true(F.coalesce(ok, F.lit(False)), F.lit(message)).isNull())


def frequency_ok(total: int = 10) -> Column:
    """Counts of the given total, probabilities, entropy and conditional direction that follow from them within 1e-12."""
    n, p = [F.col(f"n_{x}") for x in "sci"], [F.col(f"p_{x}") for x in "sci"]
    counts = (n[0] >= 0) & (n[1] >= 0) & (n[2] >= 0) & (n[0] + n[1] + n[2] == total)
    shares = (F.abs(p[0] - n[0] / total) <= TIE) & (F.abs(p[1] - n[1] / total) <= TIE) & (F.abs(p[2] - n[2] / total) <= TIE)
    derived = (F.abs(F.col("u_3") - entropy_frequency(p, 3)) <= TIE) & (F.abs(F.col("directional_score") - direction_conditional(p[0], p[1])) <= TIE)
    return F.coalesce(counts & shares & derived, F.lit(False))


def scores_ok(prediction: Column, s: Column, c: Column, i: Column) -> Column:
    """A distribution whose one exact maximum is the prediction."""
    return F.coalesce((F.abs(s + c + i - 1) <= 1e-6) & (argmax3(s, c, i, 0.0) == prediction), F.lit(False))


def orphans(child: DataFrame, parent: DataFrame, key: str) -> DataFrame:
    """Keys of child that parent does not have, sorted."""
    return child.select(key).distinct().join(parent.select(key), key, "left_anti").orderBy(key)


def key_differences(expected: DataFrame, observed: DataFrame, keys: list[str]) -> DataFrame:
    """Keys that are missing or unexpected."""
    missing = expected.select(*keys).distinct().join(observed.select(*keys), keys, "left_anti").withColumn("difference", F.lit("missing"))
    extra = observed.select(*keys).distinct().join(expected.select(*keys), keys, "left_anti").withColumn("difference", F.lit("unexpected"))
    return missing.unionByName(extra)


def repeated_keys(df: DataFrame, keys: list[str]) -> DataFrame:
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).filter("n > 1")


def one_line_query(raw: Column) -> Column:
    """A model's query: its one nonblank line without one pair of quotes, spaces collapsed.

    Null for several lines, lists, JSON, labels before it, fences and control characters.
    """
    lines = F.filter(F.split(raw, r"\r\n|\r|\n"), lambda x: F.trim(x) != "")
    one = F.trim(F.get(lines, F.lit(0)))
    bare = F.when(one.rlike("^\"[^\"]*\"$") | one.rlike("^'[^']*'$"), F.substr(one, F.lit(2), F.length(one) - 2)).otherwise(one)
    flat = F.trim(F.regexp_replace(bare, r"(?U)\s+", " "))
    bad = flat.rlike(r"^[\[{]") | flat.rlike(r"^(?:[-*•]|\d+[.)])\s") | flat.rlike(r"(?i)^(?:query|answer|output)\s*:") | flat.contains("```") | raw.rlike(r"[\x00-\x08\x0B\x0C\x0E-\x1F]")
    return F.when((F.size(lines) == 1) & ~bad & (flat != ""), flat)


def close(actual, expected, tolerance: float = 1e-12, at: str = "") -> None:
    """Raise unless two nested values are equal, numbers within the tolerance."""
    if isinstance(expected, dict):
        if not isinstance(actual, dict) or set(actual) != set(expected):
            raise ValueError(f"keys differ at {at or 'the top'}")
        for k in expected:
            close(actual[k], expected[k], tolerance, f"{at}.{k}")
    elif isinstance(expected, (list, tuple)):
        if not isinstance(actual, (list, tuple)) or len(actual) != len(expected):
            raise ValueError(f"lengths differ at {at or 'the top'}")
        for k, (a, e) in enumerate(zip(actual, expected)):
            close(a, e, tolerance, f"{at}[{k}]")
    elif isinstance(expected, float) and isinstance(actual, (int, float)) and not isinstance(actual, bool):
        if not (math.isclose(actual, expected, rel_tol=0, abs_tol=tolerance)):
            raise ValueError(f"{actual} is not {expected} at {at or 'the top'}")
    elif type(actual) is not type(expected) or actual != expected:
        raise ValueError(f"{actual!r} is not {expected!r} at {at or 'the top'}")


def inside(root: str, relative: str) -> str:
    """The path of a relative name under root; raises for absolute names and those that climb out."""
    if not relative or os.path.isabs(relative) or re.search(r"(^|[/\\])\.\.([/\\]|$)", relative):
        raise ValueError("not a path inside the project")
    full = os.path.realpath(os.path.join(root, relative))
    if os.path.commonpath([full, os.path.realpath(root)]) != os.path.realpath(root):
        raise ValueError("not a path inside the project")
    return full
