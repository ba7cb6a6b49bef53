"""Stances from annotations, strict model output, class-token log probabilities and sentences."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quorumlake.functions.columns import STANCES, one_hot, valid_distribution

CODES = {"1": "SUPPORT", "2": "CONTRADICT", "3": "IRRELEVANT"}


def annotated(claims: DataFrame, stances: str = "stances", label: str = "option") -> DataFrame:
    """One-hot distributions from a map of annotations; a label without one is an error when the result is used."""
    found = F.try_element_at(F.col(stances), F.col(label))
    known = F.coalesce(found.isin(*STANCES), F.lit(False))
    checked = claims.withColumn("stance", found).filter(F.assert_true(known, F.concat(F.lit("no annotation for "), F.col(label))).isNull())
    return checked.withColumns(dict(zip(("p_s", "p_c", "p_i"), one_hot(F.col("stance")))))


#: JSON of one object of three members whose values are numbers; keys may be any strings.
_KEY, _NUMBER = r'"(?:[^"\\\x00-\x1F]|\\(?:["\\/bfnrt]|u[0-9A-Fa-f]{4}))*"', r"-?(?:0|[1-9][0-9]*)(?:\.[0-9]+)?(?:[eE][+-]?[0-9]+)?"
_BLANK = r"[\x20\t\n\r]*"
MEMBER = rf"{_BLANK}{_KEY}{_BLANK}:{_BLANK}{_NUMBER}{_BLANK}"
OBJECT = rf"\{{{MEMBER}(?:,{MEMBER})*\}}"


def strict_distribution(raw: Column) -> Column:
    """struct(p_s, p_c, p_i, error) of a model's answer: one JSON object with exactly the three stances.

    Rejected: prose or fences around it, repeated keys, NaN and infinities,
    booleans, other keys, values outside [0, 1], and sums off 1 by over 1e-6.
    The grammar is a pattern, which admits numbers only; as many members as
    there are different keys means that none is repeated.
    """
    bare = F.regexp_replace(F.coalesce(raw, F.lit("")), r"(?U)^\s+|\s+$", "")
    shaped = bare.rlike(rf"\A{OBJECT}\z")
    # Keys are read with their escapes; an answer of another shape is not parsed at all.
    keys = F.json_object_keys(F.when(shaped, bare))
    members = F.regexp_count(bare, F.lit(MEMBER))
    exact = F.coalesce((members == 3) & (F.array_sort(F.array_distinct(keys)) == F.array(*map(F.lit, sorted(STANCES)))), F.lit(False))
    given = F.from_json(F.when(shaped & exact, bare), ", ".join(f"{s} double" for s in STANCES))
    p = [given[s] for s in STANCES]
    inside = F.lit(True)
    for x in p:
        inside = inside & F.coalesce(x.between(0, 1), F.lit(False))
    sums = F.coalesce(F.abs(p[0] + p[1] + p[2] - 1) <= 1e-6, F.lit(False))
    error = F.when(~shaped, "not one object of numbers").when(~exact, "not exactly the three stances").when(~(inside & sums), "not a distribution")
    return F.struct(*[F.when(error.isNull(), x).alias(f"p_{k}") for k, x in zip("sci", p)], error.alias("error"))


def class_code(c: Column) -> Column:
    """The stance of an answer that is 1, 2 or 3 after trimming; null otherwise."""
    bare = F.trim(c)
    return F.when(bare == "1", CODES["1"]).when(bare == "2", CODES["2"]).when(bare == "3", CODES["3"])


def class_token(content: str, tokens: list[tuple[str, bytes]], thinking_end: str = "</think>") -> int:
    """The place of the token that holds the final class code, by byte offsets; raises if the bytes do not add up to the content.

    tokens: text and bytes of each; what stands before the end of thinking and
    white space around the code are passed over.
    """
    joined = b"".join(b for _, b in tokens)
    if joined != content.encode():
        raise ValueError("token bytes differ from the content")
    start = content.rfind(thinking_end)
    start = len(content[: start + len(thinking_end)].encode()) if start >= 0 else 0
    tail = joined[start:]
    code = tail.strip()
    if code.decode("utf-8", "replace") not in CODES:
        raise ValueError("no class code")
    want = start + tail.index(code)
    at = 0
    for k, (_, b) in enumerate(tokens):
        if at <= want < at + len(b):
            if b.strip() != code:
                raise ValueError("the class code shares its token")
            return k
        at += len(b)
    raise ValueError("class code outside the tokens")


def label_likelihoods(chosen: str, alternatives: list[tuple[str, float]]) -> tuple[float | None, float | None, float | None, str | None]:
    """Normalised likelihoods of the three class codes from one token's alternatives.

    Alternatives equal but for white space count once, with the largest; the
    chosen one must be largest, alone; a missing code leaves all undefined.
    """
    best: dict[str, float] = {}
    for text, logprob in alternatives:
        code = text.strip()
        if code in CODES and math.isfinite(logprob):
            best[code] = max(logprob, best.get(code, -math.inf))
    if set(best) != set(CODES):
        return None, None, None, "LOGPROB_INCOMPLETE"
    top = max(best.values())
    e = {c: math.exp(v - top) for c, v in best.items()}
    total = math.fsum(e.values())
    p = [e[c] / total for c in CODES]
    if sum(v == top for v in best.values()) > 1 or best.get(chosen.strip()) != top:
        return None, None, None, "CHOSEN_IS_NOT_LARGEST"
    return p[0], p[1], p[2], None


def sentence_max(sentences: DataFrame, keys: list[str]) -> DataFrame:
    """For each pair the sentence whose larger directional probability is largest, the earliest of equals, with its whole distribution.

    A pair with any sentence that failed, or with gaps in its indices, has
    status FAILED and no sentence.
    """
    strength = F.greatest("p_s", "p_c")
    best = F.min_by(F.struct("sentence_index", "p_s", "p_c", "p_i"), F.struct((-strength).alias("k"), "sentence_index"))
    whole = F.bool_and((F.col("status") == "SUCCESS") & valid_distribution(F.col("p_s"), F.col("p_c"), F.col("p_i"), 1e-9))
    dense = (F.min("sentence_index") == 0) & (F.max("sentence_index") + 1 == F.count_distinct("sentence_index"))
    got = sentences.groupBy(*keys).agg((whole & dense).alias("ok"), best.alias("b"))
    pick = lambda c: F.when(F.col("ok"), F.col(f"b.{c}")).alias(c)
    return got.select(*keys, F.when(F.col("ok"), "SUCCESS").otherwise("FAILED").alias("status"), *[pick(c) for c in ("sentence_index", "p_s", "p_c", "p_i")])


def truncation(tokens: Column, limits: list[Column]) -> tuple[Column, Column]:
    """The least finite limit, and how many tokens it removes; no limit removes none."""
    finite = [F.when((x > 0) & (x < 10**6), x) for x in limits]
    least = F.least(*finite, F.lit(None).cast("long")) if len(finite) == 1 else F.least(*finite)
    return least, F.greatest(F.coalesce(tokens - least, F.lit(0)), F.lit(0))
