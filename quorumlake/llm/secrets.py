"""Secret scans: fixed key patterns and sliding-window entropy.  DataFrame functions only."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The base kinds in their order, what each matches and which matches count.
ASSIGN = r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
LEAST_ASSIGNED = 8
#: A run of 16 with its prefix, and the whole run of 32: shorter runs fail as a whole, so the least length stands in the pattern.
ACCESS = r"AKIA[A-Z0-9]{12,}"
HEX = r"[0-9a-f]{32,}"
KINDS = ["assign", "access", "hex", "entropy"]

#: Candidates of the entropy scan: whole runs of 20 or more characters of the base64 alphabets, with digits and letters or letters of both cases.
RUN = r"(?<![A-Za-z0-9+/_=-])(?=[A-Za-z0-9+/_=-]{20})(?:(?=[A-Za-z+/_=-]*[0-9])(?=[0-9+/_=-]*[A-Za-z])|(?=[A-Z+/_=-]*[a-z])(?=[a-z+/_=-]*[A-Z]))[A-Za-z0-9+/_=-]+"
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"
#: Least entropy in bits of a window of 20 characters, by the narrowest class that holds the candidate.
WINDOW = 20
CLASSES = [("hex", r"^[0-9a-fA-F]+$", 2.9), ("alnum", r"^[A-Za-z0-9]+$", 3.5), ("base64", r"^", 3.7)]
#: Candidates that are no secrets: UUIDs, dates and version strings, words joined by marks, paths of words, words joined by capitals, documentation keys.
ALLOWED = [
    r"^[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}$",
    r"^[0-9+/_=-]*$",
    r"^(?:[A-Za-z]*+[0-9]{0,4}+[/_=-]++)++[A-Za-z]*+[0-9]{0,4}+$",
    r"^(?:[A-Z]{0,4}+[a-z]{3,}+)++[A-Z]{0,4}+$",
    r"(?i)example|placeholder|changeme|xxxx",
    r"^(.)\1*$",
]
#: Running sums are made by parts of so many places; searches halve their step so often, as no text has 2**28 matches.
PART, DOUBLINGS = 256, 28
#: Counts of a window are kept five bits each, twelve to an integer.
BITS, SLOTS = 5, 12


def let(value: Column, body) -> Column:
    """body(value) with value computed once."""
    return F.transform(F.array(value), body)[0]


def sums(sizes: Column) -> Column:
    """Sums of an array up to and with each place; quadratic, so for short arrays only."""
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("out"))
    step = lambda acc, x: F.struct((acc["at"] + x).alias("at"), F.concat(acc["out"], F.array(acc["at"] + x)).alias("out"))
    return F.aggregate(sizes, start, step, lambda acc: acc["out"])


def running(sizes: Column) -> Column:
    """sums for arrays of any length: those of short parts, then those of the parts' totals."""
    parts = F.transform(F.sequence(F.lit(0), F.floor((F.size(sizes) - 1) / PART).cast("int")), lambda k: sums(F.slice(sizes, k * PART + 1, PART)))
    whole = lambda each, before: F.flatten(F.transform(each, lambda p, k: F.transform(p, lambda x: x + F.coalesce(F.get(before, k - 1), F.lit(0)))))
    return let(parts, lambda each: let(sums(F.transform(each, lambda p: F.element_at(p, -1))), lambda before: whole(each, before)))


def spans(text: Column, pattern: str, kind: int, counts=None) -> Column:
    """array of (start, kind, end, hit): leftmost non-overlapping matches in code points, end exclusive.

    What stands between matches and the matches themselves give all offsets.
    counts(hit) says which matches stay.
    """
    none = F.array().cast("array<struct<start:int,kind:int,end:int,hit:string>>")
    ends = lambda hits, between: let(F.transform(hits, lambda x, i: F.length(F.get(between, i)) + F.length(x)), running)
    one = lambda hit, end: F.struct((end - F.length(hit)).alias("start"), F.lit(kind).alias("kind"), end.alias("end"), hit.alias("hit"))
    found = let(F.regexp_extract_all(text, F.lit(pattern), 0), lambda hits: let(F.split(text, pattern, -1), lambda between: F.zip_with(hits, ends(hits, between), one)))
    found = F.when(text.rlike(pattern), found).otherwise(none)
    return F.filter(found, lambda x: counts(x["hit"])) if counts is not None else found


def coded(hit: Column) -> Column:
    """Where each character of a candidate is counted: the cell, and the unit that adds one there."""
    places = F.array(*(F.struct(F.lit(k // SLOTS).alias("cell"), F.lit(1 << BITS * (k % SLOTS)).cast("long").alias("unit")) for k in range(len(ALPHABET))))
    return F.transform(F.slice(F.split(hit, ""), 1, F.length(hit)), lambda c: F.get(places, F.position(c, F.lit(ALPHABET)) - 1))


def entropy_span(codes: Column, level: Column) -> Column:
    """(first, end) over all windows of coded characters with entropy of at least level bits; first is -1 if there is none.

    One pass: the counts of the characters and the sum of c*log2(c) change only
    by the character that enters the window and the one that leaves it.  Each
    step judges the window that the step before completed.
    """
    log = lambda c: c * math.log2(c) if c else 0.0
    gains = F.array(*(F.lit(log(c + 1) - log(c)) for c in range(WINDOW + 2)))
    cells = -(-len(ALPHABET) // SLOTS)
    zero = F.struct(F.array(*[F.lit(0).cast("long")] * cells).alias("counts"), F.lit(0.0).alias("sum"), F.lit(-1).alias("first"), F.lit(-1).alias("end"))
    count = lambda counts, cell, unit: F.call_function("div", F.get(counts, cell), unit).bitwiseAND(F.lit((1 << BITS) - 1).cast("long")).cast("int")
    nothing = F.lit(0).cast("long")
    moves = F.transform(codes, lambda c, i: F.struct(i.alias("i"), c["cell"].alias("cell"), c["unit"].alias("unit"), F.get(codes, i - WINDOW)["cell"].alias("cell2"), F.get(codes, i - WINDOW)["unit"].alias("unit2")))
    # log2(WINDOW) - sum / WINDOW >= level, without a division for each character.
    hot = lambda acc: acc["sum"] <= (F.lit(math.log2(WINDOW)) - level) * WINDOW + F.lit(1e-9)

    def step(acc: Column, x: Column) -> Column:
        counts = acc["counts"]
        entered = F.transform(counts, lambda n, k: n + F.when(k == x["cell"], x["unit"]).otherwise(nothing) - F.when(k == x["cell2"], x["unit2"]).otherwise(nothing))
        same = F.when((x["cell"] == x["cell2"]) & (x["unit"] == x["unit2"]), 0).otherwise(-1)
        lost = F.when(x["i"] < WINDOW, 0.0).otherwise(F.get(gains, count(counts, x["cell2"], x["unit2"]) + same))
        total = acc["sum"] + F.get(gains, count(counts, x["cell"], x["unit"])) - lost
        now = (x["i"] >= WINDOW) & hot(acc)
        first = F.when((acc["first"] < 0) & now, x["i"] - WINDOW).otherwise(acc["first"])
        return F.struct(entered.alias("counts"), total.alias("sum"), first.alias("first"), F.when(now, x["i"]).otherwise(acc["end"]).alias("end"))

    n = F.size(codes)
    last = lambda acc: F.struct(F.when((acc["first"] < 0) & hot(acc), n - WINDOW).otherwise(acc["first"]).alias("first"), F.when(hot(acc), n).otherwise(acc["end"]).alias("end"))
    return F.aggregate(moves, zero, step, last)


def covered(base: Column, start: Column, end: Column) -> Column:
    """(low, high) that sorted, disjoint spans cover of start-end, null if none meets it: two searches by halves."""
    steps = F.array(*(F.lit(1 << k) for k in range(DOUBLINGS)))
    halves = F.sequence(F.floor(F.log2(F.size(base))).cast("int"), F.lit(0), F.lit(-1))

    def before(passes) -> Column:
        # How many spans at the front pass.
        seek = lambda at, k: F.when(F.coalesce(passes(F.get(base, at + F.get(steps, k) - 1)), F.lit(False)), at + F.get(steps, k)).otherwise(at)
        return F.aggregate(halves, F.lit(0), seek)

    span = lambda first: F.when(first["start"] < end, F.struct(first["start"].alias("low"), F.get(base, before(lambda b: b["start"] < end) - 1)["end"].alias("high")))
    return F.when(F.size(base) > 0, let(F.get(base, before(lambda b: b["end"] <= start)), span))


def scan_secrets(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", allowed: list[str] = ALLOWED) -> DataFrame:
    """id, base and found: arrays of (start, kind, end) by start, then kind; kind is a place in KINDS.

    base has the matches of the fixed patterns, found also the entropy scan's:
    candidate runs that no allow-list pattern suppresses, from the first to the
    end of the last window of high entropy; where base matches overlap a run,
    what is left of it before and after them is scanned.  Null and empty texts have none.  Repeated rows give a row each, null ids stay
    null, an empty table gives no rows; other columns are not read.  Row by row,
    so nothing is shuffled, and texts are scanned whole.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    plain = lambda array: F.transform(array, lambda x: F.struct(x["start"].alias("start"), x["kind"].alias("kind"), x["end"].alias("end")))
    # On the hit alone the second group is what it was in the text: the hit ends with it.
    assigned = spans(text, ASSIGN, 0, lambda hit: F.length(F.regexp_extract(hit, ASSIGN, 2)) >= LEAST_ASSIGNED)
    hidden = spans(text, RUN, 3, lambda hit: ~_any(hit, allowed))
    scanned = rows.select("id", plain(assigned).alias("k0"), plain(spans(text, ACCESS, 1)).alias("k1"), plain(spans(text, HEX, 2)).alias("k2"), hidden.alias("hidden"))

    def uncovered(x: Column) -> Column:
        # What base matches cover of a candidate is theirs; the rest before and after them is looked at.
        start, end = x["start"], x["end"]
        met = [covered(F.col(k), start, end) for k in ("k0", "k1", "k2")]
        part = lambda a, b: F.struct(a.alias("start"), F.substr(x["hit"], a - start + 1, b - a).alias("hit"), _level(x["hit"]).alias("level"))
        around = lambda low, high: F.when(low.isNull(), F.array(part(start, end))).otherwise(F.array(part(start, F.greatest(low, start)), part(F.least(high, end), end)))
        return let(F.array(*met), lambda m: around(F.array_min(F.transform(m, lambda c: c["low"])), F.array_max(F.transform(m, lambda c: c["high"]))))

    parts = F.filter(F.flatten(F.transform("hidden", uncovered)), lambda x: F.length(x["hit"]) >= WINDOW)
    hot = F.transform(parts, lambda x: let(coded(x["hit"]), lambda c: let(entropy_span(c, x["level"]), lambda at: F.struct((x["start"] + at["first"]).alias("start"), F.lit(3).alias("kind"), (x["start"] + at["end"]).alias("end"), (at["first"] >= 0).alias("hot")))))
    added = plain(F.filter(hot, lambda x: x["hot"]))
    base = F.sort_array(F.concat("k0", "k1", "k2"))
    return scanned.select(F.col("id").alias(id_col), base.alias("base"), F.when(F.size("hidden") == 0, base).otherwise(F.sort_array(F.concat("k0", "k1", "k2", added))).alias("found"))


def _any(hit: Column, patterns: list[str]) -> Column:
    found = F.lit(False)
    for p in patterns:
        found = found | hit.rlike(p)
    return found


def _level(hit: Column) -> Column:
    level = F.lit(CLASSES[-1][2])
    for _, pattern, least in reversed(CLASSES[:-1]):
        level = F.when(hit.rlike(pattern), F.lit(least)).otherwise(level)
    return level


def listed(array: Column) -> Column:
    """kind:start:end, comma-joined."""
    names = F.array(*map(F.lit, KINDS))
    return F.concat_ws(",", F.transform(array, lambda x: F.concat_ws(":", F.get(names, x["kind"]), x["start"].cast("string"), x["end"].cast("string"))))


def secret_report(docs: DataFrame, **given) -> DataFrame:
    """Counts of the base kinds, a digest of the base spans, and all spans, for every row of docs; see scan_secrets."""
    found = scan_secrets(docs, **given)
    count = lambda kind: F.size(F.filter("base", lambda x: x["kind"] == kind)).cast("long")
    return found.select(
        found.columns[0], count(0).alias("n_assign"), count(1).alias("n_access"), count(2).alias("n_hex"),
        F.sha2(listed(F.col("base")), 256).alias("base_sha256"), listed(F.col("found")).alias("spans"), (F.size("found") - F.size("base")).cast("long").alias("n_entropy"),
    )
