"""Quality rules from tokeniser fertility: how a public vocabulary cuts a text."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quorumlake.llm.common import cut, kept_in_worker, pieces, texts_of
from quorumlake.llm.tokens import load

#: Token entropy grows with a text's length, so lists of words are told by windows of this many tokens; a text's
#: figure is the mean over windows that cover it.
WINDOW = 128
#: How many sampling spreads, and which share of the median besides, a figure may be off its language's median.
SPREADS, MARGIN = 6.0, 0.12
#: Labelled good documents that a language's band is fitted on at least.
LEAST = 50


class Band(NamedTuple):
    """What good text of a language looks like.

    Medians of characters per token and tokens per word with their spread for a
    single word (a text of n words has it by the root of n), the most
    byte-fallback tokens, the least token entropy in bits, the median entropy of
    windows, and the script.
    """

    cpt: float
    cpt_spread: float
    tpw: float
    tpw_spread: float
    share: float
    entropy: float
    bits: float
    script: str = "latin"


#: Bands for tables without labels, and for languages with too few of them: medians and spreads of labelled good text.
BANDS = {
    "en": Band(2.64, 0.77, 2.27, 1.25, 0.08, 5.3, 5.89),
    "de": Band(2.63, 0.73, 2.45, 1.24, 0.08, 5.3, 5.81),
    "fr": Band(2.35, 0.74, 2.55, 1.58, 0.08, 5.2, 5.77),
    "es": Band(2.30, 0.64, 2.69, 1.41, 0.08, 5.3, 5.78),
}
#: Fixed limits of any other script: characters per token (least, most), byte share (most) and entropy (least).
OTHER = (0.25, 12.0, 0.95, 3.0)
SYMBOLS = "#*$%&|<>"
BLANK = " \t\n\x0b\x0c\r"
OUT = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, chars_per_token double, tokens_per_word double, byte_share double, token_entropy double, base_failed boolean"
#: What bands are fitted on and texts are judged by besides.
BESIDES = "n_tokens long, bits double, script string"


def base_rules(text: str, raw: bytes) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words."""
    words = raw.split()
    n = len(words)
    chars = len(text) - sum(map(text.count, BLANK))
    symbols = sum(map(text.count, SYMBOLS))
    lines = [x for x in text.split("\n") if x.strip(BLANK)]
    windows = list(zip(words, words[1:], words[2:]))
    repeated = 0
    if len(set(windows)) < len(windows):
        times = Counter(windows)
        again = np.fromiter((times[w] > 1 for w in windows), bool, len(windows))
        hit = np.zeros(n, bool)
        for k in range(3):
            hit[k : k + len(windows)] |= again
        repeated = int(hit.sum())
    return n, chars, symbols, len(lines) - len(set(lines)), repeated


def fertility(ids: np.ndarray, n_chars: int, n_words: int, low: int, high: int) -> tuple[float, float, float, float]:
    """Characters per token, tokens per word, share of byte-fallback tokens of non-ASCII bytes, token entropy in bits."""
    if not len(ids):
        return 0.0, 0.0, 0.0, 0.0
    a = np.asarray(ids)
    # The vocabulary's byte tokens are consecutive; those under 0x80 only stand for controls such as the line feed.
    share = float(((a >= low) & (a <= high)).mean())
    p = np.unique(a, return_counts=True)[1] / len(a)
    return n_chars / len(a), len(a) / max(n_words, 1), share, float(-(p * np.log2(p)).sum())


def byte_range(coder) -> tuple[int, int]:
    """The ids of byte tokens from 0x80 on; none for a vocabulary without them."""
    return (min(coder.byte) + 128, max(coder.byte)) if getattr(coder, "byte", None) else (1, 0)


LETTERS = re.compile(r"[^\W\d_]+")
LATIN = re.compile("[A-Za-z\u00aa\u00ba\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u024f\u1e00-\u1eff]+")


def script_of(text: str) -> str:
    """"latin" where over half of the letters are Latin, otherwise ""."""
    if text.isascii():
        return "latin" if LETTERS.search(text) else ""
    return "latin" if 2 * sum(map(len, LATIN.findall(text))) > sum(map(len, LETTERS.findall(text))) else ""


def window_entropy(ids: np.ndarray) -> float:
    """Mean token entropy in bits of windows of WINDOW tokens spread evenly over the text, the whole text if it is shorter."""
    n = len(ids)
    if not n:
        return 0.0
    w = min(n, WINDOW)
    starts = np.linspace(0, n - w, -(-n // w)).astype(np.int64)
    rows = np.sort(np.asarray(ids, np.int32)[starts[:, None] + np.arange(w)], axis=1)
    first = np.ones(rows.shape, bool)
    np.not_equal(rows[:, 1:], rows[:, :-1], out=first[:, 1:])
    c = np.diff(np.flatnonzero(first), append=rows.size)
    return float(np.log2(w) - (c * np.log2(c)).sum() / rows.size)


def measure(docs: DataFrame, path: str, *, id_col: str, match_col: str, text_col: str, lang_col: str | None, least_words: int) -> DataFrame:
    """One row for each document, without its text: id, match, lang, the columns of OUT and those of BESIDES (0 and "" where the base rules fail)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = kept_in_worker(("coder", path), lambda: load(path))
        low, high = byte_range(coder)
        for whole in batches:
            for batch in pieces(whole, 1 << 20):
                raw = texts_of(batch)
                texts = [x.decode() for x in raw]
                rows = []
                for t, b, ids in zip(texts, raw, coder.arrays(texts)):
                    base = base_rules(t, b)
                    n, repeated = base[0], base[4]
                    failed = n < least_words or 100 * repeated > 50 * n
                    besides = (0.0, "") if failed else (window_entropy(ids), script_of(t))
                    rows.append((*base, *fertility(ids, len(t), n, low, high), failed, len(ids), *besides))
                kinds = [pa.int64()] * 5 + [pa.float64()] * 4 + [pa.bool_(), pa.int64(), pa.float64(), pa.string()]
                cols = [pa.array(c, k) for c, k in zip(zip(*rows), kinds)]
                names = [x.split()[0] for x in f"{OUT}, {BESIDES}".split(", ")]
                yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in ("id", "match", "lang")), *cols], ["id", "match", "lang", *names])

    lang = F.col(lang_col).cast("string") if lang_col in docs.columns else F.lit(None).cast("string")
    rows = docs.select(F.col(id_col).alias("id"), F.col(match_col).alias("match"), lang.alias("lang"), F.col(text_col).alias("text"))
    kind = {c: rows.schema[c].dataType.simpleString() for c in ("id", "match")}
    return rows.mapInArrow(run, f"id {kind['id']}, match {kind['match']}, lang string, {OUT}, {BESIDES}")


def quantiles(rows: DataFrame, group: str, wanted: dict[str, float]) -> DataFrame:
    """One row for each group with the exact quantile of each wanted column, interpolated between its neighbours.

    Equal values are counted together first; different ones are ranked by
    ranges, so no task holds a group.  Groups and values must not be null.
    """
    counts = rows.unpivot([group], [*wanted], "_what", "_x").groupBy(group, "_what", "_x").agg(F.count(F.lit(1)).alias("_n"))
    placed = cut(counts.repartitionByRange(group, "_what", "_x").withColumn("_part", F.spark_partition_id()))
    key = ["_part", group, "_what"]
    own = F.sum("_n").over(Window.partitionBy(*key).orderBy("_x").rowsBetween(Window.unboundedPreceding, 0))
    # As many rows as there are partitions, and one more for each group and column.
    whole = Window.partitionBy(group, "_what")
    before = F.coalesce(F.sum("_size").over(whole.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    sizes = placed.groupBy(*key).agg(F.sum("_n").alias("_size")).select(*key, before.alias("_before"), (F.sum("_size").over(whole) - 1).alias("_last"))
    at = F.coalesce(*(F.when(F.col("_what") == k, F.lit(p)) for k, p in wanted.items())) * F.col("_last")
    ranked = placed.withColumn("_own", own).join(F.broadcast(sizes), key).withColumn("_at", at).withColumn("_end", F.col("_before") + F.col("_own"))
    under, over = (F.min(F.when(F.col("_end") > place, F.col("_x"))) for place in (F.floor("_at"), F.ceil("_at")))
    found = ranked.groupBy(group, "_what").agg(under.alias("_under"), over.alias("_over"), F.max(F.col("_at") - F.floor("_at")).alias("_part"))
    value = F.when(F.col("_under") == F.col("_over"), F.col("_under")).otherwise((1 - F.col("_part")) * F.col("_under") + F.col("_part") * F.col("_over"))
    return found.groupBy(group).agg(*(F.max(F.when(F.col("_what") == k, value)).alias(k) for k in wanted))


def bands_of(measured: DataFrame, labels: DataFrame, *, match_col: str, good_col: str, most: int | None, least: int, bands: dict[str, Band]) -> dict[str, Band]:
    """Bands by language from the measured rows that labels call good; see fit_bands."""
    good = labels.filter(F.col(good_col) == 1).select(F.col(match_col).alias("_good")).filter("_good IS NOT NULL").distinct()
    if most is not None:
        good = good.orderBy(F.xxhash64("_good"), "_good").limit(most)
    sound = measured.filter("NOT base_failed AND lang IS NOT NULL").join(good, F.col("match") == F.col("_good"), "left_semi")
    names = {"n_words": "n", "chars_per_token": "cpt", "tokens_per_word": "tpw", "byte_share": "share", "token_entropy": "entropy"}
    figures = cut(sound.select("lang", "script", "bits", *(F.col(a).alias(b) for a, b in names.items())))
    middle = quantiles(figures, "lang", {"cpt": 0.5, "tpw": 0.5, "bits": 0.5, "entropy": 0.001}).select("lang", *(F.col(c).alias(f"m_{c}") for c in ("cpt", "tpw", "bits", "entropy")))
    # Decimals add up to the same sum in any order.
    spread = lambda c: F.sqrt(F.sum(((F.col(c) - F.col(f"m_{c}")) ** 2 * F.col("n")).cast("decimal(38,12)")).cast("double") / F.count(F.lit(1)))
    script = F.when(2 * F.count_if(F.col("script") == "latin") > F.count(F.lit(1)), "latin").otherwise("")
    told = figures.join(F.broadcast(middle), "lang").groupBy("lang").agg(
        F.first("m_cpt").alias("cpt"), spread("cpt").alias("cpt_spread"), F.first("m_tpw").alias("tpw"), spread("tpw").alias("tpw_spread"), (F.max("share") + 0.08).alias("share"),
        (F.first("m_entropy") - 0.3).alias("entropy"), F.first("m_bits").alias("bits"), script.alias("script"), F.count(F.lit(1)).alias("rows"),
    )
    # One row for each language.
    found = told.filter(F.col("rows") >= least).drop("rows").collect()
    return bands | {r.lang: Band(*r[1:]) for r in found}


def fit_bands(docs: DataFrame, labels: DataFrame, path: str, *, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", good_col: str = "quality", most: int | None = None, least: int = LEAST, bands: dict[str, Band] = BANDS, least_words: int = 50) -> dict[str, Band]:
    """Bands by language, fitted on good text: all documents that labels (id, good_col = 1) call good.

    With `most`, only so many of them, chosen by a hash of their id.  Documents
    that fail the base rules take no part.  Languages with fewer than `least` of
    them keep what bands has; null languages are left out.  A table without
    labels, or without documents, gives bands as it is.
    """
    measured = measure(docs, path, id_col=id_col, match_col=id_col, text_col=text_col, lang_col=lang_col, least_words=least_words)
    return bands_of(measured, labels, match_col=id_col, good_col=good_col, most=most, least=least, bands=bands)


def inside(b: Column) -> Column:
    """Whether characters per token, tokens per word, byte share and entropy of a text are inside a band."""
    reach = SPREADS / F.sqrt(F.greatest(F.col("n_words"), F.lit(1)))
    cpt = F.abs(F.col("chars_per_token") - b["cpt"]) <= reach * b["cpt_spread"] + MARGIN * b["cpt"]
    tpw = F.col("tokens_per_word") <= b["tpw"] + reach * b["tpw_spread"] + MARGIN * b["tpw"]
    return cpt & tpw & (F.col("byte_share") <= b["share"]) & (F.col("token_entropy") >= b["entropy"])


def acceptable(measured: DataFrame, bands: dict[str, Band]) -> DataFrame:
    """measured with the method's verdict, kept.

    A text must hold the band of its language; without a language, that of one
    of the languages in its script; and the mean entropy of its windows must
    reach its language's floor (the least of the script's).  A named language
    without a band may have other figures, so in a known script it has the
    windows' floor only, else the fixed limits of any script.
    """
    spark = measured.sparkSession
    # One row for each language, and one row; Arrow tables need no Python workers of their own on the executors.
    band = pa.struct([(k, pa.string() if k == "script" else pa.float64()) for k in Band._fields])
    named = spark.createDataFrame(pa.table({"_of": pa.array(list(bands), pa.string()), "own": pa.array([b._asdict() for b in bands.values()], band)}))
    latin = spark.createDataFrame(pa.table({"near": pa.array([[b._asdict() for b in bands.values() if b.script == "latin"]], pa.list_(band))}))
    rows = measured.join(F.broadcast(named), F.col("lang") == F.col("_of"), "left").crossJoin(F.broadcast(latin))
    # Few windows vary more, and a short one has fewer bits.
    long = F.lit(float(WINDOW)) / F.greatest(F.col("n_tokens"), F.lit(1))
    floor = F.coalesce(F.col("own.bits"), F.array_min(F.col("near.bits"))) - 0.25 - 0.2 * F.sqrt(long) - 0.8 * F.greatest(F.lit(0.0), F.log2(long))
    least, most, share, entropy = OTHER
    other = F.col("chars_per_token").between(least, most) & (F.col("byte_share") <= share) & (F.col("token_entropy") >= entropy)
    bare = F.col("_of").isNull() & ((F.col("script") != "latin") | (F.size("near") == 0))
    holds = F.when(F.col("_of").isNotNull(), inside(F.col("own"))).when(F.col("lang").isNull(), F.exists("near", inside)).otherwise(True)
    return rows.withColumn("kept", ~F.col("base_failed") & F.when(bare, other).otherwise(holds & (F.col("bits") >= floor)))


def quality_rules(docs: DataFrame, path: str, *, id_col: str = "doc_id", text_col: str = "text", lang_col: str | None = "lang", bands: dict[str, Band] = BANDS, least_words: int = 50, labels: DataFrame | None = None, match_col: str | None = None, good_col: str = "quality") -> DataFrame:
    """Base counts, fertility figures and the verdict for every row.

    kept is false where base_failed (fewer than least_words words, or over half
    of them in repeated three-word windows) and where the text is not acceptable
    by the bands.  With labels, bands are first fitted on all rows whose
    match_col (id_col by default) labels call good, see fit_bands; texts are
    read and encoded once for both.  Limits are wider for short texts by their
    sampling spread.  The mean entropy of token windows must
    reach the floor of the language, which does not rise with the text's length
    as the entropy of the whole does.  Null and empty texts have no words and
    fail.  Repeated rows give a row each, null ids stay null, an empty table
    gives no rows, other columns are not read.  Texts are judged whole.
    """
    match_col = match_col or id_col
    measured = measure(docs, path, id_col=id_col, match_col=match_col, text_col=text_col, lang_col=lang_col, least_words=least_words)
    if labels is not None:
        measured = cut(measured)
        bands = bands_of(measured, labels, match_col=match_col, good_col=good_col, most=None, least=LEAST, bands=bands)
    return acceptable(measured, bands).select(F.col("id").alias(id_col), *(x.split()[0] for x in OUT.split(", ")), "kept")
