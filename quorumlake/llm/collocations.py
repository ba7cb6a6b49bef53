"""Phrase collocation mining: frequent word sequences by sorting and counting fixed-width keys."""

from __future__ import annotations

from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quorumlake.llm.bytescan import START, STEP, text_buffer, word_hashes, word_spans
from quorumlake.llm.common import cut, pieces

#: Words of the longest phrase; a key has eight bytes for each, zeros behind the last.
MOST = 5
#: Ends a piece, is blank, or belongs to a word.
BREAK, BLANK = 2, 1
CLASSES = np.zeros(256, np.uint8)
CLASSES[list(b".,;:!?\n\x0b\x0c\r")] = BREAK
CLASSES[list(b" \t")] = BLANK
LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
#: Lower-cases and makes all that is in no word a blank.
WORDS_ONLY = bytes(32 if CLASSES[c] else LOWER[c] for c in range(256))
#: Bytes of text whose windows are sorted at once, distinct words counted at once, keys a range's bounds are drawn from.
CHUNK, HELD, DRAWN = 8 << 20, 200_000, 32
#: The filters of frequent words and pairs have at most 2**27 bits, 16 MB, each.
FILTER_BITS = 27
#: Languages whose totals are broadcast; more are joined.
FEW_LANGS = 10_000


def word_counts(rows: DataFrame) -> DataFrame:
    """lang, word, f: all occurrences of each word."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[str, Counter] = {}

        def full() -> Iterator[pa.RecordBatch]:
            for lang, found in counts.items():
                words = list(found)
                for a in range(0, len(words), 1 << 16):
                    part = words[a : a + (1 << 16)]
                    yield pa.RecordBatch.from_arrays([pa.array([lang] * len(part), pa.string()), pa.array(part, pa.binary()).cast(pa.string()), pa.array([found[w] for w in part], pa.int64())], ["lang", "word", "f"])

        for whole in batches:
            for batch in pieces(whole, CHUNK):
                for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text").cast(pa.binary()).to_pylist()):
                    counts.setdefault(lang, Counter()).update((text or b"").translate(WORDS_ONLY).split())
                if sum(map(len, counts.values())) > HELD:
                    yield from full()
                    counts = {}
        yield from full()

    parts = rows.mapInArrow(run, "lang string, word string, f long")
    return parts.groupBy("lang", "word").agg(F.sum("f").alias("f"))


def lang_seed(lang: str, seed: int) -> int:
    """Words of different languages have different ids."""
    return xxhash.xxh3_64_intdigest(lang.encode(), seed=seed)


def with_ids(words: DataFrame, seed: int) -> DataFrame:
    """words (lang, word, f) with their id under a seed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in pieces(whole, CHUNK, "word"):
                b, offsets = text_buffer(batch.column("word"))
                seeds = np.array([lang_seed(x, seed) for x in batch.column("lang").to_pylist()], np.uint64)
                yield batch.append_column("id", pa.array(word_hashes(b, offsets[:-1], offsets[1:], seeds).view(np.int64)))

    return words.mapInArrow(run, "lang string, word string, f long, id long")


def dictionary(rows: DataFrame, least: int) -> tuple[DataFrame, DataFrame, int]:
    """All words with their ids, the frequent ones, and the seed of the ids.

    The ids are proven before they are used: no frequent word shares its id with
    any other word of the corpus, in any language, and none is zero.  Otherwise
    the next seed is tried.
    """
    counts = cut(word_counts(rows))
    for seed in range(64):
        words = cut(with_ids(counts, seed))
        frequent = F.col("f") >= least
        shared = words.groupBy("id").agg(F.count(F.lit(1)).alias("words"), F.max("f").alias("f"))
        if shared.filter(frequent & ((F.col("words") > 1) | (F.col("id") == 0))).isEmpty():
            return words, words.filter(frequent), seed
    raise ValueError("no seed gives different ids")


def bit_filter(ids: DataFrame) -> np.ndarray:
    """A bit for the low bits of each id (column id, all different), 16 bits for each as long as the bound allows.

    Beyond the bound more ids pass that should not, which costs time and changes no count.
    """
    bits = min(FILTER_BITS, max(10, (16 * ids.count()).bit_length()))
    low = F.col("id").bitwiseAND((1 << bits) - 1)
    # At most 2**(bits - 6) rows, whatever the number of ids.
    rows = ids.groupBy(F.shiftright(low, 6).cast("int").alias("cell")).agg(F.bit_or(F.expr("shiftleft(1L, CAST(id & 63 AS INT))")).alias("bits")).toPandas()
    out = np.zeros(1 << bits - 6, np.int64)
    out[rows["cell"].to_numpy()] = rows["bits"].to_numpy()
    return out.view(np.uint64)


def passes(cells: np.ndarray, ids: np.ndarray) -> np.ndarray:
    mask = np.uint64(64 * len(cells) - 1)
    return cells[(ids & mask) >> np.uint64(6)] >> (ids & np.uint64(63)) & np.uint64(1) != 0


def pair_ids(first: np.ndarray, second: np.ndarray) -> np.ndarray:
    """An id for two words in turn, for the filter of pairs only."""
    with np.errstate(over="ignore"):
        h = (first * STEP ^ second) * START
    return h ^ h >> np.uint64(31)


def ids_of_pairs(pairs: DataFrame) -> DataFrame:
    """id of each key of two words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = numbers(batch.column("key"), 2)
            yield pa.RecordBatch.from_arrays([pa.array(pair_ids(keys[:, 0], keys[:, 1]).view(np.int64))], ["id"])

    return pairs.select("key").mapInArrow(run, "id long").distinct()


class Breaks(NamedTuple):
    """Where pieces break besides their own ends: at words that are not frequent, and between words that are no frequent pair.

    least and most: words of the shortest window that is taken and of the longest.
    """

    seed: int
    words: np.ndarray
    pairs: np.ndarray | None
    least: int
    most: int


def windows(batch: pa.RecordBatch, seeds: dict[str, int], at_: Breaks) -> np.ndarray:
    """The ids of up to `most` words from each place on, zeros behind them, as rows."""
    b, offsets = text_buffer(batch.column("text"))
    b = np.frombuffer(b.tobytes().translate(LOWER), np.uint8)
    kinds = CLASSES[b[:-8]]
    starts, ends = word_spans(kinds == 0, offsets)
    if not len(starts):
        return np.zeros((0, at_.most), np.uint64)
    row = np.searchsorted(offsets, starts, side="right") - 1
    ids = word_hashes(b, starts, ends, np.array([seeds[x] for x in batch.column("lang").to_pylist()], np.uint64)[row])
    known = passes(at_.words, ids)
    breaks = np.cumsum(kinds == BREAK)[starts]
    # A chain is a run of frequent words of one piece.
    joined = known[1:] & known[:-1] & (row[1:] == row[:-1]) & (breaks[1:] == breaks[:-1])
    if at_.pairs is not None:
        joined &= passes(at_.pairs, pair_ids(ids[:-1], ids[1:]))
    last = np.flatnonzero(np.r_[~joined, True])
    left = last[np.searchsorted(last, np.arange(len(ids)))] - np.arange(len(ids)) + 1
    at = np.flatnonzero(known & (left >= at_.least))
    ids, left = np.r_[ids, np.zeros(at_.most, np.uint64)], left[at]
    return np.stack([np.where(left > k, ids[at + k], np.uint64(0)) for k in range(at_.most)], axis=1)


def counted(rows: np.ndarray, times: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct rows in order and how often each is there.

    Ids become ranks, the ranks are radix-sorted by 16-bit digits from the last
    word to the first, and runs are counted.
    """
    if not len(rows):
        return rows, np.zeros(0, np.int64)
    codes, found = pd.factorize(rows.ravel())
    order = np.argsort(found)
    rank = np.empty(len(found), np.uint32)
    rank[order] = np.arange(len(found), dtype=np.uint32)
    ranks = rank[codes].reshape(rows.shape)
    at = np.arange(len(rows))
    for k in range(rows.shape[1] - 1, -1, -1):
        for shift in range(0, max(1, (len(found) - 1).bit_length()), 16):
            at = at[np.argsort((ranks[at, k] >> np.uint32(shift)).astype(np.uint16), kind="stable")]
    ranks = ranks[at]
    first = np.flatnonzero(np.r_[True, (ranks[1:] != ranks[:-1]).any(axis=1)])
    return rows[at[first]], np.diff(np.r_[first, len(rows)]) if times is None else np.add.reduceat(times[at], first)


def binary(keys: np.ndarray) -> bytes:
    """Keys as bytes that sort as the numbers do."""
    return keys.astype(">u8").tobytes()


def fixed(keys: bytes, width: int) -> pa.Array:
    n = len(keys) // width
    return pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer((np.arange(n + 1, dtype=np.int64) * width).astype(np.int32).tobytes()), pa.py_buffer(keys)])


def numbers(cells: pa.Array, words: int) -> np.ndarray:
    """Keys of a column as rows of ids."""
    start = np.frombuffer(cells.buffers()[1], np.int32)[cells.offset] if len(cells) else 0
    return np.frombuffer(cells.buffers()[2], ">u8", words * len(cells), start).astype(np.uint64).reshape(-1, words) if len(cells) else np.zeros((0, words), np.uint64)


def key_counts(rows: DataFrame, breaks: Breaks, bounds: list[bytes], share: float = 1.0) -> DataFrame:
    """range, key and n: windows of a chunk of text, sorted and counted, with the range between bounds that each falls in; a share of them if asked."""
    width = 8 * breaks.most

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        draw = np.random.default_rng(TaskContext.get().partitionId())

        def full() -> Iterator[pa.RecordBatch]:
            found = np.concatenate(held)
            keys, n = counted(found[draw.random(len(found)) < share] if share < 1 else found)
            raw = binary(keys)
            edges = [bisect_left(range(len(n)), b, key=lambda i: raw[i * width : (i + 1) * width]) for b in bounds]
            to = np.repeat(np.arange(len(bounds) + 1, dtype=np.int32), np.diff([0, *edges, len(n)]))
            for a in range(0, len(n), 1 << 16):
                b = min(a + (1 << 16), len(n))
                yield pa.RecordBatch.from_arrays([pa.array(to[a:b]), fixed(raw[a * width : b * width], width), pa.array(n[a:b])], ["range", "key", "n"])

        for whole in batches:
            for batch in pieces(whole, CHUNK // 4):
                seeds = {x: lang_seed(x, breaks.seed) for x in batch.column("lang").unique().to_pylist()}
                held.append(windows(batch, seeds, breaks))
                size += len(held[-1])
                if size > CHUNK // 8:
                    yield from full()
                    held, size = [], 0
        if held:
            yield from full()

    return rows.mapInArrow(run, "range int, key binary, n long")


def range_bounds(rows: DataFrame, breaks: Breaks, total: int, parts: int) -> list[bytes]:
    """At most parts - 1 keys that split the windows evenly, from at most about DRAWN keys a range, drawn from some of the documents.

    The bounds decide where keys are counted, not what is counted.
    """
    share = min(1.0, DRAWN * parts / max(total, 1))
    docs = min(1.0, 64 * share)
    drawn = key_counts(rows.filter(F.rand(7) < docs) if docs < 1 else rows, breaks, [], share / docs)
    keys = np.array(sorted(x for r in drawn.select("key", "n").toLocalIterator() for x in [bytes(r.key)] * r.n), object)
    return sorted({keys[len(keys) * k // parts] for k in range(1, parts)}) if len(keys) else []


def prefix_runs(low: int, most: int, least: int):
    """Run lengths of the prefixes of low to most words in sorted keys: k, key, n.

    A run with fewer than `least` keys goes, unless it touches an end of the
    range, where the rest of it may be in another one.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_key: list[np.ndarray | None] = [None] * (most + 1)
        open_n, at_end = [0] * (most + 1), [True] * (most + 1)

        def told(k: int, keys: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(np.full(len(n), k, np.int32)), fixed(binary(keys[:, :k]), 8 * k), pa.array(n)], ["k", "key", "n"])

        for batch in batches:
            if not batch.num_rows:
                continue
            keys, n = numbers(batch.column("key"), most), batch.column("n").to_numpy()
            differs = keys[1:] != keys[:-1]
            for k in range(low, most + 1):
                first = np.flatnonzero(np.r_[True, differs[:, :k].any(axis=1)])
                sums, heads = np.add.reduceat(n, first), keys[first]
                if open_key[k] is not None and np.array_equal(open_key[k], heads[0, :k]):
                    sums[0] += open_n[k]
                    touches = at_end[k]
                else:
                    if open_key[k] is not None and open_key[k][k - 1] and (at_end[k] or open_n[k] >= least):
                        yield told(k, open_key[k][None, :], np.array([open_n[k]]))
                    touches = open_key[k] is None
                keep = (heads[:-1, k - 1] != 0) & (sums[:-1] >= least)
                if touches and len(first) > 1:
                    keep[0] = heads[0, k - 1] != 0
                if keep.any():
                    yield told(k, heads[:-1][keep], sums[:-1][keep])
                open_key[k], open_n[k], at_end[k] = heads[-1, :k].copy(), int(sums[-1]), touches and len(first) == 1
        for k in range(low, most + 1):
            if open_key[k] is not None and open_key[k][k - 1]:
                yield told(k, open_key[k][None, :], np.array([open_n[k]]))

    return run


def phrases_between(rows: DataFrame, breaks: Breaks, total: int, least: int) -> DataFrame:
    """k, key and a: phrases of breaks.least to breaks.most words that occur at least `least` times."""
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    bounds = range_bounds(rows, breaks, total, parts)
    dealt = key_counts(rows, breaks, bounds).repartitionById(len(bounds) + 1, F.col("range")).select("key", "n").sortWithinPartitions("key")
    runs = dealt.mapInArrow(prefix_runs(breaks.least, breaks.most, least), "k int, key binary, n long")
    return cut(runs.groupBy("k", "key").agg(F.sum("n").alias("a")).filter(F.col("a") >= least))


def phrase_counts(rows: DataFrame, seed: int, frequent: DataFrame, total: int, least: int) -> DataFrame:
    """k, key and a: all phrases of two to MOST words that occur at least `least` times.

    Pairs come first: a longer phrase holds frequent pairs only, so its windows
    break at all others and few of them are left to be dealt and sorted.
    """
    words = bit_filter(frequent)
    pairs = phrases_between(rows, Breaks(seed, words, None, 2, 2), total, least)
    longer = phrases_between(rows, Breaks(seed, words, bit_filter(ids_of_pairs(pairs)), 3, MOST), total, least)
    return pairs.unionByName(longer)


def scored(phrases: DataFrame, words: DataFrame) -> DataFrame:
    """k, key, a, l, r, n, lang and score of each phrase at its lowest-scoring cut; words: key, f, lang and n of the single ones."""
    parts = words.select(F.col("key").alias("_part"), "f", "lang", "n").unionByName(phrases.select(F.col("key").alias("_part"), F.col("a").alias("f")), allowMissingColumns=True)
    cuts = phrases.select("k", "key", "a", F.explode(F.sequence(F.lit(1), F.col("k") - 1)).alias("at"))
    cuts = cuts.select("*", F.expr("substring(key, 1, 8 * at)").alias("_left"), F.expr("substring(key, 8 * at + 1)").alias("_right"))
    # The first cut's left part is one word, which tells the language and its number of words.
    left = parts.select(F.col("_part").alias("_left"), F.col("f").alias("l"), "lang", "n")
    right = parts.select(F.col("_part").alias("_right"), F.col("f").alias("r"))
    both = cuts.join(left, "_left").join(right, "_right")
    each = both.groupBy("k", "key", "a").agg(F.collect_list(F.struct("at", "l", "r")).alias("cuts"), F.max("lang").alias("lang"), F.max("n").alias("n"))
    # Exact: 1000 * a has 17 digits, n 19, l and r 18.
    whole = lambda c, digits: c.cast(f"decimal({digits},0)")
    top = whole(F.col("a") * 1000, 18) * whole(F.col("n"), 19)
    each = each.withColumn("_top", top).select("*", F.inline("cuts")).withColumn("_low", whole(F.col("l"), 18) * whole(F.col("r"), 18)).withColumn("score", F.expr("_top div _low"))
    best = each.groupBy("k", "key", "a", "lang", "n").agg(F.min(F.struct("score", "at", "l", "r")).alias("b"))
    return best.select("k", "key", "a", "b.l", "b.r", "n", "lang", "b.score")


def unextended(phrases: DataFrame) -> DataFrame:
    """Phrases without a longer one around them that occurs as often.

    A phrase occurs at least as often as any longer one around it, so where one
    of any length occurs as often, so does one that is one word longer.
    """
    longer = phrases.filter("k > 2")
    inner = longer.select(F.explode(F.array(F.expr("substring(key, 1, 8 * (k - 1))"), F.expr("substring(key, 9)"))).alias("key"), "a").distinct()
    return phrases.join(inner, ["key", "a"], "left_anti")


def collocations(docs: DataFrame, *, text_col: str = "text", lang_col: str = "lang", least: int = 100, most: int = 2000) -> DataFrame:
    """The `most` best phrases of two to five words of each language: lang, rank, phrase, a, l, r, n, score.

    Texts are lower-cased in A-Z, cut into pieces at . , ; : ! ? and line ends
    and into words at blanks.  Words that occur `least` times or more get ids of
    64 bits (hashes, proven to be different in this corpus); pieces break at all
    others, which no frequent phrase can hold.  Windows of two ids, and then of
    up to five that hold frequent pairs only, are fixed-width keys: sorted and
    counted by chunks of text, dealt by ranges, merged by a sort within each
    range, and the run lengths of their prefixes are the phrases' counts.  Runs that cross ranges are added up.  A phrase's
    score is the least of floor(1000 a n / (l r)) over its cuts, ties to the
    first cut; phrases inside a longer one that occurs as often go.  Ties rank
    by a, then by the phrase's bytes.  Null texts are empty, null languages are
    `und`; repeated rows count each; an empty table gives no rows.  Ids of
    documents and other columns are not read.
    """
    rows = docs.select(F.coalesce(F.col(lang_col).cast("string"), F.lit("und")).alias("lang"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    words, frequent, seed = dictionary(rows, least)
    totals = cut(words.groupBy("lang").agg(F.sum("f").alias("n")))
    total, langs = totals.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count(F.lit(1))).first()
    phrases = phrase_counts(rows, seed, frequent, total, least)
    key = F.to_binary(F.lpad(F.hex("id"), 16, "0"), F.lit("hex"))
    known = frequent.join(F.broadcast(totals) if langs <= FEW_LANGS else totals, "lang").select(key.alias("key"), "word", "lang", "f", "n")
    found = cut(unextended(scored(phrases, known)))
    each = found.select("k", "key", F.posexplode(F.expr("transform(sequence(0, k - 1), i -> substring(key, 8 * i + 1, 8))")).alias("at", "_word"))
    named = each.join(known.select(F.col("key").alias("_word"), "word"), "_word").groupBy("key").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "word"))), lambda x: x["word"]), " ").alias("phrase"))
    full = found.join(named, "key").select("lang", "phrase", "a", "l", "r", "n", "score")
    place = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase"))
    return full.withColumn("rank", place.cast("long")).filter(F.col("rank") <= most).select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


SQL = r"""
WITH p AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents
), w AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS ws FROM p
), t AS (SELECT lang, CAST(sum(len(ws)) AS BIGINT) AS n FROM w GROUP BY lang
), g AS (SELECT lang, k, ws, unnest(range(1, len(ws) - k + 2)) AS i FROM w, range(1, 6) r(k)
), f AS (SELECT lang, k, array_to_string(ws[i:i + k - 1], ' ') AS phrase, count(*) AS a FROM g GROUP BY ALL HAVING count(*) >= 100
), c AS (SELECT lang, k, phrase, a, string_split(phrase, ' ') AS ws FROM f WHERE k > 1
), x AS (SELECT lang, phrase, a, unnest(range(1, k)) AS place, ws FROM c
), s AS (
  SELECT x.lang, x.phrase, x.a, l.a AS l, r.a AS r, n, place, CAST(1000::HUGEINT * x.a * n // (l.a::HUGEINT * r.a) AS BIGINT) AS score
  FROM x JOIN t ON t.lang = x.lang JOIN f l ON l.lang = x.lang AND l.phrase = array_to_string(ws[:place], ' ') JOIN f r ON r.lang = x.lang AND r.phrase = array_to_string(ws[place + 1:], ' ')
), b AS (SELECT *, row_number() OVER (PARTITION BY lang, phrase ORDER BY score, place) AS best FROM s
), d AS (SELECT DISTINCT c.lang, c.phrase FROM c JOIN c z ON z.lang = c.lang AND z.k > c.k AND 100 * z.a >= 100 * c.a AND contains(' ' || z.phrase || ' ', ' ' || c.phrase || ' ')
), o AS (SELECT b.*, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM b ANTI JOIN d USING (lang, phrase) WHERE best = 1)
SELECT lang, rank, phrase, a, l, r, n, score FROM o WHERE rank <= 2000
"""
