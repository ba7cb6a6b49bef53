"""Filter interaction audit: what each of five document filters removes at each place of every order."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import permutations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quorumlake.llm.bytescan import prefix_counts, same_words, text_buffer, word_hashes, word_spans
from quorumlake.llm.common import cut, pieces

#: Too short, repetitive, too many capitals, symbols, exact copy of a smaller id; bit 0 to 4 of a mask.
FILTERS = "ABCDE"
BLANK, CAPITAL, SYMBOL, INNER = 1, 2, 4, 8
CLASSES = np.zeros(256, np.uint8)
CLASSES[[0x20, *range(0x09, 0x0E)]] |= BLANK
CLASSES[ord("A") : ord("Z") + 1] |= CAPITAL
CLASSES[list(b"#$%&*|")] |= SYMBOL
CLASSES[0x80:0xC0] |= INNER
GOLDEN = np.uint64(0x9E3779B97F4A7C15)


def distinct_words(b: np.ndarray, starts: np.ndarray, ends: np.ndarray, n_words: np.ndarray) -> np.ndarray:
    """Distinct words of each row: hashes of word and row are sorted, and neighbours with the same hash are held against each other.

    A row in which two different words share a hash is counted from the words themselves.
    """
    row = np.repeat(np.arange(len(n_words)), n_words)
    with np.errstate(over="ignore"):
        h = (word_hashes(b, starts, ends) ^ (row.astype(np.uint64) + np.uint64(1)) * GOLDEN) * GOLDEN
    order = np.argsort(h)
    pair = np.flatnonzero(h[order[1:]] == h[order[:-1]]) if len(h) else np.zeros(0, np.int64)
    i, j = order[pair], order[pair + 1]
    same = (row[i] == row[j]) & same_words(b, starts, ends, i, j)
    found = n_words - np.bincount(row[i[same]], minlength=len(n_words))
    firsts = np.r_[0, np.cumsum(n_words)]
    for k in np.unique(np.r_[row[i[~same]], row[j[~same]]]).tolist():
        found[k] = len({b[starts[x] : ends[x]].tobytes() for x in range(firsts[k], firsts[k + 1])})
    return found


def failures(column: pa.Array, least_words: int = 200) -> np.ndarray:
    """The mask of each text of a column for the filters that look at one text alone."""
    b, offsets = text_buffer(column)
    kinds = CLASSES[b[:-8]]
    starts, ends = word_spans(kinds & BLANK == 0, offsets)
    marks = np.zeros(len(kinds), bool)
    marks[starts] = True
    words, capitals, symbols = prefix_counts(marks, offsets), prefix_counts(kinds & CAPITAL != 0, offsets), prefix_counts(kinds & SYMBOL != 0, offsets)
    points = prefix_counts(kinds & INNER == 0, offsets)
    fails = [words < least_words, 100 * distinct_words(b, starts, ends, words) < 50 * words, 100 * capitals > 3 * points, symbols > 0]
    return sum(f.astype(np.int32) << k for k, f in enumerate(fails))


def masks(docs: DataFrame, id_col: str, text_col: str, part_col: str) -> DataFrame:
    """_id, _part (null: empty), _mask of filters A to D and _sha of the whole text, for every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in pieces(whole, 4 << 20, "_text"):
                shas = [hashlib.sha256(t or b"").digest() for t in batch.column("_text").cast(pa.binary()).to_pylist()]
                yield pa.RecordBatch.from_arrays([batch.column("_id"), batch.column("_part"), pa.array(failures(batch.column("_text")), pa.int32()), pa.array(shas, pa.binary())], ["_id", "_part", "_mask", "_sha"])

    rows = docs.select(F.col(id_col).alias("_id"), F.coalesce(F.col(part_col).cast("string"), F.lit("")).alias("_part"), F.col(text_col).alias("_text"))
    return rows.mapInArrow(run, f"_id {rows.schema['_id'].dataType.simpleString()}, _part string, _mask int, _sha binary")


def mask_counts(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", part_col: str = "lang", good_col: str = "quality", toxic_col: str = "toxic") -> DataFrame:
    """part, mask, good, toxic and n: rows by the filters they fail and their labels, counted over the whole table.

    Texts with the same SHA-256 are the same text.  Rows meet their labels by
    id; then rows of one text and alike in all else are counted together before
    their text's smallest id is looked for, so a text with any number of copies
    is a few rows.
    """
    told = labels.filter(F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("_of")).agg(F.max(F.col(good_col).eqNullSafe(1)).alias("good"), F.max(F.col(toxic_col).eqNullSafe(1)).alias("toxic"))
    # Rows without an id have no label; they are dealt by their text.
    rows = masks(docs, id_col, text_col, part_col).withColumn("_salt", F.when(F.col("_id").isNull(), F.xxhash64("_sha")).otherwise(F.lit(0)))
    told = told.withColumn("_zero", F.lit(0).cast("long"))
    known = rows.join(told, (F.col("_id") == F.col("_of")) & (F.col("_salt") == F.col("_zero")), "left").drop("_of", "_zero")
    known = known.withColumns({c: F.coalesce(c, F.lit(False)) for c in ("good", "toxic")})
    alike = ["_sha", "_part", "_mask", "good", "toxic"]
    by_id = known.groupBy("_id", "_salt", *alike).agg(F.count(F.lit(1)).alias("_c"))
    by_text = by_id.groupBy(*alike).agg(F.sum("_c").alias("n"), F.min(F.struct(F.col("_id").isNull().alias("absent"), "_id", "_c")).alias("lead"))
    group = by_text.groupBy("_sha").agg(F.min(F.struct(F.col("lead.absent").alias("absent"), F.col("lead._id").alias("_id"))).alias("first"), F.collect_list(F.struct("_part", "_mask", "good", "toxic", "n", "lead")).alias("of")).select("first", F.inline("of"))
    # Copies of the text with its smallest id pass filter E, all others fail; rows without an id follow all with one.
    passing = F.when(F.col("first.absent"), F.col("n")).when(F.col("lead._id").eqNullSafe(F.col("first._id")), F.col("lead._c")).otherwise(F.lit(0))
    split = group.withColumn("_p", passing).select("_part", "good", "toxic", F.inline(F.array(F.struct(F.col("_mask").alias("mask"), F.col("_p").alias("_n")), F.struct(F.col("_mask").bitwiseOR(16).alias("mask"), (F.col("n") - F.col("_p")).alias("_n")))))
    return split.filter("_n > 0").groupBy(F.col("_part").alias("part"), "mask", "good", "toxic").agg(F.sum("_n").alias("n"))


def steps() -> Column:
    """All orders with their steps: the filter's bit and those of the filters before it."""
    bit = {f: 1 << k for k, f in enumerate(FILTERS)}
    rows = [(("".join(order), k + 1, bit[f], sum(bit[x] for x in order[:k]))) for order in permutations(FILTERS) for k, f in enumerate(order)]
    return F.array(*[F.struct(F.lit(o).alias("filter_order"), F.lit(k).alias("step"), F.lit(b).alias("_bit"), F.lit(e).alias("_earlier")) for o, k, b, e in rows])


def audit(counts: DataFrame) -> DataFrame:
    """One row for each part, order of filters and step, from mask_counts."""
    every = counts.select("*", F.inline(steps()))
    fails, gone = F.col("mask").bitwiseAND(F.col("_bit")) != 0, F.col("mask").bitwiseAND(F.col("_earlier")) != 0
    total = lambda c: F.coalesce(F.sum(F.when(c, F.col("n"))), F.lit(0)).cast("long")
    here = fails & ~gone
    share = F.col("n") * F.floor(F.lit(120) / F.greatest(F.bit_count("mask"), F.lit(1)))
    return every.groupBy("part", "filter_order", "step").agg(
        total(~fails & ~gone).alias("kept"), total(here).alias("removed"), total(fails & gone).alias("redundant"), total(F.col("mask") == F.col("_bit")).alias("unique_fails"),
        total(here & F.col("good")).alias("good_lost"), total(here & F.col("toxic")).alias("toxic_lost"), F.coalesce(F.sum(F.when(fails, share)), F.lit(0)).cast("long").alias("shapley"),
    )


def filter_audit(docs: DataFrame, labels: DataFrame, **columns: str) -> DataFrame:
    """What five filters keep, remove and repeat in every order, by part: 600 rows for each part.

    Filters: A under 200 words; B fewer than half of the words distinct; C over
    3 % of the code points in A-Z; D any of #$%&*|; E the text of any smaller id.
    A part is a value of part_col, null the empty string.  Null texts are empty.
    Rows that repeat an id are counted each; a text's copies with its smallest
    id pass E.  Rows without an id have no label and fail E where any row with
    one has their text.  Several labels of one id count as one that has all of
    them.  Empty documents give no rows.  A filter that fails a row first is the
    one in its mask that comes first, so over 120 orders each of k failing
    filters removes it 120 / k times: that is shapley.
    """
    return audit(cut(mask_counts(docs, labels, **columns)))


SQL = r"""
WITH d AS (
  SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t FROM documents
), l AS (
  SELECT doc_id, max(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS good, max(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS toxic FROM labels WHERE doc_id IS NOT NULL GROUP BY doc_id
), w AS (
  SELECT doc_id, part, t, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS words, min(doc_id) OVER (PARTITION BY t) AS lead FROM d
), m AS (
  SELECT part, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic,
    CASE WHEN len(words) < 200 THEN 1 ELSE 0 END + CASE WHEN 100 * len(list_distinct(words)) < 50 * len(words) THEN 2 ELSE 0 END
    + CASE WHEN 100 * (length(t) - length(regexp_replace(t, '[A-Z]', '', 'g'))) > 3 * length(t) THEN 4 ELSE 0 END + CASE WHEN regexp_matches(t, '[#$%&*|]') THEN 8 ELSE 0 END
    + CASE WHEN lead IS NOT NULL AND w.doc_id IS DISTINCT FROM lead THEN 16 ELSE 0 END AS mask
  FROM w LEFT JOIN l ON w.doc_id = l.doc_id
), c AS (SELECT part, mask, good, toxic, count(*) AS n FROM m GROUP BY ALL),
f(f, bit) AS (VALUES ('A', 1), ('B', 2), ('C', 4), ('D', 8), ('E', 16)),
o AS (
  SELECT a.f || b.f || c.f || d.f || e.f AS filter_order, [a.bit, b.bit, c.bit, d.bit, e.bit] AS bits
  FROM f a, f b, f c, f d, f e WHERE a.bit + b.bit + c.bit + d.bit + e.bit = 31 AND (a.bit | b.bit | c.bit | d.bit | e.bit) = 31
), s AS (SELECT filter_order, CAST(k AS INTEGER) AS step, bits[k] AS bit, coalesce(list_sum(bits[:k - 1]), 0)::BIGINT AS earlier FROM o, range(1, 6) r(k)
), x AS (SELECT part, filter_order, step, n, good, toxic, mask, bit, (mask & bit) <> 0 AS fails, (mask & earlier) <> 0 AS gone FROM c, s)
SELECT part, filter_order, step,
  CAST(coalesce(sum(n) FILTER (NOT fails AND NOT gone), 0) AS BIGINT) AS kept, CAST(coalesce(sum(n) FILTER (fails AND NOT gone), 0) AS BIGINT) AS removed, CAST(coalesce(sum(n) FILTER (fails AND gone), 0) AS BIGINT) AS redundant,
  CAST(coalesce(sum(n) FILTER (mask = bit), 0) AS BIGINT) AS unique_fails, CAST(coalesce(sum(n) FILTER (fails AND NOT gone AND good = 1), 0) AS BIGINT) AS good_lost, CAST(coalesce(sum(n) FILTER (fails AND NOT gone AND toxic = 1), 0) AS BIGINT) AS toxic_lost,
  CAST(coalesce(sum(n * 120 // greatest(bit_count(mask), 1)) FILTER (fails), 0) AS BIGINT) AS shapley
FROM x GROUP BY part, filter_order, step
"""
