"""Benchmark decontamination over a distributed positional inverted index.  DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quorumlake.llm.common import cut, lower_ascii

#: What separates words once A-Z are lower case: ASCII other than digits and a-z.
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Test terms are looked for in documents by the bits of a filter: 2**SLOT_BITS integers of 64 bits at most, whatever the number of terms.
SLOT_BITS = 18
#: A term with at least 1 / HOT of all postings is dealt over several tasks; there are HOT such terms at most.
HOT = 1000


def words_of(text: Column) -> Column:
    """The words of a text; null has none."""
    return F.coalesce(F.array_remove(F.split(lower_ascii(text), SEPARATORS), ""), F.array().cast("array<string>"))


def windows_of(items: DataFrame, item_col: str, text_col: str, n: int) -> DataFrame:
    """Distinct windows of n item words, or the whole item if it has fewer but some, with the ids of their items."""
    words = items.select(F.col(item_col).cast("string").alias("item"), words_of(F.col(text_col)).alias("words")).filter(F.size("words") > 0)
    starts = F.sequence(F.lit(0), F.greatest(F.size("words") - n, F.lit(0)))
    cutouts = words.select("item", F.explode(F.transform(starts, lambda i: F.slice("words", i + 1, n))).alias("win"))
    return cutouts.groupBy("win").agg(F.collect_set("item").alias("items"))


def bit_of(term: Column) -> tuple[Column, Column]:
    """The filter's integer and the bit in it that a term has."""
    h = F.xxhash64(term)
    return F.shiftrightunsigned(h, 64 - SLOT_BITS), F.pmod(h, F.lit(64)).cast("int")


def term_filter(terms: DataFrame) -> DataFrame:
    """(slot, bits, framed) of all terms and of those marked `frame`; small by construction, so it may be sent to every task."""
    slot, bit = bit_of(F.col("term"))
    one = F.call_function("shiftleft", F.lit(1).cast("long"), bit)
    frame = F.col("frame") if "frame" in terms.columns else F.lit(True)
    rows = terms.select(slot.alias("slot"), one.alias("one"), F.when(frame, one).otherwise(F.lit(0).cast("long")).alias("own"))
    return F.broadcast(rows.groupBy("slot").agg(F.bit_or("one").alias("bits"), F.bit_or("own").alias("framed")))


def likely(rows: DataFrame, terms: DataFrame) -> DataFrame:
    """rows whose term passes the filter of terms, all that are among them and some others; framed says the same of the marked ones."""
    slot, bit = bit_of(F.col("term"))
    found = rows.withColumn("_slot", slot).withColumn("_bit", bit).join(term_filter(terms).withColumnRenamed("slot", "_slot"), "_slot")
    return found.filter(F.getbit("bits", F.col("_bit")) == 1).withColumn("framed", F.getbit("framed", F.col("_bit")) == 1).drop("_slot", "_bit", "bits")


def term_counts(docs: DataFrame, text_col: str, terms: DataFrame) -> DataFrame:
    """Postings of each test term over all documents."""
    found = likely(docs.select(F.explode(words_of(F.col(text_col))).alias("term")), terms)
    counts = found.groupBy("term").agg(F.count(F.lit(1)).alias("n"))
    return terms.join(counts, "term", "left").select("term", F.coalesce("n", F.lit(0)).alias("n"))


def anchored(windows: DataFrame, counts: DataFrame) -> DataFrame:
    """Each window with its two rarest places: term and offset of the rarest, and of the next."""
    places = windows.select("win", "items", F.posexplode("win").alias("off", "term")).join(counts, "term")
    order = Window.partitionBy("win").orderBy("n", "off")
    ranked = places.withColumn("r", F.row_number().over(order)).filter("r <= 2")
    return ranked.groupBy("win").agg(
        F.first("items").alias("items"),
        F.max(F.when(F.col("r") == 1, F.col("term"))).alias("term"),
        F.max(F.when(F.col("r") == 1, F.col("off"))).alias("off"),
        F.max(F.when(F.col("r") == 1, F.col("n"))).alias("n"),
        F.max(F.when(F.col("r") == 2, F.col("term"))).alias("term2"),
        F.max(F.when(F.col("r") == 2, F.col("off"))).alias("off2"),
        F.max(F.when(F.col("r") == 2, F.col("n"))).alias("n2"),
    ).withColumn("wid", F.xxhash64("win"))


def postings(docs: DataFrame, terms: DataFrame, id_col: str, text_col: str, radius: int) -> DataFrame:
    """Positional postings of terms (and of some that share their bits): id, h (hash of the text), term and pos; for terms marked `frame` also the words from `low` on to radius words either side.

    The frame is cut where the document is read: no document is moved or stored.
    """
    words = docs.select(F.col(id_col).alias("id"), F.xxhash64(F.col(text_col)).alias("h"), words_of(F.col(text_col)).alias("words"))
    each = likely(words.select("id", "h", "words", F.posexplode("words").alias("pos", "term")), terms)
    low = F.greatest(F.col("pos") - radius, F.lit(0))
    return each.select("id", "h", "term", "pos", low.alias("low"), F.when(F.col("framed"), F.slice("words", low + 1, F.col("pos") - low + radius + 1)).alias("frame"))


def dealt(index: DataFrame, wins: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Both with a salt: postings of a hot term are dealt over several, and its windows (term and its count n) are in each."""
    terms = wins.select("term", "n").distinct()
    whole = terms.agg(F.sum("n").alias("total"))
    salts = F.broadcast(terms.crossJoin(F.broadcast(whole)).filter(F.col("n") * HOT >= F.col("total")).filter("n > 0").select("term", F.ceil(F.col("n") * HOT / F.col("total")).cast("int").alias("salts")))
    number = F.coalesce("salts", F.lit(1))
    left = index.join(salts, "term", "left").withColumn("salt", F.pmod(F.xxhash64("id", "h", "pos"), number).cast("int")).drop("salts")
    right = wins.join(salts, "term", "left").withColumn("salt", F.explode(F.sequence(F.lit(0), number - 1))).drop("salts", "n")
    return left, right


def starts_of(index: DataFrame, wins: DataFrame, term: str, off: str, n: str) -> DataFrame:
    """The list of a term, shifted by its offset in each window: id, h, start, wid and pos, for windows that begin inside the text."""
    mine = wins.filter(F.col(term).isNotNull()).select(F.col(term).alias("term"), F.col(off).alias("off"), F.col(n).alias("n"), "wid")
    left, right = dealt(index.select("id", "h", "term", "pos"), mine)
    return left.join(right, ["term", "salt"]).select("id", "h", (F.col("pos") - F.col("off")).alias("start"), "wid", "pos").filter("start >= 0")


def intersected(index: DataFrame, wins: DataFrame) -> DataFrame:
    """Candidate starts (id, h, start, wid, pos of the rarest term) that the lists of a window's two rarest terms have in common; a window of one word has one list."""
    first = starts_of(index, wins, "term", "off", "n")
    second = starts_of(index, wins, "term2", "off2", "n2").select(F.col("id").alias("_id"), F.col("h").alias("_h"), F.col("start").alias("_start"), F.col("wid").alias("_wid"))
    short = wins.filter("term2 IS NULL").select(F.col("wid").alias("_one"))
    both = first.join(second, F.col("id").eqNullSafe(F.col("_id")) & (F.col("h") == F.col("_h")) & (F.col("start") == F.col("_start")) & (F.col("wid") == F.col("_wid")), "left_semi")
    return both.unionByName(first.join(short, F.col("wid") == F.col("_one"), "left_semi"))


def phrase_matches(docs: DataFrame, items: DataFrame, *, n: int = 10, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", slack: int | None = None) -> DataFrame:
    """Every occurrence of a window of n item words: id, h, start, length, items; with slack also near ones, exact says which.

    The index holds the postings of each window's two rarest terms, counted over
    all documents.  Their positions, less the terms' offsets, are lists of starts;
    what both lists have is a candidate, and all its terms are compared with the
    words around the rarest one.  A proximity match (slack given) has every word
    of the window within len(window) - 1 + slack words of the rarest one; its
    terms stand at no fixed offset, so only the rarest term's list is used then.
    """
    windows = cut(windows_of(items, item_col, item_text_col, n))
    terms = windows.select(F.explode("win").alias("term")).distinct()
    wins = cut(anchored(windows, term_counts(docs, text_col, terms)))
    radius = n - 1 + (slack or 0)
    rarest = wins.select("term", F.lit(True).alias("frame"))
    asked = rarest if slack is not None else rarest.unionByName(wins.filter("term2 IS NOT NULL").select(F.col("term2").alias("term"), F.lit(False).alias("frame")))
    index = cut(postings(docs, asked.groupBy("term").agg(F.max("frame").alias("frame")), id_col, text_col, radius))
    framed = index.filter("frame IS NOT NULL")
    if slack is None:
        found = intersected(index, wins).withColumnsRenamed({"id": "_id", "h": "_h", "pos": "_pos"})
        met = found.join(wins.select("wid", "win", "items", "term"), "wid")
        met = met.join(framed.withColumnRenamed("term", "_term"), F.col("id").eqNullSafe(F.col("_id")) & (F.col("h") == F.col("_h")) & (F.col("pos") == F.col("_pos")) & (F.col("term") == F.col("_term")))
    else:
        left, right = dealt(framed, wins)
        met = left.join(right, ["term", "salt"]).withColumn("start", F.col("pos") - F.col("off"))
    met = met.withColumn("at", F.col("start") - F.col("low"))
    exact = (F.col("at") >= 0) & (F.slice("frame", F.greatest(F.col("at") + 1, F.lit(1)), F.size("win")) == F.col("win"))
    if slack is None:
        met = met.filter(exact).withColumn("exact", F.lit(True))
    else:
        met = met.withColumn("exact", exact).filter(F.col("exact") | (F.size(F.array_except("win", "frame")) == 0))
    return met.select("id", "h", "start", F.size("win").alias("length"), "items", "exact")


def decontaminate(docs: DataFrame, items: DataFrame, *, n: int = 10, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """id, h, n_words, n_hit, n_items, items_sha256 and contaminated for every row of docs.

    A word is hit if it is inside any occurrence of a window; h is a hash of the
    text.  Null and empty texts have no words and no hits; null and empty items
    have no windows; items repeated under one id count once.  Rows repeated in
    docs give a row each; rows of one id with different texts are judged apart.
    Null ids stay null.  An empty table of docs gives no rows, one of items no
    hits.  Other columns are not read.
    """
    found = phrase_matches(docs, items, n=n, id_col=id_col, text_col=text_col, item_col=item_col, item_text_col=item_text_col)
    # One row of a text's matches for each (start, length) and item, so that repeated windows and rows do not pile up.
    spans = found.groupBy("id", "h", "start", "length").agg(F.flatten(F.collect_set("items")).alias("items"))
    merged = F.aggregate(
        F.array_sort(F.collect_list(F.struct("start", "length"))),
        F.struct(F.lit(0).alias("end"), F.lit(0).cast("long").alias("n")),
        lambda a, x: F.struct(F.greatest(a["end"], x["start"] + x["length"]).alias("end"), (a["n"] + F.greatest(F.lit(0), x["start"] + x["length"] - F.greatest(a["end"], x["start"]))).alias("n")),
        lambda a: a["n"],
    )
    hits = spans.groupBy("id", "h").agg(merged.alias("n_hit"), F.array_sort(F.array_distinct(F.flatten(F.collect_set("items")))).alias("items"))
    hits = hits.withColumnsRenamed({"id": "hit_id", "h": "hit_h"})
    rows = docs.select(F.col(id_col).alias("id"), F.xxhash64(F.col(text_col)).alias("h"), F.size(words_of(F.col(text_col))).cast("long").alias("n_words"))
    names = F.coalesce("items", F.array().cast("array<string>"))
    joined = rows.join(hits, F.col("id").eqNullSafe(F.col("hit_id")) & (F.col("h") == F.col("hit_h")), "left")
    n_hit = F.coalesce("n_hit", F.lit(0)).cast("long")
    return joined.select(F.col("id").alias(id_col), "h", "n_words", n_hit.alias("n_hit"), F.size(names).cast("long").alias("n_items"), F.sha2(F.concat_ws(",", names), 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"))


#: DuckDB SQL for the contract query over documents and benchmark.
SQL = r"""
WITH dw AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS words FROM documents
), bw AS (
  SELECT item_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS words FROM benchmark
), win AS (
  SELECT DISTINCT item_id, array_to_string(words[i + 1 : i + 10], ' ') AS w, least(len(words), 10) AS k
  FROM (SELECT item_id, words, unnest(range(0, greatest(len(words) - 10, 0) + 1)) AS i FROM bw WHERE len(words) > 0)
), pos AS (
  SELECT doc_id, words, unnest(range(0, len(words))) AS i FROM dw
), lens AS (SELECT DISTINCT k FROM win), occ AS (
  SELECT DISTINCT doc_id, i, pos.k, item_id
  FROM (SELECT doc_id, i, k, array_to_string(words[i + 1 : i + k], ' ') AS w FROM pos, lens WHERE i + k <= len(words)) pos
  JOIN win ON pos.w = win.w AND pos.k = win.k
), hit AS (
  SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + k)) AS p FROM occ) GROUP BY doc_id
), its AS (
  SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS names FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM occ) GROUP BY doc_id
)
SELECT dw.doc_id, CAST(len(words) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
  sha256(coalesce(names, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM dw LEFT JOIN hit USING (doc_id) LEFT JOIN its USING (doc_id)
"""
