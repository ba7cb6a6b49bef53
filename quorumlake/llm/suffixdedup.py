"""Repeated substrings over all documents: sparse suffix arrays and longest-previous-factor arrays.

A suffix array of everything does not fit one machine, so it is cut where equal
strings must fall together.  The anchor of a window (a string of `length` bytes)
is the least hashed 64-byte gram inside it: equal windows have the same gram at
the same offset.  Consecutive windows with one anchor are a run, its bytes the
run's context.  Runs with equal contexts repeat as a whole and need no sorting;
runs whose gram occurs with other contexts as well go, by gram, into suffix
arrays, whose LPF arrays tell which windows occur elsewhere.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quorumlake.llm.common import cut, pieces, runs_of, texts_of

GRAM = 64
#: Bytes looked at in one go; longer texts are cut into segments that overlap by a window less one byte.
SEGMENT = 4 << 20
#: Window starts sorted in one suffix array, and runs of one gram beyond which its contexts are dealt by their content.
STARTS, HOT_RUNS, OFFSETS = 1 << 20, 20_000, 8
#: So are those of a gram with at least 1 / HOT of all runs, of which there are HOT at most; its runs are counted in SALTS parts by context.
HOT, SALTS = 1000, 64
ODD = np.uint64(0x9E3779B97F4A7C15)


def byte_codes() -> np.ndarray:
    r = np.random.RandomState(7)
    return r.randint(0, 2**63, 256).astype(np.uint64) * np.uint64(2) + np.uint64(1)


def gram_hashes(b: np.ndarray, codes: np.ndarray) -> np.ndarray:
    """A hash of the 64 bytes from each position on, by doubling."""
    h, k, m = codes[b], 1, ODD
    with np.errstate(over="ignore"):
        while k < GRAM:
            h = h[:-k] * m + h[k:]
            m, k = m * m, 2 * k
        h ^= h >> np.uint64(32)
        h *= np.uint64(0xD6E8FEB86659FD93)
        h ^= h >> np.uint64(32)
    return h


def sliding_min(a: np.ndarray, w: int) -> np.ndarray:
    k = 1
    while 2 * k <= w:
        a = np.minimum(a[:-k], a[k:])
        k *= 2
    return np.minimum(a[: len(a) - (w - k)], a[w - k :]) if k < w else a


def runs_in(texts: list[bytes], length: int, codes: np.ndarray) -> tuple[np.ndarray, ...]:
    """doc, lo, hi (first and last window start), at (place of the anchor), gram and context hash of all runs in texts of SEGMENT bytes together."""
    docs, bases, parts = [], [], []
    for i, t in enumerate(texts):
        for at in range(0, max(len(t) - length + 1, 0), SEGMENT):
            docs.append(i)
            bases.append(at)
            parts.append(t[at : at + SEGMENT + length - 1])
    empty = np.zeros(0, np.int64)
    out = [[empty], [empty], [empty], [empty], [empty.astype(np.uint64)], [empty.astype(np.uint64)]]
    k = 0
    while k < len(parts):
        stop, total = k, 0
        while stop < len(parts) and (stop == k or total + len(parts[stop]) <= SEGMENT):
            total += len(parts[stop])
            stop += 1
        raw = b"".join(parts[k:stop])
        b = np.frombuffer(raw, np.uint8)
        ends = np.cumsum([len(p) for p in parts[k:stop]])
        h = gram_hashes(b, codes)
        # The place breaks ties, so the leftmost of equal grams is the anchor.
        keyed = (h & ~np.uint64((1 << 24) - 1)) | np.arange(len(h), dtype=np.uint64)
        anchor = (sliding_min(keyed, length - GRAM + 1) & np.uint64((1 << 24) - 1)).astype(np.int64)
        starts = np.arange(len(anchor))
        part = np.searchsorted(ends, starts, side="right")
        valid = starts + length <= ends[part]
        starts, part, anchor = starts[valid], part[valid], anchor[valid]
        first = np.flatnonzero(np.r_[True, (anchor[1:] != anchor[:-1]) | (part[1:] != part[:-1])]) if len(starts) else np.zeros(0, np.int64)
        last = np.r_[first[1:], len(starts)] - 1 if len(first) else first
        lo, hi, at = starts[first], starts[last], anchor[first]
        view = memoryview(raw)
        digest = xxhash.xxh3_64_intdigest
        context = np.fromiter((digest(view[x : y + length], seed=p - x) for x, y, p in zip(lo.tolist(), hi.tolist(), at.tolist())), np.uint64, len(lo))
        of = part[first]
        shift = np.array(bases[k:stop])[of] - np.r_[0, ends[:-1]][of] if len(of) else of
        for o, x in zip(out, (np.array(docs[k:stop], np.int64)[of] if len(of) else empty, lo + shift, hi + shift, at + shift, h[at], context)):
            o.append(x)
        k = stop
    return tuple(map(np.concatenate, out))


def merge(spans: np.ndarray) -> np.ndarray:
    """Disjoint (start, end) rows that cover the same places, in order; touching ones are joined."""
    if not len(spans):
        return spans.reshape(0, 2)
    s = spans[np.argsort(spans[:, 0], kind="stable")]
    reach = np.maximum.accumulate(s[:, 1])
    new = np.r_[True, s[1:, 0] > reach[:-1]]
    return np.column_stack([s[new, 0], reach[np.r_[np.flatnonzero(new)[1:] - 1, len(s) - 1]]])


def found_runs(rows: DataFrame, length: int, keep_first: bool) -> DataFrame:
    """gram, context, n, id, h, lo, hi, at of runs, equal ones of a batch once with their number n; and rows of n 0 whose cover has what is repeated inside a batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes = byte_codes()
        for whole in batches:
            for batch in pieces(whole, SEGMENT):
                doc, lo, hi, at, gram, context = runs_in(texts_of(batch), length, codes)
                ids, hs = batch.column("id"), batch.column("h")
                order = np.lexsort((lo, doc, context, gram))
                g, c = gram[order], context[order]
                first = np.flatnonzero(np.r_[True, (g[1:] != g[:-1]) | (c[1:] != c[:-1])]) if len(g) else np.zeros(0, np.int64)
                n = np.diff(np.r_[first, len(g)])
                kept = order[first]
                again = np.repeat(n > 1, n)
                if keep_first and len(first):
                    again[first] = False
                again = order[again]
                covered = []
                if len(again):
                    again = again[np.argsort(doc[again], kind="stable")]
                    cuts = np.flatnonzero(np.r_[True, doc[again][1:] != doc[again][:-1]])
                    for mine in np.split(again, cuts[1:]):
                        covered.append((int(doc[mine[0]]), merge(np.column_stack([lo[mine], hi[mine] + length])).ravel().tolist()))
                who = pa.array(np.r_[doc[kept], np.array([d for d, _ in covered], np.int64)].astype(np.int64))
                zeros = np.zeros(len(covered), np.int64)
                ids, hs = ids.take(who), hs.take(who)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.r_[gram[kept].view(np.int64), hs.to_numpy()[len(kept) :]].astype(np.int64)),
                        pa.array(np.r_[context[kept].view(np.int64), zeros], mask=np.r_[zeros[:0].astype(bool), np.zeros(len(kept), bool), np.ones(len(covered), bool)]),
                        pa.array(np.r_[n, zeros].astype(np.int32)), ids, hs, pa.array(np.r_[lo[kept], zeros]), pa.array(np.r_[hi[kept], zeros]), pa.array(np.r_[at[kept], zeros]),
                        pa.array([None] * len(kept) + [c for _, c in covered], pa.list_(pa.int64())),
                    ],
                    ["gram", "context", "n", "id", "h", "lo", "hi", "at", "cover"],
                )

    kind = rows.schema["id"].dataType.simpleString()
    return rows.mapInArrow(run, f"gram long, context long, n int, id {kind}, h long, lo long, hi long, at long, cover array<long>")


def hot_grams(runs: DataFrame) -> DataFrame:
    """gram and many (whether it has several contexts) of grams with at least 1 / HOT of all runs; counted before anything is moved."""
    by = runs.filter("n > 0").groupBy("gram").agg(F.count(F.lit(1)).alias("runs"), (F.min("context") < F.max("context")).alias("many"))
    # Fewer runs than parts are not worth dealing.
    by = by.filter(F.col("runs") >= SALTS)
    total = runs.agg(F.count(F.lit(1)).alias("total"))
    return F.broadcast(by.crossJoin(F.broadcast(total)).filter(F.col("runs") * HOT >= F.col("total")).select("gram", "many"))


def by_document(runs: DataFrame, length: int, keep_first: bool) -> DataFrame:
    """For each document with any: cover, what equal contexts repeat, and want, the runs that suffix arrays must look at.

    Runs meet by gram; those of a hot gram by gram and context, which is all that
    counting equal contexts needs.
    """
    same, gram = Window.partitionBy("gram", "salt", "context"), Window.partitionBy("gram", "salt")
    salt = F.when(F.col("many").isNull(), 0).otherwise(F.pmod(F.xxhash64("context"), F.lit(SALTS))).cast("int")
    runs = runs.join(hot_grams(runs), "gram", "left").withColumn("salt", salt).repartition("gram", "salt")
    told = (
        runs.withColumn("total", F.sum("n").over(same))
        .withColumn("place", F.row_number().over(same.orderBy("id", "h", "lo")))
        .withColumn("several", F.coalesce("many", F.min("context").over(gram) < F.max("context").over(gram)))
        .withColumn("hot", F.col("many").isNotNull() | (F.count(F.lit(1)).over(gram) > HOT_RUNS))
    )
    repeated = (F.col("total") >= 2) & ((F.col("place") > 1) if keep_first else F.lit(True))
    ask = (F.col("total") == 1) | F.lit(keep_first)
    sort = F.coalesce("several", F.lit(False)) & (F.col("place") == 1) & (F.col("n") > 0)
    useful = told.select("id", "h", "gram", "lo", "hi", "at", "cover", (repeated & (F.col("n") > 0)).alias("repeated"), sort.alias("sort"), ask.alias("ask"), "hot").filter("cover IS NOT NULL OR repeated OR sort")
    kind = runs.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (i, h), t in runs_of(batches, ["id", "h"]):
            lo, hi = (t.column(x).to_numpy() for x in ("lo", "hi"))
            whole, sort, ask, hot = (np.array(t.column(x).to_pylist(), bool) for x in ("repeated", "sort", "ask", "hot"))
            covers = [np.array(c, np.int64).reshape(-1, 2) for c in t.column("cover").to_pylist() if c]
            spans = merge(np.concatenate([np.column_stack([lo[whole], hi[whole] + length]), *covers]))
            gram = t.column("gram").to_numpy()
            at = t.column("at").to_numpy()
            want = [dict(zip(("gram", "lo", "hi", "at", "ask", "hot"), x)) for x in zip(*(c[sort].tolist() for c in (gram, lo, hi, at, ask, hot)))]
            yield pa.RecordBatch.from_arrays([pa.array([i], t.schema.field("id").type), pa.array([h], pa.int64()), pa.array([spans.ravel().tolist()], pa.list_(pa.int64())), pa.array([want], WANT)], ["id", "h", "cover", "want"])

    placed = useful.repartition("id", "h").sortWithinPartitions("id", "h")
    return placed.mapInArrow(run, f"id {kind}, h long, cover array<long>, want array<struct<gram:long,lo:long,hi:long,at:long,ask:boolean,hot:boolean>>")


WANT = pa.list_(pa.struct([("gram", pa.int64()), ("lo", pa.int64()), ("hi", pa.int64()), ("at", pa.int64()), ("ask", pa.bool_()), ("hot", pa.bool_())]))


def packed(rows: DataFrame) -> DataFrame:
    """id, h and the text compressed: texts cross the network twice, to be cut and to lose their spans."""
    kind = rows.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        press = zstandard.ZstdCompressor(level=3)
        for whole in batches:
            for batch in pieces(whole):
                yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("h"), pa.array([press.compress(t) for t in texts_of(batch)], pa.binary())], ["id", "h", "text"])

    return rows.mapInArrow(run, f"id {kind}, h long, text binary")


def unpacked(batch: pa.RecordBatch) -> list[bytes]:
    return [zstandard.ZstdDecompressor().decompress(t) if t else b"" for t in batch.column("text").to_pylist()]


def contexts(docs: DataFrame, wanted: DataFrame, length: int) -> DataFrame:
    """The bytes of wanted runs by key: the gram; for a hot gram also what the windows of a few offsets have in common."""
    kind = docs.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in pieces(whole, SEGMENT):
                keys, asks, who, lows, cuts = [], [], [], [], []
                for i, (t, want) in enumerate(zip(unpacked(batch), batch.column("want").to_pylist())):
                    for w in want:
                        lo = w["lo"]
                        while lo <= w["hi"]:
                            hi, key = w["hi"], w["gram"]
                            if w["hot"]:
                                # Blocks of offsets from the anchor; equal windows of one are equal in the middle that all its windows share.
                                block = (w["at"] - lo) // OFFSETS
                                top = w["at"] - block * OFFSETS
                                hi = min(hi, top)
                                key = xxhash.xxh3_64_intdigest(t[top : top - OFFSETS + 1 + length], seed=(key + block) & 0xFFFFFFFFFFFFFFFF) - (1 << 63)
                            keys.append(key)
                            asks.append(w["ask"])
                            who.append(i)
                            lows.append(lo)
                            cuts.append(t[lo : hi + length])
                            lo = hi + 1
                ids = pa.array(who, pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(asks, pa.bool_()), batch.column("id").take(ids), batch.column("h").take(ids), pa.array(lows, pa.int64()), pa.array(cuts, pa.binary())], ["key", "ask", "id", "h", "lo", "bytes"])

    given = wanted.withColumnsRenamed({"id": "wid", "h": "wh"})
    met = docs.join(given, docs["id"].eqNullSafe(given["wid"]) & (docs["h"] == given["wh"])).select("id", "h", "text", "want")
    return met.mapInArrow(run, f"key long, ask boolean, id {kind}, h long, lo long, bytes binary")


def suffix_array(flat: np.ndarray, starts: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """The order of the suffixes at starts by their first `length` bytes, and lcp[i] between the i-th and the one before it.

    Radix refinement by words of eight bytes: only suffixes that still have equals go on.
    """
    n, words = len(starts), -(-length // 8)
    order, lcp = np.arange(n), np.full(n, length, np.int64)
    cls = np.zeros(n, np.int64)
    if n:
        lcp[0] = 0
    padded = np.lib.stride_tricks.sliding_window_view(np.r_[flat, np.zeros(8 * words, np.uint8)], 8)
    tail = np.uint64(0xFFFFFFFFFFFFFFFF << (8 * (8 * words - length)) & 0xFFFFFFFFFFFFFFFF)
    active = np.arange(n)
    for d in range(words):
        if not len(active):
            break
        word = np.ascontiguousarray(padded[starts[order[active]] + 8 * d]).view(">u8").ravel().astype(np.uint64)
        if d == words - 1:
            word &= tail
        own = cls[active]
        # Classes stay where they are, and one whose members all go on alike keeps its order: only the others are sorted.
        uneven = np.zeros(n, bool)
        uneven[own[1:][(own[1:] == own[:-1]) & (word[1:] != word[:-1])]] = True
        move = np.flatnonzero(uneven[own])
        if len(move):
            by = move[np.lexsort((word[move], own[move])) if d else np.argsort(word[move])]
            order[active[move]], word[move] = order[active[by]], word[by]
        split = np.flatnonzero((own[1:] == own[:-1]) & (word[1:] != word[:-1])) + 1
        differ = word[split] ^ word[split - 1]
        same = np.zeros(len(split), np.int64)
        for byte in range(7, 0, -1):
            same += differ < np.uint64(1 << (8 * byte))
        lcp[active[split]] = np.minimum(8 * d + same, length)
        fresh = np.r_[True, own[1:] != own[:-1]] if len(own) else np.zeros(0, bool)
        fresh[split] = True
        lead = np.flatnonzero(fresh)
        sizes = np.diff(np.r_[lead, len(active)])
        cls[active] = np.repeat(active[lead], sizes)
        active = active[np.repeat(sizes > 1, sizes)]
        # Neighbours of different classes share less than what was set when they parted.
    edge = np.flatnonzero(cls[1:] != cls[:-1]) + 1
    lcp[edge] = np.minimum(lcp[edge], length - 1)
    return order, lcp


def longest_previous(order: np.ndarray, lcp: np.ndarray, rank: np.ndarray, least: int = 1) -> np.ndarray:
    """LPF by start: the longest match, up to the arrays' length, with a start of smaller rank; 0 where it is under `least`.

    The nearest smaller ranks before and after in suffix order give it; they are
    found for all suffixes at once by following pointers, with the least lcp on the way.
    """
    n = len(order)
    best = np.zeros(n, np.int64)
    own = rank[order]
    for step in (-1, 1):
        at = np.arange(n) + step
        low = lcp.copy() if step < 0 else np.r_[lcp[1:], 0] if n else lcp
        go = np.flatnonzero((at >= 0) & (at < n) & (low >= least))
        while len(go):
            # Those that have reached a smaller rank are done; the others follow the pointer where they stand.
            there = at[go]
            met = own[there] < own[go]
            best[order[go[met]]] = np.maximum(best[order[go[met]]], low[go[met]])
            go, there = go[~met], there[~met]
            low[go], at[go] = np.minimum(low[go], low[there]), at[there]
            go = go[(at[go] >= 0) & (at[go] < n) & (low[go] >= least)]
    return best


def repeats(sorted_rows: DataFrame, length: int, keep_first: bool) -> DataFrame:
    """Spans (id, lo, hi) of asked runs that occur elsewhere (keep_first: earlier, by id, then text, then place)."""
    kind = sorted_rows.schema["id"].dataType.simpleString()

    def judge(held: list[dict]) -> Iterator[tuple]:
        parts = [x["bytes"] for x in held]
        flat = np.frombuffer(b"".join(parts), np.uint8)
        base = np.r_[0, np.cumsum([len(p) for p in parts])]
        n = np.array([len(p) - length + 1 for p in parts])
        of = np.repeat(np.arange(len(parts)), n)
        starts = np.arange(n.sum()) - np.repeat(np.r_[0, np.cumsum(n)[:-1]], n) + base[of]
        order, lcp = suffix_array(flat, starts, length)
        # Rows come by key, id, h and lo, so the order of starts is the order in the documents.
        rank = np.arange(len(starts))
        again = longest_previous(order, lcp, rank, length) >= length
        if not keep_first:
            again |= longest_previous(order, lcp, -rank, length) >= length
        again &= np.array([x["ask"] for x in held])[of]
        hit = np.flatnonzero(again)
        if len(hit):
            cuts = np.flatnonzero((np.diff(hit) != 1) | (np.diff(of[hit]) != 0)) + 1
            for mine in np.split(hit, cuts):
                x = held[of[mine[0]]]
                a = x["lo"] + int(starts[mine[0]] - base[of[mine[0]]])
                yield x["id"], x["h"], a, a + len(mine) - 1 + length

    def batch_of(rows: list[tuple], idtype: pa.DataType) -> pa.RecordBatch:
        cols = list(zip(*rows)) or [(), (), (), ()]
        return pa.RecordBatch.from_arrays([pa.array(cols[0], idtype), *(pa.array(c, pa.int64()) for c in cols[1:])], ["id", "h", "lo", "hi"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[dict] = []
        total, idtype = 0, None
        for _, t in runs_of(batches, ["key"]):
            idtype = t.schema.field("id").type
            group = t.to_pylist()
            held += group
            total += sum(len(x["bytes"]) - length + 1 for x in group)
            if total >= STARTS:
                yield batch_of(list(judge(held)), idtype)
                held, total = [], 0
        if held:
            yield batch_of(list(judge(held)), idtype)

    return sorted_rows.mapInArrow(run, f"id {kind}, h long, lo long, hi long")


def repeated_spans(rows: DataFrame, length: int, keep_first: bool) -> DataFrame:
    """id, h and cover, start and end of all repeated places in turn, for documents that have any; rows: id, h, text."""
    runs = found_runs(rows, length, keep_first)
    mine = cut(by_document(runs, length, keep_first))
    parts = contexts(packed(rows), mine.filter("size(want) > 0").select("id", "h", "want"), length)
    found = repeats(parts.repartition("key").sortWithinPartitions("key", "id", "h", "lo"), length, keep_first)
    sure = mine.filter("size(cover) > 0").select("id", "h", "cover")
    return sure.union(found.select("id", "h", F.array("lo", "hi"))).groupBy("id", "h").agg(F.flatten(F.collect_list("cover")).alias("cover"))


def remove_repeats(docs: DataFrame, *, length: int = 200, keep_first: bool = True, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, h, kept (bytes that stay), n_bytes, n_removed, n_spans, kept_sha256 for every row.

    Removed is each byte inside a string of `length` bytes that also starts
    elsewhere, in the same text or another: with keep_first only where it starts
    earlier (by id, then a hash of the text, then place), so one copy of each
    string stays; without, all copies go.  Overlapping strings count and all
    are judged on the input.  n_spans counts maximal runs of removed bytes.
    Null and empty texts and those under `length` bytes lose nothing.  Rows
    repeated with one id and text are copies of each other: they get the same
    result, so without keep_first all of them go, and with it they all stay as
    the first.  Null ids stay null and come before others; an empty table gives
    no rows; other columns are not read.
    """
    if length < 2 * GRAM:
        raise ValueError(f"length must be at least {2 * GRAM}")
    rows = docs.select(F.col(id_col).alias("id"), F.xxhash64(F.col(text_col)).alias("h"), F.col(text_col).alias("text"))
    spans = repeated_spans(rows.filter(F.octet_length("text") >= length), length, keep_first).withColumnsRenamed({"id": "sid", "h": "sh"})
    kind = rows.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in pieces(whole):
                out = []
                for t, cover in zip(unpacked(batch), batch.column("cover").to_pylist()):
                    gone = merge(np.array(cover or [], np.int64).reshape(-1, 2)).tolist()
                    at, parts = 0, []
                    for a, b in gone:
                        parts.append(t[at:a])
                        at = b
                    kept = b"".join([*parts, t[at:]])
                    out.append((kept, len(t), len(t) - len(kept), len(gone), hashlib.sha256(kept).hexdigest()))
                cols = [pa.array(c, k) for c, k in zip(zip(*out), (pa.binary(), pa.int64(), pa.int64(), pa.int64(), pa.string()))]
                yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("h"), *cols], ["id", "h", "kept", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    rows = packed(rows)
    met = rows.join(spans, rows["id"].eqNullSafe(spans["sid"]) & (rows["h"] == spans["sh"]), "left").select("id", "h", "text", "cover")
    return met.mapInArrow(run, f"id {kind}, h long, kept binary, n_bytes long, n_removed long, n_spans long, kept_sha256 string").withColumnRenamed("id", id_col)
