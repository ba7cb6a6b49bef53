"""Language-model scores: context-tree weighting over bytes, beside a smoothed word model.

A code is a place of a text: its byte and the DEPTH bytes before it, the nearest
first, so that codes in order are the leaves of the context tree in order.  Codes
are counted by blocks of documents; the tree is cut below its first TOP bytes, a
subtree for each, and the few levels above come from sums over the subtrees.  A
subtree answers each block with the log probabilities of the block's own codes.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import count

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quorumlake.llm.common import cut, forget_in_worker, pieces, runs_of, texts_of

#: Bytes of context, and those that name a subtree.  A subtree has at most 256**(DEPTH - TOP + 1) codes, the levels above it 256**TOP.
DEPTH, TOP = 5, 3
#: Starts and ends texts; no byte of UTF-8.
EDGE = b"\xff"
SPACE = re.compile(rb"[\x20\x09-\x0D]")
#: Words at least so frequent in training are at most 1 / HEAVY many, so their counts may be sent to all tasks.
HEAVY = 1e-5
#: Bytes of text in a block (one longer text makes a block of its own), places looked at in one go, and codes of a forest of subtrees.
BLOCK, PIECE, FOREST = 16 << 20, 1 << 20, 1 << 18
#: Rows of words packed together on their way back to the blocks.
PACK = 1 << 20
#: Log probabilities are added up over subtrees as whole numbers of this unit, so that their order does not matter.
UNIT = 4096.0
HALF = np.log(0.5)


def log_gamma(x: np.ndarray) -> np.ndarray:
    """ln of the gamma function for x > 0: Stirling's series after eight steps up."""
    shift = np.zeros_like(x)
    for k in range(8):
        shift += np.log(x + k)
    y = x + 8
    return (y - 0.5) * np.log(y) - y + 0.5 * np.log(2 * np.pi) + 1 / (12 * y) - 1 / (360 * y**3) + 1 / (1260 * y**5) - shift


SMALL = 1 << 12
WHOLE_LOGS, HALF_LOGS = log_gamma(np.arange(SMALL) + 1.0), log_gamma(np.arange(SMALL) + 0.5)


def factorials(n: np.ndarray, half: bool) -> np.ndarray:
    """ln gamma(n + 1), or of n + 1/2: most counts are small and looked up."""
    out = (HALF_LOGS if half else WHOLE_LOGS)[np.minimum(n, SMALL - 1)]
    big = np.flatnonzero(n >= SMALL)
    if len(big):
        out[big] = log_gamma(n[big] + (0.5 if half else 1.0))
    return out


class Level:
    """All bit nodes of the contexts of one depth.

    code: context << 8 | symbol, distinct and sorted; n: counts.  At bit k a node
    is a context with the first k bits of the symbol, keyed context << k | bits.
    key, seen, p, own and weight are lists by k; node[k] tells each code's.
    """

    def __init__(self, code: np.ndarray, n: np.ndarray, deeper: Level | None = None, given: list[tuple[np.ndarray, np.ndarray]] | None = None):
        """deeper: the level below; given: the keys of this level's nodes with the summed logs of their children, by bit."""
        self.code, self.n = code, n
        self.key, self.node, self.seen, self.p, self.log, self.weight = [], [], [], [], [], []
        for k in range(8):
            key = code >> (8 - k)
            first = np.flatnonzero(np.r_[True, key[1:] != key[:-1]]) if len(code) else np.zeros(0, np.int64)
            total = np.add.reduceat(n, first) if len(first) else np.zeros(0, np.int64)
            one = np.add.reduceat(n * (code >> (7 - k) & 1), first) if len(first) else total
            own = factorials(total - one, True) + factorials(one, True) - np.log(np.pi) - factorials(total, False)
            self.key.append(key[first])
            self.node.append(np.repeat(np.arange(len(first)), np.diff(np.r_[first, len(code)])))
            self.seen.append(total > 0)
            self.p.append((one + 0.5) / (total + 1))
            if deeper is None and given is None:
                self.log.append(own)
                self.weight.append(np.ones(len(first)))
                continue
            keys, logs = given[k] if given is not None else (parents(deeper.key[k], k), deeper.log[k])
            below = np.bincount(np.searchsorted(self.key[k], keys), logs, len(first))
            self.log.append(HALF + np.logaddexp(own, below))
            self.weight.append(np.exp(HALF + own - self.log[k]))

    def mixed(self, k: int, at: np.ndarray, deeper: np.ndarray | None, known: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
        """The estimates at nodes `at` mixed with the deeper ones where those are known, and which of the nodes were seen themselves."""
        node = self.node[k][at]
        p, w = self.p[k][node], self.weight[k][node]
        return (p if deeper is None else np.where(known, w * p + (1 - w) * deeper, p)), self.seen[k][node]


def parents(key: np.ndarray, k: int) -> np.ndarray:
    """Keys of nodes at bit k, one context byte shorter."""
    return key >> (8 + k) << k | key & ((1 << k) - 1)


def shorter(code: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Codes with one context byte less, their counts, and which of them each code becomes."""
    up, at = np.unique(code >> 16 << 8 | code & 255, return_inverse=True)
    return up, np.bincount(at, n, len(up)).astype(np.int64), at


def levels_of(code: np.ndarray, n: np.ndarray, depth: int, top: int) -> tuple[list[Level], list[np.ndarray]]:
    """Levels of depths `depth` to `top`, deepest first, and which code of each every given code becomes."""
    levels, places = [Level(code, n)], [np.arange(len(code))]
    for _ in range(depth - top):
        code, n, at = shorter(code, n)
        levels.append(Level(code, n, levels[-1]))
        places.append(at[places[-1]])
    return levels, places


def mixed_down(levels: list[Level], places: list[np.ndarray], k: int) -> tuple[np.ndarray | None, np.ndarray | None]:
    """For each code at bit k, the estimate of the last level mixed with all deeper ones, and where that level was seen."""
    deeper = known = None
    for level, at in zip(levels, places):
        deeper, known = level.mixed(k, at, deeper, known)
    return deeper, known


class Crown:
    """The levels above the subtrees, by (context of TOP - 1 bytes, bit node): the whole mixture is a + b * deeper, or c where nothing deeper was seen.

    Plain arrays, so that a worker needs no code of ours to read them.
    """

    @staticmethod
    def of(code: np.ndarray, n: np.ndarray, given: list[tuple[np.ndarray, np.ndarray]], depth: int = TOP - 1) -> list[tuple[np.ndarray, ...]]:
        levels, at = [Level(code, n, given=given)], [np.arange(len(code))]
        for _ in range(depth):
            code, n, up = shorter(code, n)
            levels.append(Level(code, n, levels[-1]))
            at.append(up[at[-1]])
        out = []
        for k in range(8):
            low = levels[0]
            first = np.flatnonzero(np.r_[True, low.node[k][1:] != low.node[k][:-1]]) if len(low.code) else np.zeros(0, np.int64)
            a, b, c, known = np.zeros(len(first)), np.ones(len(first)), None, None
            for level, place in zip(levels, at):
                node = level.node[k][place[first]]
                p, w = level.p[k][node], level.weight[k][node]
                c = p if c is None else np.where(known, w * p + (1 - w) * c, p)
                a, b, known = w * p + (1 - w) * a, (1 - w) * b, level.seen[k][node]
            out.append((low.key[k], a, b, c))
        return out


def code_logs(code: np.ndarray, n: np.ndarray, crown: list[tuple[np.ndarray, ...]], depth: int = DEPTH, top: int = TOP) -> np.ndarray:
    """log10 probability of each code's byte after its context, for whole subtrees."""
    levels, places = levels_of(code, n, depth, top)
    out = np.zeros(len(code))
    symbol = code & 255
    for k in range(8):
        deeper, known = mixed_down(levels, places, k)
        keys, a, b, c = crown[k]
        # The node of the code's context of top - 1 bytes.
        at = np.searchsorted(keys, code >> 8 * (depth - top + 2) << k | symbol >> (8 - k))
        one = np.where(known, a[at] + b[at] * deeper, c[at])
        out += np.log10(np.where(symbol >> (7 - k) & 1, one, 1 - one))
    return out


def places_of(texts: list[bytes], depth: int = DEPTH) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Codes of the joined texts and the text of each, PIECE places at a time."""
    raw = b"".join(EDGE * depth + t + EDGE for t in texts)
    ends = np.cumsum([len(t) + depth + 1 for t in texts]).astype(np.int64)
    begins = np.r_[0, ends[:-1]]
    for start in range(depth, len(raw), PIECE):
        b = np.frombuffer(raw, np.uint8, min(len(raw), start + PIECE) - start + depth, start - depth)
        code = np.zeros(len(b) - depth, np.int64)
        for back in range(1, depth + 1):
            code <<= 8
            code |= b[depth - back : len(b) - back]
        code <<= 8
        code |= b[depth:]
        stop = start + len(code)
        first, last = np.searchsorted(ends, [start, stop - 1], side="right")
        edges = np.clip(np.r_[begins[first : last + 1], stop], start, stop)
        of = np.repeat(np.arange(first, last + 1), np.diff(edges))
        # The first places of a text are the edge before it.
        own = np.ones(len(code), bool)
        for k in range(depth):
            at = begins[first : last + 1] + k - start
            own[at[(at >= 0) & (at < len(code))]] = False
        yield code[own], of[own]


def word_tables() -> tuple[np.ndarray, np.ndarray]:
    """A number for each byte, and an odd one for each place in a word."""
    r = np.random.RandomState(23)
    draw = lambda n: r.randint(0, 1 << 32, n, np.uint64) << np.uint64(32) | r.randint(0, 1 << 32, n, np.uint64)
    return draw(256), draw(256) | np.uint64(1)


def parts_of(text: bytes) -> Iterator[bytes]:
    """A text in parts of about PIECE bytes, cut at white space."""
    start = 0
    while len(text) - start > PIECE:
        m = SPACE.search(text, start + PIECE)
        if m is None:
            break
        yield text[start : m.end()]
        start = m.end()
    yield text[start:]


def word_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of all words of the texts in order, and how many words each text has.

    A hash sums, over the bytes of a word, a number of the byte times a number of
    its place.  Among 1e7 different words two share one with a chance of 3e-6.
    """
    byte, place = word_tables()
    out, n = [], np.zeros(len(texts), np.int64)
    held, total = [], 0

    def look() -> None:
        raw = b"\n".join(t for _, t in held)
        b = np.frombuffer(raw, np.uint8)
        at = np.flatnonzero((b != 32) & ((b < 9) | (b > 13)))
        if not len(at):
            return
        first = np.flatnonzero(np.r_[True, np.diff(at) != 1])
        sizes = np.diff(np.r_[first, len(at)])
        inside = np.arange(len(at)) - np.repeat(first, sizes)
        h = np.add.reduceat(byte[b[at]] * place[inside & 255], first)
        # Beyond 256 bytes places would repeat.
        for k in np.flatnonzero(sizes > 256).tolist():
            h[k] = xxhash.xxh3_64_intdigest(raw[at[first[k]] : at[first[k]] + sizes[k]])
        h ^= h >> np.uint64(29)
        h *= np.uint64(0xBF58476D1CE4E5B9)
        out.append(h ^ h >> np.uint64(32))
        ends = np.cumsum([len(t) + 1 for _, t in held])
        np.add.at(n, np.array([i for i, _ in held])[np.searchsorted(ends, at[first], side="right")], 1)

    for i, t in enumerate(texts):
        for part in parts_of(t):
            held.append((i, part))
            total += len(part)
            if total >= PIECE:
                look()
                held, total = [], 0
    if held:
        look()
    return np.concatenate(out).view(np.int64) if out else np.zeros(0, np.int64), n


def block_words(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The distinct words of texts by their hashes, in order of appearance, the number of each word, and how many words each text has."""
    h, n = word_hashes(texts)
    number, words = pd.factorize(h)
    return words, number, n


def blocks_of(rows: DataFrame) -> DataFrame:
    """Documents (id, text, held_out) by blocks: their ids, sizes, folds and lower-cased texts, compressed."""
    kind = rows.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget_in_worker()
        press, serial = zstandard.ZstdCompressor(level=1), count(TaskContext.get().partitionId() << 32)
        ids, texts, held, total = [], [], [], 0

        def full() -> pa.RecordBatch:
            sizes = pa.array([list(map(len, texts))], pa.list_(pa.int64()))
            id_list = pa.ListArray.from_arrays(pa.array([0, len(texts)], pa.int32()), pa.concat_arrays(ids))
            return pa.RecordBatch.from_arrays([pa.array([next(serial)], pa.int64()), id_list, sizes, pa.array([held], pa.list_(pa.bool_())), pa.array([press.compress(b"".join(texts))], pa.binary())], ["block", "ids", "sizes", "held", "blob"])

        for whole in batches:
            for batch in pieces(whole, PIECE):
                found = [t.lower() for t in texts_of(batch)]
                size = sum(map(len, found))
                if texts and total + size > BLOCK:
                    yield full()
                    ids, texts, held, total = [], [], [], 0
                ids.append(batch.column("id"))
                texts += found
                held += batch.column("held_out").to_pylist()
                total += size
        if texts:
            yield full()

    return rows.mapInArrow(run, f"block long, ids array<{kind}>, sizes array<long>, held array<boolean>, blob binary")


def texts_in(blob: bytes, sizes: list[int]) -> list[bytes]:
    raw = zstandard.ZstdDecompressor().decompress(blob)
    ends = np.cumsum(sizes).tolist()
    return [raw[b - n : b] for b, n in zip(ends, sizes)]


def lists_of(values: np.ndarray, ends: np.ndarray) -> pa.Array:
    """Bytes of values in one binary cell for each run of rows: ends has len + 1 row numbers."""
    width = values.dtype.itemsize * (values.shape[1] if values.ndim > 1 else 1)
    return pa.Array.from_buffers(pa.binary(), len(ends) - 1, [None, pa.py_buffer((ends * width).astype(np.int32).tobytes()), pa.py_buffer(values.tobytes())])


def block_codes(texts: list[bytes]) -> tuple[np.ndarray, Iterator[tuple[np.ndarray, np.ndarray]]]:
    """The distinct codes of a block, in order, and for each of its pieces which of them its places have, and their texts.

    Of a piece only what is short is held: numbers of four bytes, and how many
    places in turn each text has.
    """
    held, found = [], []
    for places, of in places_of(texts):
        number, codes = pd.factorize(places)
        first = np.flatnonzero(np.r_[True, of[1:] != of[:-1]])
        held.append((number.astype(np.int32), of[first], np.diff(np.r_[first, len(of)])))
        found.append(codes)
    sizes = np.cumsum([len(c) for c in found])
    code, at = np.unique(np.concatenate(found), return_inverse=True)
    at = np.split(at.astype(np.int32), sizes[:-1])
    return code, ((to[number], np.repeat(of, n)) for to, (number, of, n) in zip(at, held))


def counted(blocks: DataFrame) -> DataFrame:
    """For each block and subtree the block's codes, without the subtree's bytes, and their training counts.

    low has three bytes a code, few one byte of its count; counts from 255 on stand in many, in order.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget_in_worker()
        for batch in batches:
            for k in range(batch.num_rows):
                block, sizes, held, blob = (batch.column(c)[k].as_py() for c in ("block", "sizes", "held", "blob"))
                texts, out = texts_in(blob, sizes), np.array(held)
                code, places = block_codes(texts)
                n = np.zeros(len(code), np.int64)
                for at, of in places:
                    n += np.bincount(at[~out[of]], minlength=len(code))
                del places
                tree = code >> 8 * (DEPTH - TOP + 1)
                first = np.flatnonzero(np.r_[True, tree[1:] != tree[:-1]])
                ends = np.r_[first, len(code)]
                low = np.column_stack([code >> 8 * k & 255 for k in range(DEPTH - TOP + 1)]).astype(np.uint8)
                big = n >= 255
                many = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(big)][ends], pa.int32()), pa.array(n[big]))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(first), block)), pa.array(tree[first].astype(np.int32)), lists_of(low, ends), lists_of(np.minimum(n, 255).astype(np.uint8), ends), many], ["block", "tree", "low", "few", "many"]
                )

    return blocks.mapInArrow(run, "block long, tree int, low binary, few binary, many array<long>")


def forests(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Table, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Whole subtrees of rows sorted by subtree, about FOREST codes together: the rows, distinct codes and their counts, which of them each row's codes are, and the rows' numbers of codes."""
    held, total = [], 0

    def together() -> tuple:
        t = pa.concat_tables(held)
        few = t.column("few").to_pylist()
        sizes = np.fromiter(map(len, few), np.int64, len(few))
        n = np.frombuffer(b"".join(few), np.uint8).astype(np.int64)
        n[n == 255] = t.column("many").combine_chunks().flatten().to_numpy()
        low = np.frombuffer(b"".join(t.column("low").to_pylist()), np.uint8).reshape(-1, DEPTH - TOP + 1).astype(np.int64)
        code = np.repeat(t.column("tree").to_numpy().astype(np.int64), sizes) << 8 * (DEPTH - TOP + 1)
        for k in range(DEPTH - TOP + 1):
            code |= low[:, k] << 8 * k
        code, at = np.unique(code, return_inverse=True)
        return t, code, np.bincount(at, n, len(code)).astype(np.int64), at, sizes

    for _, t in runs_of(batches, ["tree"]):
        held.append(t)
        total += t.column("few").nbytes
        if total >= FOREST:
            yield together()
            held, total = [], 0
    if held:
        yield together()


def words_of(blocks: DataFrame) -> DataFrame:
    """(word, n): each block's words, by hash, with their training counts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                sizes, held, blob = (batch.column(c)[k].as_py() for c in ("sizes", "held", "blob"))
                words, number, _ = block_words([t for t, out in zip(texts_in(blob, sizes), held) if not out])
                yield pa.RecordBatch.from_arrays([pa.array(words), pa.array(np.bincount(number, minlength=len(words)).astype(np.int64))], ["word", "n"])

    return blocks.mapInArrow(run, "word long, n long")


def packed(rows: DataFrame) -> DataFrame:
    """(block, at, n) by block: the numbers of many rows as bytes, at most PACK rows at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, total = [], 0

        def together() -> pa.RecordBatch:
            block, at, n = (np.concatenate([b.column(c).to_numpy() for b in held]) for c in ("block", "at", "n"))
            order = np.argsort(block, kind="stable")
            block = block[order]
            first = np.flatnonzero(np.r_[True, block[1:] != block[:-1]])
            pairs = np.column_stack([at[order].astype(np.int64), n[order]])
            return pa.RecordBatch.from_arrays([pa.array(block[first]), lists_of(np.ascontiguousarray(pairs.astype(np.uint32)), np.r_[first, len(block)])], ["block", "rare"])

        for batch in batches:
            if batch.num_rows:
                held.append(batch)
                total += batch.num_rows
            if total >= PACK:
                yield together()
                held, total = [], 0
        if held:
            yield together()

    return rows.mapInArrow(run, "block long, rare binary")


def crown_sums(placed: DataFrame) -> DataFrame:
    """(bit, key, n, log): for bit 8 the counts of codes of TOP - 1 context bytes, for bits 0-7 the summed logs of the subtrees below a node."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget_in_worker()
        for _, code, n, *_ in forests(batches):
            level = levels_of(code, n, DEPTH, TOP)[0][-1]
            up, total, _ = shorter(level.code, level.n)
            parts = [(8, up, total, np.zeros(len(up), np.int64))]
            for k in range(8):
                key, at = np.unique(parents(level.key[k], k), return_inverse=True)
                logs = np.bincount(at, np.rint(level.log[k] * UNIT), len(key)).astype(np.int64)
                parts.append((k, key, np.zeros(len(key), np.int64), logs))
            for k, key, m, logs in parts:
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(key), k, np.int32)), pa.array(key), pa.array(m), pa.array(logs)], ["bit", "key", "n", "log"])

    return placed.mapInArrow(run, "bit int, key long, n long, log long").groupBy("bit", "key").agg(F.sum("n").alias("n"), F.sum("log").alias("log"))


def crown_of(sums: pd.DataFrame) -> list[tuple[np.ndarray, ...]]:
    by = {k: g.sort_values("key") for k, g in sums.groupby("bit")}
    empty = np.zeros(0, np.int64)
    column = lambda k, c: by[k][c].to_numpy(np.int64) if k in by else empty
    return Crown.of(column(8, "key"), column(8, "n"), [(column(k, "key"), column(k, "log") / UNIT) for k in range(8)])


def language_scores(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", folds: int = 7, held: int = 2) -> DataFrame:
    """id, held_out, n_tokens, n_known, train_tokens, base_score, score and bits_per_byte for every row.

    Rows whose crc32 of the id as text leaves the remainder `held` by `folds`
    are held out; the others train both models over all their text.  A-Z count
    as lower case.  base_score sums log10((c + 1) / (N + V + 1)) over the words
    (runs of anything but ASCII white space) and one end; score is the log10
    probability that context-tree weighting gives the bytes and their end, and
    bits_per_byte its code length by byte of text and end.

    Every context of up to DEPTH bytes that occurs is counted, so the model grows
    with the corpus.  A node's estimate is weighted against the deeper ones by
    its share in the weighted probability of its training bits; counts are frozen
    after training, and where a context was never seen the mixture ends above it.

    Null and empty texts have the end alone; a null id counts as empty text.
    Repeated rows count, and get a row, each.  With no training rows all counts
    are 0.  An empty table gives no rows; other columns are not read.

    Words that make up at least HEAVY of the training tokens are looked up in
    each task; the others of a block get their counts from a window over the word.
    """
    text_id = F.coalesce(F.col(id_col).cast("string"), F.lit(""))
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), (F.crc32(text_id) % folds == held).alias("held_out"))
    kind = rows.schema["id"].dataType.simpleString()
    # Written out, so that all later steps see the same blocks.
    blocks = cut(blocks_of(rows))
    trees = cut(counted(blocks).repartition("tree").sortWithinPartitions("tree", "block"))
    crown = crown_of(crown_sums(trees).toPandas())
    totals = words_of(blocks).groupBy("word").agg(F.sum("n").alias("n"))
    n_words, n_distinct = totals.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count(F.lit(1))).first()
    ends = rows.filter("NOT held_out").count()
    # Each training text has one end, a token of its own.
    n_all, n_distinct = n_words + ends, n_distinct + (ends > 0)
    common = totals.filter(F.col("n") >= HEAVY * n_all).orderBy("word").toPandas()
    sent = docs.sparkSession.sparkContext.broadcast((crown, common.word.to_numpy(np.int64), common.n.to_numpy(np.int64)))

    def asked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        frequent = sent.value[1]
        for batch in batches:
            for k in range(batch.num_rows):
                block, sizes, held, blob = (batch.column(c)[k].as_py() for c in ("block", "sizes", "held", "blob"))
                words, number, n = block_words(texts_in(blob, sizes))
                times = np.bincount(number[np.repeat(~np.array(held), n)], minlength=len(words))
                rare = np.flatnonzero(~np.isin(words, frequent))
                yield pa.RecordBatch.from_arrays([pa.array(words[rare]), pa.array(np.full(len(rare), block)), pa.array(rare.astype(np.int32)), pa.array(times[rare].astype(np.int32))], ["word", "block", "at", "n"])

    def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget_in_worker()
        top = sent.value[0]
        for t, code, n, at, sizes in forests(batches):
            logs = code_logs(code, n, top).astype(np.float32)[at]
            yield from pa.table([t.column("block"), t.column("tree"), lists_of(logs, np.r_[0, np.cumsum(sizes)])], ["block", "tree", "logs"]).to_batches()

    def tell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget_in_worker()
        frequent, counts = sent.value[1:]
        for _, t in runs_of(batches, ["block"]):
            # The block's codes, in order, are what its logs belong to.
            logs = np.frombuffer(b"".join(x for x in t.column("logs").to_pylist() if x), np.float32)
            pairs = np.frombuffer(b"".join(x for x in t.column("rare").to_pylist() if x), np.uint32).reshape(-1, 2)
            row = t.filter(pa.compute.is_valid(t.column("blob")))
            sizes, out, ids = row.column("sizes")[0].as_py(), row.column("held")[0].as_py(), row.column("ids").combine_chunks().flatten()
            texts = texts_in(row.column("blob")[0].as_py(), sizes)
            m = len(texts)
            score = np.zeros(m)
            for at, of in block_codes(texts)[1]:
                score += np.bincount(of, logs[at], m)
            words, number, n = block_words(texts)
            at = np.minimum(np.searchsorted(frequent, words), max(len(frequent) - 1, 0))
            c = np.where(frequent[at] == words, counts[at], 0) if len(frequent) else np.zeros(len(words), np.int64)
            c[pairs[:, 0]] = pairs[:, 1]
            c = c[number]
            own = np.repeat(np.arange(m), n)
            sums = np.bincount(own, np.log10(c + 1.0), m) + np.log10(ends + 1)
            known = np.bincount(own, c > 0, m).astype(np.int64) + (ends > 0)
            yield pa.RecordBatch.from_arrays([ids, pa.array(out), pa.array(n + 1), pa.array(sizes, pa.int64()), pa.array(known), pa.array(sums), pa.array(score)], ["id", "held_out", "n_tokens", "n_bytes", "n_known", "sums", "score"])

    # A rare word has a row for each block that holds it: a share of HEAVY at most, so no window is large.
    rare = blocks.mapInArrow(asked, "word long, block long, at int, n int").select("block", "at", F.sum("n").over(Window.partitionBy("word")).alias("n")).filter("n > 0")
    lists = packed(rare)
    logs = trees.mapInArrow(answer, "block long, tree int, logs binary")
    every = logs.unionByName(lists, allowMissingColumns=True).unionByName(blocks, allowMissingColumns=True)
    told = every.repartition("block").sortWithinPartitions("block", "tree").mapInArrow(tell, f"id {kind}, held_out boolean, n_tokens long, n_bytes long, n_known long, sums double, score double")
    level = float(np.log10(n_all + n_distinct + 1))
    return told.select(
        F.col("id").alias(id_col), "held_out", "n_tokens", "n_known", F.lit(n_all).cast("long").alias("train_tokens"),
        (F.col("sums") - F.col("n_tokens") * level).alias("base_score"), "score",
        (-F.col("score") / float(np.log10(2)) / (F.col("n_bytes") + 1)).alias("bits_per_byte"),
    )
