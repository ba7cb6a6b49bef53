"""Token counts of whole texts, with overlap resynchronisation for huge documents."""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quorumlake.llm.common import kept_in_worker, pieces, texts_of
from quorumlake.llm.tokens import load

OUT = "n_bytes long, n_tokens long, over_limit boolean"


def char_start(raw: bytes, at: int) -> int:
    """The first place from `at` on where a character of UTF-8 begins, or the end."""
    while at < len(raw) and raw[at] & 0xC0 == 0x80:
        at += 1
    return min(at, len(raw))


def around(raw: bytes, at: int) -> tuple[str, str]:
    """The characters before and after a place between characters."""
    low = at - 1
    while raw[low] & 0xC0 == 0x80:
        low -= 1
    return raw[low:at].decode(), raw[at : char_start(raw, at + 1)].decode()


def first_common(coder, raw: bytes, left: list[int], right: list[int], low: int, high: int) -> int | None:
    """The first place in low < x < high where both encodings begin a token and the vocabulary proves that none crosses."""
    begins = set(right)
    for x in left[bisect_right(left, low) :]:
        if x >= high:
            return None
        if x in begins and coder.parts_at(*around(raw, x)):
            return x
    return None


def count_resynchronised(coder, text: str, chunk: int = 1 << 16, overlap: int = 1 << 10) -> int:
    """Tokens of a text of any length.

    Chunks that overlap are encoded with offsets.  Two neighbours are spliced at
    the first place inside their overlap where a token begins in both encodings
    and which the vocabulary proves stable: no token joins the characters on its
    two sides, so neither what came before nor what was cut off after it matters.
    The left chunk counts up to there, the right one from there on.  While there
    is none, the overlap doubles, in the end to the rest of the text; so memory is
    bounded by the chunk and the longest stretch without a stable place.
    """
    raw = text.encode()

    def begins(a: int, b: int) -> list[int]:
        return [a + x for x in coder.begins(raw[a:b].decode())]

    start, counted_to, total = 0, 0, 0
    reach = char_start(raw, min(chunk + overlap, len(raw)))
    left = begins(0, reach)
    while reach < len(raw):
        middle, width = char_start(raw, start + chunk), overlap
        stop = char_start(raw, middle + chunk + overlap)
        right = begins(middle, stop)
        while True:
            end = char_start(raw, middle + width)
            # Both encodings reach the end of the overlap, whose last character may stand beyond where the chunk was cut.
            if reach < end:
                left, reach = begins(start, end), end
            if stop < end:
                stop = char_start(raw, end + overlap)
                right = begins(middle, stop)
            x = first_common(coder, raw, left, right, middle, end)
            if x is not None or end == len(raw):
                break
            width *= 2
        if x is None:
            # Nothing splits the rest: left has all of it.
            return total + len(left) - bisect_left(left, counted_to)
        total += bisect_left(left, x) - bisect_left(left, counted_to)
        start, counted_to, left, reach = middle, x, right, stop
    return total + len(left) - bisect_left(left, counted_to)


def token_counts(docs: DataFrame, path: str, *, id_col: str = "doc_id", text_col: str = "text", limit: int = 4096, chunk: int = 1 << 16, overlap: int = 1 << 10) -> DataFrame:
    """id, n_bytes, n_tokens and over_limit (n_tokens > limit) of every row.

    Null and empty texts have 0 bytes and 0 tokens.  Repeated rows give a row
    each, null ids stay null, an empty table gives no rows and other columns
    are not read.  Texts over chunk bytes are counted in chunks.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = kept_in_worker(("coder", path), lambda: load(path))
        for whole in batches:
            for batch in pieces(whole, 4 << 20):
                raw = texts_of(batch)
                texts = [x.decode() for x in raw]
                long = [coder.splits and len(x) > chunk + overlap for x in raw]
                counts = iter(coder.count_all([t for t, x in zip(texts, long) if not x]))
                n = [count_resynchronised(coder, t, chunk, overlap) if x else next(counts) for t, x in zip(texts, long)]
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(map(len, raw), pa.int64()), pa.array(n, pa.int64()), pa.array([x > limit for x in n], pa.bool_())], ["id", "n_bytes", "n_tokens", "over_limit"])

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    return rows.mapInArrow(run, f"id {kind}, {OUT}").withColumnRenamed("id", id_col)
