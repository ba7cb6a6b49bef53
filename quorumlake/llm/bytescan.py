"""Scans of Arrow's text buffers with NumPy: byte classes, words, 64-bit hashes of words and their comparison."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash

#: Words over so many bytes are hashed and compared one by one.
LONG = 256
MASKS = np.array([(1 << 8 * k) - 1 for k in range(8)] + [(1 << 64) - 1], np.uint64)
START, STEP = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9)


def text_buffer(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column, with eight zeros behind them, and the offsets of its rows in them; null is empty."""
    column = column.fill_null("").cast(pa.large_binary())
    at = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    raw = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data is not None and len(column) else np.zeros(0, np.uint8)
    return np.concatenate([raw, np.zeros(8, np.uint8)]), at - at[0]


def word_spans(inside: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of bytes that are inside words; a run does not cross rows."""
    if not len(inside):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    first, last = inside.copy(), inside.copy()
    first[1:] &= ~inside[:-1]
    last[:-1] &= ~inside[1:]
    filled = np.flatnonzero(np.diff(offsets))
    low, high = offsets[:-1][filled], offsets[1:][filled] - 1
    first[low], last[high] = inside[low], inside[high]
    return np.flatnonzero(first), np.flatnonzero(last) + 1


def eights(b: np.ndarray) -> np.ndarray:
    """The eight bytes from each place on as one number; b ends with eight spare bytes."""
    return np.ndarray((len(b) - 7,), "<u8", b, strides=(1,))


def word_hashes(b: np.ndarray, starts: np.ndarray, ends: np.ndarray, seed: np.ndarray | int = 0) -> np.ndarray:
    """A 64-bit hash of each word and its seed, made of eight bytes at a time."""
    at, sizes = eights(b), ends - starts
    with np.errstate(over="ignore"):
        h = (sizes.astype(np.uint64) + np.asarray(seed).astype(np.uint64)) * START
        rest = np.flatnonzero(sizes <= LONG)
        k = 0
        while len(rest):
            x = h[rest] ^ (at[starts[rest] + k] & MASKS[np.minimum(sizes[rest] - k, 8)])
            x *= STEP
            h[rest] = x ^ x >> np.uint64(31)
            k += 8
            rest = rest[sizes[rest] > k]
        for i in np.flatnonzero(sizes > LONG).tolist():
            h[i] ^= np.uint64(xxhash.xxh3_64_intdigest(b[starts[i] : ends[i]].tobytes()))
        h *= START
        h ^= h >> np.uint64(29)
        h *= STEP
    return h ^ h >> np.uint64(32)


def same_words(b: np.ndarray, starts: np.ndarray, ends: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Whether words i and j have the same bytes."""
    at, sizes = eights(b), ends - starts
    equal = sizes[i] == sizes[j]
    rest = np.flatnonzero(equal & (sizes[i] <= LONG))
    k = 0
    while len(rest):
        mask = MASKS[np.minimum(sizes[i[rest]] - k, 8)]
        alike = (at[starts[i[rest]] + k] & mask) == (at[starts[j[rest]] + k] & mask)
        equal[rest[~alike]] = False
        k += 8
        rest = rest[alike]
        rest = rest[sizes[i[rest]] > k]
    for x in np.flatnonzero(equal & (sizes[i] > LONG)).tolist():
        equal[x] = np.array_equal(b[starts[i[x]] : ends[i[x]]], b[starts[j[x]] : ends[j[x]]])
    return equal


def prefix_counts(flags: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """How many flags are set in each row, from prefix sums."""
    sums = np.zeros(len(flags) + 1, np.int64)
    np.cumsum(flags, out=sums[1:])
    return sums[offsets[1:]] - sums[offsets[:-1]]
