"""Language identification: string kernels on n-gram presence, Nyström landmarks, one-versus-rest kernel ridge regression."""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quorumlake.llm.common import pieces

#: Lengths of n-grams in bytes.
GRAMS = (2, 3, 4)
#: Bounds of the fit: documents for a language, documents in all, bytes of a document, landmarks, n-grams of a length.
EACH, SAMPLE, LONGEST, LANDMARKS, WIDTH = 300, 1200, 1 << 16, 240, 6000
#: Rows of a language that are looked at for each that is wanted.
SPARE = 4
#: Weight of the ridge and the least eigenvalue of the landmarks' kernel that counts.
RIDGE, LEAST_EIGEN = 1e-3, 1e-6
#: Rows scored at once, and bytes of text.
ROWS, CHUNK = 256, 1 << 20
#: Slots of four-byte n-grams.
SLOTS = 20
#: ASCII that is no letter is a blank; four zero bytes stand between rows.
LETTERS = bytes(c if c >= 128 or chr(c).isalpha() else 32 for c in range(256))


def plain(text: str) -> bytes:
    """The text lower-cased, ASCII that is no letter as blanks."""
    return text.lower().encode().translate(LETTERS)


def parts(texts: list[str], limit: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Bytes of texts with four zeros between rows, and the row of every byte, about limit at a time.

    A longer text comes in parts that overlap by an n-gram less a byte: presence
    does not depend on where an n-gram stands, so the parts have what the text has.
    """

    def together() -> tuple[np.ndarray, np.ndarray]:
        b = np.frombuffer(b"".join(x + b"\0\0\0\0" for _, x in held) + b"\0" * 8, np.uint8)
        return b, np.repeat(np.array([i for i, _ in held], np.int32), [len(x) + 4 for _, x in held])

    held, total = [], 0
    for i, text in enumerate(texts):
        raw = plain(text)
        for a in range(0, max(len(raw), 1), limit):
            held.append((i, raw[a : a + limit + max(GRAMS) - 1]))
            total += len(held[-1][1])
            if total >= limit:
                yield together()
                held, total = [], 0
    if held:
        yield together()


def grams(b: np.ndarray, n: int) -> np.ndarray:
    """The n-gram at each place as a number; those with a zero byte cross rows."""
    return np.ndarray((len(b) - 7,), "<u4", b, strides=(1,)) & np.uint32((1 << 8 * n) - 1)


def within(b: np.ndarray, n: int) -> np.ndarray:
    """Places whose n-gram lies inside one row."""
    full = b != 0
    ok = full[: len(b) - 7].copy()
    for k in range(1, n):
        ok &= full[k : len(b) - 7 + k]
    return ok


def slot(code: np.ndarray) -> np.ndarray:
    return (code * np.uint32(2654435761)) >> np.uint32(32 - SLOTS)


class Model(NamedTuple):
    """Languages, n-grams by length in order of their columns, and weights of columns with the intercept behind them."""

    langs: list[str]
    grams: list[np.ndarray]
    weights: np.ndarray

    def tables(self) -> list[np.ndarray]:
        """For each length the column of a number, -1 for none: by the number itself, or by its slot for four bytes."""
        out, base = [], 0
        for n, codes in zip(GRAMS, self.grams):
            table = np.full(1 << (8 * n if n < 4 else SLOTS), -1, np.int16)
            table[codes if n < 4 else slot(codes)] = np.arange(base, base + len(codes), dtype=np.int16)
            out.append(table)
            base += len(codes)
        return out


def presence(texts: list[str], codes: list[np.ndarray], tables: list[np.ndarray]) -> np.ndarray:
    """A row for each text: 1 / sqrt(number of its n-grams of that length) for each n-gram it has, however often.

    The product of two texts' rows is their blended-spectrum presence kernel:
    for each length, common n-grams over the geometric mean of how many each has,
    summed over lengths, on the n-grams of the landmarks.
    """
    out = np.zeros((len(texts), sum(map(len, codes))), np.float32)
    starts = np.cumsum([0, *map(len, codes)])
    for b, row in parts(texts, CHUNK):
        for n, mine, base, table in zip(GRAMS, codes, starts, tables):
            code = grams(b, n)
            column = table[code if n < 4 else slot(code)]
            at = np.flatnonzero(column >= 0)
            if n == 4:
                at = at[mine[column[at] - base] == code[at]]
            out[row[at], column[at]] = 1
    for low, high in zip(starts, starts[1:]):
        part = out[:, low:high]
        part *= 1 / np.sqrt(np.maximum(part.sum(axis=1, keepdims=True), 1))
    return out


def vocabulary(texts: list[str], width: int = WIDTH) -> list[np.ndarray]:
    """For each length the n-grams that occur in most of the landmarks, at most width of them, two landmarks at least; ties to the smaller number."""
    seen: list[list[np.ndarray]] = [[] for _ in GRAMS]
    for t in texts:
        found = list(parts([t], CHUNK))
        for k, n in enumerate(GRAMS):
            seen[k].append(np.unique(np.concatenate([grams(b, n)[within(b, n)] for b, _ in found])))
    out = []
    for n, each in zip(GRAMS, seen):
        codes, times = np.unique(np.concatenate(each), return_counts=True)
        order = np.lexsort((codes, -times))
        chosen = codes[order[times[order] >= min(2, len(texts))]]
        if n == 4:
            # One n-gram to a slot: the more frequent one.
            chosen = chosen[np.sort(np.unique(slot(chosen), return_index=True)[1])]
        out.append(np.sort(chosen[:width]))
    return out


def train(texts: list[str], langs: list[str], landmarks: int = LANDMARKS, ridge: float = RIDGE, width: int = WIDTH) -> Model:
    """Nyström features from landmarks, ridge regression of +1 or -1 for each language on them.

    The landmarks' kernel gives features K(x, L) E / sqrt(lambda) with its
    eigenvectors E; the ridge is solved on them with an intercept.  Scores are
    K(x, L) A; as K(x, L) is a product of rows, A is folded into one weight for
    each n-gram and language, which changes no score.
    """
    names = sorted(set(langs))
    marks = texts[:landmarks]
    codes = vocabulary(marks, width)
    model = Model(names, codes, np.zeros((0, 0)))
    tables = model.tables()
    rows_of = lambda xs: np.concatenate([presence(xs[a : a + ROWS], codes, tables) for a in range(0, len(xs), ROWS)])
    base = rows_of(marks)
    values, vectors = np.linalg.eigh((base @ base.T).astype(np.float64))
    good = values > LEAST_EIGEN * max(values.max(), 1e-12)
    map_ = vectors[:, good] / np.sqrt(values[good])
    features = np.concatenate([presence(texts[a : a + ROWS], codes, tables) @ base.T for a in range(0, len(texts), ROWS)]).astype(np.float64) @ map_
    y = np.where(np.array(langs)[:, None] == np.array(names)[None, :], 1.0, -1.0)
    middle, level = features.mean(axis=0), y.mean(axis=0)
    centred = features - middle
    w = np.linalg.solve(centred.T @ centred + ridge * len(texts) * np.eye(centred.shape[1]), centred.T @ (y - level))
    return Model(names, codes, np.concatenate([base.T @ (map_ @ w), (level - middle @ w)[None, :]]).astype(np.float32))


def fit(docs: DataFrame, *, text_col: str = "text", lang_col: str = "lang", order: Column, each: int = EACH, sample: int = SAMPLE, longest: int = LONGEST, landmarks: int = LANDMARKS) -> Model | None:
    """A model from labelled documents; None without any.

    The sample is bounded: for each language at most `each` documents of at most
    `longest` bytes with a letter, the first in the order (a 64-bit hash, so no
    source or place is preferred), and `sample` in all, the languages in turn.
    The first of them are the landmarks, so each language has its share.
    """
    has = docs.filter(F.col(text_col).isNotNull() & F.col(lang_col).isNotNull() & (F.octet_length(text_col) <= longest)).filter(F.col(text_col).rlike(r"\p{L}"))
    rows = has.select(F.col(text_col).alias("text"), F.col(lang_col).cast("string").alias("lang"), order.alias("luck"))
    # At most `sample` languages, the most frequent; of each about SPARE times as many rows as are wanted go on, however many there are.
    langs = rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "lang").limit(sample)
    chance = F.shiftrightunsigned(F.coalesce("luck", F.lit(0)), 11) / F.lit(float(1 << 53))
    some = rows.join(F.broadcast(langs), "lang").filter(chance * F.col("n") < SPARE * each)
    place = F.row_number().over(Window.partitionBy("lang").orderBy("luck", "text"))
    first = some.withColumn("place", place).filter(F.col("place") <= each)
    found = first.orderBy("place", "luck", "lang").limit(sample).select("text", "lang").collect()
    return train([r.text for r in found], [r.lang for r in found], landmarks) if found else None


def predict(docs: DataFrame, model: Model | None, *, id_col: str = "doc_id", text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """id, lang_pred and score (0 to 1) of every row, from its whole text alone.

    und with score 0 for a null text or one without a letter; the language of
    the largest output otherwise, the first by name where two are equal, with
    (1 + output) / 2 as score.
    """
    keep = keep or []
    rows = docs.select(F.col(id_col).alias("_id"), *keep, F.coalesce(F.col(text_col).rlike(r"\p{L}"), F.lit(False)).alias("_letter"), F.col(text_col).alias("_text"))
    types = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[: 1 + len(keep)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = model.tables() if model else None
        for whole in batches:
            for piece in pieces(whole, CHUNK, "_text"):
                for a in range(0, piece.num_rows, ROWS):
                    batch = piece.slice(a, ROWS)
                    letter = np.array(batch.column("_letter").to_pylist())
                    if model:
                        scores = presence([t or "" for t in batch.column("_text").to_pylist()], model.grams, tables) @ model.weights[:-1] + model.weights[-1]
                        best = scores.argmax(axis=1)
                        score = np.clip((1 + scores[np.arange(len(best)), best]) / 2, 0, 1)
                    lang = [model.langs[k] if ok else "und" for k, ok in zip(best, letter)] if model else ["und"] * batch.num_rows
                    told = np.where(letter, score, 0.0) if model else np.zeros(batch.num_rows)
                    yield pa.RecordBatch.from_arrays([*[batch.column(k) for k in range(1 + len(keep))], pa.array(lang, pa.string()), pa.array(told, pa.float64())], [*batch.schema.names[: 1 + len(keep)], "lang_pred", "score"])

    return rows.mapInArrow(run, f"{types}, lang_pred string, score double").withColumnRenamed("_id", id_col)


def fold(id_col: str, folds: int) -> Column:
    return F.pmod(F.crc32(F.col(id_col).cast("string")), F.lit(folds))


def languages(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", folds: int = 4, held: int = 2) -> DataFrame:
    """id, held_out, lang_pred and score of every row; learned from rows whose fold of the id is not the held-out one.

    Rows without an id are in no fold: they are predicted, not learned from, and
    not held out.  Rows that repeat give a row each.  Without a labelled text
    nothing is learned and all is und.  An empty table gives no rows; other
    columns are not read.
    """
    model = fit(docs.filter(fold(id_col, folds) != held), text_col=text_col, lang_col=lang_col, order=F.xxhash64(F.col(id_col)))
    out = predict(docs, model, id_col=id_col, text_col=text_col)
    return out.select(id_col, F.coalesce(fold(id_col, folds) == held, F.lit(False)).alias("held_out"), "lang_pred", "score")
