"""Mixing sources to target weights by pivotal dependent rounding."""

from __future__ import annotations

import random
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quorumlake.llm.common import SPACES, cut, numbered, runs_of

#: Fractions this near to 0 or 1 are taken as such.
EPS = 1e-12


def word_count(text: Column) -> Column:
    """Number of runs of anything but ASCII white space; null counts 0."""
    trimmed = F.btrim(text, F.lit(" \t\n\x0b\x0c\r"))
    return F.when(trimmed.isNull() | (trimmed == ""), F.lit(0)).otherwise(F.size(F.split(trimmed, SPACES))).cast("long")


def source_targets(sizes: DataFrame, weights: tuple[float, ...], most: float) -> DataFrame:
    """target for each (source, source_size): shares by weight of all words, at most `most` times the source's size.

    Sources are ordered by code point, null last, and take the weights in turn.
    The excess of capped sources goes to the others by weight until none is
    above its cap: each round caps the sources above it and levels the others
    anew, with one row of totals a round.
    """
    place = F.col("number") % len(weights)
    placed = numbered(sizes, F.col("source").isNull(), F.col("source"))
    ranked = cut(placed.withColumn("w", F.element_at(F.array(*map(F.lit, map(float, weights))), place.cast("int") + 1)).withColumn("cap", F.col("source_size") * float(most)))
    level = 0.0
    while True:
        # What a level of 0 caps are sources without words.
        capped = F.col("cap") <= F.lit(level) * F.col("w")
        whole, fixed, rest = ranked.agg(F.sum("source_size"), F.sum(F.when(capped, F.col("cap"))), F.sum(F.when(~capped, F.col("w")))).first()
        fresh = ((whole or 0) - (fixed or 0.0)) / rest if rest else level
        if fresh <= level * (1 + EPS):
            return ranked.withColumn("target", F.least(F.col("cap"), F.lit(level) * F.col("w"))).select("source", "source_size", "n_docs", "target")
        level = fresh


def round_group(rows: list[tuple[int, int, float]], draw: random.Random, apart: float = 8.0) -> tuple[list[int], tuple[int, float] | None]:
    """Whole copies for rows of (size, whole part, fraction), and the place and fraction of the one row left over.

    Rows come in falling size.  The fractions of two rows meet: words move from
    one to the other, either way at random so that each row's expectation
    stays, until one fraction is 0 or 1; the other row meets the next.  A row
    over `apart` times as long as the next meets all the rest as one partner,
    whose fractions all move alike: else a long row would outlast the short
    ones and its rounding would miss the target by much of its length.
    """
    size = np.array([r[0] for r in rows], float)
    part = np.array([r[2] for r in rows], float)
    held: int | None = None
    for j in range(len(rows)):
        if size[j] == 0 or not EPS < part[j] < 1 - EPS:
            continue
        if held is not None and size[held] > apart * size[j]:
            big, p, rest = size[held], part[held], part[j:]
            live = (rest > EPS) & (rest < 1 - EPS) & (size[j:] > 0)
            words = float(size[j:][live].sum())
            up, down = min((1 - p) * big, words * rest[live].min()), min(p * big, words * (1 - rest[live]).min())
            # All fractions move alike either way, so each row's expectation stays.
            if draw.random() * (up + down) < down:
                part[held], part[j:][live] = p + up / big, rest[live] - up / words
            else:
                part[held], part[j:][live] = p - down / big, rest[live] + down / words
            held = held if EPS < part[held] < 1 - EPS else None
            if not EPS < part[j] < 1 - EPS:
                continue
        if held is None:
            held = j
            continue
        p, q = part[held], part[j]
        up, down = min((1 - p) * size[held], q * size[j]), min(p * size[held], (1 - q) * size[j])
        if draw.random() * (up + down) < down:
            part[held], part[j] = p + up / size[held], q - up / size[j]
        else:
            part[held], part[j] = p - down / size[held], q + down / size[j]
        held = next((k for k in (held, j) if EPS < part[k] < 1 - EPS), None)
    copies = [whole + (0 if k == held else int(round(x))) for k, ((_, whole, _), x) in enumerate(zip(rows, part.tolist()))]
    return copies, None if held is None else (held, float(part[held]))


def rounded(rows: DataFrame, level: int, seed: int) -> DataFrame:
    """One level of the reduction tree: rows of a (source, node) are rounded; done is false for the one left over."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (source, node), t in runs_of(batches, ["source", "node"]):
            size, whole, part = (t.column(c).to_pylist() for c in ("size", "whole", "part"))
            copies, held = round_group(list(zip(size, whole, part)), random.Random(f"{seed}/{level}/{source}/{node}"))
            done, part = [True] * len(copies), [0.0] * len(copies)
            if held is not None:
                done[held[0]], part[held[0]] = False, held[1]
            t = t.combine_chunks()
            for name, values, kind in (("whole", copies, pa.int64()), ("part", part, pa.float64()), ("done", done, pa.bool_())):
                t = t.set_column(t.schema.get_field_index(name), name, pa.array(values, kind))
            yield from t.to_batches()

    placed = rows.repartition("source", "node").sortWithinPartitions("source", "node", F.desc("size"), "id", "h")
    return placed.mapInArrow(run, placed.schema)


def mix(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[float, ...] = (1, 2, 3), most: float = 3.0, leaf: int = 4096, fan: int = 256, seed: int = 17) -> DataFrame:
    """id, h, size, source_size, target, copies and taken (copies * size) of every row; h is a hash of the text.

    Each row's expected copies are target / source_size.  Whole parts are taken;
    fractional parts are rounded by pivotal rounding in a reduction tree: leaves
    of about `leaf` rows of a source (so a hot source is many leaves), whose
    left-over rows meet, `fan` leaves at a time, at the next level.  Words taken
    from a source are thus its target up to the fraction of one last row.
    A row much longer than the next meets all the rest as one partner
    (round_group): that keeps every row's expectation like rounding by pairs.

    Null and empty texts have size 0 and take nothing; a null source is a source
    of its own; null ids stay null.  Repeated rows are rounded as rows of their
    own; rows tied in size and id are ordered by text.  An empty table gives no
    rows; other columns are not read.  Reruns agree.
    """
    rows = cut(docs.select(F.col(id_col).alias("id"), F.col(source_col).cast("string").alias("source"), word_count(F.col(text_col)).alias("size"), F.xxhash64(F.col(text_col)).alias("h")))
    sizes = rows.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("n_docs"))
    targets = source_targets(sizes, weights, most).withColumnRenamed("source", "of")
    rate = F.when(F.col("source_size") > 0, F.least(F.col("target") / F.col("source_size"), F.lit(float(most)))).otherwise(0.0)
    leaves = F.ceil(F.col("n_docs") / leaf).cast("long")
    joined = (
        rows.join(targets, F.col("source").eqNullSafe(F.col("of")), "left").drop("of")
        .withColumn("rate", rate)
        .withColumn("whole", F.floor("rate").cast("long"))
        .withColumn("part", F.col("rate") - F.col("whole"))
        .withColumn("leaves", leaves)
        .withColumn("node", F.pmod(F.xxhash64("id", "h", F.lit(seed)), F.col("leaves")))
        .withColumn("done", F.lit(False))
        .drop("rate", "n_docs")
    )
    level, out = 0, []
    now = cut(rounded(joined, level, seed))
    while True:
        out.append(now.filter("done"))
        left = now.filter("NOT done").withColumn("leaves", F.ceil(F.col("leaves") / fan).cast("long")).withColumn("node", F.floor(F.col("node") / fan).cast("long"))
        most_left = now.agg(F.max("leaves")).first()[0] or 1
        if most_left <= 1:
            break
        level += 1
        now = cut(rounded(left, level, seed))
    # What is left at the root is rounded alone, at random by its fraction.
    luck = F.pmod(F.xxhash64("source", "id", F.lit(seed)), F.lit(1 << 52)) / F.lit(float(1 << 52))
    out.append(now.filter("NOT done").withColumn("whole", F.col("whole") + F.when(luck < F.col("part"), 1).otherwise(0)))
    total = out[0]
    for x in out[1:]:
        total = total.unionByName(x)
    return total.select(F.col("id").alias(id_col), "h", "size", "source_size", "target", F.col("whole").alias("copies"), (F.col("whole") * F.col("size")).alias("taken"))
