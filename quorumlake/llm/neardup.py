"""Near duplicates: one-permutation MinHash with optimal densification, banded buckets, star-shaped candidates."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quorumlake.llm.common import cut, forget_in_worker, pieces, runs_of, texts_of
from quorumlake.llm.components import components

#: Bins of a signature at most, except where the threshold asks for more single ones, and the rows of a band at most.
BINS, ROWS = 192, 6
#: The chance at most that a pair at the threshold shares no band.
MISS = 3e-7
#: Members of a hub's block that one task compares; larger groups are split.
BLOCK = 4000


def bands_of(percent: int) -> tuple[int, int]:
    """Bands, and rows in each: as many rows as leave a pair at the threshold a chance of MISS at most within BINS bins.

    32 bands of six for 85 (a pair of similarity 0.5 meets in 4 of 10 cases), 38 of five for 80.
    """
    alike = min(max(percent, 1), 99) / 100
    bands = 0
    for rows in range(ROWS, 0, -1):
        bands = math.ceil(math.log(MISS) / math.log1p(-(alike**rows)))
        if bands * rows <= BINS:
            return bands, rows
    return bands, 1


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of unsigned 64-bit integers."""
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def shingle_set(raw: bytes, k: int) -> np.ndarray:
    """Sorted 64-bit hashes of the distinct k-word shingles; the whole sequence if there are fewer words, none without words."""
    words = raw.lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    if len(words) < k:
        return np.array([xxhash.xxh3_64_intdigest(b" ".join(words), seed=len(words))], np.uint64)
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    s = np.zeros(len(words) - k + 1, np.uint64)
    for j in range(k):
        s = mixed(s + h[j : j + len(s)] + np.uint64(j + 1))
    return np.unique(s)


def probes(bins: int) -> np.ndarray:
    """For each bin, the order in which it looks for a filled one: the same for all documents."""
    r = np.random.RandomState(11)
    return np.array([r.permutation(bins) for _ in range(bins)])


def signature(s: np.ndarray, order: np.ndarray, bins: int) -> np.ndarray:
    """One-permutation MinHash: the least hash of each bin; an empty bin copies the first filled bin of its own order."""
    spread = mixed(s)
    spread.sort()
    place = ((spread >> np.uint64(32)) * np.uint64(bins)) >> np.uint64(32)
    first = np.flatnonzero(np.r_[True, place[1:] != place[:-1]])
    filled = np.zeros(bins, bool)
    filled[place[first]] = True
    out = np.zeros(bins, np.uint64)
    out[place[first]] = spread[first]
    empty = np.flatnonzero(~filled)
    if len(empty):
        tries = order[empty]
        out[empty] = out[tries[np.arange(len(empty)), filled[tries].argmax(1)]]
    return out


def signed(docs: DataFrame, k: int, bands: int, rows: int) -> DataFrame:
    """n_shingles, cls (a 128-bit digest of the set) and band keys of every row."""
    bins = bands * rows

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget_in_worker()
        order = probes(bins)
        salt = mixed(np.arange(1, bands + 1, dtype=np.uint64))
        for whole in batches:
            for batch in pieces(whole):
                n, cls, keys = [], [], []
                for raw in texts_of(batch):
                    s = shingle_set(raw, k)
                    n.append(len(s))
                    cls.append(xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None)
                    if len(s):
                        sig = signature(s, order, bins).reshape(bands, rows)
                        key = salt.copy()
                        for j in range(rows):
                            key = mixed(key + sig[:, j])
                        keys.append(key.astype(np.int64))
                flat = np.concatenate(keys) if keys else np.zeros(0, np.int64)
                ends = np.concatenate([[0], np.cumsum([bands * (x > 0) for x in n])])
                lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat))
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(cls, pa.binary()), lists], ["id", "n_shingles", "cls", "keys"])

    kind = docs.schema["id"].dataType.simpleString()
    return docs.mapInArrow(run, f"id {kind}, n_shingles long, cls binary, keys array<long>")


def sets_of(docs: DataFrame, wanted: DataFrame, k: int) -> DataFrame:
    """cls and its set, for the classes in wanted (cls, rep): each read from the text of its document rep."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget_in_worker()
        # Rows that share an id meet in one partition of the join: a class is read once.
        seen: set[bytes] = set()
        for whole in batches:
            for batch in pieces(whole):
                cls, sets = [], []
                for raw, want in zip(texts_of(batch), batch.column("cls").to_pylist()):
                    if want in seen:
                        continue
                    s = shingle_set(raw, k)
                    if len(s) and xxhash.xxh3_128_digest(s.tobytes()) == want:
                        seen.add(want)
                        cls.append(want)
                        sets.append(s.tobytes())
                yield pa.RecordBatch.from_arrays([pa.array(cls, pa.binary()), pa.array(sets, pa.binary())], ["cls", "set"])

    met = docs.join(wanted, docs["id"].eqNullSafe(wanted["rep"])).select("text", "cls")
    return met.mapInArrow(run, "cls binary, set binary")


def linked_in_block(hub: int | None, names: list[bytes], sets: list[np.ndarray], percent: int, ask: list[int] | None = None) -> tuple[list[tuple[bytes, bytes]], list[int]]:
    """Links that span the block's classes, and the places that the hub is not linked with.

    The hub is compared with all, then each class it is not linked with (or
    those in ask): one pass over the block each, so no pair is written down.
    """
    ends = np.cumsum([len(s) for s in sets])
    starts = ends - [len(s) for s in sets]
    _, flat = np.unique(np.concatenate(sets), return_inverse=True)
    sizes = ends - starts
    root = list(range(len(sets)))

    def find(i: int) -> int:
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    mark = np.zeros(int(flat.max()) + 1, np.int64)
    links = []

    def compare(i: int) -> np.ndarray:
        own = flat[starts[i] : ends[i]]
        mark[own] = 1
        both = np.add.reduceat(mark[flat], starts)
        mark[own] = 0
        return 100 * both >= percent * (sizes[i] + sizes - both)

    strays = ask
    if strays is None:
        near = compare(hub)
        strays = np.flatnonzero(~near).tolist()
        for j in np.flatnonzero(near).tolist():
            if j != hub:
                root[find(j)] = find(hub)
                links.append((names[hub], names[j]))
    for i in strays:
        for j in np.flatnonzero(compare(i)).tolist():
            if find(i) != find(j):
                root[find(j)] = find(i)
                links.append((names[i], names[j]))
    return links, strays


def verified(rows: DataFrame, percent: int) -> DataFrame:
    """Links (a, b) in each block, and stray rows (a null): classes that the hub of a split group is not linked with."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget_in_worker()
        for (hub, _), t in runs_of(batches, ["hub", "block"]):
            names = t.column("cls").to_pylist()
            sets = [np.frombuffer(s, np.uint64) for s in t.column("set").to_pylist()]
            split = t.column("blocks")[0].as_py() > 1
            asked = t.column("ask").to_pylist()
            if any(asked):
                links, strays = linked_in_block(None, names, sets, percent, [i for i, x in enumerate(asked) if x])[0], []
            else:
                links, strays = linked_in_block(names.index(hub), names, sets, percent)
            out = [(a, b, None) for a, b in links] + [(None, names[i], hub) for i in strays if split]
            cols = zip(*out) if out else ([], [], [])
            yield pa.RecordBatch.from_arrays([pa.array(list(c), pa.binary()) for c in cols], ["a", "b", "hub"])

    placed = rows.repartition("hub", "block").sortWithinPartitions("hub", "block", "cls")
    return placed.mapInArrow(run, "a binary, b binary, hub binary")


def blocks_of(members: DataFrame, sets: DataFrame, block: int) -> DataFrame:
    """(hub, block, blocks, cls, set, ask): each hub's members in blocks, the hub itself in every block."""
    counts = members.groupBy("hub").agg(F.ceil(F.count(F.lit(1)) / block).cast("int").alias("blocks"))
    mine = members.join(counts, "hub").withColumn("block", F.pmod(F.xxhash64("cls"), F.col("blocks")).cast("int"))
    hubs = counts.select("hub", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), "blocks", F.col("hub").alias("cls"))
    every = mine.select("hub", "block", "blocks", "cls").unionByName(hubs)
    return every.join(sets, "cls").withColumn("ask", F.lit(False))


def links_of(classes: DataFrame, docs: DataFrame, percent: int, k: int, block: int = BLOCK) -> DataFrame:
    """Verified links (a, b) between classes (cls, rep, keys): enough to join all that any link joins."""
    buckets = classes.select("cls", F.explode("keys").alias("key"))
    hubs = buckets.groupBy("key").agg(F.min("cls").alias("hub"), F.max("cls").alias("last")).filter("hub <> last").drop("last")
    # A star for each bucket: its members with its smallest class.
    members = cut(buckets.join(hubs, "key").filter("cls <> hub").select("hub", "cls").distinct())
    involved = members.select("cls").union(members.select("hub")).distinct()
    sets = cut(sets_of(docs, classes.select("cls", "rep").join(involved, "cls"), k))
    found = cut(verified(blocks_of(members, sets, block), percent))
    links = found.filter("a IS NOT NULL").select("a", "b")
    strays = found.filter("a IS NULL").select("hub", F.col("b").alias("cls")).distinct()
    if strays.isEmpty():
        return links
    # Groups of several blocks: what the hub is not linked with is compared, in blocks, with the members of every block.
    asking = blocks_of(strays, sets, max(block // 8, 1)).filter("cls <> hub").select("hub", F.col("block").alias("s"), "cls", "set")
    group = blocks_of(members, sets, block).filter("blocks > 1 AND cls <> hub").select("hub", F.col("block").alias("m"), "blocks", "cls", "set")
    s_of, m_of = asking.select("hub", "s").distinct(), group.select("hub", "m", "blocks").distinct()
    cell = F.concat_ws("/", "s", "m").alias("block")
    first = asking.join(m_of, "hub").select("hub", cell, "blocks", "cls", "set", F.lit(True).alias("ask"))
    second = group.join(s_of, "hub").select("hub", cell, "blocks", "cls", "set", F.lit(False).alias("ask"))
    return links.union(verified(first.unionByName(second), percent).filter("a IS NOT NULL").select("a", "b"))


def near_duplicates(docs: DataFrame, *, shingle: int = 5, percent: int = 80, bands: int | None = None, rows: int | None = None, block: int = BLOCK, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n_shingles, component_id and kept for every row.

    Rows with 100 * intersection >= percent * union of their shingle sets are
    linked; component_id is the smallest id reachable and kept is id ==
    component_id.  Words are runs of anything but ASCII white space, A-Z lower
    case.  A row with fewer words than a shingle has its whole sequence as one;
    null and empty texts have no set and are linked with nothing.  Repeated rows
    are of one class and so of one component; of rows with one id all or none
    are kept.  Null ids count as larger than all others; a component of null ids
    alone has a null component_id and is not kept.  An empty table gives no
    rows; other columns are not read.

    Equal sets are one class.  Classes that share a band bucket meet in a star
    around its smallest class; sets are compared whole.  Classes that the hub is
    not linked with are compared with the rest of its group as well, in blocks,
    so links between them are not lost.  Bands and rows follow from percent
    unless both are given.
    """
    given = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    if bands is None or rows is None:
        bands, rows = bands_of(percent)
    rows_ = cut(signed(given, shingle, bands, rows))
    classes = cut(rows_.filter("cls IS NOT NULL").groupBy("cls").agg(F.min("id").alias("rep"), F.first("keys").alias("keys")))
    labels = components(links_of(classes, given, percent, shingle, block))
    named = classes.select("cls", "rep").join(labels.select(F.col("node").alias("cls"), "label"), "cls", "left").withColumn("label", F.coalesce("label", "cls"))
    smallest = named.groupBy("label").agg(F.min("rep").alias("component_id"))
    of = named.join(smallest, "label").select("cls", "component_id")
    found = rows_.select("id", "n_shingles", "cls").join(of, "cls", "left")
    component = F.when(F.col("cls").isNull(), F.col("id")).otherwise(F.col("component_id"))
    return found.select(F.col("id").alias(id_col), "n_shingles", component.alias("component_id")).withColumn("kept", F.coalesce(F.col(id_col) == F.col("component_id"), F.lit(False)))


#: DuckDB SQL for the contract query: exact sets, all links through shared shingles, labels by rounds of neighbour minima.
SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents
), s AS (
  SELECT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')] ELSE list_distinct([array_to_string(w[i : i + 2], ' ') FOR i IN range(1, len(w) - 1)]) END) AS g FROM w
), n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id
), common AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY ALL
), link AS (
  SELECT a, b FROM common JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 85 * (x.n + y.n - c)
), reach(a, b) AS (
  SELECT a, b FROM link UNION SELECT r.a, l.b FROM reach r JOIN link l ON r.b = l.a
), comp AS (SELECT a AS doc_id, least(a, min(b)) AS c FROM reach GROUP BY a)
SELECT w.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, coalesce(c, w.doc_id) AS component_id, coalesce(c, w.doc_id) = w.doc_id AS kept
FROM w LEFT JOIN n USING (doc_id) LEFT JOIN comp USING (doc_id)
"""
