"""An append-only audit whose entries are chained by their digests, verified by ranges and by counts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quorumlake.operators.evaluate import ranked
from quorumlake.shared import settled

#: Entries of a block: a digest covers its entries in order and the block before it.
BLOCK = 1000
#: What stands before the first block.
START = "0" * 64


def entry_digest(columns: list[str]):
    """SHA-256 of an entry's columns, nulls included, its place among them."""
    return F.sha2(F.to_json(F.struct("place", *[F.col(c) for c in sorted(columns)]), {"ignoreNullFields": "false"}), 256)


def bodies(placed: DataFrame, columns: list[str], block: int) -> DataFrame:
    """block, entries and body, the digest of the block's entries in order; a block has at most `block` entries."""
    dealt = placed.select("place", entry_digest(columns).alias("_d"), F.floor((F.col("place") - 1) / block).cast("long").alias("block"))
    listed = F.array_sort(F.collect_list(F.struct("place", "_d")))
    return dealt.groupBy("block").agg(F.count(F.lit(1)).alias("entries"), F.sha2(F.array_join(F.transform(listed, lambda x: x["_d"]), "\n"), 256).alias("body"))


def blocks_of(entries: DataFrame, order: list[str], block: int = BLOCK) -> DataFrame:
    """bodies of all entries; places come from ranges numbered apart, so no task sees all of them."""
    return bodies(ranked(entries, order), entries.columns, block)


def chained(entries: DataFrame, order: list[str], block: int = BLOCK) -> DataFrame:
    """Seals of an audit: block, entries, body, and before, the body of the block before it.

    A seal names its predecessor's body, so a block cannot be altered, left out,
    put in or moved without a seal that no longer fits.
    """
    blocks = settled(blocks_of(entries, order, block))
    earlier = blocks.select((F.col("block") + 1).alias("block"), F.col("body").alias("before"))
    return blocks.join(earlier, "block", "left").select("block", "entries", "body", F.coalesce("before", F.lit(START)).alias("before"))


def audit_faults(entries: DataFrame, seals: DataFrame, order: list[str], block: int = BLOCK) -> DataFrame:
    """block and fault of every block that does not fit its seal, or whose seal does not fit the seal before it.

    Faults: NO_SEAL, NO_ENTRIES, ENTRIES (another number), BODY (altered, moved or
    exchanged) and LINK (the seals themselves are broken).  Blocks after a lost
    or added entry are all off, as their places are; the first one says where.
    """
    now = blocks_of(entries, order, block).select("block", F.col("entries").alias("_n"), F.col("body").alias("_body"))
    links = seals.select((F.col("block") + 1).alias("block"), F.col("body").alias("_prior"))
    both = seals.join(links, "block", "left").join(now, "block", "full_outer")
    fault = (
        F.when(F.col("body").isNull(), "NO_SEAL").when(F.col("_body").isNull(), "NO_ENTRIES").when(F.col("entries") != F.col("_n"), "ENTRIES").when(F.col("body") != F.col("_body"), "BODY")
        .when(F.col("before") != F.coalesce("_prior", F.when(F.col("block") == 0, F.lit(START)), F.lit("")), "LINK")
    )
    return both.select("block", fault.alias("fault")).filter("fault IS NOT NULL")


def appended(entries: DataFrame, seals: DataFrame, order: list[str], block: int = BLOCK) -> DataFrame:
    """The seals of an audit that has grown: full blocks keep theirs, what follows them is sealed anew.

    Entries that do not come after all full blocks move places inside them; that
    is not looked for here but by audit_faults, which then names the block.
    """
    full = settled(seals.filter(F.col("entries") == block))
    n, last = full.agg(F.count(F.lit(1)), F.max_by("body", "block")).first()
    tail = ranked(entries, order).filter(F.col("place") > n * block)
    fresh = settled(bodies(tail, entries.columns, block))
    earlier = fresh.select((F.col("block") + 1).alias("block"), F.col("body").alias("before"))
    return full.unionByName(fresh.join(earlier, "block", "left").select("block", "entries", "body", F.coalesce("before", F.lit(last or START)).alias("before")))


def provenance(rows: DataFrame, keys: list[str], sources: list[str]) -> DataFrame:
    """A manifest of a sample: one row for each source with rows, distinct keys and a digest of them that no order changes."""
    words = [F.sum(F.conv(F.substring("_d", 8 * k + 1, 8), 16, 10).cast("long")).alias(f"w{k}") for k in range(8)]
    each = rows.withColumn("_d", F.sha2(F.to_json(F.struct(*[F.col(c) for c in sorted(rows.columns)]), {"ignoreNullFields": "false"}), 256))
    summed = each.groupBy(*sources).agg(F.count(F.lit(1)).alias("rows"), F.count_distinct(F.struct(*keys)).alias("keys"), *words)
    return summed.select(*sources, "rows", "keys", F.sha2(F.concat_ws(",", "rows", *[f"w{k}" for k in range(8)]), 256).alias("digest"))
