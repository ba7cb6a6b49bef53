"""Exports of versioned tables with a digest tree, and restores that refuse conflicts."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quorumlake.shared import settled
from quorumlake.sources.versions import Conflict, Files, VersionedTable

#: Leaves of a digest tree, and keys that an error names.
LEAVES, NAMED = 256, 20


def row_digest(columns: list[str]) -> Column:
    """SHA-256 of a row's columns by name, nulls included."""
    return F.sha2(F.to_json(F.struct(*[F.col(c) for c in sorted(columns)]), {"ignoreNullFields": "false"}), 256)


def leaf_of(keys: list[str], leaves: int = LEAVES) -> Column:
    return F.pmod(F.xxhash64(*keys), F.lit(leaves)).cast("int")


def digest_leaves(rows: DataFrame, keys: list[str], leaves: int = LEAVES) -> DataFrame:
    """leaf, rows and digest: the rows whose keys hash to a leaf, by what they are and not by their order or files.

    A leaf's digest covers its number of rows and the sums of the eight 32-bit
    words of their SHA-256, so it is added up before the shuffle like a count.
    """
    each = rows.select(leaf_of(keys, leaves).alias("leaf"), row_digest(rows.columns).alias("_d"))
    words = [F.sum(F.conv(F.substring("_d", 8 * k + 1, 8), 16, 10).cast("long")).alias(f"_{k}") for k in range(8)]
    summed = each.groupBy("leaf").agg(F.count(F.lit(1)).alias("rows"), *words)
    return summed.select("leaf", "rows", F.sha2(F.concat_ws(",", "rows", *[f"_{k}" for k in range(8)]), 256).alias("digest"))


def root_digest(leaves: dict[int, list]) -> str:
    import hashlib

    return hashlib.sha256("\n".join(f"{k}:{n}:{d}" for k, (n, d) in sorted(leaves.items())).encode()).hexdigest()


def told(leaves: DataFrame) -> dict[int, list]:
    """At most LEAVES rows on the driver."""
    return {r.leaf: [r.rows, r.digest] for r in leaves.collect()}


def export_table(table: VersionedTable, to: str, keys: list[str], *, version: int | None = None, note: dict | None = None, leaves: int = LEAVES) -> dict:
    """Write a version's rows by leaf under `to`, then the manifest with the digest tree of what was written; the manifest.

    The rows are read back before the manifest is put, so a manifest never
    promises what is not there.  An export is written once: Conflict otherwise.
    """
    files = Files(table.spark, to)
    if files.exists("manifest.json"):
        raise Conflict(f"{to} holds an export")
    version = table.latest() if version is None else version
    rows = table.read(version)
    placed = rows.withColumn("_leaf", leaf_of(keys, leaves))
    placed.repartition("_leaf").write.mode("overwrite").partitionBy("_leaf").parquet(f"{to}/rows")
    want = told(digest_leaves(rows, keys, leaves))
    if want != told(digest_leaves(exported(table.spark, to, rows.schema), keys, leaves)):
        raise ValueError(f"{to} does not hold what was written")
    m = {"version": version, "keys": keys, "schema": rows.schema.jsonValue(), "leaves": {str(k): v for k, v in want.items()}, "of": leaves, "root": root_digest(want), "rows": sum(n for n, _ in want.values()), "note": note or {}}
    if not files.put_if_absent("manifest.json", json.dumps(m, sort_keys=True)):
        raise Conflict(f"{to} holds an export")
    return m


def exported(spark: SparkSession, at: str, schema: T.StructType) -> DataFrame:
    """The rows under an export; a folder without any is empty."""
    files = Files(spark, at)
    if not any(x.startswith("_leaf=") for x in files.names("rows")):
        return spark.createDataFrame([], schema)
    return spark.read.schema(T.StructType([*schema.fields, T.StructField("_leaf", T.IntegerType())])).parquet(f"{at}/rows").drop("_leaf")


def verify_export(spark: SparkSession, at: str) -> tuple[dict, list[str]]:
    """The manifest of an export and what is wrong with it: leaves whose rows are lost, added, altered or unreadable.

    All leaves are checked in one job; one by one only where that job fails on a
    damaged file, to tell which it is.
    """
    m = json.loads(Files(spark, at).text("manifest.json"))
    want = {int(k): v for k, v in m["leaves"].items()}
    faults = [] if root_digest(want) == m["root"] else ["root: the tree does not give it"]
    rows = exported(spark, at, T.StructType.fromJson(m["schema"]))
    try:
        got = told(digest_leaves(rows, m["keys"], m["of"]))
    except Exception:
        got = {}
        whole = T.StructType([*T.StructType.fromJson(m["schema"]).fields, T.StructField("_leaf", T.IntegerType())])
        for leaf in sorted(want):
            try:
                got |= told(digest_leaves(spark.read.schema(whole).parquet(f"{at}/rows").filter(F.col("_leaf") == leaf).drop("_leaf"), m["keys"], m["of"]))
            except Exception as e:  # any fault of a file counts as damage, and is named
                faults.append(f"leaf {leaf}: unreadable ({type(e).__name__})")
                got[leaf] = want[leaf]
    for leaf in sorted({*want, *got}):
        if want.get(leaf) != got.get(leaf):
            a, b = want.get(leaf, [0, ""])[0], got.get(leaf, [0, ""])[0]
            faults.append(f"leaf {leaf}: {b} rows for {a}" if a != b else f"leaf {leaf}: altered")
    return m, faults


def conflicts(incoming: DataFrame, existing: DataFrame, keys: list[str]) -> DataFrame:
    """incoming's rows in a full outer join with existing: `state` NEW, SAME or CONFLICT; keys that only existing has are KEPT."""
    digest = row_digest(incoming.columns)
    left = incoming.select(*keys, digest.alias("_in"))
    right = existing.select(*keys, row_digest(existing.columns).alias("_own"))
    state = F.when(F.col("_own").isNull(), "NEW").when(F.col("_in").isNull(), "KEPT").when(F.col("_in") == F.col("_own"), "SAME").otherwise("CONFLICT")
    return left.join(right, keys, "full_outer").select(*keys, state.alias("state"))


def restore_table(at: str, table: VersionedTable) -> dict:
    """Bring a verified export into a table as one version; counts of rows by state.

    Damage or a key that the table has with other values refuses the whole
    restore before anything is written: ValueError names leaves, Conflict keys.
    Rows that are there already are left as they are, so a restore repeats
    without effect.
    """
    m, faults = verify_export(table.spark, at)
    if faults:
        raise ValueError("; ".join(faults[:NAMED]))
    keys, base = m["keys"], table.latest()
    rows = exported(table.spark, at, T.StructType.fromJson(m["schema"]))
    judged = settled(conflicts(rows, table.read(base, rows.schema), keys))
    clash = judged.filter("state = 'CONFLICT'").orderBy(*keys).limit(NAMED).select(*keys).collect()
    if clash:
        raise Conflict("other values for " + ", ".join("/".join(map(str, r)) for r in clash))
    counts = {r.state: r.n for r in judged.groupBy("state").agg(F.count(F.lit(1)).alias("n")).collect()}
    if counts.get("NEW"):
        table.commit(base, [table.write_part(rows.join(judged.filter("state = 'NEW'").select(*keys), keys, "left_semi").select(rows.columns))], tags={"restored": m["root"]})
    return {k: counts.get(k, 0) for k in ("NEW", "SAME", "KEPT")}


def newest_export(spark: SparkSession, folder: str) -> str | None:
    """The export under a folder whose manifest fits its rows and has most of them, then the highest version, then the last name."""
    found = []
    for name in Files(spark, folder).names("."):
        if Files(spark, f"{folder}/{name}").exists("manifest.json"):
            m, faults = verify_export(spark, f"{folder}/{name}")
            if not faults:
                found.append((m["rows"], m["version"], name))
    return f"{folder}/{max(found)[2]}" if found else None
