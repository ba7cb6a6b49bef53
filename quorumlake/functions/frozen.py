"""Metadata as VARIANT values: walked to any depth in the JVM, a level at a time, for what is not plain JSON."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quorumlake.shared import settled

#: Kinds of values that JSON has; decimals are numbers.
SCALARS = ("VOID", "BOOLEAN", "BIGINT", "STRING", "DOUBLE", "FLOAT")
#: Levels that a value may have before it counts as too deep.
DEPTH = 100


def metadata_faults(rows: DataFrame, key: str, value: str, depth: int = DEPTH) -> DataFrame:
    """key, path and fault of every value inside the VARIANT column that may not be frozen.

    Faults: NOT_AN_OBJECT (the whole is no mapping; null is), NOT_FINITE (a
    number), NOT_JSON (dates, binary and the like), BLANK_KEY and TOO_DEEP.  Each
    level is one explode of the objects and lists of the level before, so the
    work is in proportion to the values and no row is ever held as a tree.
    """
    kind = F.schema_of_variant(F.col("_v"))
    top = rows.select(F.col(key).alias("_k"), F.col(value).alias("_v"))
    found = top.filter(F.coalesce(~kind.startswith("OBJECT"), F.lit(True))).select("_k", F.lit("$").alias("path"), F.lit("NOT_AN_OBJECT").alias("fault"))
    level = settled(top.filter(kind.startswith("OBJECT")).select("_k", F.lit("$").alias("path"), "_v"))
    for n in range(depth + 1):
        if level.isEmpty():
            break
        if n == depth:
            found = found.unionByName(level.select("_k", "path", F.lit("TOO_DEEP").alias("fault")))
            break
        exploded = level.lateralJoin(level.sparkSession.tvf.variant_explode(F.col("_v").outer())).select("_k", "path", F.col("pos"), F.col("key").alias("_name"), F.col("value").alias("_v"))
        inner = settled(exploded.select("_k", F.concat("path", F.when(F.col("_name").isNull(), F.format_string("[%d]", "pos")).otherwise(F.concat(F.lit("."), F.col("_name")))).alias("path"), "_name", "_v"))
        number = F.try_variant_get("_v", "$", "double")
        finite = ~(F.isnan(number) | number.isin(float("inf"), float("-inf")))
        plain = kind.isin(*SCALARS) | kind.startswith("DECIMAL") | kind.startswith("OBJECT") | kind.startswith("ARRAY")
        fault = F.when(F.trim("_name") == "", "BLANK_KEY").when(~plain, "NOT_JSON").when(kind.isin("DOUBLE", "FLOAT") & ~finite, "NOT_FINITE")
        found = found.unionByName(inner.withColumn("fault", fault).filter("fault IS NOT NULL").select("_k", "path", "fault"))
        level = inner.filter(kind.startswith("OBJECT") | kind.startswith("ARRAY")).select("_k", "path", "_v")
    return found.withColumnRenamed("_k", key)


def frozen(rows: DataFrame, key: str, value: str) -> DataFrame:
    """rows with `<value>_json`, the metadata as canonical JSON; rows with a fault are left out (see metadata_faults)."""
    bad = metadata_faults(rows, key, value).select(key).distinct()
    return rows.join(bad, key, "left_anti").withColumn(f"{value}_json", F.to_json(value))
