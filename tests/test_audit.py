"""Chained audits: insertion, deletion, reordering and forged seals, whatever the partitions."""

import pytest
from pyspark.sql import functions as F

from quorumlake.operators import audit as A


def entries(spark, n=95):
    return spark.range(n).select((F.col("id") * 2).alias("seq"), F.format_string("call %d", "id").alias("what"), F.when(F.col("id") % 5 != 0, F.col("id")).alias("code"))


@pytest.mark.parametrize("parts", ["2", "9"])
def test_faults_are_found(spark, parts):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    e = entries(spark)
    seals = spark.createDataFrame(A.chained(e, ["seq"], 10).collect(), "block long, entries long, body string, before string")
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    try:
        faults = lambda x, s=seals: sorted((r.block, r.fault) for r in A.audit_faults(x.repartition(int(parts)), s, ["seq"], 10).collect())
        assert faults(e) == []
        assert faults(e.withColumn("what", F.when(F.col("seq") == 46, "forged").otherwise(F.col("what")))) == [(2, "BODY")]
        assert faults(e.withColumn("code", F.when(F.col("seq") == 0, 0).otherwise(F.col("code")))) == [(0, "BODY")]
        assert faults(e.filter("seq <> 60"))[0] == (3, "BODY") and faults(e.filter("seq <> 60"))[-1] == (9, "ENTRIES")
        added = e.unionByName(spark.createDataFrame([(61, "new", 1)], "seq long, what string, code long"))
        assert faults(added)[0] == (3, "BODY") and faults(added)[-1] == (9, "ENTRIES")
        swapped = e.withColumn("seq", F.when(F.col("seq") == 4, 6).when(F.col("seq") == 6, 4).otherwise(F.col("seq")))
        assert faults(swapped) == [(0, "BODY")]
        assert faults(e.filter("seq < 180")) == [(9, "NO_ENTRIES")]
        assert faults(e, seals.filter("block <> 4")) == [(4, "NO_SEAL"), (5, "LINK")]
        forged = seals.withColumn("before", F.when(F.col("block") == 7, F.lit("f" * 64)).otherwise(F.col("before")))
        assert faults(e, forged) == [(7, "LINK")]
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_growth(spark):
    few, many = entries(spark, 34), entries(spark, 78)
    seals = A.chained(few, ["seq"], 10)
    grown = sorted(map(tuple, A.appended(many, seals, ["seq"], 10).collect()))
    assert grown == sorted(map(tuple, A.chained(many, ["seq"], 10).collect())) and len(grown) == 8
    assert sorted(map(tuple, A.appended(few, A.chained(few.limit(0), ["seq"], 10), ["seq"], 10).collect())) == sorted(map(tuple, seals.collect()))


def test_provenance(spark):
    rows = entries(spark).withColumn("source", F.when(F.col("seq") < 50, "a").otherwise("b"))
    once = sorted(map(tuple, A.provenance(rows, ["seq"], ["source"]).collect()))
    assert once == sorted(map(tuple, A.provenance(rows.orderBy(F.desc("what")).repartition(7), ["seq"], ["source"]).collect()))
    other = sorted(map(tuple, A.provenance(rows.withColumn("code", F.when(F.col("seq") == 2, 9).otherwise(F.col("code"))), ["seq"], ["source"]).collect()))
    assert [x[:3] for x in once] == [("a", 25, 25), ("b", 70, 70)] and once[1] == other[1] and once[0] != other[0]
