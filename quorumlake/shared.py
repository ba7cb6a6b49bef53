"""Results that are written to the shared folder before they are used again."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession


def folder(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir; where that is unset and the master is local, one of our own."""
    sc = spark.sparkContext
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not sc.getCheckpointDir():
        if not base and not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = base or tempfile.mkdtemp(prefix="quorumlake-")
        sc.setCheckpointDir(base)
    return (base or sc.getCheckpointDir()).rstrip("/")


def settled(df: DataFrame) -> DataFrame:
    """df as written to the shared folder: what made it does not run again, not even where an executor is lost."""
    folder(df.sparkSession)
    return df.checkpoint()
