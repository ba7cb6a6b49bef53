"""Connected components by rounds of neighbour minima with pointer jumping, on distributed edges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quorumlake.llm.common import cut


def components(edges: DataFrame) -> DataFrame:
    """node and label, the smallest node reachable, for every node of edges (a, b); nulls are no nodes.

    A round takes the smallest label among a node and its neighbours, then the
    label of that label, so that a chain of n nodes needs about log n rounds.
    Labels are written to the shared folder each round; only a count comes to
    the driver.
    """
    both = edges.select(F.col("a").alias("node"), F.col("b").alias("to")).union(edges.select(F.col("b").alias("node"), F.col("a").alias("to")))
    both = cut(both.filter("node IS NOT NULL AND `to` IS NOT NULL").distinct())
    labels = cut(both.groupBy("node").agg(F.least(F.col("node"), F.min("to")).alias("label")))
    while True:
        near = both.join(labels.withColumnRenamed("node", "to"), "to").groupBy("node").agg(F.min("label").alias("seen"))
        stepped = labels.join(near, "node").select("node", F.col("label").alias("was"), F.least("label", "seen").alias("label"))
        # The label of a node's label: labels are nodes themselves.
        up = labels.select(F.col("node").alias("label"), F.col("label").alias("above"))
        jumped = cut(stepped.join(up, "label").select("node", "was", F.least("label", "above").alias("label")))
        moved = jumped.filter("label <> was").count()
        labels = jumped.select("node", "label")
        if not moved:
            return labels
