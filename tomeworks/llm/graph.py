"""Connected components of a table of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tomeworks.operators.settle import settle


def components(links: DataFrame) -> DataFrame:
    """``(node, label)`` for every node of the links ``(a, b)``; the label is the smallest node of the
    component.

    Each round takes the smallest label among neighbours and then the label of that label, so chains
    shorten by doubling. Minima are pre-aggregated before they are shuffled. The loop ends when no
    label changes.
    """
    both = settle(links.select("a", "b").union(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    labels = settle(both.groupBy(F.col("a").alias("node")).agg(F.least(F.first("a"), F.min("b")).alias("label")))
    while True:
        near = both.join(labels.withColumnRenamed("node", "b"), "b").groupBy(F.col("a").alias("node")).agg(F.min("label").alias("_near"))
        hop = labels.select(F.col("node").alias("_near"), F.col("label").alias("_far"))
        new = settle(
            labels.join(near, "node").withColumn("_near", F.least("label", "_near")).join(hop, "_near")
            .select("node", F.least("_near", "_far").alias("label"), (F.least("_near", "_far") < F.col("label")).alias("_moved")))
        moved = new.where("_moved").limit(1).count()
        labels = new.drop("_moved")
        if not moved:
            return labels
