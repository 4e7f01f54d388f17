"""Connected components by shrinking labels, each round a written stage table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weblode.sources.stages import written


def components(edges: DataFrame) -> DataFrame:
    """``edges(a, b)`` to ``(node, label)``: the smallest node each node reaches.

    A round takes the smallest label among a node's neighbours and then the label of that label, so the rounds follow the
    logarithm of the longest path. Every round is written to the shared stage folder: links never reach the driver, the
    lineage stays short, and a lost executor costs one round at most. A hub is one label row against many edges, which
    adaptive execution splits. No edges give no rows; self-loops and repeated edges change nothing.
    """
    both = written(
        edges.select("a", "b").union(edges.select(F.col("b"), F.col("a"))).filter("a <> b").distinct(), "cc-edges")
    labels = written(both.groupBy("a").agg(F.min("b").alias("b")).select(F.col("a").alias("node"), F.least("a", "b").alias("label")), "cc-labels")
    while True:
        near = both.join(labels.withColumnRenamed("node", "b"), "b").groupBy(F.col("a").alias("node")).agg(F.min("label").alias("near"))
        met = labels.join(near, "node").select("node", F.col("label").alias("old"), F.least("label", "near").alias("via"))
        jump = labels.select(F.col("node").alias("via"), F.col("label").alias("far"))
        new = written(
            met.join(jump, "via", "left").select("node", F.least("via", F.coalesce("far", "via")).alias("label"), "old"), "cc-labels")
        if new.filter("label <> old").isEmpty():
            return new.select("node", "label")
        labels = new.select("node", "label")
