"""Connected components of a table of edges, by least labels and pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm.common import Scratch


def components(edges: DataFrame, s: Scratch) -> DataFrame:
    """node and label (the least node that it reaches) of all nodes of the edges (a, b).

    Each round takes the least label of a node and its neighbours, then the label of that label; both ways halve the
    length of chains. Rounds end when no label changes. Only ids and labels are shuffled, and minima are taken before.
    """
    both = s.write(edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).where("a <> b").distinct(), "edges")
    labels = s.write(both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("label")).select(F.col("a").alias("node"), "label"), "labels")
    while True:
        near = both.join(labels.withColumnRenamed("node", "b"), "b").groupBy("a").agg(F.min("label").alias("near"))
        least = labels.join(near.withColumnRenamed("a", "node"), "node").select("node", F.col("label").alias("old"), F.least("label", "near").alias("label"))
        least = s.write(least, "least")
        roots = least.select(F.col("node").alias("root"), F.col("label").alias("far"))
        jumped = least.join(roots, F.col("label") == F.col("root")).select("node", "old", F.least("label", "far").alias("label"))
        jumped = s.write(jumped, "labels")
        changed = jumped.where("old <> label").isEmpty()
        s.drop(labels, least)
        labels = jumped.select("node", "label")
        if changed:
            return labels
