"""Connected components of an edge table, by smallest label with pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._shared import materialize


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of ``edges`` (a, b); root is the smallest node reachable.

    Each round takes the smallest label among neighbours and then the label's own label, so the
    number of rounds grows with the logarithm of the longest path. Labels combine before each
    shuffle; nothing is gathered on the driver but whether a label changed.
    """
    edges = edges.where("a <> b").distinct()
    both = materialize(edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))))
    labels = materialize(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("root")))
    while True:
        sent = both.join(labels, both.a == labels.node).select(F.col("b").alias("node"), "root")
        new = sent.unionByName(labels).groupBy("node").agg(F.min("root").alias("root"))
        jump = labels.select(F.col("node").alias("via"), F.col("root").alias("root2"))
        old = labels.select(F.col("node").alias("node_"), F.col("root").alias("old"))
        step = new.join(jump, F.col("root") == F.col("via"), "left").join(old, F.col("node") == F.col("node_"))
        step = materialize(step.select("node", F.least("root", F.coalesce("root2", "root")).alias("root"), "old"))
        labels = step.select("node", "root")
        if step.where("root <> old").isEmpty():
            return labels
