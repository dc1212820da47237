"""Connected components of an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from metasift.llm.common import settle


def connected_components(edges: DataFrame) -> DataFrame:
    """``edges`` (a, b: long) to ``node``, ``component``: the smallest node that can be reached. Nodes without an edge aren't listed.

    Each round gives every node the smallest label around it, then takes the label of that label; the number of rounds
    grows with the logarithm of the longest chain. Labels are kept in the shared folder after each round.
    """
    both = edges.select("a", "b").unionAll(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).where("a <> b").distinct()
    both = settle(both)
    labels = settle(both.groupBy(F.col("a").alias("node")).agg(F.least(F.col("node"), F.min("b")).alias("component")))
    while True:
        around = both.join(labels, both["b"] == labels["node"]).select(both["a"].alias("node"), "component")
        least = around.unionAll(labels).groupBy("node").agg(F.min("component").alias("near"))
        jump = labels.select(F.col("node").alias("near"), F.col("component").alias("far"))
        # roots are listed too: a component's smallest node has itself as label
        moved = least.join(jump, "near").select("node", F.least("near", "far").alias("component"))
        old = labels.select("node", F.col("component").alias("before"))
        updated = settle(moved.join(old, "node"))
        labels = updated.select("node", "component")
        if updated.where("component <> before").isEmpty():
            return labels
