"""Connected components of a graph in DataFrames: smallest label reachable from each node."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from txnlens.llm.tables import stage


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, label) for every node of (a, b) edges; label is the smallest node of its component.

    Each round takes the smallest label among the neighbours, then the label of that label, so a
    chain halves in every round. Labels are written once per round, which cuts the lineage and lets
    a skewed join be split; minima are taken before the shuffle. Null nodes are left out.
    """
    pairs = edges.where("a IS NOT NULL AND b IS NOT NULL AND a <> b")
    both = stage(
        pairs.select("a", "b").unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(),
        "links",
    )
    labels = both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("label"))
    labels = stage(labels.select("node", F.least("node", "label").alias("label")), "labels")
    while True:
        near = both.join(labels, both["a"] == labels["node"]).select(F.col("b").alias("node"), "label")
        best = near.unionByName(labels).groupBy("node").agg(F.min("label").alias("best"))
        best = stage(best, "best_labels")
        up = labels.select(F.col("node").alias("best"), F.col("label").alias("above"))
        jumped = best.join(up, "best", "left").select(
            "node", F.least("best", F.coalesce("above", "best")).alias("label")
        )
        new = stage(jumped, "labels")
        old = labels.select("node", F.col("label").alias("old"))
        moved = new.join(old, "node").where("label <> old").limit(1).count()
        labels = new
        if not moved:
            return labels
