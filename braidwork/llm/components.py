"""Connected components by min-label propagation with pointer jumping, all in DataFrame operations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .cluster import discard, materialize, spread_join


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, label) for every node with an edge; label is the smallest node of its component.

    Each round takes the smallest label among a node and its neighbours, then the label of that label. Rounds end when
    no label changes: about the logarithm of the longest path for chains, two or three for stars. Each round's labels
    are written to the shared folder, so that lost executors cost one round at most. Nothing is collected but a flag.
    """
    both = edges.select(F.col(a).alias("node"), F.col(b).alias("other")).unionAll(edges.select(F.col(b), F.col(a))).where("node <> other")
    both = materialize(both.distinct(), "edges")
    labels = materialize(both.groupBy("node").agg(F.least("node", F.min("other")).alias("label")), "labels")
    while True:
        near = spread_join(both, labels.select(F.col("node").alias("other"), "label"), "other", "node").groupBy("node").agg(F.min("label").alias("near"))
        step = materialize(labels.join(near, "node").select("node", F.col("label").alias("old"), F.least("label", "near").alias("next")), "step")
        jump = labels.select(F.col("node").alias("next"), F.col("label").alias("far"))
        new = spread_join(step, jump, "next", "node").select("node", "old", F.least("next", "far").alias("label"))
        new = materialize(new, "labels")
        changed = new.where("label <> old").limit(1).count()
        discard(step, labels)
        labels = new
        if not changed:
            return labels.select("node", "label")
