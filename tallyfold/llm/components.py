"""Connected components by minimum labels with pointer jumping, as Spark joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import staged


def connected_components(edges: DataFrame) -> DataFrame:
    """(a, b) links -> (node, component) for every linked node; component is its smallest node.

    Every round takes the smallest label among the neighbours and then the label of that label, so
    chains shorten by more than half.  Labels are pre-aggregated before each shuffle and each round
    is written to the shared folder: a lost executor costs one round at most.  Self links and
    repeated links are allowed; nulls never link.
    """
    linked = edges.select("a", "b").where("a is not null and b is not null and a != b")
    both = staged(linked.union(linked.select("b", "a")).distinct(), "links")
    labels = staged(
        both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("m")).select("node", F.least("node", "m").alias("component")),
        "labels",
    )
    while True:
        near = (
            both.join(labels.withColumnRenamed("node", "b"), "b")
            .groupBy(F.col("a").alias("node"))
            .agg(F.min("component").alias("m"))
        )
        hooked = labels.join(near, "node").select("node", "component", F.least("component", "m").alias("to"))
        root = labels.select(F.col("node").alias("to"), F.col("component").alias("root"))
        jumped = staged(
            hooked.join(root, "to", "left").select("node", "component", F.least("to", F.coalesce("root", "to")).alias("next")), "labels"
        )
        moved = jumped.where("next != component").limit(1).count()
        labels = jumped.select("node", F.col("next").alias("component"))
        if not moved:
            return labels
