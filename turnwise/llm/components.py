"""Connected components by hooking and pointer jumping, each round cut by a written table."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from turnwise.session import materialise


def connected(labels: DataFrame, edges: DataFrame) -> DataFrame:
    """labels(node, label) with every label replaced by the smallest node of its component.

    labels holds every end of edges(a, b); its label column names a node of the same component.
    A hub's messages are reduced where they arise, so no task gets all neighbours of a node.
    """
    both = materialise(edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "cc-edges")
    labels = materialise(labels, "cc-labels")
    while True:
        told = both.join(labels, F.col("b") == F.col("node")).groupBy("a").agg(F.min("label").alias("heard"))
        hooked = labels.join(told, F.col("node") == F.col("a"), "left").select("node", "label", F.least("label", F.coalesce("heard", "label")).alias("to"))
        # A root hooks when any node of its tree heard of a smaller one; then every node jumps to its label's label.
        roots = hooked.groupBy("label").agg(F.min("to").alias("root"))
        moved = hooked.join(roots, "label").select("node", "label", "root")
        jump = moved.select(F.col("node").alias("mid"), F.col("root").alias("far"))
        after = moved.join(jump, F.col("root") == F.col("mid"), "left").select("node", F.col("label").alias("old"), F.least("root", F.coalesce("far", "root")).alias("label"))
        after = materialise(after, "cc-labels")
        labels = after.select("node", "label")
        if after.where("old <> label").isEmpty():
            return labels
