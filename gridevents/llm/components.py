"""Connected components by contraction, every round a few joins over written tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from gridevents.session import written


def components(edges: DataFrame) -> DataFrame:
    """(id, component) of every end of ``edges`` (a, b); the component is its smallest id.

    Each round points every node to the smallest node in reach of one edge and merges
    nodes that point to the same one; the edges between merged nodes are the next
    round's graph.  Rounds grow with the logarithm of the longest path.  Only edges
    are shuffled; nothing of the graph comes to the driver but a count.
    """
    edges = written(edges.where("a <> b").select("a", "b").distinct(), "edges")
    labels = None
    while True:
        both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        step = written(both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("to")), "labels")
        if labels is None:
            labels = step.select(F.col("a").alias("id"), F.col("to").alias("component"))
        else:
            labels = (labels.join(step, labels["component"] == step["a"], "left")
                            .select("id", F.coalesce("to", "component").alias("component")))
        left = step.select("a", F.col("to").alias("x"))
        right = step.select(F.col("a").alias("b"), F.col("to").alias("y"))
        edges = written(edges.join(left, "a").join(right, "b").where("x <> y")
                             .select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct(), "edges")
        if edges.isEmpty():
            return written(labels, "components")
