"""Connected components of an edge table by minimum labels with pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common


def connected(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """node, label for every node of edges (a, b longs): label is the smallest node of its component.

    A node starts with the least of itself and its neighbours. Each round takes the label's own label, then the least
    label among neighbours, so the number of rounds is about the logarithm of the longest chain; it ends when no
    neighbour has a smaller label, as both ends of every edge then have the same. Labels are written to the shared
    folder each round; a node with very many edges only meets partial aggregates and joins that Spark can split.
    """
    held = edges if hasattr(edges, "_scratch") else common.materialize(edges, "edges")
    both = held.select(F.col("a").alias("x"), F.col("b").alias("y")).unionByName(held.select(F.col("b").alias("x"), F.col("a").alias("y")))
    labels = common.materialize(both.groupBy("x").agg(F.min("y").alias("y")).select(F.col("x").alias("node"), F.least("x", "y").alias("label")), "labels")
    for _ in range(rounds):
        up = labels.select(F.col("node").alias("up"), F.col("label").alias("next"))
        jumped = common.materialize(labels.join(up, labels["label"] == up["up"]).select("node", F.col("next").alias("label")), "labels")
        common.release(labels)
        near = both.join(jumped, both["y"] == jumped["node"]).groupBy("x").agg(F.min("label").alias("near"))
        moved = jumped.join(near, jumped["node"] == near["x"]).select("node", F.least("label", "near").alias("label"), (F.col("near") < F.col("label")).alias("new"))
        labels = common.materialize(moved, "labels")
        if labels.filter("new").isEmpty():
            common.release(labels, held if held is not edges else None)
            return jumped
        common.release(jumped)
    raise RuntimeError("components did not settle")


def extended(labels: DataFrame, edges: DataFrame) -> DataFrame:
    """labels (node, label as `connected` gives them) with further edges (a, b): only components that they join get a new label."""
    one, two = labels.select(F.col("node").alias("one"), F.col("label").alias("x")), labels.select(F.col("node").alias("two"), F.col("label").alias("y"))
    ends = edges.join(one, edges["a"] == F.col("one"), "left").join(two, edges["b"] == F.col("two"), "left")
    ends = common.materialize(ends.select(F.coalesce("x", "a").alias("a"), F.coalesce("y", "b").alias("b")).filter("a != b").distinct(), "edges")
    joined = connected(ends)
    moved = joined.withColumnsRenamed({"node": "old", "label": "new"})
    fresh = edges.select(F.explode(F.array("a", "b")).alias("node")).distinct().join(labels, "node", "left_anti")
    known = labels.select("node", "label").unionByName(fresh.select("node", F.col("node").alias("label")))
    out = common.materialize(known.join(moved, known["label"] == moved["old"], "left").select("node", F.coalesce("new", "label").alias("label")), "labels")
    common.release(ends, joined)
    return out
