"""Connected components of a link table by hooking and contraction, as joins and grouped minima."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewater.llm.common import settle


def _roots(parent: DataFrame) -> DataFrame:
    """(node, root) of a forest (node, up) whose pointers go to smaller nodes: pointers double until none moves."""
    while True:
        far = parent.filter("up <> node").select(F.col("node").alias("via"), F.col("up").alias("far"))
        jumped = parent.join(far, parent["up"] == far["via"], "left").select("node", F.col("up").alias("old"), F.coalesce("far", "up").alias("up"))
        jumped = settle(jumped)
        parent = jumped.select("node", "up")
        if not jumped.filter("old <> up").limit(1).count():
            return parent.withColumnRenamed("up", "root")


def components(links: DataFrame) -> DataFrame:
    """``links`` (a, b): undirected edges.  Returns (node, label): the smallest node reachable, for nodes with a link.

    Each round points every node at its smallest neighbour, follows the
    pointers to their roots, replaces the nodes of all edges by their roots and
    drops edges within a root.  At least half of the nodes that still have an
    edge vanish in a round, so dense groups shrink to a point at once and edges
    are read a few times only.  Links, labels and components stay on the
    executors; the driver sees whether any edge is left.
    """
    edges = settle(links.filter("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    labels = settle(edges.select(F.col("a").alias("node")).union(edges.select("b")).distinct().select("node", F.col("node").alias("label")))
    while edges.limit(1).count():
        seen = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        parent = settle(seen.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("up")))
        roots = _roots(parent)
        left = roots.select(F.col("node").alias("an"), F.col("root").alias("ar"))
        right = roots.select(F.col("node").alias("bn"), F.col("root").alias("br"))
        moved = edges.join(left, edges["a"] == left["an"]).join(right, F.col("b") == right["bn"]).filter("ar <> br")
        edges = settle(moved.select(F.least("ar", "br").alias("a"), F.greatest("ar", "br").alias("b")).distinct())
        labels = settle(labels.join(left, labels["label"] == left["an"], "left").select("node", F.coalesce("ar", "label").alias("label")))
    return labels
