"""Connected components of an edge table, by contraction.

Each round hooks every node that has a smaller neighbour to its smallest one,
flattens the hooks by pointer jumping, and replaces the ends of every edge by
their roots; at least half of the nodes that still have edges go each round.
Nothing is collected; every round is cut off by a reliable checkpoint.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


class Joined:
    """Joins the entries of a bucket into connected groups, row by row of the
    link matrix, and keeps one link for every two groups that meet."""

    def __init__(self, n: int) -> None:
        self.label = np.arange(n)
        self.links: list[tuple[int, int]] = []

    def row(self, a: int, linked: np.ndarray) -> None:
        label = self.label
        groups, first = np.unique(label[linked], return_index=True)
        for g, i in zip(groups.tolist(), first.tolist()):
            if g != label[a]:
                self.links.append((a, int(linked[i])))
                label[label == g] = label[a]


def _contracted(edges: DataFrame) -> DataFrame:
    return edges.where("u != v").select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of ``edges`` (u long, v long):
    component is the smallest node that can be reached. Loops and repeated
    edges do no harm; an empty table gives an empty table."""
    edges = _contracted(edges).checkpoint()
    labels = edges.select(F.explode(F.array("u", "v")).alias("node")).distinct().withColumn("component", F.col("node"))
    while not edges.isEmpty():
        # v > u: each v hooks to its smallest neighbour if that is smaller
        hooks = edges.groupBy(F.col("v").alias("a")).agg(F.min("u").alias("m")).checkpoint()
        while True:
            up = hooks.select(F.col("a").alias("m"), F.col("m").alias("_m"))
            hooks = hooks.join(up, "m", "left").select("a", F.coalesce("_m", "m").alias("m"),
                                                       F.col("_m").isNotNull().alias("_moved")).checkpoint()
            moved = hooks.where("_moved")
            if moved.isEmpty():
                break
            hooks = hooks.select("a", "m")
        hooks = hooks.select("a", "m")
        labels = labels.join(hooks, labels["component"] == hooks["a"], "left").select(
            "node", F.coalesce("m", "component").alias("component")).checkpoint()
        for end in ("u", "v"):
            edges = edges.join(hooks, edges[end] == hooks["a"], "left").withColumn(
                end, F.coalesce("m", end)).select("u", "v")
        edges = _contracted(edges).checkpoint()
    return labels
