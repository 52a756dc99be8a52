"""Connected components of links between nodes, inside a task and over the cluster."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import join_hot, materialise


class LocalForest:
    """Union-find over 0..n-1 with vectorised unions. Used inside one task on a bounded bucket, so that
    the task emits a spanning forest (fewer links than nodes) and never all pairs of a group."""

    def __init__(self, n: int):
        self.parent = np.arange(n, dtype=np.int64)

    def find(self, x: np.ndarray) -> np.ndarray:
        root = self.parent[x]
        while True:
            above = self.parent[root]
            if np.array_equal(above, root):
                return root
            root = above

    def add(self, a: np.ndarray, b: np.ndarray) -> None:
        while a.size:
            ra, rb = self.find(a), self.find(b)
            apart = ra != rb
            if not apart.any():
                return
            high, low = np.maximum(ra[apart], rb[apart]), np.minimum(ra[apart], rb[apart])
            self.parent[high] = low  # of several, one wins; the others are tried again
            a, b = high, low

    def edges(self) -> tuple[np.ndarray, np.ndarray]:
        """Members of each component as a chain: no node gets more than two links from one task."""
        self.parent = self.find(np.arange(self.parent.size))
        order = np.argsort(self.parent, kind="stable")
        same = self.parent[order][1:] == self.parent[order][:-1]
        return order[:-1][same], order[1:][same]


def connected_components(edges: DataFrame, name: str) -> DataFrame:
    """(node, label) for every node of `edges` (u long, v long): nodes get equal labels exactly if a
    path of links joins them; the label is one of the nodes.

    Local contraction: in each round every node takes the label of the neighbour (or itself) that comes
    first in a random order drawn for the round, equal labels become one node, and links inside a node
    vanish. A constant share of the nodes goes in every round, so the number of rounds is logarithmic;
    the loop ends when no link is left. Tasks emit chains (`LocalForest.edges`), so no node has many
    links at the start. The rounds' label tables are then chained, last to first; there a large
    component is a hot key, which `join_hot` takes care of."""
    cur = materialise(_undirected(edges), f"{name}-links")
    rounds: list[DataFrame] = []
    while not cur.isEmpty():
        order = F.xxhash64(F.col("v"), F.lit(len(rounds)))
        own = F.xxhash64(F.col("u"), F.lit(len(rounds)))
        both = cur.unionByName(cur.select(F.col("v").alias("u"), F.col("u").alias("v")))
        labels = (both.groupBy("u").agg(F.min_by("v", order).alias("first"), F.min(order).alias("rank"))
                  .select(F.col("u").alias("node"),
                          F.when(own < F.col("rank"), F.col("u")).otherwise(F.col("first")).alias("label")))
        labels = materialise(labels, f"{name}-round{len(rounds)}")
        rounds.append(labels)
        of_u = labels.select(F.col("node").alias("u"), F.col("label").alias("to_u"))
        of_v = labels.select(F.col("node").alias("v"), F.col("label").alias("to_v"))
        cur = materialise(_undirected(cur.join(of_u, "u").join(of_v, "v")
                                      .select(F.col("to_u").alias("u"), F.col("to_v").alias("v"))), f"{name}-links")
    if not rounds:
        return cur.select(F.col("u").alias("node"), F.col("v").alias("label"))
    done = rounds[-1]
    for labels in reversed(rounds[:-1]):
        up = done.select(F.col("node").alias("label"), F.col("label").alias("top"))
        done = materialise(join_hot(labels, up, "label", f"{name}-up")
                           .select("node", F.coalesce("top", "label").alias("label")), f"{name}-chain")
    return done


def _undirected(edges: DataFrame) -> DataFrame:
    return (edges.where(F.col("u") != F.col("v"))
            .select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct())
