"""Connected components over edge tables of any size.

The graph is contracted in rounds: each round hooks every node onto its smallest neighbour (if smaller), follows two such
steps, and contracts the edges onto the nodes reached; components end named by their smallest node. All is joins and
pre-aggregated minima; each round's tables are written to the shared folder. Stars and dense groups contract in two or
three rounds, paths in a logarithmic number.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import saved, step


def local_roots(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """For each of n nodes the smallest node of its component, given the ends of edges."""
    root = np.arange(n)
    while len(i):
        low = np.minimum(root[i], root[j])
        before = root.copy()
        np.minimum.at(root, root[i], low)
        np.minimum.at(root, root[j], low)
        while (root[root] != root).any():
            root = root[root]
        if (root == before).all():
            break
        open_ = root[i] != root[j]
        i, j = i[open_], j[open_]
    return root


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, label) of every node of an edge; `label` is the smallest node of its component. Null ends are no edges."""
    both = edges.select(F.col(a).alias("a"), F.col(b).alias("b")).filter("a IS NOT NULL AND b IS NOT NULL")
    with step(edges.sparkSession):
        now = saved(both.filter("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "edges")
        labels = None
        while not now.isEmpty():
            ends = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
            up = ends.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("node"), F.least("a", "m").alias("up"))
            up = saved(up, "parents")
            twice = up.alias("x").join(up.alias("y"), F.col("x.up") == F.col("y.node")).select(F.col("x.node").alias("node"), F.col("y.up").alias("up"))
            twice = saved(twice, "grandparents")
            if labels is None:
                labels = twice.select("node", F.col("up").alias("label"))
            else:
                moved = labels.join(twice.select(F.col("node").alias("label"), "up"), "label", "left")
                labels = saved(moved.select("node", F.coalesce("up", "label").alias("label")), "labels")
            left = now.join(twice.select(F.col("node").alias("a"), F.col("up").alias("ua")), "a").join(twice.select(F.col("node").alias("b"), F.col("up").alias("ub")), "b")
            now = saved(left.filter("ua <> ub").select(F.least("ua", "ub").alias("a"), F.greatest("ua", "ub").alias("b")).distinct(), "edges")
        labels = now.select(F.col("a").alias("node"), F.col("b").alias("label")) if labels is None else labels
        return saved(labels, "components", keep=True)
