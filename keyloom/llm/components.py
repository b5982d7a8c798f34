"""Connected components by alternating stars, as DataFrame joins.

After Kiveris et al., "Connected Components in MapReduce and Beyond" (2014).
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keyloom.llm.text import forget, stable

#: Far above what the method needs (a square of the logarithm of the nodes).
MOST_ROUNDS = 100


def stars(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each node of the links but the least of its component, and that least node."""
    nodes, place = np.unique(np.concatenate([u, v]), return_inverse=True)
    a, b = place[: len(u)], place[len(u) :]
    label = np.arange(len(nodes))
    while len(a):
        la, lb = label[a], label[b]
        apart = la != lb
        a, b = a[apart], b[apart]
        low, high = np.minimum(la, lb)[apart], np.maximum(la, lb)[apart]
        np.minimum.at(label, high, low)
        while (label != label[label]).any():
            label = label[label]
    moved = label != np.arange(len(nodes))
    return nodes[moved], nodes[label[moved]]


def _step(edges: DataFrame) -> DataFrame:
    """A large star, then a small star; edges have u > v before and after.

    Large: each node's larger neighbours are linked to its least neighbour or to
    itself.  Small: each node and its smaller neighbours are linked to the least.
    Joins merge: the sides grow with the edges, so none is broadcast.
    """
    up = edges.select(F.col("v").alias("u"), F.col("u").alias("v"))
    least = edges.select("u", "v").unionAll(up).groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    large = up.hint("merge").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    least = large.groupBy("u").agg(F.min("v").alias("m"))
    moved = large.hint("merge").join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionAll(least.select("u", F.col("m").alias("v"))).distinct()


def _settled(edges: DataFrame) -> bool:
    """Whether every node has one edge to a smaller node, or only edges from larger ones."""
    sides = edges.select(F.col("u").alias("node"), F.lit(1).alias("down"), F.lit(0).alias("up")).unionAll(edges.select(F.col("v").alias("node"), F.lit(0).alias("down"), F.lit(1).alias("up")))
    nodes = sides.groupBy("node").agg(F.sum("down").alias("down"), F.max("up").alias("up"))
    return not nodes.where("down > 1 OR (down > 0 AND up > 0)").agg(F.count("*")).first()[0]


def components(edges: DataFrame) -> DataFrame:
    """node and root (the least node of its component) for each node of an edge.

    ``edges`` has long columns u and v; direction and repeats don't matter, loops
    and nulls are ignored.  Only a count over the nodes comes to the driver.
    """
    edges = stable(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    for _ in range(MOST_ROUNDS):
        if _settled(edges):
            return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).unionAll(edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
        after = stable(_step(edges))
        forget(edges)
        edges = after
    raise RuntimeError("components did not settle")
