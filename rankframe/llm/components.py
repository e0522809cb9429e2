"""Connected components of an edge table by alternating star contraction."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, functions as F

from rankframe.llm.common import discard, join_hot, stored


def local_roots(n: int, a: np.ndarray, b: np.ndarray, label: np.ndarray | None = None) -> np.ndarray:
    """Smallest index connected to each of 0..n-1 by edges ``a-b`` (and a former result)."""
    label = np.arange(n) if label is None else label
    while True:
        la, lb = label[a], label[b]
        apart = la != lb
        if not apart.any():
            return label
        a, b = a[apart], b[apart]
        np.minimum.at(label, np.maximum(la, lb)[apart], np.minimum(la, lb)[apart])
        while True:
            up = label[label]
            if (up == label).all():
                break
            label = up


def _settled(edges: DataFrame) -> bool:
    """Whether the edges are stars: no node has two smaller neighbours, or one and a larger."""
    ends = edges.select("u", F.lit(1).alias("up"), F.lit(0).alias("down")).union(edges.select("v", F.lit(0), F.lit(1)))
    return ends.groupBy("u").agg(F.sum("up").alias("up"), F.max("down").alias("down")).filter("up > 1 or up = 1 and down = 1").isEmpty()


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """``edges(u, v)`` of longs in, ``(node, root)`` out, with the least node of each
    component as root and a row for every node that has an edge to another node.

    Each round joins the edges with the least neighbour of each end (large star, then
    small star) and is written to the shared folder; rounds grow with the logarithm of
    the longest chain. Self loops and repeated edges do no harm.
    """
    spark = edges.sparkSession
    now = edges.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    now = stored(spark, now, "edges")
    for _ in range(rounds):
        if _settled(now):
            return now.select(F.col("u").alias("node"), F.col("v").alias("root")).union(now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
        both = now.union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        # the hub of a star has as many rows as the star has nodes
        least = stored(spark, both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"), F.count("*").alias("n")), "least")
        large = join_hot(both, least, ["u"], "n").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        large = stored(spark, large, "large")
        discard(now, least)
        least = stored(spark, large.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n")), "least")
        small = join_hot(large, least, ["u"], "n").select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v")))
        now = stored(spark, small.filter("u <> v").distinct(), "small")
        discard(large, least)
    raise RuntimeError(f"components did not settle in {rounds} rounds")
