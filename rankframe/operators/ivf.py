"""Exact vector search that skips what can't reach the k-th score: an inverted file by
centre, each list cut into rings by the angle to the centre.

A query at angle a from a centre is at least ``max(0, a - high, low - a)`` from any vector
of the ring between the angles low and high, so its product with one is at most the cosine
of that times the two lengths. The blocks of greatest bounds are scored first; their k-th
score is a threshold, and of the other blocks only those whose bound reaches it are scored.
"""

from __future__ import annotations

import math
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.window import Window

from rankframe.operators.dense import dense_scores, dot, with_nearest
from rankframe.operators.lineage import stored
from rankframe.operators.ranking import PLACES, ranked

#: Width of a ring, rows scored in one task at a time, and rows (times k) scored first.
RING = math.pi / 64
CHUNK, PROBE = 20_000, 4
#: What rounding may hide, in angles and in scores.
SLACK = 4 * 10.0**-PLACES


class VectorIndex(NamedTuple):
    """``rows(doc_id, vec, cluster_id, ring)``, ``blocks(cluster_id, ring, n, low, high)`` with
    the least and greatest length, and unit ``centers(cluster_id, vec)``."""

    rows: DataFrame
    blocks: DataFrame
    centers: DataFrame


def _length(v: str) -> Column:
    return F.sqrt(dot(v, v))


def _angle(product: Column, lengths: Column) -> Column:
    """Angle of two vectors; a right one where one of them is zero."""
    return F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), F.when(lengths > 0, product / lengths).otherwise(0.0))))


def build(rows: DataFrame, centers: DataFrame) -> VectorIndex:
    """Index of all of ``rows(doc_id, vec)`` around given unit ``centers(cluster_id, vec)``,
    such as ``rerank.fit_clusters`` gives (any centres are right; close ones skip more)."""
    spark = rows.sparkSession
    near = with_nearest(rows.select("doc_id", F.transform("vec", lambda x: x.cast("double")).alias("vec")), centers)
    near = near.withColumn("length", _length("vec")).withColumn("ring", F.floor(_angle(F.col("score"), F.col("length")) / RING).cast("int"))
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    near = near.select("doc_id", "vec", "length", "cluster_id", "ring").repartition(tasks, "cluster_id", "ring", F.pmod(F.xxhash64("doc_id"), F.lit(8)))
    near = stored(near.sortWithinPartitions("cluster_id", "ring"), "vector-lists")
    blocks = stored(near.groupBy("cluster_id", "ring").agg(F.count("*").alias("n"), F.min("length").alias("low"), F.max("length").alias("high")), "vector-blocks")
    return VectorIndex(near.drop("length"), blocks, centers.select("cluster_id", "vec"))


def bounds(index: VectorIndex, queries: DataFrame) -> DataFrame:
    """``query_id, cluster_id, ring, n, bound`` of all blocks for each query."""
    sized = queries.select("query_id", _length("vec").alias("length"))
    to = dense_scores(index.centers.withColumnRenamed("cluster_id", "doc_id"), queries, None, places=None).join(sized, "query_id")
    to = to.select("query_id", F.col("doc_id").alias("cluster_id"), "length", _angle(F.col("score"), F.col("length")).alias("a"))
    each = to.join(index.blocks, "cluster_id")
    # a row's angle was taken from a score rounded to PLACES, relative to its length
    off = F.when(F.col("low") > 0, F.least(F.lit(math.pi), F.sqrt(F.lit(SLACK) / F.col("low")))).otherwise(math.pi)
    near, far = F.col("ring") * RING - off, (F.col("ring") + 1) * RING + off
    least = F.greatest(F.lit(0.0), F.col("a") - far, near - F.col("a"))
    reach = F.cos(F.least(least, F.lit(math.pi)))
    bound = F.col("length") * reach * F.when(reach >= 0, F.col("high")).otherwise(F.col("low")) + SLACK
    return each.select("query_id", "cluster_id", "ring", "n", bound.alias("bound"))


def _best_of_block(k: int):
    def run(rows: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
        if rows.empty or asked.empty:
            return pd.DataFrame({"query_id": [], "doc_id": [], "score": []}).astype({"query_id": "int64", "doc_id": "int64", "score": "float64"})
        ids, found = rows["doc_id"].to_numpy(), []
        matrix = np.stack(rows["vec"].to_numpy())
        order = np.argsort(ids, kind="stable")
        ids, matrix = ids[order], matrix[order]
        for query, vec in zip(asked["query_id"], asked["vec"]):
            scores = np.round(matrix @ np.asarray(vec, np.float64), PLACES)
            at = np.argsort(-scores, kind="stable")[:k]
            found.append(pd.DataFrame({"query_id": np.full(len(at), query), "doc_id": ids[at], "score": scores[at]}))
        return pd.concat(found)

    return run


def _scored(index: VectorIndex, queries: DataFrame, pairs: DataFrame, k: int) -> DataFrame:
    """The best k of each asked block ``pairs(query_id, cluster_id, ring)``; a large block is
    scored in chunks."""
    chunks = index.blocks.select("cluster_id", "ring", F.ceil(F.col("n") / CHUNK).cast("int").alias("chunks"))
    rows = index.rows.join(F.broadcast(chunks), ["cluster_id", "ring"]).withColumn("chunk", F.pmod(F.xxhash64("doc_id"), F.col("chunks")).cast("int"))
    asked = pairs.join(chunks, ["cluster_id", "ring"]).join(queries.select("query_id", F.transform("vec", lambda x: x.cast("double")).alias("vec")), "query_id")
    asked = asked.withColumn("chunk", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
    key = ["cluster_id", "ring", "chunk"]
    left, right = rows.select(*key, "doc_id", "vec").groupBy(*key), asked.select(*key, "query_id", "vec").groupBy(*key)
    return left.cogroup(right).applyInPandas(_best_of_block(k), "query_id long, doc_id long, score double")


def search(index: VectorIndex, queries: DataFrame, k: int = 10) -> tuple[DataFrame, DataFrame]:
    """The ranking of ``queries(query_id, vec)``, a stated set, equal to a full scan's, and
    ``query_id, n_scored, n_all``."""
    rated = bounds(index, queries)
    order = Window.partitionBy("query_id").orderBy(F.desc("bound"), "cluster_id", "ring")
    before = F.sum("n").over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("n")
    rated = stored(rated.withColumn("first", before < PROBE * k), "vector-bounds")
    sure = stored(_scored(index, queries, rated.filter("first"), k), "vector-probed")
    least = ranked(sure, k).filter(F.col("rank") == k).select("query_id", F.col("score").alias("least"))
    more = rated.filter("not first").join(least, "query_id", "left").filter("least is null or bound >= least")
    more = stored(more.select("query_id", "cluster_id", "ring", "n"), "vector-more")
    out = ranked(sure.union(_scored(index, queries, more, k)), k)
    read = rated.filter("first").select("query_id", "n").union(more.select("query_id", "n")).groupBy("query_id").agg(F.sum("n").alias("n_scored"))
    return out, read.join(rated.groupBy("query_id").agg(F.sum("n").alias("n_all")), "query_id")
