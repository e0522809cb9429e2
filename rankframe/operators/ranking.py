"""The ranked schema and what every ranker shares."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

#: Scores are compared after rounding to so many places, so that the order in which a sum
#: was taken can't change a ranking; ties go by document.
PLACES = 6
#: Tables up to this many rows are broadcast; beyond that the planner shuffles.
BROADCAST_ROWS = 200_000


def maybe_broadcast(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """``df`` with a broadcast hint if it has at most ``rows`` rows (counts at most that many)."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def spread(df: DataFrame) -> DataFrame:
    """Rows dealt evenly to as many tasks as a shuffle has: for work that is heavy for its
    bytes, which a small file would put into a task or two."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def ranked(scores: DataFrame, k: int | None = None, by: list[Column] | None = None) -> DataFrame:
    """``query_id, doc_id, rank, score`` from ``scores(query_id, doc_id, score)``, the best
    k of each query. The window has a rank limit, so Spark keeps k rows a task and query."""
    out = scores.withColumn("score", F.round("score", PLACES))
    order = Window.partitionBy("query_id").orderBy(*(by or [F.desc("score"), F.asc("doc_id")]))
    out = out.withColumn("rank", F.row_number().over(order))
    if k is not None:
        out = out.filter(F.col("rank") <= k)
    return out.select("query_id", "doc_id", F.col("rank").cast("int").alias("rank"), "score")


def pad_with_zeros(scores: DataFrame, queries: DataFrame, docs: DataFrame, k: int) -> DataFrame:
    """Adds documents of score 0 to non-negative ``scores`` of queries that have fewer than k.

    Padding goes by least id, so only the 2k least ids can be needed.
    """
    least = docs.select("doc_id").orderBy("doc_id").limit(2 * k)
    short = queries.select("query_id").distinct()
    spare = short.join(F.broadcast(least), F.lit(True)).join(scores.select("query_id", "doc_id"), ["query_id", "doc_id"], "left_anti")
    return scores.select("query_id", "doc_id", "score").union(spare.select("query_id", "doc_id", F.lit(0.0).alias("score")))


def min_max(value: str, partition: list[str], constant: float = 1.0) -> Column:
    """(x - min) / (max - min) inside a partition; ``constant`` where all values are equal."""
    w = Window.partitionBy(*partition)
    low, high = F.min(value).over(w), F.max(value).over(w)
    return F.when(high == low, F.lit(constant)).otherwise((F.col(value) - low) / (high - low))
