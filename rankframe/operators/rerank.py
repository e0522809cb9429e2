"""Reranking: cluster affinity, pair scores, parsed orders; training lists and losses."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from rankframe.functions.text import ranking_positions
from rankframe.operators.dense import dot, nearest, unit
from rankframe.operators.ranking import maybe_broadcast, min_max, ranked


def fit_clusters(rows: DataFrame, k: int, seed: int = 42) -> DataFrame:
    """``cluster_id, vec`` (unit length) of k-means over ``rows(doc_id, vec)``."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    data = rows.select(array_to_vector(F.transform("vec", lambda x: x.cast("double"))).alias("features"))
    model = KMeans(k=k, seed=seed).fit(data)
    centers = [(i, [float(x) for x in c]) for i, c in enumerate(model.clusterCenters())]
    return rows.sparkSession.createDataFrame(centers, "cluster_id long, vec array<double>").select("cluster_id", unit("vec").alias("vec"))


def lloyd(rows: DataFrame, start: DataFrame, rounds: int) -> DataFrame:
    """``cluster_id, vec`` (not scaled) after some rounds of k-means from given centres
    ``start(cluster_id, vec)``; a centre that no row is nearest to stays as it was."""
    from rankframe.operators.lineage import stored

    wide = rows.select("doc_id", "vec", F.concat(F.transform("vec", lambda x: x.cast("double")), F.array(F.lit(1.0))).alias("wide"))
    centers = start.select("cluster_id", F.transform("vec", lambda x: x.cast("double")).alias("vec"))
    for _ in range(rounds):
        # the nearest centre c of x has the greatest x.c - c.c / 2
        sent = centers.select("cluster_id", F.concat("vec", F.array(-dot("vec", "vec") / 2)).alias("vec"))
        near = nearest(wide.select("doc_id", F.col("wide").alias("vec")), sent).select("doc_id", "cluster_id")
        each = wide.join(near, "doc_id").select("cluster_id", F.posexplode("vec").alias("i", "x")).groupBy("cluster_id", "i").agg(F.avg(F.col("x").cast("double")).alias("x"))
        means = each.groupBy("cluster_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "x"))), lambda s: s["x"]).alias("mean"))
        centers = stored(centers.join(means, "cluster_id", "left").select("cluster_id", F.coalesce("mean", "vec").alias("vec")), "centres")
    return centers


def mean_centers(rows: DataFrame) -> DataFrame:
    """Unit mean vector of each given cluster of ``rows(cluster_id, vec)``."""
    each = rows.select("cluster_id", F.posexplode("vec").alias("i", "x")).groupBy("cluster_id", "i").agg(F.avg(F.col("x").cast("double")).alias("x"))
    vec = F.transform(F.array_sort(F.collect_list(F.struct("i", "x"))), lambda s: s["x"])
    return each.groupBy("cluster_id").agg(vec.alias("vec")).select("cluster_id", unit("vec").alias("vec"))


def gold_clusters(rows: DataFrame, is_gold: Column, k: int = 100, seed: int = 42) -> tuple[DataFrame, DataFrame]:
    """Centres fitted on gold rows only, and the nearest centre of every row."""
    gold = rows.filter(is_gold)
    centers = fit_clusters(gold, min(k, max(2, gold.count())), seed)
    return centers, nearest(rows, centers)


def cluster_blend(candidates: DataFrame, queries: DataFrame, assignment: DataFrame, centers: DataFrame, alpha: float, k: int, docs: DataFrame | None = None) -> DataFrame:
    """alpha * minmax(score) + (1 - alpha) * minmax(cosine of query and the candidate's
    centre, times the candidate's cosine to it if ``docs(doc_id, vec)`` is given). Constant
    scores count 1, constant affinities 0.5, candidates without a cluster have affinity 0."""
    rows = candidates.join(assignment.select("doc_id", "cluster_id"), "doc_id", "left")
    rows = rows.join(maybe_broadcast(centers.select("cluster_id", F.col("vec").alias("center"))), "cluster_id", "left")
    rows = rows.join(maybe_broadcast(queries.select("query_id", F.col("vec").alias("qvec"))), "query_id", "left")
    affinity = dot("qvec", "center")
    if docs is not None:
        rows = rows.join(docs.select("doc_id", F.col("vec").alias("dvec")), "doc_id", "left")
        affinity = affinity * dot("dvec", "center")
    rows = rows.withColumn("affinity", F.round(F.coalesce(affinity, F.lit(0.0)), 9))
    score = alpha * min_max("score", ["query_id"], 1.0) + (1 - alpha) * min_max("affinity", ["query_id"], 0.5)
    return ranked(rows.select("query_id", "doc_id", score.alias("score")), k)


def score_pairs(candidates: DataFrame, queries: DataFrame, docs: DataFrame, scorer: Callable[[pd.Series, pd.Series], pd.Series]) -> DataFrame:
    """Adds ``pair_score`` by a pluggable scorer of (question, text) batches; a missing text is ''."""
    score = F.pandas_udf(scorer, "double")
    rows = candidates.join(queries.select("query_id", F.col("text").alias("question")), "query_id").join(docs.select("doc_id", "text"), "doc_id", "left")
    return rows.withColumn("pair_score", score("question", F.coalesce("text", F.lit("")))).drop("question", "text")


def pair_blend(scored: DataFrame, alpha: float, k: int) -> DataFrame:
    """Rank by pair score alone (alpha 0), or (1 - alpha) * minmax(pair) + alpha * minmax(score)."""
    score = F.col("pair_score") if alpha == 0 else (1 - alpha) * min_max("pair_score", ["query_id"]) + alpha * min_max("score", ["query_id"])
    return ranked(scored.select("query_id", "doc_id", score.alias("score")), k)


def best_parse(tries: DataFrame, most: int = 3) -> DataFrame:
    """``query_id, text`` of the try that is used: the first that names half the candidates,
    else the one that names most. ``tries(query_id, attempt, text, n)``."""
    parsed = tries.filter(F.col("attempt") <= most).withColumn("size", F.size(ranking_positions("text", F.col("n"))))
    enough = F.col("size") >= F.floor(F.col("n") / 2)
    order = Window.partitionBy("query_id").orderBy(F.when(enough, 0).otherwise(1), F.when(enough, F.col("attempt")), F.desc("size"), "attempt")
    return parsed.withColumn("r", F.row_number().over(order)).filter("r = 1").select("query_id", "text")


def listwise(candidates: DataFrame, answers: DataFrame, k: int | None = None) -> DataFrame:
    """Order parsed from ``answers(query_id, text)``: named candidates first, in order, then
    the others in source order; score 1 / rank."""
    window = Window.partitionBy("query_id")
    rows = candidates.withColumn("n", F.count("*").over(window)).withColumn("pos", F.row_number().over(window.orderBy("rank")) - 1)
    sizes = rows.select("query_id", "n").distinct()
    named = answers.join(sizes, "query_id").select("query_id", F.posexplode(ranking_positions("text", F.col("n"))).alias("place", "pos"))
    rows = rows.join(named, ["query_id", "pos"], "left")
    rank = F.row_number().over(window.orderBy(F.asc_nulls_last("place"), "pos"))
    out = rows.withColumn("rank", rank).select("query_id", "doc_id", F.col("rank").cast("int").alias("rank"), F.round(1.0 / F.col("rank"), 6).alias("score"))
    return out if k is None else out.filter(F.col("rank") <= k)


def rerank_or_pass(reranked: DataFrame, source: DataFrame, k: int) -> DataFrame:
    """Reranked queries, and the source list, cut to k, of queries that were not reranked."""
    rest = source.join(reranked.select("query_id").distinct(), "query_id", "left_anti")
    return reranked.unionByName(rest).filter(F.col("rank") <= k)


def training_lists(candidates: DataFrame, gold: DataFrame, corpus: DataFrame, n: int) -> DataFrame:
    """``query_id, place, doc_id, is_gold``: the first gold document, then the first n
    candidates of the corpus that aren't gold. Queries without either are left out.
    ``gold(query_id, pos, doc_id)``."""
    known = corpus.select("doc_id")
    first = gold.groupBy("query_id").agg(F.min_by("doc_id", "pos").alias("doc_id")).join(known, "doc_id", "left_semi").select("query_id", "doc_id")
    others = candidates.join(gold.select("query_id", "doc_id"), ["query_id", "doc_id"], "left_anti").join(known, "doc_id", "left_semi")
    order = Window.partitionBy("query_id").orderBy("rank")
    others = others.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= n).join(first.select("query_id"), "query_id", "left_semi")
    heads = first.join(others.select("query_id").distinct(), "query_id", "left_semi").select("query_id", F.lit(0).alias("place"), "doc_id", F.lit(True).alias("is_gold"))
    return heads.unionByName(others.select("query_id", F.col("place").cast("int").alias("place"), "doc_id", F.lit(False).alias("is_gold")))


def distillation_loss(lists: DataFrame) -> DataFrame:
    """``query_id, kl, ce, loss`` of ``lists(query_id, place, de, ce)``: KL(softmax(de) ||
    softmax(ce)) plus the cross entropy of ce at place 0."""
    w = Window.partitionBy("query_id")
    logp = lambda c: F.col(c) - F.max(c).over(w) - F.log(F.sum(F.exp(F.col(c) - F.col(f"max_{c}"))).over(w))
    rows = lists.withColumn("max_de", F.max("de").over(w)).withColumn("max_ce", F.max("ce").over(w))
    rows = rows.withColumn("lde", logp("de")).withColumn("lce", logp("ce"))
    out = rows.groupBy("query_id").agg(F.sum(F.exp("lde") * (F.col("lde") - F.col("lce"))).alias("kl"), F.sum(F.when(F.col("place") == 0, -F.col("lce")).otherwise(0.0)).alias("ce"))
    return out.withColumn("loss", F.col("kl") + F.col("ce"))
