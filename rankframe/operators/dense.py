"""Vector search: blocks of queries against all rows, best k of each task merged by Spark."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from rankframe.operators.ranking import PLACES, ranked

#: Numbers in the query vectors that are sent to tasks at once; more queries go in blocks.
BLOCK_NUMBERS = 4_000_000
#: Scores that a task holds at once, and rows of a tile of them.
TILE_SCORES, TILE_ROWS = 1_000_000, 2_000


def dot(a: Column | str, b: Column | str) -> Column:
    """Dot product of two arrays in doubles."""
    a, b = (F.col(x) if isinstance(x, str) else x for x in (a, b))
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def unit(v: Column | str) -> Column:
    """Vector divided by its length; a zero vector stays."""
    v = F.col(v) if isinstance(v, str) else v
    v = F.transform(v, lambda x: x.cast("double"))
    norm = F.sqrt(dot(v, v))
    return F.when(norm == 0, v).otherwise(F.transform(v, lambda x: x / norm))


def encode(texts: DataFrame, key: str, encoder: Callable[[pd.Series], pd.Series], prefix: str = "") -> DataFrame:
    """``key, vec`` by a pluggable encoder of text batches; vectors are made unit length."""
    vectors = F.pandas_udf(encoder, "array<double>")
    return texts.select(key, vectors(F.concat(F.lit(prefix), F.coalesce("text", F.lit("")))).alias("vec")).select(key, unit("vec").alias("vec"))


def _tiles(batches: Iterator[pd.DataFrame], ids: np.ndarray, matrix: np.ndarray) -> Iterator[tuple[slice, np.ndarray, np.ndarray]]:
    """``queries, doc_ids, scores`` of tiles of all queries by all rows, at most
    ``TILE_SCORES`` scores each; a tile's rows go by id."""
    for rows in batches:
        doc = rows["doc_id"].to_numpy()
        order = np.argsort(doc, kind="stable")
        for at in range(0, len(doc), TILE_ROWS):
            part = order[at : at + TILE_ROWS]
            vectors = np.stack(rows["vec"].to_numpy()[part]).astype(np.float64).T
            step = max(1, TILE_SCORES // len(part))
            for q in range(0, len(ids), step):
                yield slice(q, min(q + step, len(ids))), doc[part], matrix[q : q + step] @ vectors


def _best(batches: Iterator[pd.DataFrame], ids: np.ndarray, matrix: np.ndarray, k: int) -> Iterator[pd.DataFrame]:
    """Best k of each query: scores and ids of those so far, and per tile what beats the k-th."""
    empty = np.iinfo(np.int64).max
    score, doc, held = np.full((len(ids), k), -np.inf), np.full((len(ids), k), empty, np.int64), np.zeros((len(ids), k), bool)
    for queries, names, scores in _tiles(batches, ids, matrix):
        last, full = np.where(np.isnan(score[queries, -1]), np.inf, score[queries, -1]), held[queries, -1]
        near = ~(scores < (last - 2 * 10.0**-PLACES)[:, None])  # NaN is greatest
        near[~full] = True
        many = np.flatnonzero(near.sum(axis=1) > 4 * k)
        if len(many):  # of those only the tile's own best k
            near[many] = False
            step = max(1, TILE_SCORES // 8 // len(names))
            for at in range(0, len(many), step):
                some = many[at : at + step]
                first = np.argsort(-np.round(scores[some], PLACES), axis=1, kind="stable")
                # NaN goes last there, and first here
                lost = np.isnan(scores[some]).sum(axis=1)
                keep = (np.arange(k)[None, :] - lost[:, None]) % len(names)
                near[some[:, None], np.take_along_axis(first, keep[:, : len(names)], axis=1)] = True
        q, at = np.nonzero(near)
        if not len(q):
            continue
        rows = np.unique(q)
        old_q, old_at = np.nonzero(held[queries][rows])
        all_q = np.concatenate([np.searchsorted(rows, q), old_q])
        all_score = np.concatenate([np.round(scores[q, at], PLACES), score[queries][rows[old_q], old_at]])
        all_doc = np.concatenate([names[at], doc[queries][rows[old_q], old_at]])
        order = np.lexsort((all_doc, -np.where(np.isnan(all_score), np.inf, all_score), ~np.isnan(all_score), all_q))
        all_q = all_q[order]
        place = np.arange(len(all_q)) - np.searchsorted(all_q, all_q)
        order, all_q, place = order[place < k], all_q[place < k], place[place < k]
        at = rows[all_q] + queries.start
        score[at, place], doc[at, place], held[at, place] = all_score[order], all_doc[order], True
    q, at = np.nonzero(held)
    for first in range(0, len(q), TILE_SCORES // 8):
        part = slice(first, first + TILE_SCORES // 8)
        yield pd.DataFrame({"query_id": ids[q[part]], "doc_id": doc[q[part], at[part]], "score": score[q[part], at[part]]})


def _every(batches: Iterator[pd.DataFrame], ids: np.ndarray, matrix: np.ndarray, places: int | None) -> Iterator[pd.DataFrame]:
    for queries, names, scores in _tiles(batches, ids, matrix):
        scores = scores if places is None else np.round(scores, places)
        yield pd.DataFrame({"query_id": np.repeat(ids[queries], len(names)), "doc_id": np.tile(names, len(scores)), "score": scores.ravel()})


def _blocks(docs: DataFrame, queries: DataFrame, work: Callable, schema: str) -> DataFrame:
    """``work(batches, ids, matrix)`` over all of ``docs(doc_id, vec)`` for blocks of
    ``queries(query_id, vec)``, a stated set."""
    spark = docs.sparkSession
    first = queries.select(F.size("vec")).first()
    per_block = max(1, BLOCK_NUMBERS // max(1, first[0] if first else 1))
    blocks = max(1, -(-queries.count() // per_block))
    out = None
    for block in range(blocks):
        rows = queries.filter(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == block).select("query_id", "vec").collect()
        ids = np.array([r[0] for r in rows], np.int64)
        matrix = np.array([r[1] for r in rows], np.float64).reshape(len(rows), len(rows[0][1]) if rows else 0)
        sent = spark.sparkContext.broadcast((ids, matrix))
        part = docs.select("doc_id", "vec").mapInPandas(lambda it, sent=sent: work(it, *sent.value) if len(sent.value[0]) else iter(()), schema)
        out = part if out is None else out.union(part)
    return out


def dense_scores(docs: DataFrame, queries: DataFrame, k: int | None, places: int | None = PLACES) -> DataFrame:
    """Scores that hold each query's best k of ``docs(doc_id, vec)``, or all scores without
    k (those to any number of places); ``queries(query_id, vec)`` is a stated set."""
    work = (lambda it, ids, matrix: _every(it, ids, matrix, places)) if k is None else lambda it, ids, matrix: _best(it, ids, matrix, k)
    return _blocks(docs, queries, work, "query_id long, doc_id long, score double")


def _ends(batches: Iterator[pd.DataFrame], ids: np.ndarray, matrix: np.ndarray) -> Iterator[pd.DataFrame]:
    low, high = np.full(len(ids), np.inf), np.full(len(ids), -np.inf)
    for queries, _, scores in _tiles(batches, ids, matrix):
        low[queries], high[queries] = np.minimum(low[queries], scores.min(axis=1)), np.maximum(high[queries], scores.max(axis=1))
    some = np.isfinite(low)
    yield pd.DataFrame({"query_id": ids[some], "low": low[some], "high": high[some]})


def dense_range(docs: DataFrame, queries: DataFrame) -> DataFrame:
    """``query_id, low, high``: least and greatest dot product with all of ``docs(doc_id, vec)``."""
    ends = _blocks(docs, queries, _ends, "query_id long, low double, high double")
    return ends.groupBy("query_id").agg(F.min("low").alias("low"), F.max("high").alias("high"))


def dense_topk(docs: DataFrame, queries: DataFrame, k: int = 10) -> DataFrame:
    return ranked(dense_scores(docs, queries, k), k)


def retrieve_texts(texts: DataFrame, queries: DataFrame, k: int = 3) -> DataFrame:
    """``query_id, answer``: the best k texts of ``texts(doc_id, vec, text)`` joined by line feeds."""
    top = dense_topk(texts, queries, k).join(texts.select("doc_id", "text"), "doc_id")
    return top.groupBy("query_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "text"))), lambda x: x["text"]), "\n").alias("answer"))


def _nearest(batches: Iterator[pd.DataFrame], ids: np.ndarray, matrix: np.ndarray) -> Iterator[pd.DataFrame]:
    """Rows with the best of these centres, or of those before (``cluster_id``, ``score``)."""
    for rows in batches:
        if len(rows):
            scores = np.round(np.stack(rows["vec"].to_numpy()).astype(np.float64) @ matrix.T, PLACES)
            at = scores.argmax(axis=1)  # the first of equal ones, and ids ascend
            best, score = ids[at], scores[np.arange(len(at)), at]
            if "score" in rows:
                old, before = rows["cluster_id"].to_numpy(), rows["score"].to_numpy()
                keep = (before > score) | ((before == score) & (old < best))
                best, score = np.where(keep, old, best), np.where(keep, before, score)
            yield pd.DataFrame({"doc_id": rows["doc_id"].to_numpy(), "vec": rows["vec"].to_numpy(), "cluster_id": best, "score": score})


#: Numbers in the centres that are sent to tasks at once; more centres go in blocks.
CENTER_NUMBERS = 8_000_000


def with_nearest(rows: DataFrame, centers: DataFrame) -> DataFrame:
    """``doc_id, vec, cluster_id, score``: each row's centre of greatest dot product; ties go
    to the least id. ``centers(cluster_id, vec)`` are sent to every task in blocks of
    ``CENTER_NUMBERS`` numbers; rows pass all blocks in one stage."""
    numbers = centers.agg(F.sum(F.size("vec"))).first()[0]
    if not numbers:
        raise ValueError("no centres")
    kind = dict(rows.dtypes)["vec"]
    now, blocks = rows.select("doc_id", "vec"), -(-numbers // CENTER_NUMBERS)
    for block in range(blocks):
        part = centers.filter(F.pmod(F.xxhash64("cluster_id"), F.lit(blocks)) == block)
        found = sorted((r["cluster_id"], r["vec"]) for r in part.select("cluster_id", "vec").collect())
        if found:
            sent = rows.sparkSession.sparkContext.broadcast((np.array([i for i, _ in found], np.int64), np.array([v for _, v in found], np.float64)))
            now = now.mapInPandas(lambda it, sent=sent: _nearest(it, *sent.value), f"doc_id long, vec {kind}, cluster_id long, score double")
    return now


def nearest(rows: DataFrame, centers: DataFrame) -> DataFrame:
    """``doc_id, cluster_id, score``, see ``with_nearest``."""
    return with_nearest(rows, centers).select("doc_id", "cluster_id", "score")
