"""Centroid clustering (Lloyd's rounds, exact) with geometrically tightened bounds.

Vectors are integers, so distances and means are exact. Each vector keeps its cluster, an
upper bound of the distance to its centroid and a lower bound of the distance to all others.
When centroids move, the upper bound grows by its centroid's drift. The lower bound need not
shrink by the full drift of the others: a cluster's vectors lie in a sphere around its
centroid, and how much nearer a centroid that moves from ``a`` to ``b`` can get to a point
of that sphere is a matter of the plane through ``a``, ``b`` and the sphere's centre
(``most_gained``). Vectors whose bounds still leave the nearest centroid open are scanned
exactly.

A round is one pass over the written vectors; what goes through the driver is a table of
clusters by components.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from rankframe.llm.common import discard, stored, tune

COMPONENTS, CLUSTERS, ROUNDS, SEED = 64, 8, 10, 3
#: Components are floor(SCALE * x).
SCALE = 1024.0
#: Components up to this size have distances that fit 64 bits; larger ones take Python's integers.
SMALL = 1 << 27
#: Relative margin of bounds, far above the rounding of doubles.
MARGIN = 1e-6

STATE = "vec_id long, vector binary, cluster int, was int, upper double, lower double, scans int, distance long"
_STATE = pa.schema([("vec_id", pa.int64()), ("vector", pa.binary()), ("cluster", pa.int32()), ("was", pa.int32()), ("upper", pa.float64()), ("lower", pa.float64()), ("scans", pa.int32()), ("distance", pa.int64())])


def _wide(x: np.ndarray) -> np.ndarray:
    """Integers that sums of squares can't overflow."""
    return x if x.dtype == object or not x.size or max(int(x.max()), -int(x.min())) <= SMALL else x.astype(object)


def squared(vectors: np.ndarray, centre: np.ndarray) -> np.ndarray:
    """Exact squared distances of rows from a centre."""
    gap = vectors - centre
    return (gap * gap).sum(axis=1)


def _length(x: np.ndarray) -> float:
    return math.sqrt(float(sum(int(v) ** 2 for v in x)))


def most_gained(centre: np.ndarray, radius: float, a: np.ndarray, b: np.ndarray) -> float:
    """A bound of ``|x - a| - |x - b|`` over all x within ``radius`` of ``centre``.

    With m the middle of a and b, a point x that m sees at an angle t from the direction of
    b gains at most ``|a - b| * cos(t)``, for ``|x-a|**2 - |x-b|**2`` is ``2 |a-b| |x-m| cos(t)``
    and ``|x-a| + |x-b|`` is at least ``2 |x-m|``. The sphere lies between the angles of its
    centre less and plus ``asin(radius / |centre - m|)``; a sphere that holds m may gain all.
    """
    move = b - a
    drift = _length(move)
    if drift == 0:
        return 0.0
    twice = 2 * centre - a - b
    far = _length(twice) / 2
    if far <= radius * (1 + MARGIN):
        return drift * (1 + MARGIN)
    cosine = float(sum(int(p) * int(q) for p, q in zip(twice, move))) / 2 / (far * drift)
    angle = math.acos(min(1.0, max(-1.0, cosine))) - math.asin(radius / far)
    return drift * (max(0.0, math.cos(max(0.0, angle))) + MARGIN)


def _vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        n = batch.num_rows
        values = np.floor(SCALE * batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(n, COMPONENTS))
        if n and not np.abs(values).max() < 1 << 62:
            raise ValueError("components of 2**52 and more aren't supported")
        rows = values.astype("<i8")
        none = np.full(n, -1, np.int32)
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array([r.tobytes() for r in rows], pa.binary()), pa.array(none), pa.array(none), pa.array(np.full(n, np.inf)), pa.array(np.full(n, -np.inf)), pa.array(np.zeros(n, np.int32)), pa.nulls(n, pa.int64())],
            schema=_STATE,
        )


def kept_vectors(vectors: DataFrame) -> DataFrame:
    """State of the vectors that have all ``COMPONENTS`` components, none null or non-finite."""
    values = F.col("embedding").cast("array<double>")
    fit = (F.size("embedding") == COMPONENTS) & ~F.exists(values, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return vectors.filter(fit).select(F.col("vec_id").cast("long").alias("vec_id"), values.alias("embedding")).mapInArrow(_vectors, STATE)


def _rows(batch: pa.RecordBatch) -> np.ndarray:
    column = batch.column(batch.schema.get_field_index("vector"))
    return np.frombuffer(b"".join(column.to_pylist()), "<i8").reshape(batch.num_rows, COMPONENTS)


def assign(rows: np.ndarray, cluster: np.ndarray, upper: np.ndarray, lower: np.ndarray, centres: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Nearest centres (ties: the smaller number), both bounds, and which rows were scanned."""
    rows, centres = _wide(rows), [_wide(c) for c in centres]
    cluster, upper, lower = cluster.copy(), upper.copy(), lower.copy()
    root = lambda d: np.sqrt(d.astype(np.float64))
    for i, c in enumerate(centres):  # bounds that overlap: first the distance to the own centre
        open_ = np.flatnonzero((cluster == i) & ~(upper < lower))
        upper[open_] = root(squared(rows[open_], c)) * (1 + MARGIN)
    scan = np.flatnonzero(~(upper < lower))
    if len(scan):
        all_ = np.stack([squared(rows[scan], c) for c in centres], axis=1)
        best = np.argmin(all_, axis=1)
        cluster[scan] = best
        upper[scan] = root(all_[np.arange(len(scan)), best]) * (1 + MARGIN)
        others = root(all_)
        others[np.arange(len(scan)), best] = np.inf
        lower[scan] = others.min(axis=1) * (1 - MARGIN)
    return cluster, upper, lower, scan


def _round(batches: Iterator[pa.RecordBatch], centres: list[list[int]], drift: list[float], loosen: list[float], last: bool) -> Iterator[pa.RecordBatch]:
    centres, k = [np.array(c, np.int64) for c in centres], len(centres)
    drift, loosen = np.array([*drift, 0.0]), np.array([*loosen, 0.0])  # the last entry is for rows without cluster (-1)
    for batch in batches:
        rows, was = _rows(batch), batch.column(2).to_numpy()
        cluster, upper, lower, scan = assign(rows, was, batch.column(4).to_numpy() + drift[was], batch.column(5).to_numpy() - loosen[was], centres)
        scans = batch.column(6).to_numpy().copy()
        scans[scan] += 1
        distance = pa.nulls(batch.num_rows, pa.int64())
        if last:
            own, wide = np.zeros(batch.num_rows, object), _wide(rows)
            for i in range(k):
                at = np.flatnonzero(cluster == i)
                own[at] = squared(wide[at], _wide(centres[i]))
            distance = pa.array([int(d) if d < 1 << 63 else None for d in own], pa.int64())
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(cluster, pa.int32()), pa.array(was, pa.int32()), pa.array(upper), pa.array(lower), pa.array(scans), distance], schema=_STATE)


def _moves(batches: Iterator[pa.RecordBatch], k: int) -> Iterator[pa.RecordBatch]:
    """What rows that changed their cluster add to the sums of both: ``cluster, part, total``;
    the part after the components is the number of rows. One set of rows a task."""
    total = np.zeros((k + 1, COMPONENTS + 1), object)  # the last row is for no cluster
    for batch in batches:
        rows = _wide(_rows(batch))
        rows = np.concatenate([rows, np.ones((len(rows), 1), rows.dtype)], axis=1)
        for column, sign in ((2, 1), (3, -1)):
            of = batch.column(column).to_numpy()
            for i in np.unique(of).tolist():
                total[i] += sign * rows[of == i].sum(axis=0)
    cluster, part = np.nonzero(total[:k])
    yield pa.RecordBatch.from_arrays([pa.array(cluster, pa.int32()), pa.array(part, pa.int32()), pa.array([str(x) for x in total[cluster, part]])], ["cluster", "part", "total"])


def first_centres(state: DataFrame, k: int, seed: int) -> list[list[int]]:
    """The k vectors of smallest ``sha256('<seed>:<vec_id>')``, in that order (null ids last)."""
    key = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256)
    first = state.select("vector", key.alias("key")).orderBy(F.asc_nulls_last("key"), "vector").limit(k).collect()
    return [np.frombuffer(r["vector"], "<i8").tolist() for r in first]


def cluster_vectors(vectors: DataFrame, k: int = CLUSTERS, rounds: int = ROUNDS, seed: int = SEED) -> DataFrame:
    """``vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256, n_scans`` of
    every row of ``vectors(vec_id, embedding)`` that has all its components.

    ``distance`` is squared; ``n_scans`` tells how often all centroids were looked at for
    the vector, of ``rounds + 1`` times. Rows that repeat a vec_id are vectors of their own;
    a null vec_id stays null and is the last to be a first centroid; with fewer than k
    vectors there are fewer centroids; without any, no rows. A distance (or sum) that no
    long can hold is null; other columns aren't read.
    """
    spark = vectors.sparkSession
    tune(spark)
    state = stored(spark, kept_vectors(vectors), "vectors")
    centres = first_centres(state, k, seed)
    k = len(centres)
    totals = [[0] * (COMPONENTS + 1) for _ in range(k)]
    drift, loosen = [0.0] * k, [0.0] * k
    for turn in range(rounds + 1):
        last = turn == rounds
        before, arguments = state, (centres, drift, loosen, last)
        state = stored(spark, before.mapInArrow(lambda it, a=arguments: _round(it, *a), STATE), "vectors")
        discard(before)
        if last:
            break
        changes = state.filter("cluster <> was").mapInArrow(lambda it: _moves(it, k), "cluster int, part int, total string")
        for r in changes.groupBy("cluster", "part").agg(F.sum(F.col("total").cast("decimal(38,0)")).alias("total")).collect():
            totals[r["cluster"]][r["part"]] += int(r["total"])
        radius = {r["cluster"]: r["upper"] for r in state.groupBy("cluster").agg(F.max("upper").alias("upper")).collect()}
        old = [np.array(c, object) for c in centres]
        centres = [[x // t[-1] for x in t[:-1]] if t[-1] else c for t, c in zip(totals, centres)]
        new = [np.array(c, object) for c in centres]
        drift = [_length(b - a) * (1 + MARGIN) for a, b in zip(old, new)]
        loosen = [max([0.0, *(most_gained(old[i], radius.get(i, 0.0), old[j], new[j]) for j in range(k) if j != i)]) for i in range(k)]
    inertia = F.when(F.max(F.col("distance").isNull()), F.lit(1 << 62).cast("decimal(38,0)") * 2).otherwise(F.sum(F.col("distance").cast("decimal(38,0)")))
    sums = {r["cluster"]: int(r["s"]) for r in state.groupBy("cluster").agg(inertia.alias("s")).collect()}
    long = lambda x: F.lit(x if x < 1 << 63 else None).cast("long")
    digests = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centres]
    at = F.col("cluster") + 1
    pick = lambda values, kind: F.element_at(F.array(*values), at) if values else F.lit(None).cast(kind)
    return state.select(
        "vec_id",
        "cluster",
        "distance",
        pick([long(sums.get(i, 0)) for i in range(k)], "long").alias("cluster_inertia"),
        long(sum(sums.values())).alias("inertia"),
        pick([F.lit(d) for d in digests], "string").alias("centroid_sha256"),
        F.col("scans").cast("long").alias("n_scans"),
    )
