import hashlib
import math
import random

import numpy as np
import pytest

pytest.importorskip("rankframe.llm")

from rankframe.llm import centroids
from rankframe.llm.queries import op11_centroid_clustering

SCHEMA = "vec_id long, embedding array<double>, cluster string"


def plain(rows, k=8, rounds=10):
    """Every vector against every centroid in every round, in Python's integers."""
    rows = [(i, [math.floor(1024.0 * x) for x in v]) for i, v in rows if v is not None and len(v) == 64 and all(x is not None and math.isfinite(x) for x in v)]
    key = lambda r: (r[0] is None, hashlib.sha256(f"3:{r[0]}".encode()).hexdigest(), np.array(r[1], "<i8").tobytes())
    centres = [v for _, v in sorted(rows, key=key)[:k]]
    gap = lambda v, c: sum((x - y) ** 2 for x, y in zip(v, c))
    near = lambda: [min((gap(v, c), j) for j, c in enumerate(centres)) for _, v in rows]
    for _ in range(rounds):
        members = {}
        for (_, v), (_, j) in zip(rows, near()):
            members.setdefault(j, []).append(v)
        centres = [[sum(x) // len(members[j]) for x in zip(*members[j])] if j in members else c for j, c in enumerate(centres)]
    found = near()
    of = [sum(d for d, i in found if i == j) for j in range(len(centres))]
    digest = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centres]
    long = lambda x: x if x < 1 << 63 else None
    return sorted(((i, j, long(d), long(of[j]), long(sum(of)), digest[j]) for (i, _), (d, j) in zip(rows, found)), key=str)


def got(df):
    return sorted((tuple(r)[:6] for r in df.collect()), key=str)


def made(n, seed, spread=1.0, grid=None):
    rng = random.Random(seed)
    middle = [[rng.gauss(0, 1) for _ in range(64)] for _ in range(5)]
    value = lambda m: rng.choice(grid) if grid else rng.gauss(m, spread)
    return [(i, [value(m) for m in rng.choice(middle)]) for i in range(n)]


@pytest.mark.parametrize("rows", [made(400, 1), made(300, 2, 0.1), made(200, 3, grid=[0.0, 0.001]), made(60, 4, grid=[1e5, -3e5, 0.0]), made(5, 5)])
def test_same_as_full_scans(spark, rows):
    table = spark.createDataFrame([(i, v, "clash") for i, v in rows], SCHEMA).repartition(3)
    assert got(centroids.cluster_vectors(table)) == plain(rows)


def test_odd_rows(spark):
    base = made(30, 6)
    v = base[0][1]
    rows = base + [(0, v), (7, v), (None, v), (100, None), (101, v[:63]), (102, v + [1.0]), (103, [None] + v[1:]), (104, [float("nan")] + v[1:]), (105, [float("inf")] + v[1:]), (106, [-0.0001] * 64), (-5, [0.0] * 64)]
    assert got(centroids.cluster_vectors(spark.createDataFrame([(i, v, "x") for i, v in rows], SCHEMA))) == plain(rows)
    assert centroids.cluster_vectors(spark.createDataFrame([], SCHEMA)).count() == 0
    assert centroids.cluster_vectors(spark.createDataFrame([(1, None, "x")], SCHEMA)).count() == 0


def test_whole_table(spark):
    rows = [tuple(r) for r in spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet").select("vec_id", "embedding").collect()]
    assert got(op11_centroid_clustering(spark, "/root/testdata/sf0.01")) == plain(rows)
    out = centroids.cluster_vectors(spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet"))
    assert out.agg(centroids.F.avg("n_scans")).head()[0] < 8  # of 11: bounds spare the rest


def test_planar_bound():
    rng = np.random.default_rng(0)
    tighter = 0
    for _ in range(300):
        d = int(rng.integers(2, 6))
        centre, a, b = (rng.integers(-1000, 1000, d).astype(object) for _ in range(3))
        if rng.random() < 0.5:
            b = a + rng.integers(-20, 20, d)
        radius = float(rng.random() * 800)
        x = rng.normal(size=(500, d))
        x = centre.astype(float) + x / np.linalg.norm(x, axis=1, keepdims=True) * radius * rng.random((500, 1)) ** (1 / d)
        gain = (np.linalg.norm(x - a.astype(float), axis=1) - np.linalg.norm(x - b.astype(float), axis=1)).max()
        bound = centroids.most_gained(centre, radius, a, b)
        assert gain <= bound + 1e-9
        tighter += bound < 0.9 * centroids._length(b - a)
    assert tighter > 100
