import numpy as np
import pytest
from pyspark.sql import functions as F

from rankframe.operators import dense, ivf, rerank


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def frame(spark, x, name):
    return spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], f"{name} long, vec array<double>")


@pytest.mark.parametrize("spread, chunk", [(0.05, 20_000), (0.3, 7), (5.0, 20_000)])
def test_equal_to_a_full_scan(spark, monkeypatch, spread, chunk):
    monkeypatch.setattr(ivf, "CHUNK", chunk)
    rng = np.random.default_rng(int(spread * 100))
    middle = rng.normal(size=(9, 16))
    x = middle[rng.integers(0, 9, 700)] + spread * rng.normal(size=(700, 16))
    x[::50] = x[7]  # ties
    x[13], x[14] = 0, x[14] * 30  # no length, and a great one
    q = np.concatenate([x[:6] * 2, -x[6:8], np.zeros((1, 16)), rng.normal(size=(3, 16))])
    docs, asked = frame(spark, x, "doc_id"), frame(spark, q, "query_id")
    index = ivf.build(docs, rerank.fit_clusters(docs, 9))
    found, read = ivf.search(index, asked, 5)
    assert rows(found) == rows(dense.dense_topk(docs, asked, 5))
    share = read.agg(F.sum("n_scored") / F.sum("n_all")).head()[0]
    print(f"scored {share:.2f}")
    assert share <= 1 and (spread > 0.1 or share < 0.5)


def test_few_rows_and_empty_tables(spark):
    x = np.eye(3)
    docs, asked = frame(spark, x, "doc_id"), frame(spark, x[:2], "query_id")
    index = ivf.build(docs, rerank.fit_clusters(docs, 2))
    assert rows(ivf.search(index, asked, 10)[0]) == rows(dense.dense_topk(docs, asked, 10))
    assert ivf.search(index, asked.limit(0), 10)[0].count() == 0
    assert ivf.search(ivf.build(docs.limit(0), index.centers), asked, 10)[0].count() == 0
