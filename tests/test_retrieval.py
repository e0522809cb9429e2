import math
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from rankframe.operators import dense, fusion, graph, metrics, ranking, rerank, select, sparse

DOCS = [(1, "the cat sat on the mat"), (2, "the dog sat"), (3, ""), (4, "the cat and the dog"), (5, "the !!!"), (6, "the cat sat on the mat"), (7, None)]
ASKED = [(1, "cat cat dog"), (2, "zebra"), (3, "")]
RANKED = "query_id long, doc_id long, rank int, score double"


def rows(df):
    return sorted(tuple(r) for r in df.collect())


@pytest.fixture
def docs(spark):
    return spark.createDataFrame(DOCS, "doc_id long, text string")


@pytest.fixture
def asked(spark):
    return spark.createDataFrame(ASKED, "query_id long, text string")


def words(t):
    return "".join(c if c.isalnum() or c.isspace() else " " for c in (t or "").lower()).split()


def test_bm25_brute_force(docs, asked):
    toks = {i: words(t) for i, t in DOCS}
    n, mean = len(toks), sum(map(len, toks.values())) / len(toks)
    df = Counter(w for t in toks.values() for w in set(t))
    want = []
    for q, text in ASKED:
        for i, t in toks.items():
            s = 0.0
            for w in set(words(text)):
                if tf := t.count(w):
                    s += max(0, math.log((n - df[w] + 0.5) / (df[w] + 0.5))) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * len(t) / mean))
            if round(s, 6) > 0:
                want.append((q, i, round(s, 6)))
    got = sparse.bm25(docs, asked, 10)
    assert sorted((r.query_id, r.doc_id, r.score) for r in got.collect()) == sorted(want)


def test_bm25_padding(docs, asked):
    got = sparse.bm25(docs, asked, 4, pad_zero=True).collect()
    assert Counter(r.query_id for r in got) == {1: 4, 2: 4, 3: 4}
    assert [r.doc_id for r in sorted(got, key=lambda r: r.rank) if r.query_id == 2] == [1, 2, 3, 4]


def test_tfidf_brute_force(docs, asked):
    toks = {i: words(t) for i, t in DOCS}
    n, df = len(toks), Counter(w for t in toks.values() for w in set(t))
    vec = lambda t: {w: c / len(t) * math.log(n / (1 + df[w])) for w, c in Counter(t).items() if w in df}
    norm = lambda v: math.sqrt(sum(x * x for x in v.values())) or 1.0
    want = []
    for q, text in ASKED:
        v = vec(words(text))
        for i, t in toks.items():
            u = vec(t)
            if set(u) & set(v):
                want.append((q, i, round(sum(u[w] * v.get(w, 0) for w in u) / (norm(u) * norm(v)), 6)))
    got = [(r.query_id, r.doc_id, r.score) for r in sparse.tfidf(docs, asked, 10).collect()]
    assert [x[:2] for x in sorted(got)] == [x[:2] for x in sorted(want)]
    assert [x[2] for x in sorted(got)] == pytest.approx([x[2] for x in sorted(want)], abs=2e-6)


def test_dense_blocks(spark, monkeypatch):
    rng = np.random.default_rng(1)
    v = rng.normal(size=(60, 8))
    df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "doc_id long, vec array<double>")
    q = df.filter("doc_id % 20 = 0").withColumnRenamed("doc_id", "query_id")
    monkeypatch.setattr(dense, "BLOCK_NUMBERS", 8)
    got = rows(dense.dense_topk(df, q, 5).select("query_id", "rank", "doc_id"))
    want = []
    for i in (0, 20, 40):
        s = np.round(v @ v[i], 6)
        want += [(i, r + 1, int(d)) for r, d in enumerate(np.lexsort((np.arange(60), -s))[:5])]
    assert got == sorted(want)


@pytest.fixture
def lists(spark):
    a = spark.createDataFrame([(1, 10, 1, 3.0), (1, 11, 2, 2.0), (1, 12, 3, 1.0), (2, 10, 1, 1.0)], RANKED)
    b = spark.createDataFrame([(1, 12, 1, 9.0), (1, 13, 2, 8.0)], RANKED)
    return a, b


def test_round_robin(lists):
    assert rows(fusion.round_robin(*lists, 3)) == [(1, 10, 1, 3.0), (1, 11, 3, 2.0), (1, 12, 2, 9.0)]


def test_rrf(lists):
    got = rows(fusion.rrf(*lists, 2))
    assert [(q, d, r) for q, d, r, _ in got] == [(1, 10, 2), (1, 12, 1), (2, 10, 1)]
    assert got[2][3] == 1.0


def test_metrics_edges(spark):
    ranked = spark.createDataFrame([(1, 5, 1, 1.0), (1, 6, 2, 0.5), (2, 9, 1, 1.0)], RANKED)
    gold = spark.createDataFrame([(1, 6), (1, 6), (1, 7), (2, 1)], "query_id long, doc_id long")
    asked = spark.createDataFrame([(1,), (2,), (3,)], "query_id long")
    got = {r.query_id: r for r in metrics.query_metrics(ranked, gold, asked, 5).collect()}
    assert (got[1].recall_1, got[1].recall_5) == (0.0, 0.5)
    assert got[1].ndcg_5 == pytest.approx((1 / math.log2(3)) / (1 + 1 / math.log2(3)))
    assert got[2].recall_5 == 0 and got[3].ndcg_5 == 0
    assert metrics.accuracy(spark.createDataFrame([], "correct boolean")).first()["accuracy"] == 0


def test_blend_constants(spark):
    cand = spark.createDataFrame([(1, 1, 1, 2.0), (1, 2, 2, 2.0)], RANKED)
    q = spark.createDataFrame([(1, [1.0, 0.0])], "query_id long, vec array<double>")
    centers = spark.createDataFrame([(0, [1.0, 0.0])], "cluster_id long, vec array<double>")
    assignment = spark.createDataFrame([(1, 0), (2, 0)], "doc_id long, cluster_id long")
    got = rows(rerank.cluster_blend(cand, q, assignment, centers, 0.6, 5))
    assert got == [(1, 1, 1, 0.8), (1, 2, 2, 0.8)]


def test_listwise_and_tries(spark, lists):
    said = spark.createDataFrame([(1, "[3] > [1] 3")], "query_id long, text string")
    got = rerank.listwise(lists[0], said)
    assert rows(got.filter("query_id = 1").select("rank", "doc_id")) == [(1, 12), (2, 10), (3, 11)]
    tries = spark.createDataFrame([(1, 1, "9", 6), (1, 2, "1 2", 6), (1, 3, "1 2 3", 6), (2, 1, "1 2", 4)], "query_id long, attempt int, text string, n int")
    assert rows(rerank.best_parse(tries)) == [(1, "1 2 3"), (2, "1 2")]


def test_distractors_alternate(spark, lists):
    gold = spark.createDataFrame([(1, 0, 50)], "query_id long, pos long, doc_id long")
    corpus = spark.createDataFrame([(i,) for i in (10, 11, 12, 13, 50)], "doc_id long")
    got = select.distractors(gold, corpus, *lists, 3).filter("query_id = 1")
    assert sorted(r.doc_id for r in got.collect()) == [10, 11, 12, 50]
    assert rows(got) == rows(select.distractors(gold, corpus, *lists, 3).filter("query_id = 1"))


def test_topk_does_not_refill(spark, lists):
    corpus = spark.createDataFrame([(11,), (12,)], "doc_id long")
    assert rows(select.topk(lists[0], corpus, 2)) == [(1, 1, 11)]


def test_pagerank_against_dense_solution(spark):
    rng = np.random.default_rng(3)
    edges = [(f"n{a}", f"n{b}", float(w)) for a, b, w in zip(rng.integers(0, 8, 14), rng.integers(8, 14, 14), rng.integers(1, 4, 14))]
    reset = [(1, "n0", 1.0), (1, "n9", 3.0), (1, "lonely", 1.0), (2, "n1", 0.0), (2, "n2", -1.0)]
    names = sorted({x for e in edges for x in e[:2]} | {"lonely", "n0", "n9"})
    at = {n: i for i, n in enumerate(names)}
    w = np.zeros((len(names),) * 2)
    for a, b, x in edges:
        w[at[a], at[b]] += x
        w[at[b], at[a]] += x
    r = np.zeros(len(names))
    for q, n, x in reset[:3]:
        r[at[n]] += x
    r /= r.sum()
    total = w.sum(axis=1)
    step = np.divide(w, total[:, None], out=np.zeros_like(w), where=total[:, None] > 0)
    x = r.copy()
    for _ in range(40):
        x = 0.5 * r + 0.5 * (x @ step + x[total == 0].sum() * r)
    got = graph.pagerank(spark.createDataFrame(edges, "src string, dst string, weight double"), spark.createDataFrame(reset, "query_id long, id string, weight double"), iterations=20)
    have = {row.id: row.score for row in got.collect() if row.query_id == 1}
    assert have == pytest.approx({n: x[at[n]] for n in have}, abs=1e-5)
    assert got.filter("query_id = 2").count() == 0


def test_propagation_modes(spark):
    seeds = spark.createDataFrame([(1, "a", 1.0)], "query_id long, entity_id string, score double")
    mention = spark.createDataFrame([("a", "s1"), ("b", "s1"), ("b", "s2"), ("c", "s2")], "entity_id string, sentence_id string")
    sim = spark.createDataFrame([(1, "s1", 0.9), (1, "s2", 0.8)], "query_id long, sentence_id string, sim double")
    got = {r.entity_id: (round(r.score, 6), round(r["last"], 6), r.tier) for r in graph.propagate(seeds, mention, sim).collect()}
    assert got == {"a": (1.9, 0.9, 1), "b": (1.62, 0.72, 2), "c": (0.72, 0.72, 2)}
    ordered = {r.entity_id: (round(r["last"], 6), r.tier) for r in graph.propagate_in_order(seeds, mention, sim).collect()}
    assert ordered == {"a": (0.9, 2), "b": (0.72, 3), "c": (0.72, 3)}


def test_adjacency_with_gaps(spark):
    d = spark.createDataFrame([(i, "x") for i in (1, 2, 3, 7, 9, 10)], "doc_id long, text string")
    assert [r[:2] for r in rows(graph.adjacency_edges(d))] == [(1, 2), (2, 3), (3, 7), (7, 9), (9, 10)]


def test_min_max_constant(spark):
    df = spark.createDataFrame([(1, 2.0), (1, 2.0), (2, 0.0), (2, 4.0)], "q int, x double")
    assert rows(df.select("q", ranking.min_max("x", ["q"], 0.5).alias("y"))) == [(1, 0.5), (1, 0.5), (2, 0.0), (2, 1.0)]


def test_nearest_in_blocks_of_centres(spark, monkeypatch):
    rng = np.random.default_rng(4)
    centers = rng.integers(-2, 3, (13, 3)).astype(float)  # with equal ones
    vectors = rng.integers(-3, 4, (60, 3)).astype(float)
    docs = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(vectors)], "doc_id long, vec array<double>")
    given = spark.createDataFrame([(i, c.tolist()) for i, c in enumerate(centers)], "cluster_id long, vec array<double>")
    want = sorted((i, int((v @ centers.T).argmax()), float((v @ centers.T).max())) for i, v in enumerate(vectors))
    for numbers in (1000, 12, 3):
        monkeypatch.setattr(dense, "CENTER_NUMBERS", numbers)
        assert rows(dense.nearest(docs, given)) == want
