"""Vector search in tiles: the same rankings, and bounded in what a task holds."""

import tracemalloc

import numpy as np
import pandas as pd
import pytest

from rankframe.operators import dense
from rankframe.operators.ranking import PLACES


def _plain(batches, ids, matrix, k):
    rows = pd.concat(batches)
    scores = np.round(matrix @ np.stack(rows["vec"].to_numpy()).astype(np.float64).T, PLACES)
    every = pd.DataFrame({"query_id": np.repeat(ids, len(rows)), "doc_id": np.tile(rows["doc_id"].to_numpy(), len(ids)), "score": scores.ravel()})
    return every.sort_values(["query_id", "score", "doc_id"], ascending=[True, False, True]).groupby("query_id").head(k).reset_index(drop=True)


def _batches(rng, n, of, copies):
    vec = rng.normal(size=(n, 4)).astype(np.float32)
    vec[rng.random(n) < copies] = vec[0]
    ids = rng.permutation(n)
    return [pd.DataFrame({"doc_id": ids[a : a + of], "vec": list(vec[a : a + of])}) for a in range(0, n, of)]


@pytest.mark.parametrize("k", [1, 3, 10, 30])
@pytest.mark.parametrize("copies", [0.0, 0.5, 1.0])
def test_tiles_give_the_plain_ranking(monkeypatch, k, copies):
    monkeypatch.setattr(dense, "TILE_SCORES", 700)
    monkeypatch.setattr(dense, "TILE_ROWS", 40)
    rng = np.random.default_rng(k)
    for n in (1, 5, 333):
        batches, ids, matrix = _batches(rng, n, 90, copies), np.arange(0, 230, 10), rng.normal(size=(23, 4))
        got = pd.concat(dense._best(iter(batches), ids, matrix, k)).sort_values(["query_id", "score", "doc_id"], ascending=[True, False, True]).reset_index(drop=True)
        assert got.equals(_plain(batches, ids, matrix, k))


@pytest.mark.parametrize("work", [lambda *a: dense._best(*a, 10), dense._ends, lambda *a: dense._every(*a, PLACES)])
def test_what_a_task_holds_is_bounded(work):
    """4,000 queries by a batch of 5,000 rows: 160 MB of scores alone if taken at once."""
    rng = np.random.default_rng(1)
    batch = pd.DataFrame({"doc_id": np.arange(5000), "vec": list(rng.normal(size=(5000, 8)).astype(np.float32))})
    ids, matrix = np.arange(4000), rng.normal(size=(4000, 8))
    tracemalloc.start()
    rows = sum(len(part) for part in work(iter([batch]), ids, matrix))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert rows in (40_000, 4000, 20_000_000) and peak < 120e6


def test_scores_that_are_not_a_number_come_first():
    batch = pd.DataFrame({"doc_id": np.arange(60), "vec": [np.array([np.nan if i in (7, 50) else i / 7]) for i in range(60)]})
    for k in (1, 2, 5):
        got = pd.concat(dense._best(iter([batch, batch.assign(doc_id=batch["doc_id"] + 100)]), np.array([1]), np.ones((1, 1)), k))
        assert got["doc_id"].tolist() == [7, 50, 107, 150, 59][:k]
