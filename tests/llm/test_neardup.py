import numpy as np
import pytest

pytest.importorskip("rankframe.llm")

import corpus_pipeline
from rankframe.llm import common, components, neardup

SCHEMA = "doc_id long, text string"


def kept_brute(rows):
    def shingle(t):
        w = (t or "").lower().split()
        return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))}

    sets = [shingle(t) for _, t in rows]
    pairs = [(i, j) for i, a in enumerate(sets) for j, b in enumerate(sets) if i < j and len(a & b) >= 0.8 * len(a | b)]
    root = components.local_roots(len(rows), *np.array(pairs).T)
    return sorted(min((k for r, (k, _) in zip(root, rows) if r == x and k is not None), default=-1) for x in set(root.tolist()))


@pytest.mark.parametrize("side", [256, 2])
def test_near_copies_of_five_word_shingles(spark, monkeypatch, side):
    monkeypatch.setattr(neardup, "SIDE", side)
    monkeypatch.setattr(neardup, "STAR_ROUNDS", 4 if side > 2 else 1)
    monkeypatch.setattr(neardup, "FOLLOWERS", 1000 if side > 2 else 2)
    monkeypatch.setattr(common, "ONE_TASK", 500_000 if side > 2 else 0)
    rng = np.random.default_rng(6)
    vocabulary = [f"w{i}" for i in range(500)]
    rows = [(1, None), (2, ""), (3, " \n "), (4, "a b"), (5, "A  B"), (6, "a c"), (6, "quite another text under one id"), (7, "É é"), (8, "é É")]
    for k in range(25):
        words = rng.choice(vocabulary, 120).tolist()
        for j in range(6):  # a chain: neighbours are near copies, its ends are not
            rows.append((100 + 10 * k + j, " ".join(words)))
            for at in rng.choice(120, int(rng.integers(1, 4)), False):
                words[int(at)] = f"c{rng.integers(10**6)}"
    df = spark.createDataFrame(rows, SCHEMA)
    got = sorted(r.doc_id for r in corpus_pipeline.near_duplicates(spark, df, "").collect())
    assert got == kept_brute(rows)
    twice = neardup.keep_one(spark.createDataFrame([(None, "one text"), (None, "two texts"), (3, "x"), (3, "x")], SCHEMA))
    assert sorted(r.text for r in twice.collect()) == ["one text", "two texts", "x"]


def test_words_that_collide_in_polynomial_hashes_stay_apart(spark):
    a = "a"
    for _ in range(10):
        a += a.translate(str.maketrans("ab", "ba"))
    b = a.translate(str.maketrans("ab", "ba"))
    rows = [(1, " ".join([a] * 8)), (2, " ".join([b] * 8)), (3, "other words in a third text"), (4, f"{a} x {a}"), (5, f"{b} x {b}")]
    assert sorted(r.doc_id for r in neardup.keep_one(spark.createDataFrame(rows, SCHEMA)).collect()) == [1, 2, 3, 4, 5]


def test_digests_and_hashes_of_words():
    texts = [b"", b" \n", b"a b", b" a \t b\n", b"ab", b"a", b"b a", b"word " * 40, b" \xc3\xa9" * 3, b"x" * 100 + b" y"]
    data, offsets = np.frombuffer(b"".join(texts), np.uint8), np.concatenate([[0], np.cumsum([len(t) for t in texts])])
    got = neardup.word_digests(data, offsets)
    want = [neardup.hashlib.blake2b(b" ".join(t.split()), digest_size=16).digest() for t in texts]
    assert got == want
    words = [b"a", b"b", b"a\0", b"abcdefgh", b"abcdefgh\0", b"abcdefghi", b"abcdefgi" * 3, b"abcdefgi" * 4, b"a"]
    data, end = np.frombuffer(b"".join(words), np.uint8), np.cumsum([len(w) for w in words])
    h = neardup.word_hashes(data, end - [len(w) for w in words], end)
    assert len(set(h.tolist())) == 8 and h[0] == h[-1]
    assert len(neardup.word_hashes(data, end[:0], end[:0])) == 0


def test_large_group_and_repeated_rows(spark):
    rng = np.random.default_rng(3)
    base = rng.choice([f"v{i}" for i in range(300)], 100).tolist()
    rows = []
    for k in range(600):  # one group of near copies of one text
        words = list(base)
        words[int(rng.integers(100))] = f"u{rng.integers(50)}"
        rows.append((1000 + k, " ".join(words)))
    rows += [(5, "one row three times over, word for word")] * 3 + [(4, "one row three times over,  word for word")]
    out = neardup.keep_one(spark.createDataFrame(rows, SCHEMA).withColumn("node", common.F.lit(1)).repartition(5))
    assert sorted(r.doc_id for r in out.collect()) == kept_brute(rows)
    assert out.columns == ["doc_id", "text", "node"]


def test_components_and_fingerprints_with_hot_keys_split(spark, monkeypatch):
    from rankframe.llm import simhash

    rng = np.random.default_rng(9)
    edges = [(0, int(k)) for k in range(1, 3000)] + [(int(a), int(b)) for a, b in rng.integers(3000, 9000, (3000, 2))]  # a hub and chains
    rows = [(k, f"text {k % 7} of the group") for k in range(400)]
    got = {}
    for limit in (0, 500_000):
        monkeypatch.setattr(common, "ONE_TASK", limit)
        roots = components.components(spark.createDataFrame(edges, "u long, v long"))
        prints = simhash.near_duplicates(spark.createDataFrame(rows, SCHEMA))
        got[limit] = sorted(map(tuple, roots.collect())), sorted(map(tuple, prints.collect()))
    assert got[0] == got[500_000]
    want = components.local_roots(9000, *np.array(edges).T)
    assert all(want[node] == root for node, root in got[0][0]) and len({r.doc_id for r in spark.createDataFrame(rows, SCHEMA).collect()}) == len(got[0][1])


def test_fingerprints_are_the_first_link(spark):
    rng = np.random.default_rng(12)
    rows = []
    for k in range(30):
        words = rng.choice([f"w{i}" for i in range(900)], 400).tolist()
        for j in range(4):  # near copies of long texts: most differ in a few bits
            rows.append((10 * k + j, " ".join(words)))
            words[int(rng.integers(400))] = f"c{rng.integers(10**6)}"
    df = spark.createDataFrame(rows, SCHEMA).select("doc_id", common.F.lit(b"").alias("tk"), "text").repartition(3)
    nodes = df.mapInArrow(neardup._prints, "doc_id long, tk binary, digest binary, fp long, bands array<long>")
    nodes = common.stored(spark, nodes.select(common.F.col("doc_id").alias("node"), "fp"), "test-nodes")
    fp = {r.node: np.array(r.fp).view(np.uint64) for r in nodes.collect()}
    members = common.stored(spark, neardup.simhash_buckets(nodes).withColumn("first", common.F.lit(True)), "test-members")
    buckets = {}
    for r in members.collect():
        buckets.setdefault(r.node, set()).add(r.bucket)
    close = {(a, b) for a in fp for b in fp if a < b and np.bitwise_count(fp[a] ^ fp[b]) <= 3}
    assert len(close) > 60 and all(buckets[a] & buckets[b] for a, b in close)
    assert all(a // 10 == b // 10 for a in fp for b in fp if buckets[a] & buckets[b])
    sets = common.stored(spark, df.select(common.F.col("doc_id").alias("node"), "text").mapInArrow(neardup._sets, "node long, size long, hashes binary"), "test-sets")
    labels, between = neardup.links(members, sets)
    ids = sorted(fp)
    at = {k: i for i, k in enumerate(ids)}
    pairs = [(at[r.node], at[r.root]) for r in labels.collect()] + [(at[r.u], at[r.v]) for r in between.collect()]
    got = components.local_roots(len(ids), *np.array(pairs).T)
    want = components.local_roots(len(ids), *np.array([(at[a], at[b]) for a, b in close]).T)  # all of them reach the threshold
    joined = [(a, b) for a in ids for b in ids if a < b and want[at[a]] == want[at[b]]]
    assert all(got[at[a]] == got[at[b]] for a, b in joined)
