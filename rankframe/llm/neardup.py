"""Near copies by the similarity of their word shingles.

Two texts are near copies if the Jaccard similarity of their sets of ``SHINGLE`` words is
at least ``SIMILAR``. Texts equal word for word are one node, told by a 128-bit digest of
their words' bytes.

Nodes get SimHash fingerprints of their shingles, and those within 3 bits are brought
together by balls that meet in the middle (``simhash.links``). Near copies at the threshold
differ in some ten bits, so nodes that this leaves apart are candidates as well where they
share a band of ``ROWS`` MinHash values; a pair at the threshold shares none of ``BANDS``
bands with a chance of ``(1 - 0.8**4)**32``, under one in ten million. Every link is verified
on the whole sets.

In each of ``STAR_ROUNDS`` rounds, the first over the buckets of fingerprints alone, a node is
held against one leader of its buckets: sets travel to the task of the leader, whose own set
is there once for every ``FOLLOWERS`` of them. Buckets that still hold several components
are then cut by size of set (sets of similar nodes differ by a quarter at most) and all their
pairs of different components are compared, in blocks of nodes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from rankframe.llm import simhash
from rankframe.llm.common import BLANK, as_bytes, discard, join_hot, mix, slices, stored, tune, word_bounds
from rankframe.llm.components import components, local_roots

SHINGLE, SIMILAR = 5, 0.8
BANDS, ROWS = 32, 4
STAR_ROUNDS = 3
#: Nodes that are held against one copy of a leader's set.
FOLLOWERS = 1000
#: Nodes on each side of a block of pairs.
SIDE = 256

_RNG = np.random.default_rng(42)
_LOW, _HIGH = (_RNG.integers(0, 1 << 32, BANDS * ROWS, np.uint64).astype(np.uint32) | np.uint32(1) for _ in range(2))


def word_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hashes of words: each eight bytes of a word are mixed into what the bytes
    before gave, by steps that no two inputs share, so words of up to eight bytes never
    have one hash."""
    wide = np.concatenate([data, np.zeros(8, np.uint8)]).astype(np.uint64)
    eight = wide[: len(data)].copy()
    for k in range(1, 8):
        eight |= wide[k : len(data) + k] << np.uint64(8 * k)
    size = end - start
    h, open_, at = mix(size.astype(np.uint64) + np.uint64(1)), np.arange(len(start)), 0
    while len(open_):
        left = np.minimum(size[open_] - at, 8)
        own = eight[start[open_] + at] & (np.uint64(0xFFFFFFFFFFFFFFFF) >> (np.uint64(64) - (left * 8).astype(np.uint64)))
        h[open_] = mix(h[open_] ^ own) + np.uint64(0x9E3779B97F4A7C15)
        at += 8
        open_ = open_[size[open_] > at]
    return h


def word_digests(data: np.ndarray, offsets: np.ndarray) -> list[bytes]:
    """128-bit digests of the rows' words, joined by single spaces."""
    inside = ~BLANK[data]
    row = np.zeros(len(data), bool)
    row[offsets[:-1][offsets[:-1] < len(data)]] = True
    after = np.zeros(len(data), bool)  # the first blank after a word of the same row
    after[1:] = ~inside[1:] & inside[:-1] & ~row[1:]
    keep = inside | after
    text = np.where(inside, data, 32).astype(np.uint8)[keep].tobytes()
    at = np.concatenate([np.zeros(1, np.int64), np.cumsum(keep)])[offsets].tolist()
    return [hashlib.blake2b(text[a:b].rstrip(b" "), digest_size=16).digest() for a, b in zip(at, at[1:])]


def shingles(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Shingle hashes of the rows of a slice in order, and the n+1 places where rows begin
    among them. A row of fewer than ``SHINGLE`` words is one shingle."""
    n = len(offsets) - 1
    start, end, row = word_bounds(data, offsets)
    h = word_hashes(data, start, end)
    first = np.searchsorted(row, np.arange(n + 1))
    count = np.diff(first)
    many = np.where(count >= SHINGLE, count - SHINGLE + 1, np.minimum(count, 1))
    cut = np.concatenate([[0], np.cumsum(many)])
    owner = np.repeat(np.arange(n), many)
    at = first[owner] + np.arange(cut[-1]) - cut[owner]
    size = np.minimum(count[owner], SHINGLE)
    key = size.astype(np.uint64)
    for j in range(SHINGLE):
        more = j < size
        key = np.where(more, mix(key ^ h[np.where(more, at + j, 0)]), key) if len(key) else key
    return key, cut


def bands(key: np.ndarray, cut: np.ndarray) -> np.ndarray:
    """Band hashes of each row, ``BANDS`` to a row (rows without shingles: any value)."""
    n = len(cut) - 1
    out = np.zeros((n, BANDS), np.uint64)
    some = np.flatnonzero(np.diff(cut))
    if not len(some):
        return out
    low, high = key.astype(np.uint32), (key >> np.uint64(32)).astype(np.uint32)
    for b in range(BANDS):
        x = np.full(len(some), np.uint64(b + 1))
        for k in range(b * ROWS, (b + 1) * ROWS):
            x = mix(x ^ np.minimum.reduceat(low * _LOW[k] + high * _HIGH[k], cut[:-1][some]).astype(np.uint64))
        out[some, b] = x
    return out


def fingerprints(key: np.ndarray, cut: np.ndarray) -> list[int]:
    """SimHash fingerprint of each row's different shingles, as a signed 64-bit integer."""
    return [simhash.fingerprint(np.unique(key[s:e])) if e > s else 0 for s, e in zip(cut, cut[1:])]


def _prints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        data, offsets = as_bytes(batch.column(2))
        digests, fps, found = [], [], [np.zeros((0, BANDS), np.int64)]
        for a, b in slices(offsets):
            part, at = data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]
            digests += word_digests(part, at)
            key, cut = shingles(part, at)
            fps += fingerprints(key, cut)
            found.append(bands(key, cut).view(np.int64))
        flat = np.concatenate(found)
        lists = pa.ListArray.from_arrays(pa.array(np.arange(len(flat) + 1, dtype=np.int32) * BANDS), pa.array(flat.ravel()))
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(digests, pa.binary()), pa.array(fps, pa.int64()), lists], ["doc_id", "tk", "digest", "fp", "bands"])


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        data, offsets = as_bytes(batch.column(1))
        out = []
        for a, b in slices(offsets):
            key, cut = shingles(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
            out += [np.unique(key[s:e]).tobytes() for s, e in zip(cut, cut[1:])]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(x) // 8 for x in out], pa.int64()), pa.array(out, pa.binary())], ["node", "size", "hashes"])


def similar(a: np.ndarray, b: np.ndarray) -> bool:
    """Whether two sorted sets reach the threshold."""
    if min(len(a), len(b)) < SIMILAR * max(len(a), len(b)):
        return False
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both >= SIMILAR * (len(a) + len(b) - both)


def _led(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links of rows ``u, salt, node, hashes`` in order, each leader's own row before its
    followers'."""
    lead, own = None, np.zeros(0, np.uint64)
    for batch in batches:
        us, vs = [], []
        for u, node, hashes in zip(*[batch.column(c).to_pylist() for c in (0, 3, 4)]):
            mine = np.frombuffer(hashes, np.uint64)
            if u == node:
                lead, own = u, mine
            elif u == lead and similar(own, mine):
                us.append(u)
                vs.append(node)
        yield pa.RecordBatch.from_arrays([pa.array(us, pa.int64()), pa.array(vs, pa.int64())], ["u", "v"])


def _held_against_leaders(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The similar ones of ``pairs(u, v)``; a leader u with many followers is in several tasks."""
    spark = pairs.sparkSession
    size = lambda c: sets.select(F.col("node").alias(c), F.col("size").alias(f"{c}_size"))
    near = pairs.join(size("u"), "u").join(size("v"), "v").filter(F.least("u_size", "v_size") >= SIMILAR * F.greatest("u_size", "v_size"))
    near = stored(spark, near.select("u", "v"), "near-pairs")
    many = near.groupBy("u").agg(F.ceil(F.count("*") / FOLLOWERS).cast("int").alias("tasks"))
    followers = near.join(many, "u").select("u", F.pmod(F.xxhash64("v"), F.col("tasks")).cast("int").alias("salt"), F.lit(1).alias("side"), F.col("v").alias("node"))
    leaders = many.select("u", F.explode(F.expr("sequence(0, tasks - 1)")).alias("salt"), F.lit(0).alias("side"), F.col("u").alias("node"))
    rows = followers.unionByName(leaders).join(sets.select("node", "hashes"), "node").select("u", "salt", "side", "node", "hashes")
    rows = rows.repartition("u", "salt").sortWithinPartitions("u", "salt", "side")
    out = stored(spark, rows.mapInArrow(_led, "u long, v long"), "near-links")
    discard(near)
    return out


def _join_block(rows: pd.DataFrame) -> pd.DataFrame:
    """Links of a block between nodes of different components: a spanning forest."""
    left, right = np.flatnonzero(rows["side"] == 0), np.flatnonzero(rows["side"] == 1)
    node, sets = rows["node"].to_numpy(), [np.frombuffer(x, np.uint64) for x in rows["hashes"]]
    label = np.unique(rows["root"].to_numpy(), return_inverse=True)[1]
    n = label.max() + 1
    up, links = np.arange(n), []
    for i in left.tolist():
        for j in right.tolist():
            if up[label[i]] != up[label[j]] and similar(sets[i], sets[j]):
                links.append((node[i], node[j]))
                up = local_roots(n, label[[i]], label[[j]], up)
    return pd.DataFrame(links, columns=["u", "v"]).astype("int64")


def _merged(labels: DataFrame, found: DataFrame) -> DataFrame:
    """``node, root`` after links ``found(u, v)``: each root takes the least root that it is
    linked with, and that one's in turn, three times. Nodes with one root are connected;
    connected nodes may still have two, which costs comparisons, not links."""
    of = lambda c: labels.select(F.col("node").alias(c), F.col("root").alias(f"{c}_root"))
    pairs = found.join(of("u"), "u").join(of("v"), "v").filter("u_root <> v_root")
    up = pairs.groupBy(F.greatest("u_root", "v_root").alias("root")).agg(F.min(F.least("u_root", "v_root")).alias("to"))
    up = stored(labels.sparkSession, up, "near-up")
    to = up
    for k in range(3):
        nxt = up.select(F.col("root").alias("to"), F.col("to").alias("nxt"))
        to = to.join(nxt, "to", "left").select("root", F.coalesce("nxt", "to").alias("to"))
    out = stored(labels.sparkSession, labels.join(to, "root", "left").select("node", F.coalesce("to", "root").alias("root")), "near-labels")
    discard(up)
    return out


def _open_buckets(members: DataFrame, labels: DataFrame, k: int) -> DataFrame:
    """``bucket, node, root`` of the buckets of ``members`` with several roots after round ``k``.
    Buckets of two nodes are left out once their pair has been compared."""
    now = members.join(labels, "node")
    several = now.groupBy("bucket").agg(F.min("root").alias("x"), F.max("root").alias("y"), F.count("*").alias("n"), F.max("first").alias("first"))
    several = several.filter("x <> y").filter("n > 2" if k else "n > 2 or not first").select("bucket")
    return stored(members.sparkSession, now.join(several, "bucket").select("bucket", "node", "root"), "near-rest")


def _blocks(rest: DataFrame, sizes: DataFrame) -> DataFrame:
    """``bucket, class, k, l, side, node, root``: blocks of all pairs of different components
    that can be similar.

    A node is in its size class and the next (classes grow by a quarter), so similar ones
    meet in one. There the nodes outside the largest component make one side, all nodes the
    other.
    """
    own = F.floor(F.log("size") / F.log(F.lit(1 / SIMILAR)))
    rest = rest.join(sizes, "node").select("bucket", "node", "root", F.explode(F.array(own, own + 1)).alias("class"))
    whole = ["bucket", "class"]
    roots = rest.groupBy(*whole, "root").agg(F.count("*").alias("n"), *[F.sum(F.xxhash64("node", F.lit(i)).cast("decimal(38,0)")).alias(f"m{i}") for i in (0, 1)])
    cells = roots.groupBy(*whole).agg(F.max(F.struct("n", "root")).alias("main"), F.sum("n").alias("n_all"), F.count("*").alias("n_roots"), F.sum("m0").alias("m0"), F.sum("m1").alias("m1")).filter("n_roots > 1")
    # cells with the same nodes count once
    cells = cells.groupBy("n_all", "m0", "m1").agg(F.min(F.struct(*whole, "main")).alias("c"))
    cells = cells.select("c.bucket", "c.class", F.col("c.main.root").alias("main"), F.ceil((F.col("n_all") - F.col("c.main.n")) / SIDE).cast("int").alias("nk"), F.ceil(F.col("n_all") / SIDE).cast("int").alias("nl"))
    rest = rest.join(cells, whole)
    # dealt by hash, not by rank: a block has about SIDE nodes
    k, l = F.pmod(F.xxhash64("node"), F.col("nk")).cast("int"), F.pmod(F.xxhash64("node"), F.col("nl")).cast("int")
    first = rest.filter("root <> main").select(*whole, k.alias("k"), F.explode(F.expr("sequence(0, nl - 1)")).alias("l"), F.lit(0).alias("side"), "node", "root")
    second = rest.select(*whole, F.explode(F.expr("sequence(0, nk - 1)")).alias("k"), l.alias("l"), F.lit(1).alias("side"), "node", "root")
    return first.union(second)


def simhash_buckets(nodes: DataFrame) -> DataFrame:
    """``bucket, node`` of the written table ``nodes(node, fp)``: any two nodes whose fingerprints
    are within 3 bits share a bucket, named by a fingerprint that both were linked with."""
    spark = nodes.sparkSession
    distinct = stored(spark, nodes.groupBy("fp").agg(F.count("*").alias("n")), "near-fp")
    found = simhash.links(distinct.select("fp"), distinct.count()).groupBy(F.col("u").alias("fp")).agg(F.collect_set("v").alias("with"))
    own = F.array("fp")
    of = distinct.join(found, "fp", "left").select("fp", "n", F.when(F.col("with").isNull(), own).otherwise(F.concat("with", own)).alias("buckets"))
    of = stored(spark, of, "near-balls")
    discard(distinct)
    return join_hot(nodes.select("node", "fp"), of, ["fp"], "n").select(F.explode("buckets").alias("bucket"), "node")


def links(members: DataFrame, sets: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``node, root`` and edges ``u, v`` between roots that together connect all similar
    nodes of ``members(bucket, node, first)``, where ``first`` marks the buckets of the first
    round; ``sets(node, size, hashes)``. Both are written tables."""
    spark = members.sparkSession
    rest, edges = members.filter("first").select("bucket", "node", F.col("node").alias("root")), None
    labels = members.select("node", F.col("node").alias("root")).distinct()
    for k in range(STAR_ROUNDS):
        order = F.struct(F.xxhash64("node", F.lit(k)).alias("h"), "node", "root")
        lead = rest.groupBy("bucket").agg(F.min(order).alias("m"), F.min("node").alias("u"), F.max("node").alias("v"), F.count("*").alias("n"))
        led = rest.join(lead.filter("n > 2").select("bucket", "m"), "bucket").filter("root <> m.root").groupBy(F.col("node").alias("v")).agg(F.min(F.struct("m.h", "m.node")).alias("m")).select(F.col("m.node").alias("u"), "v")
        # pairs are compared in the first round that has their bucket
        found = _held_against_leaders(led if k > 1 else lead.filter("n = 2").select("u", "v").distinct().union(led), sets)
        edges = found if edges is None else edges.union(found)
        labels, old = _merged(labels, found), labels
        before, rest = rest, _open_buckets(members, labels, k)
        if k:
            discard(before, old)
        if rest.isEmpty():
            break
    else:
        blocks = _blocks(rest, sets.select("node", "size")).join(sets.select("node", "hashes"), "node")
        edges = edges.union(stored(spark, blocks.groupBy("bucket", "class", "k", "l").applyInPandas(_join_block, "u long, v long"), "near-links"))
    discard(rest)
    of = lambda c: labels.select(F.col("node").alias(c), F.col("root").alias(f"{c}_root"))
    between = edges.join(of("u"), "u").join(of("v"), "v").filter("u_root <> v_root").select(F.col("u_root").alias("u"), F.col("v_root").alias("v"))
    return labels, between


def keep_one(docs: DataFrame) -> DataFrame:
    """All columns of one row of each group of near copies: the one whose doc_id is least
    (of rows that repeat one another any one; a row without id only where no other is).

    Texts without words are equal word for word; an empty table gives no rows. Names
    of columns that begin with ``__rf_`` aren't allowed.
    """
    spark = docs.sparkSession
    tune(spark)
    keys = {"__rf_id": F.col("doc_id").cast("long"), "__rf_tk": F.coalesce(F.unhex(F.md5(F.col("text").cast("binary"))), F.lit(b""))}
    rows = docs.withColumns(keys)
    prints = rows.select("__rf_id", "__rf_tk", F.lower("text").alias("text")).mapInArrow(_prints, "doc_id long, tk binary, digest binary, fp long, bands array<long>")
    prints = stored(spark, prints, "near-prints")
    order = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "tk")
    nodes = prints.groupBy("digest").agg(F.min(order).alias("least"), F.first("fp").alias("fp"), F.first("bands").alias("bands"))
    nodes = stored(spark, nodes.withColumn("node", F.monotonically_increasing_id()), "near-nodes")
    empty = hashlib.blake2b(b"", digest_size=16).digest()
    worded = nodes.filter(F.col("digest") != F.lit(empty))
    balls = simhash_buckets(worded).select("node", "bucket", F.lit(True).alias("first"))
    members = worded.select("node", F.explode("bands").alias("bucket"), F.lit(False).alias("first")).union(balls).distinct()
    shared = members.groupBy("bucket", "first").agg(F.min("node").alias("x"), F.max("node").alias("y")).filter("x <> y").select("bucket", "first")
    members = stored(spark, members.join(shared, ["bucket", "first"]), "near-buckets")
    wanted = members.select("node").distinct().join(nodes.select("node", F.col("least.doc_id").alias("__rf_of"), F.col("least.tk").alias("__rf_by")), "node")
    of = F.col("__rf_id").eqNullSafe(F.col("__rf_of")) & (F.col("__rf_tk") == F.col("__rf_by"))
    texts = rows.select("__rf_id", "__rf_tk", F.lower("text").alias("text")).join(wanted, of).select("node", "text").dropDuplicates(["node"])
    sets = stored(spark, texts.mapInArrow(_sets, "node long, size long, hashes binary"), "near-sets")
    labels, between = links(members, sets)
    roots = components(between).select(F.col("node").alias("root"), F.col("root").alias("top"))
    labels = labels.join(roots, "root", "left").select("node", F.coalesce("top", "root").alias("root"))
    named = nodes.select("digest", "node", "least").join(labels, "node", "left").withColumn("root", F.coalesce("root", "node"))
    best = named.groupBy("root").agg(F.min("least").alias("best"))
    kept = stored(spark, named.join(best, "root").filter("least = best").select("best.doc_id", "best.tk"), "near-kept")
    discard(members, sets, nodes)
    # rows to drop: all but the kept ones; kept ones that are repeated go through a second branch
    counted = prints.groupBy("doc_id", "tk").agg(F.count("*").alias("n")).join(kept.withColumnsRenamed({"doc_id": "id", "tk": "k"}), F.col("doc_id").eqNullSafe(F.col("id")) & (F.col("tk") == F.col("k")), "left")
    out = stored(spark, counted.filter("k is null or n > 1").select(F.col("doc_id").alias("__rf_of"), F.col("tk").alias("__rf_by"), F.col("k").isNotNull().alias("__rf_again")), "near-out")
    discard(prints, kept)
    once = rows.join(out, of, "left_anti").select(*docs.columns)
    again = rows.join(out.filter("__rf_again"), of, "left_semi").dropDuplicates(["__rf_id", "__rf_tk"]).select(*docs.columns)
    return once.union(again)
