"""SimHash near-duplicate groups by meet-in-the-middle ball hashing.

Two fingerprints differ in at most 3 bits if and only if some value lies within 1 bit of
one and within 2 bits of the other, so every distinct fingerprint emits its balls of
radius 1 and radius 2 and those that share a variant are linked. Variants with equal
leading bits travel as one row (fingerprint and leading bits) and are spelled out in the
task that receives them: the same variants, a small fraction of the shuffle. A bucket's
members are joined as a star, never pair by pair; what a task has joined it sends on as
a spanning forest, and star contraction finds the components.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from rankframe.llm.common import as_bytes, join_hot, slices, stored, tune
from rankframe.llm.components import components, local_roots

SEED, SHINGLE_WORDS, RADIUS = 42, 3, 3
#: Fingerprints aimed at in one cell of leading bits.
CELL = 20_000
#: A cell with more balls of radius 1 than this, or with ``16 * FULL`` of both, is split by
#: further leading bits, ``SPLIT_BITS`` at a time, down to cells of ``LAST_BITS``, which
#: hold few values of their own.
FULL, SPLIT_BITS, LAST_BITS = 2 * CELL, 8, 56
_ONE = np.uint64(1)


def shingle_hashes(text: bytes) -> list[int]:
    from xxhash import xxh64_intdigest

    w = text.lower().split()
    if len(w) < SHINGLE_WORDS:
        return [xxh64_intdigest(b" ".join(w), SEED)] if w else []
    return [xxh64_intdigest(b"%b %b %b" % t, SEED) for t in zip(w, w[1:], w[2:])]


def fingerprint(hashes: list[int] | np.ndarray) -> int:
    """Bits set in over half of the hashes, as a signed 64-bit integer; none: 0."""
    if not len(hashes):
        return 0
    h = np.array(hashes, np.uint64)
    ones = np.zeros(64, np.int64)
    for k in range(0, len(h), 1 << 16):
        bits = np.unpackbits(h[k : k + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(h), bitorder="little").view(np.int64)[0])


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        data, offsets = as_bytes(batch.column(1))
        out = []
        for a, b in slices(offsets):
            raw, at = data[offsets[a] : offsets[b]].tobytes(), (offsets[a : b + 1] - offsets[a]).tolist()
            out += [fingerprint(shingle_hashes(raw[s:e])) for s, e in zip(at, at[1:])]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.int64())], ["doc_id", "fp"])


def fingerprints(docs: DataFrame) -> DataFrame:
    """``doc_id, fp`` of every whole text (null text: no words, fingerprint 0)."""
    tune(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(_fingerprints, "doc_id long, fp long")


# ---- links -----------------------------------------------------------------------------


def leading_bits(n: int, partitions: int) -> int:
    """Leading bits of a cell, so that cells are small and enough for all tasks."""
    bits = 4
    while bits < 28 and (n * (1 + bits) > CELL << bits or 1 << bits < 4 * partitions):
        bits += 1
    return bits


def _masks(bits: int, most: int) -> list[int]:
    """All masks of at most ``most`` of the bits ``0..bits-1``."""
    return [sum(1 << i for i in c) for k in range(most + 1) for c in combinations(range(bits), k)]


def _join_cell(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
    bits = int(key[0])
    low = 64 - bits
    fp = rows["fp"].to_numpy(np.int64).view(np.uint64)
    flipped = np.bitwise_count((fp >> np.uint64(low)) ^ np.uint64(key[1]))
    values, member = np.unique(fp, return_inverse=True)
    near, wide = np.flatnonzero(rows["radius"].to_numpy() == 1), np.flatnonzero(rows["radius"].to_numpy() == 2)
    top = np.uint64((1 << low) - 1)
    cell = np.uint64((int(key[1]) << low) & 0xFFFFFFFFFFFFFFFF)
    masks = [np.array(_masks(low, k), np.uint64) for k in range(3)]

    def variants(which: np.ndarray, radius: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        for used in range(radius + 1):
            some, m = which[flipped[which] == used], masks[radius - used]
            step = max(1, (1 << 20) // len(m))
            for k in range(0, len(some), step):
                part = some[k : k + step]
                yield ((fp[part] & top | cell)[:, None] ^ m).ravel(), np.repeat(member[part], len(m))

    balls = list(variants(near, 1))
    label = np.arange(len(values))
    if balls:
        middle, owner = np.concatenate([x for x, _ in balls]), np.concatenate([x for _, x in balls])
        order = np.argsort(middle, kind="stable")
        middle, owner = middle[order], owner[order]
        first = np.ones(len(middle), bool)
        first[1:] = middle[1:] != middle[:-1]
        star = owner[first][np.cumsum(first) - 1]
        label = local_roots(len(values), owner, star, label)  # both within 1 of the middle
        middle, star = middle[first], owner[first]
        for v, x in variants(wide, 2):
            at = np.searchsorted(middle, v)
            at[at == len(middle)] = 0
            hit = (middle[at] == v) & (star[at] != x)
            pairs = np.unique(x[hit] * len(values) + star[at[hit]])
            a, b = pairs // len(values), pairs % len(values)
            true = np.bitwise_count(values[a] ^ values[b]) <= RADIUS
            label = local_roots(len(values), a[true], b[true], label)
    joined = np.flatnonzero(label != np.arange(len(values)))
    return pd.DataFrame({"u": values[joined].view(np.int64), "v": values[label[joined]].view(np.int64)})


def _sent(rows: DataFrame, bits: int, more: int) -> DataFrame:
    """``rows(fp, radius, cell, ...)`` one level down: cells of ``bits`` leading bits are
    split by the ``more`` bits after them, of which a row may flip what its radius has left."""
    head = F.shiftrightunsigned("fp", 64 - bits - more)
    own = F.shiftrightunsigned("fp", 64 - bits) if bits else F.lit(0).cast("long")
    left = F.col("radius") - F.bit_count(own.bitwiseXOR(F.col("cell")))
    by_left = [F.array(*[F.lit(m).cast("long") for m in _masks(more, k)]) for k in range(3)]
    masks = F.when(left == 0, by_left[0]).when(left == 1, by_left[1]).otherwise(by_left[2])
    inner = F.shiftleft("cell", more).bitwiseOR(head.bitwiseAND((1 << more) - 1))
    return rows.select(*[c for c in rows.columns if c != "cell"], F.explode(F.transform(masks, lambda m: m.bitwiseXOR(inner))).alias("cell"))


def _full_cells(rows: DataFrame, bits: int, more: int) -> DataFrame:
    """Cells one level down that are too full. Where a row goes depends on its first bits
    only, so rows are counted by those first."""
    rest = 64 - bits - more
    heads = rows.groupBy("radius", "cell", F.shiftleft(F.shiftrightunsigned("fp", rest), rest).alias("fp")).agg(F.count("*").alias("n"))
    sizes = _sent(heads, bits, more).groupBy("cell").agg(F.sum(F.when(F.col("radius") == 1, F.col("n")).otherwise(0)).alias("near"), F.sum("n").alias("both"))
    return sizes.filter((F.col("near") > FULL) | (F.col("both") > 16 * FULL)).select("cell")


def links(distinct: DataFrame, n: int) -> DataFrame:
    """Edges ``u, v`` that connect all of ``distinct(fp)`` within 3 bits of each other.

    Fingerprints crowd where texts share most of their words, so cells are counted and
    full ones are split again: no task holds more than a full cell.
    """
    spark = distinct.sparkSession
    bits, more = 0, leading_bits(n, int(spark.conf.get("spark.sql.shuffle.partitions")))
    rows = distinct.select("fp", F.explode(F.array(F.lit(1), F.lit(2))).alias("radius"), F.lit(0).cast("long").alias("cell"))
    ready = None
    while True:
        full = None
        if bits + more < LAST_BITS and n > FULL:  # a cell has one ball of a radius of a fingerprint
            full = stored(spark, _full_cells(rows, bits, more), "full-cells")
            full = None if full.isEmpty() else full
        rows, bits = _sent(rows, bits, more), bits + more
        fits = rows if full is None else rows.join(full, "cell", "left_anti")
        fits = fits.select("fp", "radius", "cell", F.lit(bits).alias("bits"))
        ready = fits if ready is None else ready.union(fits)
        if full is None:
            break
        rows = stored(spark, rows.join(full, "cell", "left_semi").select("fp", "radius", "cell"), "crowded")
        more = min(SPLIT_BITS, LAST_BITS - bits)
    return ready.groupBy("bits", "cell").applyInPandas(_join_cell, "u long, v long")


def groups(prints: DataFrame) -> DataFrame:
    """``fp, component_id, n`` (rows) for the distinct fingerprints of ``prints(doc_id, fp)``, a
    written table. The id is the least doc_id of the component (null ids are passed over;
    null where there is no other)."""
    spark = prints.sparkSession
    distinct = stored(spark, prints.groupBy("fp").agg(F.min("doc_id").alias("first_id"), F.count("*").alias("n")), "distinct-fp")
    roots = components(links(distinct.select("fp"), distinct.count()))
    rooted = distinct.join(roots, distinct.fp == roots.node, "left").select("fp", "n", "first_id", F.coalesce("root", "fp").alias("root"))
    rooted = stored(spark, rooted, "rooted")
    least = stored(spark, rooted.groupBy("root").agg(F.min("first_id").alias("component_id"), F.count("*").alias("prints")), "component-ids")
    return join_hot(rooted, least, ["root"], "prints").select("fp", "component_id", "n")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """One row per row of ``docs(doc_id, text)``: ``doc_id, fingerprint, component_id``.

    Empty and null texts have fingerprint zero and are linked like any other; an empty
    table gives no rows; repeated rows share their component.
    """
    spark = docs.sparkSession
    prints = stored(spark, fingerprints(docs), "fingerprints")
    found = stored(spark, groups(prints), "groups")
    return join_hot(prints, found, ["fp"], "n").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame) -> DataFrame:
    """All columns of one document of each group: the one whose doc_id is least (of rows
    that repeat that id, any one; a row without id only where no other is). Null and empty
    texts are one group; an empty table gives no rows."""
    spark = docs.sparkSession
    prints = stored(spark, fingerprints(docs), "fingerprints")
    found = stored(spark, groups(prints), "groups")
    rows = join_hot(prints, found, ["fp"], "n").groupBy("component_id").agg(F.count_if(F.col("doc_id").eqNullSafe(F.col("component_id"))).alias("__rf_n"))
    kept = docs.join(rows.withColumnRenamed("component_id", "__rf_id"), docs["doc_id"].cast("long").eqNullSafe(F.col("__rf_id")))
    once = kept.filter("__rf_n = 1").select(*[docs[c] for c in docs.columns])
    again = kept.filter("__rf_n > 1").dropDuplicates(["__rf_id"]).select(*[docs[c] for c in docs.columns])
    return once.union(again)
