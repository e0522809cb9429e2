"""Bulk-synchronous best-fit packing of documents into sequences of bounded length.

Superstep by superstep, one length class of pieces at a time from the longest down:
gaps (room left in open sequences) and pieces are ranges of equal values; the successor
of the class among the gaps (the smallest gap that holds it) takes as many pieces as it
has gaps, the n-th piece by rank going to the n-th gap, the gaps shrink, and the rest of
the class goes on to the next successor or opens new sequences. Lengths and gaps are at
most the sequence length, so classes, not rows, are what the supersteps hold: a table of
at most ``capacity`` counts, however many documents there are. Rows are ranked inside
their class by a distributed two-level count and placed by rank. The sweeps over the table
of classes run in the driver: as Spark rounds over rows they would be some 50 rounds of four
small jobs each, for the same number of sequences (see the README).
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from rankframe.llm.common import as_bytes, slices, stored, tune
from rankframe.llm.tokens import codec

#: Bytes of the placement of classes that are sent to tasks.
PLAN_BYTES = 256 << 20

PIECES = "doc_id long, piece int, start long, length int, ids_crc32 long"


def _cut(batches: Iterator[pa.RecordBatch], tokenizer: str, end_id: int, capacity: int) -> Iterator[pa.RecordBatch]:
    enc = codec(tokenizer)
    for batch in batches:
        data, offsets = as_bytes(batch.column(1))
        rows, pieces, starts, lengths, crcs = [], [], [], [], []
        for a, b in slices(offsets):
            ids, cuts = enc.encode_rows(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], end_id)
            cuts = cuts.tolist()
            raw = memoryview(ids.astype("<u4").tobytes())
            for row in range(b - a):
                lo, hi = cuts[row], cuts[row + 1]
                for k, s in enumerate(range(lo, hi, capacity)):
                    e = min(s + capacity, hi)
                    rows.append(a + row), pieces.append(k), starts.append(s - lo), lengths.append(e - s)
                    crcs.append(zlib.crc32(raw[4 * s : 4 * e]))
        yield pa.RecordBatch.from_arrays(
            [batch.column(0).take(pa.array(rows, pa.int64())), pa.array(pieces, pa.int32()), pa.array(starts, pa.int64()), pa.array(lengths, pa.int32()), pa.array(crcs, pa.int64())],
            ["doc_id", "piece", "start", "length", "ids_crc32"],
        )


def pieces_of(docs: DataFrame, tokenizer: str, end_id: int, capacity: int) -> DataFrame:
    """Encode each text with one end id after it; only documents longer than ``capacity``
    are cut. Null text is empty and gives a piece of the end id alone."""
    tune(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return rows.mapInArrow(lambda it: _cut(it, tokenizer, end_id, capacity), PIECES)


def supersteps(counts: dict[int, int], capacity: int) -> tuple[np.ndarray, int]:
    """Placement by class and rank: rows (length, first rank, number, first sequence,
    offset), and the number of sequences. ``counts`` has pieces by length."""
    gaps: dict[int, list[tuple[int, int]]] = {}  # gap -> runs (first sequence, number)
    order: list[int] = []  # gaps that are there, ascending
    plan, opened = [], 0

    def put(gap: int, first: int, n: int) -> None:
        if gap:
            if gap not in gaps:
                insort(order, gap)
                gaps[gap] = []
            gaps[gap].append((first, n))

    for length in sorted(counts, reverse=True):
        left, rank = counts[length], 0
        while left:
            k = bisect_left(order, length)
            if k == len(order):  # no gap holds the class: open sequences, each filled in turn
                each = capacity // length
                full = left // each
                for per, n in ((each, full), (left - full * each, 1)):
                    if per and n:
                        for j in range(per):
                            plan.append((length, rank, n, opened, j * length))
                            rank += n
                        put(capacity - per * length, opened, n)
                        opened += n
                left = 0
                continue
            gap = order[k]
            first, n = gaps[gap].pop()
            if not gaps[gap]:
                del gaps[gap]
                order.pop(k)
            take = min(n, left)
            plan.append((length, rank, take, first, capacity - gap))
            if take < n:
                put(gap, first + take, n - take)
            put(gap - length, first, take)
            left, rank = left - take, rank + take
    return np.array(plan, np.int64).reshape(-1, 5), opened


def _place(batches: Iterator[pa.RecordBatch], plan: np.ndarray) -> Iterator[pa.RecordBatch]:
    shift = np.int64(1 << 44)
    keys = plan[:, 0] * shift + plan[:, 1]
    by = np.argsort(keys, kind="stable")
    keys, plan = keys[by], plan[by]
    for batch in batches:
        length, rank = batch.column("length").to_numpy().astype(np.int64), batch.column("rank").to_numpy()
        at = plan[np.searchsorted(keys, length * shift + rank, "right") - 1]
        names = ["doc_id", "piece", "start", "length", "ids_crc32"]
        yield pa.RecordBatch.from_arrays(
            [batch.column(c) for c in names[:3]] + [pa.array(length), batch.column("ids_crc32"), pa.array(at[:, 3] + rank - at[:, 1]), pa.array(at[:, 4])],
            [*names, "sequence_id", "offset"],
        )


def best_fit(pieces: DataFrame, capacity: int) -> DataFrame:
    """Pack ``pieces(doc_id, piece, start, length, ids_crc32)``: adds ``sequence_id`` and
    ``offset``. Ties in length go by document and piece; repeated rows are packed each; a
    null doc_id is a value like any other; an empty table gives no rows.

    ``pieces`` should be a written table, for it is read three times.
    """
    spark = pieces.sparkSession
    # at most ``capacity`` rows reach the driver
    counts = {r[0]: r[1] for r in pieces.groupBy("length").count().collect()}
    plan, _ = supersteps(counts, capacity)
    # a class takes part of the gaps of each size once at most: fewer than capacity ** 2 / 2
    # rows of 40 bytes however many pieces there are; some thousands in practice
    if plan.nbytes > PLAN_BYTES:
        raise ValueError(f"{len(plan)} placements of classes are too many for a capacity of {capacity}")
    sent = spark.sparkContext.broadcast(plan)
    cells = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    rows = pieces.withColumn("cell", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(cells)).cast("int"))
    per_cell = rows.groupBy("length", "cell").agg(F.count("*").alias("n"))
    before = Window.partitionBy("length").orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)
    per_cell = per_cell.select("length", "cell", F.coalesce(F.sum("n").over(before), F.lit(0).cast("long")).alias("before"))
    inside = F.row_number().over(Window.partitionBy("length", "cell").orderBy("doc_id", "piece", "ids_crc32"))
    ranked = rows.withColumn("inside", inside).join(per_cell, ["length", "cell"])
    ranked = ranked.withColumn("rank", F.col("before") + F.col("inside") - 1).select("doc_id", "piece", "start", "length", "ids_crc32", "rank")
    return ranked.mapInArrow(lambda it: _place(it, sent.value), "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")


def pack(docs: DataFrame, tokenizer: str, end_id: int, capacity: int) -> DataFrame:
    """Encode, cut and pack all of ``docs(doc_id, text)``; one row per piece.

    Null and empty texts are one piece of the end id alone; repeated rows are packed each; a
    null doc_id stays null; an empty table gives no rows; other columns are not read."""
    pieces = stored(docs.sparkSession, pieces_of(docs, tokenizer, end_id, capacity), "pieces")
    return best_fit(pieces, capacity)
