"""Data selection by importance resampling with hashed n-gram models.

Words and word pairs (ASCII letters folded) are hashed into ``BUCKETS`` buckets. A
generative model of the target texts and one of all raw texts are bucket counts, shrunk
towards each other where a bucket has few; a document's log weight is the sum of its n-grams'
log ratios, the ratio of the two models. Adding Gumbel noise (a hash of the key) and taking
the k largest keys samples k documents without replacement in proportion to their weights.
Where length should not count, ``passage`` makes the weight that of so many n-grams like the
document's own.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from rankframe.llm.common import SYMBOLS_FOLDED, SubstringHash, as_bytes, mix, slices, stored, tune, word_bounds

BUCKETS = 1 << 16
#: The target model is fitted on at most so many labelled rows (those whose hashed ids are
#: least); raw counts, weights and the selection cover all rows.
TARGET_ROWS = 20_000
#: Raw n-grams of prior weight in each bucket; the target gets its share of them.
SMOOTHING = 100.0
SEED = 17


def ngram_buckets(data: np.ndarray, offsets: np.ndarray, buckets: int = BUCKETS) -> tuple[np.ndarray, np.ndarray]:
    """Bucket and row of every word and pair of neighbouring words of a slice."""
    starts, ends, rows = word_bounds(data, offsets)
    h = SubstringHash(data, SYMBOLS_FOLDED).of(starts, ends)
    pair = mix(h[:-1] * np.uint64(3) ^ mix(h[1:]))[rows[:-1] == rows[1:]] if len(h) > 1 else h[:0]
    pair_rows = rows[:-1][rows[:-1] == rows[1:]] if len(h) > 1 else rows[:0]
    every = np.concatenate([h, pair])
    return (every % np.uint64(buckets)).astype(np.int64), np.concatenate([rows, pair_rows])


def _count(batches: Iterator[pa.RecordBatch], buckets: int) -> Iterator[pa.RecordBatch]:
    raw, target = np.zeros(buckets, np.int64), np.zeros(buckets, np.int64)
    for batch in batches:
        data, offsets = as_bytes(batch.column(0))
        chosen = batch.column(1).to_numpy(zero_copy_only=False).astype(bool)
        for a, b in slices(offsets):
            bucket, row = ngram_buckets(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], buckets)
            raw += np.bincount(bucket, minlength=buckets)
            target += np.bincount(bucket[chosen[a:b][row]], minlength=buckets)
    some = np.flatnonzero(raw)
    yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(raw[some]), pa.array(target[some])], ["bucket", "raw", "target"])


def gumbel_keys(weight: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Log weights plus Gumbel noise made of 64-bit hashes."""
    uniform = ((h >> np.uint64(12)).astype(np.float64) + 0.5) / float(1 << 52)
    return weight - np.log(-np.log(uniform))


def _score(batches: Iterator[pa.RecordBatch], ratio: np.ndarray, passage: float | None) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        data, offsets = as_bytes(batch.column("text"))
        weight = np.zeros(batch.num_rows)
        for a, b in slices(offsets):
            bucket, row = ngram_buckets(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], len(ratio))
            weight[a:b] = np.bincount(row, ratio[bucket], minlength=b - a)
            if passage is not None:
                weight[a:b] *= passage / np.maximum(np.bincount(row, minlength=b - a), 1)
        key = gumbel_keys(weight, batch.column("h").to_numpy().view(np.uint64))
        signed = key.view(np.int64)
        ordered = signed ^ ((signed >> 63) & np.int64(0x7FFFFFFFFFFFFFFF))  # sorts like the keys
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(weight), pa.array(key), pa.array(ordered)], ["doc_id", "log_weight", "gumbel_key", "ordered"])


def _threshold(scored: DataFrame, k: int) -> int | None:
    """The k-th largest ``ordered``, exactly, by four counts of 16 bits each (the least
    possible value where there are fewer rows)."""
    if k <= 0:
        return None
    if scored.count() <= k:
        return -(1 << 63)
    low, part = -(1 << 63), scored
    for shift in (48, 32, 16, 0):
        digit = F.shiftright("ordered", shift) if shift == 48 else F.shiftright("ordered", shift).bitwiseAND(0xFFFF)
        # at most 65536 rows
        counts = sorted(((r[0], r[1]) for r in part.groupBy(digit.alias("digit")).count().collect()), reverse=True)
        for value, n in counts:
            if n >= k:
                break
            k -= n
        low = (value << 48) if shift == 48 else low + (value << shift)
        part = part.filter(digit == value)
    return low


def log_ratio(docs: DataFrame, target: DataFrame, buckets: int = BUCKETS) -> np.ndarray:
    """Log of target over raw probability for each bucket. ``docs(doc_id, text)``; at most
    ``TARGET_ROWS`` ids of ``target(doc_id)`` are used."""
    few = F.broadcast(target.select("doc_id").distinct().orderBy(F.xxhash64("doc_id"), "doc_id").limit(TARGET_ROWS).withColumn("__rf_target", F.lit(True)))
    rows = docs.join(few, "doc_id", "left").select("text", F.coalesce("__rf_target", F.lit(False)).alias("chosen"))
    counts = rows.mapInArrow(lambda it: _count(it, buckets), "bucket long, raw long, target long").groupBy("bucket").agg(F.sum("raw").alias("raw"), F.sum("target").alias("target"))
    both = np.zeros((buckets, 2))
    for bucket, raw, chosen in counts.collect():  # one row a bucket
        both[bucket] = (raw, chosen)
    raw, chosen = both.sum(axis=0)
    if not chosen:
        return np.zeros(buckets)
    share = chosen / raw
    return np.log((both[:, 1] + SMOOTHING * share) / ((both[:, 0] + SMOOTHING) * share))


def resample(docs: DataFrame, target: DataFrame, share: float | None = None, k: int | None = None, passage: float | None = None) -> DataFrame:
    """One row per row of ``docs(doc_id, text)``: ``doc_id, log_weight, gumbel_key, kept``.
    With ``passage`` a weight is the mean log ratio times that number.

    ``kept`` marks the k largest keys (``share`` of the rows if k is not given); rows that
    tie with the k-th are kept as well. Null text has no n-grams and weight 0; repeated
    rows share their key; without target rows all weights are 0;
    an empty table gives no rows.
    """
    spark = docs.sparkSession
    tune(spark)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"))
    ratio = spark.sparkContext.broadcast(log_ratio(rows, target))  # one number a bucket
    hashed = rows.withColumn("h", F.xxhash64("doc_id", F.lit(SEED)))
    scored = stored(spark, hashed.mapInArrow(lambda it: _score(it, ratio.value, passage), "doc_id long, log_weight double, gumbel_key double, ordered long"), "weights")
    if k is None:
        k = round(share * scored.count())
    least = _threshold(scored, k)
    kept = F.lit(False) if least is None else F.col("ordered") >= F.lit(least)
    return scored.select("doc_id", "log_weight", "gumbel_key", kept.alias("kept"))


def good_share(labels: DataFrame) -> float:
    """Share of labelled rows with quality 1 (1 where nothing is labelled)."""
    value = labels.agg(F.avg((F.col("quality") == 1).cast("double"))).head()[0]
    return 1.0 if value is None else value


def select_quality(docs: DataFrame, labels: DataFrame, share: float | None = None, passage: float | None = None) -> DataFrame:
    """``resample`` with the documents labelled quality 1 as target and, unless given,
    their share of the labels as the share kept."""
    good = labels.filter("quality = 1").select(F.col("doc_id").cast("long").alias("doc_id"))
    return resample(docs, good, share=good_share(labels) if share is None else share, passage=passage)
