"""Token-id store: raw id shards in key order, found through a minimal perfect hash.

Layout under one folder of the shared store:

* ``shard-*.ids``   16-byte header (magic ``RFIDS001``, id width, end id), then raw
  little-endian ids of whole documents in ascending key order;
* ``records``       Parquet: key, occurrence, shard, file, first id, number of ids;
* ``shards``        Parquet: shard, file, number of ids before it;
* ``index``         Parquet: one row per hash bucket with a minimal perfect hash of the
  bucket's keys (bits and, for every 64 of them, the bits before) and, slot by slot,
  fingerprint, shard, first id and number of ids.

Rows that repeat a key are told apart by their occurrence (0, 1, ...) in text order; a
null key sorts first; null text is empty and holds the end id alone. Task attempts write
files of their own names and only a finished task's files reach ``records``, so lost
executors leave nothing behind that a reader sees.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from rankframe.llm.common import as_bytes, file_system, fresh_path, mix, slices, tune
from rankframe.llm.tokens import codec

MAGIC = b"RFIDS001"
HEADER = struct.Struct("<8sII")
#: Mean number of keys in a bucket of the index; a bucket is built and probed in one task.
BUCKET_KEYS = 20_000
#: Slots per key in each level of the perfect hash.
GAMMA = 2.0

RECORDS = "doc_id long, occurrence long, shard int, file string, first long, n_tokens long"
INDEX = "bucket long, n_keys long, seed long, levels array<binary>, ranks array<binary>, fingerprints binary, shards binary, firsts binary, lengths binary"


def _open(path: str, mode: str):
    fs, inner = file_system(path)
    return fs.open_output_stream(inner) if mode == "w" else fs.open_input_file(inner)


def _make_folder(path: str) -> None:
    fs, inner = file_system(path)
    fs.create_dir(inner, recursive=True)


# ---- writing ---------------------------------------------------------------------------


def _write_shard(batches: Iterator[pa.RecordBatch], folder: str, tokenizer: str, end_id: int) -> Iterator[pa.RecordBatch]:
    enc = codec(tokenizer)
    shard = TaskContext.get().partitionId()
    path, sink, at = f"{folder}/shard-{shard:06d}-{uuid.uuid4().hex}.ids", None, 0
    last, seen = object(), 0
    for batch in batches:
        if sink is None:
            _make_folder(folder)
            sink = _open(path, "w")
            sink.write(HEADER.pack(MAGIC, enc.width, end_id))
        data, offsets = as_bytes(batch.column(1))
        lengths = np.zeros(batch.num_rows, np.int64)
        for a, b in slices(offsets):
            ids, cuts = enc.encode_rows(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], end_id)
            lengths[a:b] = np.diff(cuts)
            sink.write(ids.tobytes())
        keys, occurrence = batch.column(0).to_pylist(), []
        for k in keys:
            seen = seen + 1 if k == last else 0
            last = k
            occurrence.append(seen)
        first = at + np.concatenate([np.zeros(1, np.int64), np.cumsum(lengths)])
        at = int(first[-1])
        n = batch.num_rows
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array(occurrence, pa.int64()), pa.array(np.full(n, shard, np.int32)), pa.array([path] * n), pa.array(first[:-1]), pa.array(lengths)],
            ["doc_id", "occurrence", "shard", "file", "first", "n_tokens"],
        )
    if sink is not None:
        sink.close()


def write_store(docs: DataFrame, tokenizer: str, end_id: int, folder: str | None = None, shards: int | None = None) -> str:
    """Encode ``docs(doc_id, text)`` into a new store and return its folder.

    One range shuffle by key; each range becomes one shard, so memory is a batch of rows
    at any size. An empty table gives a store without shards.
    """
    spark = docs.sparkSession
    tune(spark)
    folder = folder or fresh_path(spark, "token-store")
    shards = shards or int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"))
    rows = rows.repartitionByRange(shards, "doc_id").sortWithinPartitions("doc_id", "text")
    rows.mapInArrow(lambda it: _write_shard(it, f"{folder}/data", tokenizer, end_id), RECORDS).write.parquet(f"{folder}/records")
    records = spark.read.schema(RECORDS).parquet(f"{folder}/records")
    sizes = records.groupBy("shard", "file").agg(F.sum("n_tokens").alias("total"))
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)  # one row per shard
    sizes.select("shard", "file", F.coalesce(F.sum("total").over(before), F.lit(0).cast("long")).alias("before")).write.parquet(f"{folder}/shards")
    _write_index(spark, folder)
    return folder


# ---- minimal perfect hash ----------------------------------------------------------------


def _level_slots(h: np.ndarray, level: int, size: int) -> np.ndarray:
    return (mix(h + np.uint64((level + 1) * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF)) % np.uint64(size)).astype(np.int64)


def build_perfect_hash(h: np.ndarray) -> tuple[list[bytes], list[bytes], np.ndarray]:
    """Levels of bit arrays for distinct 64-bit hashes, for every 64 bits of a level the
    slots before them, and the slot 0..n-1 of each hash.

    At each level a key that is alone in its place gets that place's bit; the others go
    on to the next level. A key's slot is the number of set bits before its own.
    """
    levels, ranks, slot = [], [], np.zeros(len(h), np.int64)
    left, base = np.arange(len(h)), 0
    while len(left):
        size = max(64, int(GAMMA * len(left) + 63) // 64 * 64)
        at = _level_slots(h[left], len(levels), size)
        alone = np.bincount(at, minlength=size) == 1
        before = base + np.cumsum(alone) - alone
        mine = alone[at]
        slot[left[mine]] = before[at[mine]]
        base += int(alone.sum())
        levels.append(np.packbits(alone, bitorder="little").tobytes())
        ranks.append(before[::64].astype(np.int32).tobytes())
        left = left[~mine]
    return levels, ranks, slot


def probe_perfect_hash(levels: list[bytes], ranks: list[bytes], h: np.ndarray) -> np.ndarray:
    """Slot of each hash, or -1, at a fixed cost a hash and level. Hashes that were not
    indexed may get any slot."""
    slot, todo = np.full(len(h), -1, np.int64), np.arange(len(h))
    for level, (raw, rank) in enumerate(zip(levels, ranks)):
        if not len(todo):
            break
        words, before = np.frombuffer(raw, "<u8"), np.frombuffer(rank, np.int32)
        at = _level_slots(h[todo], level, 64 * len(words))
        word, bit = words[at // 64], (at % 64).astype(np.uint64)
        hit = (word >> bit) & np.uint64(1) == 1
        slot[todo[hit]] = before[at[hit] // 64] + np.bitwise_count(word[hit] & ((np.uint64(1) << bit[hit]) - np.uint64(1)))
        todo = todo[~hit]
    return slot


def _seeded(rows: pd.DataFrame, seed: int) -> np.ndarray:
    """The keys' hashes: the first of their two, or both mixed by a seed."""
    h, other = (rows[c].to_numpy(np.int64).view(np.uint64) for c in ("h", "h2"))
    return mix(h ^ mix(other + np.uint64(seed))) if seed else h.copy()


def _fingerprint(rows: pd.DataFrame) -> np.ndarray:
    return (rows["h2"].to_numpy(np.int64).view(np.uint64) >> np.uint64(32)).astype(np.uint32)


def _build_bucket(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
    seed = 0
    while len(np.unique(h := _seeded(rows, seed))) < len(rows):  # two keys share a hash
        seed += 1
        if seed > 8:
            raise ValueError("a key comes twice")
    levels, ranks, slot = build_perfect_hash(h)

    def packed(values: np.ndarray) -> bytes:
        out = np.empty(len(slot), values.dtype)
        out[slot] = values
        return out.tobytes()

    return pd.DataFrame({
        "bucket": [key[0]], "n_keys": [len(h)], "seed": [seed], "levels": [levels], "ranks": [ranks], "fingerprints": [packed(_fingerprint(rows))],
        "shards": [packed(rows["shard"].to_numpy(np.int32))], "firsts": [packed(rows["first"].to_numpy(np.int64))], "lengths": [packed(rows["n_tokens"].to_numpy(np.int64))],
    })


def _with_bucket(keys: DataFrame, buckets: int) -> DataFrame:
    known = [F.coalesce(F.col("doc_id"), F.lit(0).cast("long")), F.col("doc_id").isNull(), F.col("occurrence")]
    keys = keys.withColumn("h", F.xxhash64(*known)).withColumn("h2", F.xxhash64(F.lit("second"), *known))
    return keys.withColumn("bucket", F.pmod(F.shiftright("h", 7), F.lit(buckets)))


def _write_index(spark: SparkSession, folder: str) -> None:
    records = spark.read.schema(RECORDS).parquet(f"{folder}/records")
    buckets = max(1, -(-records.count() // BUCKET_KEYS))
    rows = _with_bucket(records, buckets).select("bucket", "h", "h2", "shard", "first", "n_tokens")
    rows.groupBy("bucket").applyInPandas(_build_bucket, INDEX).withColumn("n_buckets", F.lit(buckets)).write.parquet(f"{folder}/index")


# ---- reading -----------------------------------------------------------------------------


def _probe_bucket(key: tuple, keys: pd.DataFrame, index: pd.DataFrame) -> pd.DataFrame:
    out = keys[["doc_id", "occurrence"]].copy()
    if index.empty:
        return out.assign(shard=-1, first=np.int64(0), n_tokens=np.int64(0), found=False)
    row = index.iloc[0]
    slot = probe_perfect_hash(list(row["levels"]), list(row["ranks"]), _seeded(keys, int(row["seed"])))
    found = slot >= 0
    safe = np.where(found, slot, 0)
    found &= np.frombuffer(row["fingerprints"], np.uint32)[safe] == _fingerprint(keys)
    pick = lambda name, kind: np.frombuffer(row[name], kind)[safe]
    return out.assign(shard=pick("shards", np.int32), first=pick("firsts", np.int64), n_tokens=pick("lengths", np.int64), found=found)


def locate(folder: str, keys: DataFrame) -> DataFrame:
    """Look ``keys(doc_id, occurrence)`` up: shard, first id, number of ids, found.

    A key outside the store is found by mistake with probability 2**-32.
    """
    spark = keys.sparkSession
    index = spark.read.schema(INDEX + ", n_buckets long").parquet(f"{folder}/index")
    head = index.select("n_buckets").head()
    asked = _with_bucket(keys.select("doc_id", "occurrence"), head[0] if head else 1)
    return asked.groupBy("bucket").cogroup(index.drop("n_buckets").groupBy("bucket")).applyInPandas(
        _probe_bucket, "doc_id long, occurrence long, shard int, first long, n_tokens long, found boolean"
    )


def _read_shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    path, source, width = None, None, 2
    for batch in batches:
        files, first, count = batch.column("file").to_pylist(), batch.column("first").to_numpy(), batch.column("n_tokens").to_numpy()
        ids_of = []
        for f, a, n in zip(files, first.tolist(), count.tolist()):
            if f != path:
                source, path = _open(f, "r"), f
                magic, width, _ = HEADER.unpack(source.read_at(HEADER.size, 0))
                if magic != MAGIC:
                    raise ValueError(f"not an id shard: {f}")
            ids_of.append(np.frombuffer(source.read_at(n * width, HEADER.size + a * width), f"<u{width}").astype("<u4").tobytes())
        crc = [zlib.crc32(x) for x in ids_of]
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), batch.column("occurrence"), batch.column("start"), batch.column("n_tokens"), pa.array(crc, pa.int64())],
            ["doc_id", "occurrence", "start", "n_tokens", "ids_crc32"],
        )


def read_back(folder: str, keys: DataFrame) -> DataFrame:
    """Fetch documents by key through the index: ``doc_id, occurrence, start`` (ids of all
    documents before it in the store), ``n_tokens``, ``ids_crc32`` of the ids in the file."""
    spark = keys.sparkSession
    shards = spark.read.schema("shard int, file string, before long").parquet(f"{folder}/shards")
    at = locate(folder, keys).filter("found").join(shards, "shard")
    at = at.withColumn("start", F.col("before") + F.col("first"))
    at = at.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "shard").sortWithinPartitions("shard", "first")
    return at.select("doc_id", "occurrence", "file", "first", "start", "n_tokens").mapInArrow(
        _read_shards, "doc_id long, occurrence long, start long, n_tokens long, ids_crc32 long"
    )


def read_document(spark: SparkSession, folder: str, doc_id: int | None, occurrence: int = 0) -> np.ndarray | None:
    """Ids of one document (None where the store has no such key): one bucket of the index
    and one range of one shard are read."""
    index = spark.read.schema(INDEX + ", n_buckets long").parquet(f"{folder}/index")
    head = index.select("n_buckets").head()
    if head is None:
        return None
    asked = _with_bucket(spark.createDataFrame([(doc_id, occurrence)], "doc_id long, occurrence long"), head[0]).toPandas()
    bucket = index.filter(F.col("bucket") == int(asked["bucket"][0])).drop("n_buckets").toPandas()
    found = _probe_bucket((), asked, bucket).iloc[0]
    if not found["found"]:
        return None
    shards = spark.read.schema("shard int, file string, before long").parquet(f"{folder}/shards")
    at = {"file": shards.filter(F.col("shard") == int(found["shard"])).head()["file"], "first": int(found["first"]), "n_tokens": int(found["n_tokens"])}
    source = _open(at["file"], "r")
    width = HEADER.unpack(source.read_at(HEADER.size, 0))[1]
    return np.frombuffer(source.read_at(at["n_tokens"] * width, HEADER.size + at["first"] * width), f"<u{width}").astype("<u4")


def store_and_read(docs: DataFrame, tokenizer: str, end_id: int) -> DataFrame:
    """Write all of ``docs(doc_id, text)`` to a new store, then read every key back through
    the index: one row per row of ``docs``.

    Null text is empty (the end id alone); rows that repeat a key come in the order of
    their texts; a null key sorts first; an empty table gives no rows; other columns are
    not read.
    """
    folder = write_store(docs, tokenizer, end_id)
    records = docs.sparkSession.read.schema(RECORDS).parquet(f"{folder}/records")
    return read_back(folder, records.select("doc_id", "occurrence"))
