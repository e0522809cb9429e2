"""Quality rules with an n-gram perplexity: a modified Kneser-Ney model per language.

The model is over characters (code points; a run of blanks is one): its n-grams are counted
over all documents, with no bound on alphabet or table. Tasks count the different n-grams
of each partition of the rows (``chunk``), Spark adds them up, derives the lower orders
(distinct left extensions), discounts, and interpolated probabilities as joins. The model is
stored as sorted arrays of 64-bit hashes with log probability and back-off weight, spread by
hash. What a chunk needs of it is gathered by a shuffle of the chunk's different n-grams
against those arrays: what is found counts as it is, what isn't backs off to shorter
n-grams. So a task holds the n-grams of its own chunk only, however large the model is. A
row that Spark has put in another partition since (executors come and go) finds what its
chunk lacks in the model's arrays themselves.

A document's figure is bits a letter (log2 of its perplexity). Words with a digit (numbers,
keys, addresses) carry no language and aren't scored; a text of which less than a quarter is
scored has no perplexity. Documents are rejected outside their language's band, which is
wider for short texts.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F, types as T

from rankframe.llm.common import BLANK, POLY, SYMBOLS, SubstringHash, as_bytes, discard, file_system, fresh_path, mix, slices, stored, tune, word_bounds

ORDER = 5
#: Bands: medians plus or minus this share of the median and so many robust deviations.
BAND_SHARE, BAND_DEVIATIONS = 0.02, 4.0
MIN_WORDS, REPEAT_PERCENT, WINDOW = 10, 20, 5
#: Languages up to which tables of one row a language are broadcast; beyond that they are
#: joined by shuffle.
FEW_LANGUAGES = 10_000
#: Text is counted and scored in slices of about so many bytes (several arrays of 8 bytes a
#: character are held for a slice).
SLICE = 1 << 19
#: Entries aimed at in one part of the model's arrays.
PART = 200_000
#: Stands before a text, so that its first characters have a context too.
EDGE = "\n"

DIGIT = np.zeros(256, bool)
DIGIT[48:58] = True
SYMBOL = np.isin(np.arange(256), list(b"#*$%&|<>"))


# ---- n-grams -----------------------------------------------------------------------------


def scored_text(data: np.ndarray, offsets: np.ndarray) -> tuple[str, np.ndarray, np.ndarray]:
    """The scored words of a slice, each with a blank after it and ``ORDER - 1`` edges
    before each row; the row of every character, and whether it is scored (not an edge)."""
    starts, ends, rows = word_bounds(data, offsets)
    digit = np.concatenate([np.zeros(1, np.int64), np.cumsum(DIGIT[data])])
    plain = digit[ends] == digit[starts]
    starts, ends, rows = starts[plain], ends[plain], rows[plain]
    if not len(starts):
        return "", np.zeros(0, np.int64), np.zeros(0, bool)
    size = ends - starts + 1
    total = int(size.sum())
    base = np.cumsum(size) - size
    symbol = data[np.minimum(np.arange(total) + np.repeat(starts - base, size), len(data) - 1)].copy()
    symbol[base + size - 1] = 32
    new_row = np.ones(len(rows), bool)
    new_row[1:] = rows[1:] != rows[:-1]
    place = np.arange(total) + np.repeat(np.cumsum(new_row) * (ORDER - 1), size)
    out = np.full(total + int(new_row.sum()) * (ORDER - 1), ord(EDGE), np.uint8)
    out[place] = symbol
    row, real = np.zeros(len(out), np.int64), np.zeros(len(out), bool)
    row[place], real[place] = np.repeat(rows, size), True
    lead = (out & 0xC0) != 0x80
    return out.tobytes().decode("utf-8", "replace"), row[lead], real[lead]


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le"), np.uint32).astype(np.uint64)


def chain(codes: Iterator[np.ndarray]) -> np.ndarray:
    """Hashes of n-grams, given their last characters, those before them, and so on."""
    with np.errstate(over="ignore"):
        key = mix(next(codes) * POLY + np.uint64(1))
        for c in codes:
            key = mix(key ^ (c * POLY + np.uint64(7)))
    return key


def ngrams(text: str, real: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where the n-grams of scored characters end, and their hashes."""
    at = np.flatnonzero(real)
    codes = _codes(text)
    return at, chain(codes[at - j] for j in range(ORDER))


def _by_language(batch: pa.RecordBatch, chunk: str, lang: str, text: str) -> Iterator[tuple[int, str, np.ndarray, pa.Array]]:
    """Rows of a batch by chunk and language: both, row numbers, texts."""
    keys = [(c, x or "") for c, x in zip(batch.column(chunk).to_pylist(), batch.column(lang).to_pylist())]
    at: dict[tuple[int, str], list[int]] = {}
    for i, k in enumerate(keys):
        at.setdefault(k, []).append(i)
    for (c, name), rows in at.items():
        yield c, name, np.array(rows), batch.column(text).take(pa.array(rows))


class _Counts:
    """Different n-grams of one chunk and language, as hashes, code points and numbers."""

    def __init__(self) -> None:
        self.hash, self.gram, self.n, self.more = np.zeros(0, np.uint64), np.zeros((0, ORDER), np.uint32), np.zeros(0, np.int64), []
        self.waiting = 0

    def add(self, text: str, real: np.ndarray) -> None:
        at, h = ngrams(text, real)
        code, kinds = pd.factorize(h)
        n = np.bincount(code, minlength=len(kinds))
        first = np.zeros(len(kinds), np.int64)
        first[code[::-1]] = np.arange(len(h))[::-1]
        place = np.minimum(np.searchsorted(self.hash, kinds), max(0, len(self.hash) - 1))
        known = self.hash[place] == kinds if len(self.hash) else np.zeros(len(kinds), bool)
        self.n[place[known]] += n[known]
        kinds, first, n = kinds[~known], first[~known], n[~known]
        points = np.frombuffer(text.encode("utf-32-le"), np.uint32)
        self.more.append((kinds, points[at[first][:, None] + np.arange(1 - ORDER, 1)], n))
        self.waiting += len(kinds)
        if self.waiting > max(50_000, len(self.hash) // 4):
            self.settle()

    def settle(self) -> None:
        h, gram, n = (np.concatenate([getattr(self, c), *[m[k] for m in self.more]]) for k, c in enumerate(("hash", "gram", "n")))
        self.hash, first, inverse = np.unique(h, return_index=True, return_inverse=True)
        self.gram, self.n = gram[first], np.bincount(inverse, n, minlength=len(first)).astype(np.int64)
        self.more, self.waiting = [], 0


def _strings(grams: np.ndarray) -> pa.Array:
    """Arrow strings of rows of code points, without one Python string each."""
    width = 1 + (grams >= 0x80) + (grams >= 0x800) + (grams >= 0x10000)
    ends = np.concatenate([np.zeros(1, np.int64), np.cumsum(width.sum(axis=1))]).astype(np.int32)
    return pa.StringArray.from_buffers(len(grams), pa.py_buffer(ends.tobytes()), pa.py_buffer(grams.tobytes().decode("utf-32-le").encode()))


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: dict[tuple[int, str], _Counts] = {}
    for batch in batches:
        for chunk, name, _, texts in _by_language(batch, "chunk", "lang", "text"):
            data, offsets = as_bytes(texts)
            for a, b in slices(offsets, SLICE):
                text, _, real = scored_text(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
                if text:
                    held.setdefault((chunk, name), _Counts()).add(text, real)
    while held:
        (chunk, name), c = held.popitem()
        c.settle()
        for k in range(0, len(c.n), PART):
            n = c.n[k : k + PART]
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(n), chunk, np.int32)), pa.array([name] * len(n), pa.string()), _strings(c.gram[k : k + PART]), pa.array(n)], ["chunk", "lang", "gram", "n"])


# ---- the model ---------------------------------------------------------------------------


def _small(table: DataFrame, rows: int) -> DataFrame:
    """A table of one row a language, broadcast if there are few."""
    return F.broadcast(table) if rows <= FEW_LANGUAGES else table


def _pack(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
    rows = rows.sort_values("key")
    column = lambda c, kind: [rows[c].to_numpy(np.float64).astype(kind).tobytes()]
    return pd.DataFrame({"part": [key[0]], "keys": [rows["key"].to_numpy(np.int64).tobytes()], "logs": column("log", np.float32), "backs": column("back", np.float32)})


MODEL = "part long, keys binary, logs binary, backs binary, parts long"


def _key() -> Column:
    return F.xxhash64("lang", "gram")


def smooth(counts: DataFrame) -> DataFrame:
    """``lang, gram, log, back``: log2 probability of each n-gram's last character after the
    others, and log2 of the weight that shorter n-grams have after it, from
    ``counts(lang, gram, n)`` of order ``ORDER``. The empty gram has the probability of a
    character that was never seen."""
    spark = counts.sparkSession
    levels = {ORDER: stored(spark, counts, "ngrams")}
    for k in range(ORDER - 1, 0, -1):
        levels[k] = stored(spark, levels[k + 1].groupBy("lang", F.substring("gram", 2, k).alias("gram")).agg(F.count("*").alias("n")), "ngrams")
    alphabet = levels[1].groupBy("lang").agg((1.0 / (F.count("*") + 1)).alias("below"))
    alphabet = stored(spark, alphabet, "alphabets")
    few = alphabet.count()
    lower, out = None, alphabet.select("lang", F.lit("").alias("gram"), F.col("below").alias("p"))
    weights, tables = None, [alphabet]
    for k in range(1, ORDER + 1):
        table = levels[k]
        seen = table.groupBy("lang").agg(*[F.count_if(F.col("n") == i).cast("double").alias(f"n{i}") for i in range(1, 5)])
        y = F.col("n1") / F.greatest(F.lit(1.0), F.col("n1") + 2 * F.col("n2"))

        def discount(i: int, y: Column = y) -> Column:
            raw = F.lit(float(i)) - (i + 1) * y * F.col(f"n{i + 1}") / F.greatest(F.lit(1.0), F.col(f"n{i}"))
            return F.least(F.lit(float(i)), F.greatest(F.lit(0.1), raw))

        seen = _small(seen.select("lang", *[discount(i).alias(f"d{i}") for i in (1, 2, 3)]), few)
        table = table.join(seen, "lang").withColumn("d", F.when(F.col("n") == 1, F.col("d1")).when(F.col("n") == 2, F.col("d2")).otherwise(F.col("d3")))
        table = table.withColumn("context", F.substring("gram", 1, k - 1))
        over = Window.partitionBy("lang", "context")  # as many rows as the alphabet has characters
        table = table.withColumn("total", F.sum("n").over(over)).withColumn("spare", F.sum("d").over(over) / F.col("total"))
        if lower is None:
            table = table.join(_small(alphabet, few), "lang")
        else:
            table = table.withColumn("tail", F.substring("gram", 2, k - 1)).join(lower.select("lang", F.col("gram").alias("tail"), F.col("p").alias("below")), ["lang", "tail"])
        table = stored(spark, table.select("lang", "gram", "context", "spare", ((F.col("n") - F.col("d")) / F.col("total") + F.col("spare") * F.col("below")).alias("p")), "level")
        tables.append(table)
        lower = table.select("lang", "gram", "p")
        out = out.union(lower)
        back = table.groupBy("lang", "context").agg(F.first("spare").alias("spare"))
        weights = back if weights is None else weights.union(back)
    # edges are contexts, but nothing ends with one: those have a weight and no probability
    both = out.join(weights.withColumnRenamed("context", "gram"), ["lang", "gram"], "full")
    both = both.select("lang", "gram", F.log2("p").alias("log"), F.coalesce(F.log2("spare"), F.lit(0.0)).alias("back"))
    both = stored(spark, both, "smoothed")
    discard(*tables, *levels.values())
    return both


def train(counts: DataFrame) -> tuple[str, int]:
    """Smooth ``counts(lang, gram, n)`` and store the model; its folder and number of parts."""
    spark = counts.sparkSession
    entries = smooth(counts)
    parts = max(1, -(-entries.count() // PART))
    folder = fresh_path(spark, "ngram-model")
    rows = entries.withColumn("key", _key()).select(F.pmod("key", F.lit(parts)).alias("part"), "key", "log", "back")
    rows.groupBy("part").applyInPandas(_pack, "part long, keys binary, logs binary, backs binary").withColumn("parts", F.lit(parts).cast("long")).write.parquet(folder)
    discard(entries)
    return folder, parts


def _find(key: tuple, asked: pd.DataFrame, model: pd.DataFrame) -> pd.DataFrame:
    out = asked.drop(columns=["part", "group", "key"])
    if model.empty:
        return out.assign(log=np.nan, back=0.0, found=False)
    row = model.iloc[0]
    keys = np.frombuffer(row["keys"], np.int64)
    at = np.minimum(np.searchsorted(keys, asked["key"].to_numpy()), len(keys) - 1)
    there = keys[at] == asked["key"].to_numpy()
    log, back = (np.frombuffer(row[c], np.float32)[at].astype(np.float64) for c in ("logs", "backs"))
    found = there & ~np.isnan(log)
    return out.assign(log=np.where(found, log, np.nan), back=np.where(there, back, 0.0), found=found)


def look_up(spark: SparkSession, folder: str, asked: DataFrame) -> DataFrame:
    """The written table ``asked(lang, gram)`` with ``log, back, found`` from the stored
    arrays. A group has one part of them and about ``2 * PART`` n-grams: where more are asked
    for, parts are sent to several groups."""
    model = spark.read.schema(MODEL).parquet(folder)
    head = model.select("parts").head()
    parts = head[0] if head else 1
    groups = max(1, -(-asked.count() // (parts * 2 * PART)))
    rows = asked.withColumn("key", _key())
    rows = rows.withColumn("part", F.pmod("key", F.lit(parts).cast("long"))).withColumn("group", F.pmod(F.shiftright("key", 40), F.lit(groups).cast("long")))
    sent = model.select("part", "keys", "logs", "backs", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(groups - 1).cast("long"))).alias("group"))
    schema = T.StructType([*asked.schema.fields, T.StructField("log", T.DoubleType()), T.StructField("back", T.DoubleType()), T.StructField("found", T.BooleanType())])
    return rows.groupBy("part", "group").cogroup(sent.groupBy("part", "group")).applyInPandas(_find, schema)


def probabilities(spark: SparkSession, folder: str, asked: DataFrame) -> DataFrame:
    """``chunk, lang, gram, log`` of ``asked(chunk, lang, gram)``: what the model has, and by
    back-off to shorter n-grams what it hasn't. A language that it doesn't know gives no rows."""
    # each n-gram is looked up once, however many chunks have it
    names = stored(spark, asked.select("lang", "gram").distinct(), "asked-grams")
    known = stored(spark, look_up(spark, folder, names), "looked-up")
    first = asked.join(known.select("lang", "gram", "log", "found"), ["lang", "gram"])
    out = first.filter("found").select("chunk", "lang", "gram", "log")
    missing = first.filter("not found").select("chunk", "lang", F.col("gram").alias("whole"), F.lit(0.0).alias("spent"))
    if known.filter("not found").isEmpty():
        return out
    for k in range(ORDER - 1, -1, -1):
        if missing.isEmpty():
            break
        rest = missing.withColumn("context", F.substring("whole", ORDER - k, k))
        names = rest.select("lang", F.col("context").alias("gram")).union(rest.select("lang", F.substring("whole", ORDER - k + 1, k)))
        known = stored(spark, look_up(spark, folder, stored(spark, names.distinct(), "asked-grams")), "looked-up")
        rest = rest.join(known.select("lang", F.col("gram").alias("context"), F.col("back")), ["lang", "context"]).withColumn("spent", F.col("spent") + F.col("back")).drop("back")
        rest = rest.withColumn("gram", F.substring("whole", ORDER - k + 1, k)).join(known.select("lang", "gram", "log", "found"), ["lang", "gram"])
        out = out.union(rest.filter("found").select("chunk", "lang", "whole", F.col("spent") + F.col("log")))
        missing = stored(spark, rest.filter("not found").select("chunk", "lang", "whole", "spent"), "missing")
    return out


def _pack_chunk(rows: pa.Table) -> pa.Table:
    codes = _codes(as_bytes(rows.column("gram"))[0].tobytes().decode()).reshape(-1, ORDER)
    h = chain(codes[:, ORDER - 1 - j] for j in range(ORDER))
    order = np.argsort(h)
    logs = rows.column("log").to_numpy()[order].astype(np.float32)
    return pa.table({"chunk": pa.array([rows.column("chunk")[0].as_py()], pa.int32()), "lang": [rows.column("lang")[0].as_py()], "hashes": pa.array([h[order].tobytes()], pa.binary()), "logs": pa.array([logs.tobytes()], pa.binary())})


def gather(counts: DataFrame, folder: str) -> str:
    """For each chunk of ``counts(chunk, lang, gram, n)`` the log probabilities of its
    n-grams, as sorted arrays in a folder of its own."""
    spark = counts.sparkSession
    path = fresh_path(spark, "chunk-grams")
    logs = probabilities(spark, folder, counts.select("chunk", "lang", "gram"))
    # a group is what one chunk has of one language
    logs.groupBy("chunk", "lang").applyInArrow(_pack_chunk, "chunk int, lang string, hashes binary, logs binary").write.partitionBy("chunk").parquet(path)
    return path


# ---- reading the stored model in a task --------------------------------------------------


@lru_cache(maxsize=8)
def model_part(folder: str, part: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Keys, logs and back-off weights of one part of the stored model."""
    import pyarrow.dataset as ds

    fs, inner = file_system(folder)
    row = ds.dataset(inner, filesystem=fs, format="parquet", exclude_invalid_files=True).to_table(filter=ds.field("part") == part).to_pylist()[0]
    return np.frombuffer(row["keys"], np.int64), np.frombuffer(row["logs"], np.float32), np.frombuffer(row["backs"], np.float32)


def log_of(folder: str, parts: int, lang: str, gram: str) -> float:
    """Log2 probability of one n-gram, from the stored arrays, with back-off."""
    from xxhash import xxh64_intdigest

    def entry(g: str) -> tuple[float, float]:
        key = np.array([xxh64_intdigest(g.encode(), xxh64_intdigest(lang.encode(), 42))], np.uint64).view(np.int64)[0]  # Spark's xxhash64(lang, gram)
        keys, logs, backs = model_part(folder, int(key) % parts)
        at = int(np.searchsorted(keys, key))
        return (float(logs[at]), float(backs[at])) if at < len(keys) and keys[at] == key else (np.nan, 0.0)

    spent = 0.0
    while True:
        log, _ = entry(gram)
        if log == log or not gram:
            return spent + (log if log == log else 0.0)
        spent += entry(gram[:-1])[1]
        gram = gram[1:]


@lru_cache(maxsize=1)
def chunk_arrays(path: str, chunk: int) -> dict[str, tuple[pd.Index, np.ndarray]]:
    """By language an index of the chunk's sorted hashes, and their log probabilities."""
    import pyarrow.dataset as ds
    from pyarrow.fs import FileType

    fs, inner = file_system(f"{path}/chunk={chunk}")
    if fs.get_file_info(inner).type == FileType.NotFound:
        return {}
    rows = ds.dataset(inner, filesystem=fs, format="parquet").to_table(columns=["lang", "hashes", "logs"]).to_pylist()
    return {r["lang"] or "": (pd.Index(np.frombuffer(r["hashes"], np.uint64)), np.frombuffer(r["logs"], np.float32).astype(np.float64)) for r in rows}


# ---- figures of documents ----------------------------------------------------------------


def _sums(flags: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    total = np.concatenate([np.zeros(1, np.int64), np.cumsum(flags)])
    return total[offsets[1:]] - total[offsets[:-1]]


def _twice(keys: np.ndarray) -> np.ndarray:
    """Which keys occur at least twice."""
    s = np.sort(keys)
    again = np.unique(s[1:][s[1:] == s[:-1]])
    if not len(again):
        return np.zeros(len(keys), bool)
    at = np.minimum(np.searchsorted(again, keys), len(again) - 1)
    return again[at] == keys


FIGURES = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "letters", "scored"]


def base_figures(data: np.ndarray, offsets: np.ndarray) -> dict[str, np.ndarray]:
    """The counts of the base rules for each row of a slice."""
    n = len(offsets) - 1
    if not len(data):
        return {c: np.zeros(n, np.int64) for c in FIGURES}
    starts, ends, rows = word_bounds(data, offsets)
    out = {"n_words": np.bincount(rows, minlength=n)}
    inside = ~BLANK[data]
    out["word_chars"] = _sums(inside & ((data & 0xC0) != 0x80), offsets)
    out["n_symbols"] = _sums(SYMBOL[data], offsets)
    raw, at = data.tobytes(), offsets.tolist()
    dup = np.zeros(n, np.int64)
    for i, (x, y) in enumerate(zip(at, at[1:])):
        lines = [line for line in raw[x:y].split(b"\n") if line.strip()]
        dup[i] = len(lines) - len(set(lines))
    out["n_dup_lines"] = dup
    repeat = np.zeros(n, np.int64)
    if len(starts) >= WINDOW:
        # equal windows have equal hashes; rows that have any are counted by their words
        h = SubstringHash(data, SYMBOLS).of(starts, ends)
        m = len(h) - WINDOW + 1
        key = mix(rows[:m].astype(np.uint64) + np.uint64(1))
        for j in range(WINDOW):
            key = mix(key ^ h[j : j + m])
        ok = np.flatnonzero(rows[:m] == rows[WINDOW - 1 :])
        for i in np.unique(rows[ok[_twice(key[ok])]]).tolist():
            repeat[i] = repeated_words(raw[at[i] : at[i + 1]].split())
    out["n_repeat_words"] = repeat
    return out


def repeated_words(words: list[bytes]) -> int:
    """Words in windows of ``WINDOW`` words that the text has twice or more."""
    windows = list(zip(*[words[j:] for j in range(WINDOW)]))
    often = Counter(windows)
    covered, end = 0, 0
    for i, w in enumerate(windows):
        if often[w] > 1:
            covered += i + WINDOW - max(end, i)
            end = i + WINDOW
    return covered


def _score(batches: Iterator[pa.RecordBatch], path: str, model: tuple[str, int], passed: int) -> Iterator[pa.RecordBatch]:
    """Adds the figures to the first ``passed`` columns; chunk, language and text are the last three."""
    nothing = pd.Index(np.zeros(1, np.uint64)), np.zeros(1)
    for batch in batches:
        figures = {c: np.zeros(batch.num_rows, np.int64) for c in FIGURES}
        bits = np.zeros(batch.num_rows)
        for chunk, name, rows, texts in _by_language(batch, "__rf_chunk", "__rf_lang", "__rf_text"):
            data, offsets = as_bytes(texts)
            for a, b in slices(offsets, SLICE):
                part, at = data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]
                base = base_figures(part, at)
                base["letters"] = base["scored"] = np.zeros(b - a, np.int64)
                text, row, real = scored_text(part, at)
                if text:
                    hashes, logs = chunk_arrays(path, chunk).get(name, nothing)
                    end, h = ngrams(text, real)
                    place = hashes.get_indexer(h)
                    log = logs[place]
                    for i in np.flatnonzero(place < 0).tolist():
                        log[i] = log_of(*model, name, text[end[i] - ORDER + 1 : end[i] + 1])
                    bits[rows[a:b]] = -np.bincount(row[end], log, minlength=b - a)
                    code = _codes(text)[end]
                    base["scored"] = np.bincount(row[end[code != 32]], minlength=b - a)
                    letter = (code >= 128) | ((code >= 65) & (code <= 90)) | ((code >= 97) & (code <= 122))
                    base["letters"] = np.bincount(row[end[letter]], minlength=b - a)
                for c in FIGURES:
                    figures[c][rows[a:b]] = base[c]
        names = batch.schema.names[:passed] + [f"__rf_{c}" for c in [*FIGURES, "bits"]] + ["__rf_lang"]
        columns = [batch.column(i) for i in range(passed)] + [pa.array(figures[c]) for c in FIGURES] + [pa.array(bits), batch.column("__rf_lang")]
        yield pa.RecordBatch.from_arrays(columns, names)
    chunk_arrays.cache_clear()  # Spark keeps the worker for other tasks


def judged(docs: DataFrame, keep: list[str]) -> DataFrame:
    """``keep`` columns of ``docs(lang, text, ...)`` with the figures, ``bits_per_letter``,
    the band and the verdicts in columns named ``__rf_...`` (``docs`` may not have such).

    Null text has no words and fails the base rules; a text that isn't scored for a quarter of
    its characters at least has no perplexity and is not kept; a null language is the
    language ''; repeated rows count each; an empty table gives no rows.
    """
    spark = docs.sparkSession
    tune(spark)
    lang = F.coalesce(F.col("lang").cast("string"), F.lit(""))
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select(*keep, F.spark_partition_id().alias("__rf_chunk"), lang.alias("__rf_lang"), text.alias("__rf_text"))
    counts = docs.select(F.spark_partition_id().alias("chunk"), lang.alias("lang"), text.alias("text"))
    counts = stored(spark, counts.mapInArrow(_count, "chunk int, lang string, gram string, n long"), "chunk-counts", "zstd")
    folder, parts = train(counts.groupBy("lang", "gram").agg(F.sum("n").alias("n")))
    path = gather(counts, folder)
    discard(counts)
    schema = T.StructType(rows.schema.fields[: len(keep)] + [T.StructField(f"__rf_{c}", T.LongType()) for c in FIGURES] + [T.StructField("__rf_bits", T.DoubleType()), T.StructField("__rf_lang", T.StringType())])
    scored = stored(spark, rows.mapInArrow(lambda it: _score(it, path, (folder, parts), len(keep)), schema), "scored")
    enough = 4 * F.col("__rf_scored") >= F.col("__rf_word_chars")
    scored = scored.withColumn("__rf_letters", F.when(enough, F.col("__rf_letters")).otherwise(0))
    failed = (F.col("__rf_n_words") < MIN_WORDS) | (100 * F.col("__rf_n_repeat_words") > REPEAT_PERCENT * F.col("__rf_n_words"))
    scored = scored.withColumn("__rf_base_failed", failed).withColumn("__rf_bits_per_letter", F.expr("try_divide(__rf_bits, __rf_letters)"))
    fair = scored.filter("not __rf_base_failed and __rf_letters > 0")
    middle = fair.groupBy("__rf_lang").agg(F.percentile_approx("__rf_bits_per_letter", 0.5, 10_000).alias("__rf_middle"))
    few = middle.count() <= FEW_LANGUAGES
    small = F.broadcast if few else (lambda df: df)
    apart = F.abs(F.col("__rf_bits_per_letter") - F.col("__rf_middle")) * F.sqrt("__rf_letters")
    # 1.4826 makes the median deviation a standard deviation for a normal spread
    spread = fair.join(small(middle), "__rf_lang").groupBy("__rf_lang").agg((1.4826 * F.percentile_approx(apart, 0.5, 10_000)).alias("__rf_spread"))
    bands = middle.join(small(spread), "__rf_lang")
    out = scored.join(small(bands), "__rf_lang", "left")
    half = BAND_SHARE * F.col("__rf_middle") + BAND_DEVIATIONS * F.col("__rf_spread") / F.sqrt("__rf_letters")
    inside = (F.col("__rf_letters") > 0) & (apart / F.sqrt("__rf_letters") <= half)
    return out.withColumn("__rf_kept", ~F.col("__rf_base_failed") & F.coalesce(inside, F.lit(False)))


def quality_figures(docs: DataFrame) -> DataFrame:
    """One row per row of ``docs(doc_id, lang, text)`` with base figures and verdicts."""
    out = judged(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "lang", "text"), ["doc_id"])
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "bits_per_letter"]
    return out.select("doc_id", *[F.col(f"__rf_{c}").alias(c) for c in names])


def keep_good(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that the rules keep, with all their columns; see ``judged`` for
    nulls, empty texts, repeated rows and empty tables."""
    return judged(docs, docs.columns).filter("__rf_kept").select(*docs.columns)
