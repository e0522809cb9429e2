"""Helpers shared by the operators: shared folder, written tables, and vectorised
views of Arrow text batches."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, functions as F

#: Text is worked on in slices of about this many bytes (a longer text is a slice of its own).
SLICE_BYTES = 1 << 20
#: Rows in an Arrow batch sent to Python; keeps a batch of very long texts small.
ARROW_ROWS = 1000

_own_dir: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """Folder that the driver and all executors share: ``spark.checkpoint.dir``.

    Where the setting is absent (tests on a local master) a temporary folder is used;
    on a cluster its absence is an error.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base:
        return base.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    if not _own_dir:
        _own_dir.append("file://" + tempfile.mkdtemp(prefix="rankframe-"))
    return _own_dir[0]


def fresh_path(spark: SparkSession, tag: str) -> str:
    return f"{shared_dir(spark)}/{tag}-{uuid.uuid4().hex}"


def stored(spark: SparkSession, df: DataFrame, tag: str, compression: str = "snappy") -> DataFrame:
    """Write ``df`` to the shared folder and read it back: cuts lineage, survives lost
    executors, and keeps one copy of work that several plans use."""
    path = fresh_path(spark, tag)
    df.write.parquet(path, compression=compression)
    return spark.read.schema(df.schema).parquet(path)


#: A key with more than one in so many rows is hot; there are at most so many of them.
HOT = 1000
ONE_TASK = 500_000


def join_hot(rows: DataFrame, table: DataFrame, on: list[str], n: str) -> DataFrame:
    """``rows`` joined with the written ``table``, one row a key, whose column ``n`` counts
    the key's rows. Hot keys, at most ``HOT``, are broadcast, so none lands in one task; the
    others go by shuffle. Up to ``ONE_TASK`` rows may land in one task. ``n`` is dropped;
    a column named ``__rf_hot`` isn't allowed."""
    every = table.agg(F.sum(n)).head()[0] or 0
    if every <= ONE_TASK:
        return rows.join(table.drop(n), on)
    hot = table.filter(F.col(n) * HOT > every).drop(n).withColumn("__rf_hot", F.lit(True))
    cold = table.filter(F.col(n) * HOT <= every).drop(n)
    marked = rows.join(F.broadcast(hot), on, "left")
    rest = marked.filter("__rf_hot is null").select(*rows.columns).join(cold, on)
    found = marked.filter("__rf_hot").drop("__rf_hot")
    return found.unionByName(rest)


def discard(*tables: DataFrame) -> None:
    """Delete the files of tables from ``stored`` that no plan reads any more."""
    for df in tables:
        files = df.inputFiles()
        if files:
            context = df.sparkSession.sparkContext
            folder = context._jvm.org.apache.hadoop.fs.Path(files[0]).getParent()
            folder.getFileSystem(context._jsc.hadoopConfiguration()).delete(folder, True)


def file_system(path: str) -> tuple[object, str]:
    """Arrow file system and path for a path of the shared folder, from tasks or the
    driver. Names that only Spark's own connectors have (``s3a``) become the usual ones."""
    from pyarrow.fs import FileSystem

    return FileSystem.from_uri(re.sub(r"^s3[an]://", "s3://", path))


def tune(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ARROW_ROWS))


def as_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of a text column without a copy, and the n+1 row offsets (null: empty)."""
    if column.null_count:
        column = pc.fill_null(column, "")
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, at, data = column.buffers()
    if at is None or len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    offsets = np.frombuffer(at, np.int64 if wide else np.int32)
    offsets = offsets[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.zeros(0, np.uint8) if data is None else np.frombuffer(data, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


def slices(offsets: np.ndarray, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges whose texts hold about ``limit`` bytes together."""
    row, rows = 0, len(offsets) - 1
    while row < rows:
        end = int(np.searchsorted(offsets, offsets[row] + limit, "right")) - 1
        end = min(max(end, row + 1), rows)
        yield row, end
        row = end


_BLANKS = re.compile(rb"[ \t-\r]")


def parts(text: bytes, limit: int = SLICE_BYTES) -> Iterator[bytes]:
    """A long text in parts of about ``limit`` bytes that end at blanks."""
    at = 0
    while at < len(text):
        cut = _BLANKS.search(text, at + limit)
        end = cut.start() if cut else len(text)
        yield text[at:end]
        at = end


class Memo(dict):
    """What ``make`` gives for each word, kept by the word's bytes for up to ``limit``
    words; long words are made anew each time."""

    LONGEST = 256

    def __init__(self, make: Callable[[bytes], object], limit: int):
        super().__init__()
        self.make, self.limit = make, limit

    def __missing__(self, word: bytes) -> object:
        out = self.make(word)
        if len(word) <= self.LONGEST:
            if len(self) >= self.limit:
                self.clear()
            self[word] = out
        return out


# ---- 64-bit hashes of substrings, for all of a slice at once --------------------------

#: Odd multiplier of the polynomial, its inverse modulo 2**64, and the
#: multipliers of the 64-bit finaliser of MurmurHash3.
POLY = np.uint64(0x9E3779B97F4A7C15)
POLY_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
MIX_A = np.uint64(0xFF51AFD7ED558CCD)
MIX_B = np.uint64(0xC4CEB9FE1A85EC53)
_S33 = np.uint64(33)

_powers: dict[str, np.ndarray] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser: every input bit reaches every output bit."""
    x = x ^ (x >> _S33)
    x *= MIX_A
    x ^= x >> _S33
    x *= MIX_B
    x ^= x >> _S33
    return x


def _power_table(name: str, base: np.uint64, n: int) -> np.ndarray:
    table = _powers.get(name)
    if table is None or len(table) < n:
        size = max(n, SLICE_BYTES + 1)
        with np.errstate(over="ignore"):
            table = np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(size - 1, base, np.uint64)]))
        _powers[name] = table
    return table[:n]


#: Every byte value gets a well mixed 64-bit symbol.
SYMBOLS = mix(np.arange(1, 257, dtype=np.uint64) * POLY)
#: The same with A-Z read as a-z.
SYMBOLS_FOLDED = SYMBOLS.copy()
SYMBOLS_FOLDED[65:91] = SYMBOLS[97:123]


class SubstringHash:
    """Hashes of any substrings of ``data`` from one prefix sum."""

    def __init__(self, data: np.ndarray, symbols: np.ndarray = SYMBOLS):
        n = len(data)
        self.prefix = np.zeros(n + 1, np.uint64)
        np.cumsum(symbols[data] * _power_table("up", POLY, n), out=self.prefix[1:])
        self.down = _power_table("down", POLY_INVERSE, n + 1)

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((self.prefix[end] - self.prefix[start]) * self.down[start])


#: 1 for the six characters that part words: space and \x09-\x0D.
BLANK = np.zeros(256, bool)
BLANK[[32, 9, 10, 11, 12, 13]] = True


def word_bounds(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and row of each word ``[^\\x20\\x09-\\x0D]+``; words end with their row."""
    if len(data) == 0:
        z = np.zeros(0, np.int64)
        return z, z, z
    inside = ~BLANK[data]
    first = np.zeros(len(data) + 1, bool)
    first[offsets[:-1]] = True
    start = inside.copy()
    start[1:] &= ~inside[:-1] | first[1:-1]
    end = inside.copy()
    end[:-1] &= ~inside[1:] | first[1:-1]
    starts = np.flatnonzero(start)
    ends = np.flatnonzero(end) + 1
    rows = np.searchsorted(offsets, starts, "right") - 1
    return starts, ends, rows
