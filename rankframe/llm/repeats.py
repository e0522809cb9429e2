"""Exact removal of long repeated substrings (repeats of ``length`` bytes or more).

1. Every start of a ``length``-byte string is put under the smallest k-gram of that
   string; starts that follow each other under one k-gram form a *run* (the strings
   overlap, so a run is a little longer than a string). Equal strings have equal smallest
   k-grams, so only runs under one k-gram can hold the same string.
2. Spark counts equal runs (by k-gram and a 128-bit BLAKE2 digest of their bytes). A run
   that occurs twice is repeated as a whole. Where different runs share a k-gram, each is
   cut into blocks of starts at fixed distances from the k-gram, and blocks that agree in
   the bytes which all strings of such a block hold form a collection.
3. Collections are compared by column-wise construction: members are aligned at the k-gram
   and one symbol of every member is inserted each round, from the last column to the
   first; each round is a stable split of the suffix order by symbol (the collection's
   Burrows-Wheeler column) and an update of common prefixes from those of the round
   before. A start whose suffix shares ``length`` bytes with a neighbour is repeated.
   Collections of any size go this way; one with more members than a task should hold is
   cut into smaller blocks of starts first, which parts it by content.
4. Ranges go back to their documents, where bytes are removed.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from rankframe.llm.common import SYMBOLS, SubstringHash, as_bytes, discard, join_hot, slices, stored, tune

#: Bytes of the k-gram that starts are put under.
GRAM = 48
#: Neighbouring starts in a block; the later sizes are for collections of over ``FULL``
#: different members. In a block of one start all members are equal.
BLOCKS_OF, FULL = (32, 4, 1), 20_000
#: Collections compared together; bounds a task's memory.
COLUMN_BYTES = 8 << 20
SALT = [k.to_bytes(2, "little") for k in range(1 << 16)]

#: A document row is known by its id (``d``) and a hash of its text (``t``).
KEY = ["d", "t"]
RUNS = "d long, t long, at int, n int, gram long, run long, run2 long, off int"
#: Members of one collection agree in these.
GROUP = ["gram", "block", "region"]
#: A run is known by these, with ``start`` its first start.
RUN = ["gram", *KEY, "start"]
#: Equal members agree in these.
ALIKE = [*GROUP, "n", "off", "same", "same2"]
MEMBERS = "gram long, block int, region long, n int, off int, same long, same2 long, d long, t long, start int, at int, times long"


def _sliding_least(x: np.ndarray, width: int) -> np.ndarray:
    """Minimum of every ``width`` neighbours, in two passes whatever the width."""
    n = len(x) - width + 1
    pad = -len(x) % width
    blocks = np.concatenate([x, np.full(pad, np.uint64(0xFFFFFFFFFFFFFFFF))]).reshape(-1, width)
    left = np.minimum.accumulate(blocks, axis=1).ravel()
    right = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(right[:n], left[width - 1 : width - 1 + n])


def runs_of(data: np.ndarray, offsets: np.ndarray, length: int) -> tuple[np.ndarray, ...]:
    """Runs of a slice: row, start in the row, number of starts, k-gram hash, bytes from
    the first start to the k-gram."""
    width = length - GRAM + 1
    z = np.zeros(0, np.int64)
    if len(data) < length:
        return z, z, z, z.view(np.uint64), z
    sub = SubstringHash(data, SYMBOLS)
    place = np.arange(len(data) - GRAM + 1)
    grams = sub.of(place, place + GRAM)
    # the same cut everywhere: of k-grams that agree in the upper half the first is taken, so
    # a string has one least k-gram in whatever slice it stands
    bits = np.uint64(32)
    packed = (grams >> bits << bits) | place.astype(np.uint64)
    least = (_sliding_least(packed, width) & ((np.uint64(1) << bits) - np.uint64(1))).astype(np.int64)
    starts = np.arange(len(least))
    row = np.searchsorted(offsets, starts, "right") - 1
    ok = starts + length <= offsets[row + 1]
    starts, row, least = starts[ok], row[ok], least[ok]
    if not len(starts):
        return z, z, z, z.view(np.uint64), z
    new = np.ones(len(starts), bool)
    new[1:] = (least[1:] != least[:-1]) | (row[1:] != row[:-1])
    first = np.flatnonzero(new)
    n = np.diff(np.append(first, len(starts)))
    begin, at, row = starts[first], least[first], row[first]
    return row, begin - offsets[row], n, grams[at], at - begin


def _runs(batches: Iterator[pa.RecordBatch], length: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        data, offsets = as_bytes(batch.column(2))
        d, t = batch.column(0).to_numpy(), batch.column(1).to_numpy()
        for a, b in slices(offsets):
            part = data[offsets[a] : offsets[b]]
            row, at, n, gram, off = runs_of(part, offsets[a : b + 1] - offsets[a], length)
            lo = at + (offsets[a:b] - offsets[a])[row]
            raw = memoryview(part.tobytes())
            # a run is known by its bytes and the place of its k-gram
            digest = b"".join([blake2b(raw[x:y], digest_size=16, salt=SALT[o]).digest() for x, y, o in zip(lo.tolist(), (lo + n - 1 + length).tolist(), off.tolist())])
            run = np.frombuffer(digest, np.int64).reshape(-1, 2)
            columns = [d[a + row], t[a + row], at.astype(np.int32), n.astype(np.int32), gram.view(np.int64), np.ascontiguousarray(run[:, 0]), np.ascontiguousarray(run[:, 1]), off.astype(np.int32)]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["d", "t", "at", "n", "gram", "run", "run2", "off"])


# ---- collections, column by column -------------------------------------------------------


def repeated_starts(members: list[bytes], counts: list[int], offs: list[int], groups: np.ndarray, length: int) -> list[np.ndarray]:
    """For each member, which of its ``counts`` starts hold a string that another member
    of its group holds at the same distance from the k-gram. ``groups`` ascend.

    Columns are counted from the k-gram; a member that has no byte in a column takes no
    part in it (its suffix there is empty).
    """
    m = len(members)
    reach = max(offs)
    flat = np.frombuffer(b"".join(members), np.uint8)
    size = np.array([len(x) for x in members])
    base = np.concatenate([np.zeros(1, np.int64), np.cumsum(size)])[:-1]
    lead = reach - np.array(offs)  # column of each member's first byte
    count = np.array(counts)
    flags = np.zeros(int(count.sum()), bool)
    flag_base = np.concatenate([np.zeros(1, np.int64), np.cumsum(count)])[:-1]
    order = np.arange(m)  # members by (group, suffix); suffixes start out empty
    common = np.zeros(m, np.int64)  # with the one before, 0 across groups
    group = np.asarray(groups)
    for column in range(int((lead + size).max()) - 1, int(lead.min()) - 1, -1):
        inside = column - lead[order]
        live = (inside >= 0) & (inside < size[order])
        symbol = np.where(live, flat[base[order] + np.clip(inside, 0, size[order] - 1)], 0).astype(np.int64) + live
        key = group[order] * 512 + symbol
        to = np.argsort(key, kind="stable")
        near = np.zeros(m, bool)
        near[1:] = key[to[1:]] == key[to[:-1]]
        at = np.flatnonzero(near)
        lo, hi = to[at - 1], to[at]  # old places of new neighbours with one symbol
        least = common[hi].copy()
        far = hi > lo + 1
        if far.any():
            cut = np.column_stack([lo[far] + 1, np.minimum(hi[far] + 1, m - 1)]).ravel()
            least[far] = np.minimum(np.minimum.reduceat(common, cut)[::2], common[hi[far]])
        now = np.zeros(m, np.int64)
        now[at] = np.where(live[hi], least + 1, 0)
        order, common = order[to], now
        place = column - lead[order]
        start = (place >= 0) & (place < count[order])
        long = common >= length
        twice = long.copy()
        twice[:-1] |= long[1:]
        hit = np.flatnonzero(start & twice)
        flags[flag_base[order[hit]] + place[hit]] = True
    return [flags[b : b + c] for b, c in zip(flag_base.tolist(), counts)]


def _spans(flags: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    edge = np.diff(np.concatenate([[0], flags.astype(np.int8), [0]]))
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)


def _compare(batches: Iterator[pa.RecordBatch], length: int) -> Iterator[pa.RecordBatch]:
    """Members of collections in, sorted by collection; repeated ranges (bytes) of members
    that stand for one place of the table out."""
    rows: list[tuple] = []
    held = 0

    def done(part: list[tuple]) -> pa.RecordBatch:
        group = np.cumsum([i == 0 or r[:3] != part[i - 1][:3] for i, r in enumerate(part)])
        found = repeated_starts([r[9] for r in part], [r[6] for r in part], [r[7] for r in part], group, length)
        d, t, lo, hi = [], [], [], []
        for r, flags in zip(part, found):
            for s, e in zip(*_spans(flags)) if r[8] == 1 else ():
                d.append(r[3]), t.append(r[4]), lo.append(r[5] + int(s)), hi.append(r[5] + int(e) - 1 + length)
        return pa.RecordBatch.from_arrays([pa.array(d, pa.int64()), pa.array(t, pa.int64()), pa.array(lo, pa.int32()), pa.array(hi, pa.int32())], ["d", "t", "lo", "hi"])

    for batch in batches:
        for r in zip(*[batch.column(c).to_pylist() for c in (*GROUP, *KEY, "at", "n", "off", "times", "bytes")]):
            if rows and held > COLUMN_BYTES and r[:3] != rows[-1][:3]:
                yield done(rows)
                rows, held = [], 0
            rows.append(r)
            held += len(r[9])
    if rows:
        yield done(rows)


def _cut_out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Documents with a list of runs in; the runs with their bytes out."""
    names = [*RUN, "n", "off", "times", "bytes"]
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.binary()]
    for batch in batches:
        data, offsets = as_bytes(batch.column("text"))
        raw, at = memoryview(data.tobytes()), offsets.tolist()
        out: list[tuple] = []
        for base, d, t, runs in zip(at, batch.column("d").to_pylist(), batch.column("t").to_pylist(), batch.column("runs").to_pylist()):
            for r in runs:
                lo = base + r["at"]
                out.append((r["gram"], d, t, r["at"], r["n"], r["off"], r["times"], bytes(raw[lo : lo + r["size"]])))
        columns = list(zip(*out)) if out else [()] * len(kinds)
        yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(columns, kinds)], names)


def _blocks(batches: Iterator[pa.RecordBatch], size: int, length: int) -> Iterator[pa.RecordBatch]:
    """Runs, or members of larger blocks, cut into blocks of ``size`` starts. Strings that
    start ``block * size`` to ``(block + 1) * size - 1`` bytes before the k-gram all hold
    the bytes that ``region`` is a hash of; ``same`` is a 128-bit digest of a member."""
    names = [c.split()[0] for c in MEMBERS.split(", ")]
    kinds = [{"int": pa.int32(), "long": pa.int64()}[c.split()[1]] for c in MEMBERS.split(", ")]
    for batch in batches:
        out = []
        for gram, d, t, start, at, n, off, times, raw in zip(*[batch.column(c).to_pylist() for c in (*RUN, "at", "n", "off", "times", "bytes")]):
            k = 0
            while k < n:
                block = (off - k) // size
                last = min(n - 1, off - block * size)  # the block's start nearest to the k-gram
                lo, hi = off - block * size, off + length - (block * size + size - 1)
                region = int.from_bytes(blake2b(raw[lo:hi], digest_size=8).digest(), "little", signed=True)
                same = blake2b(raw[k : last + length], digest_size=16).digest()
                out.append((gram, block, region, last - k + 1, off - k, int.from_bytes(same[:8], "little", signed=True), int.from_bytes(same[8:], "little", signed=True), d, t, start, at + k, times))
                k = last + 1
        columns = list(zip(*out)) if out else [()] * len(kinds)
        yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(columns, kinds)], names)


def _shared_ranges(texts: DataFrame, length: int) -> DataFrame:
    """Repeated ranges ``d, t, lo, hi`` of different runs that share a k-gram; the written
    table ``texts`` has each different run once, with its bytes and the times it occurs."""
    spark = texts.sparkSession
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    runs, found = texts.withColumn("at", F.col("start")), None
    for level, size in enumerate(BLOCKS_OF):
        cut = stored(spark, runs.mapInArrow(lambda it, size=size: _blocks(it, size, length), MEMBERS), "blocks")
        # equal members are one; a place is kept where there is only one
        alike = cut.groupBy(*ALIKE).agg(F.sum("times").alias("times"), F.min(F.struct(*KEY, "start", "at")).alias("one"), F.count("*").alias("rows"))
        members = stored(spark, alike.select(*ALIKE, "one.*", "times", "rows"), "members")
        sure = join_hot(cut.filter("times = 1"), members.filter("rows > 1").select(*ALIKE, "rows"), ALIKE, "rows")
        sure = sure.select(*KEY, F.col("at").alias("lo"), (F.col("at") + F.col("n") - 1 + length).alias("hi"))
        sizes = members.groupBy(*GROUP).agg(F.count("*").alias("members"), F.min("times").alias("least")).filter("members > 1 and least = 1")
        sizes = stored(spark, sizes.select(*GROUP, "members"), "collections")
        open_ = stored(spark, members.join(sizes, GROUP).drop("rows"), "open-members")
        full = F.col("members") > FULL if level + 1 < len(BLOCKS_OF) else F.lit(False)
        # only now the bytes
        whole = texts.select(*RUN, F.col("bytes"))
        bytes_ = F.expr(f"substring(bytes, at - start + 1, n - 1 + {length})").alias("bytes")
        fits = open_.filter(~full).join(whole, RUN).select(*GROUP, *KEY, "at", "n", "off", "times", bytes_)
        fits = fits.repartition(tasks, *GROUP).sortWithinPartitions(*GROUP)
        now = sure.union(fits.mapInArrow(lambda it: _compare(it, length), "d long, t long, lo int, hi int"))
        found = now if found is None else found.union(now)
        rest = open_.filter(full)
        if rest.isEmpty():
            break
        runs = rest.join(whole, RUN).select(*RUN, "at", "n", "off", "times", bytes_)
    return found


def repeated_ranges(docs: DataFrame, length: int) -> DataFrame:
    """``d, t, lo, hi``: byte ranges covered by repeated strings, for each row key of
    ``docs(d, t, text)``, which is read twice (see ``keyed``)."""
    spark = docs.sparkSession
    runs = stored(spark, docs.mapInArrow(lambda it: _runs(it, length), RUNS), "runs")
    # most k-grams occur once; what follows is about the others
    grams = stored(spark, runs.groupBy("gram").agg(F.count("*").alias("runs")).filter("runs > 1"), "shared-grams")
    every = runs
    runs = stored(spark, join_hot(every, grams, ["gram"], "runs"), "shared-runs")
    discard(every, grams)
    same = ["gram", "run", "run2"]
    kinds = runs.groupBy(*same).agg(F.count("*").alias("times"), F.min(F.struct(*KEY, "at", "n", "off")).alias("one"))
    kinds = stored(spark, kinds, "run-kinds")
    whole = join_hot(runs, kinds.filter("times > 1").select(*same, "times"), same, "times")
    whole = whole.select(*KEY, F.col("at").alias("lo"), (F.col("at") + F.col("n") - 1 + length).alias("hi"))
    mixed = stored(spark, kinds.groupBy("gram").agg(F.count("*").alias("kinds"), F.min("times").alias("least")).filter("kinds > 1 and least = 1"), "mixed-grams")
    asked = join_hot(kinds, mixed, ["gram"], "kinds").select("one.*", "gram", "times", (F.col("one.n") - 1 + length).alias("size"))
    asked = stored(spark, asked.groupBy(*KEY).agg(F.collect_list(F.struct("gram", "at", "n", "off", "times", "size")).alias("runs")), "asked")
    texts = docs.join(asked, KEY).mapInArrow(_cut_out, "gram long, d long, t long, start int, n int, off int, times long, bytes binary")
    # a repeated row of the table gives its runs again
    texts = stored(spark, texts.dropDuplicates(RUN), "run-texts")
    discard(asked, mixed)
    return whole.union(_shared_ranges(texts, length))


def _remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        data, offsets = as_bytes(batch.column("text"))
        raw, at = data.tobytes(), offsets.tolist()
        n_bytes, removed, spans, digest = [], [], [], []
        for i, ranges in enumerate(batch.column("ranges").to_pylist()):
            text = raw[at[i] : at[i + 1]]
            pieces, end, cut, n = [], 0, 0, 0
            for r in ranges or ():  # sorted by lo
                if r["lo"] > end or n == 0:
                    pieces.append(text[end : r["lo"]])
                    n += 1
                    cut += r["hi"] - r["lo"]
                    end = r["hi"]
                elif r["hi"] > end:
                    cut += r["hi"] - end
                    end = r["hi"]
            pieces.append(text[end:])
            n_bytes.append(len(text)), removed.append(cut), spans.append(n)
            digest.append(hashlib.sha256(b"".join(pieces)).hexdigest())
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), pa.array(n_bytes, pa.int64()), pa.array(removed, pa.int64()), pa.array(spans, pa.int64()), pa.array(digest, pa.string())],
            ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"],
        )


def keyed(docs: DataFrame) -> DataFrame:
    """``d, t, doc_id, text``: rows that repeat both id and text share their key, and so
    their ranges."""
    text = F.coalesce(F.col("text"), F.lit(""))
    key = F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 63)))
    return docs.select(key.alias("d"), F.xxhash64(text, F.col("doc_id").isNull()).alias("t"), F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"))


def remove_repeats(docs: DataFrame, length: int = 200) -> DataFrame:
    """One row per row of ``docs(doc_id, text)``: ``doc_id, n_bytes, n_removed, n_spans,
    kept_sha256``.

    Null text is empty; rows that repeat one another are copies, and both lose what they
    share; texts under ``length`` bytes lose nothing; an empty table gives no rows; other
    columns are not read.
    """
    spark = docs.sparkSession
    tune(spark)
    rows = keyed(docs)
    ranges = repeated_ranges(rows.select(*KEY, "text"), length)
    # whole runs and starts overlap; ranges of a text are no more than its bytes
    ranges = ranges.groupBy(*KEY).agg(F.array_sort(F.collect_set(F.struct("lo", "hi"))).alias("ranges"))
    return rows.join(ranges, KEY, "left").mapInArrow(_remove, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")
