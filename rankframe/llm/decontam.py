"""Benchmark decontamination by template canonicalisation.

Texts become token sequences in which numbers, units after numbers, and names are typed
placeholders; neighbouring placeholders of one type are one. Windows of ``WINDOW`` tokens
are hashed in two families, with names as placeholders and with names as plain words (a
copy may have lost its capitals). Spark joins the windows of documents and of benchmark
items by hash. The matched windows of a pair of document and item are parted into
occurrences by their diagonals. Each occurrence gives the covered share of the item, the
longest run along one diagonal, and pairs of slot values: each of the item's slots must
have one value in the occurrence, which a re-parameterised copy does and an accidental
mixture does not; a verbatim stretch passes without that. All windows of the pair
together count as well, where each of the item's values must map to one value of the
document, so that a copy in scattered pieces is found. The best of these decides.

Items of fewer than ``WINDOW`` but at least ``SHORTEST`` tokens are one window of their
own length; shorter items are not searched for.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from rankframe.llm.common import SYMBOLS_FOLDED, SubstringHash, as_bytes, mix, slices, stored, tune

WINDOW, SHORTEST = 8, 4
#: A pair is contaminated if this share of the item's windows, or a run of this many
#: tokens, is matched, and this share of its slot values is consistent.
MIN_COVERAGE, MIN_RUN, MIN_CONSISTENT = 0.3, 13, 0.75
#: Diagonals of one occurrence follow each other within this many tokens, and a quarter of the item.
MAX_SHIFT = 8
#: Window hashes of benchmark items sent to tasks at once; more are searched in blocks.
BLOCK = 1_000_000

#: Units that may follow a number, and names that may begin a sentence.
UNITS = """mm cm m km inch inches foot feet yard yards mile miles g kg mg gram grams kilogram kilograms lb lbs pound pounds ounce
ounces ton tons l ml liter liters litre litres gallon gallons second seconds sec minute minutes min hour hours h day days week weeks
month months year years dollar dollars cent cents euro euros usd eur gbp percent degrees degree celsius fahrenheit mph kmh volts volt
watt watts kw kwh joule joules newton newtons hz khz mhz ghz kb mb gb tb""".split()
NAMES = """john mary james robert michael william david sarah anna emma alice bob tom jane peter paul mark lisa laura maria jose juan carlos
ana hans klaus anja pierre marie jean luc sophie emily jack harry george oliver lucy kate daniel samuel ben max leo nina eva olivia noah
liam mia ethan jacob sam tim jim joe sally susan linda karen betty nancy helen""".split()

NUMBER, UNIT, NAME = 1, 2, 3
_HASH = {k: np.uint64(0xA5A5000000000000 + k) for k in (NUMBER, UNIT, NAME)}
_CLASS = np.zeros(256, np.int8)  # 1 letter, 2 digit
_CLASS[48:58] = 2
_CLASS[65:91] = _CLASS[97:123] = 1
_CLASS[128:] = 1
_LOWER = {c: c + 32 for c in range(65, 91)}


def _word_hashes(words: list[str]) -> np.ndarray:
    raw = [w.encode() for w in words]
    at = np.concatenate([[0], np.cumsum([len(w) for w in raw])])
    return np.unique(SubstringHash(np.frombuffer(b"".join(raw), np.uint8), SYMBOLS_FOLDED).of(at[:-1], at[1:]))


UNIT_HASHES, NAME_HASHES = _word_hashes(UNITS), _word_hashes(NAMES)


class Tokens:
    """Canonical tokens of the rows of a slice, one family: hash, type (0: plain), row,
    and byte range."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, names: bool):
        kind = _CLASS[data]
        first = np.zeros(len(data) + 1, bool)
        first[offsets[:-1]] = True
        begin = kind > 0
        begin[1:] &= (kind[1:] != kind[:-1]) | first[1:-1]
        start = np.flatnonzero(begin)
        end_mark = kind > 0
        end_mark[:-1] &= (kind[1:] != kind[:-1]) | first[1:-1]
        end = np.flatnonzero(end_mark) + 1
        row = np.searchsorted(offsets, start, "right") - 1
        h = SubstringHash(data, SYMBOLS_FOLDED).of(start, end)
        typed = np.where(kind[start] == 2, NUMBER, 0) if len(start) else np.zeros(0, np.int64)
        same = np.zeros(len(start), bool)
        same[1:] = row[1:] == row[:-1]
        after_number = same.copy()
        after_number[1:] &= typed[:-1] == NUMBER
        typed = np.where(after_number & (typed == 0) & np.isin(h, UNIT_HASHES), UNIT, typed)
        if names and len(start):
            upper = (data >= 65) & (data <= 90)
            ups = np.concatenate([[0], np.cumsum(upper)])
            capital = upper[start] & (ups[end] - ups[start] == 1) & (end - start >= 2)
            stop = np.concatenate([[0], np.cumsum(np.isin(data, (10, 33, 46, 63)))])
            inner = same.copy()
            inner[1:] &= stop[start[1:]] == stop[end[:-1]]  # no sentence end in between
            typed = np.where((typed == 0) & ((capital & inner) | (upper[start] & np.isin(h, NAME_HASHES))), NAME, typed)
        for k, v in _HASH.items():
            h = np.where(typed == k, v, h)
        more = same & (typed > 0)
        more[1:] &= typed[1:] == typed[:-1]  # goes on with the placeholder before
        head = np.flatnonzero(~more)
        last = np.append(head[1:], len(start)) - 1
        self.hash, self.type, self.row, self.start = h[head], typed[head], row[head], start[head]
        self.end = end[last] if len(head) else end

    def windows(self, size: int) -> tuple[np.ndarray, np.ndarray]:
        """First tokens and hashes of all windows of ``size`` tokens inside a row."""
        m = len(self.hash) - size + 1
        if m <= 0:
            return np.zeros(0, np.int64), np.zeros(0, np.uint64)
        at = np.flatnonzero(self.row[:m] == self.row[size - 1 :])
        key = np.full(len(at), np.uint64(size))
        for j in range(size):
            key = mix(key ^ self.hash[at + j])
        return at, key

    def canon(self, at: int, size: int, data: np.ndarray) -> str:
        """The window's tokens, placeholders by type; windows are equal if these are."""
        return " ".join([f"<{t}>" if t else bytes(data[a:b]).decode("utf-8", "replace").translate(_LOWER) for t, a, b in zip(self.type[at : at + size].tolist(), self.start[at : at + size].tolist(), self.end[at : at + size].tolist())])

    def slots(self, at: int, size: int, data: np.ndarray) -> list[str]:
        """Places in the window and typed values of its placeholders in order."""
        which = at + np.flatnonzero(self.type[at : at + size])
        return [f"{i - at}:{self.type[i]}:" + bytes(data[self.start[i] : self.end[i]]).decode("utf-8", "replace").lower() for i in which.tolist()]


WINDOWS = "key long, family int, size int, at int, h long, lo int, hi int, slots array<string>, tokens int, canon string"


def _emit(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.int32(), pa.int32(), pa.list_(pa.string()), pa.int32(), pa.string()]
    columns = list(zip(*rows)) if rows else [()] * len(kinds)
    return pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(columns, kinds)], ["key", "family", "size", "at", "h", "lo", "hi", "slots", "tokens", "canon"])


def _windows(batches: Iterator[pa.RecordBatch], wanted: dict[int, np.ndarray] | None) -> Iterator[pa.RecordBatch]:
    """Windows of each row: all of them, or for documents those with a wanted hash (by size)."""
    for batch in batches:
        data, offsets = as_bytes(batch.column(1))
        keys = batch.column(0).to_numpy()
        for a, b in slices(offsets):
            part, at = data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]
            out = []
            for family in (0, 1):
                t = Tokens(part, at, names=family == 1)
                count = np.bincount(t.row, minlength=b - a)
                first = np.cumsum(count) - count
                for size in sorted(wanted) if wanted is not None else range(SHORTEST, WINDOW + 1):
                    place, h = t.windows(size)
                    if wanted is None:  # an item's windows have the full size, or its own
                        ok = (size == WINDOW) | (count[t.row[place]] == size)
                        place, h = place[ok], h[ok]
                    else:
                        near = wanted[size]
                        ok = near[np.minimum(np.searchsorted(near, h), len(near) - 1)] == h
                        place, h = place[ok], h[ok]
                    for p, x in zip(place.tolist(), h.view(np.int64).tolist()):
                        r = int(t.row[p])
                        out.append((int(keys[a + r]), family, size, p - int(first[r]), x, int(t.start[p] - at[r]), int(t.end[p + size - 1] - at[r]), t.slots(p, size, part), int(count[r]), t.canon(p, size, part)))
            yield _emit(out)


def matched_pairs(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Pairs of ``docs(dk, text)`` and ``benchmark(item_id, text)`` with a window in
    common: ``dk, item_id, coverage, run_tokens, consistent, n_slots, lo, hi`` (bytes).
    ``dk`` numbers texts with their ids, as items are numbered here (see ``_keyed``), so
    that rows which repeat one another count once."""
    spark = docs.sparkSession
    tune(spark)
    once = ["key", "family", "size", "at"]
    named = _keyed(benchmark.select(F.col("item_id").cast("long").alias("item_id"), "text"), "ik", "item_id")
    items = named.select(F.col("ik").alias("key"), F.coalesce(F.col("text"), F.lit("")).alias("text"))
    items = stored(spark, items.mapInArrow(lambda it: _windows(it, None), WINDOWS).dropDuplicates(once), "item-windows")
    keys = items.select("size", "h").distinct()
    blocks = max(1, -(-keys.count() // BLOCK))
    found = None
    for block in range(blocks):
        some = keys.filter(F.pmod(F.xxhash64("h"), F.lit(blocks)) == block).collect()  # about BLOCK rows
        wanted = {s: np.sort(np.array([r[1] for r in some if r[0] == s], np.int64).view(np.uint64)) for s in {r[0] for r in some}}
        if not wanted:
            wanted = {WINDOW: np.zeros(1, np.uint64)}
        sent = spark.sparkContext.broadcast(wanted)
        part = docs.mapInArrow(lambda it, sent=sent: _windows(it, sent.value), WINDOWS)
        found = part if found is None else found.union(part)
    # a repeated row of the table gives its windows again
    found = stored(spark, found.dropDuplicates(once), "matched-windows")
    same = ["family", "size", "h", "canon"]
    mine = items.select(F.col("key").alias("ik"), *same, F.col("at").alias("item_at"), F.col("slots").alias("item_slots"), F.col("tokens").alias("item_tokens"))
    theirs = found.select(F.col("key").alias("dk"), *same, "at", "lo", "hi", "slots")
    pairs = stored(spark, _candidates(theirs, mine), "candidate-pairs")
    hits = pairs.join(mine, ["ik", "family"]).join(theirs, ["dk", *same])
    hits = stored(spark, hits, "window-hits")
    pair = ["dk", "ik"]
    group = [*pair, "family", "occ"]
    steps = _occurrences(hits.withColumn("diagonal", F.col("at") - F.col("item_at")).withColumn("same", F.col("slots") == F.col("item_slots")))
    covered = steps.groupBy(*group).agg(F.count_distinct("item_at").alias("n"), F.count_distinct(F.when(F.col("same"), F.col("item_at"))).alias("n_same"), F.first("item_tokens").alias("tokens"), F.min("lo").alias("lo"), F.max("hi").alias("hi"))
    share = lambda n: F.col(n) / F.greatest(F.lit(1), F.col("tokens") - WINDOW + 1)
    covered = covered.withColumn("coverage", share("n")).withColumn("same_coverage", share("n_same"))
    runs = _runs(steps, group, "run").join(_runs(steps.filter("same"), group, "same_run"), group, "left")
    each = steps.select(*group, "item_at", F.explode(F.arrays_zip("item_slots", "slots")).alias("s"))
    place = F.substring_index("s.item_slots", ":", 1)
    value = lambda c: F.expr(f"substring({c}, locate(':', {c}) + 1)")
    each = each.select(*group, (F.col("item_at") + place.cast("int")).alias("place"), value("s.item_slots").alias("item_value"), value("s.slots").alias("value"))
    values = each.groupBy(*group, "item_value").agg(F.count_distinct("value").alias("kinds"))
    values = values.groupBy(*group).agg(F.avg((F.col("kinds") == 1).cast("double")).alias("consistent"), F.count("*").alias("n_slots"))
    places = each.groupBy(*group, "place").agg(F.count_distinct("value").alias("kinds")).groupBy(*group).agg(F.avg((F.col("kinds") == 1).cast("double")).alias("at_places"))
    both = covered.join(runs, group).join(values, group, "left").join(places, group, "left")
    both = both.withColumns({"consistent": F.coalesce("consistent", F.lit(1.0)), "n_slots": F.coalesce("n_slots", F.lit(0)), "at_places": F.coalesce("at_places", F.lit(1.0)), "same_run": F.coalesce("same_run", F.lit(0))})
    enough = (F.col("coverage") >= MIN_COVERAGE) | (F.col("run") >= MIN_RUN)
    verbatim = (F.col("same_coverage") >= MIN_COVERAGE) | (F.col("same_run") >= MIN_RUN)
    slots_fit = F.when(F.col("occ") < 0, F.col("consistent")).otherwise(F.col("at_places")) >= MIN_CONSISTENT
    both = both.withColumn("contaminated", (enough & slots_fit) | ((F.col("occ") >= 0) & verbatim))
    # the best occurrence, in the better family of the two
    best = both.groupBy(*pair).agg(F.max(F.struct("contaminated", "coverage", "run", "consistent", "n_slots", "lo", "hi")).alias("b"))
    best = best.join(named.select("ik", "item_id").distinct(), "ik")
    return best.select("dk", "item_id", "b.coverage", F.col("b.run").cast("long").alias("run_tokens"), "b.consistent", "b.n_slots", "b.lo", "b.hi", "b.contaminated")


def _candidates(theirs: DataFrame, mine: DataFrame) -> DataFrame:
    """``dk, ik, family`` of every pair that can reach the share or the run.

    Such a pair has at least ``need`` of the item's windows in common, and so at least one
    of its ``windows - need + 1`` rarest ones: only those bring pairs together. A phrase
    that many items and many documents share joins nothing by itself, unless one window is
    all that an item needs.
    """
    same = ["family", "size", "h", "canon"]
    often = theirs.groupBy(*same).agg(F.count("*").alias("times"))
    rare = mine.join(often, same, "left").withColumn("times", F.coalesce("times", F.lit(0)))
    windows = F.count("*").over(Window.partitionBy("ik", "family"))
    need = F.greatest(F.lit(1), F.least(F.ceil(MIN_COVERAGE * F.col("windows") - 1e-6), F.lit(MIN_RUN - WINDOW + 1)))
    nth = F.row_number().over(Window.partitionBy("ik", "family").orderBy("times", "item_at"))
    rare = rare.withColumn("windows", windows).withColumn("nth", nth).filter(F.col("nth") <= F.col("windows") - need + 1).filter("times > 0")
    return theirs.join(rare.select("ik", *same).distinct(), same).select("dk", "ik", "family").distinct()


def _occurrences(hits: DataFrame) -> DataFrame:
    """Hits by occurrence ``occ``: those of a pair whose diagonals follow each other within
    a few tokens, for each place of the item the one on the diagonal with the most hits.
    All hits of the pair together are occurrence -1."""
    group = ["dk", "ik", "family"]
    line = Window.partitionBy(*group).orderBy("diagonal")
    slack = F.least(F.lit(MAX_SHIFT), F.floor(F.col("item_tokens") / 4))
    parts = hits.withColumn("apart", F.coalesce((F.col("diagonal") - F.lag("diagonal").over(line) > slack).cast("int"), F.lit(0)))
    parts = parts.withColumn("occ", F.sum("apart").over(line.rowsBetween(Window.unboundedPreceding, Window.currentRow)).cast("int")).drop("apart")
    parts = parts.withColumn("strength", F.count("*").over(Window.partitionBy(*group, "occ", "diagonal")))
    best = Window.partitionBy(*group, "occ", "item_at").orderBy(F.desc("strength"), "diagonal")
    parts = parts.withColumn("nth", F.row_number().over(best)).filter("nth = 1").drop("strength", "nth")
    return parts.unionByName(hits.withColumn("occ", F.lit(-1)))


def _runs(steps: DataFrame, group: list[str], name: str) -> DataFrame:
    """Tokens of the longest run of hits along one diagonal."""
    line = Window.partitionBy(*group, "diagonal").orderBy("item_at")
    blocks = steps.withColumn("block", F.col("item_at") - F.row_number().over(line)).groupBy(*group, "diagonal", "block").agg((F.count("*") + F.max("size") - 1).alias("run"))
    return blocks.groupBy(*group).agg(F.max("run").alias(name))


def _keyed(table: DataFrame, key: str, id: str) -> DataFrame:
    """Adds ``key``, which numbers (id, text) pairs; defined for null ids as well."""
    return table.withColumn(key, F.xxhash64(id, "text"))


def _pairs(rows: DataFrame, benchmark: DataFrame) -> DataFrame:
    texts = rows.select(F.col("__rf_dk").alias("dk"), F.coalesce("text", F.lit("")).alias("text"))
    return matched_pairs(texts, benchmark).filter("contaminated").drop("contaminated")


def contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Contaminated pairs ``doc_id, item_id, coverage, run_tokens, consistent, n_slots,
    lo, hi`` (``lo``, ``hi``: bytes of the document from the first to the last match).

    Null texts have no tokens and match nothing; rows that repeat one another, on either
    side, give one pair; an item without id gives pairs with a null ``item_id``; an empty
    table on either side gives no rows.
    """
    rows = _keyed(docs.select("doc_id", "text"), "__rf_dk", "doc_id")
    ids = rows.select(F.col("__rf_dk").alias("dk"), F.col("doc_id").cast("long").alias("doc_id"))
    found = _pairs(rows, benchmark).join(ids, "dk").drop("dk")
    return found.select("doc_id", "item_id", "coverage", "run_tokens", "consistent", "n_slots", "lo", "hi").dropDuplicates(["doc_id", "item_id", "lo", "hi"])


def drop_contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of ``docs`` without a contaminated pair, with all their columns.

    Null and empty texts stay; rows that repeat one another stay or go together; an empty
    ``docs`` gives no rows, an empty ``benchmark`` drops none. A column of ``docs`` named
    ``__rf_dk`` isn't allowed.
    """
    rows = _keyed(docs, "__rf_dk", "doc_id")
    bad = _pairs(rows, benchmark).select(F.col("dk").alias("__rf_dk")).distinct()
    return rows.join(bad, "__rf_dk", "left_anti").select(*docs.columns)
