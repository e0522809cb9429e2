"""Cross-tokenizer alignment: which tokens of two tokenizers cover the same bytes.

A text's two encodings are cut into groups where tokens of both end; an A and a B token are
linked where their bytes overlap. How many documents hold an id pair is counted in external
memory:

* *spill* a task gathers the distinct pairs of its documents; each ``SPILL`` records, or at
  the end, they are a chunk: its pairs, with their number of documents, are dealt by the A
  id's radix and leave as sorted zstd runs, one for each radix part;
* *merge* a part's runs are merged by a heap over their next A ids. All of an A id's pairs
  meet, so its counts and their maximum are known there, and go back, in the order of each
  run, to the chunks that the runs came from;
* *sum* a chunk adds up what came back over its documents' links.

A pair has at most one record a chunk, however many documents hold it, so no key is hot.

Both encodings of a text are the encodings of its pieces that begin at a space after a
character that isn't white: neither tokenizer has an entry that reaches over such a place.
Pieces are encoded, aligned and remembered by their text.
"""

from __future__ import annotations

import hashlib
import heapq
import os
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from rankframe.llm.common import as_bytes, discard, slices, stored, tune

#: Records (a document's distinct pairs) in a chunk, and documents in one.
SPILL, SPILL_DOCS = 4_000_000, 100_000
#: Records in a block of a run, and characters of text worked on at a time.
BLOCK, PART = 1 << 16, 1 << 20
#: Pieces remembered by a task, in two generations: those not asked for in one are forgotten.
PIECES = 300_000
LONGEST = 256

_CUT = re.compile(r"(?<=\S)(?= )")
_ODD = re.compile(r"\s |^ | $")


# ---- encoding and alignment ---------------------------------------------------------------


def byte_letters() -> dict[str, int]:
    """The byte that each letter of a byte-level vocabulary stands for: printable Latin-1
    characters for themselves, the others for code points from 256 on."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in own]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(rest)}


class Aligner:
    """Both tokenizers; ``known[piece]`` has links, groups and counts of `` piece``."""

    def __init__(self, a_path: str, b_path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(a_path)
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=b_path)
        letters = byte_letters()
        named = {i: bytes(letters.get(c, 63) for c in token) for token, i in self.a.get_vocab().items()}
        self.a_bytes = [named.get(i, b"") for i in range(max(named) + 1)]
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.b_bytes = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)]
        self.a_size, self.b_size = (np.array([len(x) for x in table], np.int64) for table in (self.a_bytes, self.b_bytes))
        # an id in decimal, and what follows it: a token, the other side, a group, a piece
        self.decimal = np.array([[f"{i}{c}".encode() for c in ",|;\n"] for i in range(max(len(self.a_bytes), len(self.b_bytes)))], object)
        self.space = self.b.piece_to_id("▁")
        self.known: dict[str, tuple[bytes, bytes, bytes]] = {}
        self.before: dict[str, tuple[bytes, bytes, bytes]] = {}
        self.long: list[str] = []

    def ids(self, pieces: list[str]) -> tuple[list[list[int]], list[list[int]]]:
        a = [e.ids for e in self.a.encode_batch_fast([" " + p for p in pieces], add_special_tokens=False)]
        return a, [ids or [self.space] for ids in self.b.encode(pieces, num_threads=1)]

    def align(self, pieces: list[str], a: list[list[int]], b: list[list[int]]) -> Iterator[tuple[bytes, bytes, bytes]]:
        """For each piece the links as packed ``a << 32 | b``, the groups' string, and packed
        numbers of A and B tokens, groups, and 1 if the bytes differ from the text's."""
        whole = [(" " + p).encode() for p in pieces]
        bad = np.array([b"".join([self.a_bytes[i] for i in x]) != w or b"".join([self.b_bytes[i] for i in y]) != w for x, y, w in zip(a, b, whole)])
        if bad.any():
            good = self.align([p for p, x in zip(pieces, bad) if not x], [x for x, y in zip(a, bad) if not y], [x for x, y in zip(b, bad) if not y]) if not bad.all() else iter(())
            nothing = b"", b"", np.array([0, 0, 0, 1], np.int64).tobytes()
            yield from (nothing if x else next(good) for x in bad)
            return
        n_a, n_b = np.array(list(map(len, a)), np.int64), np.array(list(map(len, b)), np.int64)
        a_ids, b_ids = np.array([i for x in a for i in x], np.int64), np.array([i for x in b for i in x], np.int64)
        a_end, b_end = np.cumsum(self.a_size[a_ids]), np.cumsum(self.b_size[b_ids])
        piece_end = a_end[np.cumsum(n_a) - 1]
        ends = np.union1d(a_end, b_end)  # every stretch between ends belongs to one token of each
        links = (a_ids[np.searchsorted(a_end, ends)] << 32 | b_ids[np.searchsorted(b_end, ends)]).tobytes()
        link_cut = (8 * np.concatenate([[0], np.searchsorted(ends, piece_end, "right")])).tolist()
        both = np.intersect1d(a_end, b_end, assume_unique=True)
        n_groups = np.diff(np.concatenate([[0], np.searchsorted(both, piece_end, "right")]))
        # tokens by group, A before B; a token that ends a side, a group or a piece says so
        group = np.concatenate([2 * np.searchsorted(both, a_end), 2 * np.searchsorted(both, b_end) + 1])
        order = np.argsort(group, kind="stable")
        ids, group = np.concatenate([a_ids, b_ids])[order], group[order]
        ends_side = np.append(group[1:] != group[:-1], True)
        mark = np.where(ends_side, 1 + group % 2, 0)
        mark[np.searchsorted(group, 2 * np.searchsorted(both, piece_end) + 1, "right") - 1] = 3
        strings = b"".join(self.decimal[ids, mark].tolist()).split(b"\n")
        counts = np.stack([n_a, n_b, n_groups, np.zeros_like(n_a)], axis=1).tobytes()
        for k in range(len(pieces)):
            yield links[link_cut[k] : link_cut[k + 1]], strings[k], counts[32 * k : 32 * k + 32]

    def learn(self, pieces: set[str]) -> None:
        """Afterwards ``known`` has all of ``pieces``."""
        if len(self.known) + len(pieces) > PIECES:
            self.before, self.known = self.known, {p: self.known[p] for p in pieces if p in self.known}
        new = []
        for p in pieces.difference(self.known):
            if p in self.before:
                self.known[p] = self.before[p]
            else:
                new.append(p)
        if new:
            self.known.update(zip(new, self.align(new, *self.ids(new))))
            self.long += [p for p in new if len(p) > LONGEST]

    def forget_long(self) -> None:
        for p in self.long:
            self.known.pop(p, None)
        self.long = []


def text_parts(text: str) -> Iterator[list[str]]:
    """Pieces of space + text without their first space, in lists of about ``PART`` characters."""
    at = 0
    while at <= len(text):
        cut = _CUT.search(text, at + PART)
        end = cut.start() if cut else len(text)
        part = text[at:end]
        yield [p[1:] for p in _CUT.split(" " + part)] if _ODD.search(part) else part.split(" ")
        at = end + 1


@lru_cache(maxsize=2)
def aligner(a_path: str, b_path: str) -> Aligner:
    return Aligner(a_path, b_path)


#: Links of a text, the numbers of its A and B tokens and groups, and the digest of its groups.
Links = tuple[np.ndarray, np.ndarray, str]


def text_links(enc: Aligner, texts: list[str | None]) -> Iterator[Links]:
    """Links of texts of about ``PART`` characters together, or of a longer one; nothing for
    a text without tokens."""
    nothing = np.zeros(0, np.int64), np.zeros(3, np.int64), ""
    heads = [t.split(" ") if t and len(t) <= PART and not _ODD.search(t) else () for t in texts]
    enc.learn(set().union(*heads))
    for text, head in zip(texts, heads):
        links, counts, digest = [], np.zeros(4, np.int64), hashlib.sha256()
        for k, part in enumerate([head] if head else text_parts(text) if text else ()):
            if not head:
                enc.learn(set(part))
            found, groups, numbers = zip(*map(enc.known.__getitem__, part))
            digest.update((b";" if k else b"") + b";".join(groups))
            links.append(b"".join(found))
            counts += np.frombuffer(b"".join(numbers), np.int64).reshape(-1, 4).sum(axis=0)
        if text and not counts[3]:
            yield np.frombuffer(b"".join(links), np.int64), counts[:3], digest.hexdigest()
        else:
            yield nothing
    enc.forget_long()


# ---- packed arrays ------------------------------------------------------------------------


def packed(x: np.ndarray) -> bytes:
    """zstd of an array's bytes, least bytes of all numbers first."""
    import zstandard

    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(x.view(np.uint8).reshape(len(x), x.itemsize).T).tobytes())


def unpacked(data: bytes, dtype: type) -> np.ndarray:
    import zstandard

    raw, width = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8), np.dtype(dtype).itemsize
    return np.ascontiguousarray(raw.reshape(width, len(raw) // width).T).view(dtype).ravel()


def _deltas(x: np.ndarray) -> np.ndarray:
    return np.diff(x, prepend=0)


def _rank(n_pairs: list[int]) -> np.ndarray:
    """For every record, its document's rank among those with records: with a multiple of it
    added, records' places rise over all documents by less than two chunks' pairs a step."""
    some = np.array([n for n in n_pairs if n], np.int64)
    return np.repeat(np.arange(len(some)), some)


# ---- spill --------------------------------------------------------------------------------

CHUNKS = (
    "chunk long, part int, block int, keys binary, counts binary, doc_id array<long>, n_a array<long>, n_b array<long>, n_groups array<long>, n_links array<long>, "
    "groups array<string>, n_pairs array<long>, places binary, times binary, parts binary"
)
_TYPES = [pa.int64(), pa.int32(), pa.int32(), pa.binary(), pa.binary(), *[pa.list_(pa.int64())] * 5, pa.list_(pa.string()), pa.list_(pa.int64()), *[pa.binary()] * 3]
_NAMES = [c.split()[0] for c in CHUNKS.split(", ")]


class Chunk:
    """Documents and their distinct pairs until they are spilled."""

    def __init__(self):
        self.rows, self.pairs, self.times, self.size = [], [], [], 0

    def add(self, doc_id: int | None, links: np.ndarray, counts: np.ndarray, digest: str) -> None:
        pairs, times = np.unique(links, return_counts=True)
        self.rows.append((doc_id, *counts.tolist(), len(links), digest, len(pairs)))
        self.pairs.append(pairs)
        self.times.append(times.astype(np.uint32))
        self.size += len(pairs)

    def full(self, spill: int) -> bool:
        return self.size >= spill or len(self.rows) >= SPILL_DOCS

    def spill(self, chunk: int, parts: int) -> Iterator[pa.RecordBatch]:
        """The chunk's runs, a row for each block of one, and one row of its documents."""
        pairs, places = np.unique(np.concatenate(self.pairs), return_inverse=True)
        n_docs = np.bincount(places, minlength=len(pairs)).astype(np.uint32)
        part = ((pairs >> 32) % parts).astype(np.uint16 if parts <= 1 << 16 else np.uint32)
        order = np.argsort(part, kind="stable")
        cuts = np.searchsorted(part[order], np.arange(parts + 1))
        for p in range(parts):
            run = order[cuts[p] : cuts[p + 1]]
            for k in range(0, len(run), BLOCK):
                at = run[k : k + BLOCK]
                yield self.row(chunk, p, k // BLOCK, packed(_deltas(pairs[at])), packed(n_docs[at]), *[None] * 10)
        deltas = _deltas(places.astype(np.int64) + _rank([r[-1] for r in self.rows]) * len(pairs)).astype(np.uint32)
        yield self.row(chunk, None, None, None, None, *map(list, zip(*self.rows)), packed(deltas), packed(np.concatenate(self.times)), packed(part))

    @staticmethod
    def row(*values: object) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(values, _TYPES)], _NAMES)


def _spill(batches: Iterator[pa.RecordBatch], a_path: str, b_path: str, parts: int, spill: int) -> Iterator[pa.RecordBatch]:
    enc, chunk, n = aligner(a_path, b_path), Chunk(), TaskContext.get().partitionId() << 32
    for batch in batches:
        ids, cut = batch.column(0).to_pylist(), as_bytes(batch.column(1))[1]
        for a, b in slices(cut, PART):
            for doc_id, found in zip(ids[a:b], text_links(enc, batch.column(1).slice(a, b - a).to_pylist())):
                chunk.add(doc_id, *found)
                if chunk.full(spill):
                    yield from chunk.spill(n, parts)
                    chunk, n = Chunk(), n + 1
    if chunk.rows:
        yield from chunk.spill(n, parts)


# ---- merge --------------------------------------------------------------------------------


class Run:
    """A chunk's run of one part: its A ids in order, each with its pairs and counts."""

    def __init__(self, chunk: int, blocks: list[tuple[bytes, bytes]]):
        self.chunk, self.blocks = chunk, iter(blocks)
        self.keys, self.counts = np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.at, self.done = 0, []
        self.totals: list[np.ndarray] = []
        self.best: list[np.ndarray] = []

    def next_a(self) -> int | None:
        """The next A id, all of whose pairs are in memory afterwards."""
        while True:
            end = None
            if self.at < len(self.keys):
                a = int(self.keys[self.at] >> 32)
                end = int(np.searchsorted(self.keys, (a + 1) << 32))
                if end < len(self.keys):
                    self.end = end
                    return a
            block = next(self.blocks, None)
            if block is None:
                self.end = end
                return None if end is None else a
            keys, counts = np.cumsum(unpacked(block[0], np.int64)), unpacked(block[1], np.uint32).astype(np.int64)
            self.keys, self.counts, self.at = np.concatenate([self.keys[self.at :], keys]), np.concatenate([self.counts[self.at :], counts]), 0

    def take(self) -> tuple[np.ndarray, np.ndarray]:
        a, b = self.at, self.end
        self.at = b
        return self.keys[a:b], self.counts[a:b]


BACK = "chunk long, part int, block int, totals binary, best binary"


def merge_runs(runs: list[Run]) -> None:
    """Counts of all pairs of the runs, in ascending A ids; each run gets the counts of its
    own pairs, in its order, and whether they are their A id's highest."""
    heap = [(a, k) for k, run in enumerate(runs) if (a := run.next_a()) is not None]
    heapq.heapify(heap)
    while heap:
        a, group = heap[0][0], []
        while heap and heap[0][0] == a:
            group.append(heapq.heappop(heap)[1])
        taken = [runs[k].take() for k in group]
        keys, where = np.unique(np.concatenate([t[0] for t in taken]), return_inverse=True)
        totals = np.zeros(len(keys), np.int64)
        np.add.at(totals, where, np.concatenate([t[1] for t in taken]))
        best, at = totals == totals.max(), 0
        for k, (own, _) in zip(group, taken):
            mine = where[at : at + len(own)]
            runs[k].totals.append(totals[mine])
            runs[k].best.append(best[mine])
            at += len(own)
            if (following := runs[k].next_a()) is not None:
                heapq.heappush(heap, (following, k))


def _merge(table: pa.Table) -> pa.Table:
    part = table.column("part")[0].as_py()
    table = table.sort_by([("chunk", "ascending"), ("block", "ascending")])
    blocks: dict[int, list[tuple[bytes, bytes]]] = {}
    for chunk, keys, counts in zip(*[table.column(c).to_pylist() for c in ("chunk", "keys", "counts")]):
        blocks.setdefault(chunk, []).append((keys, counts))
    runs = [Run(chunk, found) for chunk, found in blocks.items()]
    merge_runs(runs)
    n = len(runs)
    totals, best = [packed(np.concatenate(r.totals)) for r in runs], [packed(np.concatenate(r.best).view(np.uint8)) for r in runs]
    return pa.table({"chunk": pa.array([r.chunk for r in runs]), "part": pa.array([part] * n, pa.int32()), "block": pa.array([0] * n, pa.int32()), "totals": pa.array(totals, pa.binary()), "best": pa.array(best, pa.binary())})


# ---- sum ----------------------------------------------------------------------------------

RESULT = "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"
_RESULT = pa.schema([(n, pa.string() if n == "groups_sha256" else pa.int64()) for n in (c.split()[0] for c in RESULT.split(", "))])


def _sum(docs: pa.Table, back: pa.Table) -> pa.Table:
    if docs.num_rows == 0:
        return _RESULT.empty_table()
    row = docs.to_pylist()[0]
    back = back.sort_by([("part", "ascending"), ("block", "ascending")])
    order = np.argsort(unpacked(row["parts"], np.uint16 if row["wide"] == 0 else np.uint32), kind="stable")
    totals, best = np.zeros(len(order), np.int64), np.zeros(len(order), np.int64)
    if back.num_rows:
        totals[order] = np.concatenate([unpacked(x, np.int64) for x in back.column("totals").to_pylist()])
        best[order] = np.concatenate([unpacked(x, np.uint8) for x in back.column("best").to_pylist()])
    places = np.cumsum(unpacked(row["places"], np.uint32), dtype=np.int64) - _rank(row["n_pairs"]) * len(order)
    times, cut = unpacked(row["times"], np.uint32), np.concatenate([np.zeros(1, np.int64), np.cumsum(row["n_pairs"], dtype=np.int64)])
    of_docs = lambda x: np.diff(np.concatenate([np.zeros(1, np.int64), np.cumsum(x[places] * times)])[cut])
    columns = [row[c] for c in ("doc_id", "n_a", "n_b", "n_groups", "n_links")] + [of_docs(best), of_docs(totals), row["groups"]]
    return pa.table([pa.array(c, f.type) for c, f in zip(columns, _RESULT)], schema=_RESULT)


def align_tokenizers(docs: DataFrame, a_path: str, b_path: str, spill: int = SPILL) -> DataFrame:
    """``doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256`` for each row
    of ``docs(doc_id, text)``; A is a byte-level BPE file that reads space + text, B a
    sentencepiece model that adds the space itself.

    Null and empty texts, and texts whose bytes the tokens of either don't give back, have
    no tokens: zeros and an empty string. Rows that repeat one another count as documents
    of their own; a null id stays null; an empty table gives no rows; other columns aren't
    read. Very long texts are encoded part by part.
    """
    spark = docs.sparkSession
    tune(spark)
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    chunks = stored(spark, rows.mapInArrow(lambda it: _spill(it, a_path, b_path, parts, spill), CHUNKS), "alignment", "none")
    runs = chunks.filter("part is not null").select("chunk", "part", "block", "keys", "counts")
    back = runs.groupBy("part").applyInArrow(_merge, BACK)
    own = chunks.filter("part is null").drop("part", "block", "keys", "counts").withColumn("wide", F.lit(int(parts > 1 << 16)))
    out = stored(spark, own.groupBy("chunk").cogroup(back.groupBy("chunk")).applyInArrow(_sum, RESULT), "aligned")
    discard(chunks)
    return out
