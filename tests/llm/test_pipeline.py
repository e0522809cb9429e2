"""The pipeline as a whole, each stage against a plain version on what the stage before kept."""

import zlib
from collections import Counter

import numpy as np
import pytest

pytest.importorskip("rankframe.llm")

import corpus_pipeline
from rankframe.llm import quality, secret_scan
from rankframe.llm.queries import tokenizer_path

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
RNG = np.random.default_rng(11)
SYLLABLES = "ta re mi so la no ka ri du pe lo ma sa ne ti bo".split()


def word():
    return "".join(RNG.choice(SYLLABLES, int(RNG.integers(1, 4))))


def prose(n):
    return " ".join(word() for _ in range(n)) + "."


def corpus():
    items = [(k, prose(25)) for k in range(6)]
    rows = [(k, prose(int(RNG.integers(40, 160)))) for k in range(120)]
    rows += [(200 + k, rows[k][1]) for k in range(5)]  # exact copies
    rows += [(210 + k, rows[10 + k][1].replace(rows[10 + k][1].split()[20], "tarata", 1)) for k in range(5)]  # near copies
    rows += [(220 + k, prose(30) + " " + items[k][1] + " " + prose(30)) for k in range(4)]  # contaminated
    secrets = {230 + k: f"{RNG.integers(1 << 60):x}{RNG.integers(1 << 60):x}" for k in range(3)}
    rows += [(k, prose(40) + f' token = "{v}" ' + prose(30)) for k, v in secrets.items()]
    rows += [(240, "too short"), (241, "one two three four five " * 12), (242, None), (243, ""), (244, " ".join("".join(RNG.choice(list("qxzjvw"), 7)) for _ in range(80)))]
    return items, rows, secrets


def shingles(text):
    w = text.lower().split()
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))}


def test_stages_one_after_the_other(spark, tmp_path):
    from tokenizers import Tokenizer

    items, rows, secrets = corpus()
    spark.createDataFrame(items, "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    docs = spark.createDataFrame([(k, t, "xx", "src/a", None if t is None else len(t)) for k, t in rows], SCHEMA)
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    text, kept = dict(rows), {}
    now = docs
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, now, str(tmp_path))
        path = str(tmp_path / name.replace(" ", "-"))
        out.write.parquet(path)
        now = spark.read.parquet(path)
        kept[name] = sorted({r.doc_id for r in now.select("doc_id").collect()})
        if name != "packing":
            assert now.columns == docs.columns
    # quality: what the figures say, which are tested against a plain model; junk goes, prose stays
    figures = {r.doc_id: r.kept for r in quality.quality_figures(docs).collect()}
    assert kept["quality rules"] == sorted(k for k, v in figures.items() if v)
    assert not {240, 241, 242, 243, 244} & set(kept["quality rules"]) and sum(k < 235 for k in kept["quality rules"]) >= 0.97 * (len(rows) - 5)
    # near duplicates: all pairs
    before, gone = kept["quality rules"], set()
    sets = {k: shingles(text[k]) for k in before}
    for i in before:
        for j in before:
            if i < j and len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]):
                gone.add(j)
    assert kept["near duplicates"] == [k for k in before if k not in gone] and len(gone) >= 9
    # decontamination: texts that hold an item
    held = {k for k in kept["near duplicates"] if any(t in text[k] for _, t in items)}
    assert kept["decontamination"] == [k for k in kept["near duplicates"] if k not in held] and len(held) == 4
    # secrets: masked in place, nothing goes, other texts stay as they were
    masked = {r.doc_id: (r.text, r.n_chars) for r in spark.read.parquet(str(tmp_path / "secrets")).collect()}
    assert sorted(masked) == kept["decontamination"]
    for k, (t, n) in masked.items():
        want = text[k].replace(secrets[k], secret_scan.MASK) if k in secrets else text[k]
        assert t == want and n == len(want)
    # packing: ids of the library, no sequence too long, no gaps
    tokenizer = Tokenizer.from_file(tokenizer_path())
    pieces = now.collect()
    want = Counter()
    for k, (t, _) in masked.items():
        ids = np.array(tokenizer.encode(t, add_special_tokens=False).ids + [0], "<u4")
        want.update((k, i // 2048, i, zlib.crc32(ids[i : i + 2048].tobytes())) for i in range(0, len(ids), 2048))
    assert Counter((r.doc_id, r.piece, r.start, r.ids_crc32) for r in pieces) == want
    places = {}
    for r in sorted(pieces, key=lambda r: (r.sequence_id, r.offset)):
        assert r.offset == places.get(r.sequence_id, 0) and r.offset + r.length <= 2048
        places[r.sequence_id] = r.offset + r.length
    assert len(places) <= -(-sum(places.values()) // 2048) + 1
