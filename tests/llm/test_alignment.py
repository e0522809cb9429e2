import hashlib
import random
from collections import Counter

import numpy as np
import pytest

pytest.importorskip("rankframe.llm")

from rankframe.llm import alignment
from rankframe.llm.queries import op12_token_alignment, tokenizer_path

A, B = tokenizer_path("byte_bpe_50k.json"), tokenizer_path("piece_bpe_32k.model")
SCHEMA = "doc_id long, text string"
EDGE = [
    (1, None), (2, ""), (3, " "), (4, "   "), (5, "x  y   z "), (6, " lead"), (7, "a\n b\n\n  c\t d\r\n"), (8, "a▁ b"), (9, "don't <|endoftext|> stop <s> </s> <0x0A> <unk>"),
    (10, "é日本 ñandú  x　 y ́z"), (11, "same text twice, with some words"), (11, "same text twice, with some words"), (None, "a null id"), (12, "x" * 3000 + " y"),
    (13, "word " * 30_000), (14, "\n"), (15, "\x1c a\x85 b"), (16, "a" + " " * 40 + "b"), (17, "🙂 ퟿ x"), (18, "1234 5 6,7.8 (9) -- !!"),
]


def encoders():
    import sentencepiece
    from tokenizers import Tokenizer

    a = Tokenizer.from_file(A)
    a.encode_special_tokens = True
    return a, sentencepiece.SentencePieceProcessor(model_file=B)


def plain(rows):
    """Every text encoded whole, all pairs of tokens compared by their byte ranges."""
    a, b = encoders()
    letters = alignment.byte_letters()
    vocabulary = {i: bytes(letters[c] for c in t) for t, i in a.get_vocab().items() if t != "<|endoftext|>"}
    pieces = [bytes([int(p[3:5], 16)]) if b.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(map(b.id_to_piece, range(b.get_piece_size())))]
    links, shape, count = [], [], Counter()
    for _, text in rows:
        whole = (" " + (text or "")).encode()
        x = a.encode(" " + text, add_special_tokens=False).ids if text else []
        y = b.encode(text, num_threads=1) if text else []
        found, groups = [], []
        if text and b"".join(vocabulary[i] for i in x) == whole == b"".join(pieces[i] for i in y):
            ends_x, ends_y = np.cumsum([len(vocabulary[i]) for i in x]), np.cumsum([len(pieces[i]) for i in y])
            for i, (start, end) in enumerate(zip([0, *ends_x], ends_x)):
                j = int(np.searchsorted(ends_y, start, "right"))
                while j < len(y) and (ends_y[j - 1] if j else 0) < end:
                    found.append((x[i], y[j]))
                    j += 1
            cuts = sorted(set(ends_x.tolist()) & set(ends_y.tolist()))
            for s, e in zip([0, *cuts], cuts):
                inside = [",".join(map(str, ids[np.searchsorted(ends, s, "right") : np.searchsorted(ends, e, "right")])) for ids, ends in ((x, ends_x), (y, ends_y))]
                groups.append("|".join(inside))
        else:
            x, y = [], []
        links.append(found)
        shape.append((len(x), len(y), len(groups), hashlib.sha256(";".join(groups).encode()).hexdigest() if groups else ""))
        count.update(set(found))
    top = {}
    for (i, _), n in count.items():
        top[i] = max(top.get(i, 0), n)
    return sorted(
        ((k, n_a, n_b, n_g, len(f), sum(count[p] == top[p[0]] for p in f), sum(count[p] for p in f), digest) for (k, _), f, (n_a, n_b, n_g, digest) in zip(rows, links, shape)), key=str
    )


def got(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


@pytest.mark.parametrize("spill", [1, 300, alignment.SPILL])
def test_edge_texts(spark, spill):
    table = spark.createDataFrame(EDGE, SCHEMA).withColumn("chunk", alignment.F.lit(1)).repartition(3)
    assert got(alignment.align_tokenizers(table, A, B, spill)) == plain(EDGE)


def test_empty_tables(spark):
    assert alignment.align_tokenizers(spark.createDataFrame([], SCHEMA), A, B).count() == 0
    nothing = alignment.align_tokenizers(spark.createDataFrame([(1, None), (2, "")], SCHEMA), A, B)
    assert got(nothing) == [(1, 0, 0, 0, 0, 0, 0, ""), (2, 0, 0, 0, 0, 0, 0, "")]


def test_whole_table(spark):
    rows = [tuple(r) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect()]
    assert got(op12_token_alignment(spark, "/root/testdata/sf0.001")) == plain(rows)


def test_pieces_encode_as_the_whole_text(monkeypatch):
    monkeypatch.setattr(alignment, "PART", 40)
    monkeypatch.setattr(alignment, "PIECES", 50)
    rng, (a, b), enc = random.Random(4), encoders(), alignment.Aligner(A, B)
    parts = [" ", " ", "  ", "\n", "\t", " ", "　", "\x1c", "the", "'s", "Word", "12", "...", "é", "日本", "<|endoftext|>", "ß,", "▁x", "́", "🙂"]
    for _ in range(400):
        text = "".join(rng.choices(parts, k=rng.randrange(1, 60)))
        pieces = [p for part in alignment.text_parts(text) for p in part]
        assert "".join(" " + p for p in pieces) == " " + text
        x, y = enc.ids(pieces)
        assert sum(x, []) == a.encode(" " + text, add_special_tokens=False).ids
        if "▁" not in text:
            assert sum(y, []) == b.encode(text, num_threads=1)
        list(alignment.text_links(enc, [text]))
        assert len(enc.known) <= 50 + len(set(pieces))


def test_merge_of_runs():
    rng = np.random.default_rng(1)
    runs, of = [], []
    for k in range(7):
        keys = np.unique(rng.integers(0, 9, 200) << 32 | rng.integers(0, 12, 200))[: rng.integers(0, 60)]
        n = rng.integers(1, 5, len(keys)).astype(np.uint32)
        of.append((keys, n))
        blocks = [(alignment.packed(alignment._deltas(keys[i : i + 5])), alignment.packed(n[i : i + 5])) for i in range(0, len(keys), 5)]
        runs.append(alignment.Run(k, blocks))
    alignment.merge_runs(runs)
    count, top = Counter(), {}
    for keys, n in of:
        count.update(dict(zip(keys.tolist(), n.tolist())))
    for key, n in count.items():
        top[key >> 32] = max(top.get(key >> 32, 0), n)
    for run, (keys, _) in zip(runs, of):
        assert np.concatenate([[], *run.totals]).tolist() == [count[x] for x in keys.tolist()]
        assert np.concatenate([[], *run.best]).tolist() == [count[x] == top[x >> 32] for x in keys.tolist()]
