import pytest

pytest.importorskip("rankframe.llm")

from rankframe.llm import decontam

ITEM = "A shop sold 2 apples and 2 pears in the morning, and then 9 plums and 4 melons were brought in by the farmer. How many fruits are there?"


def variant(a, b, c, d):
    return f"A shop sold {a} apples and {b} pears in the morning, and then {c} plums and {d} melons were brought in by the farmer. How many fruits are there?"


def test_each_occurrence_is_judged_by_itself(spark):
    bench = spark.createDataFrame([(1, ITEM)], "item_id long, text string")
    docs = [
        (1, " Next. ".join(variant(k, k + 1, k + 20, k + 40) for k in range(3, 9))),  # a worksheet
        (2, ITEM + " Or else: " + variant(5, 6, 7, 8)),  # verbatim and a variant
        (3, variant(3, 5, 6, 6)),  # one value in two roles
        (4, "an ordinary text on apples and pears in the morning of a day on which nothing was sold"),
    ]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    assert {r.doc_id for r in decontam.contaminated(df, bench).collect()} == {1, 2, 3}
    assert [r.doc_id for r in decontam.drop_contaminated(df, bench).collect()] == [4]


def test_scattered_pieces_count_together(spark):
    words = ["w" + chr(97 + i // 26) + chr(97 + i % 26) for i in range(80)]
    pieces = [" ".join(words[k : k + 11]) + " " + " ".join(f"x{chr(97 + j)}{chr(97 + k // 3)}" for j in range(15)) for k in range(0, 77, 11)]
    bench = spark.createDataFrame([(1, " ".join(words))], "item_id long, text string")
    got = decontam.contaminated(spark.createDataFrame([(1, " ".join(pieces))], "doc_id long, text string"), bench).collect()
    assert len(got) == 1 and got[0].run_tokens < 13


def test_against_all_pairs(spark):
    """Items of plain words: a pair counts from a share of the windows or a run of tokens."""
    import numpy as np

    rng = np.random.default_rng(4)
    common = [f"w{chr(97 + i)}{chr(97 + j)}" for i in range(6) for j in range(6)]
    phrase = "which of the following is true for all of them"
    items, docs = [], []
    for k in range(30):
        words = [str(rng.choice(common)) + chr(97 + k % 26) for _ in range(int(rng.integers(4, 60)))]
        items.append((k, (phrase + " " if k % 3 == 0 else "") + " ".join(words)))
    for d in range(120):
        parts = []
        for _ in range(int(rng.integers(1, 5))):
            words = items[int(rng.integers(30))][1].split()
            a = int(rng.integers(0, len(words)))
            parts += words[a : a + int(rng.integers(3, 30))] + ["filler"] * int(rng.integers(1, 9))
        docs.append((d, " ".join(parts + phrase.split())))
    want = set()
    for i, item in items:
        w = item.split()
        size = min(8, len(w))
        mine = [tuple(w[p : p + size]) for p in range(len(w) - size + 1)]
        for d, text in docs:
            t = text.split()
            theirs = {tuple(t[p : p + size]) for p in range(len(t) - size + 1)}
            covered = sum(x in theirs for x in mine) / len(mine)
            run = max((n for p in range(len(t)) for q in range(len(w)) for n in [next((j for j in range(len(w)) if p + j >= len(t) or q + j >= len(w) or t[p + j] != w[q + j]), len(w))]), default=0)
            if covered >= 0.3 or run >= 13:
                want.add((d, i))
    got = decontam.contaminated(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"))
    assert {(r.doc_id, r.item_id) for r in got.collect()} == want and len(want) > 50


def test_words_with_one_polynomial_hash(spark):
    word = "".join("ab"[bin(i).count("1") % 2] for i in range(1024))
    other = word.translate(str.maketrans("ab", "ba"))
    item = f"one two three {word} four five six seven eight nine"
    bench = spark.createDataFrame([(1, item)], "item_id long, text string")
    docs = spark.createDataFrame([(1, item), (2, item.replace(word, other))], "doc_id long, text string")
    assert [r.doc_id for r in decontam.contaminated(docs, bench).collect()] == [1]
