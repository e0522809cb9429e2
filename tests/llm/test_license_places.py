import numpy as np
import pytest

pytest.importorskip("rankframe.llm")

from rankframe.llm import licenses


def test_each_template_after_a_long_text(spark):
    words = [f"word{chr(97 + i % 26)}{chr(97 + i // 26 % 26)}" for i in range(400)]
    docs = [(k, " ".join(words) + " " + t) for k, (_, t) in enumerate(licenses.TEMPLATES)]
    got = {(r.doc_id, r.template_id): r for r in licenses.scan_licenses(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    for k, (name, t) in enumerate(licenses.TEMPLATES):
        r = got[(k, name)]
        assert r.coverage == 1 and docs[k][1][r.start : r.end] in t and r.start == docs[k][1].index(t)


def test_clusters_are_bounded():
    begin = np.array([0, 5, 10, 15, 20, 25, 100, 3])
    new = licenses._clusters(np.array([0] * 7 + [1]), np.zeros(8, int), begin, np.full(8, 12))
    assert begin[new].tolist() == [0, 15, 100, 3]


def test_against_alignment_at_every_word():
    """Every place where the unbanded alignment of a template reaches the share is found."""
    import pyarrow as pa

    rng = np.random.default_rng(3)
    index = licenses.Index(licenses.TEMPLATES)
    names = [n for n, _ in licenses.TEMPLATES]
    asked, found = 0, 0
    for t, words in enumerate(index.words):
        for _ in range(3):
            changed = [w if rng.random() > 0.06 else b"other" for w in words]
            if len(words) > 8:
                del changed[int(rng.integers(len(changed)))]
            text = b" ".join([b"lorem"] * int(rng.integers(0, 60)) + changed + [b"ipsum"] * int(rng.integers(0, 60)))
            pairs = licenses.align(words, text.split(), 140)
            if len(pairs) < licenses.MIN_COVERAGE * len(words) or len(pairs) < min(licenses.MIN_WORDS, len(words)):
                continue
            batch = pa.RecordBatch.from_arrays([pa.array([1]), pa.array([text.decode()])], ["doc_id", "text"])
            got = [r for b in licenses._scan(iter([batch]), index) for r in b.to_pylist() if r["template_id"] == names[t]]
            asked += 1
            found += bool(got) and max(r["matched_words"] for r in got) >= len(pairs) - 1
    assert asked > 80 and found >= 0.97 * asked, (asked, found)


def test_a_text_full_of_licenses_takes_time_in_proportion():
    import time

    import pyarrow as pa

    index = licenses.Index(licenses.TEMPLATES)
    text = " ".join(t for _, t in licenses.TEMPLATES)
    seconds = []
    for size in (250_000, 1_000_000):
        batch = pa.RecordBatch.from_arrays([pa.array([1]), pa.array([(text + " ") * (size // len(text))])], ["doc_id", "text"])
        start = time.time()
        rows = sum(b.num_rows for b in licenses._scan(iter([batch]), index))
        seconds.append(time.time() - start)
        assert rows >= size // len(text) * len(licenses.TEMPLATES)
    assert seconds[1] < 8 * seconds[0] and seconds[1] < 120, seconds
