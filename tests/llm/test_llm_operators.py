import hashlib
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

pytest.importorskip("rankframe.llm")

from rankframe.llm import components, decontam, licenses, packing, pii, quality, repeats, resample, secret_scan, simhash, tokenstore
from rankframe.llm.queries import tokenizer_path

EDGE = [(1, None), (2, ""), (None, "a null id"), (3, "same text twice"), (3, "same text twice"), (4, "word " * 30_000), (5, " \n\t "), (6, "é日本 ñandú <|endoftext|>  x")]
SCHEMA = "doc_id long, text string"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


@pytest.fixture(scope="module")
def edge(spark):
    return spark.createDataFrame(EDGE, SCHEMA)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def encode(text, end):
    from tokenizers import Tokenizer

    return np.array(Tokenizer.from_file(tokenizer_path()).encode(text or "", add_special_tokens=False).ids + [end], "<u4")


def test_token_store(edge, none):
    got = sorted(tokenstore.store_and_read(edge, tokenizer_path(), 2).collect(), key=lambda r: r.start)
    start, want = 0, []
    for k, t in sorted(EDGE, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or "")):
        ids = encode(t, 2)
        want.append((k, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    assert [(r.doc_id, r.start, r.n_tokens, r.ids_crc32) for r in got] == want
    assert tokenstore.store_and_read(none, tokenizer_path(), 2).count() == 0


def test_store_misses_unknown_keys(spark):
    folder = tokenstore.write_store(spark.createDataFrame([(i, f"t {i}") for i in range(500)], SCHEMA), tokenizer_path(), 2)
    asked = spark.range(0, 1000).selectExpr("id as doc_id", "0L as occurrence")
    found = {r.doc_id: r.found for r in tokenstore.locate(folder, asked).collect()}
    assert [k for k, f in found.items() if f] and {k for k, f in found.items() if f} == set(range(500))


def test_perfect_hash():
    h = np.unique(np.random.default_rng(0).integers(0, 1 << 63, 5000).astype(np.uint64))
    levels, ranks, slot = tokenstore.build_perfect_hash(h)
    assert sorted(slot) == list(range(len(h)))
    assert (tokenstore.probe_perfect_hash(levels, ranks, h) == slot).all()


def test_bucket_of_keys_with_one_hash():
    import pandas as pd

    rows = pd.DataFrame({"h": [7, 7, 9], "h2": [1 << 40, 2 << 40, 3 << 40], "shard": [0, 0, 0], "first": [0, 5, 9], "n_tokens": [5, 4, 3]}).assign(doc_id=[1, 2, 3], occurrence=0)
    index = tokenstore._build_bucket((0,), rows)
    assert index["seed"][0] > 0
    got = tokenstore._probe_bucket((0,), rows, index)
    assert got["found"].all() and got["first"].tolist() == [0, 5, 9]


def test_read_one_document(spark, edge):
    folder = tokenstore.write_store(edge, tokenizer_path(), 2)
    for k, t in EDGE:
        assert tokenstore.read_document(spark, folder, k).tolist() == encode(t, 2).tolist()
    assert tokenstore.read_document(spark, folder, 3, 1) is not None
    assert tokenstore.read_document(spark, folder, 12345) is None


def thue_morse(n):
    return "".join("ab"[bin(i).count("1") % 2] for i in range(n))


def test_words_with_one_polynomial_hash(spark):
    word = thue_morse(1024)
    other = word.translate(str.maketrans("ab", "ba"))
    rows = [(1, f"{word} {other}"), (2, f"{other} {word}")]
    got = tokenstore.store_and_read(spark.createDataFrame(rows, SCHEMA), tokenizer_path(), 2)
    assert {r.doc_id: r.ids_crc32 for r in got.collect()} == {k: zlib.crc32(encode(t, 2).tobytes()) for k, t in rows}
    packed = packing.pack(spark.createDataFrame(rows, SCHEMA), tokenizer_path(), 0, 2048).collect()
    assert {(r.doc_id, r.piece): r.ids_crc32 for r in packed} == {(k, i // 2048): zlib.crc32(encode(t, 0)[i : i + 2048].tobytes()) for k, t in rows for i in range(0, len(encode(t, 0)), 2048)}


def test_packing(edge, none):
    got = packing.pack(edge, tokenizer_path(), 0, 2048).collect()
    want = Counter()
    for k, t in EDGE:
        ids = encode(t, 0)
        for i, s in enumerate(range(0, len(ids), 2048)):
            part = ids[s : s + 2048]
            want[(k, i, s, len(part), zlib.crc32(part.tobytes()))] += 1
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == want
    bins = defaultdict(list)
    for r in got:
        bins[r.sequence_id].append((r.offset, r.length))
    for b in bins.values():
        at = 0
        for offset, length in sorted(b):
            assert offset == at
            at += length
        assert at <= 2048
    assert packing.pack(none, tokenizer_path(), 0, 2048).count() == 0


def test_supersteps_are_best_fit_decreasing():
    rng = np.random.default_rng(5)
    for _ in range(30):
        lengths = sorted(rng.integers(1, 65, 200).tolist(), reverse=True)
        gaps = []
        for x in lengths:
            fits = [g for g in gaps if g >= x]
            if fits:
                gaps.remove(min(fits))
                gaps.append(min(fits) - x)
            else:
                gaps.append(64 - x)
        plan, n = packing.supersteps(dict(Counter(lengths)), 64)
        assert n == len(gaps) and plan[:, 2].sum() == 200


def repeat_brute(rows, length):
    seen = Counter(b[p : p + length] for _, t in rows for b in [(t or "").encode()] for p in range(len(b) - length + 1))
    out = []
    for k, t in rows:
        b = (t or "").encode()
        cover = np.zeros(len(b), bool)
        for p in range(len(b) - length + 1):
            if seen[b[p : p + length]] > 1:
                cover[p : p + length] = True
        kept = bytes(x for x, c in zip(b, cover) if not c)
        out.append((k or -1, len(b), int(cover.sum()), int(np.diff(np.r_[0, cover.astype(int)]).clip(0).sum()), hashlib.sha256(kept).hexdigest()))
    return sorted(out)


@pytest.mark.parametrize("full", [20_000, 2])
def test_repeats(spark, none, monkeypatch, full):
    monkeypatch.setattr(repeats, "FULL", full)
    rng = np.random.default_rng(0)
    text = lambda n, a="abcdeé ": "".join(rng.choice(list(a), n))
    base = text(1500)
    rows = [(1, "a" * 700), (2, "b" * 200), (3, "b" * 199), (4, None), (5, ""), (6, base[:900]), (7, "x" + base[100:800] + "y"), (8, base[300:620] + "ab" * 200), (9, base[:900]), (9, base[:900]), (None, "é" * 250)]
    rows += [(20 + k, text(rng.integers(0, 150), "pqrs") + base[900 : 1300 - k] + text(rng.integers(0, 150), "pqrs")) for k in range(12)]
    # near copies of one text: collections of more than 120 different members
    rows += [(100 + k, base[:260] + base[260 : 300 + k % 7] + text(3) + base[400:640]) for k in range(150)]
    got = repeats.remove_repeats(spark.createDataFrame(rows, SCHEMA)).collect()
    assert sorted((r[0] if r[0] is not None else -1, *r[1:]) for r in got) == repeat_brute(rows, 200)
    assert repeats.remove_repeats(none).count() == 0


def test_simhash(spark, edge, none):
    from xxhash import xxh64_intdigest

    rng = np.random.default_rng(2)
    vocabulary = [f"w{i}" for i in range(400)]
    rows = list(EDGE)
    for k in range(40):
        words = rng.choice(vocabulary, 300).tolist()
        rows.append((100 + 3 * k, " ".join(words)))
        for j in (1, 2):
            words[int(rng.integers(300))] = "CHANGED"
            rows.append((100 + 3 * k + j, " ".join(words)))

    def fp(t):
        w = WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or ""))
        s = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] if len(w) > 2 else [" ".join(w)] * bool(w)
        h = [xxh64_intdigest(x.encode(), 42) for x in s]
        return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))

    f = np.array([fp(t) for _, t in rows], np.uint64)
    i, j = np.nonzero(np.bitwise_count(f[:, None] ^ f[None, :]) <= 3)
    root = components.local_roots(len(rows), i, j)
    least = defaultdict(list)
    for r, (k, _) in zip(root, rows):
        if k is not None:
            least[r].append(k)
    want = Counter((k, f"{int(x):016x}", min(least[r], default=None)) for r, x, (k, _) in zip(root, f, rows))
    df = spark.createDataFrame(rows, SCHEMA)
    assert Counter(tuple(r) for r in simhash.near_duplicates(df).collect()) == want
    kept = Counter(r.doc_id for r in simhash.keep_one(df.selectExpr("*", "1 as fp", "2 as cell")).collect())
    assert kept == Counter({w[2]: 1 for w in want})
    assert simhash.near_duplicates(none).count() == 0


def test_links_at_distance_three_and_chains(spark):
    a = 0x0123456789ABCDEF
    prints = [a, a ^ 0b111, a ^ 0b111111, a ^ (1 << 63) ^ (1 << 40) ^ (1 << 5), a ^ (0b1111 << 20)]
    signed = [p - (1 << 64) if p >> 63 else p for p in prints]
    df = spark.createDataFrame([(i, p) for i, p in enumerate(signed)], "doc_id long, fp long")
    got = {r.fp: r.component_id for r in simhash.groups(df).collect()}
    assert [got[p] for p in signed] == [0, 0, 0, 0, 4]


def test_links_of_crowded_fingerprints(spark, monkeypatch):
    rng = np.random.default_rng(8)
    monkeypatch.setattr(simhash, "FULL", 60)
    centres = rng.integers(0, 1 << 63, 3, np.int64).view(np.uint64) << np.uint64(1)
    prints = [int(c) ^ sum(1 << int(b) for b in rng.choice(64, int(rng.integers(0, 9)), False)) for c in centres for _ in range(150)]
    prints += [int(x) for x in rng.integers(0, 1 << 63, 200)]
    f = np.unique(np.array(prints, np.uint64))
    i, j = np.nonzero(np.bitwise_count(f[:, None] ^ f[None, :]) <= 3)
    want = components.local_roots(len(f), i, j)
    df = spark.createDataFrame([(k, int(x)) for k, x in enumerate(f.view(np.int64))], "doc_id long, fp long")
    got = {r.fp: r.component_id for r in simhash.groups(df).collect()}
    assert [got[int(x)] for x in f.view(np.int64)] == want.tolist()


def test_components_of_a_long_chain(spark):
    df = spark.createDataFrame([(i, i + 1) for i in range(100)] + [(500, 501), (7, 7)], "u long, v long")
    got = {r.node: r.root for r in components.components(df).collect()}
    assert all(got[i] == 0 for i in range(101)) and got[501] == 500


def test_quality(spark, edge, none):
    rng = np.random.default_rng(4)
    vocabulary = "the of and house tree river mountain running quickly people water light story under again".split()
    rows = [(k, " ".join(rng.choice(vocabulary, 80)) + ".", "en") for k in range(150)]
    rows += [(1000 + k, " ".join(w + "$$$" for w in rng.choice(vocabulary, 80)), "en") for k in range(5)]
    rows += [(2000, "one two three four five six " * 20, "en"), (2001, "a\na\n\n b\na", None), (2002, "12 34 " * 10, "fr")]
    rows += [(None if k is None else 5000 + k, t, None) for k, t in EDGE]
    df = spark.createDataFrame(rows, SCHEMA + ", lang string")
    got = {(r.doc_id, i): r for i, r in enumerate(quality.quality_figures(df).orderBy("doc_id").collect())}
    by = {k: r for (k, _), r in got.items()}
    for k, t, _ in rows:
        words = WORD.findall(t or "")
        windows = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
        twice, mark = Counter(windows), np.zeros(len(words), bool)
        for i, w in enumerate(windows):
            if twice[w] > 1:
                mark[i : i + 5] = True
        seen, dup = set(), 0
        for line in (t or "").split("\n"):
            if WORD.search(line):
                dup += line in seen
                seen.add(line)
        failed = len(words) < 10 or 100 * int(mark.sum()) > 20 * len(words)
        r = by[k]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", t or "")), dup, int(mark.sum()), failed)
        assert not (failed and r.kept)
    assert sum(by[k].kept for k in range(150)) >= 147
    assert not any(by[1000 + k].kept for k in range(5)) and not by[2002].kept
    assert len(got) == len(rows)
    assert quality.quality_figures(none.selectExpr("*", "'x' as lang")).count() == 0


def plain_model(texts, order):
    """Modified Kneser-Ney of one language, n-gram by n-gram."""
    counts = {order: Counter()}
    for t in texts:
        chars = "\n" * (order - 1) + "".join(w + " " for w in t.split())
        counts[order].update(chars[i : i + order] for i in range(len(chars) - order + 1))
    for k in range(order - 1, 0, -1):
        counts[k] = Counter(g[1:] for g in counts[k + 1])

    def p(k, g):
        if k == 0:
            return 1 / (len(counts[1]) + 1)
        c = counts[k]
        n = [sum(v == i for v in c.values()) for i in range(1, 5)]
        y = n[0] / max(1, n[0] + 2 * n[1])
        d = [min(i, max(0.1, i - (i + 1) * y * n[i] / max(1, n[i - 1]))) for i in (1, 2, 3)]
        same = {x: v for x, v in c.items() if x[:-1] == g[:-1]}
        if not same:
            return p(k - 1, g[1:])
        total = sum(same.values())
        own = (c[g] - d[min(c[g], 3) - 1]) / total if g in c else 0.0
        return own + sum(d[min(v, 3) - 1] for v in same.values()) / total * p(k - 1, g[1:])

    return p, counts


def test_perplexity_model(spark):
    """The stored model against a plain one, for n-grams that it has and others."""
    texts = ["abab abba cab é", "bac abc日", "aab"]
    docs = spark.createDataFrame([(0, "en", t) for t in texts], "chunk int, lang string, text string")
    counts = docs.mapInArrow(quality._count, "chunk int, lang string, gram string, n long").groupBy("lang", "gram").agg({"n": "sum"}).withColumnRenamed("sum(n)", "n")
    folder, parts = quality.train(counts)
    p, plain = plain_model(texts, quality.ORDER)
    assert {r.gram: r.n for r in counts.collect()} == dict(plain[quality.ORDER])
    asked = [*plain[quality.ORDER], "zzzzz", "abab日", "xabab", "babaz", "\n\n\n\nz"]
    got = quality.probabilities(spark, folder, spark.createDataFrame([(0, "en", g) for g in asked], "chunk int, lang string, gram string")).collect()
    assert {r.gram: r.log for r in got} == pytest.approx({g: np.log2(p(quality.ORDER, g)) for g in asked}, abs=1e-4)
    assert {g: quality.log_of(folder, parts, "en", g) for g in asked} == pytest.approx({g: np.log2(p(quality.ORDER, g)) for g in asked}, abs=1e-4)
    for context in ("\n\n\n\n", "abab", "\n\nca"):
        assert sum(p(quality.ORDER, context + c) for c in [*plain[1], "?"]) == pytest.approx(1)
        known = quality.probabilities(spark, folder, spark.createDataFrame([(0, "en", context + c) for c in [*plain[1], "?"]], "chunk int, lang string, gram string")).collect()
        assert sum(2**r.log for r in known) == pytest.approx(1, abs=1e-4)


def test_verdicts_against_a_plain_version(spark):
    rng = np.random.default_rng(8)
    vocabulary = "the of and house tree river mountain running quickly people water light story under again".split()
    rows = [(k, " ".join(rng.choice(vocabulary, int(rng.integers(12, 60)))), "en") for k in range(60)]
    rows += [(100 + k, " ".join("".join(rng.choice(list("qzxjkvwy"), 6)) for _ in range(30)), "en") for k in range(4)]
    got = {r.doc_id: r for r in quality.quality_figures(spark.createDataFrame(rows, SCHEMA + ", lang string").repartition(3)).collect()}
    p, _ = plain_model([t for _, t, _ in rows], quality.ORDER)
    memo = {}
    for k, t, _ in rows:
        chars = "\n" * (quality.ORDER - 1) + "".join(w + " " for w in t.split())
        grams = [chars[i : i + quality.ORDER] for i in range(len(chars) - quality.ORDER + 1)]
        bits = -sum(memo.setdefault(g, np.log2(p(quality.ORDER, g))) for g in grams)
        assert got[k].bits_per_letter == pytest.approx(bits / sum(c.isalpha() for c in t), rel=1e-4)
    fair = {k: r for k, r in got.items() if not r.base_failed}
    middle = sorted(r.bits_per_letter for r in fair.values())[(len(fair) - 1) // 2]
    letters = {k: sum(c.isalpha() for c in t) for k, t, _ in rows}
    apart = {k: abs(r.bits_per_letter - middle) * letters[k] ** 0.5 for k, r in fair.items()}
    spread = 1.4826 * sorted(apart.values())[(len(apart) - 1) // 2]
    for k, r in got.items():
        inside = not r.base_failed and apart[k] / letters[k] ** 0.5 <= quality.BAND_SHARE * middle + quality.BAND_DEVIATIONS * spread / letters[k] ** 0.5
        assert r.kept == inside
    assert not any(got[100 + k].kept for k in range(4))


def test_lines_and_words_with_one_polynomial_hash(spark):
    word = thue_morse(1024)
    other = word.translate(str.maketrans("ab", "ba"))
    text = f"{word}\n{other}\nw x y {word} z\nw x y {other} z"
    got = quality.quality_figures(spark.createDataFrame([(1, text, "en")], SCHEMA + ", lang string")).first()
    assert got.n_dup_lines == 0 and got.n_repeat_words == 0


def luhn(d):
    return sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(d[::-1])) % 10 == 0


def pii_brute(t):
    kinds = [r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", r"[0-9]([\x20-]?[0-9])+", r"\+[0-9][\x20().0-9-]+[0-9]"]
    out = []
    for k, p in enumerate(kinds):
        for m in re.finditer(p, t):
            d = "".join(re.findall("[0-9]", m[0]))
            if (k == 1 and any(int(x) > 255 for x in m[0].split("."))) or (k == 2 and not (14 <= len(d) <= 19 and luhn(d))) or (k == 3 and not 10 <= len(d) <= 15):
                continue
            out.append((m.start(), k, m.end()))
    return sorted(out)


def test_pii_base_on_random_texts():
    rng = np.random.default_rng(0)
    for _ in range(20_000):
        t = "".join(rng.choice(list("a1@.+ -()5_9é"), int(rng.integers(0, 40))))
        assert pii.detect(t) == pii_brute(t), t


@pytest.mark.parametrize("text,want", [
    ("at john.doe [at] example [dot] com now", "john.doe [at] example [dot] com"),
    ("jоhn@exаmple.com", "jоhn@exаmple.com"),
    ("４１１１ １１１１ １１１１ １１１１", "４１１１ １１１１ １１１１ １１１１"),
    ("call plus one five five five one two three four five six seven", "plus one five five five one two three four five six seven"),
    ("ip one nine two dot one six eight dot zero dot one ok", "one nine two dot one six eight dot zero dot one"),
    ("ab@x​.org", "ab@x​.org"),
    ("mail jоhn.smith@example.com", "jоhn.smith@example.com"),
    ("user@example.c​om", "user@example.c​om"),
    ("call +1 415 five five five 0132 now", "+1 415 five five five 0132"),
    ("plus 4 nine one 7 0 1 two 3 4 five 6", "plus 4 nine one 7 0 1 two 3 4 five 6"),
    ("192[.]168[dot]0 dot 17", "192[.]168[dot]0 dot 17"),
    ("a_very" + "y" * 200 + ".b.c.d.e.f [at] one.two.three.four.five.six.seven.com", "a_very" + "y" * 200 + ".b.c.d.e.f [at] one.two.three.four.five.six.seven.com"),
])
def test_pii_disguises(text, want):
    base, full = pii.scan(text)
    assert want in [text[s:e] for s, _, e in full]
    assert set(base) <= set(full)


@pytest.mark.parametrize("text", ["meet me at example.com", "one of the two at the dot of noon", "the point is at hand", ""])
def test_pii_leaves_plain_text(text):
    assert pii.scan(text) == ([], [])


@pytest.mark.parametrize("unit", ["1", "a.", "@", "one ", "1.1.", "a dot ", "O0", "a at ", "+1(", "[at] ", " ", "\t[", "a  dot  ", "1 dot "])
def test_pii_long_texts(unit):
    import time

    start = time.time()
    pii.scan((unit * 1_000_000)[:1_000_000] + "x a [at] b.com")
    assert time.time() - start < 30


def test_pii_recall_on_random_disguises():
    """Identifiers disguised at random come back as their whole source spans."""
    rng = np.random.default_rng(6)
    pick = lambda x: x[int(rng.integers(len(x)))]
    names = ["zero", "one", "two", "three", "four", "five", "six", "seven", "eight", "nine"]
    odd = {"a": "а", "o": "о", "e": "е", "i": "і", "c": "с", "p": "р"}
    found = 0
    for _ in range(400):
        kind = int(rng.integers(4))
        if kind == 0:
            dot, at = pick([" dot ", "[dot]", " [.] ", "(punkt)"]), pick([" [at] ", "(at)", " {at} ", "[@]"])
            value = f"{pick(['ana', 'joe', 'max'])}{dot}{pick(['lee', 'kim'])}{at}{pick(['mail', 'post'])}{dot}{pick(['com', 'org'])}"
        elif kind == 1:
            plain = f"{pick(['ana', 'joe', 'piece'])}.{pick(['cole', 'price'])}@{pick(['example', 'office'])}.com"
            value = "".join(odd.get(c, c) if rng.random() < 0.4 else c for c in plain[:-4]) + plain[-4:]
            if value == plain:
                value = "\u0430" + plain
        elif kind == 2:
            value = "plus " + " ".join(names[int(d)] if rng.random() < 0.7 else str(d) for d in rng.integers(0, 10, 11)) + " five"
        else:
            value = pick([" dot ", "[.]", " [dot] "]).join(str(x) for x in rng.integers(1, 255, 4))
        text = f"some words: {value} and others, é"
        found += any(text[s:e] == value for s, _, e in pii.scan(text)[1])
    assert found >= 396, found


def test_pii_rows(edge, none):
    got = pii.personal_data(edge).collect()
    assert len(got) == len(EDGE) and all(r.base_sha256 == hashlib.sha256(b"").hexdigest() for r in got)
    assert pii.personal_data(none).count() == 0


def test_decontamination(spark, edge, none):
    item = "Yesterday John bought 5 apples and 7 pears for 12 dollars, then he gave 5 apples to Anna. How many apples are left?"
    bench = spark.createDataFrame([(1, item), (2, None), (3, ""), (4, "too short"), (5, "uno dos tres quatre cinq")], "item_id long, text string")
    swapped = "Yesterday Peter bought 9 apples and 3 pears for 40 dollars, then he gave 9 apples to Maria. How many apples are left?"
    broken = "Yesterday Peter bought 9 apples and 3 pears for 40 dollars, then he gave 8 apples to Maria."
    docs = [(1, "x y z. " + swapped + " foo"), (2, "nothing of the kind is here, my friend, on this fine day of spring"), (3, item.lower()), (4, "say uno dos tres quatre cinq now"), (5, item), (5, item)]
    df = spark.createDataFrame(docs, SCHEMA)
    got = {(r.doc_id, r.item_id) for r in decontam.contaminated(df.union(edge), bench).collect()}
    assert got == {(1, 1), (3, 1), (4, 5), (5, 1)}
    assert sorted(r.doc_id for r in decontam.drop_contaminated(df.selectExpr("*", "1 as h"), bench).collect()) == [2]
    pairs = decontam.matched_pairs(spark.createDataFrame([(1, broken)], "dk long, text string"), bench).collect()
    assert pairs[0].consistent < 1
    assert decontam.contaminated(none, bench).count() == 0 and decontam.contaminated(df, bench.limit(0)).count() == 0


def test_decontamination_of_repeated_rows_and_null_ids(spark):
    item = " ".join("w" + chr(97 + i // 26) + chr(97 + i % 26) for i in range(60))
    part = " ".join(item.split()[10:24])  # 14 tokens in a row, under the share
    bench = spark.createDataFrame([(1, item), (1, item), (1, "another text under the same id, of no use to anyone"), (None, item)], "item_id long, text string")
    docs = spark.createDataFrame([(1, part)] * 3 + [(2, "clean text of more than eight words, as it should be")], SCHEMA)
    got = decontam.contaminated(docs, bench).collect()
    assert sorted(((r.doc_id, r.item_id, r.run_tokens) for r in got), key=str) == [(1, 1, 14), (1, None, 14)]
    assert [r.doc_id for r in decontam.drop_contaminated(docs, bench).collect()] == [2]


def test_decontamination_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(decontam, "BLOCK", 5)
    texts = [" ".join("x" + chr(97 + i) + chr(97 + j) for j in range(20)) for i in range(6)]
    bench = spark.createDataFrame(list(enumerate(texts)), "item_id long, text string")
    docs = spark.createDataFrame([(10 + i, "before it " + t + " after") for i, t in enumerate(texts)], SCHEMA)
    assert {(r.doc_id, r.item_id) for r in decontam.contaminated(docs, bench).collect()} == {(10 + i, i) for i in range(6)}


def test_licenses(spark, edge, none):
    mit = dict(licenses.TEMPLATES)["MIT"]
    docs = [(10, "é code here\n" + mit + "\nend"), (11, "x Released under the MIT license. y"), (12, "no license of any sort"), (13, mit.replace("free of charge", "without any fee"))]
    got = licenses.scan_licenses(spark.createDataFrame(docs, SCHEMA).union(edge)).collect()
    by = {(r.doc_id, r.template_id): r for r in got}
    assert by[(10, "MIT")].coverage == 1 and docs[0][1][by[(10, "MIT")].start : by[(10, "MIT")].end].startswith("Permission is hereby")
    assert 0.9 < by[(13, "MIT")].coverage < 1 and "," in by[(13, "MIT")].spans
    assert (11, "MIT-line") in by and {k for k, _ in by} == {10, 11, 13}
    assert licenses.scan_licenses(none).count() == 0
    assert licenses.scan_licenses(edge, []).count() == 0


def test_secrets(spark, edge, none):
    rng = np.random.default_rng(9)
    rows, secret = [], {}
    for k in range(120):
        key = "".join(rng.choice(list("0123456789abcdef"), 40))
        words = " ".join(rng.choice(["house", "tree", "river", "running", "people"], 30))
        if k % 2:
            rows.append((k, f'{words} token = "{key}" {words}'))
            secret[k] = key
        else:
            rows.append((k, f"{words} {''.join(rng.choice(list('0123456789'), 16))} {words} housetreeriver12345 "))
    df = spark.createDataFrame([(*r, "src/a") for r in rows], SCHEMA + ", source string").unionByName(edge.selectExpr("doc_id + 5000 as doc_id", "text", "null as source"))
    got = secret_scan.findings(df).collect()
    text = dict(rows)
    assert {r.doc_id: text[r.doc_id][r.start : r.end] for r in got if r.is_secret} == secret
    assert len([r for r in got if r.doc_id in text and not r.is_secret]) == 120
    labelled = spark.createDataFrame([(r.doc_id, r.start, r.end, int(r.doc_id in secret)) for r in got if r.doc_id % 4 < 2], "doc_id long, start long, end long, label int")
    held = [r for r in secret_scan.findings(df, labelled).collect() if r.doc_id is not None and r.doc_id % 4 >= 2]
    assert np.mean([r.is_secret == (r.doc_id in secret) for r in held]) > 0.95
    masked = {r.doc_id: r.text for r in secret_scan.mask_secrets(df.selectExpr("*", "1 as n_chars")).collect()}
    assert all(secret_scan.MASK in masked[k] and v not in masked[k] for k, v in secret.items()) and masked[0] == text[0]
    assert secret_scan.secret_report(none.selectExpr("*", "'' as source")).count() == 0


def test_resampling(spark, edge, none):
    rng = np.random.default_rng(3)
    good, bad = [f"g{i}" for i in range(50)], [f"b{i}" for i in range(50)]
    rows = [(k, " ".join(rng.choice(good if k % 4 else bad, 60))) for k in range(400)]
    df = spark.createDataFrame(rows, SCHEMA)
    labels = spark.createDataFrame([(k, int(k % 4 > 0)) for k in range(0, 400, 3)], "doc_id long, quality int")
    got = {r.doc_id: r for r in resample.select_quality(df, labels).collect()}
    held = [k for k in range(400) if k % 3]
    assert np.mean([got[k].kept == (k % 4 > 0) for k in held]) > 0.97
    few = resample.resample(df, labels.filter("quality = 1"), k=7).collect()
    best = sorted(few, key=lambda r: -r.gumbel_key)[:7]
    assert {r.doc_id for r in few if r.kept} == {r.doc_id for r in best}
    flat = resample.resample(edge, labels.limit(0), k=3).collect()
    assert len(flat) == len(EDGE) and all(r.log_weight == 0 for r in flat)
    assert resample.resample(none, labels, k=3).count() == 0


def test_gumbel_keys_sample_in_proportion_to_weights():
    rng = np.random.default_rng(12)
    weight = np.array([0.0, 1.0, 2.0, -1.0, 0.5])
    h = rng.integers(0, 1 << 63, (40_000, 5), dtype=np.int64).view(np.uint64) << np.uint64(1)
    keys = np.stack([resample.gumbel_keys(weight, row) for row in h])
    first = np.bincount(keys.argmax(axis=1), minlength=5) / len(h)
    assert first == pytest.approx(np.exp(weight) / np.exp(weight).sum(), abs=0.01)


def test_weights_are_log_ratios_of_the_models(spark):
    rows = [(1, "a b c"), (2, "a a"), (3, "b c d"), (4, "d d d")]
    df = spark.createDataFrame(rows, SCHEMA)
    target = spark.createDataFrame([(1,), (2,)], "doc_id long")
    got = {r.doc_id: r.log_weight for r in resample.resample(df, target, k=2).collect()}
    grams = lambda t: t.lower().split() + list(zip(t.lower().split(), t.lower().split()[1:]))
    raw, chosen = Counter(g for _, t in rows for g in grams(t)), Counter(g for k, t in rows if k < 3 for g in grams(t))
    share = sum(chosen.values()) / sum(raw.values())
    want = {k: sum(np.log((chosen[g] + resample.SMOOTHING * share) / ((raw[g] + resample.SMOOTHING) * share)) for g in grams(t)) for k, t in rows}
    assert got == pytest.approx(want)


def test_pipeline_stages(spark, edge, none, tmp_path):
    import corpus_pipeline

    spark.createDataFrame([(1, "some benchmark item of eight words or more here")], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    docs = edge.selectExpr("*", "'en' as lang", "null as source", "cast(1 as long) as n_chars", "'x' as gram")
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["quality rules", "near duplicates", "decontamination", "secrets", "packing"]
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, str(tmp_path))
        assert out.columns == docs.columns and out.count() <= len(EDGE)
        assert stage(spark, docs.limit(0), str(tmp_path)).count() == 0
