"""Secret scans: candidates by pattern, false positives removed by a random forest.

Everything here is DataFrame expressions and Spark's own random forest. Candidates are
private key blocks, values assigned to a telling name, and long runs of key characters with
a digit or with mixed case. Features: length, shares of character classes, runs of one
class, entropy, mean log probability of the candidate's letter transitions under the
corpus's words, share of it covered by dictionary words, known beginnings, the path's parts,
and neighbouring words. The dictionary and the transitions are counted over all texts.

The forest is fitted on labelled findings. Where none are given, findings are planted:
secrets and look-alikes of many kinds, made by a generator, are put between words of the
corpus, and the generator, not the features, says which is which. A fifth of them is held
out, for precision and recall (``held_out``).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from rankframe.llm.common import stored

#: Key characters; a candidate is a whole run of at least 16 with a digit or with two
#: changes from lower to upper case, and ``=`` only as padding at its end.
_KEY = "A-Za-z0-9+/_-"
_RUN = rf"(?<![{_KEY}])(?=[A-Za-z+/_-]*+[0-9]|[{_KEY}]*?[a-z][A-Z][{_KEY}]*?[a-z][A-Z])[{_KEY}]{{16,}}+={{0,2}}"
#: Names that secrets are assigned to; values from 8 characters count there.
_NAMED = r"(?<=[:=\s\"'])(?<=[:=][\s\"']{0,3})(?<=(?i:password|passwd|pwd|secret|token|api.?key|access.?key|private.?key)[\"']{0,1}\s{0,2}[:=]\s{0,2}[\"']{0,1})[^\s\"'<>,;&\x01\x02]{8,}"
#: A block ends at the first five hyphens after its beginning (or beyond 40 single ones), so
#: text that begins blocks and never ends them is gone over once.
_BLOCK = r"-----BEGIN [A-Z ]{0,30}PRIVATE KEY-----[^-\x01]*+(?:-(?!----)[^-\x01]*+){0,40}+-----END [A-Z ]{0,30}PRIVATE KEY-----"
CANDIDATE = f"{_BLOCK}|{_NAMED}|{_RUN}"
#: Words that stand near secrets, words that stand near look-alikes, beginnings
#: of known keys, and parts of paths that hold examples.
NEAR_WORDS = r"(?i)(secret|token|passw(or)?d|pwd|api[ _-]?key|access[ _-]?key|private[ _-]?key|auth|credential|bearer)"
OTHER_WORDS = r"(?i)(sha-?[0-9]*|md5|hash|checksum|digest|commit|uuid|guid|base64|color|version|example|placeholder)"
KNOWN = r"^(AKIA|ASIA|ghp_|gho_|github_pat_|xox[abp]-|sk-|sk_live_|AIza|glpat-|eyJ|-----BEGIN)"
EXAMPLE_PATHS = r"(?i)(test|example|sample|mock|fixture|doc)"
BEFORE, AFTER = 60, 20
#: A word is in the dictionary if the corpus has it so often.
DICTIONARY_COUNT = 3
#: The forest is fitted on so many labelled findings: about as many planted ones, or at most
#: as many reviewed ones (those whose hashed keys are least).
TRAIN_ROWS = 20_000
TREES, DEPTH, SEED = 30, 8, 5
FLOOR = -12.0
FEATURES = ["size", "digits", "uppers", "lowers", "others", "runs", "entropy", "hex", "transitions", "dictionary", "near", "other_near", "assigned", "quoted", "known", "path_example", "path_depth"]


def text_key() -> Column:
    return F.xxhash64("doc_id", "text")


def pieces() -> Column:
    """``text`` cut at the candidates: text between them at even places, candidates at odd
    ones. One pass of the pattern puts marks around matches; characters that serve as marks
    are written in two others meanwhile."""
    plain = F.replace(F.replace("text", F.lit("\x02"), F.lit("\x02\x03")), F.lit("\x01"), F.lit("\x02\x04"))
    marked = F.split(F.regexp_replace(plain, F.lit(CANDIDATE), F.lit("\x01$0\x01")), "\x01", -1)
    back = lambda x: F.replace(F.replace(x, F.lit("\x02\x04"), F.lit("\x01")), F.lit("\x02\x03"), F.lit("\x02"))
    return F.transform(marked, back)


def candidates(docs: DataFrame) -> DataFrame:
    """``cid, dk, i, doc_id, path, start, end, value, before, after`` for each candidate of
    ``docs(doc_id, text, source)``, the i-th of its text; places in code points, ends exclusive."""
    path = F.coalesce(F.col("source").cast("string"), F.lit("")) if "source" in docs.columns else F.lit("")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", path.alias("path"))
    rows = rows.select("doc_id", "path", text_key().alias("dk"), pieces().alias("p"), F.monotonically_increasing_id().alias("row")).filter(F.size("p") > 1)
    found = F.transform(F.sequence(F.lit(1), F.size("p") - 2, F.lit(2)), lambda i: F.struct(F.get("p", i).alias("m"), F.get("p", i - 1).alias("b"), F.get("p", i + 1).alias("a")))
    each = rows.select("row", "dk", "doc_id", "path", F.posexplode(found).alias("i", "x"))
    each = each.select("row", "dk", "doc_id", "path", "i", F.col("x.m").alias("value"), F.col("x.b").alias("b"), F.substring("x.a", 1, AFTER).alias("after"))
    order = Window.partitionBy("row").orderBy("i")
    end = F.sum(F.length("b") + F.length("value")).over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    each = each.withColumn("end", end).withColumn("start", F.col("end") - F.length("value"))
    return each.select(F.xxhash64("row", "i").alias("cid"), "dk", "i", "doc_id", "path", "start", "end", "value", F.expr(f"right(b, {BEFORE})").alias("before"), "after")


def dictionary(docs: DataFrame) -> DataFrame:
    """``word, n`` of the letter words that all of ``docs(text)`` have often enough."""
    words = docs.select(F.explode(F.split(F.lower("text"), "[^a-z]+")).alias("word")).filter(F.length("word").between(3, 64))
    return words.groupBy("word").agg(F.count("*").alias("n")).filter(F.col("n") >= DICTIONARY_COUNT)


def transitions(words: DataFrame) -> DataFrame:
    """``pair, logp``: at most 26 * 26 rows, which the driver may hold."""
    pairs = words.select(F.explode(F.expr("transform(sequence(1, length(word) - 1), i -> substring(word, i, 2))")).alias("pair"), "n")
    pairs = pairs.groupBy("pair").agg(F.sum("n").alias("n"))
    return pairs.select("pair", F.log(F.col("n") / F.sum("n").over(Window.partitionBy(F.substring("pair", 1, 1)))).alias("logp"))


def features(found: DataFrame, words: DataFrame) -> DataFrame:
    """``found`` with the columns of ``FEATURES``."""
    size = F.length("value").cast("double")
    share = lambda pattern: F.length(F.regexp_replace("value", f"[^{pattern}]", "")) / size
    classes = F.col("value")
    for pattern, c in (("[a-z]", "a"), ("[A-Z]", "b"), ("[0-9]", "c"), ("[^abc]", "d")):
        classes = F.regexp_replace(classes, pattern, c)
    # entropy from the lengths of runs among the sorted characters
    entropy = F.expr(
        """aggregate(array_append(array_sort(split(value, '')), ''), struct('' as c, 0.0D as n, 0.0D as s),
            (acc, x) -> if(x = acc.c, struct(acc.c as c, acc.n + 1 as n, acc.s as s), struct(x as c, 1.0D as n, acc.s + if(acc.n > 1, acc.n * log2(acc.n), 0.0D) as s)),
            acc -> log2(length(value)) - acc.s / length(value))"""
    )
    table = {r["pair"]: r["logp"] for r in transitions(words).collect()}
    letters = [chr(97 + i) for i in range(26)]
    matrix = F.array(*[F.lit(float(table.get(a + b, FLOOR))) for a in letters for b in letters])
    pairs = F.transform(F.col("letters"), lambda c, i: F.when((c >= 0) & (c < 26) & (F.get("letters", i + 1) >= 0) & (F.get("letters", i + 1) < 26), F.get(matrix, c * 26 + F.get("letters", i + 1))).otherwise(F.lit(FLOOR)))
    spread = F.aggregate(F.slice(pairs, 1, F.size("letters") - 1), F.lit(0.0), lambda a, x: a + x) / (F.size("letters") - 1)
    found = found.withColumn("letters", F.transform(F.split(F.lower("value"), ""), lambda c: F.ascii(c) - 97))
    out = found.select(
        *[c for c in found.columns if c != "letters"],
        F.when(F.size("letters") > 1, spread).otherwise(F.lit(FLOOR)).alias("transitions"),
        size.alias("size"),
        share("0-9").alias("digits"),
        share("A-Z").alias("uppers"),
        share("a-z").alias("lowers"),
        (1 - share("0-9A-Za-z")).alias("others"),
        (F.length(F.regexp_replace(classes, r"(.)\1*", "$1")) / size).alias("runs"),
        entropy.alias("entropy"),
        F.col("value").rlike("^([0-9a-f]+|[0-9A-F]+)$").cast("double").alias("hex"),
        F.col("before").rlike(NEAR_WORDS).cast("double").alias("near"),
        F.col("before").rlike(OTHER_WORDS).cast("double").alias("other_near"),
        F.col("before").rlike("[:=]\\s*[\"']?$").cast("double").alias("assigned"),
        F.col("value").rlike(KNOWN).cast("double").alias("known"),
        (F.col("before").rlike("[\"'`]$") & F.col("after").rlike("^[\"'`]")).cast("double").alias("quoted"),
        F.col("path").rlike(EXAMPLE_PATHS).cast("double").alias("path_example"),
        F.size(F.split("path", "/")).cast("double").alias("path_depth"),
    )
    runs = found.select("cid", F.length("value").alias("size"), F.explode(F.filter(F.split(F.lower("value"), "[^a-z]+"), lambda w: F.length(w) >= 3)).alias("word"))
    known = runs.join(words.select("word"), "word").groupBy("cid").agg((F.sum(F.length("word")) / F.first("size")).alias("dictionary"))
    return out.join(known, "cid", "left").withColumn("dictionary", F.coalesce("dictionary", F.lit(0.0)))


def _made(h: Column) -> list[tuple[float, Column, Column, Column]]:
    """Label, text before, value and text after of every kind of planted finding, from a hash."""
    hx = F.sha2(h.cast("string"), 256)
    bits = F.base64(F.unhex(hx))
    plain = F.translate(bits, "+/=", "x7")
    size = (F.pmod(F.shiftright(h, 20), F.lit(24)) + 16).cast("int")
    cut = lambda v, n=size: F.substring(v, F.lit(1), F.lit(n) if isinstance(n, int) else n)
    some = lambda *words: F.element_at(F.array(*[F.lit(w) for w in words]), (F.pmod(F.shiftright(h, 12), F.lit(len(words))) + 1).cast("int"))
    word = some("alpha", "buffer", "cursor", "daemon", "editor", "folder", "garden", "header", "island", "jungle")
    name = some("password", "passwd", "secret", "token", "api_key", "API_KEY", "access_key", "SECRET_KEY", "auth_token", "private_key")
    sign = some('="', " = '", ': "', "=", ": ", " = ")
    quote = some('"', "'", '"', "", "", "")
    mixed = F.concat(cut(plain, 5), F.lit("!"), F.substring(plain, 8, 6), F.lit("#"))
    uuid = F.concat_ws("-", cut(hx, 8), F.substring(hx, 9, 4), F.substring(hx, 13, 4), F.substring(hx, 17, 4), F.substring(hx, 21, 12))
    number = F.translate(hx, "abcdef", "012345")
    block = F.concat(F.lit("-----BEGIN RSA PRIVATE KEY-----\n"), bits, F.lit("\n"), F.reverse(bits), F.lit("\n-----END RSA PRIVATE KEY-----"))
    empty = F.lit("")
    return [
        (1.0, F.concat(name, sign), cut(hx, 40), quote),
        (1.0, F.concat(name, sign), cut(hx), quote),
        (1.0, F.concat(name, sign), cut(plain), quote),
        (1.0, F.concat(name, sign), bits, quote),
        (1.0, F.concat(some("password", "passwd", "pwd"), sign), mixed, quote),
        (1.0, some("Authorization: Bearer ", "auth: ", "credential "), cut(plain, 40), empty),
        (1.0, F.concat(F.lit("https://host/path?"), some("token=", "access_token=", "api_key=")), cut(plain), F.lit("&page=2")),
        (1.0, some("key ", "use ", ""), F.concat(F.lit("AKIA"), F.upper(cut(plain, 16))), empty),
        (1.0, some("with ", "", "login "), F.concat(some("ghp_", "sk-", "xoxb-", "glpat-"), cut(plain, 36)), empty),
        (1.0, empty, block, empty),
        (0.0, some("commit ", "sha1 ", "revision ", "at "), cut(hx, 40), empty),
        (0.0, some("sha256: ", "md5 = ", 'checksum="', "digest: "), cut(hx), empty),
        (0.0, some("id=", "uuid: ", 'guid="', "item "), uuid, empty),
        (0.0, some("order ", "number: ", "id=", "account "), cut(number), empty),
        (0.0, some("call ", "the function ", "class ", ""), F.concat(word, F.lit("FromUser"), F.initcap(word), F.lit("ById2")), empty),
        (0.0, some("see ", "in ", "path=", "https://host/"), F.concat(word, F.lit("/share/"), word, F.lit("-docs/chapter-2/index")), empty),
        (0.0, some("file ", "name: ", ""), F.concat(word, F.lit("_"), word, F.lit("_2024_01_31_final")), empty),
        (0.0, F.concat(name, sign), F.concat(F.lit("your-"), word, F.lit("-here-1234")), quote),
        (0.0, F.concat(name, sign), some("xxxxxxxxxxxxxxxx1", "changeme12345678", "********", "0000000000000000", "${SECRET_VALUE_1}", "environment.value"), quote),
        (0.0, some("data:image/png;base64,", "src=base64,"), F.concat(bits, F.reverse(plain)), empty),
        (0.0, some("version ", "build: ", "release "), F.concat(F.lit("2024-01-31-"), word, F.lit("-build-17")), empty),
        (0.0, some("", "- ", "> "), F.concat(word, word, F.lit("12345678")), empty),
        (0.0, some("token ", "the secret ", "a password "), F.concat(word, F.lit("Of"), F.initcap(word), F.lit("InTheGarden7")), empty),
    ]


def planted(docs: DataFrame, rows: int = TRAIN_ROWS) -> DataFrame:
    """``doc_id, text, source, kind, label, lo, hi``: findings put between words of about
    ``rows`` texts (those whose hash lies under a bound); ``lo`` to ``hi`` is the planted value."""
    path = F.coalesce(F.col("source").cast("string"), F.lit("")) if "source" in docs.columns else F.lit("")
    h = F.xxhash64(F.coalesce(F.col("doc_id").cast("long"), F.lit(0)), F.coalesce("text", F.lit("")), F.lit("planted"))
    some = docs.select(h.alias("h"), path.alias("source"), F.substring(F.coalesce("text", F.lit("")), 1, 400).alias("head"))
    bound = int(min(1.0, rows / max(1, docs.count())) * (1 << 53)) - (1 << 52)
    some = some.filter(F.shiftright("h", 11) < bound)
    made = _made(F.col("h"))
    kind = F.pmod(F.xxhash64("h"), F.lit(len(made))).cast("int")
    pick = lambda j: F.element_at(F.array(*[x[j] if isinstance(x[j], Column) else F.lit(x[j]) for x in made]), F.col("kind") + 1)
    out = some.withColumn("kind", kind).select("h", "source", "kind", "head", pick(0).alias("label"), pick(1).alias("b"), pick(2).alias("v"), pick(3).alias("a"))
    at = (F.pmod(F.shiftright("h", 30), F.lit(200)) + 1).cast("int")
    before = F.concat(F.substring("head", at, F.lit(80)), F.lit(" "), "b")
    after = F.concat("a", F.lit(" "), F.substring("head", at + 80, F.lit(60)))
    return out.select(F.col("h").alias("doc_id"), F.concat(before, "v", after).alias("text"), "source", "kind", "label", F.length(before).alias("lo"), (F.length(before) + F.length("v")).alias("hi"), F.pmod(F.xxhash64("h", F.lit(1)), F.lit(5)).alias("fold"))


def _labelled(docs: DataFrame, words: DataFrame) -> DataFrame:
    """Features, ``label``, ``kind`` and ``fold`` of the planted findings."""
    made = stored(docs.sparkSession, planted(docs), "planted")
    table = features(stored(docs.sparkSession, candidates(made), "planted-candidates"), words)
    where = made.select("doc_id", "kind", "label", "lo", "hi", "fold").dropDuplicates(["doc_id"])
    return table.join(where, "doc_id").filter("start < hi and end > lo").drop("lo", "hi")


def _forest(sample: DataFrame):
    """A fitted forest of ``sample(*FEATURES, label)``; None where all labels are of one kind."""
    from pyspark.ml.classification import RandomForestClassifier
    from pyspark.ml.feature import VectorAssembler

    vector = VectorAssembler(inputCols=FEATURES, outputCol="vector")
    sample = stored(sample.sparkSession, vector.transform(sample).select("vector", "label"), "labelled")
    if sample.select("label").distinct().count() < 2:
        return None
    return RandomForestClassifier(featuresCol="vector", labelCol="label", numTrees=TREES, maxDepth=DEPTH, seed=SEED).fit(sample)


def _judged(table: DataFrame, forest) -> DataFrame:
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.functions import vector_to_array

    if forest is None:
        rule = (F.col("known") == 1) | ((F.col("near") == 1) & (F.col("assigned") == 1) & (F.col("entropy") >= 3))
        return table.withColumn("score", rule.cast("double"))
    wide = VectorAssembler(inputCols=FEATURES, outputCol="vector").transform(table)
    return forest.transform(wide).withColumn("score", vector_to_array("probability")[1])


def held_out(docs: DataFrame) -> DataFrame:
    """``kind, label, n, n_flagged`` of planted findings that the forest was not fitted on."""
    spark = docs.sparkSession
    words = stored(spark, dictionary(docs), "dictionary")
    table = stored(spark, _labelled(docs, words), "planted-features")
    out = _judged(table.filter("fold = 0"), _forest(table.filter("fold > 0")))
    return out.groupBy("kind", "label").agg(F.count("*").alias("n"), F.count_if(F.col("score") >= 0.5).alias("n_flagged"))


def findings(docs: DataFrame, labelled: DataFrame | None = None) -> DataFrame:
    """Candidates of ``docs(doc_id, text, source)`` with ``score`` (the forest's
    probability) and ``is_secret``; ``labelled(doc_id, start, end, label)`` has reviewed
    findings, in place of planted ones.

    Null and empty texts have no candidates; repeated rows repeat theirs; an empty table
    gives no rows; with labels of one kind, or none, a rule decides (a known beginning, or
    an assignment next to a telling word, of some entropy).
    """
    spark = docs.sparkSession
    found = stored(spark, candidates(docs), "candidates")
    words = stored(spark, dictionary(docs), "dictionary")
    table = stored(spark, features(found, words), "candidate-features")
    if labelled is None:
        sample = _labelled(docs, words).filter("fold > 0")
    else:
        labels = table.join(labelled.select("doc_id", "start", "end", F.col("label").cast("double").alias("label")), ["doc_id", "start", "end"])
        sample = labels.orderBy(F.xxhash64("doc_id", "start"), "cid").limit(TRAIN_ROWS)
    return _judged(table, _forest(sample)).withColumn("is_secret", F.col("score") >= 0.5)


def secret_report(docs: DataFrame, labelled: DataFrame | None = None) -> DataFrame:
    """``doc_id, start, end, length, value_sha256, score, is_secret`` of every candidate;
    values themselves are not given out."""
    out = findings(docs, labelled)
    return out.select("doc_id", "start", "end", F.length("value").cast("long").alias("length"), F.sha2("value", 256).alias("value_sha256"), F.round("score", 6).alias("score"), "is_secret")


MASK = "<secret>"


def mask_secrets(docs: DataFrame) -> DataFrame:
    """All rows of ``docs`` with all their columns, each secret in ``text`` replaced by
    ``MASK`` and ``n_chars``, where there is one, brought up to date.

    Null texts stay null; rows that repeat one another are masked alike; an empty table
    gives no rows. Time is in proportion to the text, however long it is and however many
    secrets it holds. Columns named ``__rf_dk`` or ``__rf_secret`` aren't allowed.
    """
    judged = findings(docs).groupBy("dk", "i").agg(F.max("is_secret").alias("secret"))
    flags = judged.groupBy("dk").agg(F.array_sort(F.collect_list(F.struct("i", "secret"))).alias("x"), F.count_if("secret").alias("n")).filter("n > 0")
    flags = flags.select(F.col("dk").alias("__rf_dk"), F.transform("x", lambda c: c["secret"]).alias("__rf_secret"))
    rows = docs.withColumn("__rf_dk", text_key()).join(flags, "__rf_dk", "left")
    masked = F.array_join(F.transform(pieces(), lambda x, k: F.when((k % 2 == 1) & F.get("__rf_secret", F.floor((k - 1) / 2).cast("int")), F.lit(MASK)).otherwise(x)), "")
    rows = rows.withColumn("text", F.when(F.col("__rf_secret").isNull(), F.col("text")).otherwise(masked))
    if "n_chars" in docs.columns:
        kind = dict(docs.dtypes)["n_chars"]
        rows = rows.withColumn("n_chars", F.when(F.col("__rf_secret").isNull(), F.col("n_chars")).otherwise(F.length("text").cast(kind)))
    return rows.select(*docs.columns)
