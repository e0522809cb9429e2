"""Registered queries over the driver's tables, and the SQL each must agree with."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from rankframe.functions import prompts, text as T
from rankframe.functions.arithmetic import calculate_column
from rankframe.operators import answers, dense, fusion, graph, ivf, metrics, postings, ranking, rerank, select, sparse, tools
from rankframe.operators.containment import containing
from rankframe.plans import run

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable:
    def add(f: Callable) -> Callable:
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def corpus(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select("doc_id", "text")


def questions(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "benchmark").select(F.col("item_id").alias("query_id"), "text")


def gold_pairs(spark: SparkSession, sf: str) -> DataFrame:
    """Documents that contain a question's whole text."""
    pairs = containing(corpus(spark, sf), questions(spark, sf))
    return pairs.select("query_id", F.col("doc_id").alias("pos"), "doc_id")


# ---- SQL pieces --------------------------------------------------------------------------


def tok(x: str) -> str:
    return rf"list_filter(string_split_regex(regexp_replace(lower({x}), '[^\p{{L}}\p{{N}}_\s]', ' ', 'g'), '\s+'), lambda x: x <> '')"


GOLD = "gold AS (SELECT b.item_id AS query_id, d.doc_id FROM benchmark b JOIN documents d ON contains(d.text, b.text))"
TERMS = f"""d AS (SELECT doc_id, {tok('text')} AS toks FROM documents),
 s AS (SELECT count(*)::DOUBLE AS n, avg(len(toks))::DOUBLE AS avgdl FROM d),
 p AS (SELECT doc_id, term, count(*)::DOUBLE AS tf, any_value(dl)::DOUBLE AS dl FROM (SELECT doc_id, len(toks) AS dl, unnest(toks) AS term FROM d) GROUP BY 1, 2),
 df AS (SELECT term, count(*)::DOUBLE AS df FROM p GROUP BY 1),
 qt AS (SELECT item_id AS query_id, term, count(*)::DOUBLE AS tf, any_value(ln)::DOUBLE AS ln FROM (SELECT item_id, len({tok('text')}) AS ln, unnest({tok('text')}) AS term FROM benchmark) GROUP BY 1, 2)"""
BM25_ALL = f"""{TERMS},
 bw AS (SELECT p.doc_id, p.term, p.tf * 2.5::DOUBLE / (p.tf + 1.5::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * p.dl / s.avgdl)) * greatest(0::DOUBLE, ln((s.n - df.df + 0.5::DOUBLE) / (df.df + 0.5::DOUBLE))) AS w FROM p JOIN df USING (term), s WHERE p.term IN (SELECT term FROM qt)),
 bs AS (SELECT query_id, doc_id, round(sum(w), 6) AS score FROM qt JOIN bw USING (term) GROUP BY 1, 2 HAVING round(sum(w), 6) > 0)"""


def top(scores: str, k: int, name: str = "r", order: str = "score DESC, doc_id") -> str:
    return f"{name} AS (SELECT query_id, doc_id, rank::INT AS rank, score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY {order}) AS rank FROM {scores}) WHERE rank <= {k})"


BM25_10 = f"{BM25_ALL}, {top('bs', 10, 'bm25')}"
TFIDF_10 = f"""idf AS (SELECT term, ln(s.n / (1 + df.df)) AS idf FROM df, s),
 tw AS (SELECT doc_id, term, tf / dl * idf AS w FROM p JOIN idf USING (term)),
 tn AS (SELECT doc_id, sqrt(sum(w * w)) AS norm FROM tw GROUP BY 1),
 qw AS (SELECT query_id, term, tf / ln * idf AS w FROM qt JOIN idf USING (term)),
 qn AS (SELECT query_id, sqrt(sum(w * w)) AS norm FROM qw GROUP BY 1),
 ts AS (SELECT query_id, doc_id, round(sum(tw.w * qw.w) / (CASE WHEN any_value(tn.norm) = 0 THEN 1 ELSE any_value(tn.norm) END * CASE WHEN any_value(qn.norm) = 0 THEN 1 ELSE any_value(qn.norm) END), 6) AS score
        FROM qw JOIN tw USING (term) JOIN tn USING (doc_id) JOIN qn USING (query_id) GROUP BY 1, 2), {top('ts', 10, 'tfidf')}"""
DOT = "list_sum(list_transform(range(1, 65), lambda i: {a}[i]::DOUBLE * {b}[i]::DOUBLE))"
COS = f"""qv AS (SELECT vec_id AS query_id, embedding AS v FROM embeddings WHERE vec_id % 20 = 0),
 cs AS (SELECT query_id, e.vec_id AS doc_id, round({DOT.format(a='qv.v', b='e.embedding')}, 6) AS score FROM qv, embeddings e)"""


def bm25_10(spark: SparkSession, sf: str, words: DataFrame | None = None) -> DataFrame:
    return sparse.bm25(corpus(spark, sf), questions(spark, sf), 10, words=words)


def tfidf_10(spark: SparkSession, sf: str, words: DataFrame | None = None) -> DataFrame:
    return sparse.tfidf(corpus(spark, sf), questions(spark, sf), 10, words=words)


_INDEXES: dict[tuple[str, str], str] = {}


def stored_index(spark: SparkSession, sf: str) -> postings.Index:
    """The index of the documents, built once a session and table."""
    key = spark.sparkContext.applicationId, sf
    if key not in _INDEXES:
        _INDEXES[key] = postings.build_index(corpus(spark, sf))
    return postings.open_index(spark, _INDEXES[key])


def both_10(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """Both rankings from the stored index."""
    index = stored_index(spark, sf)
    return postings.search(index, questions(spark, sf), 10)[0], postings.tfidf_search(index, questions(spark, sf), 10)


def vectors(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "embeddings").select(F.col("vec_id").alias("doc_id"), F.col("embedding").alias("vec"), F.col("label").cast("long").alias("cluster_id"))


def vector_queries(spark: SparkSession, sf: str) -> DataFrame:
    """The stated query set: every row whose id is divisible by 20, against all rows."""
    return vectors(spark, sf).filter(F.col("doc_id") % 20 == 0).select(F.col("doc_id").alias("query_id"), "vec")


# ---- text functions ----------------------------------------------------------------------


@query(f"SELECT doc_id, len({tok('text')})::INT AS n_tokens, len(list_distinct({tok('text')}))::INT AS n_terms FROM documents")
def tokenize_counts(spark: SparkSession, sf: str) -> DataFrame:
    return corpus(spark, sf).select("doc_id", F.size(T.tokens("text")).alias("n_tokens"), F.size(F.array_distinct(T.tokens("text"))).alias("n_terms"))


@query("SELECT p_partkey, concat_ws(chr(10), nullif(p_name, ''), nullif(p_brand, ''), nullif(p_type, '')) AS text FROM part")
def concat_text(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "part").select("p_partkey", T.retrieval_text("p_name", "p_brand", "p_type").alias("text"))


@query("SELECT p_partkey, coalesce(nullif(trim(CASE WHEN p_size % 2 = 0 THEN p_name ELSE '  ' END), ''), 'Skill #' || p_size::VARCHAR, 'Unnamed skill') AS name FROM part")
def display_name(spark: SparkSession, sf: str) -> DataFrame:
    name = F.when(F.col("p_size") % 2 == 0, F.col("p_name")).otherwise("  ")
    return table(spark, sf, "part").select("p_partkey", T.display_name(name, "p_size").alias("name"))


@query("""SELECT doc_id, substr(CASE WHEN length(split_part(text, chr(10), 1)) <= 80 AND trim(substr(text, length(split_part(text, chr(10), 1)) + 2)) <> ''
 THEN substr(text, length(split_part(text, chr(10), 1)) + 2) ELSE text END, 1, 4000) AS passage FROM documents""")
def passage_truncate(spark: SparkSession, sf: str) -> DataFrame:
    return corpus(spark, sf).select("doc_id", T.passage_text(T.drop_title("text")).alias("passage"))


@query("SELECT hash_id, count(*) AS n, min(doc_id) AS first_doc FROM (SELECT doc_id, 'passage-' || md5(text) AS hash_id FROM documents) GROUP BY 1")
def md5_ids(spark: SparkSession, sf: str) -> DataFrame:
    return corpus(spark, sf).select("doc_id", T.content_id("text", "passage").alias("hash_id")).groupBy("hash_id").agg(F.count("*").alias("n"), F.min("doc_id").alias("first_doc"))


@query("""SELECT vec_id, label, round(CASE WHEN hi = lo THEN 1 ELSE (x - lo) / (hi - lo) END, 6) AS scaled FROM (SELECT vec_id, label, embedding[1]::DOUBLE AS x,
 min(embedding[1]::DOUBLE) OVER (PARTITION BY label) AS lo, max(embedding[1]::DOUBLE) OVER (PARTITION BY label) AS hi FROM embeddings)""")
def minmax_by_group(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "embeddings").select("vec_id", "label", F.col("embedding")[0].cast("double").alias("x"))
    return rows.select("vec_id", "label", F.round(ranking.min_max("x", ["label"]), 6).alias("scaled"))


_THINK = "CASE turn % 3 WHEN 0 THEN '<think>' || role || chr(10) || '</think>  ' || text WHEN 1 THEN text || '<think>' || role ELSE text END"


@query(rf"""SELECT conv_id, turn, CASE WHEN contains(t, '<think>') THEN regexp_replace(regexp_replace(regexp_replace(t, '<think>.*?</think>\s*', '', 'gs'), '<think>.*', '', 'gs'), '^\s+', '') ELSE t END AS answer
 FROM (SELECT conv_id, turn, {_THINK} AS t FROM conversations)""")
def strip_think(spark: SparkSession, sf: str) -> DataFrame:
    kind = F.col("turn") % 3
    tagged = F.when(kind == 0, F.concat(F.lit("<think>"), "role", F.lit("\n</think>  "), "text")).when(kind == 1, F.concat("text", F.lit("<think>"), "role")).otherwise(F.col("text"))
    return table(spark, sf, "conversations").select("conv_id", "turn", T.strip_think(tagged).alias("answer"))


@query(r"""SELECT conv_id, turn, regexp_replace(regexp_replace(regexp_replace(regexp_replace(split_part(regexp_extract(t, '.*(?:The answer is:|the answer is:|Therefore, the answer is|therefore, the answer is)(.*)', 1, 's'), chr(10), 1), '^\s+|\s+$', '', 'g'), '\.+$', ''), '/+$', ''), '^\s+|\s+$', '', 'g') AS answer
 FROM (SELECT conv_id, turn, 'the answer is: no' || chr(10) || text || ' Therefore, the answer is ' || role || conv_id::VARCHAR || './' || '.' || chr(10) || 'bye' AS t FROM conversations)""")
def trigger_answer(spark: SparkSession, sf: str) -> DataFrame:
    said = F.concat(F.lit("the answer is: no\n"), "text", F.lit(" Therefore, the answer is "), "role", F.col("conv_id").cast("string"), F.lit("./.\nbye"))
    return table(spark, sf, "conversations").select("conv_id", "turn", T.after_trigger(said).alias("answer"))


_RANKING = "'[' || (item_id % 7)::VARCHAR || '] > [' || (item_id % 5)::VARCHAR || ', 12] 3 ' || item_id::VARCHAR || ' [' || (item_id % 7)::VARCHAR || ']'"


@query(rf"""SELECT item_id, array_to_string(list_transform(l, lambda x: (x - 1)::VARCHAR), ',') AS positions, (l[1] - 1)::INT AS first_choice FROM (
 SELECT item_id, list_filter(list_transform(regexp_extract_all(t, '\d+'), lambda x: x::INT), lambda x: x BETWEEN 1 AND 10) AS all_l,
 list_filter(all_l, lambda x, i: list_position(all_l, x) = i) AS l FROM (SELECT item_id, {_RANKING} AS t FROM benchmark))""")
def parse_ranking(spark: SparkSession, sf: str) -> DataFrame:
    n = lambda k: (F.col("item_id") % k).cast("string")
    said = F.concat(F.lit("["), n(7), F.lit("] > ["), n(5), F.lit(", 12] 3 "), F.col("item_id").cast("string"), F.lit(" ["), n(7), F.lit("]"))
    got = T.ranking_positions(said, 10)
    return table(spark, sf, "benchmark").select("item_id", F.array_join(F.transform(got, lambda x: x.cast("string")), ",").alias("positions"), T.first_choice(said, 10).alias("first_choice"))


@query("""SELECT item_id, CASE item_id % 3 WHEN 0 THEN 'Problem:' || text || chr(10) || 'Solution:' WHEN 1 THEN 'Question: ' || text ELSE text END AS user_prompt,
 'Relevant Skill:' || chr(10) || 'a' || chr(10) || '---' || chr(10) || 'b' || chr(10) || chr(10) || CASE item_id % 3 WHEN 0 THEN 'Problem:' || text || chr(10) || 'Solution:' WHEN 1 THEN 'Question: ' || text ELSE text END AS with_skills FROM benchmark""")
def prompt_build(spark: SparkSession, sf: str) -> DataFrame:
    kind = F.element_at(F.array(F.lit("theoremqa"), F.lit("toolqa"), F.lit("logicbench")), (F.col("item_id") % 3 + 1).cast("int"))
    _, plain = prompts.prompts(kind, F.col("text"))
    _, full = prompts.prompts(kind, F.col("text"), F.array(F.lit("a"), F.lit("b")))
    return table(spark, sf, "benchmark").select("item_id", plain.alias("user_prompt"), full.alias("with_skills"))


@query(r"""SELECT o_orderkey, regexp_extract(a, '^(\w+)\[(.+)\]$', 1, 's') AS kind, regexp_extract(a, '^(\w+)\[(.+)\]$', 2, 's') AS argument
 FROM (SELECT o_orderkey, CASE WHEN o_orderkey % 4 = 0 THEN o_orderpriority ELSE 'FilterDB[o_orderpriority=' || o_orderpriority || ']' END AS a FROM orders)""")
def parse_action(spark: SparkSession, sf: str) -> DataFrame:
    act = F.when(F.col("o_orderkey") % 4 == 0, F.col("o_orderpriority")).otherwise(F.concat(F.lit("FilterDB[o_orderpriority="), "o_orderpriority", F.lit("]")))
    return table(spark, sf, "orders").select("o_orderkey", T.action_type(act).alias("kind"), T.action_argument(act).alias("argument"))


@query("SELECT conv_id, turn, ((length(text) - length(replace(text, 'th', ''))) / 2)::INT AS n_th FROM conversations")
def substring_counts(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "conversations").select("conv_id", "turn", T.occurrences("text", F.lit("th")).alias("n_th"))


@query("""SELECT doc_id, CASE WHEN length(text) > 3000 THEN substr(text, 1, 3000) || '... (truncated, ' || length(text)::VARCHAR || ' chars total)' ELSE text END AS observation FROM documents""")
def truncate_observation(spark: SparkSession, sf: str) -> DataFrame:
    return corpus(spark, sf).select("doc_id", T.shortened("text").alias("observation"))


# ---- retrieval ---------------------------------------------------------------------------


@query(f"WITH {BM25_10} SELECT * FROM bm25")
def bm25_top10(spark: SparkSession, sf: str) -> DataFrame:
    return bm25_10(spark, sf)


@query(f"""WITH {BM25_ALL}, z AS (SELECT b.item_id AS query_id, d.doc_id, coalesce(bs.score, 0) AS score FROM (SELECT item_id FROM benchmark UNION ALL SELECT -1) b, d LEFT JOIN bs ON bs.query_id = b.item_id AND bs.doc_id = d.doc_id), {top('z', 10)} SELECT * FROM r""")
def bm25_padded(spark: SparkSession, sf: str) -> DataFrame:
    asked = questions(spark, sf).union(spark.createDataFrame([(-1, "qqqqqq")], "query_id long, text string"))
    return sparse.bm25(corpus(spark, sf), asked, 10, pad_zero=True)


@query(f"WITH {TERMS} SELECT term, df::BIGINT AS df, round(greatest(0::DOUBLE, ln((s.n - df.df + 0.5::DOUBLE) / (df.df + 0.5::DOUBLE))), 6) AS idf FROM df, s")
def bm25_index_stats(spark: SparkSession, sf: str) -> DataFrame:
    return sparse.index_stats(corpus(spark, sf)).withColumn("idf", F.round("idf", 6))


@query(f"""WITH {TERMS}, {TFIDF_10}, z AS (SELECT b.item_id AS query_id, d.doc_id, coalesce(ts.score, 0) AS score FROM (SELECT item_id FROM benchmark UNION ALL SELECT -1) b, d LEFT JOIN ts ON ts.query_id = b.item_id AND ts.doc_id = d.doc_id), {top('z', 60)} SELECT * FROM r""")
def tfidf_padded(spark: SparkSession, sf: str) -> DataFrame:
    asked = questions(spark, sf).union(spark.createDataFrame([(-1, "qqqqqq")], "query_id long, text string"))
    return sparse.tfidf(corpus(spark, sf), asked, 60, pad_zero=True)


@query(f"WITH {TERMS}, {TFIDF_10} SELECT * FROM tfidf")
def tfidf_top10(spark: SparkSession, sf: str) -> DataFrame:
    return tfidf_10(spark, sf)


@query(f"WITH {COS}, {top('cs', 10)} SELECT * FROM r")
def dense_top10(spark: SparkSession, sf: str) -> DataFrame:
    return dense.dense_topk(vectors(spark, sf), vector_queries(spark, sf), 10)


@query(f"WITH {COS}, {top('cs', 3)} SELECT query_id, string_agg('text ' || doc_id::VARCHAR, chr(10) ORDER BY rank) AS answer FROM r GROUP BY 1")
def dense_top3(spark: SparkSession, sf: str) -> DataFrame:
    rows = vectors(spark, sf).withColumn("text", F.concat(F.lit("text "), F.col("doc_id").cast("string")))
    return dense.retrieve_texts(rows, vector_queries(spark, sf), 3)


def _vector_index(spark: SparkSession, sf: str) -> ivf.VectorIndex:
    rows = vectors(spark, sf)
    return ivf.build(rows, rerank.mean_centers(rows))


@query(f"WITH {COS}, {top('cs', 10)} SELECT * FROM r")
def dense_indexed(spark: SparkSession, sf: str) -> DataFrame:
    return ivf.search(_vector_index(spark, sf), vector_queries(spark, sf), 10)[0]


@query("SELECT q.vec_id AS query_id, (SELECT count(*) FROM embeddings) AS n_all, true AS fewer FROM embeddings q WHERE q.vec_id % 20 = 0")
def vectors_skipped(spark: SparkSession, sf: str) -> DataFrame:
    """Vectors that there are; whether the search scores no more than those."""
    read = ivf.search(_vector_index(spark, sf), vector_queries(spark, sf), 10)[1]
    return read.select("query_id", F.col("n_all").cast("long").alias("n_all"), (F.col("n_scored") <= F.col("n_all")).alias("fewer"))


@query(f"WITH {BM25_10} SELECT * FROM bm25")
def bm25_indexed(spark: SparkSession, sf: str) -> DataFrame:
    return postings.search(stored_index(spark, sf), questions(spark, sf), 10)[0]


@query(f"WITH {TERMS}, {TFIDF_10} SELECT * FROM tfidf")
def tfidf_indexed(spark: SparkSession, sf: str) -> DataFrame:
    return postings.tfidf_search(stored_index(spark, sf), questions(spark, sf), 10)


@query(f"WITH {TERMS} SELECT query_id, sum(df.df)::BIGINT AS n_all, true AS fewer FROM qt JOIN df USING (term) GROUP BY 1")
def postings_skipped(spark: SparkSession, sf: str) -> DataFrame:
    """Postings of each question's terms; whether the search reads no more than those."""
    read = postings.search(stored_index(spark, sf), questions(spark, sf), 10)[1]
    return read.select("query_id", F.col("n_all").cast("long").alias("n_all"), (F.col("n_read") <= F.col("n_all")).alias("fewer"))


# ---- graph -------------------------------------------------------------------------------

_ENT = r"list_distinct(regexp_extract_all(text, '(?:^|[^\p{L}])([A-ZÀ-Þ]\p{L}+(?: [A-ZÀ-Þ]\p{L}+)*)', 1))"
EDGES = f"""e0 AS (SELECT doc_id, text, unnest({_ENT}) AS entity FROM documents),
 e AS (SELECT doc_id, entity, ((length(text) - length(replace(text, entity, ''))) / length(entity))::INT AS n FROM e0)"""


@query(f"WITH {EDGES} SELECT doc_id, entity, n, round(n / sum(n) OVER (PARTITION BY doc_id), 6) AS weight FROM e")
def mention_edges(spark: SparkSession, sf: str) -> DataFrame:
    return graph.mention_edges(corpus(spark, sf)).withColumn("weight", F.round("weight", 6))


@query("SELECT src, dst, 1.0::DOUBLE AS weight FROM (SELECT doc_id AS src, lead(doc_id) OVER (ORDER BY doc_id) AS dst FROM documents) WHERE dst IS NOT NULL")
def adjacency_edges(spark: SparkSession, sf: str) -> DataFrame:
    return graph.adjacency_edges(corpus(spark, sf))


@query(f"""WITH {EDGES} SELECT kind, count(DISTINCT id) AS n FROM (SELECT 'passage' AS kind, md5(text) AS id FROM documents UNION ALL SELECT 'entity', md5(entity) FROM e) GROUP BY 1""")
def graph_nodes(spark: SparkSession, sf: str) -> DataFrame:
    nodes, _ = graph.graph_tables(corpus(spark, sf))
    return nodes.groupBy("kind").agg(F.count("*").alias("n"))


@query(f"WITH {COS}, ent AS (SELECT * FROM cs WHERE doc_id % 20 <> 0), {top('ent', 1)} SELECT query_id AS seed_id, doc_id AS entity_id, score FROM r")
def seed_argmax(spark: SparkSession, sf: str) -> DataFrame:
    rows = vectors(spark, sf)
    return graph.seed_entities(vector_queries(spark, sf).withColumnRenamed("query_id", "seed_id"), rows.filter(F.col("doc_id") % 20 != 0))


# the graph of the hop queries: entities are labels and parities, sentences are vectors
_MENTION = "m AS (SELECT 'l' || label::VARCHAR AS entity_id, vec_id AS sentence_id FROM embeddings UNION SELECT 'b' || (vec_id % 50)::VARCHAR, vec_id FROM embeddings)"
_HOP = """t{h} AS (SELECT DISTINCT query_id, sentence_id FROM (SELECT query_id, sentence_id, row_number() OVER (PARTITION BY query_id, entity_id ORDER BY score DESC, sentence_id) AS r
   FROM l{h}) WHERE r <= 1),
 a{h} AS (SELECT l.query_id, l.sentence_id, sum(l.act) AS act, any_value(l.score) AS sim FROM l{h} l SEMI JOIN t{h} t USING (query_id, sentence_id) GROUP BY 1, 2),
 g{h} AS (SELECT query_id, entity_id, sum(act * sim) AS act FROM a{h} JOIN m USING (sentence_id) GROUP BY 1, 2 HAVING sum(act * sim) > 0)"""
HOPS = f"""{COS}, {_MENTION}, g0 AS (SELECT vec_id AS query_id, 'l' || label::VARCHAR AS entity_id, 1.0::DOUBLE AS act FROM embeddings WHERE vec_id % 20 = 0),
 l1 AS (SELECT g0.query_id, entity_id, g0.act, m.sentence_id, cs.score FROM g0 JOIN m USING (entity_id) JOIN cs ON cs.query_id = g0.query_id AND cs.doc_id = m.sentence_id WHERE g0.act >= 0.5),
 {_HOP.format(h=1)},
 l2 AS (SELECT g1.query_id, entity_id, g1.act, m.sentence_id, cs.score FROM g1 JOIN m USING (entity_id) JOIN cs ON cs.query_id = g1.query_id AND cs.doc_id = m.sentence_id
        WHERE g1.act >= 0.5 AND NOT EXISTS (SELECT 1 FROM t1 WHERE t1.query_id = g1.query_id AND t1.sentence_id = m.sentence_id)),
 {_HOP.format(h=2)}"""


def _hop_inputs(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    rows = vectors(spark, sf)
    mention = rows.select(F.concat(F.lit("l"), F.col("cluster_id").cast("string")).alias("entity_id"), F.col("doc_id").alias("sentence_id"))
    mention = mention.union(rows.select(F.concat(F.lit("b"), (F.col("doc_id") % 50).cast("string")), "doc_id")).distinct()
    seeds = rows.filter(F.col("doc_id") % 20 == 0).select(F.col("doc_id").alias("query_id"), F.concat(F.lit("l"), F.col("cluster_id").cast("string")).alias("entity_id"), F.lit(1.0).alias("score"))
    return seeds, mention, graph.cosine_of(vector_queries(spark, sf), rows.select(F.col("doc_id").alias("sentence_id"), "vec"))


ACTIVATED = "round(sum(act), 6) AS score, round(arg_max(act, tier) FILTER (WHERE tier = 0 OR act >= 0.5), 6) AS last, (max(tier) FILTER (WHERE tier = 0 OR act >= 0.5))::INT AS tier"


@query(f"WITH {HOPS} SELECT query_id, entity_id, {ACTIVATED} FROM (SELECT *, 0 AS tier FROM g0 UNION ALL SELECT *, 1 FROM g1 UNION ALL SELECT *, 2 FROM g2) GROUP BY 1, 2")
def entity_hop_set(spark: SparkSession, sf: str) -> DataFrame:
    return graph.propagate(*_hop_inputs(spark, sf)).withColumns({c: F.round(c, 6) for c in ("score", "last")})


# two hops in order: the one seed takes its best sentence s1; then, of the entities of s1 in
# ascending order, each takes its best sentence that isn't used yet
_BEST = "(SELECT arg_min(cs.doc_id, struct_pack(a := -cs.score, b := cs.doc_id)) FROM m JOIN cs ON cs.doc_id = m.sentence_id WHERE cs.query_id = {q} AND m.entity_id = {e}{no})"
BFS = f"""{COS}, {_MENTION}, s AS (SELECT vec_id AS query_id, 'l' || label::VARCHAR AS seed FROM embeddings WHERE vec_id % 20 = 0),
 h1 AS (SELECT query_id, seed, {_BEST.format(q='s.query_id', e='s.seed', no='')} AS s1 FROM s), h1s AS (SELECT h1.*, cs.score AS sim1 FROM h1 JOIN cs ON cs.query_id = h1.query_id AND cs.doc_id = s1),
 g1 AS (SELECT query_id, s1, entity_id, 1.0::DOUBLE * sim1 AS gain FROM h1s JOIN m ON m.sentence_id = s1 WHERE sim1 >= 0.5),
 o AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY entity_id) AS nth FROM g1),
 p1 AS (SELECT *, {_BEST.format(q='o.query_id', e='o.entity_id', no=' AND m.sentence_id <> o.s1')} AS sent FROM o WHERE nth = 1 AND gain >= 0.5),
 p2 AS (SELECT o.*, {_BEST.format(q='o.query_id', e='o.entity_id', no=' AND m.sentence_id <> o.s1 AND m.sentence_id <> coalesce((SELECT max(sent) FROM p1 WHERE p1.query_id = o.query_id), -1)')} AS sent FROM o WHERE nth = 2 AND gain >= 0.5),
 g2 AS (SELECT p.query_id, m.entity_id, p.gain * cs.score AS gain, p.nth FROM (SELECT * FROM p1 UNION ALL SELECT * FROM p2) p JOIN cs ON cs.query_id = p.query_id AND cs.doc_id = p.sent JOIN m ON m.sentence_id = p.sent WHERE p.gain * cs.score >= 0.5)"""


@query(f"WITH {BFS} SELECT query_id, entity_id, round(sum(gain), 6) AS score, round(arg_max(gain, tier * 10 + nth), 6) AS last, max(tier)::INT AS tier FROM (SELECT query_id, seed AS entity_id, 1.0::DOUBLE AS gain, 1 AS tier, 0 AS nth FROM s UNION ALL SELECT query_id, entity_id, gain, 2, 0 FROM g1 UNION ALL SELECT query_id, entity_id, gain, 3, nth FROM g2) GROUP BY 1, 2")
def entity_hop_bfs(spark: SparkSession, sf: str) -> DataFrame:
    return graph.propagate_in_order(*_hop_inputs(spark, sf)).withColumns({c: F.round(c, 6) for c in ("score", "last")})


def _ppr_sql(n: int) -> str:
    parts = [
        "e0 AS (SELECT 'n' || n_nationkey::VARCHAR AS src, 'r' || n_regionkey::VARCHAR AS dst, 1.0::DOUBLE AS w FROM nation UNION ALL SELECT 's' || s_suppkey::VARCHAR, 'n' || s_nationkey::VARCHAR, 2.0::DOUBLE FROM supplier)",
        "e AS (SELECT * FROM e0 UNION ALL SELECT dst, src, w FROM e0)",
        "st AS (SELECT src, dst, w / sum(w) OVER (PARTITION BY src) AS p FROM e)",
        "rs AS (SELECT r_regionkey::BIGINT AS query_id, 'r' || r_regionkey::VARCHAR AS id, 0.75::DOUBLE AS r FROM region UNION ALL SELECT r_regionkey::BIGINT, 'n' || r_regionkey::VARCHAR, 0.25::DOUBLE FROM region)",
        "x0 AS (SELECT query_id, id, r AS x FROM rs)",
    ]
    for i in range(n):
        parts.append(f"m{i} AS (SELECT query_id, dst AS id, sum(x * p) AS m FROM x{i} JOIN st ON st.src = x{i}.id GROUP BY 1, 2)")
        parts.append(f"k{i} AS (SELECT query_id, sum(m) AS kept FROM m{i} GROUP BY 1)")
        parts.append(f"x{i + 1} AS (SELECT query_id, id, sum(x) AS x FROM (SELECT query_id, id, 0.5::DOUBLE * r + 0.5::DOUBLE * (1 - coalesce(kept, 0)) * r AS x FROM rs LEFT JOIN k{i} USING (query_id) UNION ALL SELECT query_id, id, 0.5::DOUBLE * m FROM m{i}) GROUP BY 1, 2)")
    return f"WITH {', '.join(parts)} SELECT query_id, id, round(x, 6) AS score FROM x{n}"


@query(_ppr_sql(10))
def ppr_scores(spark: SparkSession, sf: str) -> DataFrame:
    name = lambda p, c: F.concat(F.lit(p), F.col(c).cast("string"))
    edges = table(spark, sf, "nation").select(name("n", "n_nationkey").alias("src"), name("r", "n_regionkey").alias("dst"), F.lit(1.0).alias("weight"))
    edges = edges.union(table(spark, sf, "supplier").select(name("s", "s_suppkey"), name("n", "s_nationkey"), F.lit(2.0)))
    region = table(spark, sf, "region").select(F.col("r_regionkey").cast("long").alias("query_id"))
    reset = region.select("query_id", name("r", "query_id").alias("id"), F.lit(3.0).alias("weight")).union(region.select("query_id", name("n", "query_id"), F.lit(1.0)))
    return graph.pagerank(edges, reset, iterations=10).withColumn("score", F.round("score", 6))


@query(f"WITH {COS}, {top('cs', 5)} SELECT query_id, doc_id, rank, CASE WHEN query_id % 40 = 0 THEN score ELSE round(score * 2, 6) END AS score FROM r")
def dense_fallback(spark: SparkSession, sf: str) -> DataFrame:
    """Queries divisible by 40 have no graph scores and fall back to their cosines."""
    base = dense.dense_topk(vectors(spark, sf), vector_queries(spark, sf), 5)
    scored = base.filter(F.col("query_id") % 40 != 0).select("query_id", "doc_id", (F.col("score") * 2).alias("score"))
    return graph.graph_retrieve(scored, base, 5)


# ---- fusion and reranking ----------------------------------------------------------------


@query(f"""WITH {BM25_10}, {TFIDF_10}, u AS (SELECT *, 0 AS src FROM bm25 WHERE query_id IN (SELECT query_id FROM tfidf) UNION ALL SELECT *, 1 FROM tfidf WHERE query_id IN (SELECT query_id FROM bm25)),
 f AS (SELECT query_id, doc_id, min(rank * 2 + src) AS key, arg_min(score, rank * 2 + src) AS score FROM u GROUP BY 1, 2)
 SELECT query_id, doc_id, rank::INT AS rank, score FROM (SELECT query_id, doc_id, score, row_number() OVER (PARTITION BY query_id ORDER BY key) AS rank FROM f) WHERE rank <= 10""")
def round_robin(spark: SparkSession, sf: str) -> DataFrame:
    return fusion.round_robin(*both_10(spark, sf), 10)


@query(f"""WITH {BM25_10}, {TFIDF_10}, b AS (SELECT * FROM tfidf WHERE query_id % 4 <> 0),
 j AS (SELECT coalesce(a.query_id, b.query_id) AS query_id, coalesce(a.doc_id, b.doc_id) AS doc_id, a.rank AS ra, b.rank AS rb, round(coalesce(1.0::DOUBLE / (60 + a.rank), 0) + coalesce(1.0::DOUBLE / (60 + b.rank), 0), 6) AS score
  FROM (SELECT * FROM bm25 WHERE query_id % 4 <> 0) a FULL JOIN b ON a.query_id = b.query_id AND a.doc_id = b.doc_id), {top('j', 10, order='score DESC, ra NULLS LAST, rb')}
 SELECT * FROM r UNION ALL SELECT * FROM bm25 WHERE query_id % 4 = 0""")
def rrf_fuse(spark: SparkSession, sf: str) -> DataFrame:
    a, b = both_10(spark, sf)
    return fusion.rrf(a, b.filter(F.col("query_id") % 4 != 0), 10)


CENTERS = """c0 AS (SELECT label AS cluster_id, i, avg(x) AS x FROM (SELECT label, unnest(range(1, 65)) AS i, unnest(embedding)::DOUBLE AS x FROM embeddings WHERE {where}) GROUP BY 1, 2),
 c1 AS (SELECT cluster_id, sqrt(sum(x * x)) AS norm FROM c0 GROUP BY 1), c AS (SELECT cluster_id::BIGINT AS cluster_id, list(x / norm ORDER BY i) AS center FROM c0 JOIN c1 USING (cluster_id) GROUP BY 1)"""


def _blend_sql(affinity: str, assign: str, k: int = 10) -> str:
    return f"""cand AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM cs) WHERE rank <= 30),
 aff AS (SELECT cand.query_id, cand.doc_id, cand.score, round({affinity}, 9) AS a FROM cand JOIN qv USING (query_id) JOIN {assign} asg USING (doc_id) JOIN c USING (cluster_id) JOIN embeddings ev ON ev.vec_id = cand.doc_id),
 bl AS (SELECT query_id, doc_id, round(0.6::DOUBLE * CASE WHEN sh = sl THEN 1 ELSE (score - sl) / (sh - sl) END + 0.4::DOUBLE * CASE WHEN ah = al THEN 0.5 ELSE (a - al) / (ah - al) END, 6) AS score
  FROM (SELECT *, max(score) OVER w AS sh, min(score) OVER w AS sl, max(a) OVER w AS ah, min(a) OVER w AS al FROM aff WINDOW w AS (PARTITION BY query_id))), {top('bl', k)} SELECT * FROM r"""


_QC = DOT.format(a="qv.v", b="c.center")


@query(f"WITH {COS}, {CENTERS.format(where='true')}, {_blend_sql(_QC, '(SELECT vec_id AS doc_id, label::BIGINT AS cluster_id FROM embeddings)')}")
def kmeans_blend(spark: SparkSession, sf: str) -> DataFrame:
    """Labels are the clusters; their unit means are the centres."""
    rows = vectors(spark, sf)
    candidates = dense.dense_topk(rows, vector_queries(spark, sf), 30)
    return rerank.cluster_blend(candidates, vector_queries(spark, sf), rows, rerank.mean_centers(rows), 0.6, 10)


_ASSIGN = f"asg0 AS (SELECT doc_id, cluster_id, score FROM (SELECT e.vec_id AS doc_id, c.cluster_id, round({DOT.format(a='e.embedding', b='c.center')}, 6) AS score FROM embeddings e, c) QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, cluster_id) = 1)"


@query(f"WITH {CENTERS.format(where='vec_id % 3 <> 0')}, {_ASSIGN} SELECT doc_id, cluster_id, score FROM asg0")
def gold_kmeans_assign(spark: SparkSession, sf: str) -> DataFrame:
    """Rows whose id isn't divisible by 3 are gold; all rows go to the gold centres."""
    rows = vectors(spark, sf)
    return dense.nearest(rows, rerank.mean_centers(rows.filter(F.col("doc_id") % 3 != 0)))


@query(f"WITH {COS}, {CENTERS.format(where='vec_id % 3 <> 0')}, {_ASSIGN}, {_blend_sql(f'{_QC} * ' + DOT.format(a='ev.embedding', b='c.center'), 'asg0')}")
def gold_kmeans_blend(spark: SparkSession, sf: str) -> DataFrame:
    rows = vectors(spark, sf)
    centers = rerank.mean_centers(rows.filter(F.col("doc_id") % 3 != 0))
    candidates = dense.dense_topk(rows, vector_queries(spark, sf), 30)
    return rerank.cluster_blend(candidates, vector_queries(spark, sf), dense.nearest(rows, centers), centers, 0.6, 10, docs=rows)


def _lloyd_sql(rounds: int) -> str:
    """Rounds of k-means on the first eight numbers of each vector, from the rows 0 to 9."""
    parts = ["x AS (SELECT vec_id, list_transform(embedding[1:8], lambda v: v::DOUBLE) AS v FROM embeddings)", "c0 AS (SELECT vec_id AS cluster_id, v FROM x WHERE vec_id < 10)"]
    for i in range(rounds):
        parts.append(f"n{i} AS (SELECT vec_id, arg_min(cluster_id, struct_pack(a := -s, b := cluster_id)) AS cluster_id FROM (SELECT x.vec_id, c.cluster_id, round(list_dot_product(x.v, c.v) - list_dot_product(c.v, c.v) / 2, 6) AS s FROM x, c{i} c) GROUP BY 1)")
        parts.append(f"m{i} AS (SELECT cluster_id, i, avg(x.v[i]) AS a FROM n{i} JOIN x USING (vec_id), range(1, 9) t(i) GROUP BY 1, 2)")
        parts.append(f"c{i + 1} AS (SELECT cluster_id, coalesce(list(a ORDER BY i) FILTER (a IS NOT NULL), any_value(c{i}.v)) AS v FROM c{i} LEFT JOIN m{i} USING (cluster_id) GROUP BY 1)")
    return f"WITH {', '.join(parts)} SELECT cluster_id, array_to_string(list_transform(v, lambda x: round(x, 4)::DECIMAL(9, 4)::VARCHAR), ',') AS center FROM c{rounds}"


@query(_lloyd_sql(3))
def kmeans_fit(spark: SparkSession, sf: str) -> DataFrame:
    """Three rounds from given centres."""
    rows = vectors(spark, sf).select("doc_id", F.slice("vec", 1, 8).alias("vec"))
    start = rows.filter("doc_id < 10").select(F.col("doc_id").alias("cluster_id"), "vec")
    return rerank.lloyd(rows, start, 3).select("cluster_id", F.array_join(F.transform("vec", lambda x: F.round(x, 4).cast("decimal(9,4)").cast("string")), ",").alias("center"))


@query()
def kmeans_sizes(spark: SparkSession, sf: str) -> DataFrame:
    """Clusters fitted with a random start, and how many rows each has."""
    rows = vectors(spark, sf)
    return dense.nearest(rows, rerank.fit_clusters(rows, 10)).groupBy("cluster_id").agg(F.count("*").alias("n"))


@query(f"""WITH {BM25_10}, pr AS (SELECT query_id, bm25.doc_id, score, d.n_chars::DOUBLE AS ce FROM bm25 JOIN documents d USING (doc_id)),
 bl AS (SELECT query_id, doc_id, round(0.7::DOUBLE * CASE WHEN ch = cl THEN 1 ELSE (ce - cl) / (ch - cl) END + 0.3::DOUBLE * CASE WHEN sh = sl THEN 1 ELSE (score - sl) / (sh - sl) END, 6) AS score
  FROM (SELECT *, max(score) OVER w AS sh, min(score) OVER w AS sl, max(ce) OVER w AS ch, min(ce) OVER w AS cl FROM pr WINDOW w AS (PARTITION BY query_id))), {top('bl', 10)} SELECT * FROM r""")
def pair_blend(spark: SparkSession, sf: str) -> DataFrame:
    """Text length stands in for a cross-encoder's score."""
    scored = bm25_10(spark, sf).join(table(spark, sf, "documents").select("doc_id", F.col("n_chars").cast("double").alias("pair_score")), "doc_id")
    return rerank.pair_blend(scored, 0.3, 10)


@query(f"""WITH {BM25_10}, n AS (SELECT *, count(*) OVER (PARTITION BY query_id) AS n FROM bm25),
 a AS (SELECT item_id AS query_id, list_filter(list_transform(regexp_extract_all({_RANKING}, '\\d+'), lambda x: x::INT), lambda x: x > 0) AS l FROM benchmark),
 pl AS (SELECT n.query_id, n.doc_id, n.rank AS src, list_position(a.l, n.rank) AS place FROM n JOIN a USING (query_id))
 SELECT query_id, doc_id, rank::INT AS rank, round(1.0::DOUBLE / rank, 6) AS score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY place NULLS LAST, src) AS rank FROM pl)""")
def listwise_order(spark: SparkSession, sf: str) -> DataFrame:
    n = lambda k: (F.col("query_id") % k).cast("string")
    said = F.concat(F.lit("["), n(7), F.lit("] > ["), n(5), F.lit(", 12] 3 "), F.col("query_id").cast("string"), F.lit(" ["), n(7), F.lit("]"))
    return rerank.listwise(bm25_10(spark, sf), questions(spark, sf).select("query_id", said.alias("text")))


@query(f"""WITH {BM25_10}, {GOLD}, g1 AS (SELECT query_id, min(doc_id) AS doc_id FROM gold GROUP BY 1),
 neg AS (SELECT query_id, doc_id, row_number() OVER (PARTITION BY query_id ORDER BY rank) AS place FROM bm25 ANTI JOIN gold USING (query_id, doc_id) WHERE query_id IN (SELECT query_id FROM g1))
 SELECT query_id, 0 AS place, doc_id, true AS is_gold FROM g1 WHERE query_id IN (SELECT query_id FROM neg) UNION ALL SELECT query_id, place::INT, doc_id, false FROM neg WHERE place <= 4""")
def hard_negatives(spark: SparkSession, sf: str) -> DataFrame:
    return rerank.training_lists(bm25_10(spark, sf), gold_pairs(spark, sf), corpus(spark, sf), 4)


@query(f"""WITH {COS}, {top('cs', 8)}, x AS (SELECT query_id, rank - 1 AS place, score AS de, score * 2 - rank / 10.0::DOUBLE AS ce FROM r),
 z AS (SELECT *, de - max(de) OVER w - ln(sum(exp(de - md)) OVER w) AS lde, ce - max(ce) OVER w - ln(sum(exp(ce - mc)) OVER w) AS lce FROM (SELECT *, max(de) OVER w AS md, max(ce) OVER w AS mc FROM x WINDOW w AS (PARTITION BY query_id)) WINDOW w AS (PARTITION BY query_id))
 SELECT query_id, round(sum(exp(lde) * (lde - lce)), 6) AS kl, round(sum(CASE WHEN place = 0 THEN -lce ELSE 0 END), 6) AS ce, round(sum(exp(lde) * (lde - lce)) + sum(CASE WHEN place = 0 THEN -lce ELSE 0 END), 6) AS loss FROM z GROUP BY 1""")
def distill_loss(spark: SparkSession, sf: str) -> DataFrame:
    rows = dense.dense_topk(vectors(spark, sf), vector_queries(spark, sf), 8)
    rows = rows.select("query_id", (F.col("rank") - 1).alias("place"), F.col("score").alias("de"), (F.col("score") * 2 - F.col("rank") / 10.0).alias("ce"))
    return rerank.distillation_loss(rows).select("query_id", *[F.round(c, 6).alias(c) for c in ("kl", "ce", "loss")])


# ---- selection ---------------------------------------------------------------------------


def _lists(df: DataFrame) -> DataFrame:
    return df.select("query_id", F.array_join(F.transform("doc_ids", lambda x: x.cast("string")), ",").alias("doc_ids"))


@query("SELECT item_id AS query_id, '' AS doc_ids FROM benchmark")
def select_none(spark: SparkSession, sf: str) -> DataFrame:
    return _lists(select.none(questions(spark, sf)))


@query(f"WITH {GOLD} SELECT b.item_id AS query_id, coalesce(string_agg(doc_id::VARCHAR, ',' ORDER BY doc_id), '') AS doc_ids FROM benchmark b LEFT JOIN gold ON gold.query_id = b.item_id GROUP BY 1")
def select_oracle(spark: SparkSession, sf: str) -> DataFrame:
    return _lists(select.as_lists(questions(spark, sf), select.oracle(gold_pairs(spark, sf), corpus(spark, sf))))


@query(f"WITH {BM25_10}, k AS (SELECT doc_id FROM documents WHERE source <> 'src0') SELECT b.item_id AS query_id, coalesce(string_agg(x.doc_id::VARCHAR, ',' ORDER BY rank), '') AS doc_ids FROM benchmark b LEFT JOIN (SELECT * FROM bm25 SEMI JOIN k USING (doc_id) WHERE rank <= 5) x ON x.query_id = b.item_id GROUP BY 1")
def select_topk(spark: SparkSession, sf: str) -> DataFrame:
    known = table(spark, sf, "documents").filter("source <> 'src0'")
    return _lists(select.as_lists(questions(spark, sf), select.topk(bm25_10(spark, sf), known, 5)))


@query(f"""WITH {BM25_10}, a AS (SELECT item_id AS query_id, list_filter(list_transform(regexp_extract_all({_RANKING}, '\\d+'), lambda x: x::INT), lambda x: x BETWEEN 1 AND 10)[1] AS pick FROM benchmark),
 n AS (SELECT query_id, count(*) AS n FROM bm25 GROUP BY 1) SELECT bm25.query_id, 1::INT AS place, doc_id FROM bm25 JOIN a USING (query_id) JOIN n USING (query_id) WHERE rank = CASE WHEN n = 1 THEN 1 ELSE coalesce(pick, 1) END""")
def select_llm(spark: SparkSession, sf: str) -> DataFrame:
    n = lambda k: (F.col("query_id") % k).cast("string")
    said = F.concat(F.lit("["), n(7), F.lit("] > ["), n(5), F.lit(", 12] 3 "), F.col("query_id").cast("string"), F.lit(" ["), n(7), F.lit("]"))
    return select.llm_select(bm25_10(spark, sf), corpus(spark, sf), questions(spark, sf).select("query_id", said.alias("text")), 10)


_PICK = "list_filter({l}, lambda x: NOT list_contains(chosen, x))[1]"


@query(f"""WITH RECURSIVE {BM25_10}, {TFIDF_10}, {GOLD}, g AS (SELECT query_id, list(doc_id ORDER BY doc_id) AS l FROM gold GROUP BY 1), a AS (SELECT query_id, list(doc_id ORDER BY rank) AS l FROM bm25 GROUP BY 1), b AS (SELECT query_id, list(doc_id ORDER BY rank) AS l FROM tfidf GROUP BY 1),
 q AS (SELECT item_id AS query_id, coalesce(g.l, []) AS gold_l, coalesce(a.l, []) AS la, coalesce(b.l, []) AS lb FROM benchmark LEFT JOIN g ON g.query_id = item_id LEFT JOIN a ON a.query_id = item_id LEFT JOIN b ON b.query_id = item_id),
 r AS (SELECT query_id, 0 AS i, gold_l AS chosen, la, lb FROM q UNION ALL
  SELECT query_id, i + 1, CASE WHEN pick IS NULL THEN chosen ELSE list_append(chosen, pick) END, la, lb FROM (SELECT *, CASE WHEN i % 2 = 0 THEN coalesce({_PICK.format(l='la')}, {_PICK.format(l='lb')}) ELSE coalesce({_PICK.format(l='lb')}, {_PICK.format(l='la')}) END AS pick FROM r WHERE i < 4))
 SELECT query_id, array_to_string(list_transform(chosen, lambda x: x::VARCHAR), ',') AS doc_ids FROM r WHERE i = 4""")
def select_distractor(spark: SparkSession, sf: str) -> DataFrame:
    return _lists(select.as_lists(questions(spark, sf), select.distractors(gold_pairs(spark, sf), corpus(spark, sf), *both_10(spark, sf), 4, shuffle=False)))


# ---- metrics -----------------------------------------------------------------------------

_METRIC = ", ".join(
    f"avg(coalesce(h{c} / n_gold, 0)) AS recall_{c}, avg(coalesce(g{c} / (SELECT sum(1 / log2(i + 1)) FROM range(1, least(n_gold, {c})::BIGINT + 1) t(i)), 0)) AS ndcg_{c}" for c in (1, 5, 10)
)
_HITS = ", ".join(f"count(*) FILTER (rank <= {c})::DOUBLE AS h{c}, coalesce(sum(1 / log2(rank + 1)) FILTER (rank <= {c}), 0) AS g{c}" for c in (1, 5, 10))


@query(f"""WITH {BM25_10}, {GOLD}, s1 AS (SELECT query_id, count(*)::DOUBLE AS n_gold FROM gold GROUP BY 1), hh AS (SELECT query_id, {_HITS} FROM bm25 SEMI JOIN gold USING (query_id, doc_id) GROUP BY 1),
 mm AS (SELECT {_METRIC} FROM s1 LEFT JOIN hh USING (query_id)) SELECT metric, round(value, 6) AS value FROM (UNPIVOT mm ON COLUMNS(*) INTO NAME metric VALUE value)""")
def recall_ndcg(spark: SparkSession, sf: str) -> DataFrame:
    gold = gold_pairs(spark, sf)
    asked = metrics.with_gold(questions(spark, sf), gold)
    return metrics.ranking_metrics(bm25_10(spark, sf), gold, asked, 10).withColumn("value", F.round("value", 6))


@query("SELECT round(avg((quality = 1)::INT), 6) AS accuracy, count(*) FILTER (quality = 1) AS correct, count(*) AS total FROM labels JOIN documents USING (doc_id)")
def accuracy(spark: SparkSession, sf: str) -> DataFrame:
    details = table(spark, sf, "labels").join(table(spark, sf, "documents").select("doc_id"), "doc_id").select((F.col("quality") == 1).alias("correct"))
    return metrics.accuracy(details).withColumn("accuracy", F.round("accuracy", 6))


@query(f"WITH {GOLD} SELECT count(*) FILTER (doc_id IN (SELECT doc_id FROM gold)) AS n_gold, count(*) FILTER (doc_id NOT IN (SELECT doc_id FROM gold)) AS n_web FROM documents")
def gold_counts(spark: SparkSession, sf: str) -> DataFrame:
    return metrics.gold_counts(corpus(spark, sf), gold_pairs(spark, sf))


@query(f"""WITH {BM25_10}, {TFIDF_10}, {GOLD}, q AS (SELECT item_id AS query_id, CASE WHEN item_id % 2 = 0 THEN 'even' ELSE 'odd' END AS dataset FROM benchmark), s1 AS (SELECT query_id, count(*) AS n_gold FROM gold GROUP BY 1),
 u AS (SELECT 'bm25' AS run, * FROM bm25 UNION ALL SELECT 'tfidf', * FROM tfidf), h AS (SELECT run, query_id, count(*) AS n FROM u SEMI JOIN gold USING (query_id, doc_id) WHERE rank <= 5 GROUP BY 1, 2)
 SELECT dataset, round(coalesce(sum(h1.n / n_gold), 0) / count(*), 6) AS bm25, round(coalesce(sum(h2.n / n_gold), 0) / count(*), 6) AS tfidf FROM q JOIN s1 USING (query_id) LEFT JOIN (SELECT * FROM h WHERE run = 'bm25') h1 USING (query_id) LEFT JOIN (SELECT * FROM h WHERE run = 'tfidf') h2 USING (query_id) GROUP BY 1""")
def run_pivot(spark: SparkSession, sf: str) -> DataFrame:
    a, b = both_10(spark, sf)
    runs = a.withColumn("run", F.lit("bm25")).unionByName(b.withColumn("run", F.lit("tfidf")))
    asked = questions(spark, sf).select("query_id", F.when(F.col("query_id") % 2 == 0, "even").otherwise("odd").alias("dataset"))
    out = metrics.recall_table(runs, gold_pairs(spark, sf), asked, 5, ["bm25", "tfidf"])
    return out.select("dataset", F.round("bm25", 6).alias("bm25"), F.round("tfidf", 6).alias("tfidf"))


# ---- answers -----------------------------------------------------------------------------


def _orders(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "orders")


_KEY = "o_orderkey::VARCHAR"


@query(rf"""WITH x AS (SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN 'Action: Finish[The ' || {_KEY} || ']' WHEN 1 THEN 'so the answer is: ' || {_KEY} || '.' WHEN 2 THEN 'note' || chr(10) || '  ' || {_KEY} || '.0 ' || chr(10) ELSE 'Finish[true]' END AS t, CASE WHEN o_orderkey % 4 = 3 THEN 'Yes' ELSE {_KEY} END AS gold FROM orders)
 SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN 'The ' || {_KEY} WHEN 1 THEN {_KEY} WHEN 2 THEN {_KEY} || '.0' ELSE 'true' END AS extracted, CASE o_orderkey % 4 WHEN 0 THEN 'exact' WHEN 1 THEN 'exact' WHEN 2 THEN 'numeric' ELSE 'boolean' END AS match FROM x""")
def answer_toolqa(spark: SparkSession, sf: str) -> DataFrame:
    key, kind = F.col("o_orderkey").cast("string"), F.col("o_orderkey") % 4
    said = F.when(kind == 0, F.concat(F.lit("Action: Finish[The "), key, F.lit("]"))).when(kind == 1, F.concat(F.lit("so the answer is: "), key, F.lit("."))).when(kind == 2, F.concat(F.lit("note\n  "), key, F.lit(".0 \n"))).otherwise("Finish[true]")
    got = answers.extract_toolqa(said)
    return _orders(spark, sf).select("o_orderkey", got.alias("extracted"), answers.score_toolqa(got, F.when(kind == 3, F.lit("yes")).otherwise(key)).alias("match"))


@query(r"""SELECT conv_id, turn, CASE turn % 4 WHEN 0 THEN 'yes' WHEN 1 THEN 'no' WHEN 2 THEN 'yes' ELSE 'no' END AS extracted FROM conversations""")
def answer_logic_yesno(spark: SparkSession, sf: str) -> DataFrame:
    kind = F.col("turn") % 4
    said = F.when(kind == 0, F.concat("text", F.lit(" The answer is no. So the answer is **yes** now"))).when(kind == 1, F.concat(F.lit("**No**, "), "text")).when(kind == 2, F.lit("I say no but then again yes!")).otherwise(F.concat("text", F.lit(" it cannot be inferred that is not valid")))
    return table(spark, sf, "conversations").select("conv_id", "turn", answers.extract_yes_no(said).alias("extracted"))


@query(r"""SELECT item_id, CASE item_id % 4 WHEN 0 THEN 'choice_' || (item_id % 5)::VARCHAR WHEN 1 THEN 'choice_3' WHEN 2 THEN 'choice_2' ELSE 'choice_' || (item_id % 5 + 1)::VARCHAR END AS extracted FROM benchmark""")
def answer_logic_choice(spark: SparkSession, sf: str) -> DataFrame:
    kind, n = F.col("item_id") % 4, (F.col("item_id") % 5).cast("string")
    said = F.when(kind == 0, F.concat(F.lit("Choice 1 looks right, but choice_"), n)).when(kind == 1, F.lit("My answer is: ** 3")).when(kind == 2, F.lit("clearly Beta Things hold")).otherwise(F.concat(F.lit("hm\nTherefore, the answer is number "), (F.col("item_id") % 5 + 1).cast("string")))
    asked = F.lit("choice_1: alpha things\nchoice_2: beta things\nchoice_3: gamma")
    return table(spark, sf, "benchmark").select("item_id", answers.extract_choice(said, asked).alias("extracted"))


@query(rf"""SELECT o_orderkey, CASE o_orderkey % 5 WHEN 0 THEN {_KEY} || '.5' WHEN 1 THEN '03/04/2020' WHEN 2 THEN '(12, 3)' WHEN 3 THEN '-7.25' ELSE {_KEY} END AS extracted, o_orderkey % 5 <> 4 OR o_orderkey % 2 = 0 AS correct FROM orders""")
def answer_medcalc(spark: SparkSession, sf: str) -> DataFrame:
    key, kind = F.col("o_orderkey").cast("string"), F.col("o_orderkey") % 5
    said = F.when(kind == 0, F.concat(F.lit("x\nANSWER: **"), key, F.lit(".5**\n"))).when(kind == 1, F.lit("due on 3/4/2020 then")).when(kind == 2, F.lit("she is 12 weeks, 3 days along")).when(kind == 3, F.lit("first 4, then -7.25 mg")).otherwise(F.concat(F.lit('{"answer": "'), key, F.lit('"}')))
    calc = F.when(kind == 1, 13).when(kind == 2, 69).when(kind == 4, 4).otherwise(2)
    truth = F.when(kind == 1, F.lit("3/4/2020")).when(kind == 2, F.lit("(12, 3)")).when((kind == 4) & (F.col("o_orderkey") % 2 == 1), F.concat(key, F.lit("9"))).otherwise(key)
    low, high = F.when(kind == 3, F.lit("-8")).otherwise(key), F.when(kind == 3, F.lit("-29/4")).otherwise((F.col("o_orderkey") + 1).cast("string"))
    got = answers.extract_medcalc(said, F.lit("decimal"), calc)
    return _orders(spark, sf).select("o_orderkey", got.alias("extracted"), answers.score_medcalc(got, truth, F.lit("decimal"), calc, low, high).alias("correct"))


@query("SELECT l_orderkey, l_linenumber, abs(l_extendedprice - l_quantity * 1500) <= greatest(abs(l_quantity * 1500) * 0.04::DOUBLE, 1e-9::DOUBLE) AS near FROM lineitem")
def answer_numeric_eps(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", T.within_eps(F.col("l_extendedprice"), F.col("l_quantity") * 1500).alias("near"))


@query(rf"""SELECT o_orderkey, CASE o_orderkey % 6 WHEN 0 THEN 'canonical' WHEN 1 THEN 'exact' WHEN 2 THEN 'yes_no' WHEN 3 THEN 'numeric' WHEN 4 THEN 'exact_alt' ELSE 'none' END AS match FROM orders""")
def answer_champ_canonical(spark: SparkSession, sf: str) -> DataFrame:
    key, kind = F.col("o_orderkey").cast("string"), F.col("o_orderkey") % 6
    said = F.when(kind == 0, F.concat(key, F.lit(" values"))).when(kind == 1, F.concat(F.lit(" "), key, F.lit(". "))).when(kind == 2, F.lit("It is true")).when(kind == 3, F.concat(F.lit("2*("), key, F.lit(")/2"))).otherwise(key)
    truth = F.when(kind == 2, F.lit("Yes")).when(kind == 4, F.concat(F.lit("C(n, k), or equivalently "), key, F.lit("."))).when(kind == 5, F.concat(F.lit("x"), key)).otherwise(key)
    return _orders(spark, sf).select("o_orderkey", answers.score_champ(said, truth).alias("match"))


@query(rf"""SELECT o_orderkey, CASE o_orderkey % 5 WHEN 0 THEN {_KEY} WHEN 1 THEN 'False' WHEN 2 THEN '(b)' WHEN 3 THEN {_KEY} WHEN 4 THEN '3.14' END AS extracted, o_orderkey % 5 <> 1 AS correct FROM orders""")
def answer_theorem(spark: SparkSession, sf: str) -> DataFrame:
    key, kind = F.col("o_orderkey").cast("string"), F.col("o_orderkey") % 5
    said = F.when(kind == 0, F.concat(F.lit("Therefore, the answer is x = "), key, F.lit(" cm."))).when(kind == 1, F.lit("the answer is: unknown")).when(kind == 2, F.lit("The answer is: (b)")).when(kind == 3, F.concat(F.lit("first 12 then "), key)).otherwise("Therefore, the answer is \\pi")
    truth = F.when(kind == 1, F.lit("True")).when(kind == 2, F.lit("(B)")).when(kind == 4, F.lit("3.1")).otherwise(key)
    got = answers.extract_theorem(said)
    return _orders(spark, sf).select("o_orderkey", got.alias("extracted"), answers.score_theorem(got, truth, F.when(kind == 4, "float").otherwise("integer")).alias("correct"))


@query(rf"""SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN 'symbolic' ELSE 'none' END AS match FROM orders""")
def answer_champ_symbolic(spark: SparkSession, sf: str) -> DataFrame:
    """A square with the key in it, multiplied out; every third one rightly."""
    key = F.col("o_orderkey").cast("string")
    middle = F.when(F.col("o_orderkey") % 3 == 0, F.concat(F.lit("2 "), key)).otherwise(key)
    said = F.concat(F.lit("x^2 + "), middle, F.lit(" x + "), key, F.lit("^2"))
    rows = ranking.spread(_orders(spark, sf).select("o_orderkey"))
    rows = rows.select("o_orderkey", answers.champ_texts(said, F.concat(F.lit("(x + "), key, F.lit(")^2"))).alias("texts"))
    return rows.select("o_orderkey", answers.score_champ_texts(F.col("texts")).alias("match"))


@query("SELECT l_orderkey, l_linenumber, round(l_quantity / (l_linenumber + 2) + l_linenumber ^ 3, 6) AS value, round(l_quantity / (l_linenumber + 2) + l_linenumber ^ 3, 0) % 2 = 0 AND l_quantity % (l_linenumber + 2) = 0 AS even FROM lineitem")
def answer_theorem_latex(spark: SparkSession, sf: str) -> DataFrame:
    """Fractions and powers in LaTeX, by value; integers judged against the next even one."""
    q, n = F.col("l_quantity").cast("long").cast("string"), F.col("l_linenumber").cast("string")
    said = F.concat(F.lit("Therefore, the answer is x = \\frac{"), q, F.lit("}{"), n, F.lit(" + 2} + "), n, F.lit("^{3}."))
    got = ranking.spread(_orders_lines(spark, sf)).select("l_orderkey", "l_linenumber", answers.theorem_texts(said).alias("texts"))
    got = got.select("l_orderkey", "l_linenumber", answers.theorem_answer(F.col("texts")).alias("x"))
    value = F.col("x").cast("double")
    truth = (2 * F.floor(value / 2)).cast("string")
    right = answers.score_theorem(F.col("x"), truth, F.lit("integer")) & (value == F.floor(value))
    return got.select("l_orderkey", "l_linenumber", F.round(value, 6).alias("value"), right.alias("even"))


def _orders_lines(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity")


# ---- tools -------------------------------------------------------------------------------


@query("SELECT o_orderkey, o_orderpriority, o_orderstatus FROM orders WHERE o_orderpriority >= '2' AND o_orderstatus = 'F' AND o_orderkey::VARCHAR < '5'")
def filter_db(spark: SparkSession, sf: str) -> DataFrame:
    rows = tools.as_strings(_orders(spark, sf).select("o_orderkey", "o_orderpriority", "o_orderstatus"))
    out, _ = tools.filter_db(rows, "o_orderpriority>='2', o_orderstatus= F, o_orderkey<5, no operator here")
    return out.withColumn("o_orderkey", F.col("o_orderkey").cast("long"))


@query("SELECT o_custkey, string_agg(o_orderpriority, ', ' ORDER BY o_orderkey) AS value FROM orders GROUP BY 1")
def get_value(spark: SparkSession, sf: str) -> DataFrame:
    """The column of each customer's orders."""
    return tools.values_by(_orders(spark, sf), "o_custkey", "o_orderpriority", "o_orderkey")


@query("SELECT o_orderstatus, count(*) AS n, min(o_orderpriority) AS first_priority FROM orders GROUP BY 1")
def sql_rewrite(spark: SparkSession, sf: str) -> DataFrame:
    tools.as_strings(_orders(spark, sf)).createOrReplaceTempView("orders_data")
    return tools.run_sql(spark, "SELECT o_orderstatus, count(*) AS n, min(o_orderpriority) AS first_priority FROM orders.orders_data GROUP BY o_orderstatus")


@query("SELECT o_orderpriority, round(avg(o_totalprice), 3) AS mean, round(median(o_totalprice), 3) AS median, max(o_totalprice) AS most, min(o_totalprice) AS least, count(*) AS n FROM orders GROUP BY 1")
def calc_aggregates(spark: SparkSession, sf: str) -> DataFrame:
    x = "o_totalprice"
    return _orders(spark, sf).groupBy("o_orderpriority").agg(F.round(F.avg(x), 3).alias("mean"), F.round(F.median(x), 3).alias("median"), F.max(x).alias("most"), F.min(x).alias("least"), F.count("*").alias("n"))


@query("SELECT p_partkey, (p_size * 2 + 1)::VARCHAR AS value FROM part")
def calc_expressions(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "part").select("p_partkey", calculate_column(F.format_string("(%d)*2-(-1)", "p_size")).alias("value"))


@query("""SELECT o_custkey, round(avg(x), 3) AS mean, round(median(x), 3) AS median, round(sum(x), 3) AS total, max(x) AS most, min(x) AS least FROM (SELECT o_custkey, o_totalprice::BIGINT::DOUBLE AS x FROM orders) GROUP BY 1""")
def calc_lists(spark: SparkSession, sf: str) -> DataFrame:
    """The calculator's aggregates over each customer's prices, a ``nan`` among them."""
    price = F.round(F.bround("o_totalprice", 0)).cast("long").cast("string")
    listed = _orders(spark, sf).groupBy("o_custkey").agg(F.array_join(F.collect_list(price), ", ").alias("l"))
    say = lambda name: calculate_column(F.concat(F.lit(f"{name}(nan, "), "l", F.lit(")"))).cast("double")
    return listed.select("o_custkey", say("mean").alias("mean"), say("median").alias("median"), say("sum").alias("total"), say("max").alias("most"), say("min").alias("least"))


def _net(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    name = lambda p, c: F.concat(F.lit(p), F.col(c).cast("string"))
    attrs = lambda c: F.create_map(F.lit("key"), F.col(c).cast("string"))
    g = F.lit("net").alias("graph")
    nodes = table(spark, sf, "region").select(g, name("r", "r_regionkey").alias("id"), F.col("r_name").alias("name"), attrs("r_regionkey").alias("attrs"))
    nodes = nodes.union(table(spark, sf, "nation").select(g, name("n", "n_nationkey"), "n_name", attrs("n_nationkey"))).union(table(spark, sf, "supplier").select(g, name("s", "s_suppkey"), "s_name", attrs("s_suppkey")))
    edges = table(spark, sf, "nation").select(g, name("n", "n_nationkey").alias("src"), name("r", "n_regionkey").alias("dst"), attrs("n_regionkey").alias("attrs"))
    return nodes, edges.union(table(spark, sf, "supplier").select(g, name("s", "s_suppkey"), name("n", "s_nationkey"), attrs("s_nationkey")))


@query("""WITH p AS (SELECT n_name AS a, r_name AS b FROM nation JOIN region ON n_regionkey = r_regionkey UNION ALL SELECT s_name, n_name FROM supplier JOIN nation ON s_nationkey = n_nationkey)
 SELECT 'net' AS graph, a AS name, b AS neighbour FROM p UNION ALL SELECT 'net', b, a FROM p""")
def neighbours(spark: SparkSession, sf: str) -> DataFrame:
    return tools.neighbours(*_net(spark, sf))


@query("""SELECT 'net' AS graph, n_name AS name, n_nationkey::VARCHAR AS key FROM nation UNION ALL SELECT 'net', r_name, r_regionkey::VARCHAR FROM region
 UNION ALL SELECT 'net', s_name, s_suppkey::VARCHAR FROM supplier""")
def node_check(spark: SparkSession, sf: str) -> DataFrame:
    return tools.node_attributes(_net(spark, sf)[0], "net").select("graph", "name", F.col("attrs")["key"].alias("key"))


@query("SELECT n_name AS a, s_name AS b, s_nationkey::VARCHAR AS key FROM supplier JOIN nation ON s_nationkey = n_nationkey")
def edge_check(spark: SparkSession, sf: str) -> DataFrame:
    """The edge of every supplier and its nation, asked for the other way round."""
    nodes, edges = _net(spark, sf)
    asked = table(spark, sf, "supplier").join(table(spark, sf, "nation"), F.col("s_nationkey") == F.col("n_nationkey")).select(F.lit("net").alias("graph"), F.col("n_name").alias("a"), F.col("s_name").alias("b"))
    return tools.edges_between(nodes, edges, asked).select("a", "b", F.col("attrs")["key"].alias("key"))


# ---- runs --------------------------------------------------------------------------------


@query("SELECT DISTINCT conv_id::VARCHAR AS instance_id FROM conversations WHERE conv_id NOT IN (SELECT conv_id FROM conversations WHERE turn = 2)")
def resume_pending(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "conversations").select(F.col("conv_id").cast("string").alias("instance_id"), "turn")
    return run.pending(rows.select("instance_id").distinct(), rows.filter("turn = 2"))


@query("""SELECT conv_id::VARCHAR || '-' || turn::VARCHAR AS instance_id, 'logicbench' AS dataset, CASE WHEN conv_id % 7 <> 0 THEN lower(text) END AS raw_output, CASE WHEN conv_id % 7 = 0 THEN 'ValueError: no answer' END AS error FROM conversations""")
def run_direct(spark: SparkSession, sf: str) -> DataFrame:
    """A stand-in responder that says the question in lower case and fails for some."""
    rows = table(spark, sf, "conversations").select(F.concat(F.col("conv_id").cast("string"), F.lit("-"), F.col("turn").cast("string")).alias("instance_id"), F.lit("logicbench").alias("dataset"), F.when(F.col("conv_id") % 7 == 0, "fail").otherwise(F.col("text")).alias("question"))

    def echo(system: str, user: str) -> str:
        if user == "fail":
            raise ValueError("no answer")
        return user.lower()

    none = spark.createDataFrame([], "instance_id string, place int, skill_id string")
    skills = spark.createDataFrame([], "skill_id string, name string, description string, content string")
    return run.run_many(rows, none, skills, echo).select("instance_id", "dataset", "raw_output", "error")


@query("SELECT s.source AS dataset, m.label FROM (SELECT DISTINCT source FROM documents) s, (VALUES ('llm_direct'), ('oracle_skill'), ('bm25_top1'), ('bm25_select'), ('progressive_disclosure')) m(label)")
def grid_expand(spark: SparkSession, sf: str) -> DataFrame:
    names = [r[0] for r in table(spark, sf, "documents").select("source").distinct().collect()]
    return run.grid(spark, "main", names).select("dataset", "label")
