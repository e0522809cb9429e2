"""Registered queries of sources and sinks: given tables are written in a file format and
read back."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from rankframe.functions import text as T
from rankframe.operators import graph, metrics, rerank
from rankframe.operators.lineage import fresh_path
from rankframe.plans.queries import BM25_10, CENTERS, EDGES, GOLD, bm25_10, corpus, gold_pairs, query, questions, table, vectors
from rankframe.sources import io


def _text(prefix: str, column: str) -> F.Column:
    return F.concat(F.lit(prefix), F.col(column).cast("string"))


# ---- corpora and instances ---------------------------------------------------------------


def _skills(spark: SparkSession, sf: str) -> DataFrame:
    part = table(spark, sf, "part")
    return part.select(_text("s", "p_partkey").alias("skill_id"), F.col("p_name").alias("name"), F.when(F.col("p_size") % 3 > 0, F.col("p_brand")).alias("description"), F.col("p_type").alias("content"))


@query("SELECT 's' || p_partkey::VARCHAR AS skill_id, p_name AS name, CASE WHEN p_size % 3 > 0 THEN p_brand END AS description, p_type AS content FROM part")
def corpus_scan(spark: SparkSession, sf: str) -> DataFrame:
    path = fresh_path(spark, "corpus")
    io.write_arrays(_skills(spark, sf), path, "skill_id")
    return io.read_corpus(spark, path).select("skill_id", "name", "description", "content")


@query("SELECT skill_id, arg_max(name, struct_pack(a := name, b := content)) AS name, arg_max(content, struct_pack(a := name, b := content)) AS content FROM (SELECT 's' || (p_partkey % 300)::VARCHAR AS skill_id, p_name || p_partkey::VARCHAR AS name, p_type AS content FROM part) GROUP BY 1")
def corpus_keyed(spark: SparkSession, sf: str) -> DataFrame:
    """Of repeated ids the last in file order stays; files are in order of the rows."""
    rows = table(spark, sf, "part").select(F.concat(F.lit("s"), (F.col("p_partkey") % 300).cast("string")).alias("skill_id"), F.concat("p_name", F.col("p_partkey").cast("string")).alias("name"), F.col("p_type").alias("content"))
    path = fresh_path(spark, "corpus")
    io.write_arrays(rows, path, "skill_id", per_file=100)
    return io.keyed_corpus(io.read_corpus(spark, path)).select("skill_id", "name", "content")


@query("""SELECT 'o' || o_orderkey::VARCHAR AS instance_id, CASE WHEN o_orderkey % 3 = 0 THEN 'toolqa' ELSE 'champ' END AS dataset, o_orderpriority AS question, (1 + o_orderkey % 2)::INT AS n_skills, o_orderstatus AS answer, (o_orderkey % 70)::INT AS calculator_id FROM orders""")
def instances_scan(spark: SparkSession, sf: str) -> DataFrame:
    key = F.col("o_orderkey")
    rows = table(spark, sf, "orders").select(
        _text("o", "o_orderkey").alias("instance_id"), F.when(key % 3 == 0, "toolqa").otherwise("champ").alias("dataset"), F.col("o_orderpriority").alias("question"),
        F.when(key % 2 == 0, F.array(F.lit("s1"))).otherwise(F.array(F.lit("s1"), F.lit("s2"))).alias("skill_annotations"), F.struct(F.col("o_orderstatus").alias("answer"), (key % 70).cast("int").alias("calculator_id")).alias("eval_data"),
    )
    path = fresh_path(spark, "instances")
    io.write_arrays(rows, path, "instance_id")
    got = io.read_instances(spark, path)
    return got.select("instance_id", "dataset", "question", F.size("skill_annotations").alias("n_skills"), "eval_data.answer", "eval_data.calculator_id")


@query("SELECT 's' || p_partkey::VARCHAR AS skill_id FROM part ORDER BY p_partkey LIMIT 100")
def corpus_head(spark: SparkSession, sf: str) -> DataFrame:
    """The first 100 rows in file order, the limit being the feature."""
    rows = table(spark, sf, "part").select(_text("s", "p_partkey").alias("skill_id"), F.col("p_partkey").alias("pos"))
    return io.first_rows(rows, 100).select("skill_id")


@query("SELECT 's' || p_partkey::VARCHAR AS skill_id, p_name AS name, p_type AS content FROM part ORDER BY p_partkey LIMIT 150")
def corpus_subset(spark: SparkSession, sf: str) -> DataFrame:
    """A smaller corpus of the first 150 rows, written and read."""
    path = fresh_path(spark, "subset")
    rows = _skills(spark, sf).withColumn("pos", F.expr("cast(substring(skill_id, 2) as long)"))
    io.write_subset(rows, 150, path)
    return io.read_subset(spark, path).select("skill_id", "name", "content")


@query("SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) - 1 AS pos FROM orders")
def id_map(spark: SparkSession, sf: str) -> DataFrame:
    return io.dense_ids(table(spark, sf, "orders").select("o_orderkey"), "o_orderkey")


# ---- rankings ----------------------------------------------------------------------------


def _run_file(spark: SparkSession, sf: str) -> str:
    ranked = bm25_10(spark, sf).select(_text("q", "query_id").alias("instance_id"), _text("d", "doc_id").alias("skill_id"), "rank", "score")
    gold_rows = gold_pairs(spark, sf)
    gold = gold_rows.groupBy("query_id").agg(F.array_sort(F.collect_list(_text("d", "doc_id"))).alias("gold_skill_ids"))
    gold = questions(spark, sf).join(gold, "query_id", "left").select(_text("q", "query_id").alias("instance_id"), F.coalesce("gold_skill_ids", F.array().cast("array<string>")).alias("gold_skill_ids"))
    values = metrics.ranking_metrics(bm25_10(spark, sf), gold_rows, metrics.with_gold(questions(spark, sf), gold_rows), 10)
    path = fresh_path(spark, "retrieval")
    io.write_retrieval(ranked, gold, values, path, "bm25", corpus(spark, sf).count(), 10, dataset="benchmark")
    return path


@query(f"WITH {BM25_10} SELECT 'q' || query_id::VARCHAR AS instance_id, 'd' || doc_id::VARCHAR AS skill_id, rank, score FROM bm25")
def retrieval_file(spark: SparkSession, sf: str) -> DataFrame:
    return io.read_retrieval(spark, _run_file(spark, sf))[0]


@query(f"WITH {BM25_10} SELECT 'q' || query_id::VARCHAR AS instance_id, string_agg('d' || doc_id::VARCHAR, ',' ORDER BY rank) AS skills FROM bm25 GROUP BY 1")
def retrieval_lookup(spark: SparkSession, sf: str) -> DataFrame:
    lists = io.as_lookup(io.read_retrieval(spark, _run_file(spark, sf))[0])
    return lists.select("instance_id", F.array_join(F.transform("retrieved", lambda x: x["skill_id"]), ",").alias("skills"))


@query(f"""WITH {BM25_10}, {GOLD}, h AS (SELECT query_id, count(*) AS n_gold, count(*) FILTER (doc_id IN (SELECT doc_id FROM bm25 WHERE bm25.query_id = gold.query_id)) AS n FROM gold GROUP BY 1)
 SELECT 'benchmark' AS dataset, 'bm25' AS retriever, (SELECT count(*) FROM documents) AS corpus_size, 10 AS top_k, (SELECT count(*) FROM benchmark) AS n_queries, (SELECT round(avg(n / n_gold), 6) FROM h) AS recall_10""")
def retrieval_head(spark: SparkSession, sf: str) -> DataFrame:
    head = io.read_retrieval(spark, _run_file(spark, sf))[1]
    return head.select(*[F.col(f"metadata.{c}").alias(c) for c in ("dataset", "retriever", "corpus_size", "top_k", "n_queries")], F.round(F.col("metrics")["recall_10"], 6).alias("recall_10"))


# ---- records -----------------------------------------------------------------------------


@query("""SELECT conv_id::VARCHAR || '-' || turn::VARCHAR AS instance_id, role AS dataset, text AS raw_output, CASE WHEN turn % 2 = 1 THEN 'late' END AS error FROM conversations""")
def inference_records(spark: SparkSession, sf: str) -> DataFrame:
    """Two appends of JSON lines."""
    rows = table(spark, sf, "conversations")
    path = fresh_path(spark, "records")
    for part in (0, 1):
        some = rows.filter(F.col("turn") % 2 == part)
        io.append_records(some.select(F.concat(F.col("conv_id").cast("string"), F.lit("-"), F.col("turn").cast("string")).alias("instance_id"), F.col("role").alias("dataset"), F.col("text").alias("raw_output"), F.lit("late" if part else None).cast("string").alias("error")), path)
    return io.read_records(spark, path).select("instance_id", "dataset", "raw_output", "error")


@query("SELECT lang AS dataset, round(avg((quality = 1)::INT), 6) AS accuracy, count(*) FILTER (quality = 1) AS correct, count(*) AS total, (SELECT count(*) FROM labels JOIN documents USING (doc_id) WHERE lang = 'en') AS n_details FROM labels JOIN documents USING (doc_id) WHERE lang = 'en' GROUP BY 1")
def eval_summary(spark: SparkSession, sf: str) -> DataFrame:
    """A run of one dataset, its summary and details written and read."""
    details = table(spark, sf, "labels").join(table(spark, sf, "documents").filter("lang = 'en'"), "doc_id").select(F.col("lang").alias("dataset"), "doc_id", (F.col("quality") == 1).alias("correct"))
    path = fresh_path(spark, "eval")
    io.write_summary(metrics.summary(details), details, path)
    io.write_summary(metrics.summary(details), details, path, force=True)
    got = spark.read.schema("dataset string, accuracy double, correct long, total long").json(f"{path}/summary")
    return got.select("dataset", F.round("accuracy", 6).alias("accuracy"), "correct", "total", F.lit(spark.read.json(f"{path}/details").count()).alias("n_details"))


# ---- vectors, clusters, graphs, caches ---------------------------------------------------


@query("SELECT 'v-' || (vec_id % 400)::VARCHAR AS hash_id, round(sum(embedding[1]) / count(*), 4) AS x, count(*) AS n FROM (SELECT * FROM embeddings e WHERE vec_id = (SELECT min(vec_id) FROM embeddings f WHERE f.vec_id % 400 = e.vec_id % 400)) GROUP BY 1")
def embedding_store(spark: SparkSession, sf: str) -> DataFrame:
    """An upsert in two steps; ids that the store has are passed over."""
    rows = vectors(spark, sf)
    path = fresh_path(spark, "embeddings")
    make = lambda df: df.select(F.concat(F.lit("v-"), (F.col("doc_id") % 400).cast("string")).alias("hash_id"), F.col("doc_id").cast("string").alias("text"), F.col("vec").alias("embedding"))
    io.upsert_embeddings(make(rows.filter("doc_id < 400")), path)
    io.upsert_embeddings(make(rows), path)
    return io.read_embeddings(spark, path).groupBy("hash_id").agg(F.round(F.avg(F.col("embedding")[0].cast("double")), 4).alias("x"), F.count("*").alias("n"))


@query(f"WITH {CENTERS.format(where='true')} SELECT vec_id AS doc_id, cluster_id, round(center[1], 6) AS x FROM embeddings JOIN c ON cluster_id = label")
def cluster_cache(spark: SparkSession, sf: str) -> DataFrame:
    """Centres and assignment, written and read back."""
    rows = vectors(spark, sf)
    path = fresh_path(spark, "clusters")
    io.write_clusters(rerank.mean_centers(rows), rows, path)
    centers, assignment = io.read_clusters(spark, path)
    return assignment.join(centers, "cluster_id").select("doc_id", "cluster_id", F.round(F.col("vec")[0], 6).alias("x"))


@query("""SELECT 'flights' AS database, o_orderkey::VARCHAR AS id, CASE WHEN o_orderkey % 5 > 0 THEN o_orderstatus ELSE 'nan' END AS value FROM orders UNION ALL SELECT 'yelp', c_custkey::VARCHAR, CASE WHEN c_custkey % 3 > 0 THEN c_mktsegment ELSE 'nan' END FROM customer""")
def tool_tables(spark: SparkSession, sf: str) -> DataFrame:
    root = fresh_path(spark, "tools")
    orders, customers = table(spark, sf, "orders"), table(spark, sf, "customer")
    orders.select(F.col("o_orderkey").alias("id"), F.when(F.col("o_orderkey") % 5 > 0, F.col("o_orderstatus")).alias("value")).write.csv(f"{root}/flights", header=True)
    customers.select(F.col("c_custkey").alias("id"), F.when(F.col("c_custkey") % 3 > 0, F.col("c_mktsegment")).alias("value")).write.json(f"{root}/yelp")
    return io.read_tool_table(spark, root, "flights").select(F.lit("flights").alias("database"), "id", "value").union(io.read_tool_table(spark, root, "yelp").select(F.lit("yelp"), "id", "value"))


@query(f"WITH {EDGES} SELECT DISTINCT 'passage' AS kind, 'passage-' || md5(text) AS id FROM documents UNION ALL SELECT DISTINCT 'entity', 'entity-' || md5(entity) FROM e")
def graph_files(spark: SparkSession, sf: str) -> DataFrame:
    path = fresh_path(spark, "graph")
    io.write_graph(*graph.graph_tables(corpus(spark, sf)), path)
    return io.read_graph(spark, path)[0].select("kind", "id")


@query(f"WITH {EDGES} SELECT DISTINCT 'passage-' || md5(text) AS src, 'entity-' || md5(entity) AS dst, round(weight, 6) AS weight FROM (SELECT *, n / sum(n) OVER (PARTITION BY doc_id) AS weight FROM e) JOIN documents USING (doc_id)")
def graph_edges(spark: SparkSession, sf: str) -> DataFrame:
    path = fresh_path(spark, "graph")
    io.write_graph(*graph.graph_tables(corpus(spark, sf)), path)
    return io.read_graph(spark, path)[1].select("src", "dst", F.round("weight", 6).alias("weight"))


@query("SELECT text, count(*) AS n FROM conversations GROUP BY 1")
def text_lines(spark: SparkSession, sf: str) -> DataFrame:
    path = fresh_path(spark, "lines")
    table(spark, sf, "conversations").select(F.col("text").alias("event"), "role").write.json(path)
    return io.read_texts(spark, path, "event").groupBy("text").agg(F.count("*").alias("n"))


@query("SELECT DISTINCT 'passage-' || md5(text) AS hash_id FROM documents WHERE md5(text) NOT IN (SELECT md5(text) FROM documents WHERE doc_id % 2 = 0)")
def entity_cache_pending(spark: SparkSession, sf: str) -> DataFrame:
    """Passages whose entities the cache lacks, when it has those of even documents."""
    docs = corpus(spark, sf)
    hashed = docs.select("doc_id", "text", T.content_id("text", "passage").alias("hash_id"))
    path = fresh_path(spark, "entities")
    io.append_mentions(hashed.filter("doc_id % 2 = 0").select("hash_id", F.explode_outer(graph.entities("text")).alias("entity")), path)
    return io.pending_hashes(hashed.select("hash_id").distinct(), io.read_mentions(spark, path))
