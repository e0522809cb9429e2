"""Scans and sinks of the file formats. Order in a file is kept in a ``pos`` column."""

from __future__ import annotations

from collections.abc import Iterator
from datetime import datetime, timezone

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from rankframe.operators.lineage import stored

TOOL = "struct<name:string,description:string,parameters:array<struct<name:string,type:string>>,implementation:string>"
CORPUS = f"skill_id string, name string, description string, content string, tools array<{TOOL}>"
INSTANCES = (
    "instance_id string, dataset string, question string, skill_annotations array<string>, eval_data struct<answer:string,answer_type:string,task_type:string,"
    "output_type:string,calculator_id:int,lower_limit:string,upper_limit:string,entry_point:string,test:string,code_prompt:string>"
)
RESULT = "instance_id:string,gold_skill_ids:array<string>,retrieved:array<struct<skill_id:string,score:double>>"
RETRIEVAL = f"metadata struct<dataset:string,retriever:string,corpus_size:long,top_k:int,n_queries:long,timestamp:string,extra:map<string,string>>, metrics map<string,double>, results array<struct<{RESULT}>>"
RECORDS = "instance_id string, dataset string, method string, model string, raw_output string, transcript string, skill_ids_used array<string>, meta map<string,string>, error string"
EMBEDDINGS = "hash_id string, text string, embedding array<float>"
TABLE_FORMATS = {"flights": "csv", "coffee": "csv", "airbnb": "csv", "yelp": "json"}


def _array_file(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Rows of a JSON array file with their place. A file is one task's work; many files go
    to many tasks. Large inputs should be kept as JSON lines or Parquet."""
    rows = spark.read.schema(schema).json(path, multiLine=True)
    return rows.withColumn("pos", F.monotonically_increasing_id())


def write_arrays(rows: DataFrame, path: str, key: str, per_file: int = 1000) -> None:
    """Rows as files of JSON arrays in order of ``key``, about ``per_file`` rows each; rows
    of one key are in one file."""
    files = max(1, -(-rows.count() // per_file))
    whole = F.struct(*rows.columns)
    lists = rows.groupBy(F.pmod(F.xxhash64(key), F.lit(files)).alias("file")).agg(F.array_sort(F.collect_list(F.struct(key, whole.alias("row")))).alias("rows"))
    lists.select(F.to_json(F.transform("rows", lambda r: r["row"])).alias("value"), "file").write.partitionBy("file").text(path)  # an array is a file


def read_corpus(spark: SparkSession, path: str) -> DataFrame:
    return _array_file(spark, path, CORPUS)


def keyed_corpus(corpus: DataFrame) -> DataFrame:
    """One row a ``skill_id``; of repeated ids the last in file order."""
    last = corpus.groupBy("skill_id").agg(F.max("pos").alias("pos"))
    return corpus.join(last, ["skill_id", "pos"], "left_semi")


def read_instances(spark: SparkSession, path: str) -> DataFrame:
    return _array_file(spark, path, INSTANCES)


def first_rows(rows: DataFrame, n: int | None) -> DataFrame:
    """The first n rows in file order, as a feature of small trial runs."""
    if n is None:
        return rows
    bound = rows.select("pos").orderBy("pos").limit(n).agg(F.max("pos")).first()[0]
    return rows.filter(F.col("pos") <= (-1 if bound is None else bound))


def write_subset(corpus: DataFrame, n: int, path: str) -> None:
    """The first n rows in file order as a corpus of its own (JSON lines, with ``pos``)."""
    first_rows(corpus, n).write.json(path)


def read_subset(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(f"{CORPUS}, pos long").json(path)


def as_lookup(ranked: DataFrame) -> DataFrame:
    """``instance_id, retrieved``: each instance's ranked list."""
    lists = F.array_sort(F.collect_list(F.struct("rank", "skill_id", "score")))
    return ranked.groupBy("instance_id").agg(F.transform(lists, lambda x: F.struct(x["skill_id"], x["score"])).alias("retrieved"))


def read_retrieval(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Ranked rows ``instance_id, skill_id, rank, score`` and the one-row metadata."""
    raw = spark.read.schema(RETRIEVAL).json(path, multiLine=True)
    each = raw.select(F.explode("results").alias("r")).select("r.instance_id", F.posexplode("r.retrieved").alias("i", "x"))
    return each.select("instance_id", "x.skill_id", (F.col("i") + 1).alias("rank"), "x.score"), raw.select("metadata", "metrics")


def _with_commas(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Lines of part 1 after the first of them begin with a comma."""
    seen = False
    for batch in batches:
        out = []
        for part, line in zip(*[c.to_pylist() for c in batch.columns]):
            out.append(f",{line}" if part == 1 and seen else line)
            seen |= part == 1
        yield pa.RecordBatch.from_arrays([pa.array(out, pa.string())], ["value"])


def write_retrieval(ranked: DataFrame, gold: DataFrame, metrics: DataFrame, path: str, retriever: str, corpus_size: int, top_k: int, dataset: str | None = None) -> None:
    """One JSON document: metadata, metrics, and a list of results. ``ranked(instance_id,
    skill_id, rank, score)``, ``gold(instance_id, gold_skill_ids)``. The format is one file
    by nature: one task sorts the results, a line each, and writes them as they come;
    ``ranked.write.parquet`` is the scalable sink."""
    results = gold.join(as_lookup(ranked), "instance_id", "left").select("instance_id", "gold_skill_ids", F.coalesce("retrieved", F.array().cast("array<struct<skill_id:string,score:double>>")).alias("retrieved"))
    n_queries = results.count()
    meta = [F.lit(retriever).alias("retriever"), F.lit(corpus_size).cast("long").alias("corpus_size"), F.lit(top_k).alias("top_k"), F.lit(n_queries).cast("long").alias("n_queries"), F.lit(datetime.now(timezone.utc).isoformat()).alias("timestamp")]
    if dataset:
        meta.insert(0, F.lit(dataset).alias("dataset"))
    values = metrics.agg(F.map_from_entries(F.collect_list(F.struct("metric", "value"))).alias("metrics"))
    inside = F.to_json(F.struct(F.struct(*meta).alias("metadata"), "metrics"))
    head = values.select(inside.alias("line")).select(F.lit(0).alias("part"), F.lit("").alias("key"), F.concat(F.expr("left(line, length(line) - 1)"), F.lit(',"results":[')).alias("line"))
    each = results.select(F.lit(1), "instance_id", F.to_json(F.struct("instance_id", "gold_skill_ids", "retrieved")))
    end = ranked.sparkSession.range(1).select(F.lit(2), F.lit(""), F.lit("]}"))
    lines = head.union(each).union(end).repartition(1).sortWithinPartitions("part", "key")
    lines.select("part", "line").mapInArrow(_with_commas, "value string").write.mode("overwrite").text(path)


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """Inference records of JSON lines; blank and torn lines are passed over."""
    return spark.read.schema(RECORDS + ", _bad string").option("columnNameOfCorruptRecord", "_bad").json(path).filter("instance_id is not null and _bad is null").drop("_bad")


def append_records(records: DataFrame, path: str) -> None:
    """Add records as JSON lines; null fields are left out."""
    records.write.mode("append").json(path)


def write_summary(summary: DataFrame, details: DataFrame, path: str, force: bool = False) -> None:
    """Evaluation summary and details; an existing result is kept unless ``force``."""
    mode = "overwrite" if force else "errorifexists"
    summary.write.mode(mode).json(f"{path}/summary")
    details.write.mode(mode).json(f"{path}/details")


def read_embeddings(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(EMBEDDINGS).parquet(path)


def upsert_embeddings(new: DataFrame, path: str) -> DataFrame:
    """Append the rows of ``new(hash_id, text, embedding)`` that the store lacks; returns them."""
    spark = new.sparkSession
    fresh = new.dropDuplicates(["hash_id"])
    try:
        fresh = fresh.join(spark.read.schema(EMBEDDINGS).parquet(path).select("hash_id"), "hash_id", "left_anti")
    except Exception as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
    fresh.select("hash_id", "text", "embedding").write.mode("append").parquet(path)
    return fresh


def pending_hashes(hashes: DataFrame, cache: DataFrame) -> DataFrame:
    """Hashes that a cache (of mentions or vectors) doesn't have yet."""
    return hashes.join(cache.select("hash_id"), "hash_id", "left_anti")


def append_mentions(found: DataFrame, path: str) -> None:
    """Add ``found(hash_id, entity)`` to the cache of named entities; a text without any has
    one row with a null entity, so that it isn't asked for again."""
    found.select("hash_id", "entity").write.mode("append").parquet(path)


def read_mentions(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("hash_id string, entity string").parquet(path)


def write_clusters(centers: DataFrame, assignment: DataFrame, path: str) -> None:
    """Fitted centres ``(cluster_id, vec)`` and the cluster of each row ``(doc_id, cluster_id)``."""
    centers.select("cluster_id", "vec").write.mode("overwrite").parquet(f"{path}/centers")
    assignment.select("doc_id", "cluster_id").write.mode("overwrite").parquet(f"{path}/assignment")


def read_clusters(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    return spark.read.schema("cluster_id long, vec array<double>").parquet(f"{path}/centers"), spark.read.schema("doc_id long, cluster_id long").parquet(f"{path}/assignment")


def write_graph(nodes: DataFrame, edges: DataFrame, path: str) -> None:
    nodes.write.mode("overwrite").parquet(f"{path}/nodes")
    edges.write.mode("overwrite").parquet(f"{path}/edges")


def read_graph(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    return spark.read.parquet(f"{path}/nodes"), spark.read.parquet(f"{path}/edges")


def read_tool_table(spark: SparkSession, root: str, name: str) -> DataFrame:
    """A tool database with every column a string and ``nan`` for what is missing."""
    from rankframe.operators.tools import as_strings

    if name not in TABLE_FORMATS:
        raise ValueError(f"unknown database: {name}")
    path = f"{root}/{name}"
    rows = spark.read.csv(path, header=True, inferSchema=False) if TABLE_FORMATS[name] == "csv" else spark.read.json(path)
    return as_strings(rows)


def read_texts(spark: SparkSession, path: str, field: str) -> DataFrame:
    """One field of JSON lines, as ``text``."""
    return spark.read.schema(f"{field} string").json(path).select(F.col(field).alias("text"))


def dense_ids(rows: DataFrame, key: str) -> DataFrame:
    """Adds ``pos``: 0, 1, ... by key, by two levels of counting instead of one global window."""
    tasks = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    cut = stored(rows.repartitionByRange(tasks, key).withColumn("part", F.spark_partition_id()), "ranges")
    before = F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))  # one row a task
    sizes = cut.groupBy("part").agg(F.count("*").alias("n")).select("part", F.coalesce(before, F.lit(0).cast("long")).alias("before"))
    inside = F.row_number().over(Window.partitionBy("part").orderBy(key)) - 1
    return cut.withColumn("inside", inside).join(F.broadcast(sizes), "part").withColumn("pos", F.col("before") + F.col("inside")).drop("part", "inside", "before")
