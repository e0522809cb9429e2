"""Registered queries of the operators, one each, over their whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from rankframe.llm import alignment, archives, centroids, decontam, licenses, packing, pii, quality, repeats, resample, secret_scan, simhash, tokenstore


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan_licenses(table(spark, sf_dir, "documents"))


def op2_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = tokenstore.store_and_read(table(spark, sf_dir, "documents"), tokenizer_path(), end_id=2)
    return out.select("doc_id", "start", "n_tokens", "ids_crc32")


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality_figures(table(spark, sf_dir, "documents"))


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op5_repeat_removal(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats.remove_repeats(table(spark, sf_dir, "documents"), length=200)


def op6_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.secret_report(table(spark, sf_dir, "documents"))


def op7_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.personal_data(table(spark, sf_dir, "documents"))


def op8_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), tokenizer_path(), end_id=0, capacity=2048)


def op9_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resample.select_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op10_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op11_centroid_clustering(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = centroids.cluster_vectors(table(spark, sf_dir, "embeddings"))
    return out.select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def op12_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.align_tokenizers(table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json"), tokenizer_path("piece_bpe_32k.model"))


def op13_archive_conversion(spark: SparkSession, sf_dir: str) -> DataFrame:
    return archives.archive_pages(table(spark, sf_dir, "pages"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_license_scan": op1_license_scan,
    "op2_token_store": op2_token_store,
    "op3_quality_rules": op3_quality_rules,
    "op4_decontamination": op4_decontamination,
    "op5_repeat_removal": op5_repeat_removal,
    "op6_secret_scan": op6_secret_scan,
    "op7_personal_data": op7_personal_data,
    "op8_best_fit_packing": op8_best_fit_packing,
    "op9_importance_resampling": op9_importance_resampling,
    "op10_simhash_near_dedup": op10_simhash_near_dedup,
    "op11_centroid_clustering": op11_centroid_clustering,
    "op12_token_alignment": op12_token_alignment,
    "op13_archive_conversion": op13_archive_conversion,
}


def _lloyd_sql(k: int = 8, rounds: int = 10) -> str:
    """Full scans in every round, in integers."""
    parts = [
        """v AS MATERIALIZED (SELECT row_number() OVER () AS rid, vec_id, list_transform(embedding, lambda x: floor(1024::DOUBLE * x::DOUBLE)::BIGINT) AS v FROM embeddings
 WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = 64)""",
        f"c0 AS MATERIALIZED (SELECT (row_number() OVER (ORDER BY sha256('3:' || vec_id::VARCHAR)) - 1)::INT AS k, v AS c FROM v QUALIFY row_number() OVER (ORDER BY sha256('3:' || vec_id::VARCHAR)) <= {k})",
    ]
    for i in range(rounds + 1):
        gap = "list_sum(list_transform(range(1, 65), lambda i: (v[i] - c[i]) * (v[i] - c[i])))::BIGINT"
        parts.append(f"a{i} AS MATERIALIZED (SELECT rid, any_value(vec_id) AS vec_id, any_value(v) AS v, min(struct_pack(d := d, k := k)) AS m FROM (SELECT rid, vec_id, v, k, {gap} AS d FROM v, c{i}) GROUP BY rid)")
        if i < rounds:
            parts.append(f"s{i} AS (SELECT k, j, sum(x) AS s, count(*) AS n FROM (SELECT m.k AS k, unnest(range(1, 65)) AS j, unnest(v) AS x FROM a{i}) GROUP BY 1, 2)")
            parts.append(f"n{i} AS (SELECT k, list(((s - ((s % n) + n) % n) // n)::BIGINT ORDER BY j) AS c FROM s{i} GROUP BY k)")
            parts.append(f"c{i + 1} AS MATERIALIZED (SELECT o.k, coalesce(n.c, o.c) AS c FROM c{i} o LEFT JOIN n{i} n USING (k))")
    return (
        f"WITH {', '.join(parts)} SELECT vec_id, m.k AS cluster, m.d AS distance, (sum(m.d) OVER (PARTITION BY m.k))::BIGINT AS cluster_inertia, (sum(m.d) OVER ())::BIGINT AS inertia,"
        f" sha256(array_to_string(c, ',')) AS centroid_sha256 FROM a{rounds} JOIN c{rounds} ON k = m.k"
    )


ORACLE_SQL: dict[str, str] = {
    "op11_centroid_clustering": _lloyd_sql(),
    "op13_archive_conversion": """WITH g AS (SELECT page_id, h, strlen(h) AS n, max(page_id) OVER (PARTITION BY h) AS kept, row_number() OVER (PARTITION BY h ORDER BY page_id DESC NULLS LAST) AS r FROM (SELECT page_id, coalesce(html, '') AS h FROM pages))
 SELECT page_id, n::BIGINT AS payload_bytes, sha1(h) AS payload_digest, CASE WHEN n >= 1000 AND r > 1 THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN n >= 1000 AND r > 1 THEN kept END AS refers_to FROM g""",
}
