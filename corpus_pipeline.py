"""Corpus pipeline: quality rules, near duplicates, benchmark passages, secrets, packing.

Every stage takes ``(spark, docs, sf_dir)`` and returns a DataFrame, which ``run`` writes
to the shared folder and reads back for the next stage. All but the last return the
columns of ``documents``; the last returns one row per packed piece.

In every stage an empty table gives no rows, and other columns pass through unread (names
that begin with ``__rf_`` are taken). Null and empty texts have no words, so the first stage
drops them; given to a later stage alone, they are one group of copies, hold no benchmark
item and no secret, and pack as the end id alone. Rows that repeat one another are judged
alike; of copies one row stays.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from rankframe.llm import decontam, neardup, packing, quality, secret_scan
from rankframe.llm.common import discard, stored
from rankframe.llm.queries import table, tokenizer_path


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail the base rules or lie outside their language's perplexity band
    go; a null language is a language of its own."""
    return quality.keep_good(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies (5-word shingles, similarity >= 0.8) the document with
    the least id stays; a row without id only where no other is."""
    return neardup.keep_one(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item, also with other numbers or names, go. Rows
    without id are judged by their text."""
    return decontam.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are masked in their texts; all documents stay."""
    return secret_scan.mask_secrets(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts become token ids packed into sequences of at most 2048."""
    return packing.pack(docs, tokenizer_path(), end_id=0, capacity=2048)


STAGES = [
    ("quality rules", quality_rules),
    ("near duplicates", near_duplicates),
    ("decontamination", decontaminate),
    ("secrets", mask_secrets),
    ("packing", pack),
]

#: The perplexity model, the forest and the tokenizer can't be expressed in SQL;
#: ``tests/llm/test_pipeline.py`` holds each stage against a plain version instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the last stage gives; each stage's table is deleted once the next is written."""
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        before, docs = docs, stored(spark, stage(spark, docs, sf_dir), f"stage-{k}")
        if k:
            discard(before)
    return docs
