"""A training corpus from the documents table: five stages, each one of the operators in qbank.llm."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from qbank.llm import ngram_join, packing, pii, quality, suffix_dedup
from qbank.llm._common import cut


def _recounted(docs: DataFrame) -> DataFrame:
    return docs.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else docs


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents that the quality classifier rejects."""
    return quality.classify(docs).where("keep").select(*docs.columns)


def near_dup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one row of each group of near-duplicates: the one of least doc_id; a null one only where no other is there.

    Rows are told apart by their place in the files that docs is read from, not by doc_id, so that rows that repeat an id, or have
    none, are documents of their own: of two copies one stays, and the next stage finds no copy to take out of the other.
    """
    rows = docs.withColumn("_row", F.monotonically_increasing_id())
    found = ngram_join.near_duplicates(rows.select(F.col("_row").alias("doc_id"), "text")).select(F.col("doc_id").alias("_row"), "component_id")
    groups = rows.select("_row", "doc_id").join(found, "_row").groupBy("component_id")
    kept = groups.agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "_row")).alias("k")).select("k._row")
    return rows.join(kept.hint("shuffle_hash"), "_row", "left_semi").select(*docs.columns)


def suffix_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Removes strings of 400 bytes and passages of 50 words that start elsewhere too; a character cut in two goes as a whole."""
    return _recounted(suffix_dedup.without_passages(docs).select(*docs.columns))


def pii_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Puts the kind in brackets in place of each span of personal data."""
    return _recounted(pii.redact(docs))


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs what is left into sequences; one row per piece, with its ids."""
    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"), with_ids=True)


STAGES = [
    ("quality classifier", quality_stage),
    ("n-gram Jaccard join", near_dup_stage),
    ("suffix-array dedup", suffix_stage),
    ("PII", pii_stage),
    ("packing", packing_stage),
]

#: Seeded models and tokenizers have no SQL; tests compare the stages with brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on the documents table; each stage's rows are written to the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
