"""Corpus pipeline: language ID, near-duplicate removal, benchmark decontamination, packing.

Every stage takes ``(spark, docs, sf_dir)`` and works on all that the one before
kept. The first three return the columns of ``documents``, the last the place of
every piece.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from siteweave.llm import decontaminate, jaccard_join, language_id, packing
from siteweave.llm.common import table
from siteweave.session import scratch_path


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects documents in which the inference finds no language: without a letter, or likelier without any language."""
    return language_id.drop_unknown(docs)


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the smallest id of each group of near duplicates: five-word shingles, similarity of 0.8 or more."""
    return jaccard_join.keep_one(docs, size=5, percent=80)


def clean_of_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects documents that the benchmark's items contaminate."""
    return decontaminate.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs what is left into sequences."""
    return packing.pack_documents(docs)


STAGES = [
    ("language_id", known_language),
    ("ngram_jaccard", one_of_each),
    ("decontamination", clean_of_benchmark),
    ("best_fit_packing", packed),
]

#: Neither mixture inference nor tokens can be said in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = scratch_path(spark, name)
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
