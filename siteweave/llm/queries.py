"""One query per operator over its whole table, with production parameters, and the SQL that matches it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import (
    chat_format,
    decontaminate,
    hilbert_shards,
    jaccard_join,
    language_id,
    lexical_search,
    license_scan,
    mixing,
    packing,
    spelling,
    token_counts,
    topk_search,
    url_filter,
)
from .common import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(fn: Callable[[SparkSession, str], DataFrame]):
        QUERIES[name] = fn
        if sql:
            ORACLES[name] = sql
        return fn

    return register


@query("op1_license_scan")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = license_scan.scan_licenses(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score")


@query("op3_chat_format", chat_format.digest_sql())
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = "</s>[INST] ok [/INST]"
    given = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    sample = spark.createDataFrame([(-7, 0, "user", said), (-7, 1, "assistant", said)], given.schema)
    return chat_format.conversation_digest(chat_format.format_conversations(given.unionByName(sample)))


@query("op9_url_filter", url_filter.verdict_sql())
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = url_filter.judge_urls(table(spark, sf_dir, "pages"))
    return judged.select("page_id", "host", "path", "rule", "verdict")


@query("op6_decontamination", decontaminate.contamination_sql())
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        "contaminated",
    )


@query("op8_best_fit_packing")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"))


@query("op4_exact_top_k", topk_search.top_k_sql())
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk_search.exact_top_k(table(spark, sf_dir, "embeddings"))


@query("op7_token_counts")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(table(spark, sf_dir, "documents"))


@query("op5_hilbert_shards")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    sharded = hilbert_shards.shard_documents(table(spark, sf_dir, "documents"))
    return sharded.select("doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard")


@query("op10_language_id")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = language_id.learn_and_identify(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "held_out", "lang_pred", "score")


@query("op2_ngram_jaccard", jaccard_join.near_duplicates_sql())
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = jaccard_join.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_shingles", "component_id", "n_links")


@query("op11_lexical_search", lexical_search.search_sql())
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical_search.ranked_search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query("op13_source_mixing", mixing.mixing_sql())
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.taken_words(mixing.mix_documents(table(spark, sf_dir, "documents")))


@query("op12_spelling_variants", spelling.variants_sql())
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.group_variants(spelling.count_words(table(spark, sf_dir, "documents"), misspell=97))
