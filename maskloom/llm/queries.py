"""The queries of this subpackage, with production parameters, over whole tables."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from pyspark.sql import functions as F

from . import bpe, language, licenses, media, packing, quality, rtree, secrets, sharding, suffix
from .common import documents


def op1_feistel_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard(documents(spark, sf_dir), 24)


def op2_nnls_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(documents(spark, sf_dir), public_tokenizers.path("word_bpe_49k.json"), 4096, 2)


def op3_segment_tree_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode_documents(documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.json"), whole=False)


def op4_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(documents(spark, sf_dir), windows=True).drop("matches")


def license_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The license scan with single lines as blocks, which SQL can count."""
    return licenses.scan(documents(spark, sf_dir)).drop("matches")


def op5_bwt_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix.remove_repeats(documents(spark, sf_dir))


def op6_media_sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.document_media(documents(spark, sf_dir))


def op7_count_rtree_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, _, _ = rtree.link(documents(spark, sf_dir).select("doc_id", "text"), words=3, percent=90)
    return rows.select("doc_id", F.col("n").alias("n_shingles"), "component_id")


def op8_language_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    model = language.fit(docs.where(language.fold(F.col("doc_id")) != 0))
    out = language.predict(docs, model, keep=["doc_id"])
    return out.select("doc_id", F.coalesce(language.fold(F.col("doc_id")) == 0, F.lit(False)).alias("held_out"), "lang_pred", "score")


def op9_decision_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    rules = quality.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return quality.judge(docs, rules).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op10_secret_automata(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    return secrets.scan(docs, secrets.learn(docs)).drop("n_format")


def page_sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items of all pages in their order."""
    items = media.sequences(spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "html"))
    return items.select("page_id", F.inline("items"))


def media_payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The columns of op6 that do not depend on the stored form."""
    return media.document_media(documents(spark, sf_dir)).select("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32")


def quality_base(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The base statistics of op9."""
    return quality.statistics(documents(spark, sf_dir)).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")


def secret_base(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The base spans of op10."""
    return secrets.scan(documents(spark, sf_dir), {}).select("doc_id", "n_assign", "n_access", "n_hex", "base_sha256")


OPERATORS = (op1_feistel_sharding, op2_nnls_packing, op3_segment_tree_bpe, op4_license_scan, op5_bwt_dedup, op6_media_sequences, op7_count_rtree_join, op8_language_spans, op9_decision_list, op10_secret_automata)
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (*OPERATORS, license_lines, media_payloads, page_sequences, quality_base, secret_base)}
ORACLE_SQL: dict[str, str] = {
    "op1_feistel_sharding": sharding.oracle_sql(), "op4_license_scan": licenses.windows_sql(), "op5_bwt_dedup": suffix.ORACLE_SQL, "op7_count_rtree_join": rtree.oracle_sql(),
    "license_lines": licenses.oracle_sql(), "media_payloads": media.ORACLE_SQL, "quality_base": quality.ORACLE_SQL, "secret_base": secrets.ORACLE_SQL,
}
