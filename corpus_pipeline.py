"""The corpus pipeline: language, near duplicates, repeated passages, secrets, packing; each stage on all that its predecessor kept."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from maskloom.llm import language, packing, rtree, secrets, suffix
from maskloom.llm.common import Scratch


def by_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which some language is found; those without a letter, or with no word in a script of a learned language, go."""
    model = language.fit(docs.where(language.fold(F.col("doc_id")) != 0))
    names = ("_language", "_share")
    while set(names) & {c.lower() for c in docs.columns}:
        names = (names[0] + "_", names[1] + "_")
    return language.predict(docs, model, names=names).where(F.col(names[0]) != "und").drop(*names)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group whose five-word shingles link at a similarity of 0.8 or more."""
    return rtree.keep_one(docs, words=5, percent=80)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the passages that an earlier document has; documents of which nothing is left go."""
    return suffix.remove_repeats(docs, texts=True).where("text is null or text <> ''")


def without_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts with secrets replaced."""
    return secrets.redact(docs, secrets.learn(docs))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences of 4096 tokens."""
    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"), 4096, 2)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language", by_language),
    ("near_duplicates", near_duplicates),
    ("repeated_passages", repeated_passages),
    ("secrets", without_secrets),
    ("packing", packed),
]
#: No SQL: the stages learn and tokenize; tests hold them against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written and read again."""
    scratch = Scratch(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = scratch.write(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
