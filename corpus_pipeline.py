"""From raw documents to packed sequences: five stages, each on what the one before kept."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from freshet.llm import language, mixing, near_dedup, packing, queries, secrets
from freshet.llm.common import written

#: Wanted share of each domain's present token total: toxic text goes, the rest stays.
WEIGHTS = {"good": 1.0, "poor": 1.0, "toxic": 0.0}


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows whose text has a language that the labelled rows teach; null and letterless texts go."""
    return language.keep_identified(docs, language.train(docs.where(~language.held_out("doc_id"))))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates; rows without doc_id stay."""
    return near_dedup.keep_first(docs)


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All rows, with secrets masked in their texts."""
    return secrets.redact(docs)


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that the fitted mix takes; without labels all of them."""
    return mixing.take(docs, queries.domains(spark, sf_dir), WEIGHTS)


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the texts in sequences of at most 2048 tokens; a null text is empty."""
    cut = packing.pieces(
        docs, public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken")
    )
    return packing.pack(cut)


STAGES = [
    ("language_id", language_id),
    ("near_duplicates", near_duplicates),
    ("secret_scan", secret_scan),
    ("source_mix", source_mix),
    ("best_fit_packing", best_fit_packing),
]

#: SQL has no counterpart of the trained models and the genetic algorithm.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), name)
    return docs
