"""A corpus through five operators: toxicity, language, near-duplicates, benchmark leaks, tokens."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vitalspark.llm import byte_bpe, decontaminate, langid, shingles, toxicity
from vitalspark.llm.common import materialise
from vitalspark.session import ship


def toxicity_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop the documents that the classifier scores 0.5 or more."""
    ship(spark)
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").where(F.crc32(F.col("doc_id").cast("string")) % 5 != 0)
    return toxicity.reject(docs, toxicity.fit(docs, labels))


def language_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop the documents whose declared language all evidence together rules out."""
    ship(spark)
    return langid.filter_documents(docs, langid.fit_text(docs.select("doc_id", "text", "lang")))


def near_duplicate_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document of each group of near copies: found in SimHash tries, five-word Jaccard of 0.8 or more."""
    ship(spark)
    return shingles.keep_one(docs)


def leak_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop the documents that hold a passage of the benchmark."""
    ship(spark)
    return decontaminate.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Encode every text and decode it again: digests of both."""
    ship(spark)
    return byte_bpe.digests(spark, docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", toxicity_filter),
    ("language", language_filter),
    ("near_duplicates", near_duplicate_filter),
    ("decontamination", leak_filter),
    ("tokens", tokens),
]

#: Fitted models and tokenizers are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`, each written as Parquet and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), name)
    return materialise(STAGES[-1][1](spark, docs, sf_dir), STAGES[-1][0])
