"""A corpus pipeline of five operators of blockloom.llm.

Each stage takes (spark, docs, sf_dir), works on all that the one before it kept, and returns the columns of
documents; the last returns the encoded corpus. Rows with null texts go through as empty ones, rows that repeat are
one after exact dedup, empty tables stay empty, and more columns pass through all stages but the last.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from blockloom.llm import bpe, decontam, exact_dedup, quality, simhash
from blockloom.llm.common import discard, documents


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go."""
    return quality.keep_good(docs)


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the one with the smallest id stays."""
    return exact_dedup.keep_first(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays: shingles of five words, similarity 0.8 or more."""
    return simhash.drop_near_duplicates(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of the benchmark go, the rest of their documents stays."""
    return decontam.remove(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of what is left, and the text that they decode to."""
    return bpe.round_trip(docs, public_tokenizers.path("byte_bpe_50k.json"), with_ids=True)


STAGES = [("quality", quality_classifier), ("exact_dedup", exact), ("near_dedup", near), ("decontaminate", decontaminate), ("encode", encode)]

#: Classifier, fingerprints and byte pair encoding can't be told in SQL; tests/llm hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for _, stage in STAGES:
        # every stage returns a table that it has written to the shared folder; the one before is needed no longer
        docs, before = stage(spark, docs, sf_dir), docs
        discard(before)
    return docs
