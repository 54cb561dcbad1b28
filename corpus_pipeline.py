"""From documents to packed sequences: quality, language, near duplicates, mixing, packing.

Each stage takes (spark, docs, sf_dir) and works on all that its predecessor kept; all but the last return
the columns of documents, whatever further columns it has. ``run`` writes each stage's result to the shared folder before
the next one starts. Null and empty texts get the quality of the average document and have no language, so they go in the
second stage. Repeated rows, and null doc_ids, are judged one by one up to near duplicates, of which one row stays. An
empty table gives no pieces; without labels every document passes the first stage.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from tidemark.llm import compression_quality, language_id, mixing, near_dedup, packing
from tidemark.llm.common import read, written

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose compression score reaches the threshold."""
    return compression_quality.keep(docs, compression_quality.learn(docs, read(spark, sf_dir, "labels")))


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is told with enough confidence."""
    return language_id.keep(docs, language_id.learn(docs))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies."""
    return near_dedup.keep(docs)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Three quarters of the tokens, by the target weights, no document twice."""
    return mixing.keep(docs, fraction=(3, 4))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents in sequences of 1024 ids."""
    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"), keep_ids=False)


STAGES: list[tuple[str, Stage]] = [("quality", quality), ("language", language), ("near_dedup", near_duplicates), ("mixing", mixture), ("packing", packed)]
ORACLE_SQL = None  # the classifiers and the tokenizer are beyond SQL; tests hold each stage against brute force


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
