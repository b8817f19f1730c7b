"""The corpus pipeline: quality rules, near duplicates, personal data, source mix, tokens.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written
as Parquet and read back as the next stage's ``docs``. All but the last return
the columns of documents.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from veralytics.llm import jaccard_join, mixing, pii, quality_rules, sentencepiece
from veralytics.llm.common import shared_folder, table

# Near duplicates: shingles of five words, similarity of 0.8 or more.
WORDS, PERCENT = 5, 80
# Bytes of texts that go to a Python worker at once, and words that one remembers: all stages share one application's memory.
BATCH_BYTES, REMEMBERED = 2_000_000, 100_000


def good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep; sets the session's Arrow batches for this and all later stages."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    return quality_rules.keep_good(docs, table(spark, sf_dir, "labels"))


def distinct(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates, the one with the smallest doc_id."""
    return jaccard_join.one_of_each(docs, WORDS, PERCENT)


def private(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pseudonyms in place of personal values."""
    return pii.without_private(docs)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix by source weights: a document comes as often as it is drawn."""
    return mixing.mix(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each document of the mix."""
    return sentencepiece.encode(docs, remembered=REMEMBERED)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality_rules", good), ("jaccard_join", distinct), ("pseudonyms", private), ("source_mixing", mixed),
    ("sentencepiece", tokens),
]

# A learned verdict, keyed draws and a model's vocabulary cannot be put in SQL; tests hold each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = table(spark, sf_dir, "documents")
    folder = f"{shared_folder(spark).rstrip('/')}/pipeline-{uuid.uuid4().hex}"
    for name, stage in STAGES[:-1]:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
