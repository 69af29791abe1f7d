"""A training corpus from raw documents: five stages, each over all its predecessor kept.

Language ID drops documents of no language, near-dedup keeps one document of each
group, decontamination drops documents with benchmark passages, mixing repeats
and drops documents to the sources' target weights, and the last stage writes the
token files and returns what they hold.  A stage's result is written as Parquet
and read again as the next one's documents.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from harvestline.llm import decontaminate, language_id, mixing, near_dedup, token_files
from harvestline.llm.common import Scratch, prepare, table
from harvestline.llm.queries import SCHEDULES, word_tokenizer

# Language ID and MinHash near-duplicates aren't SQL; the tests hold each stage against brute force.
ORACLE_SQL = None


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    prepare(spark)
    return language_id.keep_identified(docs)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    prepare(spark)
    return near_dedup.near_dedup(docs)


def drop_benchmark_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    prepare(spark)
    return decontaminate.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    prepare(spark)
    return mixing.mix_documents(docs, SCHEDULES)


def write_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    prepare(spark)
    path = Scratch(spark, "corpus").path("token-files")
    token_files.write_token_files(docs, path, word_tokenizer())
    return token_files.read_digests(spark, path)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language_id", identify_language),
    ("near_dedup", drop_near_duplicates),
    ("decontaminate", drop_benchmark_passages),
    ("mix", mix_sources),
    ("token_files", write_tokens),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    scratch = Scratch(prepare(spark), "corpus")
    docs, before = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES:
        docs = scratch.keep(stage(spark, docs, sf_dir), name)
        if before is not None:
            scratch.drop(before)
        before = docs
    return docs
