"""The corpus pipeline: stages over the documents table, each written and read again.

1. language     documents without a recognisable language go
2. exact        of equal texts one row stays
3. near         of each group of near duplicates (five-word shingles, 0.8) one stays
4. decontaminate  documents that hold a passage of the benchmark go
5. tokens       the remaining texts are encoded and decoded; counts and digests remain
"""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from nightjar.llm import bpe, decontaminate, exact_dedup, language, near_dedup
from nightjar.llm.common import fresh_heaps, new_path, table


def _stage(f: Callable[[SparkSession, DataFrame, str], DataFrame]) -> Callable[[SparkSession, DataFrame, str], DataFrame]:
    """A stage that starts on executors whose heaps the stage before has not filled."""

    @functools.wraps(f)
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        fresh_heaps(spark)
        return f(spark, docs, sf_dir)

    return run_stage


@_stage
def identify(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return language.drop_rejected(docs, language.fit(language.training_rows(docs)))


@_stage
def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return exact_dedup.drop_copies(docs)


@_stage
def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return near_dedup.drop_near(docs, width=5, percent=80)


@_stage
def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.drop_leaks(docs, table(spark, sf_dir, "benchmark"))


@_stage
def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    import public_tokenizers as tokenizers

    return bpe.digests(docs, tokenizers.path("byte_bpe_50k.tiktoken"), tokenizers.PATTERN)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language", identify),
    ("exact", drop_copies),
    ("near", drop_near_copies),
    ("decontaminate", drop_leaks),
    ("tokens", tokenize),
]
#: Neither the language model nor byte-pair encoding can be written in SQL; tests/llm compares with a brute-force version.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply every stage to ``documents`` in turn."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        path = new_path(spark, f"stage-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
