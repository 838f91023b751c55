"""The corpus pipeline: five stages from raw documents to a training mixture.

Each stage takes all that the stage before it kept, and its decisions take effect: rows that it turns
away are gone. All stages but the last return the columns of ``documents``; the last returns the
mixture's manifest (which document is drawn in which block of its source).

Null texts and ids, repeated rows, empty tables and extra columns are handled as the operators'
docstrings say.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from leafloom.llm import decontaminate, exact_dedup, minhash, mixing, toxicity
from leafloom.llm.common import discard, stored

#: SQL can't express the fitted model, MinHash or alignments: the tests hold the stages against brute force.
ORACLE_SQL = None


def reject_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the documents that the ordinal model, fitted on ``labels``, finds more likely toxic than not."""
    return toxicity.drop_toxic(spark, docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def drop_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of texts that are equal but for the case of A-Z, the one with the largest id."""
    return exact_dedup.drop_copies(spark, docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked by a similarity of 0.8 or more over five-word shingles, the one with the smallest id."""
    return minhash.drop_near_duplicates(spark, docs, size=5, percent=80)


def drop_benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the documents that hold a copy of a test item, edited or not."""
    return decontaminate.drop_leaks(spark, docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mixture of sources, with as many tokens as its input has."""
    return mixing.mix_sources(spark, docs)


STAGES = [
    ("toxicity", reject_toxic),
    ("exact dedup", drop_exact_copies),
    ("near dedup", drop_near_copies),
    ("decontamination", drop_benchmark_leaks),
    ("mixing", mix),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        before, docs = docs, stored(spark, stage(spark, docs, sf_dir), f"pipeline-{name.replace(' ', '-')}")
        discard(before)  # what a stage kept is whole in its own table
    return STAGES[-1][1](spark, docs, sf_dir)
