"""A training corpus from raw documents, stage by stage.

Each stage takes documents as a DataFrame and returns what stays, with the same columns; the last one returns the training order. Every result is
written as Parquet and read again, so a stage that fails can start from its predecessor's table.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wrenchlight.llm import decontaminate, fertility, line_dedup, mixing, simhash
from wrenchlight.llm.common import read, stored
from wrenchlight.session import prepare

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def quality_rules(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Documents that break the base rules or leave the fertility band of their language go."""
    return fertility.keep_good(docs)


def line_repeats(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Later copies of repeated line runs are cut out of the texts; all documents stay, and n_chars follows the text."""
    cut = line_dedup.without_repeated_lines(docs)
    return cut.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else cut


def near_duplicates(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """One document of each SimHash group stays, that with the smallest doc_id."""
    return simhash.keep_one(docs)


def benchmark_leaks(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Documents that hold a benchmark item go."""
    return decontaminate.without_leaks(docs, read(spark, folder, "benchmark"))


def source_mix(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Copies of documents in training order; those that are not taken come last."""
    return mixing.training_order(docs)


STAGES: list[tuple[str, Stage]] = [
    ("quality_rules", quality_rules),
    ("line_dedup", line_repeats),
    ("near_duplicates", near_duplicates),
    ("decontamination", benchmark_leaks),
    ("mixing", source_mix),
]

# Tokenisers and fingerprints are beyond SQL; tests/llm compares run() with a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, folder: str) -> DataFrame:
    """All stages over documents."""
    docs = read(prepare(spark), folder, "documents")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, folder), name)
    return docs
