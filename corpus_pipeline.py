"""From raw documents to packed training sequences.

Each stage takes all documents that the one before has kept, and what it decides takes effect; all
but the last return the columns of ``documents``. A stage's result is written as Parquet in the
cluster's shared folder and read again for the next one. Stages send texts to Python in batches of
``BATCH_ROWS``, which the session keeps.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from faultline.llm.common import table, written
from faultline.llm.decontamination import decontaminated
from faultline.llm.near_dedup import deduplicated
from faultline.llm.packing import pack
from faultline.llm.quality_classifier import good_documents
from faultline.llm.substring_dedup import without_repeats

#: At Spark's default of 10,000 texts a batch is copied several times, at tens of megabytes each, in the executor's native memory and in the worker.
BATCH_ROWS = 1024


def _small_batches(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier, fitted on all labels, does not reject."""
    _small_batches(spark)
    return good_documents(docs, table(spark, sf_dir, "labels"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates (five-word shingles, similarity of 0.8 or more)."""
    _small_batches(spark)
    return deduplicated(docs)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without passages that a document of a smaller id has too."""
    _small_batches(spark)
    return without_repeats(docs).withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))


def benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a word window of a benchmark item."""
    _small_batches(spark)
    return decontaminated(docs, table(spark, sf_dir, "benchmark"))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents with their places in training sequences."""
    _small_batches(spark)
    return pack(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality", quality),
    ("near_duplicates", near_duplicates),
    ("repeated_passages", repeated_passages),
    ("benchmark_leaks", benchmark_leaks),
    ("packing", packing),
]

#: Compression, a trained dictionary and the choice of sequences have no SQL form; tests/llm compares with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), name)
    return docs
