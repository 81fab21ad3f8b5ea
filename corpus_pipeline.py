"""The corpus pipeline: STAGES in order, each written as Parquet and read again as the next one's input.

Every stage takes all documents that the one before kept and tolerates nulls, empty texts, repeated
rows, further columns and empty tables, as its operator says.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ripplecast.llm import decontam, linededup, pieces, quality, simhash
from ripplecast.llm.common import materialise


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score under 0.3 go."""
    return quality.drop_rejected(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), threshold=0.3)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of lines of one template in three or more documents the first stays; every document stays."""
    return linededup.drop_recurring_lines(docs, min_docs=3, lead=3, similarity=0.8)


def simhash_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class stays: documents link at a Jaccard similarity of 0.8 of their sets of five-word shingles."""
    return simhash.keep_one(docs, width=5, similarity=0.8)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which a window of ten words of a benchmark item occurs go."""
    return decontam.drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), length=10)


def sentencepiece(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of every document left: (doc_id, n_pieces, lossless, pieces)."""
    return pieces.encode(docs, alpha=1.0, seed=0)


STAGES = [
    ("quality_classifier", quality_classifier),
    ("line_dedup", line_dedup),
    ("simhash_near_dedup", simhash_near_dedup),
    ("benchmark_decontamination", benchmark_decontamination),
    ("sentencepiece", sentencepiece),
]

#: A trained network, majority votes over hash bits and sampled segmentations have no SQL form.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
