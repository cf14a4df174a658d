"""From raw documents to packed token sequences, in five stages, each of which sees all that the one before kept.

Near copies are found on five-word shingles at a Jaccard similarity of 0.8.

A null text counts as empty everywhere. Copies, near copies and leaks are dropped by id, so ids should be unique: of a
repeated id all rows go or stay together. Rows with a null id are scored by the classifier like any other, and no later
stage drops them. Ties between copies go to the smallest id. Empty tables give empty results, and stages carry further
columns along, whatever they are called; only packing has columns of its own.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lodestrata.llm import decontam, exact_dedup, jaccard_join, packing, quality
from lodestrata.llm.runtime import release, table, written


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts; it is trained on the labels outside its held-out fold."""
    return quality.keep_good(docs, quality.train(docs, table(spark, sf_dir, "labels")))


def without_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each text (white space aside): the longest, then that with the smallest id."""
    return exact_dedup.drop_copies(docs)


def without_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that with the smallest id, of each group that near-copy links join."""
    return jaccard_join.keep_one(docs, n=5, percent=80)


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that contain no benchmark item."""
    return decontam.drop_leaks(docs, table(spark, sf_dir, "benchmark"))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of token sequences."""
    return packing.pack(docs)


STAGES = [
    ("quality_classifier", good_quality),
    ("exact_dedup", without_copies),
    ("ngram_jaccard_join", without_near_copies),
    ("benchmark_decontamination", without_benchmark),
    ("packing", packed),
]

#: The classifier is fitted numerically, which SQL can't express; tests hold each stage against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    first = docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        before, docs = docs, written(stage(spark, docs, sf_dir), f"pipeline-{name}")
        if before is not first:
            release(before)
    return STAGES[-1][1](spark, docs, sf_dir)
