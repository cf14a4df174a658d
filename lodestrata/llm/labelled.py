"""Labelled training rows: a bounded, reproducible sample of the labels outside the held-out fold."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Labelled rows that a model is fitted on at most (about; rows are chosen by a hash of their id).
SAMPLE_ROWS = 20_000


def fold(doc_id, n: int):
    """crc32 of doc_id as text, modulo n."""
    return F.crc32(doc_id.cast("string").cast("binary")) % n


def sample_labels(labels: DataFrame, label: str, folds: int, held: int, rows: int = SAMPLE_ROWS) -> DataFrame:
    """(doc_id, y) of about `rows` labelled documents outside fold `held`; null ids and labels are left out.

    Repeated labels of an id count once; an id with clashing ones says nothing and is left out.

    Every label outside the fold has the same chance: the share of a 64-bit hash's range that gives `rows` of them.
    """
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).cast("int").alias("y")).filter(F.col("doc_id").isNotNull() & F.col("y").isin(0, 1))
    known = known.filter(fold(F.col("doc_id"), folds) != held)
    n = known.count()
    if n > rows:
        known = known.filter(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) < int(rows / n * (1 << 30)))
    return known.groupBy("doc_id").agg(F.min("y").alias("y"), F.max("y").alias("_most")).filter("y = _most").drop("_most")
