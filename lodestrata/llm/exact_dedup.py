"""Exact deduplication by a content sort.

Each input partition sorts its normalised bytes and collapses equal neighbours (a sorted run, the map-side combine);
sampled splitters range-partition the runs' texts; an external sort places equals adjacent, and full comparisons of
neighbours merge them. A text of which a third of all rows are copies thus reaches the sort as one row per input
partition, whatever its number of copies.

Which row stays and how many rows a text has comes from that sort; a row finds its class again by the SHA-256 of its
normalised text, so that whole texts move once only. Normalising, digests, sorting and the merge of runs are built-in
expressions; the one Python step collapses the neighbours of a run, on Arrow columns.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestrata.llm.runtime import attach, keep_ids, written

#: Deleted before texts are compared: [\x20\x09-\x0D].
WHITE_SPACE = " \t\n\x0b\x0c\r"

#: Bytes of the normalised text in a range key; the digest orders texts that share them, so splitters stay small.
PREFIX_BYTES = 32

_RUN = "norm binary, n_cp long, doc_id long, n long"
_RUN_NAMES = ["norm", "n_cp", "doc_id", "n"]


def _rows(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    norm = F.translate(text, WHITE_SPACE, "").cast("binary")
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.length(text).cast("long").alias("n_cp"), norm.alias("norm"))


def _digest(norm: str) -> Column:
    return F.unhex(F.sha2(F.col(norm), 256))


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Streams rows in order of norm and yields one for each stretch of equal neighbours, with the row that stays and the sum of n."""
    last = None
    for batch in batches:
        batch = pa.RecordBatch.from_arrays(batch.columns, _RUN_NAMES)  # without what the input says of nulls
        if last is not None:
            batch = pa.concat_batches([last, batch])
        if not batch.num_rows:
            continue
        norm, ids = batch.column("norm"), batch.column("doc_id")
        edges = np.concatenate([[0], np.flatnonzero(pc.not_equal(norm[1:], norm[:-1]).to_numpy(zero_copy_only=False)) + 1])
        run = np.repeat(np.arange(len(edges)), np.diff(np.append(edges, batch.num_rows)))
        # most code points, then the smallest id; a null id comes last
        order = np.lexsort((ids.fill_null(0).to_numpy(), ids.is_null().to_numpy(zero_copy_only=False), -batch.column("n_cp").to_numpy(), run))
        best = batch.take(pa.array(order[edges]))
        n = pa.array(np.add.reduceat(batch.column("n").to_numpy(), edges), pa.int64())
        best = pa.RecordBatch.from_arrays([best.column("norm"), best.column("n_cp"), best.column("doc_id"), n], _RUN_NAMES)
        yield best[:-1]
        last = best.take(pa.array([best.num_rows - 1]))  # a copy, so that the batch can go
    if last is not None:
        yield last


def content_classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per distinct normalised text: digest (SHA-256 of it), keep_id, group_size."""
    rows = _rows(docs, id_col, text_col).select("norm", "n_cp", "doc_id", F.lit(1).cast("long").alias("n"))
    runs = rows.sortWithinPartitions("norm").mapInArrow(_runs, _RUN)
    ranged = runs.select(F.substring("norm", 1, PREFIX_BYTES).alias("prefix"), _digest("norm").alias("digest"), "norm", "n_cp", "doc_id", "n")
    first = F.min(F.struct((-F.col("n_cp")).alias("less"), F.col("doc_id").isNull().alias("without"), "doc_id"))
    # the ranges keep equal texts together, so this sorts and compares neighbours in place: no second exchange
    merged = ranged.repartitionByRange("prefix", "digest").groupBy("prefix", "digest", "norm").agg(first.alias("first"), F.sum("n").alias("group_size"))
    return merged.select("digest", F.col("first.doc_id").alias("keep_id"), "group_size")


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: doc_id, keep_id, group_size, kept, text_sha256.

    A null text counts as empty, and all empty texts (and texts of white space alone) are one group. Of equal texts the
    one with the most code points stays, then the smallest doc_id; a null doc_id comes last, and its row isn't kept
    unless it is alone. Repeated rows of one doc_id are members each, and all of them are `kept` if it is the one that
    stays. An empty table gives no rows; other columns are ignored.
    """
    classes = written(content_classes(docs, id_col, text_col), "content-classes")
    members = written(_rows(docs, id_col, text_col).select("doc_id", _digest("norm").alias("digest")), "content-members")
    found = attach(members, classes, "digest", "group_size", members.count())
    return found.select("doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), F.lower(F.hex("digest")).alias("text_sha256"))


def drop_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs without the rows whose text equals that of a row that stays; all columns, unchanged.

    docs needs unique ids. Rows with a null id stay.
    """
    dropped = written(exact_groups(docs, id_col, text_col).filter(~F.col("kept")).select(F.col("doc_id").alias(id_col)), "content-dropped")
    return keep_ids(docs, dropped, id_col, "left_anti").select(*docs.columns)
