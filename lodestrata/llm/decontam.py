r"""Benchmark decontamination by size-partitioned MinHash containment search, verified by exact shingle containment.

An item is contained in a document when at least THRESHOLD of its distinct word shingles occur there, however long the
document is. Items are partitioned by size in powers of two. An item's sketch is its k smallest shingle hashes (bottom-k
MinHash); k = floor((1 - THRESHOLD) * largest size of the partition) + 1, so a document that holds THRESHOLD of the
shingles can't miss all of the sketch: the candidate search loses nothing. Candidates are then verified on the shingles
themselves, not on hashes.

Documents' shingles meet the sketches in a join whose probing side is never shuffled while the sketches are of a
checked, small size; only hits move. Everything is DataFrame expressions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestrata.llm.runtime import BROADCAST_IDS, keep_ids, written

#: Words of a shingle and share of an item's shingles from which it counts as contained.
SHINGLE_WORDS, THRESHOLD = 5, 0.8

#: Items' shingles of at most so many characters in all are broadcast; more are joined by a shuffle, with the same rows.
BROADCAST_CHARS = 16 << 20


def words_of(text: Column) -> Column:
    """Letters and digits of the lower-cased text, as words."""
    return F.regexp_extract_all(F.lower(F.coalesce(text.cast("string"), F.lit(""))), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))


def shingle_texts(words: Column, n: int) -> Column:
    """Distinct runs of n words, each as one string; none if there are fewer words."""
    runs = F.transform(F.sequence(F.lit(1), F.size(words) - n + 1), lambda i: F.array_join(F.slice(words, i, n), " "))
    return F.when(F.size(words) >= n, F.array_distinct(runs)).otherwise(F.array().cast("array<string>"))


def shingle_hashes(hashes: Column, n: int) -> Column:
    """A 64-bit hash for every run of n words, from the words' own hashes."""
    runs = F.transform(F.sequence(F.lit(0), F.size(hashes) - n), lambda i: F.xxhash64(*[F.get(hashes, i + k) for k in range(n)]))
    return F.when(F.size(hashes) >= n, runs).otherwise(F.array().cast("array<bigint>"))


def _items(benchmark: DataFrame, id_col: str, text_col: str, n: int) -> DataFrame:
    """(item_id, size, words, shingles); size is n, or the number of words if that is less. Items without words are left out."""
    rows = benchmark.select(F.col(id_col).cast("long").alias("item_id"), words_of(F.col(text_col)).alias("words")).filter(F.size("words") > 0).filter(F.col("item_id").isNotNull())
    rows = rows.withColumn("size", F.least(F.lit(n), F.size("words")))
    shingles = F.coalesce(*[F.when(F.col("size") == k, shingle_texts(F.col("words"), k)) for k in range(1, n + 1)])
    return rows.select("item_id", "size", "words", shingles.alias("shingles"))


def sketches(items: DataFrame, n: int, threshold: float) -> DataFrame:
    """(hash, item_id, size): the bottom-k sketch of every item, k by its size partition."""
    hashes = F.coalesce(*[F.when(F.col("size") == k, F.array_distinct(shingle_hashes(F.transform("words", lambda w: F.xxhash64(w)), k))) for k in range(1, n + 1)])
    top = F.pow(F.lit(2), F.floor(F.log2(F.size("hashes"))) + 1) - 1  # the largest size of the partition
    k = F.least(F.size("hashes"), F.floor(top * F.lit(1 - threshold) + F.lit(1e-9)).cast("int") + 1)
    rows = items.select("item_id", "size", hashes.alias("hashes"))
    return rows.select("item_id", "size", F.explode(F.slice(F.array_sort("hashes"), F.lit(1), k)).alias("hash"))


def leaks(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", n: int = SHINGLE_WORDS, threshold: float = THRESHOLD) -> DataFrame:
    """One row per document and item that it contains: doc_id, item_id, item_shingles, shared_shingles, containment.

    An item of fewer than n words is one shingle of all its words; items and documents without words (null, empty) match
    nothing. Very long documents are searched whole. Rows with a null id are left out. Repeated rows of a doc_id count as one document, by the best of them, and
    repeated items likewise. Empty tables give no rows; other columns are ignored.
    """
    items = written(_items(benchmark, item_col, item_text_col, n), "decontam-items")
    sketch = written(sketches(items, n, threshold), "decontam-sketches")
    sizes = sorted(r["size"] for r in items.select("size").distinct().collect())  # 1 to n at most
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).filter(F.col("doc_id").isNotNull())
    if not sizes:
        return rows.select("doc_id", F.lit(0).cast("long").alias("item_id"), *[F.lit(0).cast("long").alias(c) for c in ("item_shingles", "shared_shingles")], F.lit(0.0).alias("containment")).limit(0)

    hashed = rows.select("doc_id", F.transform(words_of(F.col("text")), lambda w: F.xxhash64(w)).alias("h"))
    runs = hashed.select("doc_id", F.explode(F.concat(*[shingle_hashes(F.col("h"), k) for k in sizes])).alias("hash"))
    side = sketch.select("hash", "item_id")
    side = F.broadcast(side) if sketch.count() <= BROADCAST_IDS else side.hint("shuffle_merge")
    found = written(runs.join(side, "hash").select("doc_id", "item_id").distinct(), "decontam-candidates")

    texts = keep_ids(rows, found.select("doc_id").distinct(), "doc_id").select("doc_id", words_of(F.col("text")).alias("words"))
    chars = items.agg(F.sum(F.aggregate("shingles", F.lit(0).cast("long"), lambda n, x: n + F.length(x))).alias("n")).first()["n"] or 0
    few = chars <= BROADCAST_CHARS
    known = items.select("item_id", "size", "shingles")
    pairs = found.join(F.broadcast(known) if few else known.hint("shuffle_merge"), "item_id")
    both = pairs.join(texts.hint("shuffle_merge"), "doc_id")
    own = F.coalesce(*[F.when(F.col("size") == k, shingle_texts(F.col("words"), k)) for k in sizes])
    shared = F.size(F.array_intersect("shingles", own)).cast("long")
    counted = both.select("doc_id", "item_id", F.size("shingles").cast("long").alias("item_shingles"), shared.alias("shared_shingles"))
    leaked = counted.filter(F.col("shared_shingles") >= F.col("item_shingles") * F.lit(threshold) - F.lit(1e-9))
    best = leaked.groupBy("doc_id", "item_id").agg(F.max(F.struct((F.col("shared_shingles") / F.col("item_shingles")).alias("containment"), "item_shingles", "shared_shingles")).alias("x"))
    return best.select("doc_id", "item_id", "x.item_shingles", "x.shared_shingles", "x.containment")


def drop_leaks(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """docs without those that contain a benchmark item; all columns, unchanged. Rows with a null id stay."""
    ids = written(leaks(docs, benchmark, id_col).select(F.col("doc_id").alias(id_col)).distinct(), "decontam-leaked")
    return keep_ids(docs, ids, id_col, "left_anti").select(*docs.columns)
