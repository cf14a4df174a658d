"""Rank fusion, boosts, caps and pages. Ties always go to (first list, first rank, id)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Confidence weights.
CONFIDENCE = {"high": 1.0, "medium": 0.7, "low": 0.4}


def fuse(lists: DataFrame, k: int = 60) -> DataFrame:
    """Reciprocal rank fusion of (list_no, id, rank), rank from 1: (id, score, first_list, first_rank)."""
    return lists.groupBy("id").agg(F.round(F.sum(1.0 / (F.lit(k) + F.col("rank"))), 6).alias("score"), F.min("list_no").alias("first_list"), F.min("rank").alias("first_rank"))


def ranked(df: DataFrame, *order: Column, name: str = "rank") -> DataFrame:
    """Row numbers over a result that has been cut to a bounded size."""
    return df.withColumn(name, F.row_number().over(W.orderBy(*order)))


def citation_boost(scored: DataFrame, cites: Column, alpha: float = 1.0, bounded: bool = False) -> DataFrame:
    """score * (1 + alpha * ln(1 + c) / ln(2 + max c)) where c > 0; the maximum is one row.

    With `bounded`, of a result that has been cut to a size, the maximum comes from a window in the same pass.
    """
    df = scored.withColumn("_c", F.coalesce(cites, F.lit(0)).cast("double"))
    if bounded:
        df = df.withColumn("_m", F.max("_c").over(W.partitionBy()))
        boosted = F.when(F.col("_c") > 0, F.col("score") * (1 + alpha * F.log1p("_c") / F.log(2 + F.col("_m")))).otherwise(F.col("score"))
        return df.withColumn("score", F.round(boosted, 6)).drop("_c", "_m")
    most = df.agg(F.max("_c").alias("_m"))
    boosted = F.when(F.col("_c") > 0, F.col("score") * (1 + alpha * F.log1p("_c") / F.log(2 + F.col("_m")))).otherwise(F.col("score"))
    return df.crossJoin(F.broadcast(most)).withColumn("score", F.round(boosted, 6)).drop("_c", "_m")


def multi_signal(df: DataFrame, bm25: Column, cites: Column, confidence: Column, key_result: Column) -> DataFrame:
    """0.50 BM25 (min-max) + 0.25 citations + 0.15 confidence + 0.10 key result."""
    rows = df.withColumns({"_b": bm25.cast("double"), "_c": F.coalesce(cites, F.lit(0)).cast("double")})
    ends = rows.agg(F.min("_b").alias("_lo"), F.max("_b").alias("_hi"), F.max("_c").alias("_m"))
    width = F.when(F.col("_hi") > F.col("_lo"), F.col("_hi") - F.col("_lo")).otherwise(1.0)
    conf = F.lit(0.5)
    for name, weight in CONFIDENCE.items():
        conf = F.when(confidence == name, weight).otherwise(conf)
    score = 0.50 * (F.col("_b") - F.col("_lo")) / width + 0.25 * F.log1p("_c") / F.log(2 + F.col("_m")) + 0.15 * conf + 0.10 * F.when(key_result, 1.0).otherwise(0.5)
    return rows.crossJoin(F.broadcast(ends)).withColumn("score", F.round(score, 6)).drop("_b", "_c", "_lo", "_hi", "_m")


def cap_stable(df: DataFrame, key: str, position: str, n: int = 1) -> DataFrame:
    """Stable partition: the first n of each key in order of position, then the rest; nothing is dropped. Adds `place`."""
    own = df.withColumn("_rn", F.row_number().over(W.partitionBy(key).orderBy(position)))
    return own.withColumn("place", F.row_number().over(W.orderBy((F.col("_rn") > n).cast("int"), position))).drop("_rn")


def top_per(df: DataFrame, key: str | list[str], order: list[Column], n: int) -> DataFrame:
    """The first n rows of each key. Spark cuts each map task's rows of a key to n before the shuffle (WindowGroupLimit), so a hot key stays small."""
    keys = [key] if isinstance(key, str) else key
    return df.withColumn("rn", F.row_number().over(W.partitionBy(*keys).orderBy(*order))).filter(F.col("rn") <= n)


def breadth(matches: DataFrame, cites: DataFrame, k: int) -> DataFrame:
    """Papers by (number of subqueries matched)^2 * ln(2 + citations); matches (query_no, paper), cites (paper, c)."""
    n = matches.groupBy("paper").agg(F.countDistinct("query_no").alias("n_queries"))
    score = F.round(F.pow("n_queries", F.lit(2)) * F.log(2 + F.coalesce("c", F.lit(0)).cast("double")), 6)
    return n.join(cites, "paper", "left").withColumn("score", score).orderBy(F.desc("score"), "paper").limit(k)


def inject(hits: DataFrame, candidates: DataFrame, paper: str, limit: int) -> DataFrame:
    """Adds the best candidate (id, paper, score, ...) of each paper that hits lack, up to max(limit / 2, 15), with the score of hit number limit // 2."""
    unseen = candidates.join(hits.select(paper).distinct(), paper, "left_anti")
    best = top_per(unseen, paper, [F.desc("score"), F.col("id")], 1).drop("rn").orderBy(F.desc("score"), "id").limit(max(limit // 2, 15))
    middle = hits.orderBy(F.desc("score"), "id").offset(max(0, limit // 2 - 1)).limit(1).agg(F.coalesce(F.max("score"), F.lit(0.0)).alias("_s"))
    return hits.withColumn("injected", F.lit(False)).unionByName(best.crossJoin(F.broadcast(middle)).withColumn("score", F.col("_s")).drop("_s").withColumn("injected", F.lit(True)))


def strict_or_loose(df: DataFrame, strict: Column, loose: Column) -> DataFrame:
    """Rows that hold strict, or, if there are none, those that hold loose."""
    some = df.agg(F.coalesce(F.max(strict.cast("int")), F.lit(0)).alias("_any"))
    return df.crossJoin(F.broadcast(some)).filter(F.when(F.col("_any") == 1, strict).otherwise(loose)).drop("_any")


def without_markers(df: DataFrame, text: Column, markers: list[str]) -> DataFrame:
    """Rows whose text holds none of the marker words."""
    found = F.lit(False)
    for m in markers:
        found = found | F.contains(F.lower(text), F.lit(m.lower()))
    return df.filter(~F.coalesce(found, F.lit(False)))


def page(df: DataFrame, order: list[Column], limit: int, offset: int = 0, bounded: bool = False) -> DataFrame:
    """One page with the total of all rows; the total is one row, or with `bounded`, of a result cut to a size, a window in the same pass."""
    if bounded:
        return df.withColumn("total", F.count("*").over(W.partitionBy())).orderBy(*order).offset(offset).limit(limit)
    total = df.agg(F.count("*").alias("total"))
    return df.crossJoin(F.broadcast(total)).orderBy(*order).offset(offset).limit(limit)


def by_date(year: str, score: str, key: str) -> list[Column]:
    """Newest first, missing years last, then relevance."""
    return [F.desc_nulls_last(year), F.desc(score), F.col(key)]


def enrich(hits: DataFrame, sources: DataFrame, key: str, columns: list[str]) -> DataFrame:
    return hits.join(sources.select(key, *columns), key, "left")


def normalised_channels(lists: DataFrame, on: dict[str, bool]) -> DataFrame:
    """Lists (channel, id, rank) without the channels that are switched off."""
    return lists.filter(F.col("channel").isin([c for c, use in on.items() if use]))
