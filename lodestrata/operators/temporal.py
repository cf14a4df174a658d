"""Temporal roll-ups: surge and decline, timelines, feeds, subscriptions, usage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lodestrata.operators.rank import top_per


def surge_decline(counts: DataFrame, period: str, n: str, by: list[str] | None = None) -> DataFrame:
    """Adds prev (the previous period that is there), surge (n > 2 prev > 0) and decline (prev > 5 and n < prev / 2).

    Counts are one row for each period and key. Without keys they are a few hundred rows at most, in one window.
    """
    w = W.partitionBy(*(by or [])).orderBy(period)
    prev = F.lag(n).over(w)
    df = counts.withColumn("prev", prev)
    return df.withColumns({"surge": F.coalesce((F.col("prev") > 0) & (F.col(n) > 2 * F.col("prev")), F.lit(False)), "decline": F.coalesce((F.col("prev") > 5) & (F.col(n) < F.col("prev") / 2), F.lit(False))})


def timeline(claims: DataFrame, period: str, kind: str, paper: str, cites: str, top: int = 5) -> DataFrame:
    """(period, n, kinds, top_papers) with surge and decline; top papers of a period by their largest citation count."""
    per_kind = claims.groupBy(period, kind).agg(F.count("*").alias("n"))
    kinds = per_kind.groupBy(period).agg(F.sum("n").alias("n"), F.array_sort(F.collect_list(F.concat_ws("=", kind, "n"))).alias("kinds"))
    papers = claims.groupBy(period, paper).agg(F.max(cites).alias("c"))
    best = top_per(papers, period, [F.desc("c"), F.col(paper)], top).groupBy(period).agg(F.array_sort(F.collect_list(F.struct("rn", paper))).alias("t"))
    tops = best.select(period, F.transform("t", lambda x: x[paper]).alias("top_papers"))
    return surge_decline(kinds.join(tops, period), period, "n")


def by_period(df: DataFrame, ts: Column, unit: str) -> Column:
    """decade, year or quarter of a time, as a label that sorts."""
    return {
        "decade": F.floor(F.year(ts) / 10).cast("int") * 10,
        "year": F.year(ts),
        "quarter": F.concat(F.year(ts).cast("string"), F.lit("Q"), F.quarter(ts).cast("string")),
    }[unit]


def progressive_window(df: DataFrame, ts: Column, as_of: Column, days: tuple[int, ...] = (7, 30, 90, 365, 3650)) -> DataFrame:
    """Rows of the smallest window before as_of that has any; one pass finds it. Adds window_days (null: all)."""
    age = F.datediff(as_of, ts)
    bucket = F.lit(None).cast("int")
    for d in reversed(days):
        bucket = F.when(age <= d, d).otherwise(bucket)
    rows = df.withColumn("_b", bucket)
    least = rows.agg(F.min("_b").alias("window_days"))
    return rows.crossJoin(F.broadcast(least)).filter(F.col("window_days").isNull() | (F.col("_b") <= F.col("window_days"))).drop("_b")


def due(subscriptions: DataFrame, last: str, cadence: str, as_of: Column) -> DataFrame:
    """Subscriptions never notified, daily ones after 86,400 seconds and weekly ones after 604,800."""
    gone = F.unix_timestamp(as_of) - F.unix_timestamp(F.col(last).cast("timestamp"))
    need = F.when(F.col(cadence) == "weekly", 604_800).otherwise(86_400)
    return subscriptions.filter(F.col(last).isNull() | (gone >= need)).withColumn("seconds", gone)


def new_since(items: DataFrame, subscriptions: DataFrame, key: str, ts: str, last: str) -> DataFrame:
    """Items of each subscription's key that came after its last notification."""
    return items.join(subscriptions, key).filter(F.col(last).isNull() | (F.col(ts) > F.col(last)))


def usage(log: DataFrame, ts: str, keys: list[str], latency: str) -> DataFrame:
    """Requests and mean latency by day and keys."""
    return log.groupBy(F.to_date(ts).alias("day"), *keys).agg(F.count("*").alias("n"), F.round(F.avg(latency), 6).alias("mean_latency"))


def tier(current: Column, total: Column, age_days: Column) -> Column:
    """The tier that a key graduates to by its requests and age: one step at a time; an empty one is tier_1."""
    now = F.coalesce(F.nullif(current, F.lit("")), F.lit("tier_1"))
    return F.when(now.isin("free", "tier_1") & (total >= 10_000) & (age_days >= 7), "tier_2").when((now == "tier_2") & (total >= 100_000) & (age_days >= 30), "tier_3").otherwise(now)


def discovery(items: DataFrame, date: Column, as_of: Column, surprise: str, cites: str, days: int = 30) -> DataFrame:
    """(items, basis, window_days): the surprising ones of the last `days` days, or, where none has a surprise, those of the smallest window that holds any, by citations.

    The choice is one row; nothing else is compared with it.
    """
    age = F.datediff(as_of, date)
    dated = items.withColumn("_age", age)
    some = dated.agg(F.coalesce(F.max(((F.col("_age") <= days) & (F.col(surprise) > 0)).cast("int")), F.lit(0)).alias("_any"))
    hot = dated.crossJoin(F.broadcast(some)).filter((F.col("_any") == 1) & (F.col("_age") <= days) & (F.col(surprise) > 0))
    cold = progressive_window(dated.crossJoin(F.broadcast(some)).filter("_any = 0"), date, as_of)
    hot = hot.select(*items.columns, F.lit("surprise").alias("basis"), F.lit(days).alias("window_days"), F.col(surprise).cast("double").alias("score"))
    return hot.unionByName(cold.select(*items.columns, F.lit("citations").alias("basis"), F.col("window_days").cast("int").alias("window_days"), F.col(cites).cast("double").alias("score")))


def usage_summary(events: DataFrame, ts: str, key: str, as_of: Column, days: int = 30) -> DataFrame:
    """(key, requests, active_days, mean_per_day, busiest) of the last `days` days."""
    per = events.filter((F.datediff(as_of, F.to_date(ts)) < days) & (F.datediff(as_of, F.to_date(ts)) >= 0)).groupBy(key, F.to_date(ts).alias("day")).agg(F.count("*").alias("n"))
    return per.groupBy(key).agg(F.sum("n").alias("requests"), F.count("*").alias("active_days"), F.round(F.sum("n") / days, 6).alias("mean_per_day"), F.max("n").alias("busiest"))
