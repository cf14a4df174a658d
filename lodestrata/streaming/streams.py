"""Structured Streaming counterparts: windows, limits, sessions, deduplication, upserts, digests.

Each takes a streaming DataFrame; `replay` runs one to its end with availableNow, as a batch of closed windows.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestrata.scratch import scratch_dir

# Requests a minute and a day that a tier may make.
LIMITS = {"anon": (100, 5_000), "tier1": (200, 20_000), "tier2": (500, 100_000), "tier3": (1_000, 500_000)}


def table_stream(spark: SparkSession, folder: str, name: str, ts: str | None = None) -> DataFrame:
    """A table of the folder, one file or a folder of files, as a stream; time stamps without a zone become UTC times, as watermarks need."""
    schema = spark.read.parquet(f"{folder}/{name}.parquet").schema
    stream = spark.readStream.schema(schema).parquet(f"{folder}/[{name[0]}]{name[1:]}.parquet")  # a stream takes one file by a pattern only
    return stream.withColumn(ts, F.col(ts).cast("timestamp")) if ts else stream


def scratch(spark: SparkSession) -> str:
    return f"{scratch_dir(spark)}/stream-{uuid.uuid4().hex}"


def replay(stream: DataFrame, mode: str = "append", each: Callable[[DataFrame, int], None] | None = None) -> DataFrame:
    """Runs the stream over what is there now and gives its sink as a DataFrame (append), or None with `each` batch handled."""
    spark = stream.sparkSession
    where = scratch(spark)
    writer = stream.writeStream.outputMode(mode).option("checkpointLocation", f"{where}/checkpoint").trigger(availableNow=True)
    if each is not None:
        writer.foreachBatch(each).start().awaitTermination()
        return None
    writer.format("parquet").option("path", f"{where}/out").start().awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{where}/out")


def daily_counts(stream: DataFrame, ts: str, by: list[str], late: str = "1 hour") -> DataFrame:
    """Counts by day and keys once a day is closed."""
    w = stream.withWatermark(ts, late).groupBy(F.window(ts, "1 day"), *by).agg(F.count("*").alias("n"))
    return w.select(F.col("window.start").alias("day"), *by, "n")


def sliding_rate(stream: DataFrame, ts: str, key: str, window: str, slide: str, limit: int, late: str = "10 minutes") -> DataFrame:
    """Windows in which a key made more than `limit` requests."""
    w = stream.withWatermark(ts, late).groupBy(F.window(ts, window, slide), key).agg(F.count("*").alias("n"))
    return w.filter(F.col("n") > limit).select(F.col("window.start").alias("start"), key, "n")


def sessions(stream: DataFrame, ts: str, key: str, gap: str, late: str = "10 minutes") -> DataFrame:
    w = stream.withWatermark(ts, late).groupBy(F.session_window(ts, gap), key).agg(F.count("*").alias("n"))
    return w.select(F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), key, "n")


def dedup(stream: DataFrame, ts: str, keys: list[str], late: str = "1 day") -> DataFrame:
    """The first row of each key within the watermark."""
    return stream.withWatermark(ts, late).dropDuplicatesWithinWatermark(keys)


def latest(stream: DataFrame, key: str, ts: str) -> DataFrame:
    """The newest row of each key, in update mode, for foreachBatch upserts."""
    return stream.groupBy(key).agg(F.max(ts).alias(ts), F.count("*").alias("n"))


def joined_within(left: DataFrame, right: DataFrame, key: str, left_ts: str, right_ts: str, within: str, late: str = "1 hour") -> DataFrame:
    """Stream-stream join: right rows of a key up to `within` after a left row."""
    a, b = left.withWatermark(left_ts, late), right.withWatermark(right_ts, late).withColumnRenamed(key, "_k")
    return a.join(b, F.expr(f"{key} = _k AND {right_ts} >= {left_ts} AND {right_ts} <= {left_ts} + INTERVAL {within}")).drop("_k")


def digests(stream: DataFrame, subscriptions: DataFrame, key: str, ts: str, last: str) -> DataFrame:
    """Stream-static join: new items of subscriptions since their last notification."""
    return stream.join(subscriptions, key).filter(F.col(last).isNull() | (F.col(ts) > F.col(last)))


def over_limits(stream: DataFrame, ts: str, key: str, tier: str, limits: dict[str, tuple[int, int]] = LIMITS, late: str = "10 minutes") -> DataFrame:
    """Log of keys over their tier's limit in a minute that slides by ten seconds, or in a UTC day: (start, key, tier, kind, n, most).

    A tier that isn't in limits has those of the first one.
    """
    first = next(iter(limits.values()))
    most = lambda i: F.coalesce(F.create_map(*[F.lit(x) for t, v in limits.items() for x in (t, v[i])])[F.col(tier)], F.lit(first[i]))
    minute = stream.withWatermark(ts, late).groupBy(F.window(ts, "1 minute", "10 seconds").alias("w"), key, tier).agg(F.count("*").alias("n")).filter(F.col("n") > most(0)).select(F.col("w.start").alias("start"), key, tier, F.lit("minute").alias("kind"), "n", most(0).alias("most"))
    day = stream.withWatermark(ts, late).groupBy(F.window(ts, "1 day").alias("w"), key, tier).agg(F.count("*").alias("n")).filter(F.col("n") > most(1)).select(F.col("w.start").alias("start"), key, tier, F.lit("day").alias("kind"), "n", most(1).alias("most"))
    return minute.unionByName(day)


def after_marks(stream: DataFrame, marks: DataFrame, source: str, ts: str, mark: str) -> DataFrame:
    """Items of each source after its own high-water mark; a source without one is new and gives all. marks (source, mark)."""
    joined = stream.join(marks, source, "left")
    return joined.filter(F.col(mark).isNull() | (F.col(ts) > F.col(mark))).drop(mark)


def next_marks(items: DataFrame, marks: DataFrame, source: str, ts: str, mark: str) -> DataFrame:
    """(source, mark) after a run: the newest item's time, or the old mark where nothing came."""
    new = items.groupBy(source).agg(F.max(ts).alias("_new"))
    return marks.join(new, source, "full").select(source, F.greatest("_new", mark).alias(mark))
