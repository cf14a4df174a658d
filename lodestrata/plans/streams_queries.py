"""Named queries of streaming operators: streams over events run to their end, checked on closed windows."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestrata.plans.registry import register
from lodestrata.streaming import streams as W


def events(spark, d):
    return W.table_stream(spark, d, "events", "ts")


@register("stream_daily_counts", "WITH m AS (SELECT max(ts) - INTERVAL 1 HOUR AS w FROM events) SELECT CAST(ts AS DATE) AS day, event_type, count(*) AS n FROM events, m WHERE CAST(CAST(ts AS DATE) AS TIMESTAMP) + INTERVAL 1 DAY <= w GROUP BY ALL")
def stream_daily_counts(spark, d):
    return W.replay(W.daily_counts(events(spark, d), "ts", ["event_type"])).select(F.to_date("day").alias("day"), "event_type", "n")


@register("stream_sliding_rate", "WITH m AS (SELECT max(ts) - INTERVAL 10 MINUTE AS w FROM events), s AS (SELECT user_id, unnest(range(time_bucket(INTERVAL 1 HOUR, ts) - INTERVAL 5 HOUR, time_bucket(INTERVAL 1 HOUR, ts) + INTERVAL 1 HOUR, INTERVAL 1 HOUR)) AS start FROM events) SELECT start, user_id, count(*) AS n FROM s, m WHERE start + INTERVAL 6 HOUR <= w GROUP BY ALL HAVING count(*) > 3")
def stream_sliding_rate(spark, d):
    return W.replay(W.sliding_rate(events(spark, d), "ts", "user_id", "6 hours", "1 hour", 3)).withColumn("start", F.col("start").cast("timestamp_ntz"))


@register("stream_sessions", "WITH m AS (SELECT max(ts) - INTERVAL 10 MINUTE AS w FROM events), g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 2 HOUR THEN 0 ELSE 1 END AS new FROM events), s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g), o AS (SELECT user_id, min(ts) AS start, max(ts) + INTERVAL 2 HOUR AS \"end\", count(*) AS n FROM s GROUP BY user_id, k) SELECT start, \"end\", user_id, n FROM o, m WHERE \"end\" <= w")
def stream_sessions(spark, d):
    s = W.replay(W.sessions(events(spark, d), "ts", "user_id", "2 hours"))
    return s.withColumns({"start": F.col("start").cast("timestamp_ntz"), "end": F.col("end").cast("timestamp_ntz")})


@register("stream_dedup", "SELECT count(DISTINCT event_id) AS n, count(DISTINCT user_id) AS users FROM events")
def stream_dedup(spark, d):
    twice = events(spark, d).select("event_id", "user_id", "ts", F.explode(F.array(F.lit(1), F.lit(2))).alias("copy"))
    return W.replay(W.dedup(twice, "ts", ["event_id"])).agg(F.count("*").alias("n"), F.countDistinct("user_id").alias("users"))


@register("stream_upsert", "SELECT user_id, count(*) AS n, max(event_id) AS last FROM events GROUP BY 1")
def stream_upsert(spark, d):
    """Batches are merged into a table of versions; the newest version is the result."""
    from lodestrata.operators.ingest import upsert

    where = W.scratch(spark)
    state = {"now": None}

    def merge(batch, number):
        own = batch.groupBy("user_id").agg(F.count("*").alias("n"), F.max("event_id").alias("last"))
        if state["now"]:
            old = spark.read.parquet(state["now"])
            summed = old.unionByName(own).groupBy("user_id").agg(F.sum("n").alias("n"), F.max("last").alias("last"))
            own = upsert(old, summed, ["user_id"], ["last", "n"])
        own.write.mode("overwrite").parquet(f"{where}/version-{number}")
        state["now"] = f"{where}/version-{number}"

    W.replay(events(spark, d), each=merge)
    return spark.read.parquet(state["now"])


@register("stream_digests", "SELECT e.user_id, count(*) AS n FROM events e JOIN (SELECT c_custkey AS user_id FROM customer) s ON e.user_id = s.user_id WHERE ts > TIMESTAMP '2024-01-15' GROUP BY 1")
def stream_digests(spark, d):
    subs = spark.read.parquet(f"{d}/customer.parquet").select(F.col("c_custkey").alias("user_id"), F.lit("2024-01-15").cast("timestamp").alias("last"))
    return W.replay(W.digests(events(spark, d), subs, "user_id", "ts", "last").select("user_id", "event_id")).groupBy("user_id").agg(F.count("*").alias("n"))


@register("stream_join", "SELECT a.event_id AS purchase, b.event_id AS click FROM events a JOIN events b ON a.user_id = b.user_id AND b.ts >= a.ts AND b.ts <= a.ts + INTERVAL 3 HOUR WHERE a.event_type = 'purchase' AND b.event_type = 'click'")
def stream_join(spark, d):
    a = events(spark, d).filter("event_type = 'purchase'").select("user_id", F.col("event_id").alias("purchase"), F.col("ts").alias("t1"))
    b = events(spark, d).filter("event_type = 'click'").select("user_id", F.col("event_id").alias("click"), F.col("ts").alias("t2"))
    return W.replay(W.joined_within(a, b, "user_id", "t1", "t2", "3 HOURS")).select("purchase", "click")


@register("stream_incremental_ids", "SELECT vec_id FROM embeddings WHERE vec_id NOT IN (SELECT doc_id FROM labels)")
def stream_incremental_ids(spark, d):
    """Vectors that aren't there yet, batch by batch: an anti join of a stream with a table."""
    new = W.table_stream(spark, d, "embeddings").select("vec_id")
    have = spark.read.parquet(f"{d}/labels.parquet").select(F.col("doc_id").alias("vec_id"))
    return W.replay(new.join(have, "vec_id", "left_anti"))


@register("stream_rate_log", """
WITH e AS (SELECT ts, user_id, CASE user_id % 3 WHEN 0 THEN 'anon' WHEN 1 THEN 'tier1' ELSE 'none' END AS tier FROM events), m AS (SELECT max(ts) - INTERVAL 10 MINUTE AS w FROM events),
x AS (SELECT unnest(range(time_bucket(INTERVAL 10 SECOND, ts) - INTERVAL 50 SECOND, time_bucket(INTERVAL 10 SECOND, ts) + INTERVAL 1 SECOND, INTERVAL 10 SECOND)) AS start, user_id, tier FROM e),
a AS (SELECT start, user_id, tier, 'minute' AS kind, count(*) AS n, CASE tier WHEN 'tier1' THEN 2 ELSE 1 END AS most FROM x, m WHERE start + INTERVAL 1 MINUTE <= w GROUP BY ALL),
b AS (SELECT CAST(CAST(ts AS DATE) AS TIMESTAMP) AS start, user_id, tier, 'day' AS kind, count(*) AS n, CASE tier WHEN 'tier1' THEN 6 ELSE 4 END AS most FROM e, m WHERE CAST(CAST(ts AS DATE) AS TIMESTAMP) + INTERVAL 1 DAY <= w GROUP BY ALL)
SELECT * FROM a WHERE n > most UNION ALL SELECT * FROM b WHERE n > most""")
def stream_rate_log(spark, d):
    """Limits by tier, in a sliding minute and a UTC day; the log of what exceeds them."""
    tier = F.when(F.col("user_id") % 3 == 0, "anon").when(F.col("user_id") % 3 == 1, "tier1").otherwise("none")
    log = W.over_limits(events(spark, d).select("ts", "user_id", tier.alias("tier")), "ts", "user_id", "tier", {"anon": (1, 4), "tier1": (2, 6)})
    return W.replay(log).withColumn("start", F.col("start").cast("timestamp_ntz"))


@register("stream_source_marks", """
WITH k(event_type, mark) AS (VALUES ('click', TIMESTAMP '2024-01-20 00:00:00'), ('view', TIMESTAMP '2024-01-25 00:00:00'), ('gone', TIMESTAMP '2024-01-05 00:00:00')), n AS (SELECT event_type, count(*) AS n, max(ts) AS newest FROM events LEFT JOIN k USING (event_type) WHERE mark IS NULL OR ts > mark GROUP BY 1)
SELECT coalesce(k.event_type, n.event_type) AS event_type, coalesce(n, 0) AS n, greatest(newest, mark) AS mark FROM k FULL JOIN n ON k.event_type = n.event_type""")
def stream_source_marks(spark, d):
    """What is new of each source since its own last run, and the marks for the next one."""
    marks = spark.createDataFrame([("click", "2024-01-20 00:00:00"), ("view", "2024-01-25 00:00:00"), ("gone", "2024-01-05 00:00:00")], "event_type string, mark string").withColumn("mark", F.col("mark").cast("timestamp"))
    new = W.replay(W.after_marks(events(spark, d).select("event_type", "event_id", "ts"), marks, "event_type", "ts", "mark"))
    counts = new.groupBy("event_type").agg(F.count("*").alias("n"))
    out = W.next_marks(new, marks, "event_type", "ts", "mark").join(counts, "event_type", "left")
    return out.select("event_type", F.coalesce("n", F.lit(0)).alias("n"), F.col("mark").cast("timestamp_ntz").alias("mark"))


@register("stream_job_status", "SELECT user_id, list(DISTINCT event_type ORDER BY event_type)[1] AS first_status, bool_or(event_type = 'purchase') AS finished, count(*) AS n FROM events GROUP BY 1")
def stream_job_status(spark, d):
    """What a poll of each job sees: its events so far, and whether it has come to its end."""
    seen = W.replay(events(spark, d).select("user_id", "event_type", "ts"))
    return seen.groupBy("user_id").agg(F.min("event_type").alias("first_status"), F.max((F.col("event_type") == "purchase").cast("int")).cast("boolean").alias("finished"), F.count("*").alias("n"))
