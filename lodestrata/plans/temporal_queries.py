"""Named queries of temporal operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestrata.operators import temporal as D
from lodestrata.plans.registry import register
from lodestrata.tables import load

_YEARS = "y AS (SELECT CAST(year(o_orderdate) AS INTEGER) AS year, o_orderpriority AS kind, count(*) AS n FROM orders GROUP BY ALL)"


@register("year_surge_decline", f"WITH {_YEARS}, p AS (SELECT *, lag(n) OVER (PARTITION BY kind ORDER BY year) AS prev FROM y) SELECT year, kind, n, prev, coalesce(prev > 0 AND n > 2 * prev, false) AS surge, coalesce(prev > 5 AND n < prev / 2, false) AS decline FROM p")
def year_surge_decline(spark, d):
    counts = load(spark, d, "orders").groupBy(F.year("o_orderdate").alias("year"), F.col("o_orderpriority").alias("kind")).agg(F.count("*").alias("n"))
    return D.surge_decline(counts, "year", "n", ["kind"])


@register("evolution_top_papers", """
WITH c AS (SELECT CAST(year(o_orderdate) AS INTEGER) AS year, o_orderstatus AS kind, o_custkey AS paper, o_totalprice AS cites FROM orders), k AS (SELECT year, kind, count(*) AS n FROM c GROUP BY ALL), t AS (SELECT year, CAST(sum(n) AS BIGINT) AS n, array_to_string(list_sort(list(kind || '=' || n)), ',') AS kinds FROM k GROUP BY year),
p AS (SELECT year, paper, max(cites) AS c FROM c GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY year ORDER BY c DESC, paper) AS rn FROM p), b AS (SELECT year, string_agg(paper, ',' ORDER BY rn) AS top_papers FROM r WHERE rn <= 5 GROUP BY year),
j AS (SELECT t.year, n, kinds, top_papers, lag(n) OVER (ORDER BY t.year) AS prev FROM t JOIN b ON t.year = b.year) SELECT *, coalesce(prev > 0 AND n > 2 * prev, false) AS surge, coalesce(prev > 5 AND n < prev / 2, false) AS decline FROM j""")
def evolution_top_papers(spark, d):
    c = load(spark, d, "orders").select(F.year("o_orderdate").alias("year"), F.col("o_orderstatus").alias("kind"), F.col("o_custkey").alias("paper"), F.col("o_totalprice").alias("cites"))
    return D.timeline(c, "year", "kind", "paper", "cites").withColumns({"kinds": F.array_join("kinds", ","), "top_papers": F.array_join(F.col("top_papers").cast("array<string>"), ",")})


@register("time_decades", "SELECT CAST(year(o_orderdate) // 10 * 10 AS INTEGER) AS decade, count(*) AS n FROM orders GROUP BY 1")
def time_decades(spark, d):
    o = load(spark, d, "orders")
    return o.groupBy(D.by_period(o, F.col("o_orderdate"), "decade").alias("decade")).agg(F.count("*").alias("n"))


@register("quarter_browse", "SELECT year(o_orderdate) || 'Q' || quarter(o_orderdate) AS quarter, count(*) AS n, max(o_totalprice) AS most FROM orders GROUP BY 1")
def quarter_browse(spark, d):
    o = load(spark, d, "orders")
    return o.groupBy(D.by_period(o, F.col("o_orderdate"), "quarter").alias("quarter")).agg(F.count("*").alias("n"), F.max("o_totalprice").alias("most"))


@register("index_stats", "SELECT 'kind' AS facet, lang AS value, count(*) AS n FROM documents GROUP BY 2 UNION ALL SELECT 'year', CAST(year(o_orderdate) AS VARCHAR), count(*) FROM orders WHERE year(o_orderdate) > 1900 GROUP BY 2")
def index_stats(spark, d):
    kinds = load(spark, d, "documents").groupBy(F.col("lang").alias("value")).agg(F.count("*").alias("n")).select(F.lit("kind").alias("facet"), "value", "n")
    years = load(spark, d, "orders").filter(F.year("o_orderdate") > 1900).groupBy(F.year("o_orderdate").cast("string").alias("value")).agg(F.count("*").alias("n"))
    return kinds.unionByName(years.select(F.lit("year").alias("facet"), "value", "n"))


@register("discovery_feed_windows", """
WITH m AS (SELECT CAST(max(ts) AS DATE) + 20 AS as_of FROM events), a AS (SELECT event_id, value, date_diff('day', CAST(ts AS DATE), as_of) AS age FROM events, m), b AS (SELECT *, CASE WHEN age <= 7 THEN 7 WHEN age <= 30 THEN 30 WHEN age <= 90 THEN 90 WHEN age <= 365 THEN 365 WHEN age <= 3650 THEN 3650 END AS b FROM a)
SELECT event_id, value, CAST((SELECT min(b) FROM b) AS INTEGER) AS window_days FROM b WHERE (SELECT min(b) FROM b) IS NULL OR b <= (SELECT min(b) FROM b) ORDER BY value DESC, event_id LIMIT 50""")
def discovery_feed_windows(spark, d):
    e = load(spark, d, "events")
    as_of = e.agg(F.max(F.to_date("ts")).alias("_m"))
    dated = e.crossJoin(F.broadcast(as_of))  # one row
    rows = D.progressive_window(dated, F.to_date("ts"), F.date_add("_m", 20))
    return rows.select("event_id", "value", "window_days").orderBy(F.desc("value"), "event_id").limit(50)


_SUBS = "subs AS (SELECT c_custkey AS user_id, CASE WHEN c_custkey % 7 = 0 THEN NULL ELSE TIMESTAMP '2024-01-30 00:00:00' - to_hours(CAST(c_custkey * 5 AS INTEGER)) END AS last, CASE WHEN c_custkey % 2 = 0 THEN 'weekly' ELSE 'daily' END AS cadence FROM customer)"


def subs(spark, d):
    c = load(spark, d, "customer")
    last = F.when(F.col("c_custkey") % 7 != 0, F.timestamp_seconds(F.lit(1706572800) - F.col("c_custkey") * 5 * 3600).cast("timestamp_ntz"))
    return c.select(F.col("c_custkey").alias("user_id"), last.alias("last"), F.when(F.col("c_custkey") % 2 == 0, "weekly").otherwise("daily").alias("cadence"))


@register("due_subscriptions", f"WITH {_SUBS} SELECT user_id, cadence, date_diff('second', last, TIMESTAMP '2024-01-30 00:00:00') AS seconds FROM subs WHERE last IS NULL OR date_diff('second', last, TIMESTAMP '2024-01-30 00:00:00') >= CASE cadence WHEN 'weekly' THEN 604800 ELSE 86400 END")
def due_subscriptions(spark, d):
    return D.due(subs(spark, d), "last", "cadence", F.lit("2024-01-30 00:00:00").cast("timestamp")).select("user_id", "cadence", "seconds")


@register("subscription_new_items", f"WITH {_SUBS} SELECT s.user_id, count(*) AS n, max(event_id) AS newest FROM events e JOIN subs s ON e.user_id = s.user_id WHERE last IS NULL OR ts > last GROUP BY 1")
def subscription_new_items(spark, d):
    return D.new_since(load(spark, d, "events"), subs(spark, d), "user_id", "ts", "last").groupBy("user_id").agg(F.count("*").alias("n"), F.max("event_id").alias("newest"))


@register("query_analytics", "SELECT CAST(ts AS DATE) AS day, event_type, count(*) AS n, round(avg(value), 6) AS mean_latency FROM events WHERE ts >= (SELECT max(ts) FROM events) - INTERVAL 14 DAY GROUP BY ALL")
def query_analytics(spark, d):
    e = load(spark, d, "events")
    since = e.agg((F.max("ts") - F.expr("INTERVAL 14 DAYS")).alias("_s"))
    return D.usage(e.crossJoin(F.broadcast(since)).filter(F.col("ts") >= F.col("_s")), "ts", ["event_type"], "value")  # since: one row


@register("top_queries", "SELECT event_type, count(*) AS n, round(avg(value), 6) AS mean_latency, count(DISTINCT user_id) AS users FROM events GROUP BY 1 ORDER BY n DESC, event_type LIMIT 3")
def top_queries(spark, d):
    return load(spark, d, "events").groupBy("event_type").agg(F.count("*").alias("n"), F.round(F.avg("value"), 6).alias("mean_latency"), F.countDistinct("user_id").alias("users")).orderBy(F.desc("n"), "event_type").limit(3)


@register("ingestion_history", "SELECT CAST(ts AS DATE) AS day, count(*) FILTER (event_type = 'click') AS click, count(*) FILTER (event_type = 'view') AS view, count(DISTINCT user_id) AS users FROM events GROUP BY 1 ORDER BY day DESC LIMIT 30")
def ingestion_history(spark, d):
    e = load(spark, d, "events").withColumn("day", F.to_date("ts"))
    wide = e.groupBy("day").pivot("event_type", ["click", "view"]).agg(F.count("event_id"))
    users = e.groupBy("day").agg(F.countDistinct("user_id").alias("users"))
    return users.join(wide, "day").select("day", F.coalesce("click", F.lit(0)).alias("click"), F.coalesce("view", F.lit(0)).alias("view"), "users").orderBy(F.desc("day")).limit(30)


@register("usage_counters", "SELECT user_id, CAST(ts AS DATE) AS day, count(*) AS n FROM events GROUP BY ALL")
def usage_counters(spark, d):
    return load(spark, d, "events").groupBy("user_id", F.to_date("ts").alias("day")).agg(F.count("*").alias("n"))


@register("tier_graduation", "WITH u AS (SELECT user_id, count(*) * 400 AS total, date_diff('day', CAST(min(ts) AS DATE), CAST(max(ts) AS DATE)) AS age FROM events GROUP BY 1), t AS (SELECT *, CASE user_id % 3 WHEN 0 THEN 'free' WHEN 1 THEN 'tier_1' ELSE 'tier_2' END AS now FROM u) SELECT user_id, CASE WHEN now IN ('free', 'tier_1') AND total >= 10000 AND age >= 7 THEN 'tier_2' WHEN now = 'tier_2' AND total >= 100000 AND age >= 30 THEN 'tier_3' ELSE now END AS tier FROM t")
def tier_graduation(spark, d):
    u = load(spark, d, "events").groupBy("user_id").agg((F.count("*") * 400).alias("total"), F.datediff(F.max(F.to_date("ts")), F.min(F.to_date("ts"))).alias("age"))
    now = F.when(F.col("user_id") % 3 == 0, "free").when(F.col("user_id") % 3 == 1, "tier_1").otherwise("tier_2")
    return u.select("user_id", D.tier(now, F.col("total"), F.col("age")).alias("tier"))


_FEED = """
WITH m AS (SELECT CAST(max(ts) AS DATE) + {late} AS as_of FROM events), a AS (SELECT event_id, value, CASE WHEN event_type = 'error' THEN value * 10 ELSE 0 END AS surprise, date_diff('day', CAST(ts AS DATE), as_of) AS age FROM events, m), s AS (SELECT coalesce(bool_or(age <= 10 AND surprise > 0), false) AS found FROM a),
b AS (SELECT *, CASE WHEN age <= 7 THEN 7 WHEN age <= 30 THEN 30 WHEN age <= 90 THEN 90 WHEN age <= 365 THEN 365 WHEN age <= 3650 THEN 3650 END AS b FROM a)
SELECT event_id, 'surprise' AS basis, 10 AS window_days, round(surprise, 6) AS score FROM a, s WHERE found AND age <= 10 AND surprise > 0
UNION ALL SELECT event_id, 'citations', CAST((SELECT min(b) FROM b) AS INTEGER), round(value, 6) FROM b, s WHERE NOT found AND ((SELECT min(b) FROM b) IS NULL OR b <= (SELECT min(b) FROM b))
ORDER BY score DESC, event_id LIMIT 30"""


def feed(spark, d, late):
    e = load(spark, d, "events")
    as_of = e.agg(F.date_add(F.max(F.to_date("ts")), late).alias("_m"))
    rows = e.withColumn("surprise", F.when(F.col("event_type") == "error", F.col("value") * 10).otherwise(0.0)).crossJoin(F.broadcast(as_of))  # one row
    found = D.discovery(rows, F.to_date("ts"), F.col("_m"), "surprise", "value", 10)
    return found.select("event_id", "basis", "window_days", F.round("score", 6).alias("score")).orderBy(F.desc("score"), "event_id").limit(30)


@register("discovery_feed_surprise", _FEED.format(late=1))
def discovery_feed_surprise(spark, d):
    return feed(spark, d, 1)


@register("discovery_feed_citations", _FEED.format(late=20))
def discovery_feed_citations(spark, d):
    """No surprise in the last days: the smallest window that holds any item, by citations."""
    return feed(spark, d, 20)


@register("usage_summary", "WITH m AS (SELECT CAST(max(ts) AS DATE) AS d FROM events), p AS (SELECT user_id, CAST(ts AS DATE) AS day, count(*) AS n FROM events, m WHERE date_diff('day', CAST(ts AS DATE), d) < 20 GROUP BY ALL) SELECT user_id, CAST(sum(n) AS BIGINT) AS requests, count(*) AS active_days, round(sum(n) / 20.0::DOUBLE, 6) AS mean_per_day, max(n) AS busiest FROM p GROUP BY 1")
def usage_summary(spark, d):
    e = load(spark, d, "events")
    last = e.agg(F.max(F.to_date("ts")).alias("_m"))
    return D.usage_summary(e.crossJoin(F.broadcast(last)), "ts", "user_id", F.col("_m"), 20)  # last: one row
