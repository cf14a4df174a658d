"""Named queries of validation and quality operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestrata.functions.text import concept_key
from lodestrata.operators import quality as Q
from lodestrata.plans.registry import register
from lodestrata.tables import load


def validated(spark, d, strict=False):
    e = load(spark, d, "events").withColumns({"kind": F.when(F.col("event_type") == "view", "property").when(F.col("event_type") == "click", "").otherwise(F.col("event_type")), "quote": F.when(F.col("event_id") % 5 == 0, "").when(F.col("event_id") % 5 == 1, "short").otherwise("long enough a quote"), "locator": F.when(F.col("event_id") % 10 == 0, "Fig. 1")})
    checks = [Q.required("claim_type", F.col("kind")), Q.one_of("claim_type", F.col("kind"), Q.CLAIM_TYPES), Q.grounded(F.col("quote"), F.col("locator")), Q.in_range("yield", F.col("value"), 0, 20)]
    return Q.validate(e, checks, strict)


_VALID = """
v AS (SELECT event_id, CASE event_type WHEN 'view' THEN 'property' WHEN 'click' THEN '' ELSE event_type END AS kind, event_id % 5 AS q, event_id % 10 = 0 AS loc, value FROM events),
i AS (SELECT event_id, [x FOR x IN [CASE WHEN kind = '' THEN 'claim_type:error' END, CASE WHEN kind <> '' AND kind <> 'property' THEN 'claim_type:error' END, CASE WHEN q = 0 AND NOT loc THEN 'verbatim_quote:error' WHEN q = 0 THEN 'verbatim_quote:warning' WHEN q = 1 THEN 'verbatim_quote:warning' END, CASE WHEN value < 0 OR value > 20 THEN 'yield:warning' END] IF x IS NOT NULL] AS a FROM v)"""


@register("validate_rows", f"WITH {_VALID} SELECT event_id, CAST(len(a) AS INTEGER) AS n_issues, len([x FOR x IN a IF x LIKE '%:error']) = 0 AS valid FROM i")
def validate_rows(spark, d):
    return validated(spark, d).select("event_id", F.size("issues").alias("n_issues"), "valid")


@register("validate_rows_strict", f"WITH {_VALID} SELECT event_id, len(a) = 0 AS valid FROM i")
def validate_rows_strict(spark, d):
    return validated(spark, d, strict=True).select("event_id", "valid")


@register("validation_summary", f"WITH {_VALID}, x AS (SELECT unnest(a) AS s FROM i) SELECT split_part(s, ':', 1) AS field, split_part(s, ':', 2) AS severity, count(*) AS n FROM x GROUP BY ALL UNION ALL SELECT '', CASE WHEN len([x FOR x IN a IF x LIKE '%:error']) > 0 THEN 'invalid' WHEN len(a) > 0 THEN 'warnings_only' ELSE 'clean' END, count(*) FROM i GROUP BY ALL")
def validation_summary(spark, d):
    return Q.validation_summary(validated(spark, d))


@register("quality_report", "SELECT lang, count(*) AS n, count(*) FILTER (n_chars > 2000) AS deep, count(*) FILTER (contains(text, 'icense')) AS licensed, round(count(*) FILTER (n_chars > 2000)::DOUBLE / count(*), 6) AS deep_share, round(count(*) FILTER (contains(text, 'icense'))::DOUBLE / count(*), 6) AS licensed_share FROM documents GROUP BY lang")
def quality_report(spark, d):
    return Q.shares(load(spark, d, "documents"), ["lang"], {"deep": F.col("n_chars") > 2000, "licensed": F.contains("text", F.lit("icense"))})


@register("paper_validation", "SELECT o_orderkey, round(CASE WHEN o_totalprice > 1000 THEN 0.2 ELSE 0 END + CASE WHEN o_orderstatus = 'F' THEN 0.3 ELSE 0 END + CASE WHEN o_orderpriority <> '5-LOW' THEN 0.3 ELSE 0 END + CASE WHEN o_custkey % 2 = 0 THEN 0.2 ELSE 0 END, 6)::DOUBLE AS score FROM orders")
def paper_validation(spark, d):
    s = Q.paper_score([(F.col("o_totalprice") > 1000, 0.2), (F.col("o_orderstatus") == "F", 0.3), (F.col("o_orderpriority") != "5-LOW", 0.3), (F.col("o_custkey") % 2 == 0, 0.2)])
    return load(spark, d, "orders").select("o_orderkey", s.alias("score"))


_VALUE = """
WITH g AS (SELECT l_orderkey AS k, count(*) AS claims, count(DISTINCT l_returnflag || l_linestatus) AS kinds, sum(CASE WHEN l_returnflag = 'R' THEN 3 ELSE 1 END) AS w FROM lineitem GROUP BY 1),
p AS (SELECT o_orderkey, o_totalprice / 100 AS cites, coalesce(claims, 0) AS claims, coalesce(kinds, 0) AS kinds, coalesce(w, 0) AS w, o_orderkey % 6 AS kw, o_orderpriority AS pr, o_orderstatus AS st, o_custkey AS c FROM orders LEFT JOIN g ON k = o_orderkey),
s AS (SELECT *, round(greatest(least(log10(cites + 1) / 4.0, 1.0) * 25 + least(claims / 12.0, 1.0) * 18 + least(kinds / 6.0, 1.0) * 12 + least(w / 16.0, 1.0) * 22 + least(kw / 5.0, 1.0) * 15 + CASE WHEN st = 'O' THEN 8 ELSE 0 END + CASE WHEN c % 3 = 0 THEN 5 ELSE 0 END - CASE WHEN pr = '1-URGENT' THEN 28 ELSE 0 END - CASE WHEN pr = '2-HIGH' THEN 10 ELSE 0 END - CASE WHEN c % 50 = 0 THEN 35 ELSE 0 END - CASE WHEN c % 7 = 0 THEN 6 ELSE 0 END, 0), 2) AS score FROM p)
SELECT o_orderkey, score, CASE WHEN score >= 60 THEN 'high_value' WHEN score >= 42 THEN 'valuable' WHEN score >= 28 THEN 'maybe' ELSE 'low_value' END AS tier, CASE WHEN c % 50 = 0 THEN 'nonpaper_or_book' WHEN pr = '1-URGENT' THEN 'review_or_perspective' WHEN pr = '2-HIGH' THEN 'software_or_reference' ELSE 'primary_research' END AS style,
CAST(CAST(cites >= 200 AS INTEGER) + CAST(claims >= 8 AS INTEGER) + CAST(kinds >= 4 AS INTEGER) + CAST(w >= 8 AS INTEGER) + CAST(kw >= 3 AS INTEGER) + CAST(st = 'O' AS INTEGER) + CAST(c % 3 = 0 AS INTEGER) + CAST(pr = '1-URGENT' AS INTEGER) + CAST(pr = '2-HIGH' AS INTEGER) + CAST(c % 50 = 0 AS INTEGER) + CAST(c % 7 = 0 AS INTEGER) AS INTEGER) AS n_reasons FROM s"""


@register("value_score", _VALUE)
def value_score(spark, d):
    g = load(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.count("*").alias("claims"), F.countDistinct(F.concat("l_returnflag", "l_linestatus")).alias("kinds"), F.sum(F.when(F.col("l_returnflag") == "R", 3).otherwise(1)).alias("w"))
    p = load(spark, d, "orders").join(g, "o_orderkey", "left").fillna(0, ["claims", "kinds", "w"])
    c, pr = F.col("o_custkey"), F.col("o_orderpriority")
    flags = {"open_access": F.col("o_orderstatus") == "O", "venue": c % 3 == 0, "review": pr == "1-URGENT", "software": pr == "2-HIGH", "nonpaper": c % 50 == 0, "no_abstract": c % 7 == 0}
    out = Q.value_score(p, F.col("o_totalprice") / 100, F.col("claims"), F.col("kinds"), F.col("w"), F.col("o_orderkey") % 6, flags)
    return out.select("o_orderkey", "score", "tier", "style", F.size("reasons").alias("n_reasons"))


@register("tier_assignment", "WITH r AS (SELECT doc_id, CASE lang WHEN 'en' THEN 4 WHEN 'de' THEN 2 ELSE 0 END + least(len(regexp_extract_all(text, 'thing')), 3) AS rel, doc_id % 70 AS cites FROM documents) SELECT doc_id, CAST(rel AS INTEGER) AS rel, CASE WHEN cites >= 50 AND rel >= 5 THEN 1 WHEN (cites >= 10 AND rel >= 5) OR (cites >= 50 AND rel >= 2) THEN 2 WHEN rel >= 4 OR (cites >= 10 AND rel >= 2) THEN 3 ELSE 4 END AS tier FROM r")
def tier_assignment(spark, d):
    rel = Q.relevance(F.col("lang"), {"en": 4, "de": 2}, F.col("text"), "thing")
    return load(spark, d, "documents").select("doc_id", rel.alias("rel"), Q.tier(rel, F.col("doc_id") % 70).alias("tier"))


@register("reading_list_tiers", """
WITH p AS (SELECT o_orderkey, o_orderkey % 80 AS cites, CAST(year(o_orderdate) AS INTEGER) AS year FROM orders), t AS (SELECT *, CASE WHEN cites > 50 THEN 'Foundational' WHEN cites >= 10 OR (year >= 1999 AND cites >= 3) THEN 'Key Results' ELSE 'Recent Advances' END AS tier FROM p), r AS (SELECT *, row_number() OVER (PARTITION BY tier ORDER BY cites DESC, o_orderkey) AS rn FROM t)
SELECT o_orderkey, cites, year, tier, CAST(rn AS INTEGER) AS rn FROM r WHERE rn <= 5""")
def reading_list_tiers(spark, d):
    p = load(spark, d, "orders").select("o_orderkey", (F.col("o_orderkey") % 80).alias("cites"), F.year("o_orderdate").alias("year"))
    p = p.withColumn("tier", Q.reading_tier(F.col("cites"), F.col("year"), 2001))
    return Q.reading_list(p, "tier", [F.desc("cites"), F.col("o_orderkey")])


@register("vote_summary", "SELECT event_type AS item, count(*) FILTER (value > 5) AS up, count(*) FILTER (value <= 5) AS down, max(CASE WHEN value > 5 THEN 1 ELSE -1 END) FILTER (user_id = 8) AS mine FROM events GROUP BY 1")
def vote_summary(spark, d):
    e = load(spark, d, "events").select(F.col("event_type").alias("item"), F.when(F.col("value") > 5, 1).otherwise(-1).alias("vote"), "user_id")
    return Q.votes(e, "item", "vote", "user_id", 8)


@register("flag_summary", "SELECT toxic, quality, count(*) AS n, min(doc_id) AS first FROM labels GROUP BY ALL")
def flag_summary(spark, d):
    return load(spark, d, "labels").groupBy("toxic", "quality").agg(F.count("*").alias("n"), F.min("doc_id").alias("first"))


@register("security_events", "SELECT event_id, ts, user_id FROM events WHERE event_type = 'error' AND value > 5 ORDER BY ts DESC, event_id LIMIT 50")
def security_events(spark, d):
    return load(spark, d, "events").filter("event_type = 'error' AND value > 5").select("event_id", "ts", "user_id").orderBy(F.desc("ts"), "event_id").limit(50)


@register("release_gates", "WITH r AS (SELECT count(*) FILTER (n_chars = 0) AS empty, count(*) - count(DISTINCT doc_id) AS repeated, count(*) FILTER (lang NOT IN ('en', 'de')) AS foreign_docs FROM documents) SELECT 'empty' AS gate, empty::DOUBLE AS value, 0::DOUBLE AS \"limit\", empty <= 0 AS passed FROM r UNION ALL SELECT 'repeated', repeated, 0, repeated <= 0 FROM r UNION ALL SELECT 'foreign_docs', foreign_docs, 10, foreign_docs <= 10 FROM r")
def release_gates(spark, d):
    r = load(spark, d, "documents").agg(F.count(F.when(F.col("n_chars") == 0, 1)).alias("empty"), (F.count("*") - F.countDistinct("doc_id")).alias("repeated"), F.count(F.when(~F.col("lang").isin("en", "de"), 1)).alias("foreign_docs"))
    return Q.gates(r, {"empty": 0, "repeated": 0, "foreign_docs": 10})


@register("coverage_audit", "SELECT c_mktsegment, count(*) AS expected, count(o) AS present, round(count(o)::DOUBLE / count(*), 6) AS share FROM customer LEFT JOIN (SELECT DISTINCT o_custkey AS o FROM orders WHERE o_totalprice > 400000) ON o = c_custkey GROUP BY 1")
def coverage_audit(spark, d):
    o = load(spark, d, "orders").filter("o_totalprice > 400000").select(F.col("o_custkey").alias("c_custkey"))
    return Q.coverage(load(spark, d, "customer"), o, "c_custkey", "c_mktsegment")


@register("merge_groups", r"WITH k AS (SELECT DISTINCT p_brand || ' Methods' AS l FROM part UNION SELECT DISTINCT lower(p_brand) FROM part), g AS (SELECT trim(regexp_replace(regexp_replace(lower(l), '[^a-z0-9]+', '_', 'g'), '(_?methods)+$', ''), '_') AS key, list_sort(list(DISTINCT l)) AS ls FROM k GROUP BY 1) SELECT key, CAST(len(ls) AS INTEGER) AS n, substr(sha256(key), 1, 16) AS concept_id FROM g WHERE len(ls) > 1")
def merge_groups(spark, d):
    b = load(spark, d, "part").select("p_brand").distinct()
    labels = b.select(F.concat("p_brand", F.lit(" Methods")).alias("l")).union(b.select(F.lower("p_brand")))
    return Q.merge_groups(labels, "l", concept_key(F.col("l"))).select("key", F.size("labels").alias("n"), "concept_id")


@register("index_insights", """
SELECT 'sparse' AS insight, p_brand || '/' || p_name AS subject, count(*)::DOUBLE AS value FROM part GROUP BY 2 HAVING count(*) <= 2
UNION ALL SELECT 'dense', p_brand || '/' || p_name, count(*) FROM part GROUP BY 2 HAVING count(*) >= 5
UNION ALL SELECT 'range', p_type, max(p_size) - min(p_size) FROM part GROUP BY 2 HAVING max(p_size) - min(p_size) > 20
UNION ALL SELECT 'type', p_type, count(*) FROM part GROUP BY 2 UNION ALL SELECT 'confidence', CASE WHEN p_size > 30 THEN 'high' WHEN p_size > 10 THEN 'medium' ELSE 'low' END, count(*) FROM part GROUP BY 2
UNION ALL SELECT * FROM (SELECT 'source', 'Supplier ' || l_suppkey, count(*)::DOUBLE FROM lineitem GROUP BY 2 ORDER BY 3 DESC, 2 LIMIT 10)""")
def index_insights(spark, d):
    p = load(spark, d, "part")
    nodes = p.groupBy(F.concat_ws("/", "p_brand", "p_name").alias("subject")).agg(F.count("*").cast("double").alias("value"))
    kinds = nodes.withColumn("insight", F.when(F.col("value") <= 2, "sparse").when(F.col("value") >= 5, "dense")).filter("insight IS NOT NULL")
    spans = p.groupBy(F.col("p_type").alias("subject")).agg((F.max("p_size") - F.min("p_size")).cast("double").alias("value")).filter("value > 20").withColumn("insight", F.lit("range"))
    n = F.count("*").cast("double").alias("value")
    types = p.groupBy(F.lit("type").alias("insight"), F.col("p_type").alias("subject")).agg(n)
    trust = p.groupBy(F.lit("confidence").alias("insight"), F.when(F.col("p_size") > 30, "high").when(F.col("p_size") > 10, "medium").otherwise("low").alias("subject")).agg(n)
    sources = load(spark, d, "lineitem").groupBy(F.lit("source").alias("insight"), F.concat(F.lit("Supplier "), F.col("l_suppkey").cast("string")).alias("subject")).agg(n).orderBy(F.desc("value"), "subject").limit(10)
    out = kinds.select("insight", "subject", "value").unionByName(spans.select("insight", "subject", "value"))
    return out.unionByName(types).unionByName(trust).unionByName(sources)


@register("model_report", """
WITH d AS (SELECT source, n_chars > 2000 AS deep, quality, lang FROM documents LEFT JOIN labels ON labels.doc_id = documents.doc_id), g AS (SELECT source, count(*) AS n, count(*) FILTER (deep) AS deep, count(quality) AS checked, count(*) FILTER (quality = 1) AS verified, count(DISTINCT lang) AS fields FROM d GROUP BY 1)
SELECT source, n, deep, n - deep AS shallow, round(deep::DOUBLE / n, 6) AS deep_share, checked, CASE WHEN checked > 0 THEN round(verified::DOUBLE / checked, 6) END AS verification_rate, fields, concat_ws(',', CASE WHEN round(deep::DOUBLE / n, 6) < 0.3 THEN 'shallow' END, CASE WHEN coalesce(CASE WHEN checked > 0 THEN round(verified::DOUBLE / checked, 6) END, 0) < 0.7 THEN 'unverified' END) AS flags FROM g""")
def model_report(spark, d):
    rows = load(spark, d, "documents").join(load(spark, d, "labels").select("doc_id", "quality"), "doc_id", "left")
    return Q.report(rows, "source", F.col("n_chars") > 2000, F.col("quality") == 1, F.col("quality").isNotNull(), "lang", 0.3, 0.7)


@register("venue_coverage", """
WITH p AS (SELECT CASE WHEN regexp_matches(o_orderpriority, 'URGENT|HIGH') THEN 'leading' WHEN regexp_matches(o_orderpriority, '^3') THEN 'solid' ELSE 'other' END AS label, CASE WHEN regexp_matches(o_orderpriority, 'URGENT|HIGH') THEN 1 WHEN regexp_matches(o_orderpriority, '^3') THEN 2 ELSE 9 END AS tier, CAST(year(o_orderdate) AS INTEGER) AS year FROM orders WHERE year(o_orderdate) BETWEEN 1990 AND 2003)
SELECT label, tier, count(*) AS n, CAST(count(DISTINCT year) AS INTEGER) AS years, min(year) AS first, max(year) AS last, array_to_string(list_filter(range(1990, 2004), lambda y: NOT list_contains(list(DISTINCT year), y)), ',') AS missing FROM p GROUP BY ALL""")
def venue_coverage(spark, d):
    return Q.venue_coverage(load(spark, d, "orders"), F.col("o_orderpriority"), F.year("o_orderdate"), [("URGENT|HIGH", "leading", 1), ("^3", "solid", 2)], 1990, 2003)


@register("data_signal_cte", "WITH s AS (SELECT l_orderkey, count(*) AS n, sum(CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END) AS r, list_sort(list(DISTINCT l_linestatus)) AS k FROM lineitem GROUP BY 1 HAVING count(*) >= 4) SELECT l_orderkey, n, CAST(r AS BIGINT) AS r, array_to_string(k, ',') AS kinds FROM s")
def data_signal_cte(spark, d):
    g = load(spark, d, "lineitem").groupBy("l_orderkey").agg(F.count("*").alias("n"), F.sum(F.when(F.col("l_returnflag") == "R", 1).otherwise(0)).alias("r"), F.array_join(F.array_sort(F.collect_set("l_linestatus")), ",").alias("kinds"))
    return g.filter("n >= 4")
