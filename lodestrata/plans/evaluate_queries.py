"""Named queries of evaluation operators. Probes are sources; gains come from labels."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lodestrata.operators import evaluate as E
from lodestrata.plans.registry import register
from lodestrata.tables import load

_J = "j AS (SELECT source AS probe, doc_id AS id, CAST(2 * quality + toxic AS DOUBLE) AS gain FROM labels JOIN documents USING (doc_id))"
_RUN = "run AS (SELECT source AS probe, doc_id AS id, row_number() OVER (PARTITION BY source ORDER BY n_chars DESC, doc_id) AS rank FROM documents)"
_G = f"WITH {_J}, {_RUN}, g AS (SELECT run.probe, run.id, rank, coalesce(gain, 0) AS gain FROM run LEFT JOIN j ON j.probe = run.probe AND j.id = run.id)"


def judgments(spark, d):
    return load(spark, d, "labels").join(load(spark, d, "documents").select("doc_id", "source"), "doc_id").select(F.col("source").alias("probe"), F.col("doc_id").alias("id"), (2 * F.col("quality") + F.col("toxic")).cast("double").alias("gain"))


def run(spark, d):
    w = W.partitionBy("source").orderBy(F.desc("n_chars"), "doc_id")
    return load(spark, d, "documents").select(F.col("source").alias("probe"), F.col("doc_id").alias("id"), F.row_number().over(w).alias("rank"))


_NDCG = f"{_G}, a AS (SELECT probe, sum(gain / log2(rank + 1)) AS dcg FROM g WHERE rank <= 10 GROUP BY 1), i AS (SELECT probe, sum(gain / log2(r + 1)) AS idcg FROM (SELECT *, row_number() OVER (PARTITION BY probe ORDER BY gain DESC, id) AS r FROM j) WHERE r <= 10 GROUP BY 1), nd AS (SELECT coalesce(a.probe, i.probe) AS probe, CASE WHEN idcg > 0 THEN round(coalesce(dcg, 0) / idcg, 6) END AS ndcg FROM a FULL JOIN i ON a.probe = i.probe)"


@register("ndcg_at_10", f"{_NDCG} SELECT * FROM nd")
def ndcg_at_10(spark, d):
    return E.ndcg(run(spark, d), judgments(spark, d), 10)


@register("mrr", f"{_G} SELECT probe, coalesce(round(1.0::DOUBLE / min(rank) FILTER (gain >= 3), 6), 0) AS mrr FROM g GROUP BY 1")
def mrr(spark, d):
    return E.mrr(run(spark, d), judgments(spark, d), 3)


@register("recall_at_k", f"{_G}, t AS (SELECT probe, count(*) FILTER (gain >= 2) AS n FROM j GROUP BY 1), m AS (SELECT probe, count(*) FILTER (gain >= 2) AS m FROM g WHERE rank <= 20 GROUP BY 1) SELECT t.probe, CASE WHEN n > 0 THEN round(coalesce(m, 0)::DOUBLE / n, 6) END AS recall FROM t LEFT JOIN m ON t.probe = m.probe")
def recall_at_k(spark, d):
    return E.recall(run(spark, d), judgments(spark, d), 20)


@register("run_scores", f"{_NDCG} SELECT right(probe, 1) AS family, count(*) AS n, round(avg(ndcg), 6) AS ndcg FROM nd GROUP BY 1")
def run_scores(spark, d):
    s = E.ndcg(run(spark, d), judgments(spark, d), 10).withColumn("family", F.expr("right(probe, 1)"))
    return E.macro(s, "family", "ndcg")


@register("bootstrap_ci")
def bootstrap_ci(spark, d):
    """Ten thousand rounds. Chance comes from Spark's 64-bit hash, which DuckDB lacks; tests check coverage and reproducibility."""
    s = E.ndcg(run(spark, d), judgments(spark, d), 10).join(E.ndcg(run(spark, d), judgments(spark, d), 5).withColumnRenamed("ndcg", "other"), "probe")
    return E.bootstrap(s.select("probe", (F.col("ndcg") - F.col("other")).alias("d")), "d")


@register("kappa_quadratic", "WITH o AS (SELECT quality AS i, toxic AS j, count(*) AS n FROM labels GROUP BY ALL), a AS (SELECT i, sum(n) AS ni FROM o GROUP BY 1), b AS (SELECT j, sum(n) AS nj FROM o GROUP BY 1), t AS (SELECT sum(n) AS t FROM o) SELECT round(1 - (SELECT sum((i - j) * (i - j) * n) FROM o)::DOUBLE / (SELECT sum((i - j) * (i - j) * ni * nj::DOUBLE / t) FROM a, b, t), 6) AS kappa")
def kappa_quadratic(spark, d):
    return E.kappa_quadratic(load(spark, d, "labels"), "quality", "toxic", 2)


@register("stratified_sample", "WITH r AS (SELECT lang, doc_id, row_number() OVER (PARTITION BY lang ORDER BY md5('s:' || doc_id), doc_id) AS rn FROM documents) SELECT lang, doc_id FROM r WHERE rn <= CASE lang WHEN 'en' THEN 20 ELSE 5 END")
def stratified_sample(spark, d):
    return E.stratified(load(spark, d, "documents"), "lang", "doc_id", F.when(F.col("lang") == "en", 20).otherwise(5), "s").select("lang", "doc_id")


@register("proportional_sample", """
WITH k AS (SELECT lang, count(*) AS k, count(*) * 50::DOUBLE / (SELECT count(*) FROM documents) AS e FROM documents GROUP BY 1), f AS (SELECT lang, greatest(1, CAST(floor(e) AS INTEGER)) AS f, e - floor(e) AS r FROM k),
q AS (SELECT lang, f + CASE WHEN row_number() OVER (ORDER BY r DESC, lang) <= 50 - sum(f) OVER () THEN 1 ELSE 0 END AS q FROM f), r AS (SELECT lang, doc_id, row_number() OVER (PARTITION BY lang ORDER BY md5('p:' || doc_id), doc_id) AS rn FROM documents)
SELECT doc_id, r.lang FROM r JOIN q ON r.lang = q.lang WHERE rn <= q OR doc_id < 5""")
def proportional_sample(spark, d):
    docs = load(spark, d, "documents")
    return E.proportional(docs, "lang", "doc_id", 50, docs.filter("doc_id < 5"), "p").select("doc_id", "lang")


@register("covered_sample", """
WITH r AS (SELECT event_id, event_type, md5('c:' || event_id) AS o FROM events), z AS (SELECT event_type, count(*) AS z FROM events GROUP BY 1), k AS (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY o, event_id) AS rn FROM r JOIN z USING (event_type))
SELECT event_id, event_type FROM k ORDER BY CAST(rn > 3 AS INTEGER), CASE WHEN rn > 3 THEN -z ELSE 0 END, CASE WHEN rn > 3 THEN event_type END NULLS FIRST, o, event_id LIMIT 40""")
def covered_sample(spark, d):
    return E.covered_sample(load(spark, d, "events"), "event_type", "event_id", 3, 40, "c").select("event_id", "event_type")


@register("precision_by_group", "SELECT l_returnflag, l_linestatus, count(*) AS n, count(*) FILTER (l_tax > 0.03) AS correct, round(count(*) FILTER (l_tax > 0.03)::DOUBLE / count(*), 6) AS precision FROM lineitem WHERE l_linenumber <> 7 GROUP BY CUBE (l_returnflag, l_linestatus)")
def precision_by_group(spark, d):
    g = load(spark, d, "lineitem").withColumn("verdict", F.when(F.col("l_linenumber") == 7, "skip").when(F.col("l_tax") > 0.03, "correct").otherwise("wrong"))
    return E.precision(g, "verdict", ["l_returnflag", "l_linestatus"])


@register("latency_percentiles", "SELECT event_type, count(*) AS n, round(quantile_cont(value, 0.5), 6) AS p50, round(quantile_cont(value, 0.95), 6) AS p95, round(avg(CASE WHEN user_id % 10 = 0 THEN 0.0 ELSE 1.0 END::DOUBLE), 6) AS ok_rate FROM events GROUP BY 1")
def latency_percentiles(spark, d):
    return E.latency(load(spark, d, "events"), ["event_type"], "value", F.col("user_id") % 10 != 0)


@register("metric_spread", "SELECT source, count(n_chars) AS n, round(avg(n_chars), 6) AS mean, CASE WHEN count(n_chars) > 1 THEN round(stddev_pop(n_chars), 6) END AS sd FROM documents GROUP BY 1")
def metric_spread(spark, d):
    return E.spread(load(spark, d, "documents"), ["source"], "n_chars")


@register("section_flags", "SELECT conv_id, turn, max(CAST(role = 'assistant' AS INTEGER)) OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING) = 1 AS inside FROM conversations")
def section_flags(spark, d):
    return E.section_flags(load(spark, d, "conversations"), "conv_id", "turn", F.col("role") == "assistant").select("conv_id", "turn", "inside")


_ANSWERS = """
s AS (SELECT conv_id AS answer, turn AS pos, text || CASE WHEN turn % 2 = 1 THEN ' of 5 mg' ELSE '' END AS text, CASE WHEN turn % 3 = 1 THEN ['10.1/' || (conv_id % 40), '10.1/' || (conv_id % 7 + 900)] WHEN turn % 3 = 2 THEN ['10.1/' || (conv_id % 11)] ELSE [] END AS dois, turn >= 2 AS inside FROM conversations),
known AS (SELECT '10.1/' || o_orderkey AS doi, CAST(year(o_orderdate) AS INTEGER) AS year FROM orders WHERE o_orderkey < 900)"""


@register("answer_metrics", f"""
WITH {_ANSWERS}, c AS (SELECT answer, pos, x.doi, year FROM (SELECT answer, pos, unnest(dois) AS doi FROM s) x LEFT JOIN known k ON k.doi = x.doi), p AS (SELECT answer, count(*) AS cited, count(year) AS existing, round(avg(2002 - year), 6) AS recency FROM (SELECT DISTINCT answer, doi, year FROM c) GROUP BY 1),
g AS (SELECT answer, pos, max(CAST(year IS NOT NULL AS INTEGER)) AS good FROM c GROUP BY ALL), m AS (SELECT s.answer, s.pos, inside, regexp_matches(text, '[0-9]') AS specific, coalesce(good, 0) AS good FROM s LEFT JOIN g ON g.answer = s.answer AND g.pos = s.pos),
b AS (SELECT *, max(good) OVER (PARTITION BY answer ORDER BY pos ROWS UNBOUNDED PRECEDING) AS before FROM m), t AS (SELECT answer, count(*) FILTER (specific) AS specific, count(*) FILTER (specific AND (good = 1 OR (inside AND before = 1))) AS grounded FROM b GROUP BY 1),
o AS (SELECT DISTINCT answer, doi FROM c), h AS (SELECT answer, max(n) AS shared FROM (SELECT a.answer, b.answer AS other, count(*) AS n FROM o a JOIN o b ON a.doi = b.doi AND a.answer <> b.answer GROUP BY ALL) GROUP BY 1)
SELECT t.answer, coalesce(cited, 0) AS cited, coalesce(existing, 0) AS existing, specific, grounded, CASE WHEN specific > 0 THEN round(grounded::DOUBLE / specific, 6) END AS grounded_share, recency, CASE WHEN cited > 0 THEN round(coalesce(shared, 0)::DOUBLE / cited, 6) END AS overlap FROM t LEFT JOIN p ON p.answer = t.answer LEFT JOIN h ON h.answer = t.answer""")
def answer_metrics(spark, d):
    """Conversations as answers, with citations put in by a rule since they have none."""
    c, t = F.col("conv_id"), F.col("turn")
    doi = lambda n: F.concat(F.lit("10.1/"), n.cast("string"))
    cited = F.when(t % 3 == 1, F.array(doi(c % 40), doi(c % 7 + 900))).when(t % 3 == 2, F.array(doi(c % 11))).otherwise(F.array().cast("array<string>"))
    s = load(spark, d, "conversations").select(c.alias("answer"), t.alias("pos"), F.concat("text", F.when(t % 2 == 1, " of 5 mg").otherwise("")).alias("text"), cited.alias("dois"), (t >= 2).alias("inside"))
    known = load(spark, d, "orders").filter("o_orderkey < 900").select(doi(F.col("o_orderkey")).alias("doi"), F.year("o_orderdate").alias("year"))
    return E.answer_metrics(s, known, 2002)


@register("stage_profile", "WITH m AS (SELECT user_id AS run, event_type AS stage, epoch_us(ts) / 1000000.0::DOUBLE AS mark FROM events), d AS (SELECT stage, mark - lag(mark) OVER (PARTITION BY run ORDER BY mark) AS delta FROM m) SELECT stage, count(*) AS n, round(quantile_cont(delta, 0.5), 3) AS median FROM d WHERE delta IS NOT NULL GROUP BY 1")
def stage_profile(spark, d):
    m = load(spark, d, "events").select(F.col("user_id").alias("run"), F.col("event_type").alias("stage"), (F.unix_micros(F.col("ts").cast("timestamp")) / 1000000.0).alias("at"))
    return E.stage_profile(m, "run", "stage", "at").withColumn("median", F.round("median", 3))


@register("candidate_pool", f"WITH {_RUN}, b AS (SELECT source AS probe, doc_id AS id, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS rank FROM documents) SELECT probe, id FROM run WHERE rank <= 5 UNION SELECT probe, id FROM b WHERE rank <= 5")
def candidate_pool(spark, d):
    other = load(spark, d, "documents").select(F.col("source").alias("probe"), F.col("doc_id").alias("id"), F.row_number().over(W.partitionBy("source").orderBy("doc_id")).alias("rank"))
    return E.pool([run(spark, d), other], 5)


@register("search_suite", f"""
WITH {_RUN}, e AS (SELECT source AS probe, doc_id AS id FROM labels JOIN documents USING (doc_id) WHERE quality = 1), r AS (SELECT run.*, lang AS paper, n_chars AS cites, (doc_id % 97)::DOUBLE AS ms FROM run JOIN documents ON doc_id = id WHERE rank <= 10), t(paper, tier) AS (VALUES ('en', 1), ('de', 2)),
h AS (SELECT r.*, e.id IS NOT NULL AS hit, coalesce(tier, 9) = 1 AS top FROM r LEFT JOIN e ON e.probe = r.probe AND e.id = r.id LEFT JOIN t ON t.paper = r.paper),
p AS (SELECT probe, count(*) FILTER (hit) AS hits, count(*) - count(DISTINCT paper) AS duplicates, round(avg(top::INTEGER::DOUBLE), 6) AS top_share, round(avg(cites), 6) AS mean_cites, round(quantile_cont(ms, 0.95), 6) AS p95 FROM h GROUP BY 1), w AS (SELECT probe, count(*) AS expected FROM e GROUP BY 1)
SELECT w.probe, coalesce(hits, 0) AS hits, expected, round(coalesce(hits, 0)::DOUBLE / expected, 6) AS recall, coalesce(duplicates, 0) AS duplicates, top_share, mean_cites, p95 FROM w LEFT JOIN p ON p.probe = w.probe""")
def search_suite(spark, d):
    docs = load(spark, d, "documents").select(F.col("doc_id").alias("id"), F.col("source").alias("probe"), F.col("lang").alias("paper"), F.col("n_chars").alias("cites"), (F.col("doc_id") % 97).cast("double").alias("ms"))
    expected = load(spark, d, "labels").filter("quality = 1").select(F.col("doc_id").alias("id")).join(docs, "id").select("probe", "id")
    results = run(spark, d).select("probe", "id", "rank").join(docs.drop("probe"), "id")
    return E.suite(results, expected, spark.createDataFrame([("en", 1), ("de", 2)], "paper string, tier int"))
