"""Named queries of pairwise operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestrata.functions.text import edit_ratio, tokens
from lodestrata.operators import pairs as P
from lodestrata.plans.registry import register
from lodestrata.tables import load

_V = "v AS (SELECT l_partkey AS k, l_linenumber AS t, l_orderkey AS source, l_suppkey, max(l_discount) * 1000 AS x, max(l_extendedprice) AS y, min(l_orderkey * 1000 + l_suppkey) AS id FROM lineitem GROUP BY ALL)"


def values(spark, d):
    return load(spark, d, "lineitem").groupBy(F.col("l_partkey").alias("k"), F.col("l_linenumber").alias("t"), F.col("l_orderkey").alias("source"), "l_suppkey").agg(
        (F.max("l_discount") * 1000).alias("x"), F.max("l_extendedprice").alias("y"), F.min(F.col("l_orderkey") * 1000 + F.col("l_suppkey")).alias("id")
    )


@register("numeric_conflicts", f"WITH {_V} SELECT a.id AS a_id, b.id AS b_id, round(abs(a.x - b.x), 6) AS diff FROM v a JOIN v b ON a.k = b.k AND a.t = b.t AND a.id < b.id AND a.source <> b.source AND abs(a.x - b.x) >= 20")
def numeric_conflicts(spark, d):
    return P.numeric_conflicts(values(spark, d), ["k", "t"], "id", "source", "x").select("a_id", "b_id", "diff")


@register("relative_conflicts", f"WITH {_V} SELECT a.id AS a_id, b.id AS b_id, round(abs(a.y - b.y) / greatest(abs(a.y), abs(b.y), 1) * 100, 6) AS percent FROM v a JOIN v b ON a.k = b.k AND a.t = b.t AND a.id < b.id AND a.source <> b.source AND abs(a.y - b.y) / greatest(abs(a.y), abs(b.y), 1) * 100 >= 20")
def relative_conflicts(spark, d):
    return P.relative_conflicts(values(spark, d), ["k", "t"], "id", "source", "y").select("a_id", "b_id", "percent")


@register("candidate_pairs_capped", """
WITH r AS (SELECT lang, source, doc_id, row_number() OVER (PARTITION BY lang ORDER BY doc_id) AS rn FROM documents), m AS (SELECT * FROM r WHERE rn <= 100), p AS (SELECT a.lang, a.doc_id AS a_id, b.doc_id AS b_id, row_number() OVER (PARTITION BY a.lang ORDER BY a.doc_id, b.doc_id) AS rn FROM m a JOIN m b ON a.lang = b.lang AND a.doc_id < b.doc_id AND a.source <> b.source)
SELECT lang, a_id, b_id FROM p WHERE rn <= 500""")
def candidate_pairs_capped(spark, d):
    return P.candidate_pairs(load(spark, d, "documents"), ["lang"], "doc_id", "source").select(F.col("a_lang").alias("lang"), "a_id", "b_id")


@register("pair_estimate", "WITH c AS (SELECT lang, source, count(*) AS k FROM documents GROUP BY ALL) SELECT lang, CAST(sum(k) AS BIGINT) AS n, count(*) AS n_sources, CAST((sum(k) * sum(k) - sum(k * k)) // 2 AS BIGINT) AS pairs, CAST(least((sum(k) * sum(k) - sum(k * k)) // 2, 20) AS BIGINT) AS capped FROM c GROUP BY lang")
def pair_estimate(spark, d):
    return P.pair_estimate(load(spark, d, "documents"), ["lang"], "source").withColumn("capped", F.col("capped").cast("long"))


@register("viewfree_candidates", "WITH g AS (SELECT p_name, p_type, count(DISTINCT p_brand) AS n FROM part GROUP BY ALL) SELECT a.p_partkey AS a_id, b.p_partkey AS b_id FROM part a JOIN part b ON a.p_name = b.p_name AND a.p_type = b.p_type AND a.p_partkey < b.p_partkey AND a.p_brand <> b.p_brand JOIN g ON g.p_name = a.p_name AND g.p_type = a.p_type WHERE n >= 2 AND a.p_type IN ('ECONOMY', 'SMALL') AND a.p_name NOT LIKE 'hot %'")
def viewfree_candidates(spark, d):
    p = load(spark, d, "part").filter(F.col("p_type").isin("ECONOMY", "SMALL") & ~F.startswith("p_name", F.lit("hot ")))
    a, b, on = P.self_pairs(p, ["p_name", "p_type"], "p_partkey", ["p_brand"])
    return a.join(b, on & (F.col("a_p_brand") != F.col("b_p_brand"))).select("a_id", "b_id")


_CUE_WORDS = {side: [w for family in P.OPPOSING for w in family[side]] for side in (0, 1)}


@register("opposing_cues", f"""
WITH w AS (SELECT doc_id, source, regexp_extract_all(regexp_replace(lower(text || ' ' || CASE doc_id % 4 WHEN 0 THEN '{P.OPPOSING[0][0][0]}' WHEN 1 THEN '{P.OPPOSING[0][1][0]}' WHEN 2 THEN '{P.OPPOSING[1][0][0]} {P.OPPOSING[0][1][0]}' ELSE '' END), '[^a-z0-9_+-]', ' ', 'g'), '[a-z][a-z0-9_+-]*') AS w FROM documents),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, {' + '.join(f"CAST((list_has_any(a.w, {list(x)!r}) AND list_has_any(b.w, {list(y)!r})) OR (list_has_any(a.w, {list(y)!r}) AND list_has_any(b.w, {list(x)!r})) AS INTEGER)" for x, y in P.OPPOSING)} AS score FROM w a JOIN w b ON b.doc_id = a.doc_id + 1)
SELECT a, b, score FROM p""")
def opposing_cues(spark, d):
    """Neighbouring documents, with cue words put into three of four since the corpus has none."""
    first, second = P.OPPOSING[0], P.OPPOSING[1]
    more = F.when(F.col("doc_id") % 4 == 0, first[0][0]).when(F.col("doc_id") % 4 == 1, first[1][0]).when(F.col("doc_id") % 4 == 2, f"{second[0][0]} {first[1][0]}").otherwise("")
    t = load(spark, d, "documents").select("doc_id", F.regexp_replace(F.lower(F.concat_ws(" ", "text", more)), "[^a-z0-9_+-]", " ").alias("t"))
    other = t.select((F.col("doc_id") - 1).alias("doc_id"), F.col("t").alias("u"))
    return t.join(other, "doc_id").select(F.col("doc_id").alias("a"), (F.col("doc_id") + 1).alias("b"), P.cue_conflict(F.col("t"), F.col("u")).alias("score"))


@register("stored_conflicts", "WITH c AS (SELECT event_id AS a_id, event_id + 9990 AS b_id, value FROM events WHERE event_id < 50) SELECT a_id, b_id, c.value, a.event_type AS a_event_type, b.event_type AS b_event_type FROM c LEFT JOIN events a ON a.event_id = a_id LEFT JOIN events b ON b.event_id = b_id ORDER BY value DESC, a_id LIMIT 30")
def stored_conflicts(spark, d):
    e = load(spark, d, "events")
    c = e.filter("event_id < 50").select(F.col("event_id").alias("a_id"), (F.col("event_id") + 9990).alias("b_id"), "value")
    return P.stored_conflicts(c, e, "event_id", ["event_type"]).select("a_id", "b_id", "value", "a_event_type", "b_event_type").orderBy(F.desc("value"), "a_id").limit(30)


@register("surprise_score", """
WITH n AS (SELECT p_type, p_name, count(*) AS sib FROM part GROUP BY ALL), p AS (SELECT p_partkey, p.p_type, p_size, sib FROM part p JOIN n ON p.p_type = n.p_type AND p.p_name = n.p_name),
s AS (SELECT p_partkey, least(CASE WHEN sib <= 3 THEN 10 WHEN sib <= 10 THEN 5 ELSE 0 END + CASE p_type WHEN 'SMALL' THEN 10 WHEN 'LARGE' THEN 5 ELSE 0 END + CASE WHEN p_size * 3 > 99 THEN 5 WHEN p_size * 3 < 10 THEN 8 ELSE 0 END, 40) AS structural, CASE WHEN 1990 + p_size % 30 >= 2019 THEN 15 WHEN 1990 + p_size % 30 >= 2018 THEN 10 WHEN 1990 + p_size % 30 >= 2017 THEN 5 ELSE 0 END AS temporal FROM p)
SELECT p_partkey, structural, temporal, 5 AS content, structural + temporal + 5 AS surprise FROM s""")
def surprise_score(spark, d):
    p = load(spark, d, "part")
    sib = p.groupBy("p_type", "p_name").agg(F.count("*").alias("sib"))
    rows = p.join(sib, ["p_type", "p_name"])
    kind = F.when(F.col("p_type") == "SMALL", "limitation").when(F.col("p_type") == "LARGE", "future_direction").otherwise("property")
    out = P.surprise(rows, [F.col("sib")], kind, F.col("p_size") * 3, 1990 + F.col("p_size") % 30, 2019, F.lit("a Novel class"))
    return out.select("p_partkey", "structural", "temporal", "content", "surprise")


_W = "regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+')"


@register("jaccard_near_dupes", f"""
WITH t AS (SELECT doc_id, source, list_distinct({_W}) AS w FROM documents), p AS (SELECT a.doc_id AS a, b.doc_id AS b, len(list_intersect(a.w, b.w)) AS n, len(a.w) AS x, len(b.w) AS y FROM t a JOIN t b ON a.source = b.source AND a.doc_id < b.doc_id WHERE len(a.w) > 0 AND len(b.w) > 0)
SELECT a, b, round(n::DOUBLE / (x + y - n), 6) AS jaccard FROM p WHERE n::DOUBLE / (x + y - n) >= 0.8""")
def jaccard_near_dupes(spark, d):
    return P.token_pairs(load(spark, d, "documents"), "doc_id", tokens(F.col("text")), "source", 0.8)


@register("benchmark_overlap", "SELECT item_id, count(DISTINCT doc_id) AS n_docs FROM documents, benchmark WHERE contains(documents.text, benchmark.text) GROUP BY 1")
def benchmark_overlap(spark, d):
    """Documents that hold an item as it is."""
    found = P.contained_items(load(spark, d, "documents"), load(spark, d, "benchmark"), "doc_id", "item_id")
    return found.groupBy(F.col("item").alias("item_id")).agg(F.countDistinct("doc").alias("n_docs"))


def low_product(key, factor: int):
    """Low 64 bits of a long times a factor, where * would overflow. Both 32-bit halves of the factor are below 2^29."""
    half = F.lit(0xFFFFFFFF)
    low, high, few, many = key.bitwiseAND(half), F.shiftright(key, 32), factor & 0xFFFFFFFF, factor >> 32
    first = low * F.lit(few)
    return F.shiftleft(F.shiftright(first, 32) + high * F.lit(few) + low * F.lit(many), 32).bitwiseOR(first.bitwiseAND(half))


_BITS32 = "list_transform(range(1, 33), lambda i: p_partkey * (1099511627791 * i))"


@register("bit_tanimoto", f"""
WITH f AS (SELECT p_partkey, p_name, {_BITS32} AS x FROM part), p AS (SELECT a.p_partkey AS a, b.p_partkey AS b, list_sum([bit_count(a.x[i] & b.x[i]) FOR i IN range(1, 33)])::DOUBLE / list_sum([bit_count(a.x[i] | b.x[i]) FOR i IN range(1, 33)]) AS s FROM f a JOIN f b ON a.p_name = b.p_name AND a.p_partkey < b.p_partkey)
SELECT a, b, round(s, 6) AS similarity FROM p WHERE round(s, 6) >= 0.5""")
def bit_tanimoto(spark, d):
    """Fingerprints of 2048 bits (32 longs), made from the key by a rule since the parts have none.

    A long is the product's low 64 bits. The SQL has no result beyond a key of 262,143, where a product needs more.
    """
    part = load(spark, d, "part").select(F.col("p_partkey").cast("long").alias("p_partkey"), "p_name").repartition("p_partkey")  # a file of a few MB would be one task
    bits = F.array(*(low_product(F.col("p_partkey"), 1099511627791 * i) for i in range(1, 33)))
    return P.fingerprint_pairs(part.withColumn("bits", bits), "p_partkey", "bits", "p_name", 0.5)


@register("greedy_match")
def greedy_match(spark, d):
    """Greedy one-to-one matches depend on order; tests compare a plain loop."""
    p = load(spark, d, "part").select("p_type", "p_partkey", "p_name", "p_size")
    gold = p.filter("p_size % 2 = 0").select(F.col("p_type").alias("doc"), F.col("p_partkey").alias("gold"), F.col("p_name").alias("g"))
    found = p.filter("p_size % 2 = 1").select(F.col("p_type").alias("doc"), F.col("p_partkey").alias("found"), F.col("p_name").alias("f"))
    scored = gold.join(found, "doc").withColumn("score", F.round(0.7 * edit_ratio(F.col("g"), F.col("f")) + 0.3, 6))
    return P.greedy_match(scored.filter("score >= 0.65").select("doc", "gold", "found", "score"), "doc")


@register("field_accuracy", """
WITH n AS (SELECT CASE WHEN l_linenumber % 3 = 0 THEN 'wrong' ELSE 'correct' END AS verdict FROM lineitem),
t AS (SELECT p_name AS g, CASE p_partkey % 3 WHEN 0 THEN p_name || 's' WHEN 1 THEN substr(p_name, 1, CAST(greatest(1, length(p_name) * 7 // 10) AS INTEGER)) ELSE reverse(p_name) END AS f FROM part),
r AS (SELECT 1 - levenshtein(g, f)::DOUBLE / greatest(length(g), length(f)) AS r FROM t)
SELECT 'number' AS field, verdict, count(*) AS n FROM n GROUP BY 2 UNION ALL SELECT 'string', CASE WHEN r > 0.8 THEN 'correct' WHEN r > 0.5 THEN 'partial' ELSE 'wrong' END, count(*) FROM r GROUP BY 2""")
def field_accuracy(spark, d):
    q = F.col("l_quantity")
    found = F.when(F.col("l_linenumber") % 3 == 0, q * 1.5).otherwise(q * 1.005)
    numbers = load(spark, d, "lineitem").select(F.lit("number").alias("field"), P.field_accuracy(q.cast("string"), found.cast("string"), F.lit(0.0)).alias("verdict"))
    g, k = F.col("p_name"), F.col("p_partkey") % 3
    said = F.when(k == 0, F.concat(g, F.lit("s"))).when(k == 1, F.substring(g, F.lit(1), F.greatest(F.lit(1), F.floor(F.length(g) * 7 / 10)).cast("int"))).otherwise(F.reverse(g))
    strings = load(spark, d, "part").select(F.lit("string").alias("field"), P.field_accuracy(g, said, edit_ratio(g, said)).alias("verdict"))
    return numbers.unionByName(strings).groupBy("field", "verdict").agg(F.count("*").alias("n"))
