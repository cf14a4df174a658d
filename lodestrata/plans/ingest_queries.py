"""Named queries of ingest operators and of join patterns."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from lodestrata.functions import text, udf
from lodestrata.operators import ingest as S
from lodestrata.operators import taxonomy, vectors
from lodestrata.plans.registry import register
from lodestrata.scratch import scratch_dir
from lodestrata.sources import readers, sinks
from lodestrata.tables import load


@register("keep_last_upsert", "WITH r AS (SELECT doc_id % 300 AS k, doc_id, lang, row_number() OVER (PARTITION BY doc_id % 300 ORDER BY n_chars DESC, doc_id DESC) AS rn FROM documents) SELECT k, doc_id, lang FROM r WHERE rn = 1")
def keep_last_upsert(spark, d):
    rows = load(spark, d, "documents").select((F.col("doc_id") % 300).alias("k"), "doc_id", "lang", "n_chars")
    base, changes = rows.filter("doc_id < 500"), rows.filter("doc_id >= 500")
    return S.upsert(base, changes, ["k"], ["n_chars", "doc_id"]).select("k", "doc_id", "lang")


@register("keep_first_insert", "SELECT p_partkey, p_name FROM part WHERE p_size < 20 UNION ALL SELECT p_partkey, p_name FROM part WHERE p_size >= 10 AND NOT p_size < 20")
def keep_first_insert(spark, d):
    p = load(spark, d, "part").select("p_partkey", "p_name", "p_size")
    return S.keep_first(p.filter("p_size < 20"), p.filter("p_size >= 10"), ["p_partkey"]).select("p_partkey", "p_name")


@register("validating_insert", "SELECT event_id FROM events WHERE value BETWEEN 0 AND 20 OR event_id % 100 = 0")
def validating_insert(spark, d):
    from lodestrata.operators import quality as Q

    e = load(spark, d, "events")
    v = Q.validate(e, [Q.issue((F.col("value") > 20) & (F.col("event_id") % 100 != 0), "value", "out of range")])
    return sinks.split_valid(v)[0].select("event_id")


@register("dedup_prefer_nonempty", """
WITH r AS (SELECT 0 AS i, 'Doi' || (doc_id % 4000000) AS doi, CASE WHEN doc_id % 3 = 0 THEN '' ELSE source END AS abstract, n_chars FROM documents WHERE doc_id % 7 < 5 UNION ALL SELECT 1, 'DOI' || (doc_id % 4000000), source, n_chars FROM documents WHERE doc_id % 7 >= 4),
n AS (SELECT *, row_number() OVER (PARTITION BY lower(doi) ORDER BY CAST(abstract = '' AS INTEGER), i, doi) AS rn FROM r WHERE lower(doi) NOT IN (SELECT 'doi' || doc_id FROM documents WHERE doc_id % 5 = 0)) SELECT doi, abstract, n_chars FROM n WHERE rn = 1 AND abstract <> ''""")
def dedup_prefer_nonempty(spark, d):
    """Two sources that overlap, each a share of the documents by a rule."""
    docs = load(spark, d, "documents")
    num = (F.col("doc_id") % 4000000).cast("string")
    a = docs.filter("doc_id % 7 < 5").select(F.concat(F.lit("Doi"), num).alias("doi"), F.when(F.col("doc_id") % 3 == 0, "").otherwise(F.col("source")).alias("abstract"), "n_chars")
    b = docs.filter("doc_id % 7 >= 4").select(F.concat(F.lit("DOI"), num).alias("doi"), F.col("source").alias("abstract"), "n_chars")
    have = docs.filter("doc_id % 5 = 0").select(F.concat(F.lit("doi"), F.col("doc_id").cast("string")).alias("doi"))
    return S.discover([a, b], have, "doi", "abstract", "n_chars").select("doi", "abstract", "n_chars")


@register("route_three_way", "SELECT doc_id, CASE WHEN doc_id % 4 = 0 THEN 'full' WHEN length(trim(text)) >= 800 THEN 'abstract' ELSE 'dropped' END AS route, CASE WHEN doc_id % 4 = 0 OR length(trim(text)) >= 800 THEN NULL ELSE 'short abstract' END AS reason FROM documents")
def route_three_way(spark, d):
    return S.route(load(spark, d, "documents"), F.col("doc_id") % 4 == 0, F.col("text"), 800).select("doc_id", "route", "reason")


@register("anti_join_new", "SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels) AND source IN (SELECT source FROM documents WHERE lang = 'es')")
def anti_join_new(spark, d):
    docs = load(spark, d, "documents")
    ready = docs.join(docs.filter("lang = 'es'").select("source"), "source", "left_semi").select("doc_id")
    return S.unseen(docs.select("doc_id"), load(spark, d, "labels"), "doc_id", ready)


@register("job_ledger", "SELECT user_id, max_by(event_type, event_id) AS status, max(event_id) AS last FROM events GROUP BY 1")
def job_ledger(spark, d):
    e = load(spark, d, "events").select("user_id", F.col("event_type").alias("status"), F.col("event_id").alias("last"))
    return S.latest_status(e, "user_id", "last").select("user_id", "status", "last")


@register("response_cache_keys", """SELECT event_type, sha256('{"p0":"' || event_type || '","p1":1}') AS key, count(*) AS n FROM events GROUP BY 1""")
def response_cache_keys(spark, d):
    e = load(spark, d, "events").groupBy("event_type").agg(F.count("*").alias("n"))
    return e.select("event_type", S.cache_key(F.col("event_type"), F.lit(1)).alias("key"), "n")


@register("case_insensitive_lookup", "SELECT c_custkey, c_name FROM customer WHERE lower(c_name) IN (SELECT lower(c_name) FROM customer WHERE c_custkey % 50 = 0)")
def case_insensitive_lookup(spark, d):
    c = load(spark, d, "customer")
    return S.lookup(c, c.filter("c_custkey % 50 = 0").select(F.upper("c_name").alias("c_name")), "c_name").select("c_custkey", "c_name")


@register("bulk_export", "SELECT o_orderkey, o_totalprice, (SELECT count(*) FROM orders WHERE o_orderdate >= TIMESTAMP '1999-01-01') AS total FROM orders WHERE o_orderdate >= TIMESTAMP '1999-01-01' ORDER BY o_orderkey LIMIT 100 OFFSET 50")
def bulk_export(spark, d):
    o = load(spark, d, "orders")
    return S.export(o, F.col("o_orderdate") >= F.lit("1999-01-01").cast("timestamp_ntz"), [F.col("o_orderkey")], 100, 50).select("o_orderkey", "o_totalprice", "total")


@register("changelog", "SELECT event_id, ts FROM events WHERE ts > TIMESTAMP '2024-01-10' ORDER BY ts DESC, event_id DESC LIMIT 50")
def changelog(spark, d):
    return load(spark, d, "events").filter(F.col("ts") > F.lit("2024-01-10").cast("timestamp_ntz")).select("event_id", "ts").orderBy(F.desc("ts"), F.desc("event_id")).limit(50)


@register("table_counts", "SELECT 'part' AS name, count(*) AS n FROM part UNION ALL SELECT 'orders', count(*) FROM orders UNION ALL SELECT 'documents', count(*) FROM documents")
def table_counts(spark, d):
    return S.table_counts({n: load(spark, d, n) for n in ("part", "orders", "documents")})


@register("nested_extractions", "SELECT substr(sha256('10.1/' || conv_id || ':' || role || ':' || turn), 1, 16) AS claim_id, '10.1/' || conv_id AS doi, role AS claim_type, 'v' || (conv_id % 3) AS venue FROM conversations")
def nested_extractions(spark, d):
    """Claims nested by paper, exploded again with ids and metadata."""
    c = load(spark, d, "conversations").select(F.concat(F.lit("10.1/"), F.col("conv_id").cast("string")).alias("doi"), F.struct(F.col("role").alias("claim_type"), F.col("turn").cast("string").alias("content"), F.lit("high").alias("confidence"), F.lit("q").alias("quote")).alias("c"), "conv_id")
    raw = c.groupBy("doi").agg(F.collect_list("c").alias("cs")).select(F.upper("doi").alias("doi"), F.lit("m").alias("model"), F.struct(F.col("cs").alias("claims")).alias("data"))
    meta = c.select("doi", F.concat(F.lit("v"), (F.col("conv_id") % 3).cast("string")).alias("venue")).distinct()
    return readers.extractions(raw, meta).select("claim_id", "doi", "claim_type", "venue")


@register("hierarchy_import", "WITH p AS (SELECT DISTINCT p_type AS path FROM part UNION SELECT DISTINCT p_type || '/' || p_brand FROM part) SELECT path, (SELECT count(*) FROM p c WHERE regexp_replace(c.path, '/?[^/]*$', '') = p.path) AS n_children FROM p")
def hierarchy_import(spark, d):
    p = load(spark, d, "part")
    n = p.select(F.col("p_type").alias("path")).union(p.select(F.concat_ws("/", "p_type", "p_brand"))).distinct().withColumn("view_id", F.lit("v"))
    return readers.hierarchy(n).select("path", F.coalesce(F.size("children"), F.lit(0)).cast("long").alias("n_children")).withColumn("n_children", F.greatest("n_children", F.lit(0)))


@register("public_projection", "SELECT o_orderkey AS claim_id, o_orderstatus AS claim_type FROM orders")
def public_projection(spark, d):
    o = load(spark, d, "orders").select(F.col("o_orderkey").alias("claim_id"), F.col("o_orderstatus").alias("claim_type"), "o_custkey")
    return sinks.public({"claims": o, "users": load(spark, d, "customer")})["claims"]


@register("submission_queue", "SELECT user_id, event_type, count(*) AS n FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id DESC) AS rn FROM events) WHERE rn <= 3 GROUP BY ALL")
def submission_queue(spark, d):
    from lodestrata.operators.rank import top_per

    return top_per(load(spark, d, "events"), ["user_id", "event_type"], [F.desc("event_id")], 3).groupBy("user_id", "event_type").agg(F.count("*").alias("n"))


@register("membership_pairs", "SELECT DISTINCT l_partkey, l_suppkey FROM lineitem WHERE l_partkey IN (SELECT p_partkey FROM part WHERE p_size > 40) AND l_suppkey IN (SELECT s_suppkey FROM supplier WHERE s_acctbal > 5000)")
def membership_pairs(spark, d):
    """Both ends in given sets."""
    pairs = load(spark, d, "lineitem").select("l_partkey", "l_suppkey").distinct()
    a, b = load(spark, d, "part").filter("p_size > 40"), load(spark, d, "supplier").filter("s_acctbal > 5000")
    return pairs.join(a, F.col("l_partkey") == F.col("p_partkey"), "left_semi").join(b, F.col("l_suppkey") == F.col("s_suppkey"), "left_semi")


@register("set_operations", "SELECT 'both' AS op, count(*) AS n FROM (SELECT l_partkey FROM lineitem WHERE l_returnflag = 'A' INTERSECT SELECT l_partkey FROM lineitem WHERE l_returnflag = 'N') UNION ALL SELECT 'first_only', count(*) FROM (SELECT l_partkey FROM lineitem WHERE l_suppkey = 1 EXCEPT SELECT l_partkey FROM lineitem WHERE l_suppkey = 2) UNION ALL SELECT 'either', count(*) FROM (SELECT l_partkey FROM lineitem WHERE l_suppkey = 1 UNION SELECT l_partkey FROM lineitem WHERE l_suppkey = 2)")
def set_operations(spark, d):
    t = load(spark, d, "lineitem")
    keys = lambda c: t.filter(c).select("l_partkey")
    both = keys("l_returnflag = 'A'").intersect(keys("l_returnflag = 'N'"))
    first = keys("l_suppkey = 1").subtract(keys("l_suppkey = 2"))
    either = keys("l_suppkey = 1").union(keys("l_suppkey = 2")).distinct()
    return S.table_counts({"both": both, "first_only": first, "either": either}).withColumnRenamed("name", "op")


@register("claims_with_sources", "SELECT o_orderkey, c_mktsegment, n_name FROM orders JOIN customer ON o_custkey = c_custkey LEFT JOIN nation ON c_nationkey = n_nationkey AND n_regionkey = 3")
def claims_with_sources(spark, d):
    n = load(spark, d, "nation").filter("n_regionkey = 3").select("n_nationkey", "n_name")
    both = load(spark, d, "orders").join(load(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    return both.join(F.broadcast(n), F.col("c_nationkey") == F.col("n_nationkey"), "left").select("o_orderkey", "c_mktsegment", "n_name")  # nations: 25 rows


@register("random_probe", "SELECT p_partkey, p_name FROM part WHERE p_size BETWEEN 10 AND 20 ORDER BY md5('f:' || p_partkey), p_partkey LIMIT 10")
def random_probe(spark, d):
    p = load(spark, d, "part").filter("p_size BETWEEN 10 AND 20")
    return p.orderBy(F.md5(F.concat(F.lit("f:"), F.col("p_partkey").cast("string")).cast("binary")), "p_partkey").limit(10).select("p_partkey", "p_name")


@register("interval_join", "WITH s AS (SELECT event_id AS span, user_id AS u, CAST(epoch(ts) AS BIGINT) AS a, CAST(epoch(ts) AS BIGINT) + 600 AS b FROM events WHERE event_type = 'purchase'), p AS (SELECT event_id, user_id, CAST(floor(epoch(ts)) AS BIGINT) AS t FROM events WHERE event_type = 'click') SELECT span, event_id FROM s JOIN p ON t >= a AND t < b")
def interval_join(spark, d):
    e = load(spark, d, "events").withColumn("t", F.unix_seconds(F.col("ts").cast("timestamp")))
    # DuckDB's cast rounds; seconds here are rounded alike
    r = F.round(F.unix_micros(F.col("ts").cast("timestamp")) / 1000000.0).cast("long")
    spans = e.filter("event_type = 'purchase'").select(F.col("event_id").alias("span"), r.alias("a"), (r + 600).alias("b"))
    return S.range_join(e.filter("event_type = 'click'").select("event_id", "t"), "t", spans, "a", "b", 600).select("span", "event_id")


@register("query_intents", "SELECT doc_id, CASE WHEN doc_id % 4 = 0 THEN 'author' WHEN doc_id % 4 = 1 THEN 'comparison' WHEN doc_id % 4 = 2 THEN 'question' ELSE 'topic' END AS intent FROM documents")
def query_intents(spark, d):
    q = F.element_at(F.array(*map(F.lit, ("papers by Ada Lovelace", "zinc vs copper", "how do metals melt", "metal fatigue"))), (F.col("doc_id") % 4 + 1).cast("int"))
    return load(spark, d, "documents").select("doc_id", udf.apply("query_intent", q).alias("intent"))


@register("cross_catalog_join", "SELECT event_type, lang, count(*) AS n FROM events JOIN documents ON doc_id = event_id GROUP BY ALL")
def cross_catalog_join(spark, d):
    """A database of its own for run-time tables beside the corpus, which is only read, joined in one statement."""
    load(spark, d, "events").select("event_id", "event_type").createOrReplaceGlobalTempView("runtime_events")
    load(spark, d, "documents").select("doc_id", "lang").createOrReplaceTempView("corpus_documents")
    return spark.sql("SELECT event_type, lang, count(*) AS n FROM global_temp.runtime_events JOIN corpus_documents ON doc_id = event_id GROUP BY event_type, lang")


@register("json_records_import", "SELECT 'dp' || (p_partkey % 50) AS doi, min(p_name) AS title, count(*) AS citation_count FROM part GROUP BY 1")
def json_records_import(spark, d):
    """A file for each record, read back by a given schema."""
    p = load(spark, d, "part").groupBy(F.concat(F.lit("dp"), (F.col("p_partkey") % 50).cast("string")).alias("doi")).agg(F.min("p_name").alias("title"), F.count("*").cast("int").alias("citation_count"))
    folder = f"{scratch_dir(spark)}/records-{uuid.uuid4().hex}"
    p.repartition(50, "doi").write.option("maxRecordsPerFile", 1).json(folder)
    return readers.json_files(spark, folder, readers.SOURCE, multi_line=False).select("doi", "title", F.col("citation_count").cast("long").alias("citation_count"))


@register("batched_scan", "WITH r AS (SELECT o_orderkey, (row_number() OVER (ORDER BY o_orderkey) - 1) // 1000 AS batch FROM orders) SELECT CAST(batch AS BIGINT) AS batch, count(*) AS n, min(o_orderkey) AS first, max(o_orderkey) AS last FROM r GROUP BY 1")
def batched_scan(spark, d):
    """Batches of a thousand rows in order of the key, numbered without bringing the table into one task."""
    keys = vectors.numbered(load(spark, d, "orders").select("o_orderkey"), "o_orderkey")
    return keys.groupBy(F.floor((F.col("row") - F.lit(0)) / 1000).alias("batch")).agg(F.count("*").alias("n"), F.min("o_orderkey").alias("first"), F.max("o_orderkey").alias("last"))


@register("dataset_package", "SELECT 'claims' AS part, o_orderstatus AS by, count(*) AS n, CAST(sum(o_custkey) AS BIGINT) AS checksum FROM orders GROUP BY 2 UNION ALL SELECT 'sources', '', count(*), CAST(sum(c_custkey) AS BIGINT) FROM customer")
def dataset_package(spark, d):
    """A package of JSON lines, partitioned where asked, and what a reader of it finds."""
    folder = f"{scratch_dir(spark)}/package-{uuid.uuid4().hex}"
    sinks.package({"claims": load(spark, d, "orders").select("o_orderkey", "o_custkey", "o_orderstatus"), "sources": load(spark, d, "customer").select("c_custkey", "c_name")}, folder, {"claims": "o_orderstatus"})
    claims = spark.read.schema("o_orderkey long, o_custkey long, o_orderstatus string").json(f"{folder}/claims")
    sources = spark.read.schema("c_custkey long, c_name string").json(f"{folder}/sources")
    one = claims.groupBy(F.lit("claims").alias("part"), F.col("o_orderstatus").alias("by")).agg(F.count("*").alias("n"), F.sum("o_custkey").alias("checksum"))
    return one.unionByName(sources.groupBy(F.lit("sources").alias("part"), F.lit("").alias("by")).agg(F.count("*").alias("n"), F.sum("c_custkey").alias("checksum")))


@register("full_rebuild", """
WITH c AS (SELECT DISTINCT substr(sha256('10.1/' || conv_id || ':' || role || ':' || turn), 1, 16) AS id, role || '/' || 'v' || (conv_id % 3) AS path FROM conversations), m AS (SELECT id, path FROM c UNION ALL SELECT id, split_part(path, '/', 1) FROM c)
SELECT path, count(*) AS total, min(id) AS first_claim FROM m GROUP BY 1""")
def full_rebuild(spark, d):
    """From nested extractions to the tree: claims with ids, paths, prefix map and roll-up, published as a new version."""
    c = load(spark, d, "conversations").select(F.concat(F.lit("10.1/"), F.col("conv_id").cast("string")).alias("doi"), F.struct(F.col("role").alias("claim_type"), F.col("turn").cast("string").alias("content"), F.lit("high").alias("confidence"), F.lit("q").alias("quote")).alias("c"), "conv_id")
    raw = c.groupBy("doi").agg(F.collect_list("c").alias("cs")).select(F.upper("doi").alias("doi"), F.lit("m").alias("model"), F.struct(F.col("cs").alias("claims")).alias("data"))
    meta = c.select("doi", F.concat(F.lit("v"), (F.col("conv_id") % 3).cast("string")).alias("venue")).distinct()
    claims = readers.extractions(raw, meta).select("claim_id", F.lit("by_type").alias("view"), F.concat_ws("/", "claim_type", "venue").alias("path")).distinct()
    claims = sinks.publish(claims, f"{scratch_dir(spark)}/claims-{uuid.uuid4().hex}", "1", "rebuilt_claims")
    tree = taxonomy.rollup(taxonomy.prefix_map(claims, "claim_id", F.split("path", "/"), F.col("view")))
    return tree.select("path", "total", F.get("sample_ids", F.lit(0)).alias("first_claim"))


@register("query_variants", "SELECT unnest(['hot rings', 'warm ring', 'hot loops', 'hot ring']) AS variant, unnest(range(1, 5)) AS place")
def query_variants(spark, d):
    """Variants of a query in order: as it is, its pair's expansions, its words' and the singular."""
    found = text.query_variants("hot rings", {"hot rings": ["warm ring"]}, {"rings": ["loops"]})
    return spark.createDataFrame([(v, i) for i, v in enumerate(found, 1)], "variant string, place bigint")


@register("pluggable_scorers", "SELECT p_partkey, CASE WHEN contains(p_name, 'ring') THEN 1.0 ELSE 0.0 END::DOUBLE AS relevance, CASE WHEN contains(p_name, 'ring') THEN 'cycle' ELSE '' END AS added, p_partkey % 2 = 0 AND length(split_part(p_name, ' ', 1)) >= 4 OR p_partkey % 2 = 0 AND length(split_part(p_name, ' ', 2)) >= 4 AS contradicts FROM part WHERE NOT contains(p_name, 'rings')")
def pluggable_scorers(spark, d):
    """Relevance, expansion and contradiction by the fall-backs of the registry."""
    p, name = load(spark, d, "part").filter(~F.contains("p_name", F.lit("rings"))), F.col("p_name")
    other = F.when(F.col("p_partkey") % 2 == 0, F.concat(F.lit("not "), name)).otherwise(name)
    added = F.array_join(F.array_except(udf.apply("query_expand", name), F.split(name, " ")), ",")
    return p.select("p_partkey", udf.apply("query_relevance", F.concat(F.lit("ring\t"), name)).alias("relevance"), added.alias("added"), udf.apply("claims_contradict", F.concat(name, F.lit("\t"), other)).alias("contradicts"))
