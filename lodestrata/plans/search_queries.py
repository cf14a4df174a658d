"""Named queries of full-text search, vectors, ranking and the search pipeline."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestrata.functions.text import tokens
from lodestrata.operators import fts, rank, search, text_index, vectors
from lodestrata.plans.registry import register
from lodestrata.tables import load

TERMS = ["thing", "ther", "eron"]
WORDS = "regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+')"
PADDED = f"(' ' || array_to_string({WORDS}, ' ') || ' ')"
Q = 7  # the vector that serves as a query


def docs(spark, d):
    return load(spark, d, "documents")


def ix(spark, d):
    """The stored index of the documents' text; built at its first use, read by term then."""
    return text_index.stored(docs(spark, d), "doc_id", {"text": "text"})


def bm25_sql(terms, name="bm25", where="true", prefix="", table="documents", key="doc_id", text="text"):
    """CTEs ending in `name` (id, score)."""
    p = prefix or name
    words = WORDS.replace("text", text)
    held = ", ".join(f"'{t}'" for t in terms)
    df = ", ".join(f"count(*) FILTER (list_contains(w, '{t}')) AS df{i}" for i, t in enumerate(terms))
    tf = ", ".join(f"len(list_filter(w, lambda x: x = '{t}')) AS tf{i}" for i, t in enumerate(terms))
    s = " + ".join(f"ln(1 + (n - df{i} + 0.5::DOUBLE) / (df{i} + 0.5::DOUBLE)) * tf{i} * 2.2::DOUBLE / (tf{i} + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * dl / avgdl))" for i in range(len(terms)))
    return (
        f"{p}_w AS (SELECT {key} AS id, {words} AS w FROM {table} WHERE {where}), {p}_s AS (SELECT count(*) AS n, avg(len(w)) AS avgdl, {df} FROM {p}_w), "
        f"{p}_h AS (SELECT id, len(w) AS dl, {tf} FROM {p}_w WHERE list_has_any(w, [{held}])), {name} AS (SELECT id, round({s}, 6) AS score FROM {p}_h, {p}_s)"
    )


@register("bm25_topk", f"WITH {bm25_sql(TERMS)} SELECT id AS doc_id, score FROM bm25 ORDER BY score DESC, id LIMIT 20")
def bm25_topk(spark, d):
    return fts.top(ix(spark, d).bm25(TERMS), 20, "id").withColumnRenamed("id", "doc_id")


@register("bm25_scan_topk", f"WITH {bm25_sql(TERMS)} SELECT id AS doc_id, score FROM bm25 ORDER BY score DESC, id LIMIT 20")
def bm25_scan_topk(spark, d):
    """The same without an index, by two scans of the text."""
    return fts.top(fts.bm25(docs(spark, d), "doc_id", "text", TERMS), 20, "id").withColumnRenamed("id", "doc_id")


@register("fts_index", f"WITH t AS (SELECT doc_id, len({WORDS}) AS dl, unnest({WORDS}) AS term FROM documents), p AS (SELECT term, doc_id, dl, count(*) AS tf FROM t GROUP BY ALL) SELECT term, count(*) AS df, CAST(sum(tf) AS BIGINT) AS cf, max(dl) AS longest FROM p GROUP BY term")
def fts_index(spark, d):
    return ix(spark, d).frequencies().select("term", "df", "cf", "longest")


@register("fts_fielded_index", """
WITH p AS (SELECT source, string_agg(text, ' ' ORDER BY doc_id) AS body FROM documents WHERE doc_id % 1 = 0 GROUP BY source),
t AS (SELECT source, 'title' AS field, unnest(regexp_extract_all(lower(source), '[\\p{L}\\p{N}]+')) AS term FROM p UNION ALL SELECT source, 'body', unnest(regexp_extract_all(lower(body), '[\\p{L}\\p{N}]+')) FROM p)
SELECT field, term, count(DISTINCT source) AS df, count(*) AS cf FROM t GROUP BY ALL""")
def fts_fielded_index(spark, d):
    p = docs(spark, d).groupBy("source").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("doc_id", "text"))), lambda x: x["text"]), " ").alias("body"))
    return fts.index(p, "source", {"title": "source", "body": "body"}).groupBy("field", "term").agg(F.count("*").alias("df"), F.sum("tf").alias("cf"))


@register("fts_all_terms", f"SELECT doc_id FROM documents WHERE list_has_all({WORDS}, ['thing', 'ther', 'eron'])")
def fts_all_terms(spark, d):
    return ix(spark, d).match_all(TERMS).withColumnRenamed("id", "doc_id")


@register("fts_any_terms", f"SELECT doc_id FROM documents WHERE list_has_any({WORDS}, ['thing', 'ther', 'eron'])")
def fts_any_terms(spark, d):
    return ix(spark, d).match_any(TERMS).withColumnRenamed("id", "doc_id")


@register("fts_prefix", f"SELECT doc_id FROM documents WHERE len(list_filter({WORDS}, lambda x: starts_with(x, 'thingb'))) > 0")
def fts_prefix(spark, d):
    return ix(spark, d).match_prefix("thingb").withColumnRenamed("id", "doc_id")


@register("fts_phrase", f"SELECT doc_id FROM documents WHERE contains({PADDED}, ' of the ')")
def fts_phrase(spark, d):
    return ix(spark, d).match_phrase(["of", "the"]).withColumnRenamed("id", "doc_id")


_NEAR = "WITH a AS (SELECT doc_id, {w} AS w FROM documents), p AS (SELECT doc_id, unnest(range(len(w))) AS pos, unnest(w) AS term FROM a), x AS (SELECT doc_id, pos FROM p WHERE term = '{t0}'), y AS (SELECT doc_id, pos FROM p WHERE term = '{t1}') SELECT DISTINCT x.doc_id FROM x JOIN y ON x.doc_id = y.doc_id AND abs(x.pos - y.pos) <= {gap} + 1"


@register("fts_near", _NEAR.format(w=WORDS, t0="thing", t1="ther", gap=5))
def fts_near(spark, d):
    return ix(spark, d).match_near(["thing", "ther"], 5).withColumnRenamed("id", "doc_id")


@register("fts_field_filter", "SELECT doc_id, 'source' AS field FROM documents WHERE list_contains(regexp_extract_all(lower(source), '[\\p{L}\\p{N}]+'), 'src3')")
def fts_field_filter(spark, d):
    found = fts.Clause("all", ("src3",), field="source").match(docs(spark, d), "doc_id", {"source": "source", "text": "text"})
    return found.select(F.col("id").alias("doc_id"), F.lit("source").alias("field"))


def _cascade_sql():
    lists = {0: f"contains({PADDED}, ' thing ther ')", 1: f"doc_id IN ({_NEAR.format(w=WORDS, t0='thing', t1='ther', gap=5)})", 2: f"list_has_all({WORDS}, ['thing', 'ther'])"}
    parts = [f"SELECT {no} AS list_no, id, row_number() OVER (ORDER BY score DESC, id) AS rank FROM (SELECT b.id, b.score FROM bm25 b JOIN documents ON doc_id = id WHERE {cond} ORDER BY score DESC, id LIMIT 300)" for no, cond in lists.items()]
    return f"WITH {bm25_sql(['thing', 'ther'])}, l AS ({' UNION ALL '.join(parts)}) SELECT id AS doc_id, round(sum(1.0::DOUBLE / (60 + rank)), 6) AS score, CAST(min(list_no) AS INTEGER) AS first_list FROM l GROUP BY id"


@register("fts_mode_cascade", _cascade_sql())
def fts_mode_cascade(spark, d):
    clauses = fts.compile_query("thing ther", "auto")
    fused = rank.fuse(ix(spark, d).cascade(clauses))
    return fused.select(F.col("id").alias("doc_id"), "score", "first_list")


@register("match_time_histogram", f"""
WITH m AS (SELECT doc_id AS o_orderkey FROM documents WHERE list_has_any({WORDS}, ['thing', 'ther', 'eron']))
SELECT CAST(year(o_orderdate) AS INTEGER) AS year, CAST(year(o_orderdate) // 10 * 10 AS BIGINT) AS decade, count(*) AS n, count(DISTINCT o_orderkey) AS n_papers FROM m JOIN orders USING (o_orderkey) GROUP BY ALL""")
def match_time_histogram(spark, d):
    m = ix(spark, d).match_any(TERMS).select(F.col("id").alias("o_orderkey"))
    return fts.time_distribution(m, load(spark, d, "orders"), "o_orderkey", F.year("o_orderdate")).withColumn("decade", F.col("decade").cast("long"))


@register("title_search", """
WITH h AS (SELECT p_partkey, p_name FROM part WHERE contains(lower(p_name), 'ring') AND contains(lower(p_name), 'o')), n AS (SELECT l_partkey, count(*) AS n FROM lineitem GROUP BY 1)
SELECT p_partkey, p_name, coalesce(n, 0) AS n_facts, (SELECT count(*) FROM h) AS total FROM h LEFT JOIN n ON l_partkey = p_partkey ORDER BY n_facts DESC, p_partkey LIMIT 20 OFFSET 5""")
def title_search(spark, d):
    p = load(spark, d, "part").select("p_partkey", "p_name")
    facts = load(spark, d, "lineitem").select(F.col("l_partkey").alias("p_partkey"))
    return fts.title_search(p, "p_name", ["ring", "o"], facts, "p_partkey", [F.desc("n_facts"), F.col("p_partkey")], 20, 5)


@register("snippet_rank", """
SELECT doc_id, source, CAST(contains(lower(text), 'thing') AS INTEGER) + CAST(contains(lower(text), 'ther') AS INTEGER) + CASE WHEN lang = 'en' THEN 1 ELSE 0 END AS score FROM documents WHERE source = 'src5' ORDER BY score DESC, doc_id LIMIT 10""")
def snippet_rank(spark, d):
    own = docs(spark, d).filter("source = 'src5'")
    ranked = fts.snippet_rank(own, "text", ["thing", "ther", "thing"], F.when(F.col("lang") == "en", 1).otherwise(0))
    return ranked.select("doc_id", "source", "score").orderBy(F.desc("score"), "doc_id").limit(10)


@register("scan_search", "SELECT c_custkey FROM customer WHERE contains(lower(c_name || '|' || c_mktsegment), 'machin')")
def scan_search(spark, d):
    return fts.scan_search(load(spark, d, "customer").select("c_custkey", "c_name", "c_mktsegment"), "MACHIN").select("c_custkey")


# --- vectors ---------------------------------------------------------------------------------------

_QV = f"(SELECT embedding FROM embeddings WHERE vec_id = {Q})"
_DOT = "list_dot_product(CAST({a} AS DOUBLE[]), CAST({b} AS DOUBLE[]))"


def emb(spark, d):
    return load(spark, d, "embeddings")


def qvec(spark, d):
    return vectors.query_vector(emb(spark, d), "vec_id", "embedding", Q)


@register("vector_topk", f"SELECT vec_id, round({_DOT.format(a='embedding', b=_QV)}, 6) AS score FROM embeddings WHERE round({_DOT.format(a='embedding', b=_QV)}, 6) >= 0.2 ORDER BY score DESC, vec_id LIMIT 50")
def vector_topk(spark, d):
    return vectors.search(emb(spark, d), "vec_id", "embedding", qvec(spark, d), 50, 0.20).withColumnRenamed("id", "vec_id")


@register("vector_rerank_subset", f"WITH c AS (SELECT doc_id FROM documents WHERE lang = 'en') SELECT vec_id, round({_DOT.format(a='embedding', b=_QV)}, 6) AS score FROM embeddings WHERE vec_id IN (SELECT doc_id FROM c) AND round({_DOT.format(a='embedding', b=_QV)}, 6) >= 0.1 ORDER BY score DESC, vec_id LIMIT 30")
def vector_rerank_subset(spark, d):
    ids = docs(spark, d).filter("lang = 'en'").select(F.col("doc_id").alias("id"))
    return vectors.rerank(emb(spark, d), "vec_id", "embedding", qvec(spark, d), ids, 30, 0.10).withColumnRenamed("id", "vec_id")


_NORM = "sqrt(list_sum([x * x FOR x IN {v}]))"


@register("vector_truncate_topk", f"""
WITH h AS (SELECT vec_id, CAST(embedding[1:16] AS DOUBLE[]) AS v FROM embeddings), t AS (SELECT vec_id, [x / {_NORM.format(v='v')} FOR x IN v] AS v FROM h)
SELECT a.vec_id, round(list_dot_product(a.v, b.v), 6) AS score FROM t a, (SELECT v FROM t WHERE vec_id = {Q}) b WHERE round(list_dot_product(a.v, b.v), 6) >= 0.2 ORDER BY score DESC, a.vec_id LIMIT 50""")
def vector_truncate_topk(spark, d):
    short = emb(spark, d).select("vec_id", vectors.truncated(F.col("embedding"), 16).alias("embedding"))
    return vectors.search(short, "vec_id", "embedding", vectors.query_vector(short, "vec_id", "embedding", Q), 50, 0.20).withColumnRenamed("id", "vec_id")


@register("vector_cosine_prefix", f"""
WITH v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v, CAST(embedding[1:32] AS DOUBLE[]) AS h FROM embeddings), q AS (SELECT h AS q FROM v WHERE vec_id = {Q})
SELECT vec_id, round(list_dot_product(v[1:32], q) / ({_NORM.format(v='v[1:32]')} * {_NORM.format(v='q')}), 6) AS cosine FROM v, q""")
def vector_cosine_prefix(spark, d):
    q = vectors.literal(qvec(spark, d)[:32])
    return emb(spark, d).select("vec_id", F.round(vectors.cosine(F.col("embedding"), q), 6).alias("cosine"))


_CENTROIDS = f"dims AS (SELECT label, unnest(range(64)) AS i, unnest(CAST(embedding AS DOUBLE[])) AS x FROM embeddings), sums AS (SELECT label, i, sum(x) AS x FROM dims GROUP BY ALL), raw AS (SELECT label, list(x ORDER BY i) AS v FROM sums GROUP BY label), cent AS (SELECT label, [x / {_NORM.format(v='v')} FOR x IN v] AS c FROM raw)"


@register("centroid_placement", f"""
WITH {_CENTROIDS}, s AS (SELECT vec_id, cent.label, round(list_dot_product(CAST(embedding AS DOUBLE[]), c), 6) AS score FROM embeddings, cent),
r AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY score DESC, label) AS rn FROM s)
SELECT a.vec_id, a.label AS best, a.score, b.label AS runner_up, round(a.score - b.score, 6) AS margin, CASE WHEN a.score >= 0.55 THEN 'attach' WHEN a.score <= 0.42 THEN 'exception' ELSE 'gray' END AS decision FROM r a JOIN r b ON a.vec_id = b.vec_id AND a.rn = 1 AND b.rn = 2""")
def centroid_placement(spark, d):
    e = emb(spark, d)
    return vectors.place(e, "vec_id", "embedding", vectors.centroids(e, "label", "embedding")).withColumnRenamed("id", "vec_id")


@register("similar_papers", f"""
WITH h AS (SELECT vec_id, round({_DOT.format(a='embedding', b=_QV)}, 6) AS score FROM embeddings WHERE round({_DOT.format(a='embedding', b=_QV)}, 6) >= 0 ORDER BY score DESC, vec_id LIMIT 120), r AS (SELECT vec_id, row_number() OVER (ORDER BY score DESC, vec_id) AS rank FROM h)
SELECT source AS paper, CAST(min(rank) AS INTEGER) AS best_rank FROM r JOIN documents ON doc_id = vec_id WHERE source <> (SELECT source FROM documents WHERE doc_id = {Q}) GROUP BY 1 ORDER BY best_rank LIMIT 10""")
def similar_papers(spark, d):
    hits = rank.ranked(vectors.search(emb(spark, d), "vec_id", "embedding", qvec(spark, d), 120, 0.0), F.desc("score"), F.col("id")).select("id", "rank")
    papers = docs(spark, d).select(F.col("doc_id").alias("id"), F.col("source").alias("paper"))
    own = papers.filter(F.col("id") == Q).select("paper")
    return vectors.similar_papers(hits, papers.join(F.broadcast(own), "paper", "left_anti"), 10)  # own: one row


@register("branch_routing", f"""
WITH {_CENTROIDS} SELECT label, round({_DOT.format(a='c', b=_QV)} + CASE WHEN label IN (1, 2) THEN 0.15 ELSE 0 END, 6) AS score FROM cent ORDER BY score DESC, label LIMIT 8""")
def branch_routing(spark, d):
    c = vectors.centroids(emb(spark, d), "label", "embedding")
    return vectors.route(c, qvec(spark, d), F.col("label").isin(1, 2)).select("label", "score")


@register("branch_search", f"""
WITH {_CENTROIDS}, r AS (SELECT label, round({_DOT.format(a='c', b=_QV)}, 6) AS score FROM cent ORDER BY score DESC, label LIMIT 3), h AS (SELECT label FROM (SELECT vec_id, label, round({_DOT.format(a='embedding', b=_QV)}, 6) AS s FROM embeddings) WHERE s >= 0.2 ORDER BY s DESC, vec_id LIMIT 40), n AS (SELECT label, count(*) AS n_hits FROM h GROUP BY 1)
SELECT coalesce(r.label, n.label) AS label, score, coalesce(n_hits, 0) AS n_hits FROM r FULL JOIN n ON r.label = n.label""")
def branch_search(spark, d):
    e, q = emb(spark, d), qvec(spark, d)
    routed = vectors.route(vectors.centroids(e, "label", "embedding"), q, F.lit(False), k=3)
    hits = vectors.search(e, "vec_id", "embedding", q, 40, 0.20).join(e.select(F.col("vec_id").alias("id"), "label"), "id")
    return vectors.routed_or_hit(routed, hits)


@register("query_placement", f"""
WITH p AS (SELECT vec_id % 50 AS doc, label, {_DOT.format(a='embedding', b=_QV)} + CASE WHEN label % 2 = 0 THEN 0.05 ELSE 0 END AS s FROM embeddings), r AS (SELECT *, row_number() OVER (PARTITION BY doc ORDER BY s DESC, label) AS rn FROM p)
SELECT doc, label, round(s, 6) AS score FROM r WHERE rn = 1""")
def query_placement(spark, d):
    q = vectors.literal(qvec(spark, d))
    places = emb(spark, d).select((F.col("vec_id") % 50).alias("doc"), "label", vectors.dot(F.col("embedding"), q).alias("sim"))
    return vectors.best_placement(places, F.col("label") % 2 == 0)


@register("pair_scorer_rerank", f"""
WITH {bm25_sql(TERMS)}, t AS (SELECT id, score FROM bm25 ORDER BY score DESC, id LIMIT 50)
SELECT doc_id, round(len(list_intersect({WORDS}, ['thing', 'ther', 'eron'])) / 3.0::DOUBLE, 6) AS pair_score, score FROM t JOIN documents ON doc_id = id ORDER BY pair_score DESC, score DESC, doc_id LIMIT 20""")
def pair_scorer_rerank(spark, d):
    best = fts.top(ix(spark, d).bm25(TERMS), 50, "id").withColumnRenamed("id", "doc_id")
    pairs = docs(spark, d).join(F.broadcast(best), "doc_id")  # fifty rows
    return pairs.select("doc_id", F.round(vectors.token_overlap_score(TERMS, tokens(F.col("text"))), 6).alias("pair_score"), "score").orderBy(F.desc("pair_score"), F.desc("score"), "doc_id").limit(20)


@register("vector_similar_pairs", f"SELECT a.vec_id AS a, b.vec_id AS b, round({_DOT.format(a='a.embedding', b='b.embedding')}, 6) AS score FROM embeddings a JOIN embeddings b ON a.label = b.label AND a.vec_id < b.vec_id WHERE round({_DOT.format(a='a.embedding', b='b.embedding')}, 6) >= 0.3")
def vector_similar_pairs(spark, d):
    return vectors.similar_pairs(emb(spark, d), "vec_id", "embedding", "label", 0.3)


@register("vector_alignment", "SELECT vec_id, row_number() OVER (ORDER BY vec_id) - 1 AS row FROM embeddings WHERE vec_id IN (SELECT doc_id FROM documents WHERE lang = 'de')")
def vector_alignment(spark, d):
    ids = emb(spark, d).select("vec_id").join(docs(spark, d).filter("lang = 'de'").select(F.col("doc_id").alias("vec_id")), "vec_id", "left_semi")
    return vectors.numbered(ids, "vec_id").withColumn("row", F.col("row").cast("long"))


# --- ranking -----------------------------------------------------------------------------------------

_CITES = "cites AS (SELECT source, count(*) FILTER (n_chars > 1500) AS c FROM documents GROUP BY source)"


def cites(spark, d):
    return docs(spark, d).groupBy(F.col("source").alias("paper")).agg(F.count(F.when(F.col("n_chars") > 1500, 1)).alias("c"))


def corpus(spark, d):
    return search.Corpus(docs(spark, d), cites=cites(spark, d), vectors=emb(spark, d), index=ix(spark, d))


def full_corpus(spark, d):
    """With a taxonomy (language / source) and authors (nations by key) in the roles that the tables lack."""
    c = corpus(spark, d)
    path = F.array("lang", "source")
    prefixes = F.transform(F.sequence(F.lit(1), F.lit(2)), lambda k: F.array_join(F.slice(path, F.lit(1), k), "/"))
    c.members = docs(spark, d).select(F.col("doc_id").alias("id"), F.lit(2).alias("depth"), F.explode(prefixes).alias("prefix"))
    by_key = load(spark, d, "nation").groupBy(F.concat(F.lit("src"), (F.col("n_nationkey") % 20).cast("string")).alias("paper")).agg(F.collect_list("n_name").alias("authors"))
    c.authors = by_key.join(c.cites, "paper").withColumnRenamed("c", "cites")
    return c


def asked(spark):
    nodes = spark.createDataFrame([("en", 1.0), ("de/src3", 1.5)], "path string, match double")
    return search.Asked(nodes=nodes, author="an", title="text", synonyms={"ther": ["the"]})


_GUIDED_SQL = (
    ", ".join(f"g{i} AS (SELECT DISTINCT {i} AS q, source FROM documents WHERE list_contains({WORDS}, '{t}'))" for i, t in enumerate(TERMS))
    + ", gp AS (SELECT source, round(count(*) * count(*) * ln(2 + any_value(c)), 6) AS p FROM (" + " UNION ALL ".join(f"SELECT * FROM g{i}" for i in range(len(TERMS))) + ") g JOIN cites USING (source) GROUP BY source ORDER BY p DESC, source LIMIT 60)"
)


def _of_papers(papers, alias):
    """The best claim by text of each paper (source, p)."""
    return f"{alias} AS (SELECT id, p, source FROM (SELECT b.id, b.score, source, p, row_number() OVER (PARTITION BY source ORDER BY b.score DESC, b.id) AS rn FROM bm25 b JOIN documents ON doc_id = b.id JOIN {papers} USING (source)) WHERE rn = 1)"


_LISTS = f"""{bm25_sql(TERMS)}, {_CITES},
tx AS (SELECT id, score FROM bm25 ORDER BY score DESC, id LIMIT 200), vc AS (SELECT vec_id AS id, round({_DOT.format(a='embedding', b=_QV)}, 6) AS score FROM embeddings WHERE round({_DOT.format(a='embedding', b=_QV)}, 6) >= 0.2 ORDER BY score DESC, vec_id LIMIT 200),
au AS (SELECT id, c, score FROM bm25 JOIN documents ON doc_id = id JOIN cites USING (source) ORDER BY c DESC, score DESC, id LIMIT 200),
{_GUIDED_SQL}, {_of_papers("gp", "gd")},
lists AS (SELECT 0 AS list_no, id, row_number() OVER (ORDER BY score DESC, id) AS rank FROM tx UNION ALL SELECT 1, id, row_number() OVER (ORDER BY score DESC, id) FROM vc UNION ALL SELECT 2, id, row_number() OVER (ORDER BY c DESC, score DESC, id) FROM au
UNION ALL SELECT 6, id, row_number() OVER (ORDER BY p DESC, source, id) FROM gd),
fused AS (SELECT id, round(sum(1.0::DOUBLE / (60 + rank)), 6) AS score FROM lists GROUP BY id)"""


def _hybrid_sql(alpha="1", kind="true", limit=20, offset=0, on=("text", "vector", "authority", "guided"), lists=_LISTS, rerank=False):
    for name, alias in (("text", "tx"), ("vector", "vc"), ("authority", "au"), ("guided", "gd")):
        if name not in on:
            lists = lists.replace(f"FROM {alias}", f"FROM {alias} WHERE false")
    simmed = f"sm AS (SELECT f.id, f.score + 0.05::DOUBLE * greatest(coalesce({_DOT.format(a='embedding', b=_QV)}, 0), 0) AS score FROM fused f LEFT JOIN embeddings ON vec_id = f.id)" if "vector" in on else "sm AS (SELECT * FROM fused)"
    return f"""WITH {lists}, {simmed},
h AS (SELECT doc_id AS id, source AS paper, lang AS kind, round(sm.score, 6) AS s, CAST(c AS DOUBLE) AS c FROM sm JOIN documents ON doc_id = sm.id JOIN cites USING (source)),
b AS (SELECT id, paper, kind, round(CASE WHEN c > 0 THEN s * (1 + {alpha} * ln(1 + c) / ln(2 + (SELECT max(c) FROM h))) ELSE s END, 6) AS score FROM h),
n AS (SELECT *, row_number() OVER (ORDER BY score DESC, id) AS _r FROM b), r AS (SELECT n.id, paper, kind, CASE WHEN _r <= 50 THEN round(score + len(list_intersect({WORDS}, ['thing', 'ther', 'eron'])) / 3.0::DOUBLE, 6) ELSE score END AS score FROM n JOIN documents ON doc_id = n.id),
k AS (SELECT * FROM {"r" if rerank else "b"} WHERE {kind}), p AS (SELECT *, row_number() OVER (ORDER BY score DESC, id) AS position FROM k), o AS (SELECT *, row_number() OVER (PARTITION BY paper ORDER BY position) AS rn FROM p)
SELECT CAST(row_number() OVER (ORDER BY CAST(rn > 1 AS INTEGER), position) AS INTEGER) AS place, id, paper, kind, score, count(*) OVER () AS total FROM o ORDER BY place LIMIT {limit} OFFSET {offset}"""


@register("hybrid_search", _hybrid_sql())
def hybrid_search(spark, d):
    return search.search(corpus(spark, d), TERMS, qvec(spark, d))


@register("hybrid_search_page", _hybrid_sql(kind="kind = 'en'", limit=10, offset=10))
def hybrid_search_page(spark, d):
    return search.search(corpus(spark, d), TERMS, qvec(spark, d), search.Knobs(limit=10, offset=10), kind="en")


@register("hybrid_search_no_vectors", _hybrid_sql(on=("text", "authority")))
def hybrid_search_no_vectors(spark, d):
    """Channel ablation: the vector channel is off."""
    return search.search(corpus(spark, d), TERMS, None, search.Knobs(on={"text": True, "authority": True}))


_FEEDBACK = f"""
fs AS (SELECT id FROM bm25 ORDER BY score DESC, id LIMIT 30), ft AS (SELECT unnest(list_distinct({WORDS})) AS term FROM documents JOIN fs ON doc_id = id),
fn AS (SELECT term, count(*) AS n FROM ft WHERE length(term) > 3 AND term NOT IN ('thing', 'ther', 'eron') GROUP BY 1 HAVING count(*) >= 2),
fm AS (SELECT term FROM fn ORDER BY round(n * CASE WHEN length(term) <= 6 THEN 1.5::DOUBLE ELSE 1 END, 6) DESC, term LIMIT 8),
fp AS (SELECT doc_id AS id, len({WORDS}) AS dl, unnest({WORDS}) AS term FROM documents), fq AS (SELECT id, dl, term, count(*) AS tf FROM fp JOIN fm USING (term) GROUP BY ALL), fd AS (SELECT term, count(*) AS df FROM fq GROUP BY 1),
fb AS (SELECT id, round(sum(ln(1 + (n - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE)) * tf * 2.2::DOUBLE / (tf + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * dl / avgdl))), 6) AS score FROM fq JOIN fd USING (term), bm25_s GROUP BY id),
fx AS (SELECT id, score FROM fb ORDER BY score DESC, id LIMIT 200),
lists AS (SELECT 3 AS list_no, id, row_number() OVER (ORDER BY score DESC, id) AS rank FROM fx UNION ALL """
_WITH_FEEDBACK = _LISTS.replace("lists AS (", _FEEDBACK.strip() + " ")

_TITLED = "papers AS (SELECT source AS id, min(text) AS text FROM documents GROUP BY source)"


def _paper_recall_sql(terms, k, synonyms):
    """CTEs ending in rp (source, p)."""
    crossed = [[x, core] for w in terms for x in synonyms.get(w, []) for core in terms if core not in (w, x)]
    pairs = [*([a, b] for i, a in enumerate(terms) for b in terms[i + 1 :]), *crossed]
    held = lambda t: f"list_has_all({WORDS}, [{', '.join(repr(x) for x in t)}])"
    near = " AND ".join(f"list_contains(w[greatest(i - {10 + len(terms) - 1}, 1):i], '{t}')" for t in terms)
    ctes = [_TITLED, bm25_sql(terms, "pb", table="papers", key="id"), "pc AS (SELECT id, score, c FROM pb JOIN cites ON source = id)", f"pn AS (SELECT DISTINCT id FROM (SELECT id, w, unnest(range(1, len(w) + 1)) AS i FROM pb_w) WHERE {near})"]
    best = lambda no, frm, where: f"SELECT {no} AS list_no, id, row_number() OVER (ORDER BY score DESC, id) AS rank FROM (SELECT x.id, x.score FROM {frm} x JOIN papers p ON p.id = x.id WHERE {where} ORDER BY x.score DESC, x.id LIMIT 60)"
    lists = [best(0, "pb", "true"), best(1, "pb", "true"), best(2, "pb", held(terms)), best(3, "pb", "x.id IN (SELECT id FROM pn)")]
    lists += [f"SELECT {no}, id, row_number() OVER (ORDER BY c DESC, id) FROM (SELECT * FROM pc ORDER BY c DESC, id LIMIT 60)" for no in (4, 5)]
    for i, pair in enumerate(pairs):
        ctes.append(bm25_sql(pair, f"pp{i}", table="papers", key="id"))
        lists.append(best(6 + i, f"pp{i}", held(pair)))
    ctes += [f"pl AS ({' UNION ALL '.join(lists)})", "pf AS (SELECT id, round(sum(1.0::DOUBLE / (10 + rank)), 6) AS score FROM pl GROUP BY id)", "pz AS (SELECT id, score, CAST(coalesce(c, 0) AS DOUBLE) AS c FROM pf LEFT JOIN cites ON source = id)"]
    ctes.append(f"rp AS (SELECT id AS source, round(CASE WHEN c > 0 THEN score * (1 + 3 * ln(1 + c) / ln(2 + (SELECT max(c) FROM pz))) ELSE score END, 6) AS p FROM pz ORDER BY p DESC, source LIMIT {k})")
    return ", ".join(ctes)


_FULL = _LISTS.replace("lists AS (", f"""tn(path, match) AS (VALUES ('en', 1.0::DOUBLE), ('de/src3', 1.5::DOUBLE)), tm AS (SELECT doc_id AS id, unnest([lang, lang || '/' || source]) AS prefix FROM documents),
tr AS (SELECT id, round(max(match / (1 + 0.3::DOUBLE * (2 - len(string_split(path, '/'))))), 6) AS score FROM tm JOIN tn ON prefix = path GROUP BY id ORDER BY score DESC, id LIMIT 200),
{_paper_recall_sql(TERMS, 60, {'ther': ['the']})}, {_of_papers('rp', 'pr')},
an AS (SELECT paper, c AS cites FROM (SELECT 'src' || (n_nationkey % 20) AS paper, bool_or(contains(lower(n_name), 'an')) AS hit FROM nation GROUP BY 1) JOIN cites ON source = paper WHERE hit),
ar AS (SELECT id, cites, paper, rn FROM (SELECT doc_id AS id, cites, paper, row_number() OVER (PARTITION BY paper ORDER BY doc_id) AS rn FROM documents JOIN an ON source = paper) WHERE rn <= 3 ORDER BY cites DESC, paper, rn LIMIT 60),
lists AS (SELECT 4 AS list_no, id, row_number() OVER (ORDER BY score DESC, id) AS rank FROM tr UNION ALL SELECT 5, id, row_number() OVER (ORDER BY p DESC, source, id) FROM pr
UNION ALL SELECT 7, id, row_number() OVER (ORDER BY cites DESC, paper, rn) FROM ar UNION ALL SELECT 8, id, row_number() OVER (ORDER BY cites DESC, paper, rn) FROM ar UNION ALL """)


@register("hybrid_search_full", _hybrid_sql(lists=_FULL))
def hybrid_search_full(spark, d):
    """Every channel: text, vectors, authority, taxonomy, papers, claim-guided papers, and the author twice."""
    return search.search(full_corpus(spark, d), TERMS, qvec(spark, d), asked=asked(spark))


@register("hybrid_search_cached", _hybrid_sql(lists=_FULL))
def hybrid_search_cached(spark, d):
    """The second answer comes from the result cache."""
    cache = search.ResultCache()
    c, q = full_corpus(spark, d), qvec(spark, d)
    for _ in range(2):
        found = cache.get(spark, (d, *TERMS), lambda: search.search(c, TERMS, q, asked=asked(spark)))
    return found


@register("channel_profile", f"WITH {_FULL} SELECT CASE list_no WHEN 0 THEN 'text' WHEN 1 THEN 'vector' WHEN 2 THEN 'authority' WHEN 4 THEN 'tree' WHEN 5 THEN 'paper' WHEN 6 THEN 'guided' ELSE 'author' END AS channel, count(*) AS n, true AS timed FROM lists GROUP BY 1")
def channel_profile(spark, d):
    """What each channel finds by itself, and that it was timed."""
    rows = search.profile(full_corpus(spark, d), TERMS, qvec(spark, d), asked=asked(spark))
    return spark.createDataFrame([(r["channel"], r["n"], r["seconds"] > 0) for r in rows if r["n"]], "channel string, n bigint, timed boolean")


@register("hybrid_search_feedback", _hybrid_sql(lists=_WITH_FEEDBACK, rerank=True))
def hybrid_search_feedback(spark, d):
    """With feedback terms and the pair scorer; its feedback terms come from the text channel at run time."""
    return search.search(corpus(spark, d), TERMS, qvec(spark, d), search.Knobs(on=search.Knobs().on | {"feedback": True, "rerank": True}))


@register("channel_pools", f"WITH {_LISTS} SELECT CAST(list_no AS INTEGER) AS list_no, count(*) AS n, CAST(sum(id) AS BIGINT) AS id_sum FROM lists GROUP BY list_no")
def channel_pools(spark, d):
    """What each channel found: the trace of a search."""
    pools = search.channels(corpus(spark, d), TERMS, qvec(spark, d), search.Knobs())
    return pools.groupBy("list_no").agg(F.count("*").alias("n"), F.sum("id").alias("id_sum"))


@register("rrf_fusion", f"WITH {_LISTS} SELECT id, round(sum(1.0::DOUBLE / (60 + rank)), 6) AS score, CAST(min(list_no) AS INTEGER) AS first_list, CAST(min(rank) AS INTEGER) AS first_rank FROM lists GROUP BY id")
def rrf_fusion(spark, d):
    return rank.fuse(search.channels(corpus(spark, d), TERMS, qvec(spark, d), search.Knobs()))


@register("citation_boost", f"WITH {bm25_sql(TERMS)}, {_CITES}, h AS (SELECT id, score, CAST(c AS DOUBLE) AS c FROM bm25 JOIN documents ON doc_id = id JOIN cites USING (source)) SELECT id, round(CASE WHEN c > 0 THEN score * (1 + 3 * ln(1 + c) / ln(2 + (SELECT max(c) FROM h))) ELSE score END, 6) AS score FROM h")
def citation_boost(spark, d):
    own = ix(spark, d).bm25(TERMS).join(docs(spark, d).select(F.col("doc_id").alias("id"), F.col("source").alias("paper")), "id").join(cites(spark, d), "paper")
    return rank.citation_boost(own, F.col("c"), 3.0).select("id", "score")


@register("multi_signal_score", f"""
WITH {bm25_sql(TERMS)}, {_CITES}, h AS (SELECT id, score AS b, CAST(c AS DOUBLE) AS c, lang, n_chars FROM bm25 JOIN documents ON doc_id = id JOIN cites USING (source)), e AS (SELECT min(b) AS lo, max(b) AS hi, max(c) AS m FROM h)
SELECT id, round(0.5::DOUBLE * (b - lo) / CASE WHEN hi > lo THEN hi - lo ELSE 1 END + 0.25::DOUBLE * ln(1 + c) / ln(2 + m) + 0.15::DOUBLE * CASE lang WHEN 'en' THEN 1.0 WHEN 'de' THEN 0.7 WHEN 'fr' THEN 0.4 ELSE 0.5 END + 0.1::DOUBLE * CASE WHEN n_chars > 2000 THEN 1.0 ELSE 0.5 END, 6) AS score FROM h, e""")
def multi_signal_score(spark, d):
    facts = docs(spark, d).select(F.col("doc_id").alias("id"), F.col("source").alias("paper"), "lang", "n_chars")
    own = ix(spark, d).bm25(TERMS).join(facts, "id").join(cites(spark, d), "paper")
    conf = F.when(F.col("lang") == "en", "high").when(F.col("lang") == "de", "medium").when(F.col("lang") == "fr", "low").otherwise("none")
    return rank.multi_signal(own, F.col("score"), F.col("c"), conf, F.col("n_chars") > 2000).select("id", "score")


@register("cap_per_source", f"WITH {bm25_sql(TERMS)}, t AS (SELECT id, score FROM bm25 ORDER BY score DESC, id LIMIT 100), p AS (SELECT id, source, row_number() OVER (ORDER BY score DESC, id) AS position FROM t JOIN documents ON doc_id = id), o AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY position) AS rn FROM p) SELECT id, source, CAST(position AS INTEGER) AS position, CAST(row_number() OVER (ORDER BY CAST(rn > 1 AS INTEGER), position) AS INTEGER) AS place FROM o")
def cap_per_source(spark, d):
    best = fts.top(ix(spark, d).bm25(TERMS), 100, "id").join(docs(spark, d).select(F.col("doc_id").alias("id"), "source"), "id")
    return rank.cap_stable(rank.ranked(best, F.desc("score"), F.col("id"), name="position"), "source", "position").select("id", "source", "position", "place")


@register("paper_breadth_score", f"""
WITH {_CITES}, m AS (SELECT 0 AS q, source FROM documents WHERE list_contains({WORDS}, 'thingble') UNION ALL SELECT 1, source FROM documents WHERE list_contains({WORDS}, 'therea') UNION ALL SELECT 2, source FROM documents WHERE list_contains({WORDS}, 'eronth')), n AS (SELECT source, count(DISTINCT q) AS n_queries FROM m GROUP BY 1)
SELECT source AS paper, n_queries, c, round(n_queries * n_queries * ln(2 + c), 6) AS score FROM n JOIN cites USING (source) ORDER BY score DESC, source LIMIT 30""")
def paper_breadth_score(spark, d):
    out = None
    for i, t in enumerate(("thingble", "therea", "eronth")):
        one = docs(spark, d).filter(F.array_contains(tokens(F.col("text")), t)).select(F.lit(i).alias("query_no"), F.col("source").alias("paper"))
        out = one if out is None else out.union(one)
    return rank.breadth(out, cites(spark, d), 30).select("paper", "n_queries", "c", "score")


@register("paper_recall", f"WITH {_CITES}, {_paper_recall_sql(TERMS, 60, {'ther': ['the']})} SELECT source AS paper, p AS score FROM rp")
def paper_recall(spark, d):
    return search.paper_recall(corpus(spark, d), "text", TERMS, 60, synonyms={"ther": ["the"]})


@register("tree_recall", """
WITH m AS (SELECT p_partkey AS id, [p_type, p_brand, p_name] AS s FROM part), x AS (SELECT id, k AS depth, array_to_string(s[1:k], '/') AS prefix FROM (SELECT *, unnest([1, 2, 3]) AS k FROM m)), n(path, match) AS (VALUES ('ECONOMY', 1.0::DOUBLE), ('ECONOMY/Brand#2', 1.5::DOUBLE), ('SMALL', 0.7::DOUBLE)),
d AS (SELECT id, 3 AS full_depth, prefix FROM x)
SELECT id, round(max(match / (1 + 0.3::DOUBLE * (3 - len(string_split(path, '/'))))), 6) AS score FROM d JOIN n ON prefix = path GROUP BY id ORDER BY score DESC, id LIMIT 200""")
def tree_recall(spark, d):
    p = load(spark, d, "part").select(F.col("p_partkey").alias("id"), F.array("p_type", "p_brand", "p_name").alias("s"))
    members = p.select("id", F.lit(3).alias("depth"), F.explode(F.transform(F.sequence(F.lit(1), F.lit(3)), lambda k: F.array_join(F.slice("s", F.lit(1), k), "/"))).alias("prefix"))
    nodes = spark.createDataFrame([("ECONOMY", 1.0), ("ECONOMY/Brand#2", 1.5), ("SMALL", 0.7)], "path string, match double")
    return search.tree_recall(nodes, members, 200)


@register("author_recall", """
WITH a AS (SELECT l_orderkey, list(DISTINCT 'supplier ' || l_suppkey) AS authors, count(*) AS cites FROM lineitem GROUP BY 1), h AS (SELECT l_orderkey, cites FROM a WHERE len(list_filter(authors, lambda x: contains(x, 'supplier 7'))) > 0),
c AS (SELECT DISTINCT l_orderkey, l_partkey FROM lineitem), r AS (SELECT c.l_orderkey, l_partkey, cites, row_number() OVER (PARTITION BY c.l_orderkey ORDER BY l_partkey) AS rn FROM c JOIN h ON c.l_orderkey = h.l_orderkey)
SELECT l_orderkey, l_partkey, cites, CAST(rn AS INTEGER) AS rn FROM r WHERE rn <= 3 ORDER BY cites DESC, l_orderkey, rn LIMIT 60""")
def author_recall(spark, d):
    li = load(spark, d, "lineitem").select("l_orderkey", "l_suppkey", "l_partkey")
    papers = li.groupBy("l_orderkey").agg(F.collect_set(F.concat(F.lit("supplier "), F.col("l_suppkey").cast("string"))).alias("authors"), F.count("*").alias("cites"))
    return search.author_recall(papers, li.select("l_orderkey", "l_partkey").distinct(), "Supplier 7", "l_orderkey", 3, [F.col("l_partkey")], 60).select("l_orderkey", "l_partkey", "cites", "rn")


@register("prf_terms", f"""
WITH {bm25_sql(TERMS)}, s AS (SELECT id FROM bm25 ORDER BY score DESC, id LIMIT 30), t AS (SELECT unnest(list_distinct({WORDS})) AS term FROM documents JOIN s ON doc_id = id), n AS (SELECT term, count(*) AS n FROM t WHERE length(term) > 3 AND term NOT IN ('thing', 'ther', 'eron') GROUP BY 1 HAVING count(*) >= 2)
SELECT term, n, round(n * CASE WHEN length(term) <= 6 THEN 1.5::DOUBLE ELSE 1 END, 6) AS weight FROM n ORDER BY weight DESC, term LIMIT 20""")
def prf_terms(spark, d):
    seeds = fts.top(ix(spark, d).bm25(TERMS), 30, "id")
    return search.feedback_terms(corpus(spark, d), seeds, TERMS)


_MANY = [["thing"], ["ther", "eron"], ["thed", "erin"]]


@register("prf_named_terms", f"""
WITH {bm25_sql(TERMS)}, s AS (SELECT id FROM bm25 ORDER BY score DESC, id LIMIT 30), t AS (SELECT unnest(list_distinct({WORDS})) AS term FROM documents JOIN s ON doc_id = id), n AS (SELECT term, count(*) AS n FROM t WHERE length(term) > 3 AND term NOT IN ('thing', 'ther', 'eron') GROUP BY 1 HAVING count(*) >= 2)
SELECT term, n, round(n * CASE WHEN term IN ('that', 'there', 'erth') THEN 4::DOUBLE WHEN length(term) <= 6 THEN 1.5::DOUBLE ELSE 1 END, 6) AS weight FROM n ORDER BY weight DESC, term LIMIT 20""")
def prf_named_terms(spark, d):
    """Feedback in which named terms weigh four times."""
    seeds = fts.top(ix(spark, d).bm25(TERMS), 30, "id")
    return search.feedback_terms(corpus(spark, d), seeds, TERMS, names=["that", "there", "erth"])


@register("multi_query_search", f"""
WITH {', '.join(bm25_sql(t, f'mq{i}') for i, t in enumerate(_MANY))}, l AS ({' UNION ALL '.join(f"SELECT {i} AS list_no, id, row_number() OVER (ORDER BY score DESC, id) AS rank FROM (SELECT id, score FROM mq{i} ORDER BY score DESC, id LIMIT 200)" for i in range(3))}),
f AS (SELECT id, round(sum(1.0::DOUBLE / (60 + rank)), 6) AS score FROM l GROUP BY id), p AS (SELECT id, source AS paper, score, row_number() OVER (ORDER BY score DESC, id DESC) AS position FROM f JOIN documents ON doc_id = id), o AS (SELECT *, row_number() OVER (PARTITION BY paper ORDER BY position) AS rn FROM p)
SELECT CAST(row_number() OVER (ORDER BY CAST(rn > 1 AS INTEGER), position) AS INTEGER) AS place, id, paper, score FROM o ORDER BY place LIMIT 20""")
def multi_query_search(spark, d):
    """Several queries in one job."""
    return search.search_many(corpus(spark, d), _MANY)


_T100 = f"{bm25_sql(TERMS)}, t AS (SELECT id, score FROM bm25 ORDER BY score DESC, id LIMIT 100), f AS (SELECT id, score, source, lang, text, n_chars FROM t JOIN documents ON doc_id = id)"


def top100(spark, d):
    best = fts.top(ix(spark, d).bm25(TERMS), 100, "id")
    return docs(spark, d).withColumnRenamed("doc_id", "id").join(F.broadcast(best), "id")  # a hundred rows


@register("diversity_injection", f"""
WITH {_T100}, h AS (SELECT id, source, score FROM f WHERE source IN ('src1', 'src2', 'src3')), m AS (SELECT coalesce(max(score), 0) AS s FROM (SELECT score FROM h ORDER BY score DESC, id LIMIT 1 OFFSET 1)),
b AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY score DESC, id) AS rn FROM f WHERE source NOT IN (SELECT source FROM h)), c AS (SELECT id, source, score FROM b WHERE rn = 1 ORDER BY score DESC, id LIMIT 15)
SELECT id, source, score, false AS injected FROM h UNION ALL SELECT id, source, s, true FROM c, m""")
def diversity_injection(spark, d):
    f = top100(spark, d).select("id", "source", "score")
    return rank.inject(f.filter(F.col("source").isin("src1", "src2", "src3")), f, "source", 4)


@register("two_pass_filter", f"WITH {_T100} SELECT id, lang FROM f WHERE CASE WHEN (SELECT count(*) FROM f WHERE lang = 'xx') > 0 THEN lang = 'xx' ELSE lang = 'en' END")
def two_pass_filter(spark, d):
    return rank.strict_or_loose(top100(spark, d), F.col("lang") == "xx", F.col("lang") == "en").select("id", "lang")


@register("noise_filter", f"WITH {_T100} SELECT id FROM f WHERE NOT contains(lower(text), 'thingth') AND NOT contains(lower(text), 'license')")
def noise_filter(spark, d):
    return rank.without_markers(top100(spark, d), F.col("text"), ["thingth", "License"]).select("id")


@register("date_sorted_page", f"WITH {_T100}, y AS (SELECT id, score, CASE WHEN id % 5 = 0 THEN NULL ELSE CAST(year(o_orderdate) AS INTEGER) END AS year FROM f LEFT JOIN orders ON o_orderkey = id) SELECT id, year, score, (SELECT count(*) FROM y) AS total FROM y ORDER BY year DESC NULLS LAST, score DESC, id LIMIT 20 OFFSET 20")
def date_sorted_page(spark, d):
    y = load(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.year("o_orderdate").alias("y"))
    dated = top100(spark, d).select("id", "score").join(y, "id", "left").select("id", F.when(F.col("id") % 5 != 0, F.col("y")).alias("year"), "score")
    return rank.page(dated, rank.by_date("year", "score", "id"), 20, 20)


@register("enriched_hits", f"WITH {_T100}, s AS (SELECT source, count(*) AS n_docs, min(doc_id) AS first_doc FROM documents GROUP BY 1) SELECT id, source, score, n_docs, first_doc FROM f LEFT JOIN s USING (source)")
def enriched_hits(spark, d):
    s = docs(spark, d).groupBy("source").agg(F.count("*").alias("n_docs"), F.min("doc_id").alias("first_doc"))
    return rank.enrich(top100(spark, d).select("id", "source", "score"), s, "source", ["n_docs", "first_doc"]).select("id", "source", "score", "n_docs", "first_doc")


@register("evidence_pool", f"WITH {_T100}, p AS (SELECT id, source, row_number() OVER (ORDER BY score DESC, id) AS position FROM f), o AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY position) AS rn FROM p) SELECT id, source, CAST(position AS INTEGER) AS position FROM o ORDER BY CAST(rn > 2 AS INTEGER), position LIMIT 40")
def evidence_pool(spark, d):
    p = rank.ranked(top100(spark, d).select("id", "source", "score"), F.desc("score"), F.col("id"), name="position")
    return search.evidence_pool(p, "source", "position", 2, 40).select("id", "source", "position")


@register("channel_switches", f"WITH {_LISTS} SELECT CASE list_no WHEN 0 THEN 'text' ELSE 'vector' END AS channel, count(*) AS n FROM lists WHERE list_no < 2 GROUP BY 1")
def channel_switches(spark, d):
    names = F.when(F.col("list_no") == 0, "text").when(F.col("list_no") == 1, "vector").otherwise("authority")
    lists = search.channels(corpus(spark, d), TERMS, qvec(spark, d), search.Knobs()).withColumn("channel", names)
    return rank.normalised_channels(lists, {"text": True, "vector": True, "authority": False}).groupBy("channel").agg(F.count("*").alias("n"))
