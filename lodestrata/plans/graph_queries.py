"""Named queries of graph operators. Papers are orders, authors suppliers; typed edges go from parts to suppliers."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestrata.operators import graph as G
from lodestrata.plans.registry import register
from lodestrata.tables import load

_E = "e AS (SELECT DISTINCT 'p' || l_partkey AS src, 's' || l_suppkey AS dst, l_returnflag AS kind FROM lineitem)"
_HITS = "h AS (SELECT 'p' || p_partkey AS node FROM part WHERE p_partkey <= 40 UNION SELECT 's' || s_suppkey FROM supplier WHERE s_suppkey <= 30)"
_U = "u AS (SELECT DISTINCT src, dst FROM (SELECT src, dst FROM e UNION ALL SELECT dst, src FROM e))"


def li(spark, d):
    return load(spark, d, "lineitem")


def edges(spark, d):
    return li(spark, d).select(F.concat(F.lit("p"), F.col("l_partkey").cast("string")).alias("src"), F.concat(F.lit("s"), F.col("l_suppkey").cast("string")).alias("dst"), F.col("l_returnflag").alias("kind")).distinct()


def hits(spark, d):
    p = load(spark, d, "part").filter("p_partkey <= 40").select(F.concat(F.lit("p"), F.col("p_partkey").cast("string")).alias("node"))
    return p.union(load(spark, d, "supplier").filter("s_suppkey <= 30").select(F.concat(F.lit("s"), F.col("s_suppkey").cast("string"))))


@register("edge_browse", f"WITH {_E} SELECT src, dst, kind FROM e WHERE dst = 's7' AND kind = 'R'")
def edge_browse(spark, d):
    return G.browse(edges(spark, d), dst="s7", kind="R", src=None)


@register("ego_depth2", f"WITH {_E}, {_U}, h1 AS (SELECT DISTINCT dst AS node FROM u WHERE src = 'p5'), h2 AS (SELECT DISTINCT dst AS node FROM u WHERE src IN (SELECT node FROM h1)) SELECT 'p5' AS node, 0 AS hop UNION ALL SELECT node, 1 FROM h1 WHERE node <> 'p5' UNION ALL SELECT node, 2 FROM h2 WHERE node <> 'p5' AND node NOT IN (SELECT node FROM h1)")
def ego_depth2(spark, d):
    both = G.undirected(edges(spark, d))
    return G.neighbourhood(both, spark.createDataFrame([("p5",)], "node string"), 2)


@register("induced_subgraph", f"WITH {_E}, {_HITS} SELECT src, dst, kind FROM e WHERE src IN (SELECT node FROM h) AND dst IN (SELECT node FROM h)")
def induced_subgraph(spark, d):
    return G.induced(edges(spark, d), hits(spark, d)).select("src", "dst", "kind")


@register("bridge_nodes", f"WITH {_E}, {_U}, {_HITS} SELECT dst AS node, count(DISTINCT src) AS n_hits FROM u WHERE src IN (SELECT node FROM h) AND dst NOT IN (SELECT node FROM h) GROUP BY dst HAVING count(DISTINCT src) >= 2")
def bridge_nodes(spark, d):
    return G.bridges(edges(spark, d), hits(spark, d))


@register("one_hop", f"WITH {_E}, {_U}, {_HITS} SELECT DISTINCT dst AS node FROM u WHERE src IN (SELECT node FROM h) AND dst NOT IN (SELECT node FROM h) ORDER BY node LIMIT 200")
def one_hop(spark, d):
    return G.one_hop(edges(spark, d), hits(spark, d))


@register("isolated_hits", f"WITH {_E}, {_HITS}, i AS (SELECT src, dst FROM e WHERE src IN (SELECT node FROM h) AND dst IN (SELECT node FROM h)) SELECT node FROM h WHERE node NOT IN (SELECT src FROM i UNION SELECT dst FROM i)")
def isolated_hits(spark, d):
    return G.isolated(edges(spark, d), hits(spark, d))


@register("graph_stats", f"WITH {_E} SELECT kind, count(*) AS n_edges, count(DISTINCT src) AS n_src, count(DISTINCT dst) AS n_dst FROM e GROUP BY 1")
def graph_stats(spark, d):
    return edges(spark, d).groupBy("kind").agg(F.count("*").alias("n_edges"), F.countDistinct("src").alias("n_src"), F.countDistinct("dst").alias("n_dst"))


@register("co_mention_star", """
WITH h AS (SELECT source, doc_id, CAST(n_chars AS DOUBLE) AS score FROM documents WHERE lang = 'en'), r AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY score DESC, doc_id) AS rn, count(*) OVER (PARTITION BY source) AS n FROM h)
SELECT a.source, a.doc_id AS src, b.doc_id AS dst FROM r a JOIN r b ON a.source = b.source AND a.rn = 1 AND b.rn BETWEEN 2 AND 9 ORDER BY a.n DESC, a.source, b.rn LIMIT 100""")
def co_mention_star(spark, d):
    h = load(spark, d, "documents").filter("lang = 'en'").select("source", "doc_id", F.col("n_chars").cast("double").alias("score"))
    return G.stars(h, "source", "doc_id", "score", most=100)


_NODEROWS = "SELECT p_partkey, p_name, substr(p_type, 1, 3) AS kind, n FROM part LEFT JOIN (SELECT l_partkey, count(*) AS n FROM lineitem GROUP BY 1) ON l_partkey = p_partkey"


@register("node_descriptors", _NODEROWS)
def node_descriptors(spark, d):
    n = li(spark, d).groupBy(F.col("l_partkey").alias("p_partkey")).agg(F.count("*").alias("n"))
    return load(spark, d, "part").join(n, "p_partkey", "left").select("p_partkey", "p_name", F.substring("p_type", 1, 3).alias("kind"), "n")


_AUTHORS = "a AS (SELECT l_orderkey AS paper, list_sort(list(DISTINCT 'Author ' || l_suppkey)) AS authors FROM lineitem GROUP BY 1), p AS (SELECT paper, authors, o_totalprice AS cites FROM a JOIN orders ON o_orderkey = paper)"


def papers(spark, d):
    a = li(spark, d).groupBy(F.col("l_orderkey").alias("paper")).agg(F.array_sort(F.collect_set(F.concat(F.lit("Author "), F.col("l_suppkey").cast("string")))).alias("authors"))
    return a.join(load(spark, d, "orders").select(F.col("o_orderkey").alias("paper"), F.col("o_totalprice").alias("cites")), "paper")


_INDEX = f"{_AUTHORS}, x AS (SELECT paper, cites, len(authors) AS k, unnest(range(1, len(authors) + 1)) AS i, unnest(authors) AS name FROM p), ai AS (SELECT name, count(DISTINCT paper) AS papers, sum(cites) AS cites, count(*) FILTER (i = 1) AS firsts, count(*) FILTER (i = k AND k > 1) AS lasts FROM x GROUP BY 1)"


@register("author_index", f"WITH {_INDEX} SELECT name, papers, round(cites, 2) AS cites, firsts, lasts FROM ai")
def author_index(spark, d):
    return G.author_index(papers(spark, d), "paper", "authors", "cites").select("name", "papers", F.round("cites", 2).alias("cites"), "firsts", "lasts")


@register("author_ids", "SELECT s_suppkey, 'local:' || substr(sha1('author ' || s_suppkey), 1, 16) AS author_id FROM supplier WHERE s_suppkey IN (SELECT l_suppkey FROM lineitem)")
def author_ids(spark, d):
    a = G.author_index(papers(spark, d), "paper", "authors", "cites")
    return a.select(F.split_part("name", F.lit(" "), F.lit(2)).cast("long").alias("s_suppkey"), "author_id")


@register("entity_position", f"WITH {_AUTHORS}, x AS (SELECT paper, len(authors) AS k, unnest(range(1, len(authors) + 1)) AS i, unnest(authors) AS name FROM p) SELECT CASE WHEN i = 1 THEN 'first' WHEN i = k THEN 'last' ELSE 'middle' END AS place, count(*) AS n FROM x GROUP BY 1")
def entity_position(spark, d):
    x = papers(spark, d).select(F.size("authors").alias("k"), F.posexplode("authors").alias("i", "name"))
    return x.groupBy(G.position(F.col("i") + 1, F.col("k")).alias("place")).agg(F.count("*").alias("n"))


_CO = "s AS (SELECT DISTINCT l_orderkey, l_suppkey AS m FROM lineitem), z AS (SELECT l_orderkey FROM s GROUP BY 1 HAVING count(*) BETWEEN 2 AND 50), k AS (SELECT * FROM s WHERE l_orderkey IN (SELECT l_orderkey FROM z)), co AS (SELECT x.m AS a, y.m AS b, count(*) AS n FROM k x JOIN k y ON x.l_orderkey = y.l_orderkey AND x.m < y.m GROUP BY ALL HAVING count(*) >= 2)"


def co(spark, d):
    return G.co_occurrence(li(spark, d), "l_orderkey", "l_suppkey", min_groups=2)


@register("co_occurrence_edges", f"WITH {_CO} SELECT a, b, n FROM co")
def co_occurrence_edges(spark, d):
    return co(spark, d)


@register("co_occurrence_of", f"WITH {_CO} SELECT partner, n FROM (SELECT b AS partner, n FROM co WHERE a = 3 UNION ALL SELECT a, n FROM co WHERE b = 3) ORDER BY n DESC, partner LIMIT 20")
def co_occurrence_of(spark, d):
    return G.partners(co(spark, d), 3, 20)


@register("co_author_network", f"WITH {_CO}, t AS (SELECT a AS src, b AS dst, n FROM co UNION ALL SELECT b, a, n FROM co), o AS (SELECT src, dst, n FROM t WHERE src = 3 ORDER BY n DESC, dst LIMIT 10), w AS (SELECT *, row_number() OVER (PARTITION BY src ORDER BY n DESC, dst) AS rn FROM t WHERE dst <> 3 AND src IN (SELECT dst FROM o)) SELECT src, dst, n, 1 AS hop FROM o UNION ALL SELECT src, dst, n, 2 FROM w WHERE rn <= 5")
def co_author_network(spark, d):
    return G.ego(co(spark, d), 3)


@register("top_entities", f"WITH {_INDEX} SELECT name, papers FROM ai ORDER BY papers DESC, name LIMIT 20")
def top_entities(spark, d):
    a = G.author_index(papers(spark, d), "paper", "authors", "cites")
    return a.select("name", "papers").orderBy(F.desc("papers"), "name").limit(20)


@register("entity_search", "SELECT s_suppkey, s_name FROM supplier WHERE contains(lower(s_name), '7') ORDER BY CASE WHEN lower(s_name) = 'supplier_7' THEN 0 ELSE 1 END, s_name LIMIT 10")
def entity_search(spark, d):
    s = load(spark, d, "supplier").filter(F.contains(F.lower("s_name"), F.lit("7")))
    return s.select("s_suppkey", "s_name").orderBy(F.when(F.lower("s_name") == "supplier_7", 0).otherwise(1), "s_name").limit(10)


@register("expert_ranking", f"WITH {_INDEX} SELECT name, papers, round(cites, 2) AS cites FROM ai WHERE (SELECT count(*) FILTER (papers >= 150) FROM ai) < 5 OR papers >= 150 ORDER BY papers DESC, name LIMIT 20")
def expert_ranking(spark, d):
    a = G.author_index(papers(spark, d), "paper", "authors", "cites")
    return G.adaptive_experts(a, "papers", [F.desc("papers"), F.col("name")], least=150).select("name", "papers", F.round("cites", 2).alias("cites"))


@register("entity_profile", "SELECT p_type AS area, count(*) AS n, count(DISTINCT l_orderkey) AS papers FROM lineitem JOIN part ON l_partkey = p_partkey WHERE l_suppkey = 3 GROUP BY 1 ORDER BY n DESC, area LIMIT 20")
def entity_profile(spark, d):
    own = li(spark, d).filter("l_suppkey = 3").join(load(spark, d, "part"), F.col("l_partkey") == F.col("p_partkey"))
    return own.groupBy(F.col("p_type").alias("area")).agg(F.count("*").alias("n"), F.countDistinct("l_orderkey").alias("papers")).orderBy(F.desc("n"), "area").limit(20)


@register("author_totals", "SELECT l_suppkey, count(DISTINCT l_orderkey) AS papers, round(sum(l_extendedprice), 2) AS total FROM lineitem GROUP BY 1")
def author_totals(spark, d):
    return li(spark, d).groupBy("l_suppkey").agg(F.countDistinct("l_orderkey").alias("papers"), F.round(F.sum("l_extendedprice"), 2).alias("total"))


_CITE = "c AS (SELECT DISTINCT l_orderkey AS src, l_partkey AS dst FROM lineitem)"


def citations(spark, d):
    return li(spark, d).select(F.col("l_orderkey").alias("src"), F.col("l_partkey").alias("dst")).distinct()


@register("branch_influence", f"WITH {_CITE}, p AS (SELECT o_orderkey AS paper, CAST(year(o_orderdate) AS INTEGER) AS year, o_totalprice AS cites FROM orders WHERE o_orderpriority = '1-URGENT'), i AS (SELECT dst AS paper, count(*) AS inside FROM c WHERE src IN (SELECT paper FROM p) AND dst IN (SELECT paper FROM p) GROUP BY 1) SELECT p.paper, year, coalesce(inside, 0) AS inside, round(3 * coalesce(inside, 0) + log10(coalesce(cites, 0) + 1), 6) AS score FROM p LEFT JOIN i ON p.paper = i.paper ORDER BY score DESC, p.paper LIMIT 30")
def branch_influence(spark, d):
    p = load(spark, d, "orders").filter("o_orderpriority = '1-URGENT'").select(F.col("o_orderkey").alias("paper"), F.year("o_orderdate").alias("year"), F.col("o_totalprice").alias("cites"))
    return G.influence(p, citations(spark, d), 30).select("paper", "year", "inside", "score")


@register("citation_report", f"WITH {_CITE}, r AS (SELECT src, count(*) AS n FROM c GROUP BY 1) SELECT count(*) AS citing, quantile_cont(n, 0.25) AS q25, quantile_cont(n, 0.5) AS q50, quantile_cont(n, 0.75) AS q75, (SELECT count(*) FROM c WHERE src IN (SELECT o_orderkey FROM orders) AND dst IN (SELECT o_orderkey FROM orders)) AS inside, (SELECT count(*) FROM orders) AS papers, round(count(*)::DOUBLE / (SELECT count(*) FROM orders), 6) AS coverage FROM r")
def citation_report(spark, d):
    return G.citation_report(citations(spark, d), load(spark, d, "orders").select(F.col("o_orderkey").alias("node")))


@register("citation_candidate_pairs", f"WITH {_CITE} SELECT src, dst FROM c WHERE src IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'O') AND dst IN (SELECT p_partkey FROM part WHERE p_size > 10) AND NOT (src % 10 = 0) ORDER BY md5('seed:' || src || ':' || dst) LIMIT 100")
def citation_candidate_pairs(spark, d):
    t = load(spark, d, "orders").filter("o_orderstatus = 'O'").select(F.col("o_orderkey").alias("node"))
    ok = load(spark, d, "part").filter("p_size > 10").select(F.col("p_partkey").alias("node"))
    done = citations(spark, d).filter("src % 10 = 0")
    return G.candidate_pairs(citations(spark, d), t, ok, done, "seed", 100)


@register("edge_validation", f"WITH {_E} SELECT src, dst, kind, 'medium' AS confidence FROM e WHERE kind IN ('A', 'R') AND src IN (SELECT 'p' || p_partkey FROM part WHERE p_size > 5)")
def edge_validation(spark, d):
    e = edges(spark, d).withColumns({"confidence": F.lit(None).cast("string"), "evidence": F.lit("x")})
    n = load(spark, d, "part").filter("p_size > 5").select(F.concat(F.lit("p"), F.col("p_partkey").cast("string")).alias("node"))
    return G.valid_edges(e, ["A", "R"], n).select("src", "dst", "kind", "confidence")
