"""Citation, co-author and evidence graphs as edge DataFrames."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestrata.operators.rank import top_per
from lodestrata.scratch import scratch_dir


def browse(edges: DataFrame, **equal: object) -> DataFrame:
    """Edges that hold every given column value; None means any."""
    for column, value in equal.items():
        if value is not None:
            edges = edges.filter(F.col(column) == value)
    return edges


def undirected(edges: DataFrame) -> DataFrame:
    return edges.select("src", "dst").union(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).distinct()


def neighbourhood(edges: DataFrame, start: DataFrame, depth: int = 2, per_hop: int | None = None) -> DataFrame:
    """(node, hop) reached from start (node) within depth hops, each at its first hop. Bounded breadth-first search."""
    seen = start.select("node").distinct().withColumn("hop", F.lit(0))
    front = seen
    for hop in range(1, depth + 1):
        step = front.select(F.col("node").alias("src")).join(edges, "src").select(F.col("dst").alias("node")).distinct().join(seen.select("node"), "node", "left_anti")
        front = (step.orderBy("node").limit(per_hop) if per_hop else step).withColumn("hop", F.lit(hop))
        seen = seen.unionByName(front)
    return seen


def induced(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges with both ends among nodes (node)."""
    a, b = nodes.select(F.col("node").alias("src")), nodes.select(F.col("node").alias("dst"))
    return edges.join(a, "src", "left_semi").join(b, "dst", "left_semi")


def bridges(edges: DataFrame, hits: DataFrame, least: int = 2) -> DataFrame:
    """(node, n_hits): nodes that aren't hits and touch at least `least` of them."""
    touch = undirected(edges).join(hits.select(F.col("node").alias("src")), "src", "left_semi").join(hits.select(F.col("node").alias("dst")), "dst", "left_anti")
    return touch.groupBy(F.col("dst").alias("node")).agg(F.countDistinct("src").alias("n_hits")).filter(F.col("n_hits") >= least)


def one_hop(edges: DataFrame, hits: DataFrame, most: int = 200) -> DataFrame:
    touch = undirected(edges).join(hits.select(F.col("node").alias("src")), "src", "left_semi").join(hits.select(F.col("node").alias("dst")), "dst", "left_anti")
    return touch.select(F.col("dst").alias("node")).distinct().orderBy("node").limit(most)


def isolated(edges: DataFrame, hits: DataFrame) -> DataFrame:
    own = induced(edges, hits)
    return hits.join(own.select(F.col("src").alias("node")).union(own.select("dst")), "node", "left_anti")


def stars(hits: DataFrame, group: str, node: str, score: str, spokes: int = 8, most: int = 200) -> DataFrame:
    """(group, src, dst): in each group an edge from its best hit to the next ones, largest groups first."""
    ranked = top_per(hits, group, [F.desc(score), F.col(node)], spokes + 1)
    size = hits.groupBy(group).agg(F.count("*").alias("_n"))
    centre = ranked.filter("rn = 1").select(group, F.col(node).alias("src"))
    spoke = ranked.filter("rn > 1").select(group, F.col(node).alias("dst"), "rn")
    return centre.join(spoke, group).join(size, group).orderBy(F.desc("_n"), group, "rn").limit(most).select(group, "src", "dst")


def co_occurrence(pairs: DataFrame, group: str, member: str, least: int = 2, most: int = 50, min_groups: int = 1) -> DataFrame:
    """(a, b, n) of members that share groups of `least` to `most` distinct members, a < b.

    The size filter bounds a group's pairs; it is part of the operator (huge author lists say nothing of two authors).
    """
    own = pairs.select(group, F.col(member).alias("m")).distinct()
    fits = own.groupBy(group).agg(F.count("*").alias("k")).filter(F.col("k").between(least, most)).select(group)
    sized = own.join(fits, group, "left_semi").groupBy(group).agg(F.collect_list("m").alias("s"))
    exploded = sized.select(F.explode("s").alias("a"), "s").select("a", F.explode("s").alias("b")).filter("a < b")
    return exploded.groupBy("a", "b").agg(F.count("*").alias("n")).filter(F.col("n") >= min_groups)


def partners(edges: DataFrame, member: object, k: int) -> DataFrame:
    """Co-members of one member from edges (a, b, n), both directions, most shared first."""
    both = edges.filter(F.col("a") == member).select(F.col("b").alias("partner"), "n").unionByName(edges.filter(F.col("b") == member).select(F.col("a").alias("partner"), "n"))
    return both.orderBy(F.desc("n"), "partner").limit(k)


def ego(edges: DataFrame, member: object, first: int = 10, second: int = 5) -> DataFrame:
    """(src, dst, n, hop): the strongest partners, and the strongest partners of each of those."""
    both = edges.select(F.col("a").alias("src"), F.col("b").alias("dst"), "n").union(edges.select("b", "a", "n"))
    one = both.filter(F.col("src") == member).orderBy(F.desc("n"), "dst").limit(first).withColumn("hop", F.lit(1))
    next_ = both.filter(F.col("dst") != member).join(F.broadcast(one.select(F.col("dst").alias("src"))), "src", "left_semi")  # `first` rows
    two = top_per(next_, "src", [F.desc("n"), F.col("dst")], second).drop("rn").withColumn("hop", F.lit(2))
    return one.unionByName(two)


def position(place: Column, size: Column) -> Column:
    """first, middle or last of an author list by index from 1; one author is first, an unmatched one unknown."""
    return F.when(place.isNull() | (place <= 0), "unknown").when(place == 1, "first").when(place == size, "last").otherwise("middle")


def author_index(papers: DataFrame, paper: str, authors: str, cites: str) -> DataFrame:
    """(author_id, name, papers, cites, firsts, lasts) from author lists; the id is a hash of the normalised name."""
    rows = papers.select(paper, cites, F.size(authors).alias("k"), F.posexplode(authors).alias("i", "name"))
    place = position(F.col("i") + 1, F.col("k"))
    key = F.concat(F.lit("local:"), F.substring(F.sha1(F.lower(F.regexp_replace(F.trim("name"), r"\s+", " ")).cast("binary")), 1, 16))
    g = rows.withColumns({"author_id": key, "place": place}).groupBy("author_id")
    return g.agg(F.min("name").alias("name"), F.countDistinct(paper).alias("papers"), F.sum(cites).alias("cites"), F.count(F.when(F.col("place") == "first", 1)).alias("firsts"), F.count(F.when(F.col("place") == "last", 1)).alias("lasts"))


def adaptive_experts(authors: DataFrame, papers: str, score: list[Column], least: int = 2, enough: int = 5, k: int = 20) -> DataFrame:
    """Authors with at least `least` papers if `enough` of them qualify, else the top k."""
    n = authors.agg(F.count(F.when(F.col(papers) >= least, 1)).alias("_n"))
    return authors.crossJoin(F.broadcast(n)).filter((F.col("_n") < enough) | (F.col(papers) >= least)).drop("_n").orderBy(*score).limit(k)


def influence(papers: DataFrame, citations: DataFrame, k: int) -> DataFrame:
    """Papers (paper, year, cites) by 3 * citations within the branch + log10(1 + cites)."""
    inside = induced(citations, papers.select(F.col("paper").alias("node")))
    deg = inside.groupBy(F.col("dst").alias("paper")).agg(F.count("*").alias("inside"))
    score = F.round(3 * F.coalesce("inside", F.lit(0)) + F.log10(F.coalesce("cites", F.lit(0)) + 1), 6)
    return papers.join(deg, "paper", "left").withColumn("inside", F.coalesce("inside", F.lit(0))).withColumn("score", score).orderBy(F.desc("score"), "paper").limit(k)


def citation_report(citations: DataFrame, corpus: DataFrame) -> DataFrame:
    """One row: citing papers, quartiles of references, pairs within the corpus, share of papers with references."""
    refs = citations.groupBy("src").agg(F.count("*").alias("n"))
    q = refs.agg(F.count("*").alias("citing"), *[F.percentile("n", F.lit(p)).alias(f"q{int(p * 100)}") for p in (0.25, 0.5, 0.75)])
    inside = induced(citations, corpus).agg(F.count("*").alias("inside"))
    total = corpus.agg(F.count("*").alias("papers"))
    return q.crossJoin(inside).crossJoin(total).withColumn("coverage", F.round(F.col("citing") / F.col("papers"), 6))  # one row each


def candidate_pairs(citations: DataFrame, targets: DataFrame, eligible: DataFrame, done: DataFrame, seed: str, k: int) -> DataFrame:
    """Citing in targets, cited in eligible, not done; a shuffle by a seeded hash, reproducible everywhere."""
    pool = citations.join(targets.select(F.col("node").alias("src")), "src", "left_semi").join(eligible.select(F.col("node").alias("dst")), "dst", "left_semi").join(done, ["src", "dst"], "left_anti")
    return pool.orderBy(F.md5(F.concat_ws(":", F.lit(seed), "src", "dst").cast("binary"))).limit(k)


def valid_edges(edges: DataFrame, kinds: list[str], nodes: DataFrame, evidence: int = 500) -> DataFrame:
    """Known kinds, known ends, no loops, each once, a default confidence, evidence cut."""
    ok = edges.filter(F.col("kind").isin(kinds) & (F.col("src") != F.col("dst")))
    ok = ok.join(nodes.select(F.col("node").alias("src")), "src", "left_semi")
    best = ok.groupBy("src", "dst", "kind").agg(F.max(F.coalesce("confidence", F.lit("medium"))).alias("confidence"), F.min(F.substring("evidence", 1, evidence)).alias("evidence"))
    return best


def components(links: DataFrame) -> DataFrame:
    """(node, root): root is the smallest node of the component. Minimum labels over undirected links, with a checkpoint each round."""
    edges = links.select(F.col("a").alias("src"), F.col("b").alias("dst"))
    both = cut(edges.union(edges.select("dst", "src")).distinct())
    label = cut(both.groupBy(F.col("src").alias("node")).agg(F.least(F.first("src"), F.min("dst")).alias("root")))
    while True:
        near = both.join(label.select(F.col("node").alias("dst"), "root"), "dst").groupBy(F.col("src").alias("node")).agg(F.min("root").alias("m"))
        lower = near.join(label, "node").select("node", F.least("m", "root").alias("r"))
        jump = label.select(F.col("node").alias("r"), F.col("root").alias("rr"))
        new = cut(lower.join(jump, "r", "left").select("node", F.least("r", F.coalesce("rr", "r")).alias("root")))
        if new.join(label.withColumnRenamed("root", "old"), "node").filter("root <> old").isEmpty():
            return new
        label = new


def cut(df: DataFrame) -> DataFrame:
    """A reliable checkpoint in the folder that driver and executors share."""
    sc = df.sparkSession.sparkContext
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(scratch_dir(df.sparkSession))
    return df.checkpoint()
