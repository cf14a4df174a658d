"""The composed search pipeline: channels, fusion, feedback, boost, rerank, injection, caps, pages. One lazy plan."""

from __future__ import annotations

import itertools
import time
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lodestrata.functions.text import tokens
from lodestrata.operators import fts, rank, vectors
from lodestrata.operators.graph import cut
from lodestrata.operators.text_index import TextIndex


@dataclass
class Corpus:
    """Tables and the columns that play the roles."""

    claims: DataFrame
    id: str = "doc_id"
    text: str = "text"
    paper: str = "source"
    kind: str = "lang"
    cites: DataFrame | None = None  # (paper, c)
    vectors: DataFrame | None = None
    vec_id: str = "vec_id"
    vec: str = "embedding"
    index: TextIndex | None = None  # of the claims' text; without one every search scans the text
    members: DataFrame | None = None  # the taxonomy's prefix map (id, prefix, depth)
    authors: DataFrame | None = None  # (paper, authors, cites)

    def scores(self, terms: list[str]) -> DataFrame:
        """(id, score) by BM25, from the index where there is one."""
        return self.index.bm25(terms) if self.index is not None else fts.bm25(self.claims, self.id, self.text, terms)

    def any_of(self, terms: list[str]) -> DataFrame:
        return self.index.match_any(terms) if self.index is not None else fts.match_any(self.claims, self.id, self.text, terms)

    def papers_of(self) -> DataFrame:
        """(id, paper) of every claim."""
        return self.claims.select(F.col(self.id).alias("id"), F.col(self.paper).alias("paper"))


@dataclass
class Asked:
    """What a query names beside its terms: taxonomy nodes (path, match), an author, a paper title column, synonyms."""

    nodes: DataFrame | None = None
    author: str | None = None
    title: str | None = None
    synonyms: dict[str, list[str]] = field(default_factory=dict)


@dataclass
class Knobs:
    """Sizes of the channels, and switches for ablation."""

    limit: int = 20
    offset: int = 0
    each: int = 200
    k: int = 60
    vector_least: float = 0.20
    vector_weight: float = 0.05
    alpha: float = 1.0
    per_paper: int = 1
    rerank_window: int = 50
    tree_k: int = 200
    paper_k: int = 60
    per_author_paper: int = 3
    on: dict[str, bool] = field(default_factory=lambda: {"text": True, "vector": True, "authority": True, "feedback": False, "rerank": False, "tree": True, "paper": True, "guided": True, "author": True, "inject": False})


def _list(scored: DataFrame, no: int, *order: Column) -> DataFrame:
    return rank.ranked(scored, *order).select(F.lit(no).alias("list_no"), "id", "rank")


def channels(corpus: Corpus, terms: list[str], query: list[float] | None, knobs: Knobs, asked: Asked | None = None) -> DataFrame:
    """(list_no, id, rank) of the channels that are on and have what they need.

    0 text, 1 vector, 2 cited papers' claims, 3 feedback terms, 4 taxonomy, 5 papers by title and text, 6 papers by how
    many of the terms their claims match, 7 and 8 the author's claims (an author that is named counts twice).
    """
    asked, lists = asked or Asked(), []
    text = corpus.scores(terms)
    if knobs.on.get("text"):
        lists.append(_list(fts.top(text, knobs.each, "id"), 0, F.desc("score"), F.col("id")))
    if knobs.on.get("vector") and corpus.vectors is not None and query:
        lists.append(_list(vectors.search(corpus.vectors, corpus.vec_id, corpus.vec, query, knobs.each, knobs.vector_least), 1, F.desc("score"), F.col("id")))
    if knobs.on.get("authority") and corpus.cites is not None:
        owned = text.join(corpus.papers_of(), "id").join(corpus.cites, "paper", "left")
        best = owned.select("id", F.coalesce("c", F.lit(0)).alias("c"), "score").orderBy(F.desc("c"), F.desc("score"), "id").limit(knobs.each)
        lists.append(_list(best, 2, F.desc("c"), F.desc("score"), F.col("id")))
    if knobs.on.get("feedback"):
        more = [r["term"] for r in feedback_terms(corpus, fts.top(text, 30, "id"), terms, 8).collect()]  # eight terms
        if more:
            lists.append(_list(fts.top(corpus.scores(more), knobs.each, "id"), 3, F.desc("score"), F.col("id")))
    if knobs.on.get("tree") and corpus.members is not None and asked.nodes is not None:
        lists.append(_list(tree_recall(asked.nodes, corpus.members, knobs.tree_k), 4, F.desc("score"), F.col("id")))
    if knobs.on.get("paper") and corpus.cites is not None and asked.title:
        found = paper_recall(corpus, asked.title, terms, knobs.paper_k, synonyms=asked.synonyms).withColumnRenamed("score", "p")
        lists.append(_claims_of(corpus, text, found, 5))
    if knobs.on.get("guided") and corpus.cites is not None:
        lists.append(_claims_of(corpus, text, guided_recall(corpus, terms, knobs.paper_k).withColumnRenamed("score", "p"), 6))
    if knobs.on.get("author") and corpus.authors is not None and asked.author:
        own = corpus.claims.select(F.col(corpus.id).alias("id"), F.col(corpus.paper).alias("paper"))
        hit = author_recall(corpus.authors, own, asked.author, "paper", knobs.per_author_paper, [F.col("id")], knobs.paper_k)
        lists += [_list(hit, no, F.desc("cites"), F.col("paper"), F.col("rn")) for no in (7, 8)]
    out = lists[0]
    for x in lists[1:]:
        out = out.unionByName(x)
    return out


def _claims_of(corpus: Corpus, text: DataFrame, papers: DataFrame, no: int) -> DataFrame:
    """The best claim by text of each paper (paper, p), in order of p."""
    own = text.join(corpus.papers_of(), "id").join(F.broadcast(papers), "paper")  # papers have been cut to a number
    best = rank.top_per(own, "paper", [F.desc("score"), F.col("id")], 1)
    return _list(best, no, F.desc("p"), F.col("paper"), F.col("id"))


def guided_recall(corpus: Corpus, terms: list[str], k: int) -> DataFrame:
    """(paper, n_queries, c, score): papers by how many of the terms their claims match, and citations."""
    if corpus.index is not None:
        found = corpus.index.postings(terms).join(corpus.papers_of(), "id").select(F.col("term").alias("query_no"), "paper")
        return rank.breadth(found, corpus.cites, k).select("paper", "score")
    out = None
    for i, t in enumerate(dict.fromkeys(terms)):
        one = corpus.any_of([t]).join(corpus.papers_of(), "id").select(F.lit(i).alias("query_no"), "paper")
        out = one if out is None else out.unionByName(one)
    return rank.breadth(out, corpus.cites, k).select("paper", "score")


def feedback_terms(corpus: Corpus, seeds: DataFrame, terms: list[str], k: int = 20, least: int = 2, names: list[str] | None = None) -> DataFrame:
    """(term, n): words that most seed documents hold, beyond the query's; names (of elements, say) count 4 times, other short words 1.5 times."""
    words = corpus.claims.join(F.broadcast(seeds.select(F.col("id").alias(corpus.id))), corpus.id, "left_semi")  # a cut result
    one = words.select(F.explode(F.array_distinct(tokens(F.col(corpus.text)))).alias("term")).filter((F.length("term") > 3) & ~F.col("term").isin(terms))
    n = one.groupBy("term").agg(F.count("*").alias("n")).filter(F.col("n") >= least)
    weight = F.round(F.col("n") * F.when(F.col("term").isin(list(names or [])), 4.0).when(F.length("term") <= 6, 1.5).otherwise(1.0), 6)
    return n.withColumn("weight", weight).orderBy(F.desc("weight"), "term").limit(k)


def search(corpus: Corpus, terms: list[str], query: list[float] | None = None, knobs: Knobs | None = None, kind: str | None = None, asked: Asked | None = None) -> DataFrame:
    """(place, id, paper, kind, score, total): the page of ranked claims."""
    knobs = knobs or Knobs()
    fused = rank.fuse(channels(corpus, terms, query, knobs, asked), knobs.k)
    facts = corpus.claims.select(F.col(corpus.id).alias("id"), F.col(corpus.paper).alias("paper"), F.col(corpus.kind).alias("kind"), F.col(corpus.text).alias("_text"))
    hits = facts.join(F.broadcast(fused), "id")  # at most `each` rows for each channel
    if knobs.on.get("vector") and corpus.vectors is not None and query:
        own = corpus.vectors.select(F.col(corpus.vec_id).alias("id"), F.col(corpus.vec).alias("_v")).join(F.broadcast(fused.select("id")), "id", "left_semi")
        sims = own.select("id", vectors.dot(F.col("_v"), vectors.literal(query)).alias("sim"))
        hits = hits.join(F.broadcast(sims), "id", "left").withColumn("score", F.round(F.col("score") + knobs.vector_weight * F.greatest(F.coalesce("sim", F.lit(0.0)), F.lit(0.0)), 6)).drop("sim")
    if corpus.cites is not None:
        hits = rank.citation_boost(hits.join(corpus.cites, "paper", "left"), F.col("c"), knobs.alpha, bounded=True).drop("c")
    if knobs.on.get("rerank"):
        pair = vectors.token_overlap_score(terms, tokens(F.col("_text")))
        order = rank.ranked(hits, F.desc("score"), F.col("id"), name="_r")
        hits = order.withColumn("score", F.when(F.col("_r") <= knobs.rerank_window, F.round(F.col("score") + pair, 6)).otherwise(F.col("score"))).drop("_r")
    if kind is not None:
        hits = hits.filter(F.col("kind") == kind)
    placed = rank.cap_stable(rank.ranked(hits.drop("_text"), F.desc("score"), F.col("id"), name="position"), "paper", "position", knobs.per_paper)
    return rank.page(placed.select("place", "id", "paper", "kind", "score"), [F.col("place")], knobs.limit, knobs.offset, bounded=True)


def search_many(corpus: Corpus, queries: list[list[str]], knobs: Knobs | None = None) -> DataFrame:
    """(id, paper, score): text results of up to eight queries, fused in one job, one hit of each paper first."""
    knobs = knobs or Knobs()
    out = None
    for i, terms in enumerate(queries[:8]):
        one = _list(fts.top(corpus.scores(terms), knobs.each, "id"), i, F.desc("score"), F.col("id"))
        out = one if out is None else out.unionByName(one)
    fused = rank.fuse(out, knobs.k)
    hits = corpus.claims.select(F.col(corpus.id).alias("id"), F.col(corpus.paper).alias("paper")).join(F.broadcast(fused), "id")
    placed = rank.cap_stable(rank.ranked(hits, F.desc("score"), F.desc("id"), name="position"), "paper", "position", 1)
    return placed.select("place", "id", "paper", "score").orderBy("place").limit(knobs.limit)


def paper_recall(corpus: Corpus, title: str, terms: list[str], k: int, fusion: int = 10, alpha: float = 3.0, each: int = 60, synonyms: dict[str, list[str]] | None = None, pairs: int = 6) -> DataFrame:
    """(paper, score): papers by title, fused and boosted by citations.

    The lists are title matches (twice), all terms, near terms, citations (twice), pairs of terms (so many of them), and
    each synonym in the place of its word beside every other term.
    """
    papers = cut(corpus.claims.groupBy(F.col(corpus.paper).alias("id")).agg(F.min(title).alias("title")))  # every list reads it
    terms = list(dict.fromkeys(terms))
    scored = fts.bm25(papers, "id", "title", terms)
    by_score = lambda df, no: _list(fts.top(df, each, "id"), no, F.desc("score"), F.col("id"))
    lists = [by_score(scored, no) for no in (0, 1)]
    lists.append(by_score(scored.join(fts.match_all(papers, "id", "title", terms), "id", "left_semi"), 2))
    lists.append(by_score(scored.join(fts.match_near(papers, "id", "title", terms, 10), "id", "left_semi"), 3))
    cites = corpus.cites.withColumnRenamed("paper", "id")
    cited = scored.join(cites, "id").orderBy(F.desc("c"), "id").limit(each)
    lists += [_list(cited, no, F.desc("c"), F.col("id")) for no in (4, 5)]
    crossed = [[s, core] for w in terms for s in (synonyms or {}).get(w, []) for core in terms if core not in (w, s)]
    for no, pair in enumerate([*map(list, itertools.islice(itertools.combinations(terms, 2), pairs)), *crossed], 6):
        lists.append(by_score(fts.bm25(papers, "id", "title", pair).join(fts.match_all(papers, "id", "title", pair), "id", "left_semi"), no))
    out = lists[0]
    for x in lists[1:]:
        out = out.unionByName(x)
    boosted = rank.citation_boost(rank.fuse(out, fusion).join(cites, "id", "left"), F.col("c"), alpha, bounded=True)
    return boosted.select(F.col("id").alias("paper"), "score").orderBy(F.desc("score"), "paper").limit(k)


def tree_recall(nodes: DataFrame, members: DataFrame, k: int, decay: float = 0.3) -> DataFrame:
    """(id, score): claims below matched nodes (path, match); score match / (1 + decay * levels deeper), the best for each.

    members is the prefix map (id, prefix, depth), so that a subtree is an equality and not a scan for beginnings.
    """
    at = members.join(F.broadcast(nodes), members["prefix"] == nodes["path"])  # a few matched nodes
    score = F.col("match") / (1 + decay * (F.col("depth") - F.size(F.split("path", "/"))))
    return at.groupBy("id").agg(F.round(F.max(score), 6).alias("score")).orderBy(F.desc("score"), "id").limit(k)


def author_recall(papers: DataFrame, claims: DataFrame, name: str, paper: str, per_paper: int, order: list[Column], k: int) -> DataFrame:
    """Claims of papers (paper, authors, cites) one of whose authors matches, cited ones first, so many of each paper."""
    hit = papers.filter(F.exists("authors", lambda a: F.contains(F.lower(a), F.lit(name.lower())))).select(paper, "cites")
    own = rank.top_per(claims.join(hit, paper), paper, order, per_paper)
    return own.orderBy(F.desc("cites"), F.col(paper), F.col("rn")).limit(k)


def evidence_pool(hits: DataFrame, paper: str, position: str, per_paper: int, most: int) -> DataFrame:
    """So many hits of each paper in order, then others to fill up to `most`."""
    own = hits.withColumn("_rn", F.row_number().over(W.partitionBy(paper).orderBy(position)))
    return own.orderBy((F.col("_rn") > per_paper).cast("int"), position).limit(most).drop("_rn")


class ResultCache:
    """Results of searches by all their knobs, for as long as they live; at most `most` of them, the least used go first.

    A result is kept as its rows, which a page's limit bounds. The key holds the corpus' version, so a changed corpus
    doesn't answer from old rows.
    """

    def __init__(self, most: int = 2000, seconds: float = 300.0, clock=time.monotonic):
        self.most, self.seconds, self.clock, self.held, self.hits, self.misses = most, seconds, clock, {}, 0, 0

    def get(self, spark, key: tuple, make) -> DataFrame:
        """The rows under key as a DataFrame; make() gives them where they aren't held or too old."""
        known = self.held.pop(key, None)
        if known is not None and self.clock() - known[0] <= self.seconds:
            self.hits += 1
        else:
            df = make()
            known = (self.clock(), df.collect(), df.schema)
            self.misses += 1
        self.held[key] = known
        while len(self.held) > self.most:
            self.held.pop(next(iter(self.held)))
        return spark.createDataFrame(known[1], known[2])


def cached_search(cache: ResultCache, version: str, corpus: Corpus, terms: list[str], query: list[float] | None = None, knobs: Knobs | None = None, kind: str | None = None) -> DataFrame:
    """search() through a cache keyed by the version of the corpus and everything that was asked."""
    knobs = knobs or Knobs()
    asked = (version, tuple(terms), tuple(query or ()), kind, *(tuple(sorted(v.items())) if isinstance(v, dict) else v for v in vars(knobs).values()))
    return cache.get(corpus.claims.sparkSession, asked, lambda: search(corpus, terms, query, knobs, kind))


def profile(corpus: Corpus, terms: list[str], query: list[float] | None = None, knobs: Knobs | None = None, asked: Asked | None = None) -> list[dict]:
    """A row for each channel that is on: what it found and how long it took by itself."""
    knobs, out = knobs or Knobs(), []
    for name in [c for c, use in knobs.on.items() if use and c not in ("rerank", "inject")]:
        began = time.perf_counter()
        alone = Knobs(**{**vars(knobs), "on": {name: True}})
        try:
            n = channels(corpus, terms, query, alone, asked).count()
        except IndexError:  # the channel lacks what it needs
            n = 0
        out.append({"channel": name, "n": n, "seconds": time.perf_counter() - began})
    return out
