"""Dense vectors: inner products inside whole-stage code, top-k, placement and clusters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    """Inner product in double precision."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(v: Column) -> Column:
    return F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))


def truncated(v: Column, dims: int) -> Column:
    """The first dims, renormalised."""
    head = F.slice(v, 1, dims)
    n = norm(head)
    return F.transform(head, lambda x: F.when(n > 0, x.cast("double") / n).otherwise(0.0))


def cosine(a: Column, b: Column) -> Column:
    """Over the dims that both have."""
    d = F.least(F.size(a), F.size(b))
    x, y = F.slice(a, F.lit(1), d), F.slice(b, F.lit(1), d)
    n = norm(x) * norm(y)
    return F.when(n > 0, dot(x, y) / n).otherwise(0.0)


def query_vector(vectors: DataFrame, id_col: str, vec_col: str, id_value: int) -> list[float]:
    """A stored vector as a query: one row to the driver."""
    row = vectors.filter(F.col(id_col) == id_value).select(vec_col).first()
    return [float(x) for x in row[0]] if row else []


def literal(v: list[float]) -> Column:
    return F.array(*[F.lit(float(x)) for x in v])


def search(vectors: DataFrame, id_col: str, vec_col: str, query: list[float], k: int = 200, least: float = 0.20) -> DataFrame:
    """(id, score) of the k best with at least `least`; scan, filter and top-k without a shuffle of vectors."""
    scored = vectors.select(F.col(id_col).alias("id"), F.round(dot(F.col(vec_col), literal(query)), 6).alias("score"))
    return scored.filter(F.col("score") >= least).orderBy(F.desc("score"), "id").limit(k)


def rerank(vectors: DataFrame, id_col: str, vec_col: str, query: list[float], ids: DataFrame, k: int, least: float) -> DataFrame:
    """search() among the ids of another result."""
    return search(vectors.join(ids.select(F.col("id").alias(id_col)), id_col, "left_semi"), id_col, vec_col, query, k, least)


def centroids(vectors: DataFrame, label_col: str, vec_col: str) -> DataFrame:
    """(label, centroid) with unit norm: sums per dimension on the map side, then one array for each label."""
    dims = vectors.select(label_col, F.posexplode(vec_col).alias("dim", "x")).groupBy(label_col, "dim").agg(F.sum(F.col("x").cast("double")).alias("x"))
    v = dims.groupBy(label_col).agg(F.array_sort(F.collect_list(F.struct("dim", "x"))).alias("v"))
    raw = F.transform("v", lambda s: s["x"])
    return v.select(F.col(label_col).alias("label"), F.transform(raw, lambda x: x / norm(raw)).alias("centroid"))


def place(leaves: DataFrame, id_col: str, vec_col: str, branches: DataFrame, attach: float = 0.55, exception: float = 0.42) -> DataFrame:
    """(id, best, score, runner_up, margin, decision): each leaf's nearest branch.

    branches (label, centroid) are categories of a taxonomy level, few whatever the corpus is; the leaves don't move.
    """
    scored = leaves.select(F.col(id_col).alias("id"), vec_col).crossJoin(F.broadcast(branches)).select("id", "label", F.round(dot(F.col(vec_col), F.col("centroid")), 6).alias("score"))
    two = scored.groupBy("id").agg(F.slice(F.sort_array(F.collect_list(F.struct("score", (-F.col("label")).alias("back"))), False), 1, 2).alias("t"))
    best, second = F.get("t", F.lit(0)), F.get("t", F.lit(1))
    decision = F.when(best["score"] >= attach, "attach").when(best["score"] <= exception, "exception").otherwise("gray")
    return two.select("id", (-best["back"]).alias("best"), best["score"].alias("score"), (-second["back"]).alias("runner_up"), F.round(best["score"] - second["score"], 6).alias("margin"), decision.alias("decision"))


def route(branches: DataFrame, query: list[float], literal_hit: Column, bonus: float = 0.15, k: int = 8) -> DataFrame:
    """Branches (label, centroid, ...) by similarity, with a bonus where the query's words name them."""
    score = F.round(dot(F.col("centroid"), F.array(*[F.lit(float(x)) for x in query])) + F.when(literal_hit, bonus).otherwise(0.0), 6)
    return branches.withColumn("score", score).orderBy(F.desc("score"), "label").limit(k)


def routed_or_hit(routed: DataFrame, hits: DataFrame) -> DataFrame:
    """(label, score, n_hits): branches that were routed to, or that hold hits (label), or both."""
    counts = hits.groupBy("label").agg(F.count("*").alias("n_hits"))
    return routed.select("label", "score").join(counts, "label", "full").select("label", "score", F.coalesce("n_hits", F.lit(0)).alias("n_hits"))


def best_placement(places: DataFrame, preferred: Column, bonus: float = 0.05) -> DataFrame:
    """(doc, label): for each doc the place (label, sim) with the largest similarity, some of them preferred."""
    ranked = F.struct((F.col("sim") + F.when(preferred, bonus).otherwise(0.0)).alias("s"), (-F.col("label")).alias("back"))
    return places.groupBy("doc").agg(F.max(ranked).alias("m")).select("doc", (-F.col("m.back")).alias("label"), F.round("m.s", 6).alias("score"))


def similar_papers(hits: DataFrame, papers: DataFrame, k: int) -> DataFrame:
    """(paper, best_rank): the first k distinct papers in order of their best hit; hits (id, rank), papers (id, paper)."""
    return hits.join(papers, "id").groupBy("paper").agg(F.min("rank").alias("best_rank")).orderBy("best_rank", "paper").limit(k)


def similar_pairs(vectors: DataFrame, id_col: str, vec_col: str, block: str, least: float) -> DataFrame:
    """(a, b, score) with score >= least within a block (label, source, or an LSH bucket), a < b.

    The condition is part of the join, so only pairs that hold it are made; AQE splits large blocks.
    """
    left = vectors.select(F.col(id_col).alias("a"), F.col(vec_col).alias("va"), F.col(block).alias("block"))
    right = vectors.select(F.col(id_col).alias("b"), F.col(vec_col).alias("vb"), F.col(block).alias("block2"))
    score = F.round(dot(F.col("va"), F.col("vb")), 6)
    pairs = left.join(right, (F.col("block") == F.col("block2")) & (F.col("a") < F.col("b")) & (score >= least))
    return pairs.select("a", "b", score.alias("score"))


def numbered(ids: DataFrame, id_col: str) -> DataFrame:
    """(id, row): row numbers from 0 in order of the id, as vector files need them.

    Ids are put into ranges and numbered within each; a range begins at the number of ids in those before it, which is a
    table of as many rows as there are ranges. Equal ids fall into one range.
    """
    from lodestrata.operators.graph import cut

    parts = cut(ids.select(id_col).repartitionByRange(id_col).withColumn("_part", F.spark_partition_id()))
    sizes = parts.groupBy("_part").agg(F.count("*").alias("_n"))
    before = sizes.select("_part", (F.sum("_n").over(W.orderBy("_part")) - F.col("_n")).alias("_before"))
    own = parts.withColumn("_own", F.row_number().over(W.partitionBy("_part").orderBy(id_col)) - 1)
    return own.join(F.broadcast(before), "_part").select(id_col, (F.col("_before") + F.col("_own")).alias("row"))


def token_overlap_score(query_terms: list[str], words: Column) -> Column:
    """A deterministic stand-in for a pair scorer: share of query terms that the words hold."""
    terms = F.array(*map(F.lit, dict.fromkeys(query_terms)))
    return F.size(F.array_intersect(terms, words)) / F.size(terms)
