"""Retrieval metrics, agreement, sampling and load statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lodestrata.operators.rank import top_per


def judged(run: DataFrame, judgments: DataFrame) -> DataFrame:
    """Run (probe, id, rank from 1) with gain; unjudged is 0."""
    return run.join(judgments.select("probe", "id", F.col("gain").cast("double").alias("gain")), ["probe", "id"], "left").withColumn("gain", F.coalesce("gain", F.lit(0.0)))


def ndcg(run: DataFrame, judgments: DataFrame, k: int = 10) -> DataFrame:
    """(probe, ndcg): linear gain over log2(rank + 1); null without an ideal gain."""
    dcg = judged(run, judgments).filter(F.col("rank") <= k).groupBy("probe").agg(F.sum(F.col("gain") / F.log2(F.col("rank") + 1)).alias("dcg"))
    ideal = judgments.withColumn("r", F.row_number().over(W.partitionBy("probe").orderBy(F.desc("gain"), "id"))).filter(F.col("r") <= k)
    best = ideal.groupBy("probe").agg(F.sum(F.col("gain") / F.log2(F.col("r") + 1)).alias("idcg"))
    return dcg.join(best, "probe", "full").select("probe", F.when(F.col("idcg") > 0, F.round(F.coalesce("dcg", F.lit(0.0)) / F.col("idcg"), 6)).alias("ndcg"))


def mrr(run: DataFrame, judgments: DataFrame, least: float = 2) -> DataFrame:
    first = judged(run, judgments).groupBy("probe").agg(F.min(F.when(F.col("gain") >= least, F.col("rank"))).alias("r"))
    return first.select("probe", F.coalesce(F.round(1.0 / F.col("r"), 6), F.lit(0.0)).alias("mrr"))


def recall(run: DataFrame, judgments: DataFrame, k: int, least: float = 2) -> DataFrame:
    """(probe, recall); null where nothing is relevant."""
    total = judgments.groupBy("probe").agg(F.count(F.when(F.col("gain") >= least, 1)).alias("n"))
    got = judged(run, judgments).filter(F.col("rank") <= k).groupBy("probe").agg(F.count(F.when(F.col("gain") >= least, 1)).alias("m"))
    return total.join(got, "probe", "left").select("probe", F.when(F.col("n") > 0, F.round(F.coalesce("m", F.lit(0)) / F.col("n"), 6)).alias("recall"))


def macro(scores: DataFrame, family: str, *metrics: str) -> DataFrame:
    """Means by family; nulls are left out."""
    return scores.groupBy(family).agg(F.count("*").alias("n"), *[F.round(F.avg(m), 6).alias(m) for m in metrics])


def bootstrap(pairs: DataFrame, diff: str, rounds: int = 10_000, seed: int = 0) -> DataFrame:
    """One row (mean, low, high): 95 % interval of the mean difference by resampling probes with a hash as the source of chance.

    pairs are probes (a benchmark's, some hundreds); rounds x probes rows are made on the executors.
    """
    n = pairs.count()
    numbered = pairs.select((F.row_number().over(W.orderBy("probe")) - 1).alias("i"), F.col(diff).alias("d"))
    spark = pairs.sparkSession
    draws = spark.range(rounds).withColumnRenamed("id", "round").crossJoin(F.broadcast(numbered.select(F.col("i").alias("slot"))))
    draws = draws.withColumn("i", F.pmod(F.xxhash64(F.lit(seed), "round", "slot"), F.lit(max(n, 1))).cast("int"))
    means = draws.join(F.broadcast(numbered), "i").groupBy("round").agg(F.avg("d").alias("m"))
    return means.agg(F.round(F.avg("m"), 6).alias("mean"), F.round(F.percentile("m", F.lit(0.025)), 6).alias("low"), F.round(F.percentile("m", F.lit(0.975)), 6).alias("high"))


def kappa_quadratic(df: DataFrame, a: str, b: str, classes: int) -> DataFrame:
    """One row: quadratic-weighted Cohen kappa of two raters with classes 0 to classes - 1."""
    o = df.groupBy(F.col(a).alias("i"), F.col(b).alias("j")).agg(F.count("*").alias("n"))  # classes^2 rows
    ra, rb = o.groupBy("i").agg(F.sum("n").alias("ni")), o.groupBy("j").agg(F.sum("n").alias("nj"))
    total = o.agg(F.sum("n").alias("t"))
    w = F.pow(F.col("i") - F.col("j"), F.lit(2)) / float((classes - 1) ** 2 or 1)
    seen = o.agg(F.sum(w * F.col("n")).alias("seen"))
    chance = ra.crossJoin(rb).crossJoin(total).agg(F.sum(w * F.col("ni") * F.col("nj") / F.col("t")).alias("chance"))
    return seen.crossJoin(chance).select(F.when(F.col("chance") > 0, F.round(1 - F.col("seen") / F.col("chance"), 6)).otherwise(1.0).alias("kappa"))


def stratified(df: DataFrame, stratum: str, key: str, quota: Column, seed: str) -> DataFrame:
    """The first `quota` rows of each stratum in the order of a seeded hash."""
    order = F.md5(F.concat_ws(":", F.lit(seed), F.col(key).cast("string")).cast("binary"))
    return df.withColumn("rn", F.row_number().over(W.partitionBy(stratum).orderBy(order, key))).filter(F.col("rn") <= quota)


def proportional(df: DataFrame, stratum: str, key: str, total: int, forced: DataFrame, seed: str) -> DataFrame:
    """`total` rows by the strata's shares, one at least from each, plus the forced ids.

    Shares are rounded down; what then lacks goes to the strata with the largest remainders, one row each, by name in
    ties. Strata are few.
    """
    sizes = df.groupBy(stratum).agg(F.count("*").alias("_k"))
    all_ = df.agg(F.count("*").alias("_t"))
    exact = F.col("_k") * total / F.col("_t")
    quotas = sizes.crossJoin(F.broadcast(all_)).select(stratum, F.greatest(F.lit(1), F.floor(exact)).cast("int").alias("_f"), (exact - F.floor(exact)).alias("_r"))
    lacks = F.lit(total) - F.sum("_f").over(W.partitionBy())
    place = F.row_number().over(W.orderBy(F.desc("_r"), stratum))
    quotas = quotas.select(stratum, (F.col("_f") + (place <= lacks).cast("int")).alias("_q"))
    drawn = stratified(df.join(F.broadcast(quotas), stratum), stratum, key, F.col("_q"), seed).select(key)
    ids = drawn.union(forced.select(key)).distinct()
    return df.join(ids, key, "left_semi")


def covered_sample(df: DataFrame, kind: str, key: str, each: int, total: int, seed: str) -> DataFrame:
    """`each` rows of every kind, then others from the largest kind on up to `total`, in the order of a seeded hash."""
    order = F.md5(F.concat_ws(":", F.lit(seed), F.col(key).cast("string")).cast("binary"))
    sizes = F.broadcast(df.groupBy(kind).agg(F.count("*").alias("_k")))  # kinds are few
    ranked = top_per(df.withColumn("_o", order), kind, [F.col("_o"), F.col(key)], total).join(sizes, kind)
    beyond = F.col("rn") > each
    return ranked.orderBy(beyond.cast("int"), F.when(beyond, -F.col("_k")).otherwise(0), F.when(beyond, F.col(kind)), "_o", key).limit(total).drop("_o", "rn", "_k")


def precision(graded: DataFrame, verdict: str, by: list[str]) -> DataFrame:
    """Precision without skips over every combination of the columns."""
    g = graded.filter(F.col(verdict) != "skip").cube(*by).agg(F.count("*").alias("n"), F.count(F.when(F.col(verdict) == "correct", 1)).alias("correct"))
    return g.withColumn("precision", F.round(F.col("correct") / F.col("n"), 6))


def latency(df: DataFrame, by: list[str], ms: str, ok: Column) -> DataFrame:
    """(by, n, p50, p95, ok_rate); percentiles are exact."""
    return df.groupBy(*by).agg(F.count("*").alias("n"), F.round(F.percentile(ms, F.lit(0.5)), 6).alias("p50"), F.round(F.percentile(ms, F.lit(0.95)), 6).alias("p95"), F.round(F.avg(ok.cast("double")), 6).alias("ok_rate"))


def spread(df: DataFrame, by: list[str], value: str) -> DataFrame:
    """Mean and population standard deviation; the latter is null for fewer than two values."""
    return df.groupBy(*by).agg(F.count(value).alias("n"), F.round(F.avg(value), 6).alias("mean"), F.when(F.count(value) > 1, F.round(F.stddev_pop(value), 6)).alias("sd"))


def suite(results: DataFrame, expected: DataFrame, tiers: DataFrame, k: int = 10) -> DataFrame:
    """A row for each probe of a golden set: hits, expected, recall, duplicates, share of top venues, mean citations, p95 latency.

    results (probe, id, rank, paper, cites, ms), expected (probe, id), tiers (paper, tier).
    """
    top = results.filter(F.col("rank") <= k)
    held = top.join(expected.select("probe", "id", F.lit(1).alias("_hit")), ["probe", "id"], "left").join(tiers, "paper", "left")
    per = held.groupBy("probe").agg(
        F.count("_hit").alias("hits"), (F.count("*") - F.countDistinct("paper")).alias("duplicates"), F.round(F.avg((F.coalesce("tier", F.lit(9)) == 1).cast("double")), 6).alias("top_share"),
        F.round(F.avg("cites"), 6).alias("mean_cites"), F.round(F.percentile("ms", F.lit(0.95)), 6).alias("p95"),
    )
    wanted = expected.groupBy("probe").agg(F.count("*").alias("expected"))
    return wanted.join(per, "probe", "left").select("probe", F.coalesce("hits", F.lit(0)).alias("hits"), "expected", F.round(F.coalesce("hits", F.lit(0)) / F.col("expected"), 6).alias("recall"), F.coalesce("duplicates", F.lit(0)).alias("duplicates"), "top_share", "mean_cites", "p95")


#: Sentences that carry a measured value or a named amount are specific.
SPECIFIC = r"[0-9]"


def answer_metrics(sentences: DataFrame, known: DataFrame, as_of: int) -> DataFrame:
    """A row for each answer: cited, existing (cited papers that are known), specific, grounded, grounded_share, recency, overlap.

    sentences (answer, pos, text, dois, inside), inside where the sentence stands in an evidence section; a specific
    sentence is grounded if it cites a known paper itself or stands in such a section after one that does. known (doi,
    year). overlap is the largest share of an answer's citations that another answer has too:
    all of them where another answer cites the same papers, so only answers whose set of papers is their own are compared,
    and with each set once.
    """
    cites = sentences.select("answer", "pos", F.explode("dois").alias("doi")).join(known, "doi", "left")
    per = cites.select("answer", "doi", "year").distinct().groupBy("answer").agg(F.count("*").alias("cited"), F.count("year").alias("existing"), F.round(F.avg(F.lit(as_of) - F.col("year")), 6).alias("recency"))
    good = cites.groupBy("answer", "pos").agg(F.max(F.col("year").isNotNull().cast("int")).alias("good"))
    marked = sentences.select("answer", "pos", "inside", F.col("text").rlike(SPECIFIC).alias("specific")).join(good, ["answer", "pos"], "left").withColumn("good", F.coalesce("good", F.lit(0)))
    before = F.max("good").over(W.partitionBy("answer").orderBy("pos").rowsBetween(W.unboundedPreceding, 0))
    marked = marked.withColumn("grounded", F.col("specific") & ((F.col("good") == 1) | F.col("inside") & (before == 1)))
    told = marked.groupBy("answer").agg(F.count(F.when(F.col("specific"), 1)).alias("specific"), F.count(F.when(F.col("grounded"), 1)).alias("grounded"))
    own = cites.select("answer", "doi").dropna().distinct().groupBy("answer").agg(F.array_sort(F.collect_list("doi")).alias("dois"))
    kinds = own.groupBy("dois").agg(F.count("*").alias("k"), F.min("answer").alias("kind"))
    each = lambda x, name: x.select(F.col("kind").alias(name), F.explode("dois").alias("doi"))
    shared = each(kinds.filter("k = 1"), "answer").join(each(kinds, "other"), "doi").filter("answer <> other").groupBy("answer", "other").agg(F.count("*").alias("n"))
    alike = own.join(kinds.filter("k > 1").select("dois"), "dois").select("answer", F.size("dois").cast("long").alias("shared"))  # another answer has all of them
    most = shared.groupBy("answer").agg(F.max("n").alias("shared")).unionByName(alike)
    out = told.join(per, "answer", "left").join(most, "answer", "left")
    zero = lambda c: F.coalesce(c, F.lit(0))
    return out.select("answer", zero("cited").alias("cited"), zero("existing").alias("existing"), "specific", "grounded", F.when(F.col("specific") > 0, F.round(F.col("grounded") / F.col("specific"), 6)).alias("grounded_share"), "recency", F.when(F.col("cited") > 0, F.round(zero("shared") / F.col("cited"), 6)).alias("overlap"))


def section_flags(sentences: DataFrame, doc: str, pos: str, heading: Column) -> DataFrame:
    """Adds `inside`: whether a heading came before the sentence in its document, as a running maximum."""
    return sentences.withColumn("inside", F.max(heading.cast("int")).over(W.partitionBy(doc).orderBy(pos).rowsBetween(W.unboundedPreceding, 0)) == 1)


def stage_profile(marks: DataFrame, run: str, stage: str, at: str) -> DataFrame:
    """(stage, n, median): time since the run's previous mark."""
    delta = F.col(at) - F.lag(at).over(W.partitionBy(run).orderBy(at))
    return marks.withColumn("delta", delta).filter("delta IS NOT NULL").groupBy(stage).agg(F.count("*").alias("n"), F.round(F.percentile("delta", F.lit(0.5)), 6).alias("median"))


def pool(lists: list[DataFrame], depth: int) -> DataFrame:
    """(probe, id) that any list has among its first `depth`."""
    out = None
    for x in lists:
        one = x.filter(F.col("rank") <= depth).select("probe", "id")
        out = one if out is None else out.union(one)
    return out.distinct()
