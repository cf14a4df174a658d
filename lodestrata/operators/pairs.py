"""Pairwise conflict, matching and near-duplicate detection. Always blocked; conditions are part of the joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lodestrata.operators.blocks import bit_overlaps

# Opposing cue words.
OPPOSING = (
    (("high", "increase", "increased", "increases", "enhance", "enhanced", "stable", "retain", "retained", "excellent", "superior", "effective", "efficient"), ("low", "decrease", "decreased", "decreases", "degrade", "degraded", "unstable", "lose", "lost", "poor", "inferior", "ineffective", "inefficient")),
    (("improve", "improved", "promotes", "facilitates", "accelerate"), ("worsen", "worsened", "inhibits", "hinders", "decelerate")),
    (("positive", "beneficial", "favorable"), ("negative", "detrimental", "unfavorable")),
)
# Kinds and words that make a claim surprising.
RARE_KINDS = {"surprising_finding": 10, "limitation": 10, "hypothesis": 10, "future_direction": 5}
SURPRISE_WORDS = ("surprisingly", "unexpectedly", "contrary to", "unprecedented", "first report", "first example", "never before", "counterintuitive", "remarkable", "striking", "anomalous")
NOVELTY_WORDS = ("novel", "new class", "first-in-class", "breakthrough", "paradigm", "record-breaking", "state-of-the-art")


def self_pairs(df: DataFrame, block: list[str], id_col: str, columns: list[str]) -> tuple[DataFrame, DataFrame, Column]:
    """Both sides of a blocked self-join and its condition (blocks equal, id of a < id of b)."""
    a = df.select(*[F.col(b).alias(f"a_{b}") for b in block], F.col(id_col).alias("a_id"), *[F.col(c).alias(f"a_{c}") for c in columns])
    b = df.select(*[F.col(x).alias(f"b_{x}") for x in block], F.col(id_col).alias("b_id"), *[F.col(c).alias(f"b_{c}") for c in columns])
    on = F.col("a_id") < F.col("b_id")
    for x in block:
        on = on & (F.col(f"a_{x}") == F.col(f"b_{x}"))
    return a, b, on


def numeric_conflicts(df: DataFrame, block: list[str], id_col: str, source: str, value: str, least: float = 20.0) -> DataFrame:
    """Pairs of a block from different sources whose values differ by at least `least`."""
    a, b, on = self_pairs(df, block, id_col, [source, value])
    diff = F.abs(F.col(f"a_{value}") - F.col(f"b_{value}"))
    return a.join(b, on & (F.col(f"a_{source}") != F.col(f"b_{source}")) & (diff >= least)).withColumn("diff", F.round(diff, 6))


def relative_conflicts(df: DataFrame, block: list[str], id_col: str, source: str, value: str, least: float = 20.0) -> DataFrame:
    """The same by |a - b| / max(|a|, |b|, 1) in percent."""
    a, b, on = self_pairs(df, block, id_col, [source, value])
    x, y = F.col(f"a_{value}"), F.col(f"b_{value}")
    diff = F.abs(x - y) / F.greatest(F.abs(x), F.abs(y), F.lit(1.0)) * 100
    return a.join(b, on & (F.col(f"a_{source}") != F.col(f"b_{source}")) & (diff >= least)).withColumn("percent", F.round(diff, 6))


def candidate_pairs(df: DataFrame, block: list[str], id_col: str, source: str, members: int = 100, pairs: int = 500) -> DataFrame:
    """Pairs of different sources in a block: its first `members` and at most `pairs` of them, which is the operator's contract."""
    first = df.withColumn("_rn", F.row_number().over(W.partitionBy(*block).orderBy(id_col))).filter(F.col("_rn") <= members)
    a, b, on = self_pairs(first, block, id_col, [source])
    found = a.join(b, on & (F.col(f"a_{source}") != F.col(f"b_{source}")))
    keys = [f"a_{x}" for x in block]
    return found.withColumn("rn", F.row_number().over(W.partitionBy(*keys).orderBy("a_id", "b_id"))).filter(F.col("rn") <= pairs)


def pair_estimate(df: DataFrame, block: list[str], source: str, most: int = 20) -> DataFrame:
    """(block, n, n_sources, pairs, capped) without making a pair: (n^2 - sum of squares by source) / 2."""
    per = df.groupBy(*block, source).agg(F.count("*").alias("k"))
    g = per.groupBy(*block).agg(F.sum("k").alias("n"), F.count("*").alias("n_sources"), F.sum(F.col("k") * F.col("k")).alias("sq"))
    return g.withColumn("pairs", F.expr("(n * n - sq) div 2")).withColumn("capped", F.least("pairs", F.lit(most))).drop("sq")


def cue_conflict(a: Column, b: Column) -> Column:
    """Number of opposing cue families with one side in either text."""
    words = lambda c: F.regexp_extract_all(F.lower(F.coalesce(c, F.lit(""))), F.lit("[a-z][a-z0-9_+-]*"), F.lit(0))
    x, y = words(a), words(b)
    lit = lambda ws: F.array(*map(F.lit, ws))
    hit = [(F.arrays_overlap(x, lit(p)) & F.arrays_overlap(y, lit(n))) | (F.arrays_overlap(x, lit(n)) & F.arrays_overlap(y, lit(p))) for p, n in OPPOSING]
    return sum((h.cast("int") for h in hit[1:]), hit[0].cast("int"))


def stored_conflicts(pairs: DataFrame, claims: DataFrame, id_col: str, columns: list[str]) -> DataFrame:
    """Pairs (a_id, b_id, ...) with both sides' columns; a side that is gone stays as null."""
    for side in ("a", "b"):
        own = claims.select(F.col(id_col).alias(f"{side}_id"), *[F.col(c).alias(f"{side}_{c}") for c in columns])
        pairs = pairs.join(own, f"{side}_id", "left")
    return pairs


def surprise(df: DataFrame, siblings: list[Column], kind: Column, outcome: Column, year: Column, as_of: int, quote: Column) -> DataFrame:
    """Adds structural (0-40), temporal (0-30), content (0-30) and their sum, as `surprise`."""
    sparse = sum((F.when(s <= 3, 10).when(s <= 10, 5).otherwise(0) for s in siblings), F.lit(0))
    rare = F.lit(0)
    for name, points in RARE_KINDS.items():
        rare = F.when(kind == name, points).otherwise(rare)
    outlier = F.when(outcome > 99, 5).when(outcome < 10, 8).otherwise(0)
    structural = F.least(sparse + rare + F.coalesce(outlier, F.lit(0)), F.lit(40))
    temporal = F.when(year >= as_of, 15).when(year >= as_of - 1, 10).when(year >= as_of - 2, 5).otherwise(0)
    low = F.lower(F.coalesce(quote, F.lit("")))
    said = lambda words: F.array_contains(F.transform(F.array(*map(F.lit, words)), lambda w: F.contains(low, w)), True)
    content = F.when(kind == "surprising_finding", 20).otherwise(0) + F.when(said(SURPRISE_WORDS), 5).otherwise(0) + F.when(said(NOVELTY_WORDS), 5).otherwise(0)
    content = F.least(content, F.lit(30))
    return df.withColumns({"structural": structural, "temporal": temporal, "content": content}).withColumn("surprise", F.col("structural") + F.col("temporal") + F.col("content"))


def token_pairs(df: DataFrame, id_col: str, words: Column, block: str, least: float) -> DataFrame:
    """(a, b, jaccard) of a block by token sets; sizes are tested before sets."""
    rows = df.select(F.col(id_col).alias("id"), F.col(block).alias("block"), F.array_distinct(words).alias("w")).filter(F.size("w") > 0)
    a = rows.select(F.col("id").alias("a"), "block", F.col("w").alias("wa"))
    b = rows.select(F.col("id").alias("b"), F.col("block").alias("block2"), F.col("w").alias("wb"))
    n = F.size(F.array_intersect("wa", "wb"))
    j = n / (F.size("wa") + F.size("wb") - n)
    near = F.least(F.size("wa"), F.size("wb")) >= least * F.greatest(F.size("wa"), F.size("wb"))
    return a.join(b, (F.col("block") == F.col("block2")) & (F.col("a") < F.col("b")) & near & (j >= least)).select("a", "b", F.round(j, 6).alias("jaccard"))


def bit_tanimoto(a: Column, b: Column) -> Column:
    """Tanimoto similarity of two bit strings held as longs."""
    both, either = F.bit_count(a.bitwiseAND(b)), F.bit_count(a.bitwiseOR(b))
    return F.when(either > 0, both / either).otherwise(0.0)


def fingerprint_pairs(df: DataFrame, id_col: str, bits: str, block: str, least: float) -> DataFrame:
    """(a, b, similarity) of a block. Common bits are counted by matrix products of two parts of a block at a time."""
    rows = df.select(F.col(id_col).alias("id"), F.col(bits).alias("v"), F.col(block).alias("block"))
    found = bit_overlaps(rows, least - 1e-6)  # rounded and tested below
    similar = F.round(F.when(F.col("either") > 0, F.col("both") / F.col("either")).otherwise(0.0), 6)
    return found.select("a", "b", similar.alias("similarity")).filter(F.col("similarity") >= least)


def contained_items(docs: DataFrame, items: DataFrame, doc_col: str, item_col: str, text_col: str = "text") -> DataFrame:
    """(doc, item): documents whose text holds an item's text as it is, letter by letter.

    Words inside an item, which are whole in any document that holds it, are its key (up to four of them), met by hash;
    ids alone are joined and the texts compared at the end. An item of one or two words has no word inside: it is
    compared with every document, so keep such items few.
    """
    split = lambda c: F.split(c, r"[ \n]+")
    keyed = items.select(F.col(item_col).alias("item"), F.col(text_col).alias("held")).filter(F.length("held") > 0).withColumn("w", split(F.col("held")))
    keyed = keyed.withColumn("size", F.least(F.lit(4), F.size("w") - 2))
    long, short = keyed.filter("size > 0"), keyed.filter("size <= 0").select("item", "held")
    key = F.xxhash64(F.array_join(F.slice("w", F.lit(2), F.col("size")), " "))
    w = docs.select(F.col(doc_col).alias("doc"), split(F.col(text_col)).alias("w"))
    none = F.array().cast("array<struct<size:int,key:bigint>>")

    def runs(k: int) -> Column:
        each = F.transform(F.sequence(F.lit(1), F.size("w") - k + 1), lambda i: F.struct(F.lit(k).alias("size"), F.xxhash64(F.array_join(F.slice("w", i, k), " ")).alias("key")))
        return F.when(F.size("w") >= k, each).otherwise(none)

    sizes = [r["size"] for r in long.select("size").distinct().collect()]  # four at most
    at = w.select("doc", F.explode(F.concat(*map(runs, sizes)) if sizes else none).alias("x")).select("doc", "x.*")
    met = at.join(long.select("item", F.col("size"), key.alias("key")), ["size", "key"]).select("doc", "item").distinct()
    texts = docs.select(F.col(doc_col).alias("doc"), F.col(text_col).alias("text"))
    whole = met.join(long.select("item", "held"), "item").join(texts, "doc").filter(F.contains("text", F.col("held"))).select("doc", "item")
    return whole.unionByName(texts.join(short, F.contains("text", F.col("held"))).select("doc", "item")).distinct()


def greedy_match(scores: DataFrame, group: str) -> DataFrame:
    """One-to-one matches of a group by falling score (group, gold, found, score); a group is one document's candidates.

    Ties go to the smaller gold, then found id.
    """

    def pick(rows):
        rows = rows.sort_values(["score", "gold", "found"], ascending=[False, True, True])
        gold, found, keep = set(), set(), []
        for i, r in zip(rows.index, rows.itertuples(), strict=True):
            if r.gold not in gold and r.found not in found:
                gold.add(r.gold)
                found.add(r.found)
                keep.append(i)
        return rows.loc[keep]

    return scores.groupBy(group).applyInPandas(pick, scores.schema)


def field_accuracy(gold: Column, found: Column, ratio: Column) -> Column:
    """correct, partial or wrong: numbers within one percent, strings by a similarity of 0.8 and 0.5."""
    x, y = gold.try_cast("double"), found.try_cast("double")
    number = x.isNotNull() & y.isNotNull()
    return F.when(number, F.when(F.abs(x - y) <= 0.01 * F.greatest(F.abs(x), F.lit(1e-9)), "correct").otherwise("wrong")).when(ratio > 0.8, "correct").when(ratio > 0.5, "partial").otherwise("wrong")


def greedy_clusters(counts: DataFrame, similar: float = 0.85) -> DataFrame:
    """(block, label, cluster): labels by falling count join the first cluster they are like: equal but for a plural s, or a token similarity.

    A label is compared with every cluster of its block, and a block is one task: give blocks that hold a vocabulary.
    """

    def run(rows):
        import pandas as pd

        heads: list[tuple[str, frozenset]] = []
        out = []
        for r in rows.sort_values(["n", "label"], ascending=[False, True]).itertuples():
            words = frozenset(r.label.split("_"))
            home = None
            for head, held in heads:
                j = len(words & held) / len(words | held)
                if r.label.rstrip("s") == head.rstrip("s") or j >= similar or (j >= 0.7 and (words < held or held < words)):
                    home = head
                    break
            if home is None:
                home = r.label
                heads.append((r.label, words))
            out.append((r.block, r.label, home))
        return pd.DataFrame(out, columns=["block", "label", "cluster"])

    return counts.groupBy("block").applyInPandas(run, "block string, label string, cluster string")
