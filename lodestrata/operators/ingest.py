"""Ingest: upserts, discovery, routing, resumption, lookups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def upsert(base: DataFrame, changes: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The last row of each key in the order of columns; base rows are older than changes of an equal order.

    One aggregate with a map-side combine: the whole row is the payload of a maximum.
    """
    columns = base.columns
    rows = base.withColumn("_new", F.lit(0)).unionByName(changes.select(*columns).withColumn("_new", F.lit(1)))
    rest = [c for c in columns if c not in keys]
    last = rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*order, "_new")).alias("_r"))
    return last.select(*keys, "_r.*").select(*columns)


def keep_first(base: DataFrame, changes: DataFrame, keys: list[str]) -> DataFrame:
    """base, and changes whose key it lacks."""
    return base.unionByName(changes.select(*base.columns).join(base.select(*keys), keys, "left_anti"))


def discover(sources: list[DataFrame], existing: DataFrame, key: str, abstract: str, cites: str) -> DataFrame:
    """One row per lower-cased key over several sources, those with an abstract first, then the earlier source; not existing ones; with an abstract; by citations."""
    rows = None
    for i, s in enumerate(sources):
        one = s.withColumns({"_k": F.lower(key), "_i": F.lit(i)})
        rows = one if rows is None else rows.unionByName(one, allowMissingColumns=True)
    new = rows.join(existing.select(F.lower(key).alias("_k")), "_k", "left_anti")
    columns = [c for c in new.columns if c != "_k"]
    empty = F.coalesce(F.trim(abstract), F.lit("")) == ""
    best = new.groupBy("_k").agg(F.min_by(F.struct(*columns), F.struct(empty.cast("int"), "_i", key)).alias("r")).select("r.*")
    return best.filter(F.coalesce(F.trim(abstract), F.lit("")) != "").drop("_i").orderBy(F.desc(cites), key)


def route(df: DataFrame, has_full: Column, abstract: Column, least: int) -> DataFrame:
    """Adds route (full, abstract, dropped) and reason."""
    n = F.length(F.trim(F.coalesce(abstract, F.lit(""))))
    return df.withColumns({
        "route": F.when(has_full, "full").when(n >= least, "abstract").otherwise("dropped"),
        "reason": F.when(has_full, F.lit(None)).when(n >= least, F.lit(None)).when(n == 0, "no abstract").otherwise("short abstract"),
    })


def unseen(df: DataFrame, done: DataFrame, key: str, ready: DataFrame | None = None) -> DataFrame:
    """Rows whose key isn't done and, if given, is ready."""
    out = df.join(done.select(key), key, "left_anti")
    return out.join(ready.select(key), key, "left_semi") if ready is not None else out


def latest_status(ledger: DataFrame, job: str, at: str) -> DataFrame:
    """The last status of each job."""
    return ledger.groupBy(job).agg(F.max_by(F.struct(*[c for c in ledger.columns if c != job]), F.col(at)).alias("r")).select(job, "r.*")


def cache_key(*parts: Column) -> Column:
    return F.sha2(F.to_json(F.struct(*[p.alias(f"p{i}") for i, p in enumerate(parts)])), 256)


def lookup(df: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    """Rows of the given keys, ignoring case."""
    return df.withColumn("_k", F.lower(key)).join(keys.select(F.lower(key).alias("_k")).distinct(), "_k", "left_semi").drop("_k")


def export(df: DataFrame, since: Column | None, order: list[Column], limit: int, offset: int = 0) -> DataFrame:
    """A page of rows with the total of those that match."""
    rows = df.filter(since) if since is not None else df
    total = rows.agg(F.count("*").alias("total"))
    return rows.crossJoin(F.broadcast(total)).orderBy(*order).offset(offset).limit(limit)  # total: one row


def table_counts(tables: dict[str, DataFrame]) -> DataFrame:
    out = None
    for name, df in tables.items():
        one = df.agg(F.lit(name).alias("name"), F.count("*").alias("n"))
        out = one if out is None else out.unionByName(one)
    return out


def range_join(points: DataFrame, at: str, spans: DataFrame, start: str, end: str, width: int) -> DataFrame:
    """Points in half-open spans [start, end), in seconds: spans are cut into buckets of `width`, so the join is an equality with a condition."""
    bucketed = spans.withColumn("_b", F.explode(F.sequence(F.floor(F.col(start) / width), F.floor((F.col(end) - 1) / width))))
    return points.withColumn("_b", F.floor(F.col(at) / width)).join(bucketed, "_b").filter((F.col(at) >= F.col(start)) & (F.col(at) < F.col(end))).drop("_b")
