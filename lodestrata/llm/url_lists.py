r"""URL filters by a temporal list join.

Dated list entries (add or remove a pattern) become validity intervals; an as-of join then evaluates every capture
against the entries that were active when it was fetched. A pattern is a host, a domain (which covers its sub-domains)
or a prefix of host and path; a capture looks for each of the keys that could match it, so the join is an equality with
an interval condition and never a scan of the list.

DataFrame expressions only. Captures aren't moved while the list is of a checked size; a larger list is joined by a
shuffle in which keys that hold over 1/HOT_SHARE of all rows (a host with a third of the captures) are kept apart.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from lodestrata.llm.runtime import BROADCAST_IDS, HOT_SHARE, written

#: Kinds of patterns.
SCOPES = ("host", "domain", "prefix")


def host_of(url: Column) -> Column:
    """Lower-cased host without user, port and trailing dot; empty if there is none."""
    rest = F.regexp_extract(F.lower(F.trim(F.coalesce(url.cast("string"), F.lit("")))), r"^(?:[a-z][a-z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]*)", 1)
    return F.regexp_replace(rest, r"\.$", "")


def path_of(url: Column) -> Column:
    """The path as it is, without query and fragment."""
    return F.regexp_extract(F.trim(F.coalesce(url.cast("string"), F.lit(""))), r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//[^/?#]*(/[^?#]*)", 1)


def keys_of(host: Column, path: Column) -> Column:
    """Every key under which an entry could match: host:h, domain:d for each d of two labels or more, prefix:h/a/b/ for each depth."""
    labels = F.split(host, r"\.")
    domains = F.when(F.size(labels) >= 2, F.transform(F.sequence(F.lit(1), F.size(labels) - 1), lambda i: F.concat(F.lit("domain:"), F.array_join(F.slice(labels, i, F.size(labels)), ".")))).otherwise(F.array().cast("array<string>"))
    parts = F.split(path, "/")
    prefixes = F.transform(F.sequence(F.lit(1), F.greatest(F.size(parts) - 1, F.lit(1))), lambda i: F.concat(F.lit("prefix:"), host, F.array_join(F.slice(parts, 1, i), "/"), F.lit("/")))
    return F.when(host == "", F.array().cast("array<string>")).otherwise(F.array_distinct(F.concat(F.array(F.concat(F.lit("host:"), host)), domains, prefixes)))


def intervals(entries: DataFrame) -> DataFrame:
    """(list, key, valid_from, valid_to) from dated entries (list, scope, pattern, action, at).

    Entries of a pattern are read in order of `at`; on one day a removal comes last. Repeated additions change nothing,
    nor do removals of what isn't listed. valid_to is exclusive and null while the entry is still active. Entries with a
    null, an unknown scope or an unknown action are left out.
    """
    known = entries.select("list", "scope", F.lower("pattern").alias("pattern"), "action", F.col("at").cast("date").alias("at")).dropna()
    known = known.filter(F.col("scope").isin(*SCOPES) & F.col("action").isin("add", "remove"))
    days = known.groupBy("list", "scope", "pattern", "at").agg(F.max("action").alias("action"))  # remove > add
    turn = W.partitionBy("list", "scope", "pattern").orderBy("at")
    changes = days.withColumn("was", F.coalesce(F.lag("action").over(turn), F.lit("remove"))).filter(F.col("was") != F.col("action"))
    ends = changes.withColumn("valid_to", F.lead("at").over(turn)).filter(F.col("action") == "add")
    return ends.select("list", F.concat_ws(":", "scope", "pattern").alias("key"), F.col("at").alias("valid_from"), "valid_to")


def evaluate(captures: DataFrame, entries: DataFrame) -> DataFrame:
    """One row per row of captures (page_id, url, fetched): page_id, host, fetched, n_active, lists, blocked.

    lists are the names of lists with an entry that was active at `fetched`, sorted and comma-joined. A capture without a
    host or a fetch date matches nothing. Rows with the same page_id, url and fetch date are one row with their number in
    n_captures; a null page_id is a value like any other. Empty tables give no rows or no matches; other columns are
    ignored.
    """
    active = written(intervals(entries), "list-intervals")
    rows = captures.select(F.col("page_id").cast("long").alias("page_id"), host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"), F.col("fetched").cast("date").alias("fetched"))
    rows = rows.groupBy("page_id", "host", "path", "fetched").agg(F.count("*").alias("n_captures"))
    keyed = rows.withColumn("key", F.explode_outer(keys_of(F.col("host"), F.col("path"))))
    side = active.withColumnRenamed("key", "pattern_key")
    match = lambda a, b: (a["key"] == b["pattern_key"]) & (a["fetched"] >= b["valid_from"]) & (b["valid_to"].isNull() | (a["fetched"] < b["valid_to"]))
    if active.count() <= BROADCAST_IDS:
        side = F.broadcast(side)
        found = keyed.join(side, match(keyed, side), "left")
    else:
        keyed = written(keyed, "list-keys")
        total = keyed.count()
        hot = keyed.groupBy("key").count().filter(F.col("count") * HOT_SHARE > total).select(F.col("key").alias("pattern_key"))
        hot_side = side.join(F.broadcast(hot), "pattern_key", "left_semi")
        many = hot_side.groupBy("pattern_key").count().agg(F.coalesce(F.max("count"), F.lit(0))).first()[0]
        if many * HOT_SHARE > BROADCAST_IDS:  # a hot pattern with a very long history: AQE splits its partition
            found = keyed.join(side.hint("shuffle_merge"), match(keyed, side), "left")
        else:
            cold_side = side.join(F.broadcast(hot), "pattern_key", "left_anti")
            is_hot = keyed.join(F.broadcast(hot), keyed["key"] == hot["pattern_key"], "left_semi")
            is_cold = keyed.join(F.broadcast(hot), keyed["key"] == hot["pattern_key"], "left_anti")
            hot_side = F.broadcast(hot_side)
            cold_side = cold_side.hint("shuffle_merge")
            found = is_hot.join(hot_side, match(is_hot, hot_side), "left").unionByName(is_cold.join(cold_side, match(is_cold, cold_side), "left"))
    out = found.groupBy("page_id", "host", "path", "fetched", "n_captures").agg(F.count("pattern_key").alias("n_active"), F.array_join(F.array_sort(F.collect_set("list")), ",").alias("lists"))
    return out.select("page_id", "host", "path", "fetched", "n_captures", "n_active", "lists", (F.col("n_active") > 0).alias("blocked"))
