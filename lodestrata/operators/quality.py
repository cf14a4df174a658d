"""Validation, quality scores and audit reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Controlled vocabularies.
CLAIM_TYPES = ("reaction", "property", "method", "mechanism", "comparison", "scope_entry", "computational_result", "structure", "hypothesis", "experimental_design", "limitation", "future_direction", "surprising_finding", "conclusion", "conclusions")
CONFIDENCE = ("high", "medium", "low")


def issue(cond: Column, field: str, message: str, severity: str = "error") -> Column:
    return F.when(cond, F.struct(F.lit(field).alias("field"), F.lit(message).alias("message"), F.lit(severity).alias("severity")))


def blank(c: Column) -> Column:
    return c.isNull() | (F.trim(c.cast("string")) == "")


def required(field: str, c: Column) -> Column:
    return issue(blank(c), field, f"Missing {field}")


def one_of(field: str, c: Column, allowed: tuple[str, ...], severity: str = "error") -> Column:
    return issue(~blank(c) & ~c.isin(*allowed), field, f"Invalid {field}", severity)


def in_range(field: str, c: Column, low: float, high: float) -> Column:
    number = F.regexp_replace(F.trim(c.cast("string")), "%+$", "").try_cast("double")
    return F.coalesce(issue(~blank(c) & number.isNull(), field, "Expected a number", "warning"), issue(number.isNotNull() & ~number.between(low, high), field, f"Outside {low:g} to {high:g}", "warning"))


def grounded(quote: Column, locator: Column) -> Column:
    return F.coalesce(
        issue(blank(quote) & blank(locator), "verbatim_quote", "Missing source grounding"),
        issue(blank(quote), "verbatim_quote", "Grounded by the locator instead", "warning"),
        issue(F.length(quote) < 10, "verbatim_quote", "Very short quote", "warning"),
    )


def validate(df: DataFrame, checks: list[Column], strict: bool = False) -> DataFrame:
    """Adds issues (array of field, message, severity) and valid; strict takes warnings as errors."""
    out = df.withColumn("issues", F.array_compact(F.array(*checks)))
    bad = F.size("issues") > 0 if strict else F.exists("issues", lambda i: i["severity"] == "error")
    return out.withColumn("valid", ~bad)


def validation_summary(validated: DataFrame) -> DataFrame:
    """(field, severity, n) and rows for totals: field '' with valid, invalid and warnings_only."""
    per = validated.select(F.explode("issues").alias("i")).groupBy("i.field", "i.severity").agg(F.count("*").alias("n"))
    state = F.when(~F.col("valid"), "invalid").when(F.size("issues") > 0, "warnings_only").otherwise("clean")
    total = validated.groupBy(state.alias("severity")).agg(F.count("*").alias("n")).select(F.lit("").alias("field"), "severity", "n")
    return per.unionByName(total)


def shares(df: DataFrame, by: list[str], flags: dict[str, Column]) -> DataFrame:
    """(by, n, each flag's count and share)."""
    counts = [F.count(F.when(c, 1)).alias(name) for name, c in flags.items()]
    g = df.groupBy(*by).agg(F.count("*").alias("n"), *counts)
    return g.select(*by, "n", *flags, *[F.round(F.col(name) / F.col("n"), 6).alias(f"{name}_share") for name in flags])


def paper_score(flags: list[tuple[Column, float]]) -> Column:
    """Weighted sum of flags."""
    return F.round(sum((F.when(c, w).otherwise(0.0) for c, w in flags), F.lit(0.0)), 6)


def value_score(df: DataFrame, cites: Column, claims: Column, kinds: Column, weight: Column, keywords: Column, flags: dict[str, Column]) -> DataFrame:
    """Adds score, tier, style and reasons. flags: open_access, venue, review, software, nonpaper, no_abstract."""
    part = lambda c, most, points: F.least(c / most, F.lit(1.0)) * points
    points = {"open_access": 8, "venue": 5, "review": -28, "software": -10, "nonpaper": -35, "no_abstract": -6}
    total = part(F.log10(cites + 1), 4.0, 25) + part(claims, 12.0, 18) + part(kinds, 6.0, 12) + part(weight, 16.0, 22) + part(keywords, 5.0, 15)
    for name, p in points.items():
        total = total + F.when(flags[name], p).otherwise(0)
    score = F.round(F.greatest(total, F.lit(0.0)), 2)
    reasons = [
        F.when(cites >= 200, "cited"), F.when(claims >= 8, "many claims"), F.when(kinds >= 4, "many kinds"), F.when(weight >= 8, "experimental"),
        F.when(keywords >= 3, "keywords"), *[F.when(flags[n], n) for n in points],
    ]
    style = F.when(flags["nonpaper"], "nonpaper_or_book").when(flags["review"], "review_or_perspective").when(flags["software"], "software_or_reference").otherwise("primary_research")
    tier = F.when(F.col("score") >= 60, "high_value").when(F.col("score") >= 42, "valuable").when(F.col("score") >= 28, "maybe").otherwise("low_value")
    return df.withColumn("score", score).withColumns({"tier": tier, "style": style, "reasons": F.array_compact(F.array(*reasons))})


def relevance(category: Column, scores: dict[str, int], text: Column, pattern: str) -> Column:
    """Points of the category plus keyword hits, three at most."""
    points = F.lit(0)
    for name, p in scores.items():
        points = F.when(category == name, p).otherwise(points)
    return points + F.least(F.regexp_count(text, F.lit(pattern)), F.lit(3))


def tier(rel: Column, cites: Column) -> Column:
    return F.when((cites >= 50) & (rel >= 5), 1).when(((cites >= 10) & (rel >= 5)) | ((cites >= 50) & (rel >= 2)), 2).when((rel >= 4) | ((cites >= 10) & (rel >= 2)), 3).otherwise(4)


def reading_tier(cites: Column, year: Column, as_of: int) -> Column:
    return F.when(cites > 50, "Foundational").when((cites >= 10) | ((year >= as_of - 2) & (cites >= 3)), "Key Results").otherwise("Recent Advances")


def reading_list(papers: DataFrame, tier_col: str, order: list[Column], limit: int = 15, tiers: int = 3) -> DataFrame:
    from lodestrata.operators.rank import top_per

    return top_per(papers, tier_col, order, max(3, limit // tiers))


def votes(df: DataFrame, item: str, vote: str, user: str, me: object) -> DataFrame:
    """(item, up, down, mine): counts of each item, and the user's own vote."""
    return df.groupBy(item).agg(F.count(F.when(F.col(vote) > 0, 1)).alias("up"), F.count(F.when(F.col(vote) < 0, 1)).alias("down"), F.max(F.when(F.col(user) == me, F.col(vote))).alias("mine"))


def gates(report: DataFrame, limits: dict[str, float]) -> DataFrame:
    """(gate, value, limit, passed) of a one-row report."""
    kinds = [F.struct(F.lit(k).alias("gate"), F.col(k).cast("double").alias("value"), F.lit(float(v)).alias("limit")) for k, v in limits.items()]
    out = report.select(F.explode(F.array(*kinds)).alias("g")).select("g.*")
    return out.withColumn("passed", F.col("value") <= F.col("limit"))


def enforce(gated: DataFrame) -> None:
    """Raises if a gate failed."""
    failed = gated.filter("NOT passed").collect()  # a row for each gate
    if failed:
        raise AssertionError("; ".join(f"{r['gate']}: {r['value']:g} > {r['limit']:g}" for r in failed))


def coverage(expected: DataFrame, present: DataFrame, key: str, group: str) -> DataFrame:
    """(group, expected, present, share) of keys."""
    seen = present.select(key).distinct().withColumn("_in", F.lit(1))
    g = expected.join(seen, key, "left").groupBy(group).agg(F.count("*").alias("expected"), F.count("_in").alias("present"))
    return g.withColumn("share", F.round(F.col("present") / F.col("expected"), 6))


def merge_groups(labels: DataFrame, label: str, key: Column) -> DataFrame:
    """(key, labels, id): labels of one key, where there are several; the id is a hash of the key."""
    g = labels.groupBy(key.alias("key")).agg(F.array_sort(F.collect_set(label)).alias("labels")).filter(F.size("labels") > 1)
    return g.withColumn("concept_id", F.substring(F.sha2("key", 256), 1, 16))


def report(claims: DataFrame, model: str, deep: Column, verified: Column, checked: Column, field: str, least_deep: float, least_verified: float) -> DataFrame:
    """A row for each model: claims, deep and shallow ones, verification rate among the checked, fields covered, flags.

    Flags are `shallow` and `unverified`, where a share is below its least; comma-joined.
    """
    g = claims.groupBy(model).agg(F.count("*").alias("n"), F.count(F.when(deep, 1)).alias("deep"), F.count(F.when(checked, 1)).alias("checked"), F.count(F.when(checked & verified, 1)).alias("verified"), F.countDistinct(field).alias("fields"))
    rate = F.when(F.col("checked") > 0, F.round(F.col("verified") / F.col("checked"), 6))
    share = F.round(F.col("deep") / F.col("n"), 6)
    flags = F.concat_ws(",", F.when(share < least_deep, "shallow"), F.when(F.coalesce(rate, F.lit(0.0)) < least_verified, "unverified"))
    return g.select(model, "n", "deep", (F.col("n") - F.col("deep")).alias("shallow"), share.alias("deep_share"), "checked", rate.alias("verification_rate"), "fields", flags.alias("flags"))


def venue_coverage(papers: DataFrame, venue: Column, year: Column, rules: list[tuple[str, str, int]], first: int, last: int) -> DataFrame:
    """A row for each (label, tier) of the venue rules (pattern, label, tier; the first that matches): papers, years covered from first to last, and missing years."""
    label, tier_ = F.lit("other"), F.lit(9)
    for pattern, name, level in reversed(rules):
        label, tier_ = F.when(venue.rlike(pattern), name).otherwise(label), F.when(venue.rlike(pattern), level).otherwise(tier_)
    rows = papers.select(label.alias("label"), tier_.alias("tier"), year.alias("year")).filter(F.col("year").between(first, last))
    g = rows.groupBy("label", "tier").agg(F.count("*").alias("n"), F.countDistinct("year").cast("int").alias("years"), F.min("year").alias("first"), F.max("year").alias("last"), F.collect_set("year").alias("_seen"))
    gaps = F.array_sort(F.array_except(F.sequence(F.lit(first), F.lit(last)), "_seen"))
    return g.select("label", "tier", "n", "years", "first", "last", F.array_join(gaps.cast("array<string>"), ",").alias("missing"))
