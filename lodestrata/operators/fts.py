"""Full-text search: an inverted index as a DataFrame, a small query language, and BM25."""

from __future__ import annotations

import itertools
import re
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lodestrata.functions.text import TOKEN, clean_query, tokens

#: BM25 constants.
K1, B = 1.2, 0.75


def postings(docs: DataFrame, id_col: str, text_cols: dict[str, str], keep: list[str] | None = None) -> DataFrame:
    """(id, field, pos, term): every token of every field; only `keep` terms if given, so that queries shuffle little."""
    parts = []
    for name, column in text_cols.items():
        words = docs.select(F.col(id_col).alias("id"), F.lit(name).alias("field"), F.posexplode(tokens(F.col(column))).alias("pos", "term"))
        parts.append(words)
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.filter(F.col("term").isin(keep)) if keep is not None else out


def index(docs: DataFrame, id_col: str, text_cols: dict[str, str]) -> DataFrame:
    """(term, field, id, tf, dl): the index that repeated searches read; write it partitioned or bucketed by term."""
    out = None
    for name, column in text_cols.items():
        words = docs.select(F.col(id_col).alias("id"), tokens(F.col(column)).alias("w"))
        tf = words.select("id", F.size("w").cast("long").alias("dl"), F.explode("w").alias("term")).groupBy("term", "id", "dl").agg(F.count("*").alias("tf"))
        tf = tf.select("term", F.lit(name).alias("field"), "id", "tf", "dl")
        out = tf if out is None else out.unionByName(tf)
    return out


def _held(text: Column, term: str) -> Column:
    """Whether the text has the token; it is only cut into tokens where it has the letters."""
    return F.contains(F.lower(text), F.lit(term)) & F.array_contains(tokens(text), term)


def term_frequencies(docs: DataFrame, id_col: str, text_col: str, terms: list[str]) -> DataFrame:
    """(id, dl, tf array in order of terms) of documents that hold a term: within a row, no shuffle."""
    any_ = F.lit(False)
    for t in terms:
        any_ = any_ | F.contains(F.lower(text_col), F.lit(t))
    w = docs.filter(any_).select(F.col(id_col).alias("id"), tokens(F.col(text_col)).alias("w"))

    def count(term: str) -> Column:
        return F.size(F.filter("w", lambda x: x == term)).cast("long")

    tf = F.array(*[count(t) for t in terms])
    return w.filter(F.arrays_overlap("w", F.array(*map(F.lit, terms)))).select("id", F.size("w").cast("long").alias("dl"), tf.alias("tf"))


def bm25(docs: DataFrame, id_col: str, text_col: str, terms: list[str], k1: float = K1, b: float = B) -> DataFrame:
    """(id, score), rounded to six digits, of documents that hold any term.

    Two passes over the text: corpus totals and document frequencies (one row), then scores within rows. Only texts that
    hold a term's letters are cut into tokens.
    """
    terms = list(dict.fromkeys(terms))
    text = F.col(text_col)
    dl = F.regexp_count(F.lower(F.coalesce(text, F.lit(""))), F.lit(TOKEN)).cast("long")
    counts = [F.count(F.when(_held(text, t), 1)).alias(f"df{i}") for i, t in enumerate(terms)]
    stats = docs.agg(F.count("*").alias("n"), F.avg(dl).alias("avgdl"), *counts)
    hits = term_frequencies(docs, id_col, text_col, terms).crossJoin(F.broadcast(stats))  # one row
    score = F.lit(0.0)
    for i in range(len(terms)):
        tf, df = F.get("tf", F.lit(i)), F.col(f"df{i}")
        idf = F.log(1 + (F.col("n") - df + 0.5) / (df + 0.5))
        score = score + idf * tf * (k1 + 1) / (tf + k1 * (1 - b + b * F.col("dl") / F.col("avgdl")))
    return hits.select("id", F.round(score, 6).alias("score"))


def top(scored: DataFrame, k: int, *ties: str) -> DataFrame:
    """The k best rows by score; a top-k plan, not a sort. Ties go by the named columns."""
    return scored.orderBy(F.desc("score"), *ties).limit(k)


# --- matching: each gives (id) ---------------------------------------------------------------


def match_all(docs: DataFrame, id_col: str, text_col: str, terms: list[str]) -> DataFrame:
    w = tokens(F.col(text_col))
    cond = F.lit(True)
    for t in terms:
        cond = cond & F.array_contains(w, t)
    return docs.filter(cond).select(F.col(id_col).alias("id"))


def match_any(docs: DataFrame, id_col: str, text_col: str, terms: list[str]) -> DataFrame:
    return docs.filter(F.arrays_overlap(tokens(F.col(text_col)), F.array(*map(F.lit, terms)))).select(F.col(id_col).alias("id"))


def match_prefix(docs: DataFrame, id_col: str, text_col: str, prefix: str) -> DataFrame:
    return docs.filter(F.exists(tokens(F.col(text_col)), lambda x: F.startswith(x, F.lit(prefix)))).select(F.col(id_col).alias("id"))


def match_phrase(docs: DataFrame, id_col: str, text_col: str, terms: list[str]) -> DataFrame:
    """Consecutive tokens: the tokens as one padded string holds the phrase; no positional join."""
    padded = F.concat(F.lit(" "), F.array_join(tokens(F.col(text_col)), " "), F.lit(" "))
    return docs.filter(F.contains(padded, F.lit(" " + " ".join(terms) + " "))).select(F.col(id_col).alias("id"))


def match_near(docs: DataFrame, id_col: str, text_col: str, terms: list[str], gap: int) -> DataFrame:
    """Every term within a stretch with at most `gap` tokens between the first and the last, in any order.

    Only the query's tokens are exploded; a window ends at each of them and looks back so far.
    """
    terms = list(dict.fromkeys(terms))
    reach = gap + len(terms) - 1
    at = postings(docs, id_col, {"text": text_col}, terms)
    back = W.partitionBy("id").orderBy("pos").rangeBetween(-reach, 0)
    return at.withColumn("held", F.size(F.collect_set("term").over(back))).filter(F.col("held") == len(terms)).select("id").distinct()


# --- query language ---------------------------------------------------------------------------


@dataclass(frozen=True)
class Clause:
    """kind: phrase, near, all, any or prefix."""

    kind: str
    terms: tuple[str, ...]
    gap: int = 5
    field: str = field(default="")

    def match(self, docs: DataFrame, id_col: str, fields: dict[str, str]) -> DataFrame:
        columns = [fields[self.field]] if self.field else list(fields.values())
        found = None
        for c in columns:
            one = {
                "phrase": lambda c=c: match_phrase(docs, id_col, c, list(self.terms)),
                "near": lambda c=c: match_near(docs, id_col, c, list(self.terms), self.gap),
                "all": lambda c=c: match_all(docs, id_col, c, list(self.terms)),
                "any": lambda c=c: match_any(docs, id_col, c, list(self.terms)),
                "prefix": lambda c=c: match_prefix(docs, id_col, c, self.terms[0]),
            }[self.kind]()
            found = one if found is None else found.union(one).distinct()
        return found


def compile_query(query: str, mode: str = "auto", synonyms: dict[str, list[str]] | None = None) -> list[Clause]:
    """Clauses from the strictest to the loosest: phrase, near, all, combinations of three (four words or more), singular, prefix (one word), synonyms."""
    words = [w.lower() for w in clean_query(query)]
    words = [x for w in words for x in re.findall(r"[^\W_]+", w)]
    if not words:
        return []
    if mode in ("phrase", "all", "any"):
        return [Clause(mode, tuple(words))]
    out = []
    if len(words) > 1:
        out += [Clause("phrase", tuple(words)), Clause("near", tuple(words), 5), Clause("all", tuple(words))]
        if len(words) >= 4:
            out += [Clause("all", c) for c in itertools.islice(itertools.combinations(words, 3), 8)]
    else:
        out += [Clause("all", tuple(words)), Clause("prefix", (words[0],))]
    single = tuple(w[:-1] if len(w) > 3 and w.endswith("s") and not w.endswith("ss") else w for w in words)
    if single != tuple(words):
        out.append(Clause("all", single))
    more = [s for w in words for s in (synonyms or {}).get(w, [])]
    if more:
        out.append(Clause("any", tuple(dict.fromkeys(more))[:10]))
    return list(dict.fromkeys(out))[:12]


def cascade(docs: DataFrame, id_col: str, text_col: str, clauses: list[Clause], each: int = 300) -> DataFrame:
    """(list_no, id, rank): every clause's matches by BM25 of its terms, the best `each` of them."""
    out = None
    for i, c in enumerate(clauses):
        terms = list(c.terms)
        scored = bm25(docs, id_col, text_col, terms) if c.kind != "prefix" else docs.select(F.col(id_col).alias("id"), F.lit(0.0).alias("score"))
        hits = top(scored.join(c.match(docs, id_col, {"text": text_col}), "id", "left_semi"), each, "id")
        ranked = hits.select(F.lit(i).alias("list_no"), "id", F.row_number().over(W.orderBy(F.desc("score"), "id")).alias("rank"))  # at most `each` rows
        out = ranked if out is None else out.unionByName(ranked)
    return out


def title_search(papers: DataFrame, title_col: str, words: list[str], facts: DataFrame, key: str, sort: list[Column], limit: int, offset: int = 0) -> DataFrame:
    """Papers whose title holds every word, with the number of facts of each and the total; one page of them."""
    cond = F.lit(True)
    for w in words:
        cond = cond & F.contains(F.lower(title_col), F.lit(w.lower()))
    hits = papers.filter(cond)
    counts = facts.join(hits.select(key), key, "left_semi").groupBy(key).agg(F.count("*").alias("n_facts"))
    joined = hits.join(counts, key, "left").withColumn("n_facts", F.coalesce("n_facts", F.lit(0)))
    total = hits.agg(F.count("*").alias("total"))
    return joined.crossJoin(F.broadcast(total)).orderBy(*sort).offset(offset).limit(limit)  # total: one row


def snippet_rank(claims: DataFrame, text_col: str, words: list[str], bonus: Column) -> DataFrame:
    """Claims with score: distinct query words that the text holds, plus a bonus for their kind."""
    low = F.lower(text_col)
    held = sum((F.contains(low, F.lit(w.lower())).cast("int") for w in dict.fromkeys(words)), F.lit(0))
    return claims.withColumn("score", held + bonus)


def scan_search(df: DataFrame, query: str) -> DataFrame:
    """Rows whose JSON holds the query, whatever the column."""
    return df.filter(F.contains(F.lower(F.to_json(F.struct(*df.columns))), F.lit(query.lower())))


def time_distribution(matches: DataFrame, dated: DataFrame, key: str, year: Column) -> DataFrame:
    """(year, decade, n, n_papers) of all matches with a year from 1900 to 2029."""
    rows = matches.join(dated.select(key, year.alias("year")), key).filter(F.col("year").between(1900, 2029))
    return rows.groupBy("year").agg(F.count("*").alias("n"), F.countDistinct(key).alias("n_papers")).withColumn("decade", F.expr("year div 10 * 10"))
