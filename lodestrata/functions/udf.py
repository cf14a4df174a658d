"""A registry of pluggable scorers: named pandas UDFs with deterministic fall-backs for models that aren't there."""

from __future__ import annotations

import re
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from lodestrata.functions.text import author_hint, clean_query, stem_word

_FUNCTIONS: dict[str, tuple[Callable[[pd.Series], pd.Series], str]] = {}


def scorer(name: str, kind: str):
    """Registers a Series -> Series function under a name; a later one replaces it (a model instead of a fall-back)."""

    def add(fn):
        _FUNCTIONS[name] = (fn, kind)
        return fn

    return add


def apply(name: str, column: Column) -> Column:
    fn, kind = _FUNCTIONS[name]
    return F.pandas_udf(fn, kind)(column)


def register_all(spark: SparkSession) -> list[str]:
    """Makes every scorer a SQL function; gives their names."""
    for name, (fn, kind) in _FUNCTIONS.items():
        spark.udf.register(name, F.pandas_udf(fn, kind))
    return sorted(_FUNCTIONS)


@scorer("query_intent", "string")
def query_intent(q: pd.Series) -> pd.Series:
    """author, comparison, question or topic."""

    def one(x: str | None) -> str:
        x = x or ""
        if author_hint(x):
            return "author"
        if re.search(r"\b(vs|versus|compared?)\b", x.lower()):
            return "comparison"
        return "question" if re.match(r"(?i)\s*(what|how|why|which|when|who|where)\b", x) else "topic"

    return q.map(one)


@scorer("query_normalise", "string")
def query_normalise(q: pd.Series) -> pd.Series:
    return q.map(lambda x: " ".join(w.lower() for w in clean_query(x or "")))


@scorer("query_decompose", "array<string>")
def query_decompose(q: pd.Series) -> pd.Series:
    return q.map(lambda x: [p.strip() for p in re.split(r"\s+(?:and|vs\.?|versus)\s+|[;,]", x or "") if p.strip()])


@scorer("query_relevance", "double")
def query_relevance(pair: pd.Series) -> pd.Series:
    """Of "query \\t text": the share of the query's words that the text holds, by their stems."""

    def one(x: str | None) -> float:
        q, _, t = (x or "").partition("\t")
        want = {stem_word(w.lower()) for w in clean_query(q)}
        held = {stem_word(w) for w in re.findall(r"[^\W_]+", t.lower())}
        return len(want & held) / len(want) if want else 0.0

    return pair.map(one)


#: Word -> words that a fall-back expansion adds; a model or a larger table replaces it. Fixed values.
EXPANSIONS = {"thing": ["item"], "catalyst": ["catalysis"], "yield": ["conversion"], "ring": ["cycle"]}


@scorer("query_expand", "array<string>")
def query_expand(q: pd.Series) -> pd.Series:
    """The query's words and what EXPANSIONS adds to each, once."""

    def one(x: str | None) -> list[str]:
        words = [w.lower() for w in clean_query(x or "")]
        return list(dict.fromkeys([*words, *(m for w in words for m in EXPANSIONS.get(w, []))]))

    return q.map(one)


@scorer("claims_contradict", "boolean")
def claims_contradict(pair: pd.Series) -> pd.Series:
    """Of "claim \\t claim": whether both share a word of four letters or more and one denies what the other says (not, no, never, without)."""
    deny = re.compile(r"\b(?:not|no|never|without)\b")

    def one(x: str | None) -> bool:
        a, _, b = (x or "").lower().partition("\t")
        shared = set(re.findall(r"[^\W_]{4,}", a)) & set(re.findall(r"[^\W_]{4,}", b))
        return bool(shared) and bool(deny.search(a)) != bool(deny.search(b))

    return pair.map(one)
