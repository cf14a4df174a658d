"""Toxicity scores from a learned lexicon, matched with its misspellings.

The lexicon - whole words, and stems that begin words - is learned from labelled documents: terms that toxic ones hold
far more often. It becomes a trie; a Levenshtein automaton of one edit is intersected with the trie, and the product is
made deterministic on the fly, so that looking up a word costs a few table steps and most words end in the dead state
after some letters. Each match is then read in a window of its context: between quotation marks, or beside a reporting
word, it counts as quoted, else as abuse. A logistic fit weighs exact and misspelled, quoted and other matches.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestrata.llm.labelled import SAMPLE_ROWS, fold, sample_labels
from lodestrata.llm.logistic import newton, sigmoid

#: Toxic documents that a term must be in at least.
LEAST_DOCS = 4

#: Natural logarithm of how many times as often toxic documents must hold a term.
LEAST_ODDS = 2.5

#: Lengths of stems; words of at least FUZZY_LEAST letters may be misspelled by one edit.
STEM_LENGTHS, FUZZY_LEAST = range(4, 9), 5

#: Code points on either side of a match that tell whether it is quoted.
WINDOW = 60

#: Words that report someone else's speech.
REPORTING = re.compile(r"\b(?:said|says|wrote|writes|quot\w*|called|so-called|cited|according|replied|dit|dijo|sagte|schrieb|citation|zitat|cita)\b", re.IGNORECASE)
QUOTES = "\"“”„«»"

_WORD = re.compile(r"[^\W\d_]+(?:[0-9@$!*'][^\W\d_]+)*")
#: Signs that stand for letters.
_SIGNS = str.maketrans("013457@$!", "oleastasi")
_FEATURES = 11


class Automaton:
    """Words within one edit of a lexicon term, or that begin with a stem.

    A state is a set of (trie node, edits so far); transitions are kept once made. match() gives (kind, weight) with kind
    0 for a whole word, 1 for a stem, 2 for a misspelled word, or None. Stems match exactly, since a short beginning
    within one edit of a stem is common in clean text.
    """

    MOST_STATES = 200_000

    def __init__(self, words: dict[str, float], stems: dict[str, float]):
        self.children: list[dict[str, int]] = [{}]
        self.word: list[float | None] = [None]
        self.stem: list[float | None] = [None]
        self.fuzzy: list[bool] = [False]  # a long enough word is below
        for terms, ends in ((words, self.word), (stems, self.stem)):
            for term, weight in terms.items():
                node, path = 0, [0]
                for letter in term:
                    node = self.children[node].setdefault(letter, len(self.children))
                    if node == len(self.children):
                        self.children.append({})
                        self.word.append(None)
                        self.stem.append(None)
                        self.fuzzy.append(False)
                    path.append(node)
                ends[node] = weight
                if ends is self.word and len(term) >= FUZZY_LEAST:
                    for x in path:
                        self.fuzzy[x] = True
        self._reset()

    def _reset(self) -> None:
        self.ids: dict[frozenset, int] = {}
        self.sets: list[frozenset] = []
        self.steps: list[dict[str, int]] = []
        self.ends: list[tuple | None] = []
        self.stems: list[float | None] = []
        self._state(frozenset())  # 0: dead
        self.start = self._state(self._closed({(0, 0)}))

    def _closed(self, pairs: set) -> frozenset:
        """With the term's letters that the word may lack."""
        for node, edits in list(pairs):
            if edits == 0:
                pairs.update((x, 1) for x in self.children[node].values() if self.fuzzy[x])
        return frozenset(p for p in pairs if p[1] == 0 or (p[0], 0) not in pairs)

    def _state(self, key: frozenset) -> int:
        if key not in self.ids:
            self.ids[key] = len(self.sets)
            self.sets.append(key)
            self.steps.append({})
            exact = [self.word[n] for n, e in key if e == 0 and self.word[n] is not None]
            near = [self.word[n] for n, e in key if e == 1 and self.word[n] is not None and self.fuzzy[n]]
            self.ends.append((0, max(exact)) if exact else (2, max(near)) if near else None)
            stems = [self.stem[n] for n, e in key if e == 0 and self.stem[n] is not None]
            self.stems.append(max(stems) if stems else None)
        return self.ids[key]

    def _step(self, state: int, letter: str) -> int:
        pairs = set()
        for node, edits in self.sets[state]:
            below = self.children[node]
            if letter in below and (edits == 0 or self.fuzzy[below[letter]]):
                pairs.add((below[letter], edits))
            if edits == 0 and self.fuzzy[node]:
                pairs.add((node, 1))  # a letter too many
                pairs.update((x, 1) for x in below.values() if self.fuzzy[x])  # another letter
        to = self.steps[state][letter] = self._state(self._closed(pairs))
        return to

    def match(self, word: str) -> tuple[int, float] | None:
        if len(self.sets) > self.MOST_STATES:
            self._reset()
        state, stem = self.start, None
        for letter in word:
            to = self.steps[state].get(letter)
            state = self._step(state, letter) if to is None else to
            if not state:
                break
            if self.stems[state] is not None:
                stem = self.stems[state]
        end = self.ends[state]  # of the dead state None
        if end and (end[0] == 0 or stem is None):
            return end
        return None if stem is None else (1, stem)


class Matcher:
    """Features of whole texts; words are looked up once per worker as far as the memo goes."""

    MEMO = 400_000

    def __init__(self, words: dict[str, float], stems: dict[str, float]):
        self.automaton, self.memo = Automaton(words, stems), {}

    def lookup(self, word: str) -> tuple[int, float] | None:
        if len(self.memo) > self.MEMO:
            self.memo.clear()
        found = self.automaton.match(word)
        if found is None and not word.isalpha():
            found = self.automaton.match(word.translate(_SIGNS))
            found = found and (2, found[1])
        self.memo[word] = found
        return found

    def features(self, text: str) -> np.ndarray:
        x = np.zeros(_FEATURES)
        low = text.lower()
        memo, n_words = self.memo, 0
        quoted_sum = plain_sum = 0.0
        for m in _WORD.finditer(low):
            n_words += 1
            word = m[0]
            found = memo[word] if word in memo else self.lookup(word)
            if found is None:
                continue
            quoted = is_quoted(low, *m.span())
            x[2 * found[0] + quoted] += 1
            if quoted:
                quoted_sum += found[1]
            else:
                plain_sum += found[1]
        hits = x[:6].sum()
        x[6], x[7] = math.log1p(plain_sum), math.log1p(quoted_sum)
        x[8] = hits > 0
        x[9] = math.log1p(100 * hits / max(1, n_words))
        x[:6] = np.log1p(x[:6])
        x[10] = 1
        return x


def is_quoted(text: str, start: int, end: int) -> bool:
    """Whether the window around text[start:end] shows quotation: marks on both sides within its line, or a reporting word before it."""
    a, b = max(0, start - WINDOW), min(len(text), end + WINDOW)
    before, after = text[a:start], text[end:b]
    before = before[before.rfind("\n") + 1 :]
    after = after.split("\n", 1)[0]
    if any(q in before for q in QUOTES) and any(q in after for q in QUOTES) and sum(before.count(q) for q in QUOTES) % 2 == 1:
        return True
    return bool(REPORTING.search(before))


def _rows(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))


def learn_lexicon(labelled: DataFrame) -> tuple[dict[str, float], dict[str, float]]:
    """Words and stems with their log odds, from (doc_id, text, y). Words stay where a stem begins them, for their misspellings.

    All terms come to the driver that at least LEAST_DOCS toxic documents hold, far more often than others; the labelled sample bounds them.
    """

    def terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for text, y in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                words = set(_WORD.findall((text or "").lower()))
                stems = {w[:k] + "*" for w in words for k in STEM_LENGTHS if len(w) > k}
                held = [*words, *stems]
                yield pa.RecordBatch.from_arrays([pa.array(held, pa.string()), pa.array([y] * len(held), pa.int32())], ["term", "y"])

    n = {r["y"]: r["n"] for r in labelled.groupBy("y").agg(F.count("*").alias("n")).collect()}
    if not n.get(0) or not n.get(1):
        return {}, {}
    counts = labelled.select("doc_id", "text", "y").mapInArrow(terms, "term string, y int").groupBy("term").agg(F.sum("y").alias("bad"), F.count("*").alias("n"))
    odds = F.log((F.col("bad") + 0.1) / (n[1] + 0.2)) - F.log((F.col("n") - F.col("bad") + 0.1) / (n[0] + 0.2))
    best = counts.filter(F.col("bad") >= LEAST_DOCS).withColumn("odds", odds).filter(F.col("odds") >= LEAST_ODDS)
    stem = F.col("term").endswith("*")
    take = lambda cond: [(r["term"].rstrip("*"), r["odds"], r["bad"]) for r in best.filter(cond).orderBy(F.desc("bad"), F.desc("odds"), "term").collect()]
    words, stems = take(~stem), take(stem)
    # the shortest stems that explain the longer ones
    kept: dict[str, tuple[float, int]] = {}
    for term, weight, bad in sorted(stems, key=lambda x: (len(x[0]), x[0])):
        if not any(term[:k] in kept for k in STEM_LENGTHS if k < len(term)):
            kept[term] = weight, bad
    begun: dict[str, list[int]] = {}
    for term, _, bad in words:
        for k in STEM_LENGTHS:
            if len(term) >= k and term[:k] in kept:
                begun.setdefault(term[:k], []).append(bad)
    # a stem that only begins one frequent word is that word
    single = {s for s, own in begun.items() if len(own) == 1 and own[0] >= 0.9 * kept[s][1]}
    return {t: o for t, o, _ in words}, {s: o for s, (o, _) in kept.items() if s not in single}


def train(docs: DataFrame, labels: DataFrame, folds: int = 5, held: int = 0, rows: int = SAMPLE_ROWS) -> dict:
    """Lexicon and weights from at most about `rows` labelled documents; their feature vectors come to the driver."""
    labelled = _rows(docs).join(F.broadcast(sample_labels(labels, "toxic", folds, held, rows)), "doc_id")
    words, stems = learn_lexicon(labelled)

    def featured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matcher = Matcher(words, stems)
        for batch in batches:
            x = [matcher.features(t or "").tolist() for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(x, pa.list_(pa.float64()))], ["doc_id", "y", "x"])

    got = labelled.select("doc_id", "text", "y").mapInArrow(featured, "doc_id long, y int, x array<double>").toPandas().sort_values("doc_id", kind="stable")
    x, y = np.array(got["x"].tolist(), float).reshape(-1, _FEATURES), got["y"].to_numpy(float)
    w = newton(x, y, l2=0.3, free=1) if len(y) and y.min() < y.max() else np.array([0.0] * (_FEATURES - 1) + [10.0 if len(y) and y[0] else -10.0])
    return {"words": words, "stems": stems, "w": w}


def score_toxicity(docs: DataFrame, model: dict, folds: int = 5, held: int = 0) -> DataFrame:
    """One row per row of docs: doc_id, held_out, score, predicted.

    A null text counts as empty and is scored like any other. held_out of a null doc_id is false. An empty table gives
    no rows; other columns are ignored.
    """

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matcher = Matcher(model["words"], model["stems"])
        for batch in batches:
            x = np.array([matcher.features(t or "") for t in batch.column(1).to_pylist()]).reshape(-1, _FEATURES)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sigmoid(x @ model["w"]), pa.float64())], ["doc_id", "score"])

    out = _rows(docs).mapInArrow(scored, "doc_id long, score double")
    return out.select("doc_id", F.coalesce(fold(F.col("doc_id"), folds) == held, F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
