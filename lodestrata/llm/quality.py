"""Quality classifier by Bradley-Terry pairwise ranking.

From labelled documents, preference pairs (a good one over a poor one) are drawn; the weights minimise the logistic
loss on feature differences, so that a document's score is its Bradley-Terry strength. Documents are then accepted by a
quantile of the training scores, which maps to the fixed threshold of the output score.

Only whole texts are used. The fit sees a bounded sample of labelled rows (labelled.SAMPLE_ROWS); scoring is one pass
over all documents without a shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestrata.llm.labelled import SAMPLE_ROWS, fold, sample_labels
from lodestrata.llm.logistic import newton, sigmoid

#: Preference pairs drawn for the fit.
PAIRS = 60_000

#: Score from which a document is predicted to be good.
ACCEPT = 0.7

_FEATURES = 22


def features(text: str) -> np.ndarray:
    """A vector of shares and logarithms of the whole text; zeros for an empty one."""
    out = np.zeros(_FEATURES)
    if not text:
        return out
    raw = np.frombuffer(text.encode("utf-8", "replace"), np.uint8)
    n = np.bincount(raw, minlength=256)
    size = len(raw)
    words = text.split()
    lines = text.split("\n")
    upper, lower, digits = n[65:91].sum(), n[97:123].sum(), n[48:58].sum()
    space = n[32] + n[9:14].sum()
    high = n[128:].sum()
    point = n[33:48].sum() + n[58:65].sum() + n[91:97].sum() + n[123:127].sum()
    n_words, distinct = max(1, len(words)), len(set(words))
    shares = n[np.flatnonzero(n)] / size
    ends = n[46] + n[63] + n[33]
    out[:] = (
        upper / max(1, upper + lower), digits / size, space / size, high / size, point / size,
        n[33] / n_words, n[124] / n_words, (n[35] + n[36] + n[37] + n[38] + n[42]) / n_words, n[44] / n_words, n[46] / n_words,
        (n[60] + n[62] + n[123] + n[125] + n[91] + n[93] + n[61] + n[95]) / n_words, n[47] / n_words,
        np.log1p(len(words)), distinct / n_words, np.log1p(n_words / max(1, distinct)), np.log(sum(map(len, words)) / n_words + 1),
        -(shares * np.log(shares)).sum(), np.log1p(len(lines)), len(set(lines)) / len(lines), np.log1p(n_words / len(lines)),
        np.log1p(n_words / max(1, ends)), max(map(len, words), default=0) > 40,
    )
    return out


def fit(x: np.ndarray, y: np.ndarray, pairs: int = PAIRS, seed: int = 7) -> dict:
    """Bradley-Terry weights and the acceptance cut. With one class only, every score is on that class's side."""
    if not len(y) or y.min() == y.max():
        return {"mean": np.zeros(_FEATURES), "scale": np.ones(_FEATURES), "w": np.zeros(_FEATURES), "slope": 1.0, "cut": -1.0 if len(y) and y[0] else 1.0}
    mean, scale = x.mean(0), np.maximum(x.std(0), 1e-6)
    z = np.clip((x - mean) / scale, -8, 8)
    draw = np.random.default_rng(seed)
    good, poor = np.flatnonzero(y == 1), np.flatnonzero(y == 0)
    a, b = draw.choice(good, pairs), draw.choice(poor, pairs)
    swap = np.arange(pairs) % 2 == 1  # the pair's sides in turn, so that both outcomes are there
    diff = np.where(swap[:, None], z[b] - z[a], z[a] - z[b])
    w = newton(diff, 1.0 - swap, l2=10.0)
    strength = z @ w
    # the quantile of the training scores at which most rows fall on their own side
    order = np.argsort(strength, kind="stable")
    right = np.concatenate([[0], np.cumsum(y[order] == 0)]) + np.concatenate([np.cumsum((y[order] == 1)[::-1])[::-1], [0]])
    at = np.flatnonzero(right == right.max())
    k = int(at[len(at) // 2])
    s = strength[order]
    cut = (s[k - 1] + s[k]) / 2 if 0 < k < len(s) else s[0] - 1 if k == 0 else s[-1] + 1
    slope = float(abs(newton(np.column_stack([strength - cut, np.ones(len(s))]), y.astype(float), l2=1e-3, free=1)[0]))
    return {"mean": mean, "scale": scale, "w": w, "slope": min(max(slope, 0.05), 20.0), "cut": float(cut)}


def scores(model: dict, x: np.ndarray) -> np.ndarray:
    """0 to 1; ACCEPT exactly at the cut."""
    strength = np.clip((x - model["mean"]) / model["scale"], -8, 8) @ model["w"]
    return sigmoid(model["slope"] * (strength - model["cut"]) + np.log(ACCEPT / (1 - ACCEPT)))


def _rows(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))


def train(docs: DataFrame, labels: DataFrame, folds: int = 4, held: int = 2, rows: int = SAMPLE_ROWS) -> dict:
    """The model from at most about `rows` labelled documents; what comes to the driver is their feature vectors."""

    def featured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = [features(t or "").tolist() for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(x, pa.list_(pa.float64()))], ["doc_id", "y", "x"])

    known = F.broadcast(sample_labels(labels, "quality", folds, held, rows))
    got = _rows(docs).join(known, "doc_id").mapInArrow(featured, "doc_id long, y int, x array<double>").toPandas()
    got = got.sort_values("doc_id", kind="stable")
    x = np.array(got["x"].tolist(), float).reshape(-1, _FEATURES)
    return fit(x, got["y"].to_numpy(int))


def score_quality(docs: DataFrame, model: dict, folds: int = 4, held: int = 2) -> DataFrame:
    """One row per row of docs: doc_id, held_out, score, predicted.

    A null text counts as empty and is scored like any other. held_out of a null doc_id is false. An empty table gives
    no rows; other columns are ignored.
    """

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.array([features(t or "") for t in batch.column(1).to_pylist()]).reshape(-1, _FEATURES)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores(model, x), pa.float64())], ["doc_id", "score"])

    out = _rows(docs).mapInArrow(scored, "doc_id long, score double")
    return out.select("doc_id", F.coalesce(fold(F.col("doc_id"), folds) == held, F.lit(False)).alias("held_out"), "score", (F.col("score") >= ACCEPT).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, model: dict) -> DataFrame:
    """docs that the model accepts; all columns, unchanged, in one pass."""
    @F.pandas_udf("double")
    def strength(text):
        return pd.Series(scores(model, np.array([features(t or "") for t in text]).reshape(-1, _FEATURES)))

    return docs.filter(strength(F.col("text").cast("string")) >= ACCEPT)
