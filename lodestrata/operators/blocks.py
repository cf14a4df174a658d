"""All pairs of a block by matrix products. A block is cut into parts of bounded size, and two parts meet in one task."""

from __future__ import annotations

from collections.abc import Iterator
from decimal import ROUND_HALF_UP, Decimal

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rows of a part.
PART = 1024

_KEYS = ["block", "lo", "hi"]


def meetings(rows: DataFrame, part: int = PART) -> DataFrame:
    """rows (id, block, v) with (part, lo, hi): each row once for every pair of parts of its block that holds its own."""
    rows = rows.select("id", "block", "v").dropna()
    sizes = rows.groupBy("block").agg(F.ceil(F.count("*") / part).cast("int").alias("parts"))
    own = rows.join(sizes, "block").withColumn("part", F.pmod(F.xxhash64("id"), "parts").cast("int"))
    each = own.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    return each.select("id", "block", "v", "part", F.least("part", "other").alias("lo"), F.greatest("part", "other").alias("hi"))


def _sides(rows: pd.DataFrame) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(ids, ids, values, values) of two parts, or twice of one, for each length of the arrays; arrays with a null say nothing."""
    rows = rows[[not pd.isna(v).any() for v in rows["v"]]]
    for _, same in rows.groupby(rows["v"].map(len)):
        a, b = (same[same["part"] == same[c].iloc[0]] for c in ("lo", "hi"))
        if len(a) and len(b):
            yield a["id"].to_numpy(), b["id"].to_numpy(), np.stack(a["v"].to_numpy()), np.stack(b["v"].to_numpy())


def _rounded(x: np.ndarray, y: np.ndarray) -> Decimal:
    total = 0.0
    for p, q in zip(x.tolist(), y.tolist(), strict=True):
        total += p * q
    return Decimal(repr(total)).quantize(Decimal("1e-6"), ROUND_HALF_UP)


def _alike(x: np.ndarray, y: np.ndarray, least: float) -> np.ndarray:
    """Whether inner products are at least `least` to six digits; what is next to the bound is summed again in order. Not a number counts as large."""
    x, y = x.astype(np.float64), y.astype(np.float64)
    score, bound = x @ y.T, least - 5e-7
    hit = ~(score < bound)
    far = 1e-9 * max(1.0, np.sqrt((x * x).sum(1).max(initial=0) * (y * y).sum(1).max(initial=0)))
    for i, j in np.argwhere(np.abs(score - bound) <= far):
        hit[i, j] = _rounded(x[i], y[j]) >= Decimal(repr(least))
    return hit


def _groups(hit: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Rows and columns of each component of the links that a matrix shows."""
    rows_left, cols_left = hit.any(1), np.ones(hit.shape[1], bool)
    for start in np.flatnonzero(rows_left):
        if not rows_left[start]:
            continue
        front, rows, cols = np.array([start]), [], []
        while len(front):
            rows_left[front] = False
            rows.append(front)
            new = np.flatnonzero(hit[front].any(0) & cols_left)
            cols_left[new] = False
            cols.append(new)
            front = np.flatnonzero(hit[:, new].any(1) & rows_left)
        yield np.concatenate(rows), np.concatenate(cols)


def similar_links(rows: DataFrame, least: float) -> DataFrame:
    """(a, b) with the same components, of the same nodes, as all pairs of a block whose inner product is at least `least`.

    Each meeting of parts gives a star for each component of its own links, so fewer rows than it has ids.
    """

    def run(met: pd.DataFrame) -> pd.DataFrame:
        out = []
        for a, b, x, y in _sides(met):
            for r, c in _groups(_alike(x, y, least) & (a[:, None] != b[None, :])):
                ids = np.unique(np.concatenate([a[r], b[c]]))
                out.append(pd.DataFrame({"a": ids[0], "b": ids[1:]}))
        return pd.concat(out) if out else pd.DataFrame({"a": [], "b": []})

    kind = rows.schema["id"].dataType.simpleString()
    return meetings(rows).groupBy(*_KEYS).applyInPandas(run, f"a {kind}, b {kind}")


def _bit_sides(met: pa.Table) -> Iterator[tuple[pa.Array, pa.Array, np.ndarray, np.ndarray]]:
    """(ids, ids, values, values) of two parts, or twice of one, for each length of the arrays; arrays with a null say nothing."""
    lengths, part = pc.list_value_length(met["v"]).to_numpy(), met["part"].to_numpy()
    if any(c.flatten().null_count for c in met["v"].chunks):
        lengths = np.where([None in v for v in met["v"].to_pylist()], -1, lengths)
    for n in np.unique(lengths[lengths >= 0]):
        sides = [met.filter(pa.array((lengths == n) & (part == met[c][0].as_py()))) for c in ("lo", "hi")]
        if all(map(len, sides)):
            a, b = (x["id"].combine_chunks() for x in sides)
            v, w = (x["v"].combine_chunks().flatten().to_numpy().reshape(len(x), n) for x in sides)
            yield a, b, v, w


def bit_overlaps(rows: DataFrame, least: float, part: int = 4096, tile: int = 1024) -> DataFrame:
    """(a, b, both, either), a < b: bits that both fingerprints of a block's pair have and that either has, where both is at least `least` of either.

    Parts are larger than those of vectors, as bits are short and each row goes to every meeting of its part; `tile`
    rows of either meet at a time, which bounds the memory.
    """

    def bits(v: np.ndarray) -> np.ndarray:
        return np.unpackbits(np.ascontiguousarray(v, "<i8").view(np.uint8), axis=1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        met = pa.Table.from_batches(list(batches))
        one = met["lo"][0] == met["hi"][0]
        for a, b, v, w in _bit_sides(met):
            common = np.flatnonzero(bits(np.bitwise_or.reduce(v, axis=0)[None, :] & np.bitwise_or.reduce(w, axis=0)[None, :])[0])
            y = bits(w)[:, common].astype(np.float32)  # counts to 2^24 are exact
            n, m = (np.bitwise_count(x.view(np.uint64)).sum(1, dtype=np.int64) for x in (v, w))
            ids, others = a.to_numpy(zero_copy_only=False), b.to_numpy(zero_copy_only=False)
            # both >= least * (n + m - both), with room for 32-bit bounds; what is left is tested again
            n_bound, m_bound = ((least / (1 + least) * x - 0.25 - 1e-6 * x).astype(np.float32) for x in (n, m))
            for at in range(0, len(v), tile):
                x = bits(v[at : at + tile])[:, common].astype(np.float32)
                for to in range(at if one else 0, len(w), tile):
                    both = x @ y[to : to + tile].T
                    i, j = np.nonzero(both >= n_bound[at : at + tile, None] + m_bound[None, to : to + tile])
                    both = both[i, j].astype(np.int64)
                    i, j = i + at, j + to
                    either = n[i] + m[j] - both
                    p, q = ids[i], others[j]
                    hit = np.flatnonzero((both >= least * either) & (p != q) & ((i < j) | (not one)))
                    if len(hit):
                        p, q, after = a.take(pa.array(i[hit])), b.take(pa.array(j[hit])), pa.array(p[hit] > q[hit], pa.bool_())
                        yield pa.RecordBatch.from_arrays([pc.if_else(after, q, p), pc.if_else(after, p, q), pa.array(both[hit]), pa.array(either[hit])], ["a", "b", "both", "either"])

    kind = rows.schema["id"].dataType.simpleString()
    return meetings(rows, part).groupBy(*_KEYS).applyInArrow(run, f"a {kind}, b {kind}, both long, either long")
