r"""Exact Jaccard join on word shingles, with token-combination prefixes.

A global order puts rare tokens (shingles) before frequent ones; two sets that are similar enough share two tokens in
prefixes of n - ceil(t * n) + 2 tokens. Rare tokens of that prefix are index keys by themselves. Frequent ones - the
classes that common passages and large groups of copies make - are indexed as two-token combinations where a prefix
holds few of them (at most FEW), and such a set's single frequent tokens meet only those of sets that hold many. Every
pair over the threshold meets in a key; what meets is verified on the whole sets.

The order comes from a sketch of counters over all documents' tokens. A token is frequent if its counter stands out from
the load that other tokens alone give a counter, by three of that load's deviations (and two): so the classes follow the
corpus, whatever its size, and a rare token is in few documents beside it. Documents with equal sets are one
class from the start. A key's classes are first linked with one pivot (a star: rows grow with the postings, not with
their square), verified, and merged into components; only pairs of a key that are then still in different components are
formed, once for all keys with the same rows, in blocks of BLOCK rows of a key. Pairs are thinned by their sizes and by parity signatures, which bound the sets' difference from below, before
they are verified. So a large group of near copies costs a star instead of all its pairs, and no link that could join two
components is left out.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestrata.llm.components import components
from lodestrata.llm.runtime import attach, keep_ids, release, written

#: Words of a shingle; sets link when 100 * intersection >= PERCENT * union.
SHINGLE_WORDS, PERCENT = 4, 85

#: Counters of the frequency sketch, in SKETCH_CHUNKS rows per task; FAN_IN tasks' sketches are summed at a time.
SKETCH, SKETCH_CHUNKS, FAN_IN = 1 << 20, 16, 64

#: Longs of the parities that a key's rows carry (a power of two): sets of up to some 3,000 tokens that share little are told apart by 1024 bits.
PARITY_LONGS = 16

#: Bits of a signature at most.
MOST_BITS = 1 << 16

#: Frequent tokens of a prefix up to which it is indexed by pairs of them.
FEW = 12

#: Rows of a key that meet in one task when its pairs are formed; a key with more is cut into blocks, each pair of which is a key.
BLOCK = 256

_WS = np.zeros(256, bool)
_WS[[0x20, *range(0x09, 0x0E)]] = True
_draw = np.random.default_rng(20_240_501)
_BYTE = _draw.integers(1, 1 << 63, 256, np.uint64) * np.uint64(2) + np.uint64(1)
_BYTE[65:91] = _BYTE[97:123]  # A-Z as a-z
_BASE = np.uint64(0x9E3779B97F4A7C15)
_BACK = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_MANY = _draw.integers(1, 1 << 63, 16, np.uint64) * np.uint64(2) + np.uint64(1)
_PIECE = 1 << 20
_powers: dict[str, np.ndarray] = {}


def _mix(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h = h ^ (h >> np.uint64(27))
    h = h * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def _power(size: int) -> tuple[np.ndarray, np.ndarray]:
    if "up" not in _powers or len(_powers["up"]) < size:
        for name, base in (("up", _BASE), ("down", _BACK)):
            _powers[name] = np.cumprod(np.concatenate([[np.uint64(1)], np.full(max(size, 1 << 16) - 1, base)]), dtype=np.uint64)
    return _powers["up"], _powers["down"]


def word_hashes(text: str) -> np.ndarray:
    """A 64-bit hash for each word [^\\x20\\x09-\\x0D]+ of the text whose A-Z are lower case; long texts go in pieces that end between words."""
    raw = np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)
    out, at = [], 0
    while at < len(raw):
        end = min(len(raw), at + _PIECE)
        while end < len(raw) and not _WS[raw[end]]:
            end += 1
        piece = raw[at:end]
        at = end
        gap = _WS[piece]
        edges = np.diff(np.concatenate([[True], gap, [True]]).astype(np.int8))
        starts, ends = np.flatnonzero(edges == -1), np.flatnonzero(edges == 1)
        up, down = _power(len(piece) + 1)
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(np.where(gap, np.uint64(0), _BYTE[piece]) * up[: len(piece)], dtype=np.uint64)])
        out.append(_mix((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64)))
    return np.concatenate(out) if out else np.zeros(0, np.uint64)


def shingle_set(text: str | None, n: int = SHINGLE_WORDS) -> np.ndarray:
    """Sorted distinct hashes of the text's n-word shingles; of fewer words, the whole sequence as one; none without words."""
    words = word_hashes(text or "")
    if not len(words):
        return words
    k = min(n, len(words))
    total = np.zeros(len(words) - k + 1, np.uint64)
    for i in range(k):
        total += words[i : len(words) - k + 1 + i] * _MANY[i]
    return np.unique(_mix(total + np.full(1, k, np.uint64) * _BASE))


def digest(tokens: np.ndarray) -> int:
    return int.from_bytes(hashlib.blake2b(tokens.tobytes(), digest_size=8).digest(), "little", signed=True)


def parity(tokens: np.ndarray) -> np.ndarray:
    """PARITY_LONGS longs; bit i is the parity of the number of tokens that fall on it."""
    odd = np.bincount((tokens >> np.uint64(40)).astype(np.int64) & (64 * PARITY_LONGS - 1), minlength=64 * PARITY_LONGS) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


def signature(tokens: np.ndarray) -> bytes:
    """Parities as in parity(), over as many bits as the set has tokens (a power of two from 256 to MOST_BITS)."""
    bits = min(MOST_BITS, max(256, 1 << max(0, len(tokens) - 1).bit_length()))
    odd = np.bincount((tokens >> np.uint64(40)).astype(np.int64) & (bits - 1), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").tobytes()


def differ_at_least(x: bytes, y: bytes) -> int:
    """A lower bound of two sets' symmetric difference from their signatures; the longer one is folded to the shorter."""
    a, b = sorted((x, y), key=len)
    p, q, size = int.from_bytes(a, "little"), int.from_bytes(b, "little"), 8 * len(b)
    while size > 8 * len(a):
        size //= 2
        q = (q >> size) ^ (q & ((1 << size) - 1))
    return (p ^ q).bit_count()


def least_shared(n: np.ndarray | int, percent: int = PERCENT):
    """Tokens of a set of n that any similar set shares at least."""
    return (n * percent + 99) // 100


#: Kinds of keys: of a rare token, of frequent tokens, and of a frequent single token of a set with few of them.
RARE, OFTEN, NARROW = 0, 1, 2


def index_keys(tokens: np.ndarray, classes: np.ndarray, percent: int = PERCENT) -> tuple[np.ndarray, np.ndarray]:
    """(keys, kinds) of a set.

    A set so small that neither a token less nor one more is allowed is similar to no other set, and gets none.
    """
    n = len(tokens)
    shared = least_shared(n, percent)
    if shared >= n and n * 100 < percent * (n + 1):  # neither a token less nor one more is allowed
        return np.zeros(0, np.uint64), np.zeros(0, np.int32)
    pairs = shared >= 2
    size = min(n, n - shared + (2 if pairs else 1))
    level = classes[(tokens & np.uint64(SKETCH - 1)).astype(np.int64)]
    order = np.lexsort((tokens, level))[:size]
    tokens, level = tokens[order], level[order]
    rare, often = tokens[level == 0], tokens[level > 0]
    if not pairs or len(often) > FEW:
        return tokens, np.where(level == 0, RARE, OFTEN).astype(np.int32)
    i, j = np.triu_indices(len(often), 1)
    both = _mix(often[i] * _MANY[14] + _mix(often[j] * _MANY[15]))
    return np.concatenate([rare, both, often]), np.repeat(np.array([RARE, OFTEN, NARROW], np.int32), [len(rare), len(both), len(often)])


def _signed(x: np.ndarray) -> pa.Array:
    return pa.array(x.astype(np.uint64).view(np.int64), pa.int64())


_BITS = tuple(f"b{i}" for i in range(PARITY_LONGS))
_ROW = f"part int, chunk int, counts binary, doc_id long, n long, class long, {', '.join(f'{b} long' for b in _BITS)}, bits binary"
_ROW_KINDS = (pa.int32(), pa.int32(), pa.binary(), *[pa.int64()] * (3 + PARITY_LONGS), pa.binary())


def _sets(batches: Iterator[pa.RecordBatch], n: int) -> Iterator[pa.RecordBatch]:
    """A row per document, and at the end the task's frequency sketch over its distinct sets."""
    part = TaskContext.get().partitionId()
    names = [c.split()[0] for c in _ROW.split(", ")]
    counts, seen = np.zeros(SKETCH, np.uint32), set()
    for batch in batches:
        rows = []
        for doc_id, text in zip(batch.column(0), batch.column(1), strict=True):
            tokens = shingle_set(text.as_py(), n)
            own = digest(tokens)
            rows.append((None, None, None, doc_id.as_py(), len(tokens), own, *parity(tokens).tolist(), signature(tokens)))
            if own not in seen and len(tokens):
                seen.add(own)
                np.add.at(counts, (tokens & np.uint64(SKETCH - 1)).astype(np.int64), 1)
        columns = zip(*rows, strict=True) if rows else [[]] * len(names)
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, _ROW_KINDS, strict=True)], names)
    if seen:
        each = SKETCH // SKETCH_CHUNKS
        for i in range(SKETCH_CHUNKS):
            row = (part, i, _packed(counts[i * each : (i + 1) * each]), *[None] * (4 + PARITY_LONGS))
            yield pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(row, _ROW_KINDS, strict=True)], names)


def _packed(counts: np.ndarray) -> bytes:
    """Counters in the fewest bytes each that hold them."""
    kind = next((k for k in (np.uint8, np.uint16, np.uint32) if counts.max(initial=0) <= np.iinfo(k).max), np.uint64)
    return counts.astype(kind).tobytes()


def _unpacked(raw: bytes) -> np.ndarray:
    each = SKETCH // SKETCH_CHUNKS
    return np.frombuffer(raw, f"<u{len(raw) // each}").astype(np.uint64)


def _summed(rows: pd.DataFrame) -> pd.DataFrame:
    total = sum((_unpacked(x) for x in rows["counts"]), np.zeros(SKETCH // SKETCH_CHUNKS, np.uint64))
    return pd.DataFrame({"part": rows["part"].iloc[:1], "chunk": rows["chunk"].iloc[:1], "counts": [_packed(total)]})


def frequency_classes(sketch: DataFrame) -> np.ndarray:
    """A byte for each counter: 0 for rare tokens, else 1 + the logarithm of how far above the bound it is.

    The bound is what the tokens that fall on a counter by chance hardly exceed: the median load, three times its root,
    and two.

    Sketches are summed FAN_IN at a time on the executors; the driver gets SKETCH_CHUNKS rows, whatever the input is.
    """
    parts = sketch.agg(F.coalesce(F.max("part"), F.lit(0)).alias("m")).first()["m"] + 1
    while parts > 1:
        parts = -(-parts // FAN_IN)
        grouped = sketch.select(F.expr(f"part div {FAN_IN}").cast("int").alias("part"), "chunk", "counts")
        sketch = grouped.groupBy("part", "chunk").applyInPandas(_summed, "part int, chunk int, counts binary")
    counts = np.zeros(SKETCH, np.uint64)
    each = SKETCH // SKETCH_CHUNKS
    for row in sketch.collect():
        counts[row["chunk"] * each : (row["chunk"] + 1) * each] += _unpacked(bytes(row["counts"]))
    return classes_of(counts)


def classes_of(counts: np.ndarray) -> np.ndarray:
    load = float(np.median(counts))
    bound = load + 3 * load**0.5 + 2
    return np.where(counts <= bound, 0, 1 + np.log2(np.maximum(counts / bound, 1)).astype(np.int64)).clip(0, 255).astype(np.uint8)


def _postings(docs: DataFrame, classes: np.ndarray, n: int, percent: int) -> DataFrame:
    """(key, kind, class, doc_id) of every distinct set of a task."""
    names, kinds = ["key", "kind", "class", "doc_id"], (pa.int64(), pa.int32(), pa.int64(), pa.int64())

    def posted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = set()
        for batch in batches:
            held, size = [], 0
            for doc_id, text in zip(batch.column(0), batch.column(1), strict=True):
                tokens = shingle_set(text.as_py(), n)
                own = digest(tokens)
                if own in seen:
                    continue
                seen.add(own)
                keys, kind = index_keys(tokens, classes, percent)
                if len(keys):
                    held.append((keys, kind, np.full(len(keys), own), np.full(len(keys), doc_id.as_py())))
                    size += len(keys)
                if size > 100_000:
                    yield pa.RecordBatch.from_arrays([_signed(np.concatenate([x[0] for x in held])), *[pa.array(np.concatenate([x[i] for x in held]), kinds[i]) for i in (1, 2, 3)]], names)
                    held, size = [], 0
            if held:
                yield pa.RecordBatch.from_arrays([_signed(np.concatenate([x[0] for x in held])), *[pa.array(np.concatenate([x[i] for x in held]), kinds[i]) for i in (1, 2, 3)]], names)

    return docs.mapInArrow(posted, "key long, kind int, class long, doc_id long")


def _met(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows in order of key and doc_id: those of keys with two classes or more, with the class of the first row as pivot. Streams; holds one row of a key."""
    key = first = None
    shown = False
    for batch in batches:
        out = []
        for k, c, i in zip(*(batch.column(j).to_pylist() for j in range(3)), strict=True):
            if k != key:
                key, first, shown = k, (c, i), False
            elif c != first[0]:
                if not shown:
                    out.append((k, RARE, *first, first[0]))
                    shown = True
                out.append((k, RARE, c, i, first[0]))
        columns = zip(*out, strict=True) if out else [[]] * 5
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()), strict=True)], ["key", "kind", "class", "doc_id", "pivot"])


def _members(postings: DataFrame) -> DataFrame:
    """(key, kind, class, doc_id, pivot) of keys in which different classes meet.

    A rare token's counter is below the sketch's bound, so the token itself is in no more sets than some deviations of a
    counter's load (some ten thousand at 100 TB): its postings go to one task, which streams them in order. Keys of frequent tokens may be in any share of the
    documents: their pivots are minima, combined on the map side, and the join is one that AQE splits.
    """
    rare = postings.filter(F.col("kind") == RARE).select("key", "class", "doc_id").repartition("key").sortWithinPartitions("key", "doc_id")
    rare = rare.mapInArrow(_met, "key long, kind int, class long, doc_id long, pivot long")
    often = postings.filter(F.col("kind") != RARE)
    wide = F.when(F.col("kind") == OFTEN, F.struct("doc_id", "class"))
    keys = often.groupBy("key").agg(F.min(wide).alias("pivot"), F.min("class").alias("least"), F.max("class").alias("most"))
    keys = written(keys.filter(F.col("pivot").isNotNull() & (F.col("least") != F.col("most"))).select("key", F.col("pivot.class").alias("pivot")), "jaccard-keys")
    return rare.unionByName(often.join(keys.hint("shuffle_merge"), "key"))


def _may_link(n_a: Column, n_b: Column, bits_a: list[Column], bits_b: list[Column], percent: int) -> Column:
    """Whether sizes and signatures allow 100 * intersection >= percent * union; never false for sets that link."""
    sizes = (F.least(n_a, n_b) * 100 >= F.greatest(n_a, n_b) * percent)
    differ = sum((F.bit_count(x.bitwiseXOR(y)) for x, y in zip(bits_a, bits_b, strict=True)), F.lit(0))
    return sizes & (differ * (100 + percent) <= (n_a + n_b) * (100 - percent))


def _thinned(pairs: DataFrame, classes: DataFrame, percent: int, name: str) -> DataFrame:
    """The pairs (a, b) whose sizes and signatures allow the threshold, written; none that is over it is lost."""

    def possible(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for a, b, n, x, m, y in zip(*(batch.column(i).to_pylist() for i in range(6)), strict=True):
                if min(n, m) * 100 >= max(n, m) * percent and differ_at_least(x, y) * (100 + percent) <= (n + m) * (100 - percent):
                    out.append((a, b))
            columns = zip(*out, strict=True) if out else [[], []]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["a", "b"])

    side = lambda c: classes.select(F.col("class").alias(c), F.col("n").alias(f"n_{c}"), F.col("bits").alias(f"bits_{c}")).hint("shuffle_merge")
    half = written(pairs.join(side("a"), "a"), f"{name}-half")  # cut here, so that AQE can split either join
    both = half.join(side("b"), "b").select("a", "b", "n_a", "bits_a", "n_b", "bits_b")
    out = written(both.mapInArrow(possible, "a long, b long"), f"{name}-pairs")
    release(half)
    return out


def _verified(pairs: DataFrame, docs: DataFrame, classes: DataFrame, n: int, percent: int, name: str) -> DataFrame:
    """The pairs (a, b) of classes whose whole sets are over the threshold."""
    needed = pairs.select(F.col("a").alias("class")).union(pairs.select("b")).distinct()
    known = written(needed.join(classes.select("class", "doc_id").hint("shuffle_merge"), "class"), f"{name}-needed")

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [shingle_set(t.as_py(), n) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([pa.array([digest(s) for s in sets], pa.int64()), pa.array([s.tobytes() for s in sets], pa.binary())], ["class", "tokens"])

    def checked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for a, b, x, y in zip(*(batch.column(i) for i in range(4)), strict=True):
                s, t = (np.frombuffer(v.as_buffer(), np.uint64) for v in (x, y))
                shared = len(np.intersect1d(s, t, assume_unique=True))
                if 100 * shared >= percent * (len(s) + len(t) - shared):
                    out.append((a.as_py(), b.as_py()))
            columns = zip(*out, strict=True) if out else [[], []]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["a", "b"])

    texts = keep_ids(docs, known.select("doc_id"), "doc_id")
    sets = written(texts.mapInArrow(whole, "class long, tokens binary"), f"{name}-sets")
    left = sets.select(F.col("class").alias("a"), F.col("tokens").alias("a_tokens")).hint("shuffle_merge")
    right = sets.select(F.col("class").alias("b"), F.col("tokens").alias("b_tokens")).hint("shuffle_merge")
    both = pairs.select("a", "b").join(left, "a").join(right, "b").select("a", "b", "a_tokens", "b_tokens")
    links = written(both.mapInArrow(checked, "a long, b long"), f"{name}-links")
    release(sets, known)
    return links


def _open_keys(placed: DataFrame) -> DataFrame:
    """(key, m) of the keys in which components still meet, one of all that hold the same rows (class, kind), m in number.

    Such keys, of the tokens that the same sets share, would form the same pairs. Rows are compared by their number and
    by sums of two 64-bit hashes, in halves so that they hold two billion rows.
    """
    halves = lambda h: (F.shiftright(h, 32), h.bitwiseAND(F.lit(0xFFFFFFFF)))
    sums = [F.sum(x).alias(f"s{i}") for i, x in enumerate(halves(F.xxhash64("class", "kind")) + halves(F.xxhash64(F.lit(1), "kind", "class")))]
    keys = placed.groupBy("key").agg(F.min("root").alias("x"), F.max("root").alias("y"), F.count("*").alias("m"), *sums).filter("x <> y")
    return keys.groupBy("m", *[f"s{i}" for i in range(4)]).agg(F.min("key").alias("key"))


def similar_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = SHINGLE_WORDS, percent: int = PERCENT) -> DataFrame:
    """One row per row of docs: doc_id, n_shingles, component_id (the smallest doc_id reachable by links, itself included).

    A null text counts as empty; documents without words have no shingles and are their own component. Equal sets are
    linked. Very long texts are hashed in pieces, whole. Repeated rows of a doc_id are rows of their own; a null doc_id
    links with nothing and has a null component. Of documents with equal sets the smallest id stands for them. An empty
    table gives no rows; other columns are ignored.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    known = written(rows.mapInArrow(lambda batches: _sets(batches, n), _ROW), "jaccard-sets")
    sets = known.filter(F.col("n").isNotNull()).select("doc_id", "n", "class", *_BITS, "bits")
    some = sets.filter((F.col("n") > 0) & F.col("doc_id").isNotNull())
    alike = F.struct("doc_id", "n", *_BITS, "bits")
    merged = some.groupBy("class").agg(F.min(alike).alias("x"), F.count("*").alias("n_docs"))
    classes = written(merged.select("class", "n_docs", "x.*"), "jaccard-classes")

    levels = frequency_classes(known.filter(F.col("chunk").isNotNull()).select("part", "chunk", "counts"))
    postings = written(_postings(rows.filter(F.col("doc_id").isNotNull()), levels, n, percent), "jaccard-postings")
    members = written(_members(postings), "jaccard-members")
    release(postings)

    star = members.filter(F.col("class") != F.col("pivot")).select(F.col("class").alias("a"), F.col("pivot").alias("b")).distinct()
    links = _verified(_thinned(star, classes, percent, "jaccard-star"), rows, classes, n, percent, "jaccard-star")
    roots = components(links, "jaccard-first")

    placed = members.join(roots.select(F.col("node").alias("class"), "root").hint("shuffle_merge"), "class", "left")
    placed = written(placed.select("key", "kind", "class", F.coalesce("root", "class").alias("root")), "jaccard-placed")
    open_keys = written(_open_keys(placed).select("key", F.ceil(F.col("m") / BLOCK).cast("int").alias("blocks")), "jaccard-open-keys")
    open_ = written(placed.join(open_keys.hint("shuffle_merge"), "key"), "jaccard-open")
    open_ = open_.join(classes.select("class", "n", *_BITS).hint("shuffle_merge"), "class").withColumn("block", F.pmod(F.xxhash64("class"), F.col("blocks")).cast("int"))
    blocked = written(open_.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))), "jaccard-open")
    meets = [F.col("key"), F.least("block", "other").alias("lo"), F.greatest("block", "other").alias("hi")]
    a = blocked.select(*meets, *[F.col(c).alias(f"a_{c}") for c in ("class", "kind", "root", "n", "block", *_BITS)])
    b = blocked.select(*meets, *[F.col(c).alias(f"b_{c}") for c in ("class", "kind", "root", "n", "block", *_BITS)]).hint("shuffle_merge")
    b = b.select(F.col("key").alias("b_key"), F.col("lo").alias("b_lo"), F.col("hi").alias("b_hi"), *[c for c in b.columns if c.startswith("b")])
    bits = lambda c: [F.col(f"{c}_{b}") for b in _BITS]
    fits = (F.col("a_class") < F.col("b_class")) & (F.col("a_root") != F.col("b_root")) & ~((F.col("a_kind") == NARROW) & (F.col("b_kind") == NARROW)) & _may_link(F.col("a_n"), F.col("b_n"), bits("a"), bits("b"), percent)
    once = (F.col("lo") == F.col("hi")) | (F.col("a_block") != F.col("b_block"))
    crossed = a.join(b.hint("shuffle_merge"), (F.col("key") == F.col("b_key")) & (F.col("lo") == F.col("b_lo")) & (F.col("hi") == F.col("b_hi")) & once & fits)
    crossed = crossed.select(F.col("a_class").alias("a"), F.col("b_class").alias("b")).distinct()
    more = _verified(_thinned(crossed, classes, percent, "jaccard-cross"), rows, classes, n, percent, "jaccard-cross")
    if not more.isEmpty():
        roots = components(links.union(more), "jaccard-second")

    grouped = classes.select("class", "doc_id", "n_docs").join(roots.select(F.col("node").alias("class"), "root").hint("shuffle_merge"), "class", "left")
    grouped = written(grouped.withColumn("root", F.coalesce("root", "class")), "jaccard-grouped")
    ids = written(grouped.groupBy("root").agg(F.min("doc_id").alias("component_id")), "jaccard-ids")
    final = written(grouped.join(ids.hint("shuffle_merge"), "root").select("class", "n_docs", "component_id"), "jaccard-final")
    linked = attach(some.select("doc_id", "n", "class"), final, "class", "n_docs", some.count())
    alone = sets.filter((F.col("n") == 0) | F.col("doc_id").isNull()).withColumn("component_id", F.col("doc_id"))
    return linked.select("doc_id", F.col("n").alias("n_shingles"), "component_id").unionByName(alone.select("doc_id", F.col("n").alias("n_shingles"), "component_id"))


def keep_one(docs: DataFrame, id_col: str = "doc_id", n: int = 5, percent: int = 80) -> DataFrame:
    """docs with one document of each component, that with the smallest id; all columns, unchanged. Rows with a null id stay."""
    found = similar_components(docs, id_col, n=n, percent=percent)
    dropped = written(found.filter(F.col("doc_id") != F.col("component_id")).select(F.col("doc_id").alias(id_col)), "jaccard-dropped")
    return keep_ids(docs, dropped, id_col, "left_anti").select(*docs.columns)
