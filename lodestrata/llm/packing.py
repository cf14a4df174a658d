"""Sum-of-squares packing of token streams into windows of a fixed size.

A document's whole windows are sequences of their own. Its rest goes, online, to the fill level that minimises the sum
of the squared numbers of partially filled windows, which a level array tracks. Documents may be cut freely, so there is
a second way to place a rest that is too long for some window: its first ids fill that window, and what remains is placed
likewise. A cut counts as CUT_COST squares, so it is made where the counts would otherwise grow; that keeps the open
windows few (a level that holds two is cut into before it holds many), whatever the number of documents. At a task's end
the emptiest open windows fill the fullest ones; of the last window, the only partial one, the parts are powers of two,
for which no padding is needed.

Every input partition packs by itself: no shuffle, and a lost task gives the same rows again.
"""

from __future__ import annotations

import base64
import re
import zlib
from collections import deque
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Squares that a cut must save beyond its own placements to be made.
CUT_COST = 2

#: Sequence numbers of one partition.
SPAN = 1 << 36

_NAMES = ("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")
_SCHEMA = ", ".join(f"{n} long" for n in _NAMES)


class Levels:
    """The level array: counts[h] windows are filled up to h, 0 < h < size; `open` has their numbers and pieces.

    whole, cut and laid count the rests that were placed whole, in two pieces, and laid elsewhere at the end.

    A piece is (doc_id, start, ids, doc_tokens). Of placements of equal cost the one at the fullest level is taken, of
    windows at a level the last one that came there.
    """

    def __init__(self, size: int):
        self.size, self.counts, self.open = size, np.zeros(size + 1, np.int64), [[] for _ in range(size)]
        self.cut = self.whole = self.laid = 0

    def best(self, length: int) -> tuple[int, int]:
        """(change of the sum of squares, level) of the best place for a whole piece; level 0 is a new window."""
        size, n = self.size, self.counts
        new = 2 * int(n[length]) + 1
        used = np.flatnonzero(n[1 : size - length + 1]) + 1
        if not len(used):
            return new, 0
        after = used + length
        cost = np.where(after < size, 2 * (n[after] - n[used]) + 2, 1 - 2 * n[used])
        at = len(cost) - 1 - int(np.argmin(cost[::-1]))
        return (int(cost[at]), int(used[at])) if cost[at] <= new else (new, 0)

    def best_cut(self, length: int) -> tuple[int, int, int]:
        """(change of the sum, level that the first part fills, level for the remainder); both by the counts as they are."""
        size, n = self.size, self.counts
        used = np.flatnonzero(n)
        over = used[used > size - length]
        if not len(over):
            return 1 << 40, 0, 0
        left = over + length - size
        after = left[:, None] + used
        cost = np.where(after < size, 2 * (n[np.minimum(after, size)] - n[used]) + 2, np.where(after == size, 1 - 2 * n[used], 1 << 40))
        cost[(over[:, None] == used) & (n[used] == 1)] = 1 << 40  # that window is full then
        cost = np.column_stack([2 * n[left] + 1, cost]) + (1 - 2 * n[over])[:, None]
        i, j = divmod(int(np.argmin(cost)), cost.shape[1])
        return int(cost[i, j]), int(over[i]), int(used[j - 1]) if j else 0

    def _put(self, piece: tuple, level: int, number: Iterator[int]) -> Iterator[tuple]:
        """Puts a piece into a window of a level; gives the window (its number, its pieces) if that is full now."""
        if level:
            window = self.open[level].pop()
            self.counts[level] -= 1
        else:
            window = (next(number), [])
        window[1].append(piece)
        level += len(piece[2])
        if level == self.size:
            yield window
            return
        self.open[level].append(window)
        self.counts[level] += 1

    def place(self, piece: tuple, number: Iterator[int]) -> Iterator[tuple]:
        """Puts a piece down, whole or cut in two; gives the windows that are full now."""
        doc_id, start, ids, total = piece
        cost, level = self.best(len(ids))
        with_cut, at, there = self.best_cut(len(ids))
        if with_cut + CUT_COST < cost:
            self.cut += 1
            part = self.size - at
            yield from self._put((doc_id, start, ids[:part], total), at, number)
            yield from self._put((doc_id, start + part, ids[part:], total), there, number)
        else:
            self.whole += 1
            yield from self._put(piece, level, number)

    def close(self) -> tuple[list[tuple], list[tuple]]:
        """(full windows, pieces of the one that isn't): the emptiest open windows fill the fullest."""
        windows = deque(w for level in range(self.size - 1, 0, -1) for w in self.open[level])
        full: list[tuple] = []
        torn = None
        while len(windows) > 1:
            number, pieces = windows.popleft()
            room = self.size - sum(len(x[2]) for x in pieces)
            while room and windows:
                spare = windows[-1][1]
                if spare is not torn:
                    torn, self.laid = spare, self.laid + len(spare)
                doc_id, start, ids, total = spare.pop()
                pieces.append((doc_id, start, ids[:room], total))
                if len(ids) > room:
                    spare.append((doc_id, start + room, ids[room:], total))
                room -= min(room, len(ids))
                if not spare:
                    windows.pop()
            if room:
                windows.append((number, pieces))
            else:
                full.append((number, pieces))
        self.counts[:] = 0
        self.open = [[] for _ in range(self.size)]
        return full, windows[0][1] if windows else []


def _rows(number: int, pieces: list[tuple]) -> Iterator[tuple]:
    """Output rows of a window."""
    offset = 0
    for doc_id, start, ids, total in pieces:
        yield doc_id, start, len(ids), zlib.crc32(ids.tobytes()), total, number, offset
        offset += len(ids)


def pack_stream(docs: Iterator[tuple[int | None, np.ndarray]], size: int, first: int = 0, levels: Levels | None = None) -> Iterator[tuple]:
    """Packs (doc_id, ids) one after another; rows as in pack()."""
    number = iter(range(first, first + SPAN))
    levels = levels or Levels(size)
    for doc_id, ids in docs:
        whole = len(ids) // size * size
        for start in range(0, whole, size):
            yield from _rows(next(number), [(doc_id, start, ids[start : start + size], len(ids))])
        if whole < len(ids):
            for full in levels.place((doc_id, whole, ids[whole:], len(ids)), number):
                yield from _rows(*full)
    closed, pieces = levels.close()
    for full in closed:
        yield from _rows(*full)
    left = sum(len(x[2]) for x in pieces)
    rest = deque(pieces)
    while left:
        room = 1 << (left.bit_length() - 1)
        left -= room
        window = []
        while room:
            doc_id, start, ids, total = rest.popleft()
            window.append((doc_id, start, ids[:room], total))
            if len(ids) > room:
                rest.appendleft((doc_id, start + room, ids[room:], total))
            room -= min(room, len(ids))
        yield from _rows(next(number), window)


class Tokens:
    """ids of byte_bpe_50k for whole texts, as `tokenizers` gives them.

    The rank file holds the JSON file's vocabulary and merges; its encoder splits every code point in the same way (a
    test goes through all of them) and gives the same ids several times as fast. It can't read a run of about a million
    white-space characters, and doesn't know the special token: texts with either go to `tokenizers` itself.
    """

    SPECIAL = "<|endoftext|>"
    LONG_RUN = re.compile(r"\s{20000}")

    def __init__(self, json_path: str, ranks_path: str, pattern: str):
        import tiktoken

        self.json_path, self.own = json_path, None
        with open(ranks_path, "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        self.fast = tiktoken.Encoding("byte_bpe_50k", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})

    def __call__(self, text: str) -> list[int]:
        if self.SPECIAL not in text and not (len(text) >= 20000 and self.LONG_RUN.search(text)):
            return self.fast.encode_ordinary(text)
        if self.own is None:
            from tokenizers import Tokenizer

            self.own = Tokenizer.from_file(self.json_path)
        return self.own.encode(text, add_special_tokens=False).ids


def public_tokens() -> tuple[str, str, str]:
    """Paths and split pattern of the public byte-level vocabulary."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN


def pack(docs: DataFrame, size: int = 1024, end_id: int = 0, tokenizer: tuple[str, str, str] | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    A document is its text's ids, then end_id; a null or empty text is end_id alone. Repeated rows and null ids are
    documents of their own. Very long texts, and very long runs of white space, are encoded whole and cut at every
    `size` ids. Ties between levels go to the fullest (see Levels). An empty table gives no rows; other columns are
    ignored.
    """
    paths = tokenizer or public_tokens()

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = Tokens(*paths)

        def stream():
            for batch in batches:
                for doc_id, text in zip(batch.column(0), batch.column(1), strict=True):
                    yield doc_id.as_py(), np.fromiter(chain(tokens(text.as_py() or ""), (end_id,)), np.dtype("<u4"))

        held = []
        for row in pack_stream(stream(), size, TaskContext.get().partitionId() * SPAN):
            held.append(row)
            if len(held) == 8192:
                yield _arrow(held)
                held = []
        yield _arrow(held)

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(packed, _SCHEMA)


def _arrow(rows: list[tuple]) -> pa.RecordBatch:
    columns = zip(*rows, strict=True) if rows else [[] for _ in _NAMES]
    return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], list(_NAMES))
