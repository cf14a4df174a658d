"""Keys of the Jaccard join that hold the same rows form their pairs once."""

import numpy as np

from lodestrata.llm import jaccard_join as J


def test_keys_with_the_same_rows_are_one(spark):
    rows = [(k, 0, c, c) for k in (1, 2, 3) for c in (10, 11, 12)]  # three keys of the same sets
    rows += [(4, 0, 10, 10), (4, 0, 11, 11), (4, 0, 13, 13)]  # as many rows, another set
    rows += [(5, 1, 10, 10), (5, 1, 11, 11), (5, 1, 12, 12)]  # another kind
    rows += [(6, 0, 10, 10), (6, 0, 11, 11), (6, 0, 12, 12), (6, 0, 12, 12)]  # a set of two tasks
    rows += [(7, 0, 20, 20), (7, 0, 21, 20)]  # one component already
    got = J._open_keys(spark.createDataFrame(rows, "key long, kind int, class long, root long")).collect()
    assert sorted((r["key"], r["m"]) for r in got) == [(1, 3), (4, 3), (5, 3), (6, 4)]


def test_parities_tell_long_sets_apart():
    draw = np.random.default_rng(3)
    x, y = (np.unique(draw.integers(0, 1 << 63, 2000, np.uint64)) for _ in range(2))
    differ = sum((int(p) ^ int(q)).bit_count() for p, q in zip(J.parity(x).view(np.uint64), J.parity(y).view(np.uint64), strict=True))
    assert differ <= 4000 and differ * (100 + J.PERCENT) > (len(x) + len(y)) * (100 - J.PERCENT)
