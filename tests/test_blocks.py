"""Products of blocks against plain loops, with parts smaller than the blocks, and overlaps of many like answers."""

import time
from decimal import ROUND_HALF_UP, Decimal

import numpy as np
from pyspark.sql import functions as F

from lodestrata.operators import blocks, evaluate, graph, pairs
from lodestrata.plans import registry


def six(x):
    return float(Decimal(repr(x)).quantize(Decimal("1e-6"), ROUND_HALF_UP))


def test_fingerprints_match_a_plain_loop(spark, monkeypatch):
    draw = np.random.default_rng(5)
    base = draw.integers(-(2**63), 2**63 - 1, (6, 4))
    rows = [(i, "xy"[i % 2], [int(v) for v in base[draw.integers(6)] ^ (1 << draw.integers(0, 62, 4))]) for i in range(70)]
    rows += [(70, "x", [0] * 4), (71, "x", [0] * 4), (72, "x", None), (73, None, [1] * 4), (74, "y", [-1] * 4)]
    monkeypatch.setattr(blocks.meetings, "__defaults__", (8,))
    got = pairs.fingerprint_pairs(spark.createDataFrame(rows, "id long, block string, bits array<long>"), "id", "bits", "block", 0.5)
    count = lambda v, w, f: sum((f(p, q) & (2**64 - 1)).bit_count() for p, q in zip(v, w, strict=True))
    want = []
    for a, x, v in rows:
        for b, y, w in rows:
            if a < b and x == y and v and w and (either := count(v, w, int.__or__)) and six(count(v, w, int.__and__) / either) >= 0.5:
                want.append((a, b, six(count(v, w, int.__and__) / either)))
    assert sorted(map(tuple, got.collect())) == sorted(want) and len(want) > 50


def test_fingerprints_of_keys_whose_products_overflow(spark, tmp_path):
    """Keys over 262,143 failed by ARITHMETIC_OVERFLOW; a fingerprint holds the low 64 bits of the products."""
    keys = [*range(0, 262_144, 9_000), *range(262_130, 262_160), *range(1_199_900, 1_200_000), 2**31, 2**32 - 1, 2**32, 2**40 + 3, 2**53 + 1, 2**63 - 1, -1, -7, -(2**62), -(2**63)]
    table = spark.createDataFrame([(k, "ab"[i % 2]) for i, k in enumerate(keys)] + [(None, "a"), (5, None)], "p_partkey long, p_name string")
    table.coalesce(1).write.parquet(str(tmp_path / "part.parquet"))
    mark = {k: sum((k * 1099511627791 * i) % 2**64 << 64 * i for i in range(1, 33)) for k in keys}
    want = []
    for i, a in enumerate(keys):
        for b in keys[i % 2 :: 2]:
            if a < b and (s := six((mark[a] & mark[b]).bit_count() / (mark[a] | mark[b]).bit_count())) >= 0.5:
                want.append((a, b, s))
    got = registry.queries()["bit_tanimoto"](spark, str(tmp_path)).select("a", "b", "similarity").collect()
    assert sorted(map(tuple, got)) == sorted(want) and sum(b > 262_143 for _, b, _ in want) > 50


def test_overlaps_of_parts_and_tiles(spark):
    """Small parts and tiles, arrays of other lengths, nulls and ids of text give each pair once."""
    draw = np.random.default_rng(8)
    rows = [(f"k{draw.integers(10**6)}", "xy"[i % 2], [int(v) for v in draw.integers(-(2**63), 2**63 - 1, 2 + i % 3 // 2)]) for i in range(120)]
    rows += [("k1", "x", [0, 0]), ("k2", "x", [0, 0]), ("k3", "x", [1, None]), ("k4", "x", None), ("k5", "x", []), ("k6", "y", [-1, -1])]
    got = blocks.bit_overlaps(spark.createDataFrame(rows, "id string, block string, v array<long>"), 0.3, part=16, tile=5).collect()
    want = []
    for a, x, v in rows:
        for b, y, w in rows:
            if a < b and x == y and v and w and None not in v + w and len(v) == len(w):
                both, either = (sum((f(p, q) & (2**64 - 1)).bit_count() for p, q in zip(v, w, strict=True)) for f in (int.__and__, int.__or__))
                if both >= 0.3 * either:
                    want.append((a, b, both, either))
    assert sorted(map(tuple, got)) == sorted(want) and len(want) > 500


def test_links_have_the_components_of_all_pairs(spark, monkeypatch):
    draw = np.random.default_rng(6)
    rows = [(i, i % 3, [float(x) for x in np.float32(draw.normal(size=8) / 3)]) for i in range(150)]
    rows += [(200 + i, 0, [0.5, 0.4999990] + [0.0] * 6) for i in range(3)] + [(300, 1, [0.4999995] + [0.0] * 7), (301, 1, [0.9999999] + [0.0] * 7)]
    rows += [(400, 7, [0.1] * 8), (401, 7, [0.1] * 8), (402, 7, None), (403, 7, [1.0, None]), (404, None, [1.0] * 8)]
    monkeypatch.setattr(blocks.meetings, "__defaults__", (16,))
    table = spark.createDataFrame(rows, "id long, block int, v array<double>")
    links = [(a, b) for a, x, v in rows for b, y, w in rows if a < b and x == y and v and w and None not in v + w and six(sum(p * q for p, q in zip(v, w, strict=True))) >= 0.5]
    root = {n: n for link in links for n in link}
    for _ in root:
        for a, b in links:
            root[a] = root[b] = min(root[a], root[b])
    got = {r["node"]: r["root"] for r in graph.components(blocks.similar_links(table, 0.5)).collect()}
    assert got == root and len(set(root.values())) < len(root)


def test_like_answers_are_not_paired(spark):
    """20,000 answers of one set of papers would be 400 million pairs a paper."""
    n = 20_000
    s = spark.range(n + 3).select(F.col("id").alias("answer"), F.lit(1).alias("pos"), F.lit("of 5 mg").alias("text"), F.expr(f"CASE WHEN id < {n} THEN array('a', 'b') WHEN id = {n} THEN array('a', 'c', 'd') WHEN id = {n} + 1 THEN array('c', 'd', 'e', 'f') ELSE array('z') END").alias("dois"), F.lit(True).alias("inside"))
    known = spark.createDataFrame([("a", 2000)], "doi string, year int")
    began = time.perf_counter()
    got = evaluate.answer_metrics(s, known, 2002).groupBy("cited", "existing", "overlap").count().collect()
    assert time.perf_counter() - began < 60
    assert sorted(map(tuple, got)) == [(1, 0, 0.0, 1), (2, 1, 1.0, n), (3, 1, 0.666667, 1), (4, 0, 0.5, 1)]
