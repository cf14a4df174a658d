"""The stored index against scans of the text, the result cache, and tree and label operators against plain loops."""

import random
import shutil

from pyspark.sql import functions as F

from lodestrata.operators import fts, pairs, search, taxonomy, text_index
from lodestrata.operators import evaluate as E
from lodestrata.tables import load

TERMS = ["thing", "ther", "eron"]


def ids(df):
    return sorted(r["id"] for r in df.collect())


def test_index_gives_what_scans_give(spark, small, tmp_path):
    docs = load(spark, small, "documents").select("doc_id", "text", "source").unionByName(spark.createDataFrame([(-1, None, "x"), (-2, "", "x"), (-3, "thing thing ther", "thing")], "doc_id long, text string, source string"))
    ix = text_index.build(docs, "doc_id", {"text": "text", "source": "source"}, str(tmp_path / "ix"), buckets=4)
    assert sorted(map(tuple, ix.bm25(TERMS).collect())) == sorted(map(tuple, fts.bm25(docs, "doc_id", "text", TERMS).collect()))
    for clause in (fts.Clause("all", ("thing", "ther")), fts.Clause("any", tuple(TERMS)), fts.Clause("phrase", ("of", "the")), fts.Clause("phrase", ("thing", "thing", "ther")), fts.Clause("near", ("thing", "ther"), 5), fts.Clause("prefix", ("thin",))):
        for field in ("text", "source", ""):
            c = fts.Clause(clause.kind, clause.terms, clause.gap, field)
            assert ids(ix.match(c)) == ids(c.match(docs, "doc_id", {"text": "text", "source": "source"})), c
    assert ids(ix.match_any(["nowhere"])) == [] and ix.bm25(["nowhere"]).count() == 0
    plan = ix.bm25(["thing"])._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters" in plan and "EqualTo(term,thing)" in plan.replace("In(term, [thing])", "EqualTo(term,thing)")


def test_stored_index_follows_the_files(spark, tmp_path):
    folder = tmp_path / "t"
    for words, want in (("alpha beta", 1), ("gamma", 0)):
        shutil.rmtree(folder, ignore_errors=True)
        spark.createDataFrame([(1, words)], "doc_id long, text string").write.parquet(str(folder))
        assert text_index.stored(spark.read.parquet(str(folder)), "doc_id", {"text": "text"}).match_any(["alpha"]).count() == want


def test_result_cache(spark):
    now, made = [0.0], []
    cache = search.ResultCache(most=2, seconds=10, clock=lambda: now[0])

    def make(n):
        return lambda: made.append(n) or spark.createDataFrame([(n,)], "n long")

    for key in ("a", "b", "a"):
        assert cache.get(spark, (key,), make(len(made))).count() == 1
    assert (cache.hits, cache.misses, len(made)) == (1, 2, 2)
    cache.get(spark, ("c",), make(9))  # b, the least used, goes
    assert set(cache.held) == {("a",), ("c",)}
    now[0] = 11.0
    cache.get(spark, ("a",), make(8))
    assert made[-1] == 8


def test_contained_items_of_any_length(spark):
    texts = ["one two three four five six seven", "xone two three", "two", "a one b", "", None]
    items = ["two three four five six", "one two", "wo", "ne two thr", "three", "missing words here now then", ""]
    docs = spark.createDataFrame(list(enumerate(texts)), "d long, text string")
    bench = spark.createDataFrame(list(enumerate(items)), "i long, text string")
    got = {(r["doc"], r["item"]) for r in pairs.contained_items(docs, bench, "d", "i").collect()}
    assert got == {(d, i) for d, t in enumerate(texts) for i, x in enumerate(items) if t and x and x in t}


def test_label_clusters_match_a_plain_loop(spark):
    draw = random.Random(3)
    words = ["hot", "ring", "rings", "rod", "small", "plate", "fine"]
    rows = [("b", "_".join(draw.sample(words, draw.randint(1, 4))), draw.randint(1, 9)) for _ in range(600)]
    rows = sorted({label: (b, label, n) for b, label, n in rows}.values())
    heads, want = [], {}
    for _, label, _ in sorted(rows, key=lambda r: (-r[2], r[1])):
        w = set(label.split("_"))
        for head in heads:
            h = set(head.split("_"))
            j = len(w & h) / len(w | h)
            if label.rstrip("s") == head.rstrip("s") or j >= 0.85 or j >= 0.7 and (w < h or h < w):
                want[label] = head
                break
        else:
            heads.append(label)
            want[label] = label
    got = pairs.greedy_clusters(spark.createDataFrame(rows, "block string, label string, n long"))
    assert {r["label"]: r["cluster"] for r in got.collect()} == want


def test_merges_make_no_circle(spark):
    edges = spark.createDataFrame([("r", "a"), ("a", "b"), ("b", "a2"), ("r", "c"), ("r", "c2"), ("c2", "d")], "parent string, child string")
    nodes = spark.createDataFrame([("r", "root", 0, 9), ("a", "x", 1, 5), ("b", "y", 2, 3), ("a2", "X", 3, 1), ("c", "z", 1, 2), ("c2", "Z ", 1, 1), ("d", "w", 2, 1)], "node string, name string, level int, leaves long")
    got, left = taxonomy.merge_to_fixpoint(edges, nodes)
    assert {tuple(r) for r in got.collect()} == {("r", "a"), ("a", "b"), ("b", "a2"), ("r", "c"), ("c", "d")}
    assert {r["node"]: r["leaves"] for r in left.collect()} == {"r": 9, "a": 5, "b": 3, "a2": 1, "c": 3, "d": 1}


def test_bootstrap_covers_the_mean_and_repeats(spark):
    df = spark.createDataFrame([(f"p{i}", (i % 7 - 3) / 10 + 0.05) for i in range(70)], "probe string, d double")
    a, b = E.bootstrap(df, "d").first(), E.bootstrap(df, "d").first()
    assert a == b and a["low"] < 0.05 < a["high"] and abs(a["mean"] - 0.05) < 0.01
    assert abs((a["high"] - a["low"]) / 2 - 1.96 * 0.2 / 70**0.5) < 0.01


def test_numbers_are_dense(spark):
    from lodestrata.operators.vectors import numbered

    rows = numbered(spark.range(5000).select((F.col("id") * 7919 % 5003).alias("v")), "v").collect()
    assert [r["row"] for r in sorted(rows, key=lambda r: r["v"])] == list(range(5000))
