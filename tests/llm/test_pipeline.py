"""The pipeline's stages against brute force, and its queries against their SQL."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from lodestrata.llm import quality, queries
from lodestrata.llm.runtime import table
from tests.llm.test_operators import brute_components, brute_groups, brute_leaks, check_pieces
from tests.oracle import connect, oracle_rows, rows_of


def test_stages_one_after_another(spark, small, tmp_path):
    docs = table(spark, small, "documents")
    columns = docs.columns
    labels = table(spark, small, "labels")
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        before = [(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()]
        stage(spark, docs, small).write.parquet(str(tmp_path / f"{i}"))
        out = spark.read.parquet(str(tmp_path / f"{i}"))
        if name == "quality_classifier":
            model = quality.train(docs, labels)
            want = {i for i, t in before if quality.scores(model, quality.features(t or "")[None, :])[0] >= quality.ACCEPT}
        elif name == "exact_dedup":
            want = {i for i, _, _, kept, _ in brute_groups(before) if kept}
        elif name == "ngram_jaccard_join":
            want = {i for i, _, root in brute_components(before, 5, 80) if i == root}
        elif name == "benchmark_decontamination":
            items = [(r["item_id"], r["text"]) for r in table(spark, small, "benchmark").collect()]
            want = {i for i, _ in before} - {x[0] for x in brute_leaks(before, items)}
        else:
            check_pieces(out.collect(), dict(before))
            continue
        assert out.columns == columns
        assert {r["doc_id"] for r in out.select("doc_id").collect()} == want
        docs = out


def test_run(spark, small):
    assert corpus_pipeline.run(spark, small).count() > 0
    assert corpus_pipeline.ORACLE_SQL is None


def test_registered_names():
    assert sorted(int(n[2:].split("_")[0]) for n in queries.queries()) == list(range(1, 11))


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_oracle(spark, small, name):
    assert rows_of(queries.queries()[name](spark, small)) == oracle_rows(connect(small), queries.oracle_sql()[name])


def test_empty_corpus(spark, small, tmp_path):
    for t in ("documents", "labels", "benchmark"):
        table(spark, small, t).filter(F.lit(False)).write.parquet(str(tmp_path / f"{t}.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_odd_rows_pass_every_stage(spark, small):
    """Null and repeated ids, null, empty and long texts, and columns named like those the operators use."""
    some = table(spark, small, "documents").limit(60)
    long = " ".join(f"w{i}" for i in range(20_000))
    rows = [(None, "no id at all"), (None, None), (9001, None), (9002, ""), (9003, long), (9004, "twice"), (9004, "twice"), (9005, "one text"), (9005, "another text")]
    odd = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    docs = some.unionByName(odd)
    for extra in ("class", "key", "root", "n", "keep_id", "component_id", "item_id", "hash", "norm", "y", "score"):
        docs = docs.withColumn(extra, F.lit("clash"))
    for name, stage in corpus_pipeline.STAGES[1:]:
        out = stage(spark, docs, small)
        if name == "packing":
            assert out.select("doc_id").distinct().count() == docs.select("doc_id").distinct().count()
            continue
        kept = {(r["doc_id"], r["text"]) for r in out.collect()}
        assert out.columns == docs.columns
        assert {(None, "no id at all"), (None, None), (9003, long), (9004, "twice")} <= kept
