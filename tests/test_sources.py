"""Readers, sinks, routing and gates."""

import json

import pytest
from pyspark.sql import functions as F

from lodestrata.functions import udf
from lodestrata.operators import ingest, quality
from lodestrata.plans import registry
from lodestrata.sources import readers, sinks
from lodestrata.streaming import streams


def test_json_lines_keep_bad_rows(spark, tmp_path):
    (tmp_path / "c.jsonl").write_text(json.dumps({"claim_id": "1", "claim_type": "method"}) + "\nnot json\n")
    got = readers.json_lines(spark, str(tmp_path / "c.jsonl"), readers.CLAIM).select("claim_id", "_bad").collect()
    assert {(r["claim_id"], r["_bad"]) for r in got} == {("1", None), (None, "not json")}


def test_json_files_and_package(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.json").write_text(json.dumps({"doi": "10.1/A", "title": "t", "authors": ["x"]}, indent=1))
    df = readers.json_files(spark, str(tmp_path / "in"), readers.SOURCE)
    assert df.count() == 1
    sinks.package({"sources": df.drop("_file")}, str(tmp_path / "out"), {"sources": "doi"})
    assert spark.read.json(str(tmp_path / "out" / "sources")).count() == 1


def test_public_projection_hides_tables_and_columns(spark):
    claims = spark.createDataFrame([("1", "secret")], "claim_id string, api_key string")
    out = sinks.public({"claims": claims, "users": claims})
    assert list(out) == ["claims"] and out["claims"].columns == ["claim_id"]


def test_publish_refuses_a_version_twice(spark, tmp_path):
    df = spark.range(3)
    sinks.publish(df, str(tmp_path / "t"), "1", "lodestrata_published")
    assert spark.table("lodestrata_published").count() == 3
    with pytest.raises(Exception, match="EXISTS"):
        sinks.publish(df, str(tmp_path / "t"), "1", "lodestrata_published")


def test_upsert_is_idempotent(spark):
    base = spark.createDataFrame([(1, "a", 1), (2, "b", 1)], "k int, v string, t int")
    new = spark.createDataFrame([(2, "c", 2), (3, "d", 1)], "k int, v string, t int")
    once = ingest.upsert(base, new, ["k"], ["t"])
    twice = ingest.upsert(once, new, ["k"], ["t"])
    assert sorted(map(tuple, once.collect())) == sorted(map(tuple, twice.collect())) == [(1, "a", 1), (2, "c", 2), (3, "d", 1)]


def test_gates(spark):
    g = quality.gates(spark.createDataFrame([(0, 3)], "a int, b int"), {"a": 0, "b": 2})
    with pytest.raises(AssertionError, match="b: 3 > 2"):
        quality.enforce(g)


def test_scorers_in_sql(spark):
    udf.register_all(spark)
    assert spark.sql("SELECT query_normalise('The Suzuki coupling?') AS q").first()["q"] == "suzuki coupling"
    assert spark.createDataFrame([("zinc vs copper",)], "q string").select(udf.apply("query_decompose", F.col("q")).alias("p")).first()["p"] == ["zinc", "copper"]


def test_streams_read_tables_of_one_file_and_of_many(spark, tmp_path):
    df = spark.range(20).selectExpr("id AS vec_id")
    df.repartition(3).write.parquet(str(tmp_path / "embeddings.parquet"))
    spark.range(0, 20, 4).selectExpr("id AS doc_id").toPandas().to_parquet(tmp_path / "labels.parquet")
    found = registry.queries()["stream_incremental_ids"](spark, str(tmp_path))
    assert sorted(r["vec_id"] for r in found.collect()) == [i for i in range(20) if i % 4]
    assert streams.replay(streams.table_stream(spark, str(tmp_path), "labels")).count() == 5
