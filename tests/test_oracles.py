"""Every registered query of the library against its SQL in DuckDB, and the shape of those without."""

import duckdb
import pytest
from pyspark.sql import functions as F

from lodestrata.plans import registry
from tests.oracle import connect, oracle_rows, rows_of

QUERIES, SQL = registry.queries(), registry.oracle_sql()


@pytest.fixture(scope="module")
def duck(small):
    return connect(small)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, small, duck, name):
    df = QUERIES[name](spark, small)
    if name not in SQL:
        assert df.columns and df.collect() is not None
        return
    assert rows_of(df) == oracle_rows(duck, SQL[name])


def test_node_append_with_keys_that_the_tree_has(spark, small, tmp_path):
    part = spark.read.parquet(f"{small}/part.parquet").filter("p_partkey < 60")
    part = part.unionByName(part.withColumn("p_partkey", F.expr("p_partkey + 1000000"))).unionByName(part.withColumn("p_partkey", F.expr("p_partkey + 3000001")))
    part.toPandas().to_parquet(tmp_path / "part.parquet")
    duck = duckdb.connect()
    duck.execute(f"CREATE VIEW part AS SELECT * FROM '{tmp_path}/part.parquet'")
    assert rows_of(QUERIES["node_append"](spark, str(tmp_path))) == oracle_rows(duck, SQL["node_append"])
