"""Tables of a data folder."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lodestrata.session import reachable


def load(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A Parquet table of the folder; filters and column selections reach its scan."""
    reachable(spark)
    return spark.read.parquet(f"{folder}/{name}.parquet")


def views(spark: SparkSession, folder: str, names: list[str]) -> None:
    """Registers tables as temporary views, for spark.sql()."""
    for name in names:
        load(spark, folder, name).createOrReplaceTempView(name)
