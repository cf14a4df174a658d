"""What the operators share: the scratch folder, written tables, and joins that keep hot keys apart."""

from __future__ import annotations

import atexit
import gc
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestrata.scratch import scratch_dir
from lodestrata.session import reachable

#: A side of at most so many narrow rows (ids of 8 bytes) is broadcast; beyond it the join shuffles.
BROADCAST_IDS = 500_000

#: A key with over 1/HOT_SHARE of all rows is hot, so there are fewer than HOT_SHARE hot keys at any size.
HOT_SHARE = 1000

_written: list = []


#: Rows and bytes of an Arrow batch: a Python worker holds a few copies of one, and a task may run two workers.
BATCH_ROWS, BATCH_BYTES = 1000, 8 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    reachable(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def written(df: DataFrame, name: str) -> DataFrame:
    """Writes df as Parquet in the scratch folder and reads it back: cuts the lineage, survives lost executors.

    The files go when the Python process ends; see clean().
    """
    spark = df.sparkSession
    path = f"{scratch_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _written.append((spark, path))
    return spark.read.schema(df.schema).parquet(path)


def release(*tables: DataFrame) -> None:
    """Deletes tables that written() has left and nothing reads any more, and lets go of shuffle files.

    Spark deletes a shuffle's files once its dependency is collected as garbage on the driver, which on a quiet driver
    may take long after the last use.
    """
    for df in tables:
        for spark, path in [x for x in _written if f"{x[1]}/" in str(df.inputFiles()[:1])]:
            _delete(spark, path)
            _written.remove((spark, path))
    gc.collect()
    for spark in {id(df.sparkSession): df.sparkSession for df in tables}.values():
        spark.sparkContext._jvm.System.gc()


def _delete(spark: SparkSession, path: str) -> None:
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def clean() -> None:
    """Deletes the tables that written() has left; DataFrames that read them can't be used afterwards."""
    while _written:
        spark, path = _written.pop()
        try:
            _delete(spark, path)
        except Exception:  # noqa: BLE001  the session has ended; the cluster cleans its scratch folder
            return


atexit.register(clean)


def keep_ids(rows: DataFrame, ids: DataFrame, key: str, how: str = "left_semi") -> DataFrame:
    """rows whose key is (left_semi) or isn't (left_anti) in ids, a written table of one narrow column.

    The ids are counted first: up to BROADCAST_IDS of them are broadcast, so that wide rows needn't move; more are
    joined by a shuffle.
    """
    ids = ids.select(key)
    if ids.count() <= BROADCAST_IDS:
        ids = F.broadcast(ids)
    else:
        ids = ids.hint("shuffle_merge")
    return rows.join(ids, key, how)


def attach(rows: DataFrame, classes: DataFrame, key: str, size: str, total: int) -> DataFrame:
    """Inner join of narrow rows with classes, which are unique by key; `size` holds a class's number of rows.

    Classes with over 1/HOT_SHARE of all rows are fewer than HOT_SHARE whatever the input is: they are broadcast and
    their rows stay where they are. All other keys are small beside a partition and are joined by a shuffle.
    """
    hot = classes.filter(F.col(size) * HOT_SHARE > F.lit(total))
    cold = classes.filter(F.col(size) * HOT_SHARE <= F.lit(total))
    here = rows.join(F.broadcast(hot), key)
    rest = rows.join(F.broadcast(hot.select(key)), key, "left_anti").join(cold.hint("shuffle_merge"), key)
    return here.unionByName(rest)
