"""The folder for intermediate tables: one that driver and executors share."""

from __future__ import annotations

import atexit
import shutil
import tempfile

from pyspark.sql import SparkSession


def scratch_dir(spark: SparkSession) -> str:
    """The folder named in spark.checkpoint.dir (or set as checkpoint folder).

    Where neither is there, a temporary one on a local master, which the driver and the tasks share, is set, and goes
    when the process ends; on a cluster that would be a folder nobody else can read, so it is an error.
    """
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not named:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        own = tempfile.mkdtemp(prefix="lodestrata-")
        atexit.register(shutil.rmtree, own, ignore_errors=True)
        named = f"file://{own}"
        if spark.conf.isModifiable("spark.checkpoint.dir"):
            spark.conf.set("spark.checkpoint.dir", named)
        else:
            spark.sparkContext.setCheckpointDir(named)
    return named.rstrip("/")
