"""Cutting lineage in a way that survives lost executors."""

from __future__ import annotations

import tempfile
import time

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir``; in local mode one of our own where that is unset."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        if not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir isn't set: executors have no folder in common")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="sonolith-checkpoint-"))
    return sc.getCheckpointDir().rstrip("/")


#: Seconds between two collections that are asked for, and when the last one was.
COLLECT_EVERY, _collected = 5.0, [0.0]


def cut(df: DataFrame) -> DataFrame:
    """df from a reliable checkpoint in the shared folder.

    Spark's cleaner removes the shuffle files of plans that the driver has collected as garbage. A collection is
    asked for here every few seconds, as Spark itself does now and then, so that a long chain of steps doesn't hold the
    disk of all of them.
    """
    spark = df.sparkSession
    directory = shared_dir(spark)
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(directory)
    out = df.checkpoint()
    if time.monotonic() - _collected[0] > COLLECT_EVERY:
        spark.sparkContext._jvm.System.gc()
        _collected[0] = time.monotonic()
    return out
