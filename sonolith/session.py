"""A session for local use."""

from __future__ import annotations

from pyspark.sql import SparkSession


def local_session(cpus: int = 8, memory: str = "16g") -> SparkSession:
    return (
        SparkSession.builder.master(f"local[{cpus}]").appName("sonolith").config("spark.sql.shuffle.partitions", str(cpus))
        .config("spark.driver.memory", memory).config("spark.sql.session.timeZone", "UTC").config("spark.ui.enabled", "false")
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true").getOrCreate()
    )
