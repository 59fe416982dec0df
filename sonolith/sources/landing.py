"""Landed JSON: pages of an API, seeds and playlists, read with declared schemas."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def read_pages(spark: SparkSession, path: str) -> DataFrame:
    """(url, data) from JSON lines ``{"url": ..., "data": {...}}``; data stays text."""
    raw = spark.read.text(path)
    return raw.select(F.get_json_object("value", "$.url").alias("url"), F.get_json_object("value", "$.data").alias("data"))


def write_pages(pages: DataFrame, path: str) -> None:
    pages.select("url", "data").write.mode("append").parquet(path)


def read_object(spark: SparkSession, path: str) -> DataFrame:
    """One JSON object a file as (name, url) rows."""
    from ..operators.catalog import seeds

    return seeds(spark.read.text(path, wholetext=True))


def as_variant(pages: DataFrame, column: str = "data") -> DataFrame:
    """The column as a variant; broken JSON is null."""
    return pages.withColumn(column, F.try_parse_json(column))


def playlist_entry(text: Column) -> Column:
    """The first line of a playlist that is no comment."""
    lines = F.filter(F.transform(F.split(text, "\n"), lambda x: F.trim(x)), lambda x: (x != "") & ~x.startswith("#"))
    return F.try_element_at(lines, F.lit(1))


def write_chunks(rows: DataFrame, value: str, path: str) -> None:
    """Text files by chunk: one folder for each."""
    rows.select(F.col(value).cast("string").alias("value"), "chunk").repartition("chunk").sortWithinPartitions("chunk", "value").write.partitionBy("chunk").text(path)
