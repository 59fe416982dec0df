"""The driver's tables in the roles of audio tables; they exercise operators, not musical accuracy.

``embeddings`` serves as a spectrogram: every FRAMES vectors in a row are a track, a vector is a frame and an array position
a bin. Tracks are of one length, so that more vectors are more tracks and not longer ones.
"""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import landmarks
from ..operators.peaks import peaks
from ..presets import AMPLITUDE, LANDMARK, QUAD

#: Frames of a track.
FRAMES = 50

#: Presets cut down to 64 bins.
LP = replace(LANDMARK, radius_t=2, radius_f=3, threshold=0.0, tested=(0, 63), bins=64)
QH = replace(QUAD, radius_f=3, threshold=1e-6, tested=(0, 63), bins=64)
AC = replace(AMPLITUDE, radius_t=2, radius_f=3, tested=(4, 59), bins=64)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    flat = table(spark, sf_dir, "embeddings").select("vec_id", F.posexplode("embedding").alias("f", "m"))
    return flat.select(F.expr(f"vec_id div {FRAMES}").alias("track_id"), F.expr(f"cast(vec_id % {FRAMES} as int)").alias("t"), "f", F.col("m").cast("double").alias("m"))


def clip_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Frames 5 to 30 of every track, from 0: the right answer of each clip is its own track at offset 5."""
    c = cells(spark, sf_dir).where("t between 5 and 30")
    return c.withColumn("t", F.col("t") - 5)


def index_prints(spark: SparkSession, sf_dir: str, preset) -> DataFrame:
    return landmarks.fingerprints(peaks(cells(spark, sf_dir), preset), preset)


def query_prints(spark: SparkSession, sf_dir: str, preset) -> DataFrame:
    found = landmarks.fingerprints(peaks(clip_cells(spark, sf_dir), preset, query=True), preset)
    return found.select(F.col("track_id").alias("query_id"), "hash", F.col("anchor_t").alias("t1"))


def tracks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(segment_id, track_id, artist, album, title) of the surrogate tracks; three in a row, one of each segment, have one name."""
    ids = table(spark, sf_dir, "embeddings").select(F.expr(f"vec_id div {FRAMES}").alias("track_id")).distinct()
    name = F.expr("track_id div 3")
    return ids.select(F.expr("cast(track_id % 3 as int)").alias("segment_id"), "track_id", F.concat(F.lit("artist"), name).alias("artist"), F.lit("album").alias("album"), F.concat(F.lit("title"), name).alias("title"))
