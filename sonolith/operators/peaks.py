"""Spectral peaks of cells (track_id, t, f, m) as windows; all columns are partitioned by track once.

A rectangle's maximum is separable, so "no neighbour is larger" takes two window maxima and no join. Both
windows and the pairing after them are clustered by track_id, which one exchange provides.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..presets import LONGEST_FRAMES, Preset

#: Cells of a task, about, unless a track has more; a task sorts them for several windows (hundreds of bytes each in all).
CELLS = 1 << 18


def by_track(cells: DataFrame) -> DataFrame:
    """Cells without NaN, each track in one partition: a track is minutes of audio, its size is bounded. More cells are more
    partitions, not larger ones."""
    spark, cells = cells.sparkSession, cells.where(~F.isnan("m"))
    n = -(-cells.count() // CELLS)
    if n > min(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism):
        return cells.repartition(n, "track_id")
    return cells.repartition("track_id")


def in_scale(cells: DataFrame, preset: Preset) -> DataFrame:
    """Powers to decibels under the loudest in-band cell (of the track, or so far), for relative presets."""
    if preset.scale != "relative":
        return cells
    low, high = preset.tested
    inside = F.when(F.col("f").between(low, high), F.col("m"))
    over = Window.partitionBy("track_id")
    if preset.running_reference:
        over = over.orderBy("t").rangeBetween(Window.unboundedPreceding, preset.radius_t)
    top = F.greatest(F.coalesce(F.max(inside).over(over), F.lit(1e-12)), F.lit(1e-12))
    return cells.withColumn("m", 10 * F.log10(F.greatest(F.col("m"), F.lit(1e-12)) / top))


def local_maxima(cells: DataFrame, radius_t: int, radius_f: int, strict: bool = False) -> DataFrame:
    """Cells that no neighbour exceeds (strict: that exceed every neighbour in their frame)."""
    frame = Window.partitionBy("track_id", "t").orderBy("f")
    if strict:
        before, after = F.max("m").over(frame.rangeBetween(-radius_f, -1)), F.max("m").over(frame.rangeBetween(1, radius_f))
        flagged = cells.withColumn("_before", before).withColumn("_after", after)
        low = F.lit(float("-inf"))
        return flagged.where((F.col("m") > F.coalesce("_before", low)) & (F.col("m") > F.coalesce("_after", low))).drop("_before", "_after")
    bins = Window.partitionBy("track_id", "f").orderBy("t")
    rows = cells.withColumn("_row", F.max("m").over(frame.rangeBetween(-radius_f, radius_f)))
    return rows.withColumn("_box", F.max("_row").over(bins.rangeBetween(-radius_t, radius_t))).where("m = _box").drop("_row", "_box")


def peaks(cells: DataFrame, preset: Preset, query: bool = False, longest: int = LONGEST_FRAMES) -> DataFrame:
    """(track_id, t, f, m, rk, ord): peaks of dense cells; rk by magnitude, ord the place in the frame's list. Relative
    designs find none in tracks of over ``longest`` frames."""
    low, high = preset.tested
    cells = by_track(cells)
    if preset.scale == "relative":  # these designs give up on longer tracks
        frames = F.max("t").over(Window.partitionBy("track_id"))
        cells = cells.withColumn("_frames", frames).where(F.col("_frames") < longest).drop("_frames")
    if preset.running_reference:  # powers are compared, as frames have references of their own
        cells = cells.withColumn("_last", F.max("t").over(Window.partitionBy("track_id"))).withColumn("_power", F.col("m"))
        cells = in_scale(cells, preset).withColumnRenamed("m", "_level").withColumnRenamed("_power", "m")
        found = local_maxima(cells, preset.radius_t, preset.radius_f).drop("m").withColumnRenamed("_level", "m").where(F.col("f").between(low, high))
    else:
        found = local_maxima(in_scale(cells, preset), preset.radius_t, preset.radius_f, preset.strict).where(F.col("f").between(low, high))
    if preset.threshold is not None:
        found = found.where(F.col("m") > preset.threshold if preset.strict else F.col("m") >= preset.threshold)
    if preset.running_reference:  # a frame is judged with radius_t frames on either side, and as many must follow these
        found = found.where((F.col("t") >= preset.radius_t) & (F.col("t") <= F.col("_last") - 2 * preset.radius_t)).drop("_last")
    return ranked(found, preset, query)


def ranked(found: DataFrame, preset: Preset, query: bool = False) -> DataFrame:
    """The preset's top peaks of every frame, with rk and ord."""
    limit = preset.top_k[1 if query else 0]
    frame = Window.partitionBy("track_id", "t")
    out = found.withColumn("rk", F.row_number().over(frame.orderBy(F.desc("m"), "f")))
    if preset.targets_by == "list":
        out = out.withColumn("_n", F.count("*").over(frame))
    if limit:
        out = out.where(F.col("rk") <= limit)
    if preset.targets_by == "list":  # by magnitude where the limit cut the frame, else by bin
        place = F.row_number().over(frame.orderBy("f"))
        return out.withColumn("_place", place).withColumn("ord", F.when(F.col("_n") > limit, F.col("rk")).otherwise(F.col("_place"))).select("track_id", "t", "f", "m", "rk", "ord")
    if preset.targets_by == "time" and query:
        return out.withColumn("ord", F.row_number().over(frame.orderBy("f"))).select("track_id", "t", "f", "m", "rk", "ord")
    return out.withColumn("ord", F.col("rk")).select("track_id", "t", "f", "m", "rk", "ord")
