"""Pairing of peaks into hashes: an interval window over frames collects each anchor's target zone, no self-join."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import hashing
from ..presets import Preset

#: The sort key of targets: by time and place in the frame's list, or by magnitude.
ORDERS = {
    "time": lambda: [F.col("t"), F.col("ord"), F.col("f")],
    "list": lambda: [F.col("t"), F.col("ord"), F.col("f")],
    "magnitude": lambda: [-F.col("m"), F.col("t"), F.col("f")],
}


def targets(peaks: DataFrame, preset: Preset) -> DataFrame:
    """peaks with ``zone``: the first targets of every anchor, in the preset's order.

    All anchors of a frame have one zone, and a frame can give it no more than its own first targets: frames carry these,
    so a zone gathers a few items of each frame in reach, once for a frame and not for every peak.
    """
    low, high = preset.dt
    keys = ORDERS[preset.targets_by]()
    item = F.struct(*(k.alias(f"k{i}") for i, k in enumerate(keys)), F.col("t").alias("t2"), F.col("f").alias("f2"))
    rest = [c for c in peaks.columns if c not in ("track_id", "t")]
    first = lambda items: F.slice(F.array_sort(items), 1, preset.targets)
    frames = peaks.groupBy("track_id", "t").agg(first(F.collect_list(item)).alias("own"), F.collect_list(F.struct(*rest)).alias("anchors"))
    zone = F.flatten(F.collect_list("own").over(Window.partitionBy("track_id").orderBy("t").rangeBetween(low, high)))
    flat = frames.select("track_id", "t", first(zone).alias("zone"), "anchors").select("track_id", "t", "zone", F.inline("anchors"))
    return flat.select(*peaks.columns, "zone")


def pairs(peaks: DataFrame, preset: Preset) -> DataFrame:
    """(track_id, anchor_t, f1, f2, dt, hash) of every anchor and target."""
    flat = targets(peaks, preset).select("track_id", F.col("t").alias("anchor_t"), F.col("f").alias("f1"), F.explode("zone").alias("z"))
    flat = flat.select("track_id", F.col("anchor_t").cast("bigint").alias("anchor_t"), "f1", F.col("z.f2").alias("f2"), (F.col("z.t2") - F.col("anchor_t")).alias("dt"))
    layout = {"pack22": hashing.pack22, "pack16": hashing.pack16, "pack16q": hashing.pack16q}[preset.hashing]
    return flat.withColumn("hash", layout(F.col("f1"), F.col("f2"), F.col("dt")))


def quad_values(peaks: DataFrame, preset: Preset) -> DataFrame:
    """(track_id, anchor_t, b0..b3, d1..d3): anchors with exactly the asked number of targets; bins and millisecond deltas."""
    ms = lambda t: hashing.frame_to_ms(t, preset.hop, preset.sample_rate)
    full = targets(peaks, preset).where(F.size("zone") == preset.targets)
    z: list[Column] = [F.col("zone")[i] for i in range(3)]
    return full.select(
        "track_id", ms(F.col("t")).alias("anchor_t"), hashing.quad_bin(F.col("f")).alias("b0"),
        *(hashing.quad_bin(z[i]["f2"]).alias(f"b{i + 1}") for i in range(3)),
        *(hashing.quad_delta(ms(z[i]["t2"]) - ms(F.col("t"))).alias(f"d{i + 1}") for i in range(3)),
    )


def fingerprints(peaks: DataFrame, preset: Preset, seed: int | None = None) -> DataFrame:
    """(track_id, hash, anchor_t). seed: another seed than Spark's own for the quad hash."""
    if preset.hashing != "quad64":
        return pairs(peaks, preset).select("track_id", "hash", "anchor_t")
    values = quad_values(peaks, preset)
    parts = [F.col(c) for c in ("b0", "b1", "b2", "b3", "d1", "d2", "d3")]
    key = hashing.quad64(*parts) if seed is None else hashing.xxhash64_seeded(hashing.big_endian16(*parts), seed)
    return values.select("track_id", key.alias("hash"), "anchor_t")


def describe(peaks: DataFrame, preset: Preset, first: int = 20) -> DataFrame:
    """A clip's figures for debugging: peaks, hashes, distinct hashes and the first hashes in time order."""
    prints = fingerprints(peaks, preset)
    head = prints.orderBy("anchor_t", "hash").limit(first).agg(F.array_sort(F.collect_list(F.struct("anchor_t", "hash"))).alias("first"))
    n_peaks = peaks.agg(F.count("*").alias("n_peaks"))
    n = prints.agg(F.count("*").alias("n_hashes"), F.count_distinct("hash").alias("n_distinct"))
    return n_peaks.crossJoin(n).crossJoin(head)  # one row each
