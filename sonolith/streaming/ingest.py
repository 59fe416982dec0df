"""Incremental indexing and monitoring as structured streams."""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery, StreamingQueryListener

from ..api import segment_of, watched_peaks
from ..operators import index
from ..operators.monitor import Watch
from ..presets import Preset
from ..sources import audio

FILES = "path string, modificationTime timestamp, length bigint, content binary"


def stream_files(spark: SparkSession, root: str, glob: str = "*.[wW][aA][vV]", per_trigger: int = 1000) -> DataFrame:
    """New files below root as rows of the binary source."""
    source = spark.readStream.format("binaryFile").schema(FILES).option("pathGlobFilter", glob).option("recursiveFileLookup", "true").option("maxFilesPerTrigger", per_trigger)
    return audio.with_names(source.load(root), root)


def index_stream(files: DataFrame, root: str, preset: Preset, checkpoint: str, every: str | None = "2 seconds", watch: Watch | None = None) -> StreamingQuery:
    """Each micro-batch becomes a segment with a line in the manifest; files already indexed are skipped. The segment's
    run is named by the stream (its checkpoint's path) and the batch, so a batch that is run again adds nothing. watch gets the files done and failed and the hashes of all
    batches so far."""
    watch = watch or Watch()
    stream = hashlib.sha256(checkpoint.encode()).hexdigest()[:16]

    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        run = f"s{stream}-{batch_id}"
        known = index.manifest(spark, root)
        if not known.where(F.col("run") == run).isEmpty():
            return
        batch = batch.dropDuplicates(["rel_path"])
        if not known.isEmpty():
            batch = index.not_indexed(batch, index.read_index(spark, root)[0])
        valid, _ = audio.split_quarantine(batch, audio.quarantine_reason(F.col("name"), F.col("length")))
        valid = valid.persist()
        try:
            n, tracks, prints = segment_of(valid, watched_peaks(valid, preset, watch), preset)
            if n:
                index.write_segment(tracks, watch.over(prints, hashes=F.lit(True)), root, preset, run)
        finally:
            valid.unpersist()

    writer = files.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return (writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)).start()


def rate_stream(events: DataFrame, ts: str = "ts", every: str = "5 seconds", late: str = "10 minutes") -> DataFrame:
    """Counts of event-time ticks, closed by a watermark."""
    return events.withWatermark(ts, late).groupBy(F.window(ts, every).alias("w")).agg(F.count("*").alias("n")).select(F.col("w.start").alias("tick"), "n")


def distinct_stream(files: DataFrame, key: str = "rel_path", ts: str = "modificationTime", late: str = "1 hour") -> DataFrame:
    """Each key once; the state of keys older than the watermark is dropped."""
    return files.withWatermark(ts, late).dropDuplicatesWithinWatermark([key])


class Progress(StreamingQueryListener):
    """Rows and rates of the last micro-batches of a session's streams."""

    def __init__(self, keep: int = 50):
        self.keep, self.rows = keep, []

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        p = event.progress
        self.rows = [*self.rows, (p.timestamp, p.numInputRows, p.processedRowsPerSecond)][-self.keep :]

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        pass
