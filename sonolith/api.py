"""Indexing and querying audio folders: the calls behind the command line."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators import index, landmarks, match
from .operators.monitor import Watch
from .presets import LANDMARK, PRESETS, Preset
from .recovery import cut
from .sources import audio

EXTENSIONS = ("wav", "m4a", "mp4", "aac", "mp3", "flac")


def watched_peaks(files: DataFrame, preset: Preset, watch: Watch) -> DataFrame:
    """decoded_peaks from a checkpoint; watch gets the files done and failed."""
    head, bad = F.col("head"), F.col("reason").isNotNull()
    return cut(watch.over(audio.decoded_peaks(files, preset), done=head & ~bad, failed=head & bad))


def segment_of(files: DataFrame, found: DataFrame, preset: Preset, tags: DataFrame | None = None) -> tuple[int, DataFrame, DataFrame]:
    """(number, tracks, fingerprints) of decoded files. found: audio.decoded_peaks of files."""
    decoded = found.where("reason is null").select("rel_path").distinct()
    tracks = audio.track_rows(files.drop("content").join(decoded, "rel_path", "left_semi"), tags).withColumn("track_id", F.xxhash64("rel_path"))
    peaks = found.where("t is not null").withColumn("track_id", F.xxhash64("rel_path")).drop("rel_path", "reason", "head")
    return decoded.count(), tracks, landmarks.fingerprints(peaks, preset)


class Engine:
    """An index at a path, under one preset."""

    def __init__(self, spark: SparkSession, root: str, preset: Preset | str = LANDMARK):
        self.spark, self.root = spark, root
        self.preset = PRESETS[preset] if isinstance(preset, str) else preset

    def _files(self, folder: str) -> DataFrame:
        files = audio.scan(self.spark, folder, EXTENSIONS)
        return audio.split_quarantine(files, audio.quarantine_reason(F.col("name"), F.col("length")))[0]

    def add_segment(self, folder: str, force: bool = False, tags: DataFrame | None = None, watch: Watch | None = None) -> int:
        """Index a folder's new files as a segment; the number of tracks added. force indexes all of them again. Files that can't be
        decoded are no tracks: see rejected. watch gets the files done and failed and the hashes, counted while they are made."""
        watch = watch or Watch()
        files = self._files(folder)
        if not index.manifest(self.spark, self.root).isEmpty():
            files = index.not_indexed(files, index.read_index(self.spark, self.root)[0], force)
        found = watched_peaks(files, self.preset, watch)
        n, tracks, prints = segment_of(files, found, self.preset, tags)
        if n:
            index.write_segment(tracks, watch.over(prints, hashes=F.lit(True)), self.root, self.preset)
        return n

    def rejected(self, folder: str) -> DataFrame:
        """(rel_path, reason) of a folder's files that can't be indexed: hidden, too small or not decodable."""
        files = audio.scan(self.spark, folder, EXTENSIONS)
        valid, held = audio.split_quarantine(files, audio.quarantine_reason(F.col("name"), F.col("length")))
        return held.select("rel_path", "reason").union(audio.probe(valid, self.preset).where("not readable").select("rel_path", "reason"))

    def query(self, clips: str, limit: int | None = -1, skip_damaged: bool = False, most: int = match.BROADCAST_HASHES) -> DataFrame:
        """Ranked matches of every clip at a path (a file or folder), with track names; query_id is the clip's path.

        skip_damaged searches the sound segments only: see ``damaged`` for the others. A batch of over ``most`` hashes
        goes to the buckets where the postings lie.
        """
        files = audio.scan(self.spark, clips, EXTENSIONS)
        prints = landmarks.fingerprints(audio.clips_to_peaks(files, self.preset, query=True, key="path").withColumnRenamed("path", "track_id"), self.preset)
        query = cut(prints.select(F.col("track_id").alias("query_id"), "hash", F.col("anchor_t").alias("t1")))
        found = index.read_index(self.spark, self.root, bucketed=query.count() > most, skip_damaged=skip_damaged)
        tracks, postings = index.current(*found)  # a track indexed again counts once
        return match.match(query, postings, self.preset, tracks.select("track_id", "rel_path", "artist", "album", "title"), limit, most)

    def damaged(self, full: bool = False) -> DataFrame:
        """The index's files that are missing or changed; full reads them all."""
        return index.damaged(self.spark, self.root, full)

    def compact(self, target: str) -> None:
        """Write all segments as one at another path; of a track indexed again the latest segment."""
        tracks, postings = index.compact(*index.current(*index.read_index(self.spark, self.root)))
        index.write_segment(tracks, postings, target, self.preset)

    def inspect(self, hex_key: str) -> DataFrame:
        """Postings of a key of 16 hex characters."""
        return index.inspect_hash(index.read_index(self.spark, self.root)[1], hex_key)

    def describe(self, clip: str) -> DataFrame:
        """A clip's numbers of peaks and hashes, and its first hashes."""
        peaks = audio.clips_to_peaks(audio.scan(self.spark, clip, EXTENSIONS), self.preset, query=True).withColumnRenamed("rel_path", "track_id")
        return landmarks.describe(peaks, self.preset)
