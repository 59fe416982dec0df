"""Audio files to cells, peaks and clips: a binary scan, then decoding and FFT in one Arrow stage.

Samples and spectrograms never leave the worker: a row in is a file, rows out are its peaks. WAV and raw PCM
are decoded here; other containers go through ffmpeg where it is installed and are quarantined otherwise.
"""

from __future__ import annotations

import io
import shutil
import subprocess
import wave
from collections.abc import Callable, Iterator
from math import gcd

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import dsp
from ..functions.text import or_unknown, path_metadata
from ..presets import Preset

LEAST_BYTES = 10_240
EXTENSIONS = ("m4a", "mp4", "aac", "mp3", "wav", "flac")


def scan(spark: SparkSession, root: str, extensions: tuple[str, ...] = ("m4a",), recursive: bool = True, any_case: bool = True, content: bool = True) -> DataFrame:
    """(path, length, modificationTime, content, rel_path, name) of audio files."""
    each = ["".join(f"[{c.lower()}{c.upper()}]" for c in e) if any_case else e for e in extensions]
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.{" + ",".join(each) + "}" if len(each) > 1 else f"*.{each[0]}")
    files = files.option("recursiveFileLookup", str(recursive).lower()).load(root)
    if not content:
        files = files.drop("content")  # pruned: no file is opened
    return with_names(files, root)


def with_names(files: DataFrame, root: str) -> DataFrame:
    """files with rel_path, what follows the root's own text whatever the scheme in front, and name."""
    base = root.rstrip("/") + "/"
    at = F.locate(base, F.col("path"))
    rel = F.when(at > 0, F.substring(F.col("path"), at + len(base), F.length("path"))).otherwise(F.col("path"))
    return files.withColumn("rel_path", rel).withColumn("name", F.element_at(F.split("path", "/"), -1))


def count_files(spark: SparkSession, root: str) -> DataFrame:
    """The number of files below root, without reading them."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root).agg(F.count("*").alias("n_files"))


def quarantine_reason(name: Column, length: Column, least: int = LEAST_BYTES) -> Column:
    """hidden, too small, or null."""
    return F.when(name.startswith("."), "hidden").when(length < least, "too small")


def split_quarantine(files: DataFrame, reason: Column) -> tuple[DataFrame, DataFrame]:
    """(valid, quarantined with reason)."""
    marked = files.withColumn("reason", reason)
    return marked.where("reason is null").drop("reason"), marked.where("reason is not null")


def resample(samples: np.ndarray, rate: int, wanted: int, half: int = 16) -> np.ndarray:
    """samples at another rate: a windowed sinc under the lower of both limits, one set of taps for each phase."""
    if rate == wanted or not len(samples):
        return samples
    up, down = wanted // gcd(rate, wanted), rate // gcd(rate, wanted)
    reach = half * max(1, -(-down // up))  # input samples on either side
    taps = np.arange(-reach, reach + 1)
    phases = np.arange(up)[:, None] / up - taps
    limit = min(1.0, up / down)
    filters = limit * np.sinc(limit * phases) * np.where(np.abs(phases) <= reach, 0.5 + 0.5 * np.cos(np.pi * phases / (reach + 1)), 0)
    filters /= filters.sum(axis=1, keepdims=True)
    padded = np.pad(samples, (reach, reach + 1))
    n = -(-len(samples) * up // down)
    out = np.empty(n)
    for s in range(0, n, 65_536):  # bounded memory
        at = np.arange(s, min(s + 65_536, n)) * down
        rows = np.lib.stride_tricks.sliding_window_view(padded, len(taps))[at // up]
        out[s : s + len(at)] = np.einsum("ij,ij->i", rows, filters[at % up])
    return out


def pcm(data: bytes, width: int) -> np.ndarray:
    """Samples in [-1, 1) of little-endian PCM: 8 bits unsigned, 16, 24 and 32 bits signed."""
    data = data[: len(data) // width * width]
    if width == 1:
        return (np.frombuffer(data, np.uint8).astype(float) - 128) / 128
    if width == 3:
        wide = np.zeros((len(data) // 3, 4), np.uint8)
        wide[:, 1:] = np.frombuffer(data, np.uint8).reshape(-1, 3)
        return wide.view("<i4").ravel() / 2147483648.0
    return np.frombuffer(data, f"<i{width}") / float(1 << (8 * width - 1))


def decode(data: bytes, name: str, rate: int, most_seconds: int | None = None) -> tuple[np.ndarray | None, str | None]:
    """(mono samples in [-1, 1) at the rate, None) or (None, reason)."""
    try:
        if name.lower().endswith(".wav"):
            with wave.open(io.BytesIO(data)) as w:
                if w.getsampwidth() > 4:
                    return None, f"sample width {w.getsampwidth()}"
                samples = pcm(w.readframes(w.getnframes()), w.getsampwidth()).reshape(-1, w.getnchannels()).mean(axis=1)
                if most_seconds:
                    samples = samples[: most_seconds * w.getframerate()]
                samples = resample(samples, w.getframerate(), rate)
        elif name.lower().endswith(".pcm"):
            samples = pcm(data, 2)
        elif shutil.which("ffmpeg"):
            command = ["ffmpeg", "-nostdin", "-v", "error", "-i", "pipe:0", "-map", "a:0", "-ac", "1", "-ar", str(rate), "-f", "s16le", "pipe:1"]
            out = subprocess.run(command, input=data, capture_output=True, timeout=300, check=False)
            if out.returncode:
                return None, "decoder failed"
            samples = pcm(out.stdout, 2)
        else:
            return None, "no decoder"
    except (wave.Error, EOFError, ValueError, subprocess.TimeoutExpired) as e:
        return None, f"unreadable: {type(e).__name__}"
    return (samples[: most_seconds * rate] if most_seconds else samples), None


def decoded_peaks(files: DataFrame, preset: Preset, query: bool = False, transform: Callable = np.fft.rfft, key: str = "rel_path") -> DataFrame:
    """(key, reason, t, f, m, ord, head): the peaks of every file, or one row without a peak: with the reason of a file that can't
    be decoded. head marks one row of each file."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for name, ident, data in zip(batch["name"], batch[key], batch["content"], strict=True):
                samples, reason = decode(bytes(data), name, preset.sample_rate, preset.max_seconds)
                t, f, m, place = (np.zeros(0),) * 4 if samples is None else dsp.peaks(dsp.spectrogram(samples, preset, transform), preset, query)
                if len(t):
                    yield pd.DataFrame({key: ident, "reason": None, "t": t.astype(np.int32), "f": f.astype(np.int32), "m": m, "ord": place.astype(np.int32), "head": np.arange(len(t)) == 0})
                else:
                    yield pd.DataFrame({key: [ident], "reason": [reason], "t": [None], "f": [None], "m": [None], "ord": [None], "head": [True]})

    return files.select(key, "name", "content").mapInPandas(run, f"{key} string, reason string, t int, f int, m double, ord int, head boolean")


def clips_to_peaks(files: DataFrame, preset: Preset, query: bool = False, transform: Callable = np.fft.rfft, key: str = "rel_path") -> DataFrame:
    """(key, t, f, m, ord) of every file's peaks."""
    return decoded_peaks(files, preset, query, transform, key).where("t is not null").drop("reason", "head")


def probe(files: DataFrame, preset: Preset, key: str = "rel_path") -> DataFrame:
    """(key, duration, readable, reason) of every file."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = [decode(bytes(d), n, preset.sample_rate) for n, d in zip(batch["name"], batch["content"], strict=True)]
            yield pd.DataFrame({key: batch[key], "duration": [0.0 if s is None else len(s) / preset.sample_rate for s, _ in found], "readable": [s is not None for s, _ in found], "reason": [r for _, r in found]})

    return files.select(key, "name", "content").mapInPandas(run, f"{key} string, duration double, readable boolean, reason string")


def track_rows(files: DataFrame, tags: DataFrame | None = None) -> DataFrame:
    """(rel_path, path, artist, album, title) of files; tags (rel_path, artist, album, title) win where they are not blank."""
    own = files.select("rel_path", "path", *(c.alias(n) for n, c in path_metadata(F.col("rel_path")).items()))
    if tags is None:
        return own
    t = tags.select("rel_path", *(or_unknown(F.col(c)).alias(f"_{c}") for c in ("artist", "album", "title")))
    joined = own.join(t, "rel_path", "left")
    pick = [F.when(F.coalesce(f"_{c}", F.lit("unknown")) != "unknown", F.col(f"_{c}")).otherwise(F.col(c)).alias(c) for c in ("artist", "album", "title")]
    return joined.select("rel_path", "path", *pick)


def probe_tags(rows: DataFrame, column: str = "value") -> DataFrame:
    """title, artist, album, track and duration of probe output as JSON text."""
    shape = "struct<format:struct<tags:map<string,string>,duration:string>>"
    p = rows.withColumn("p", F.from_json(column, shape))
    tag = lambda k: F.coalesce(F.col(f"p.format.tags.{k}"), F.col(f"p.format.tags.{k.upper()}")).alias(k)
    return p.select(tag("title"), tag("artist"), tag("album"), tag("track"), F.coalesce(F.regexp_replace("p.format.duration", ",", ".").try_cast("double"), F.lit(0.0)).alias("duration"))
