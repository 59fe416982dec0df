"""Peaks of audio that arrives in chunks: a keyed state carries the last frames and the running maximum from chunk to chunk.

A track's chunks are numbered; those that come before their turn wait in the state. A frame is judged once the frames of
its neighbourhood and as many after them are there, so what is found doesn't depend on how a track is cut into chunks or
chunks into micro-batches: it is what ``peaks`` finds in the whole track under the same preset.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from ..functions import dsp
from ..presets import Preset

SHAPE = "track_id bigint, t int, f int, m double"


def next_peaks(power: np.ndarray, tops: np.ndarray, start: int, first: int, preset: Preset) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(t, f, m) of the frames from first that can be judged. power, tops: frames from start, and the running maximum at each."""
    r = preset.radius_t
    low, high = preset.tested
    end = start + len(power) - 2 * r  # judged frames are before it
    if end <= first:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
    box = dsp.box_max(dsp.box_max(power, preset.radius_f, 1), r, 0)[first - start : end - start]
    own = power[first - start : end - start]
    level = 10 * np.log10(np.maximum(own, 1e-12) / tops[first - start + r : end - start + r, None])
    found = own == box
    if preset.threshold is not None:
        found &= level >= preset.threshold
    found[:, :low] = found[:, high + 1 :] = False
    t, f = np.nonzero(found)
    return t + first, f, level[t, f]


class RingPeaks(StatefulProcessor):
    """Rows (track_id, seq, power): power is the chunk's frames in a row, as doubles, each of preset.bins."""

    def __init__(self, preset: Preset):
        self.preset = preset

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.ring = handle.getValueState("ring", "seq int, seen bigint, top double, frames binary, tops binary")
        self.waiting = handle.getMapState("waiting", "seq int", "power binary")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        p, bins = self.preset, self.preset.bins
        for batch in rows:
            for seq, power in zip(batch["seq"], batch["power"], strict=True):
                self.waiting.updateValue((int(seq),), (np.asarray(power, np.float64).tobytes(),))
        seq, seen, top, frames, tops = self.ring.get() if self.ring.exists() else (0, 0, 1e-12, b"", b"")
        kept, levels = np.frombuffer(frames).reshape(-1, bins), np.frombuffer(tops)
        low, high = p.tested
        while self.waiting.containsKey((seq,)):
            new = np.frombuffer(self.waiting.getValue((seq,))[0]).reshape(-1, bins)
            self.waiting.removeKey((seq,))
            start = seen - len(kept)
            # as many as were kept behind the last judged frame, but for the track's own first frames
            first = max(p.radius_t, seen - 2 * p.radius_t)
            kept = np.concatenate([kept, new])
            levels = np.concatenate([levels, np.maximum.accumulate(np.concatenate([[top], new[:, low : high + 1].max(axis=1, initial=1e-12)]))[1:]])
            seen, seq, top = seen + len(new), seq + 1, float(levels[-1]) if len(levels) else top
            t, f, m = next_peaks(kept, levels, start, first, p)
            if len(t):
                yield pd.DataFrame({"track_id": key[0], "t": t.astype(np.int32), "f": f.astype(np.int32), "m": m})
            keep = min(len(kept), 3 * p.radius_t)
            kept, levels = kept[len(kept) - keep :], levels[len(levels) - keep :]
        self.ring.update((seq, seen, top, kept.tobytes(), levels.tobytes()))


def ring_peaks(chunks: DataFrame, preset: Preset) -> DataFrame:
    """(track_id, t, f, m) of a stream of chunks (track_id, seq, power)."""
    chunks.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    return chunks.select("track_id", "seq", "power").groupBy("track_id").transformWithStateInPandas(RingPeaks(preset), SHAPE, "Append", "None")
