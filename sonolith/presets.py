"""Parameters of the three fingerprint designs; one pipeline serves them all."""

from __future__ import annotations

from dataclasses import dataclass, replace


@dataclass(frozen=True)
class Preset:
    """scale: what a cell's magnitude is (db, linear, or db under the loudest in-band cell); strict: equal
    neighbours are no peaks; top_k: peaks kept in a frame (index, query; 0 for all); targets_by: the order
    in which an anchor's targets are chosen; short_clip: what a clip under one window gives."""

    name: str
    sample_rate: int
    window: int
    hop: int
    periodic_hann: bool
    bins: int
    tested: tuple[int, int]
    scale: str
    threshold: float | None
    radius_t: int
    radius_f: int
    strict: bool
    top_k: tuple[int, int]
    dt: tuple[int, int]
    targets: int
    targets_by: str
    hashing: str
    time_unit: str
    confidence: str
    least_votes: int = 0
    least_confidence: float = 0.0
    limit: int = 10
    short_clip: str = "drop"
    running_reference: bool = False
    max_seconds: int | None = None


#: Each design's sample rate, window, neighbourhood, fan-out, hash layout and cut-offs.
LANDMARK = Preset(
    "landmark", 11025, 2048, 1024, False, 1024, (1, 1022), "db", -55.0, 2, 15, False, (5, 0), (1, 60), 4,
    "time", "pack22", "frame", "best", short_clip="pad",
)
QUAD = Preset(
    "quad", 44100, 4096, 2048, False, 2048, (0, 2047), "linear", 1e-6, 0, 3, True, (10, 10), (1, 64), 3,
    "list", "quad64", "ms", "queries", 3, 0.01,
)
AMPLITUDE = Preset(
    "amplitude", 11025, 2048, 512, True, 1025, (14, 928), "relative", None, 8, 8, False, (30, 30), (1, 32), 10,
    "magnitude", "pack16q", "frame", "queries", max_seconds=180,
)
AMPLITUDE_DB6 = replace(AMPLITUDE, name="amplitude_db6", threshold=-6.0, top_k=(0, 0), targets=5, hashing="pack16")
AMPLITUDE_STREAM = replace(AMPLITUDE_DB6, name="amplitude_stream", running_reference=True)
PRESETS = {p.name: p for p in (LANDMARK, QUAD, AMPLITUDE, AMPLITUDE_DB6, AMPLITUDE_STREAM)}
#: Frames beyond which a track of the amplitude designs gives no peaks.
LONGEST_FRAMES = 20_000
