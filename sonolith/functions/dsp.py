"""Spectrogram arithmetic in numpy; the only part that Spark expressions don't cover."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np

from ..presets import LONGEST_FRAMES, Preset

#: A drop-in for the transform: rows of windowed samples to rows of complex bins.
Transform = Callable[[np.ndarray], np.ndarray]


def hann(n: int, periodic: bool = False) -> np.ndarray:
    return 0.5 * (1 - np.cos(2 * np.pi * np.arange(n) / (n if periodic else n - 1)))


def frames_of(samples: np.ndarray, preset: Preset) -> np.ndarray:
    """Windows at every hop; a clip under one window is padded or dropped as the preset says."""
    if len(samples) < preset.window:
        if preset.short_clip == "drop" or not len(samples):
            return np.zeros((0, preset.window))
        samples = np.pad(samples, (0, preset.window - len(samples)))
    return np.lib.stride_tricks.sliding_window_view(samples, preset.window)[:: preset.hop]


def spectrogram(samples: np.ndarray, preset: Preset, transform: Transform = np.fft.rfft) -> np.ndarray:
    """frames x bins magnitudes on the preset's scale; powers where its reference runs: see peaks."""
    window = hann(preset.window, preset.periodic_hann)
    out = []
    frames = frames_of(np.asarray(samples, np.float64), preset)
    for at in range(0, len(frames), 256):  # bounded memory for long tracks
        out.append(np.abs(transform(frames[at : at + 256] * window)[:, : preset.bins]))
    m = np.concatenate(out) if out else np.zeros((0, preset.bins))
    if preset.scale == "db":
        return 20 * np.log10(m + 1e-12)
    if preset.scale == "relative":
        power = m * m
        low, high = preset.tested
        if preset.running_reference:
            return power
        top = max(power[:, low : high + 1].max(initial=0), 1e-12)
        return 10 * np.log10(np.maximum(power, 1e-12) / top)
    return m


def box_max(m: np.ndarray, radius: int, axis: int) -> np.ndarray:
    """Sliding maximum with windows clipped at the edges."""
    if radius == 0 or m.shape[axis] == 0:
        return m
    pad = [(0, 0), (0, 0)]
    pad[axis] = (radius, radius)
    return np.lib.stride_tricks.sliding_window_view(np.pad(m, pad, constant_values=-np.inf), 2 * radius + 1, axis).max(axis=-1)


def peaks(m: np.ndarray, preset: Preset, query: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(t, f, m, ord) of the peaks of a spectrogram, top_k of each frame; ord is the place in the frame's list.

    Under a running reference powers are compared, and m is decibels under the loudest in-band power up to the last
    frame of the neighbourhood.
    """
    empty = (np.zeros(0, np.int64),) * 2 + (np.zeros(0), np.zeros(0, np.int64))
    if not len(m) or (preset.scale == "relative" and len(m) > LONGEST_FRAMES):
        return empty
    if preset.strict:
        pad = np.pad(m, ((0, 0), (preset.radius_f, preset.radius_f)), constant_values=-np.inf)
        side = lambda s: np.lib.stride_tricks.sliding_window_view(pad[:, s : s + m.shape[1] + preset.radius_f - 1], preset.radius_f, 1).max(axis=-1)
        found = (m > side(0)) & (m > side(preset.radius_f + 1))
    else:
        found = m == box_max(box_max(m, preset.radius_f, 1), preset.radius_t, 0)
    low, high = preset.tested
    if preset.running_reference:
        top = np.maximum.accumulate(np.maximum(m[:, low : high + 1].max(axis=1, initial=1e-12), 1e-12))
        m = 10 * np.log10(np.maximum(m, 1e-12) / top[np.minimum(np.arange(len(m)) + preset.radius_t, len(m) - 1)][:, None])
    found[:, :low] = False
    found[:, high + 1 :] = False
    if preset.threshold is not None:
        found &= m > preset.threshold if preset.strict else m >= preset.threshold
    if preset.running_reference:
        found[: preset.radius_t] = False
        found[max(len(m) - 2 * preset.radius_t, 0) :] = False
    t, f = np.nonzero(found)
    v = m[t, f]
    order = np.lexsort((f, -v, t))
    t, f, v = t[order], f[order], v[order]
    first = np.searchsorted(t, t)
    rank = np.arange(len(t)) - first + 1
    limit = preset.top_k[1 if query else 0]
    size = np.searchsorted(t, t, side="right") - first
    if limit:
        keep = rank <= limit
        t, f, v, rank, size = t[keep], f[keep], v[keep], rank[keep], size[keep]
    by_f = np.lexsort((f, t))
    place = np.empty(len(t), np.int64)
    place[by_f] = np.arange(len(t)) - np.searchsorted(t[by_f], t[by_f]) + 1
    listed = {"list": np.where(size > limit, rank, place), "time": rank if not query else place}.get(preset.targets_by, rank)
    return t, f, v, listed
