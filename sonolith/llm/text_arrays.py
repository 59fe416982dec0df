"""Word hashes of many texts at once, as numpy arrays.

Texts are joined into one byte buffer; word ends come from a byte table, and the 64-bit hash of every word
is a difference of running sums of ``byte * P**position`` times the inverse power of its start, so no step
runs per word. Buffers are limited in bytes, so memory is bounded by the limit or by one longest text.
"""

from __future__ import annotations

import contextlib
from collections.abc import Iterator

import numpy as np

#: Bytes of text in one buffer; a longer text is a buffer of its own.
BUFFER = 1 << 20
P = np.uint64(0x9E3779B97F4A7C15)
P_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))

#: A-Z to a-z; bytes that are part of a word: 0-9, a-z and everything beyond ASCII.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
IN_WORD = np.zeros(256, bool)
IN_WORD[48:58] = IN_WORD[65:91] = IN_WORD[97:123] = IN_WORD[128:] = True

_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    """P**i and P**-i for i below n or more, modulo 2**64."""
    if len(_powers[0]) < n:
        size = max(n, BUFFER + 4096)
        for k, base in enumerate((P, P_INVERSE)):
            steps = np.full(size, base, np.uint64)
            steps[0] = 1
            _powers[k] = np.multiply.accumulate(steps)
    return _powers[0], _powers[1]


def mix(h: np.ndarray, seed: int = 0) -> np.ndarray:
    """A bijective scrambling of 64-bit values."""
    h = h + np.uint64((seed * 0x9E3779B97F4A7C15 + 0x632BE59BD9B4E019) & (2**64 - 1))
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def buffers(texts: list[str | None]) -> Iterator[tuple[int, list[bytes]]]:
    """(index of the first, encoded texts) of runs of texts within the byte limit."""
    held: list[bytes] = []
    size = first = 0
    for i, t in enumerate(texts):
        raw = (t or "").encode("utf-8", "replace")
        if held and size + len(raw) > BUFFER:
            yield first, held
            held, size, first = [], 0, i
        held.append(raw)
        size += len(raw) + 1
    if held:
        yield first, held


def _hashed(encoded: list[bytes], stem: int, in_word: np.ndarray = IN_WORD) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(word hashes, offsets of texts among words, stem hashes, words with a stem): see word_hashes and stem_hashes."""
    buf = LOWER[np.frombuffer(b"\n".join([*encoded, b""]), np.uint8)]
    lengths = np.array([len(e) + 1 for e in encoded], np.int64)
    none = np.zeros(0, np.int64)
    if not len(buf):
        return np.zeros(0, np.uint64), np.zeros(len(encoded) + 1, np.int64), np.zeros(0, np.uint64), none
    inside = in_word[buf]
    edges = np.diff(inside.astype(np.int8), prepend=0, append=0)
    starts, ends = np.flatnonzero(edges == 1), np.flatnonzero(edges == -1)
    powers, inverse = _power_tables(len(buf) + 1)
    sums = np.zeros(len(buf) + 1, np.uint64)
    np.cumsum((buf.astype(np.uint64) + np.uint64(1)) * powers[: len(buf)], out=sums[1:])
    hashes = mix((sums[ends] - sums[starts]) * inverse[starts])
    offsets = np.searchsorted(starts, np.concatenate([[0], np.cumsum(lengths)]))
    if not stem:
        return hashes, offsets, np.zeros(0, np.uint64), none
    first = np.flatnonzero((buf & 0xC0) != 0x80)  # first bytes of characters
    after = np.searchsorted(first, starts) + stem
    stop = np.where(after < len(first), first[np.minimum(after, len(first) - 1)], len(buf))
    longer = np.flatnonzero(stop < ends)
    return hashes, offsets, mix((sums[stop[longer]] - sums[starts[longer]]) * inverse[starts[longer]], 5), longer


def word_hashes(encoded: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(hashes of all lower-cased words in order, offsets: words of text i are offsets[i]:offsets[i + 1])."""
    return _hashed(encoded, 0)[:2]


def term_hashes(encoded: list[bytes], stem: int) -> tuple[np.ndarray, np.ndarray]:
    """(hashes of the words and of the first ``stem`` characters of longer words, index of the text of each)."""
    hashes, offsets, stems, longer = _hashed(encoded, stem)
    owner = np.repeat(np.arange(len(encoded)), np.diff(offsets))
    return np.concatenate([hashes, stems]), np.concatenate([owner, owner[longer]])


def slices(batch, column: int, rows: int = 256, most: int = 1 << 22) -> Iterator:
    """Parts of an Arrow batch that become Python objects together: so many rows, and so many bytes of the column's text unless one row has more."""
    import pyarrow.compute as pc

    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    ends = np.cumsum(sizes)
    at = 0
    while at < batch.num_rows:
        to = max(at + 1, min(at + rows, int(np.searchsorted(ends, ends[at] - sizes[at] + most, side="right"))))
        yield batch.slice(at, to - at)
        at = to


def release() -> None:
    """Give memory that Arrow and the C library hold free back to the system: a worker goes on with other tasks."""
    import ctypes

    import pyarrow as pa

    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # another C library
        ctypes.CDLL("libc.so.6").malloc_trim(0)


def hash_of(word: str) -> int:
    return int(word_hashes([word.encode()])[0][0])
