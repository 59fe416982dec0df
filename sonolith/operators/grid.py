"""Votes of one cell of the grid: some clips' rows by some tracks' postings, in arrays, as many hits at a time as fit."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

#: Hits that are laid out at once, unless one clip and track have more; rows of a batch that is given back.
HITS = 1 << 21
ROWS = 1 << 16


def _codes(columns: list) -> tuple[np.ndarray, np.ndarray]:
    """(a number for every row, a row of each number): equal ids have one number."""
    out = np.zeros(len(columns[0]), np.int64)
    for column in columns:
        coded = column.combine_chunks().dictionary_encode(null_encoding="encode")
        coded = coded.combine_chunks() if hasattr(coded, "combine_chunks") else coded
        out = out * max(len(coded.dictionary), 1) + coded.indices.to_numpy(zero_copy_only=False)
    _, first, code = np.unique(out, return_index=True, return_inverse=True)
    return code, first


def _runs(sorted_keys: np.ndarray) -> np.ndarray:
    """Where runs of equal keys start."""
    return np.flatnonzero(np.concatenate([[True], sorted_keys[1:] != sorted_keys[:-1]]))


def _spans(sizes: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """Ranges of rows of about ``most`` in all, and of one row at least."""
    ends, at = np.cumsum(sizes), 0
    while at < len(sizes):
        to = max(at + 1, int(np.searchsorted(ends, ends[at] - sizes[at] + most, side="right")))
        yield at, to
        at = to


def _counted(pair: np.ndarray, offset: np.ndarray, times: np.ndarray) -> tuple[np.ndarray, ...]:
    """(pair, offset, votes) of hits, by pair and offset."""
    low, values = int(offset.min()), None
    width = int(offset.max()) - low + 1
    if (int(pair.max()) + 1) * width >= 1 << 62:  # offsets of far apart times are numbered
        values, offset = np.unique(offset, return_inverse=True)
        low, width = 0, len(values)
    key = pair * width + (offset - low)
    if (times == 1).all():
        key.sort()
        start = _runs(key)
        votes = np.diff(np.append(start, len(key)))
    else:
        order = np.argsort(key, kind="stable")
        key = key[order]
        start = _runs(key)
        votes = np.add.reduceat(times[order], start)
    key = key[start]
    offset = key % width + low
    return key // width, offset if values is None else values[offset], votes


def _best(start: np.ndarray, sizes: np.ndarray, offset: np.ndarray, votes: np.ndarray) -> np.ndarray:
    """The row of each pair with most votes, then the least offset by amount, then the least."""
    most = votes == np.repeat(np.maximum.reduceat(votes, start), sizes)
    far = np.where(most, np.abs(offset), np.iinfo(np.int64).max)
    rows = np.flatnonzero(most & (far == np.repeat(np.minimum.reduceat(far, start), sizes)))
    pair = np.repeat(np.arange(len(start)), sizes)[rows]
    return rows[_runs(pair)] if len(rows) else rows  # a pair's offsets ascend


def _places(clip: np.ndarray, start: np.ndarray, count: np.ndarray, at: np.ndarray, part: tuple[int, int]) -> tuple[np.ndarray, np.ndarray]:
    """(start, number) of the rows of the clips in a range, within the rows of each of the hashes at."""
    hashes, where = np.unique(at, return_inverse=True)
    low, high = (np.array([start[h] + np.searchsorted(clip[start[h] : start[h] + count[h]], c) for h in hashes.tolist()], np.int64) for c in part)
    return low[where], (high - low)[where]


def votes_of(clip: np.ndarray, clip_hash: np.ndarray, t1: np.ndarray, times: np.ndarray, track: np.ndarray, track_hash: np.ndarray, anchor: np.ndarray, best: bool, hits: int = HITS) -> Iterator[tuple[np.ndarray, ...]]:
    """(clip, track, offset, votes, total votes) arrays; clips and tracks are numbers from 0, a pair is in one of the yields."""
    order = np.lexsort((clip, clip_hash))
    clip, clip_hash, t1, times = clip[order], clip_hash[order], t1[order], times[order]
    start = _runs(clip_hash) if len(clip) else np.zeros(0, np.int64)
    count = np.diff(np.append(start, len(clip)))
    if not len(start) or not len(track):
        return
    at = np.minimum(np.searchsorted(clip_hash[start], track_hash), len(start) - 1)
    met = clip_hash[start][at] == track_hash
    at, track, anchor = at[met], track[met], anchor[met]
    order = np.argsort(track, kind="stable")
    at, track, anchor = at[order], track[order], anchor[order]
    if not len(track):
        return
    first = _runs(track)
    size = np.add.reduceat(count[at], first)
    ends = np.append(first[1:], len(track))
    n_clips = int(clip.max()) + 1
    for a, b in _spans(size, hits):
        rows = np.arange(first[a], ends[b - 1])
        parts: list = [None]
        if size[a:b].sum() > hits:  # one track: its clips in ranges
            each = np.zeros(n_clips, np.int64)
            for h, n in zip(*np.unique(at[rows], return_counts=True), strict=True):
                np.add.at(each, clip[start[h] : start[h] + count[h]], n)
            parts = list(_spans(each, hits))
        for part in parts:
            s, n = start[at[rows]], count[at[rows]]
            if part is not None:  # the clips of a hash ascend
                s, n = _places(clip, start, count, at[rows], part)
            total = int(n.sum())
            if not total:
                continue
            row = np.repeat(rows, n)
            q = np.repeat(s - np.cumsum(n) + n, n) + np.arange(total)
            pair, offset, votes = _counted(track[row] * n_clips + clip[q], anchor[row] - t1[q], times[q])
            runs = _runs(pair)
            sizes = np.diff(np.append(runs, len(pair)))
            sums = np.repeat(np.add.reduceat(votes, runs), sizes)
            if best:
                kept = _best(runs, sizes, offset, votes)
                pair, offset, votes, sums = pair[kept], offset[kept], votes[kept], sums[kept]
            yield pair % n_clips, pair // n_clips, offset, votes, sums


def cell_votes(batches: Iterator, keys: tuple[str, ...], best: bool) -> Iterator:
    """Record batches of votes of a cell's rows: clips' rows have times over 0, postings 0."""
    import pyarrow as pa
    import pyarrow.compute as pc

    rows = list(batches)
    if not rows:
        return
    table = pa.Table.from_batches(rows)
    is_clip = pc.greater(table.column("times"), 0)
    clips, tracks = table.filter(is_clip), table.filter(pc.invert(is_clip))
    del table, rows
    if not clips.num_rows or not tracks.num_rows:
        return
    (clip, a_clip), (track, a_track) = _codes([clips.column("query_id")]), _codes([tracks.column(k) for k in keys])
    array = lambda t, name: t.column(name).to_numpy()
    names = [clips.column("query_id").take(a_clip), *(tracks.column(k).take(a_track) for k in keys)]
    found = votes_of(clip, array(clips, "hash"), array(clips, "at"), array(clips, "times"), track, array(tracks, "hash"), array(tracks, "at"), best)
    for c, t, *rest in found:
        for at in range(0, len(c), ROWS):
            some = slice(at, at + ROWS)
            ids = [names[0].take(c[some]), *(n.take(t[some]) for n in names[1:])]
            yield pa.RecordBatch.from_arrays([*(i.combine_chunks() for i in ids), *(pa.array(r[some], pa.int64()) for r in rest)], names=["query_id", *keys, "offset_frames", "votes", "total_votes"])
