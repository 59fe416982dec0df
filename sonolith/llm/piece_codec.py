"""SentencePiece encoding and decoding by batched Viterbi.

Spaces become U+2581 and one is put before the text. No piece goes on past a U+2581 after another character,
so the best segmentation of a text is that of its words, each with its leading U+2581. Distinct words are
grouped by length; all words of a group advance together, one start position and one piece length at a time:
rolling hashes of the substrings probe the sorted keys of the pieces and their prefixes (a hit is held against the
characters, and a substring that starts no piece isn't made longer), scores are added to the best of the start, and maxima with their back-pointers are kept where
they grow. A long word is many windows that advance together in the same way. A character that no piece holds costs more than any piece and is written as its bytes' pieces. Equal sums go to the longer last piece.

The segmentation maximises the sum of the model file's piece scores. A model trained as BPE stores merge
ranks as scores; its own merge order isn't a maximum of sums and can cut a word otherwise (both decode to
the same text).

Defined cases: null and empty texts have no ids and decode to the empty text; U+2581 in a text reads back as
a space; bytes that are no UTF-8 decode to U+FFFD; repeated rows get equal ids; an empty table gives an
empty result; other columns are kept or left out as asked.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import table
from .text_arrays import release, slices

SPACE = "▁"
RUNS = re.compile(f"{SPACE}+[^{SPACE}]*")
BASE = np.uint64(0x9E3779B97F4A7C15)
#: Distinct words cached in a worker; words advanced together.
CACHE_WORDS = 150_000
GROUP = 20_000
#: Words of more characters advance as windows of so many characters, so many rows at once; what is after a word's end.
LONG = 2048
WINDOW = 512
WINDOW_ROWS = 1024
PAD = 0x110000


def _keys(points: np.ndarray) -> np.ndarray:
    h = np.zeros(len(points), np.uint64)
    for k in range(points.shape[1]):
        h = (h + points[:, k] + np.uint64(1)) * BASE
        h ^= h >> np.uint64(32)
    return h


def _points(words: list[str]) -> np.ndarray:
    """Code points of words of one length, a row each."""
    return np.frombuffer("".join(words).encode("utf-32-le", "replace"), "<u4").reshape(len(words), -1)


class Pieces:
    """A piece model: sorted keys of the pieces, their scores and texts."""

    def __init__(self, pieces: list[tuple[int, str, float]], byte_ids: dict[int, int], size: int, unknown: int = 0):
        pieces = [p for p in pieces if p[1]]
        self.longest = max(len(p[1]) for p in pieces)
        self.byte_ids = np.array([byte_ids.get(b, unknown) for b in range(256)], np.int64)
        scores = {p[1]: (p[0], p[2]) for p in pieces}
        tables, above = [], {"": 0}
        for n in range(1, self.longest + 1):  # the prefixes of n characters of all pieces; a piece is one of them
            starts = sorted({p[1][:n] for p in pieces if len(p[1]) >= n})
            points = _points(starts)
            keys = _keys(points)
            order = np.argsort(keys)
            if (np.diff(keys[order]) == 0).any():
                raise ValueError("two prefixes have the same key")
            found = [scores.get(x, (-1, -np.inf)) for x in starts]
            parents = np.array([above[x[:-1]] for x in starts])
            tables.append((keys[order], np.array([f[1] for f in found])[order], np.array([f[0] for f in found], np.int64)[order], parents[order], points[order, -1]))
            place = np.empty(len(starts), np.int64)
            place[order] = np.arange(len(starts))
            above = dict(zip(starts, place.tolist(), strict=True))
        self.tables = tables
        self.unknown_score = min(p[2] for p in pieces) - 10.0
        held = {p[0]: p[1].replace(SPACE, " ").encode() for p in pieces} | {i: bytes([b]) for b, i in byte_ids.items()} | ({unknown: " ⁇ ".encode()} if unknown not in byte_ids.values() else {})
        self.raw = [held.get(i, b"") for i in range(size)]
        self.cache: dict[str, bytes] = {}

    @staticmethod
    def load(path: str) -> Pieces:
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        size = model.vocab_size()
        plain, by_byte = [], {}
        for i in range(size):
            if model.is_byte(i):
                by_byte[int(model.id_to_piece(i)[3:-1], 16)] = i
            elif not (model.is_control(i) or model.is_unknown(i) or model.is_unused(i)):
                plain.append((i, model.id_to_piece(i), model.get_score(i)))
        return Pieces(plain, by_byte, size, model.unk_id())

    def _forward(self, points: np.ndarray, best: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(back, piece) of words of one length, all at once: best holds the sums that are known, and is filled."""
        n, length = points.shape
        back = np.zeros((length + 1, n), np.int32)
        piece = np.full((length + 1, n), -1, np.int32)
        for start in range(length):
            open_words, at = np.arange(n), np.zeros(n, np.int64)
            h = np.zeros(n, np.uint64)
            alone = np.zeros(n, bool)
            for size in range(1, min(self.longest, length - start) + 1):
                end = start + size
                keys, scores, ids, parents, last = self.tables[size - 1]
                char = points[open_words, end - 1]
                h = (h + char + np.uint64(1)) * BASE
                h ^= h >> np.uint64(32)
                to = np.minimum(np.searchsorted(keys, h), len(keys) - 1)
                # the same key, the same last character, and the same prefix before it
                hit = np.flatnonzero((keys[to] == h) & (last[to] == char) & (parents[to] == at))
                if not len(hit):
                    break
                open_words, at, h = open_words[hit], to[hit], h[hit]  # only prefixes of pieces go on
                full = np.flatnonzero(ids[at] >= 0)
                some, place = open_words[full], at[full]
                if size == 1:
                    alone[some] = True
                total = best[start, some] + scores[place]
                more = total > best[end, some]
                some = some[more]
                best[end, some], back[end, some], piece[end, some] = total[more], start, ids[place[more]]
            total = np.where(alone, -np.inf, best[start] + self.unknown_score)
            more = np.flatnonzero(total > best[start + 1])
            best[start + 1, more], back[start + 1, more], piece[start + 1, more] = total[more], start, -1
        return back, piece

    def _bytes_of(self, text: str) -> np.ndarray:
        return self.byte_ids[np.frombuffer(text.encode("utf-8", "replace"), np.uint8)]

    def segment(self, words: list[str]) -> list[bytes]:
        """Ids of words of one length by Viterbi, all words at once, as little-endian 32-bit integers."""
        points = _points(words)
        n, length = points.shape
        best = np.full((length + 1, n), -np.inf)
        best[0] = 0
        back, piece = self._forward(points, best)
        at = np.full(n, length)
        alive = np.arange(n)
        owners, found, starts = [], [], []
        while len(alive):  # from the ends of all words to their starts
            start = back[at[alive], alive]
            owners.append(alive)
            found.append(piece[at[alive], alive])
            starts.append(start)
            at[alive] = start
            alive = alive[start > 0]
        owner, ids, start = np.concatenate(owners), np.concatenate(found), np.concatenate(starts)
        order = np.lexsort((start, owner))
        owner, ids, start = owner[order], ids[order], start[order]
        unknown = np.flatnonzero(ids < 0)
        if len(unknown):  # each becomes its bytes' pieces
            raw = [self._bytes_of(words[w][s]) for w, s in zip(owner[unknown].tolist(), start[unknown].tolist(), strict=True)]
            times = np.ones(len(ids), np.int64)
            times[unknown] = [len(r) for r in raw]
            owner, place = np.repeat(owner, times), np.repeat(ids < 0, times)
            ids = np.repeat(ids, times)
            ids[place] = np.concatenate(raw)
        data = ids.astype("<i4").tobytes()
        ends = (4 * np.cumsum(np.bincount(owner, minlength=n))).tolist()
        return [data[s:e] for s, e in zip([0, *ends[:-1]], ends, strict=True)]

    def segment_long(self, word: str) -> bytes:
        """Ids of one long word; its windows advance together.

        A path has a cut among any ``longest`` places in a row, so the sums at the first places of a window follow from
        those of the window before and the best sums between the two, which all windows find at the same time, a row for
        each place. From these sums every window then finds its cuts as in one run over the whole word.
        """
        m, step = self.longest, max(WINDOW, self.longest)
        size, n = step + m, len(word)
        windows = -(-n // step)
        points = np.full(windows * step + m, PAD, np.uint32)
        points[:n] = _points([word])[0]
        cut = np.lib.stride_tricks.sliding_window_view(points, size)[::step]
        sums = np.full((windows + 1, m), -np.inf)  # at the first places of every window
        start = np.full((size + 1, 1), -np.inf)
        start[0] = 0
        self._forward(cut[:1], start)
        sums[0] = start[:m, 0]
        group = max(1, WINDOW_ROWS // m)
        for at in range(0, windows, group):
            some = cut[at : at + group]
            best = np.full((size + 1, len(some) * m), -np.inf)
            best[np.tile(np.arange(m), len(some)), np.arange(len(some) * m)] = 0
            self._forward(np.repeat(some, m, axis=0), best)
            between = best[step : step + m].reshape(m, len(some), m)  # to place, window, from place
            for k in range(len(some)):
                sums[at + k + 1] = (between[:, k] + sums[at + k]).max(axis=1)
        back, piece = np.zeros(n + m + step, np.int64), np.full(n + m + step, -1, np.int64)
        for at in range(0, windows, WINDOW_ROWS):
            some = cut[at : at + WINDOW_ROWS]
            best = np.full((size + 1, len(some)), -np.inf)
            best[:m] = sums[at : at + len(some)].T
            b, p = self._forward(some, best)
            for k in range(len(some)):
                first = (at + k) * step
                lo = m if at + k else 0
                hi = min(step + m, n + 1 - first)
                if hi > lo:
                    back[first + lo : first + hi], piece[first + lo : first + hi] = b[lo:hi, k] + first, p[lo:hi, k]
            if not at:  # the first places come from the run over the start of the word
                first_best = np.full((size + 1, 1), -np.inf)
                first_best[0] = 0
                b, p = self._forward(cut[:1], first_best)
                hi = min(m, n + 1)
                back[:hi], piece[:hi] = b[:hi, 0], p[:hi, 0]
        backs, pieces, end, out = back.tolist(), piece.tolist(), n, []
        while end > 0:
            out.append([pieces[end]] if pieces[end] >= 0 else self._bytes_of(word[backs[end]]).tolist())
            end = backs[end]
        return np.array([i for ids in reversed(out) for i in ids], "<i4").tobytes()

    def learn(self, words: set[str]) -> None:
        """Segment words into the cache, grouped by length. Words come without their first U+2581."""
        groups: dict[int, list[str]] = {}
        for w in words:
            groups.setdefault(len(w), []).append(w)
        for length, some in groups.items():
            if length > LONG:
                self.cache.update((w, self.segment_long(SPACE + w)) for w in some)
                continue
            step = max(1, min(GROUP, 4_000_000 // (length + 1)))
            for at in range(0, len(some), step):
                part = some[at : at + step]
                self.cache.update(zip(part, self.segment([SPACE + w for w in part]), strict=True))

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """Ids of every whole text as little-endian 32-bit integers."""
        if len(self.cache) > CACHE_WORDS:
            self.cache.clear()
        cut = []
        for t in texts:
            if not t:
                cut.append([])
            elif t[0] == " " or t[-1] == " " or "  " in t or SPACE in t:
                cut.append([w[1:] for w in RUNS.findall(SPACE + t.replace(" ", SPACE))])
            else:  # the same words
                cut.append(t.split(" "))
        new = set().union(*cut).difference(self.cache)
        if new:
            self.learn(new)
        get = self.cache.__getitem__
        return [b"".join(map(get, c)) for c in cut]

    def decode(self, ids: np.ndarray) -> str:
        """The text of ids; ids out of range are left out."""
        raw = self.raw
        text = b"".join([raw[i] for i in ids.tolist() if 0 <= i < len(raw)]).decode("utf-8", "replace")
        return text[1:] if text.startswith(" ") else text


_models: dict[str, Pieces] = {}


def pieces_at(path: str) -> Pieces:
    """This worker's model of a file: kept for the worker's next tasks."""
    if path not in _models:
        _models[path] = Pieces.load(path)
    return _models[path]


def encode_texts(docs: DataFrame, path: str, text_col: str = "text", keep: tuple[str, ...] = ("doc_id",), check: bool = False) -> DataFrame:
    """The kept columns, ids (array<int>) and ids_crc32 of every document; with check also round_trip: whether the ids
    decode, in the same task, to the text again, U+2581 read as a space."""
    import pyarrow as pa

    def run(batches: Iterator) -> Iterator:
        model = pieces_at(path)
        for batch in batches:
            for some in slices(batch, 0):
                texts = some.column(0).to_pylist()
                found = model.encode(texts)
                ends = np.cumsum([0] + [len(x) // 4 for x in found])
                ids = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.frombuffer(b"".join(found), "<i4")))
                columns = [*some.columns[1:], ids, pa.array([zlib.crc32(x) for x in found], pa.int64())]
                if check:
                    columns.append(pa.array([model.decode(np.frombuffer(x, "<i4")) == (t or "").replace(SPACE, " ") for x, t in zip(found, texts, strict=True)], pa.bool_()))
                yield pa.RecordBatch.from_arrays(columns, names=[*some.schema.names[1:], "ids", "ids_crc32", *["round_trip"] * check])
        model.cache.clear()  # the worker may go on with another operator's tasks
        release()

    flat = docs.select(F.col(text_col).cast("string").alias("\x00text"), *keep)
    kinds = ", ".join(f"`{n}` {t}" for n, t in docs.select(*keep).dtypes)
    return flat.mapInArrow(run, f"{kinds}, ids array<int>, ids_crc32 bigint" + ", round_trip boolean" * check)


def decode_ids(encoded: DataFrame, path: str, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The kept columns and text of every row's ids."""
    import pyarrow as pa

    def run(batches: Iterator) -> Iterator:
        model = pieces_at(path)
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                some = batch.slice(at, 256)
                lists = some.column(0)
                flat, ends = lists.flatten().to_numpy(zero_copy_only=False), np.cumsum([0] + lists.value_lengths().fill_null(0).to_pylist())
                texts = [model.decode(flat[ends[i] : ends[i + 1]]) for i in range(some.num_rows)]
                yield pa.RecordBatch.from_arrays([*some.columns[1:], pa.array(texts, pa.string())], names=[*some.schema.names[1:], "decoded"])

    kinds = ", ".join(f"`{n}` {t}" for n, t in encoded.select(*keep).dtypes)
    return encoded.select("ids", *keep).mapInArrow(run, f"{kinds}, decoded string")


def encode_and_check(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, n_pieces, ids, ids_crc32, round_trip of every document: one worker of a task encodes and decodes."""
    found = encode_texts(docs.select("doc_id", "text"), path, check=True)
    return found.select("doc_id", F.size("ids").cast("bigint").alias("n_pieces"), "ids", "ids_crc32", "round_trip")


def op6_piece_codec(spark, sf_dir: str) -> DataFrame:
    """Every document's piece ids, as digests, and whether they decode to its text."""
    import public_tokenizers

    return encode_and_check(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model")).drop("ids")


QUERIES = {"op6_piece_codec": op6_piece_codec}
SQL: dict[str, str] = {}
