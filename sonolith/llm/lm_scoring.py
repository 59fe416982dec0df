"""Log probabilities of texts under an interpolated modified Kneser-Ney bigram model.

Tokens are runs of characters that aren't ASCII white space, A-Z in lower case, and one end for each text; the first
token's context is a start that is no token. Words are 64-bit hashes. The model is counted in three exchanges of packed
arrays: tasks count the words of bounded batches, ranges of hashes are summed and written as sorted hash arrays, and a
word's place over all ranges is its id; pairs of ids are counted alike, keyed by a bijective scrambling of the pair, so
that a pair is dealt by itself and a word with a third of all pairs is dealt to all ranges; each range of pairs then
gives what a word needs as a context (tokens, and types seen once, twice or more) and as a continuation (distinct words
before it), summed by the word's range. The arrays lie in the shared folder and are memory-mapped by the workers that
look ids and pairs up; only ranges' sizes and the counts of counts pass the driver. Nothing is pruned.

P(w | v) = max(c(v w) - D(c(v w)), 0) / c(v) + g(v) P(w), with P(w) alike from the numbers of distinct words before w,
interpolated with 1 / (V + 1), the last class for all unknown words. The three discounts of each order follow from its
counts of counts; where one of these is 0 all three are a half. Unknown contexts have g = 1, so the probabilities of
all V words and the unknown class sum to 1 in every context. Up to 2**32 distinct words have ids.

Defined cases: a null text is the empty text, which is its end; a null doc_id is held out as its empty text's checksum
says; repeated rows count as often as they are there; without training texts every probability is 1; an empty table gives
an empty result; only doc_id and text are read, whatever other columns are called.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import id_remainder, session_partitions, shared_path, table
from .stores import mapped, put
from .text_arrays import _hashed, buffers, mix, release, slices

IN_TOKEN = np.ones(256, bool)
IN_TOKEN[[9, 10, 11, 12, 13, 32]] = False
#: Stand for the end and the start of a text among the hashes of words.
END, START = np.uint64(0xE4D5C3B2A1908F7E), np.uint64(0x57A27B0C1D2E3F40)
#: Bytes of training text for one range of words or pairs: what one task sums at once.
RANGE_BYTES = 64 << 20
#: Keys that a task holds before it passes its counts on.
HELD = 1 << 21
#: What is known of a word: tokens of it; tokens after it and types after it seen once, twice, more often; types before it.
WORD_FIELDS = {"count": "<i8", "total": "<i8", "once": "<u4", "twice": "<u4", "more": "<u4", "before": "<u4"}


def unmix(h: np.ndarray) -> np.ndarray:
    """The values that mix made h of."""
    def unshift(x: np.ndarray, by: int) -> np.ndarray:
        out = x
        for _ in range(64 // by):
            out = x ^ (out >> np.uint64(by))
        return out

    h = unshift(h, 31) * np.uint64(pow(0x94D049BB133111EB, -1, 1 << 64))
    h = unshift(h, 27) * np.uint64(pow(0xBF58476D1CE4E5B9, -1, 1 << 64))
    return unshift(h, 30) - np.uint64(0x632BE59BD9B4E019)


def summed(keys: np.ndarray, *values: np.ndarray) -> tuple[np.ndarray, ...]:
    """(distinct keys in order, each value's sums)."""
    if not len(keys):
        return (keys, *values)
    order = np.argsort(keys, kind="stable")
    ranked = keys[order]
    starts = np.flatnonzero(np.concatenate([[True], ranked[1:] != ranked[:-1]]))
    return (ranked[starts], *(np.add.reduceat(v[order], starts) for v in values))


def range_of(hashes: np.ndarray, n: int) -> np.ndarray:
    """Of n equal ranges of 64-bit values the one that each lies in."""
    return ((hashes >> np.uint64(32)) * np.uint64(n) >> np.uint64(32)).astype(np.int64)


class Counter:
    """Counts of keys, as packed rows of (range, keys, counts) whenever many are held."""

    def __init__(self, n: int, most: int = HELD):
        self.n, self.most, self.parts, self.size = n, most, [], 0

    def add(self, keys: np.ndarray, counts: np.ndarray) -> Iterator:
        self.parts.append((keys, counts))
        self.size += len(keys)
        if self.size > self.most:
            merged = self._merge()
            if len(merged[0]) > self.most // 2:
                yield self._packed(merged)
            else:
                self.parts, self.size = [merged], len(merged[0])

    def rest(self) -> Iterator:
        if self.size:
            yield self._packed(self._merge())

    def _merge(self) -> tuple:
        out = summed(np.concatenate([p[0] for p in self.parts]), np.concatenate([p[1] for p in self.parts]))
        self.parts, self.size = [], 0
        return out

    def _packed(self, merged: tuple):
        import pyarrow as pa

        keys, counts = merged
        at = np.searchsorted(range_of(keys, self.n), np.arange(self.n + 1))
        some = [b for b in range(self.n) if at[b] < at[b + 1]]
        columns = [pa.array([a[at[b] : at[b + 1]].tobytes() for b in some], pa.binary()) for a in (keys, counts.astype("<u4" if counts.max() < 1 << 32 else "<u8"))]
        return pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), *columns], names=["part", "keys", "counts"])


def _unpacked(blobs, dtype) -> np.ndarray:
    return np.concatenate([np.frombuffer(b, dtype) for b in blobs]) if len(blobs) else np.zeros(0, dtype)


def _merged(group) -> tuple[np.ndarray, np.ndarray]:
    """(keys in order, counts) of packed rows; counts of 4 or 8 bytes."""
    keys = [np.frombuffer(k, np.uint64) for k in group["keys"].to_pylist()]
    counts = [np.frombuffer(c, "<u4" if len(c) == 4 * len(k) else "<u8").astype(np.int64) for k, c in zip(keys, group["counts"].to_pylist(), strict=True)]
    return summed(np.concatenate(keys), np.concatenate(counts))


def _texts(batches: Iterator, column: int) -> Iterator:
    """(batch slice, first text's place in it, token hashes, offsets) of bounded buffers."""
    for batch in batches:
        for some in slices(batch, column):
            for first, encoded in buffers(some.column(column).to_pylist()):
                yield some, first, *_hashed(encoded, 0, IN_TOKEN)[:2]
    release()


def sequences(tokens: np.ndarray, offsets: np.ndarray, start: int, end: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(contexts, tokens, first place of each text) of texts with their ends. tokens: numbers of the texts' words."""
    n = len(offsets) - 1
    own = np.full(len(tokens) + n, end, np.int64)
    own[np.arange(len(tokens)) + np.repeat(np.arange(n), np.diff(offsets))] = tokens
    firsts = offsets[:-1] + np.arange(n)
    context = np.empty_like(own)
    context[1:] = own[:-1]
    context[firsts] = start
    return context, own, firsts


def _discounts(n: np.ndarray) -> tuple[float, ...]:
    """D(1), D(2), D(3 and more) from the numbers of types seen once to four times."""
    if (n <= 0).any():
        return (0.5, 0.5, 0.5)
    y = n[0] / (n[0] + 2 * n[1])
    return tuple(float(np.clip(k + 1 - (k + 2) * y * n[k + 1] / n[k], 0, k + 1)) for k in range(3))


def discounted(counts: np.ndarray, d: tuple[float, ...]) -> np.ndarray:
    return np.maximum(counts - np.array([0.0, *d])[np.minimum(counts, 3)], 0)


_maps: dict = {}


@dataclass(frozen=True)
class Model:
    """Where the arrays lie and what is the same for all words. sizes: (words, pairs) of each range."""

    root: str
    n: int
    words: tuple[int, ...] = ()
    pairs: tuple[int, ...] = ()
    tokens: int = 0
    distinct: int = 0
    pair_discounts: tuple[float, ...] = (0.5, 0.5, 0.5)
    word_discounts: tuple[float, ...] = (0.5, 0.5, 0.5)
    types: int = 0
    left_over: float = 1.0
    offsets: tuple[int, ...] = field(default=())

    def array(self, name: str, part: int, dtype) -> np.ndarray:
        """A range's array, mapped once in a worker."""
        if _maps.get("root") != self.root:
            _maps.clear()
            _maps["root"] = self.root
        key = (name, part)
        if key not in _maps:
            _maps[key] = mapped(f"{self.root}/{name}-{part}", dtype)
        return _maps[key]

    def find(self, hashes: np.ndarray, kind: str, sizes: tuple[int, ...]) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(range, places in hashes, places in the range's array) of the hashes that are there. hashes ascend."""
        at = np.searchsorted(range_of(hashes, self.n), np.arange(self.n + 1))
        for part in np.flatnonzero(np.diff(at)):
            if sizes[part]:
                known = self.array(kind, part, "<u8")
                own = hashes[at[part] : at[part + 1]]
                place = np.minimum(np.searchsorted(known, own), len(known) - 1)
                there = np.flatnonzero(known[place] == own)
                yield int(part), there + at[part], place[there]

    def word_ids(self, hashes: np.ndarray) -> np.ndarray:
        """Ids of ascending hashes, -1 for unknown words."""
        ids = np.full(len(hashes), -1, np.int64)
        for part, i, place in self.find(hashes, "words", self.words):
            ids[i] = place + self.offsets[part]
        return ids

    def word_fields(self, hashes: np.ndarray) -> tuple[np.ndarray, dict]:
        ids, out = np.full(len(hashes), -1, np.int64), {k: np.zeros(len(hashes), np.int64) for k in WORD_FIELDS}
        for part, i, place in self.find(hashes, "words", self.words):
            ids[i] = place + self.offsets[part]
            for k, dtype in WORD_FIELDS.items():
                out[k][i] = self.array(k, part, dtype)[place]
        return ids, out

    def pair_counts(self, keys: np.ndarray) -> np.ndarray:
        """How often pairs were seen; keys: see pair_keys."""
        distinct, inverse = np.unique(mix(keys), return_inverse=True)
        counts = np.zeros(len(distinct), np.int64)
        for part, i, place in self.find(distinct, "pairs", self.pairs):
            counts[i] = self.array("seen", part, "<u8" if self.pairs[part] < 0 else "<u4")[place]
        return counts[inverse]

    def judged(self, hashes: np.ndarray, offsets: np.ndarray) -> dict[str, np.ndarray]:
        """n_tokens, n_known, base_score and score of texts, from the hashes of their words."""
        distinct, inverse = np.unique(np.concatenate([hashes, np.array([START, END], np.uint64)]), return_inverse=True)
        ids, w = self.word_fields(distinct)
        context, own, firsts = sequences(inverse[:-2], offsets, int(inverse[-2]), int(inverse[-1]))
        base = np.log10((w["count"] + 1) / (self.tokens + self.distinct + 1))
        word = (discounted(w["before"], self.word_discounts) / max(self.types, 1) + self.left_over / (self.distinct + 1))
        d1, d2, d3 = self.pair_discounts
        left = np.where(w["total"] > 0, (d1 * w["once"] + d2 * w["twice"] + d3 * w["more"]) / np.maximum(w["total"], 1), 1.0)
        seen = np.zeros(len(own), np.int64)
        both = np.flatnonzero((ids[context] >= 0) & (ids[own] >= 0))
        seen[both] = self.pair_counts(pair_keys(ids[context[both]], ids[own[both]]))
        p = discounted(seen, self.pair_discounts) / np.maximum(w["total"][context], 1) + left[context] * word[own]
        return {
            "n_tokens": np.diff(np.append(firsts, len(own))), "n_known": np.add.reduceat((w["count"] > 0)[own].astype(np.int64), firsts),
            "base_score": np.add.reduceat(base[own], firsts), "score": np.add.reduceat(np.log10(p), firsts),
        }


def pair_keys(context: np.ndarray, own: np.ndarray) -> np.ndarray:
    return context.astype(np.uint64) << np.uint64(32) | own.astype(np.uint64)


def train(docs: DataFrame, text_col: str = "text", range_bytes: int = RANGE_BYTES, held: int = HELD) -> Model:
    """The model of all rows of docs, as arrays in a new folder of the shared one."""
    import pyarrow as pa

    spark = docs.sparkSession
    texts = docs.select(F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    size = texts.agg(F.sum(F.octet_length("text") + 1)).first()[0] or 0
    n, root = max(session_partitions(spark), -(-size // range_bytes)), shared_path(spark, "ngrams")

    def count_words(batches: Iterator) -> Iterator:
        counter = Counter(n, held)
        for _, _, hashes, offsets in _texts(batches, 0):
            words, times = np.unique(hashes, return_counts=True)
            # the start is a word that is never counted
            yield from counter.add(np.concatenate([words, np.array([END, START], np.uint64)]), np.concatenate([times, [len(offsets) - 1, 0]]))
        yield from counter.rest()

    def write_words(group: pa.Table) -> pa.Table:
        part, (words, times) = group["part"][0].as_py(), _merged(group)
        put(f"{root}/words-{part}", words.astype("<u8"))
        put(f"{root}/count-{part}", times.astype("<i8"))
        return pa.table({"part": pa.array([part], pa.int32()), "n": [len(words)], "known": [int((times > 0).sum())], "tokens": [int(times.sum())]})

    packed = "part int, keys binary, counts binary"
    found = texts.mapInArrow(count_words, packed).groupBy("part").applyInArrow(write_words, "part int, n bigint, known bigint, tokens bigint").collect()  # a row for each range
    sizes = np.zeros(n, np.int64)
    for r in found:
        sizes[r.part] = r.n
    if sizes.sum() >= 1 << 32:
        raise ValueError("more than 2**32 distinct words")
    words = Model(root, n, tuple(sizes.tolist()), tokens=sum(r.tokens for r in found), distinct=sum(r.known for r in found), offsets=tuple((np.cumsum(sizes) - sizes).tolist()))
    if not found:
        return words

    def count_pairs(batches: Iterator) -> Iterator:
        counter = Counter(n, held)
        for _, _, hashes, offsets in _texts(batches, 0):
            distinct, inverse = np.unique(np.concatenate([hashes, np.array([START, END], np.uint64)]), return_inverse=True)
            ids = words.word_ids(distinct)
            context, own, _ = sequences(ids[inverse[:-2]], offsets, int(ids[inverse[-2]]), int(ids[inverse[-1]]))
            keys, times = np.unique(mix(pair_keys(context, own)), return_counts=True)
            yield from counter.add(keys, times)
        yield from counter.rest()

    def write_pairs(group: pa.Table) -> pa.Table:
        """The words' figures by their ranges; in range -1 the pairs' own."""
        part, (keys, times) = group["part"][0].as_py(), _merged(group)
        wide = bool(len(times) and times.max() >= 1 << 32)
        put(f"{root}/pairs-{part}", keys.astype("<u8"))
        put(f"{root}/seen-{part}", times.astype("<u8" if wide else "<u4"))
        pairs = unmix(keys)
        context, own = (pairs >> np.uint64(32)).astype(np.int64), (pairs & np.uint64(0xFFFFFFFF)).astype(np.int64)
        zero = np.zeros(len(pairs), np.int64)
        both = summed(
            np.concatenate([context, own]), np.concatenate([times, zero]), *(np.concatenate([x.astype(np.int64), zero]) for x in (times == 1, times == 2, times > 2)), np.concatenate([zero, zero + 1]))
        at = np.searchsorted(both[0], [*words.offsets, sum(words.words)])
        some = [b for b in range(n) if at[b] < at[b + 1]]
        out = {"part": pa.array([-1, *some], pa.int32())}
        own_figures = np.array([part, -len(keys) if wide else len(keys), *((times == k).sum() for k in (1, 2, 3, 4))], "<i8")
        for name, values, dtype in zip(("ids", "total", "once", "twice", "more", "before"), both, ("<u4", "<u8", "<u4", "<u4", "<u4", "<u4"), strict=True):
            out[name] = pa.array([own_figures.tobytes() if name == "ids" else b"", *(values[at[b] : at[b + 1]].astype(dtype).tobytes() for b in some)], pa.binary())
        return pa.table(out)

    def write_figures(group: pa.Table) -> pa.Table:
        """Dense arrays of a range's words, and how many words have one, two, three and four words before them."""
        part = group["part"][0].as_py()
        if part < 0:
            return pa.table({"part": group["part"], "figures": group["ids"]})
        ids = _unpacked(group["ids"].to_pylist(), "<u4").astype(np.int64) - words.offsets[part]
        figures = [part]
        for name, dtype in (("total", "<u8"), ("once", "<u4"), ("twice", "<u4"), ("more", "<u4"), ("before", "<u4")):
            dense = np.zeros(words.words[part], np.int64)
            np.add.at(dense, ids, _unpacked(group[name].to_pylist(), dtype).astype(np.int64))
            put(f"{root}/{name}-{part}", dense.astype(WORD_FIELDS[name]))
        figures += [int((dense == k).sum()) for k in (1, 2, 3, 4)] + [int((dense > 2).sum()), int(dense.sum())]
        return pa.table({"part": pa.array([part], pa.int32()), "figures": pa.array([np.array(figures, "<i8").tobytes()], pa.binary())})

    shape = "part int, ids binary, total binary, once binary, twice binary, more binary, before binary"
    rows = texts.mapInArrow(count_pairs, packed).groupBy("part").applyInArrow(write_pairs, shape).groupBy("part").applyInArrow(write_figures, "part int, figures binary").collect()  # two rows for each range
    pairs, seen = np.zeros(n, np.int64), np.zeros(4, np.int64)
    for f in (np.frombuffer(r.figures, "<i8") for r in rows if r.part < 0):
        pairs[f[0]] = f[1]
        seen += f[2:6]
    before = sum(np.frombuffer(r.figures, "<i8")[1:] for r in rows if r.part >= 0)
    d = _discounts(before[:4])
    types = int(before[5])
    left = (d[0] * before[0] + d[1] * before[1] + d[2] * before[4]) / types
    return Model(root, n, words.words, tuple(pairs.tolist()), words.tokens, words.distinct, _discounts(seen), d, types, float(left), words.offsets)


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_tokens, n_known, base_score, score, perplexity) of every row of docs."""
    import pyarrow as pa

    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("ident"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))

    def run(batches: Iterator) -> Iterator:
        for some, first, hashes, offsets in _texts(batches, 1):
            got = model.judged(hashes, offsets)
            got["perplexity"] = 10.0 ** (-got["score"] / got["n_tokens"])
            yield pa.RecordBatch.from_arrays([some.column(0).slice(first, len(offsets) - 1), *map(pa.array, got.values())], names=["ident", *got])

    out = rows.mapInArrow(run, f"ident {kind}, n_tokens bigint, n_known bigint, base_score double, score double, perplexity double")
    return out.withColumnRenamed("ident", id_col)


def held_out(ident: Column) -> Column:
    return id_remainder(ident, 7) == 2


def op11_lm_scoring(spark, sf_dir: str) -> DataFrame:
    """Every document under the model of those that aren't held out."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = train(docs.where(~held_out(F.col("doc_id"))))
    found = score(docs, model)
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "n_tokens", "n_known", F.lit(model.tokens).cast("bigint").alias("train_tokens"), "base_score", "score", "perplexity")


QUERIES = {"op11_lm_scoring": op11_lm_scoring}
SQL: dict[str, str] = {}
