"""Token ids as Simple-8b word-aligned blocks.

Format. A stream of ids is cut into blocks of ``BLOCK`` ids, and a block is a run of 64-bit little-endian
words. The low four bits of a word are its selector; the other 60 hold a fixed count of ids of a fixed
width, the first id lowest (``COUNTS``, ``WIDTHS``); selectors 0 and 1 are runs of 240 and 120 zeros. In a
word of selector 15 a field of ones is the escape: the id, of more than 60 bits, is the next one in the list
of escapes at the end. A chunk is a header (magic, ids, blocks, escapes), the word offset of every block, the
words, and the escapes. Each block has BLOCK ids but for the last and starts at a word of its own, so blocks
decode together: words are unpacked selector by selector with array operations.

Files. A file is a Parquet file, so that any store that Spark reaches works and a task's output is committed
as a whole or not at all; its rows are chunks in stream order with the documents they hold. The files of one
output are ordered by ``part``.

Defined cases: a null text is the empty text; an empty text is its end id alone; null ids sort first and are
kept; repeated rows are repeated; an empty table writes no chunk; other columns are not read.
"""

from __future__ import annotations

import json
import re
import zlib
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import session_partitions, shared_path, table
from .text_arrays import slices

#: By selector: ids in a word, and bits of each.
COUNTS = np.array([240, 120, 60, 30, 20, 15, 12, 10, 8, 7, 6, 5, 4, 3, 2, 1])
WIDTHS = np.array([0, 0, 1, 2, 3, 4, 5, 6, 7, 8, 10, 12, 15, 20, 30, 60])
ESCAPE = (1 << 60) - 1
#: The least id too wide for each of WIDTHS[1:-1].
LEAST = np.uint64(1) << WIDTHS[1:-1].astype(np.uint64)
MAGIC = 0x31423853
BLOCK = 512
#: A chunk ends with the document that reaches so many ids.
CHUNK_IDS = 1 << 18
#: Cached words in a worker (about 200 bytes each), and characters of the longest of them.
CACHE_WORDS = 1_200_000
LONGEST = 200
#: Rows whose texts are encoded together at most.
ROWS = 1024
END_ID = 0


def encode_chunk(ids: np.ndarray) -> bytes:
    """A chunk with the given unsigned 64-bit ids."""
    ids = np.asarray(ids, dtype=np.uint64)
    n, blocks = len(ids), -(-len(ids) // BLOCK)
    escaped = ids >= ESCAPE
    escapes = ids[escaped]
    grid = np.zeros(blocks * BLOCK, np.uint64)
    grid[:n] = np.where(escaped, np.uint64(ESCAPE), ids)
    lengths = np.full(blocks, BLOCK)
    if blocks:
        lengths[-1] = n - (blocks - 1) * BLOCK
    need = np.searchsorted(LEAST, grid, side="right").astype(np.int8).reshape(blocks, BLOCK)  # the least width's place among WIDTHS[1:]
    if blocks:
        need[-1, lengths[-1] :] = 0
    best = np.full((blocks, BLOCK), 15, np.int8)
    for s in range(14, -1, -1):  # the last that fits has the most ids
        fits = need <= max(s - 1, 0)
        if s < 10 and fits.sum() < 0.05 * n:  # no long run is likely: a few words more
            continue
        run, size = np.pad(fits, ((0, 0), (0, 240)), constant_values=True), 1  # a block's last word may have fewer ids
        while size < COUNTS[s]:
            more = min(size, COUNTS[s] - size)
            run, size = run[:, :-more] & run[:, more:], size + more
        best[run[:, :BLOCK]] = s
    best = best.reshape(-1)
    words, owners = [], []
    where, alive = np.arange(blocks) * BLOCK, np.arange(blocks)
    stop = where + lengths
    starts = []
    while len(alive):  # every block takes one word at a time
        starts.append(where[alive])
        owners.append(alive)
        where[alive] += COUNTS[best[where[alive]]]
        alive = alive[where[alive] < stop[alive]]
    if starts:
        first, owner = np.concatenate(starts), np.concatenate(owners)
        order = np.argsort(first, kind="stable")
        first, owner = first[order], owner[order]
        chosen = best[first].astype(np.int64)
        words = chosen.astype(np.uint64)
        padded = np.concatenate([grid, np.zeros(240, np.uint64)])
        for s in range(2, 16):
            mine = np.flatnonzero(chosen == s)
            if len(mine):
                k = np.arange(COUNTS[s])
                index = first[mine][:, None] + k
                value = np.where(index < stop[owner[mine]][:, None], padded[index], np.uint64(0))
                words[mine] |= np.bitwise_or.reduce(value << (np.uint64(4) + (k * WIDTHS[s]).astype(np.uint64)), axis=1)
        offsets = np.searchsorted(owner, np.arange(blocks + 1))
    else:
        words, offsets = np.zeros(0, np.uint64), np.zeros(1, np.int64)
    header = np.array([MAGIC, n, blocks, len(escapes)], "<u4")
    return header.tobytes() + offsets.astype("<u4").tobytes() + np.asarray(words).astype("<u8").tobytes() + escapes.astype("<u8").tobytes()


def decode_chunk(data: bytes, first_block: int = 0, last_block: int | None = None) -> np.ndarray:
    """The ids of a chunk, or of its blocks from first_block up to last_block."""
    magic, n, blocks, n_escapes = np.frombuffer(data, "<u4", 4)
    if magic != MAGIC:
        raise ValueError("not a chunk of this format")
    n, blocks = int(n), int(blocks)
    offsets = np.frombuffer(data, "<u4", blocks + 1, 16).astype(np.int64)
    every = np.frombuffer(data, "<u8", int(offsets[-1]), 16 + 4 * (blocks + 1))
    last_block = blocks if last_block is None else min(last_block, blocks)
    words = every[offsets[first_block] : offsets[last_block]]
    if not len(words):
        return np.zeros(0, np.uint64)
    chosen = (words & np.uint64(15)).astype(np.int64)
    owner = np.repeat(np.arange(first_block, last_block), np.diff(offsets[first_block : last_block + 1]))
    taken = COUNTS[chosen]
    before = np.cumsum(taken) - taken
    block_start = before[offsets[first_block:last_block] - offsets[first_block]]
    first = before - block_start[owner - first_block] + owner * BLOCK
    stop = np.minimum((owner + 1) * BLOCK, n)
    base = first_block * BLOCK
    out = np.zeros(min(last_block * BLOCK, n) - base + 240, np.uint64)
    for s in range(2, 16):
        mine = np.flatnonzero(chosen == s)
        if len(mine):
            k = np.arange(COUNTS[s])
            index = first[mine][:, None] + k
            value = (words[mine][:, None] >> (np.uint64(4) + (k * WIDTHS[s]).astype(np.uint64))) & np.uint64((1 << int(WIDTHS[s])) - 1)
            inside = index < stop[mine][:, None]
            out[index[inside] - base] = value[inside]
    out = out[:-240]
    if n_escapes:
        escapes = np.frombuffer(data, "<u8", int(n_escapes), 16 + 4 * (blocks + 1) + 8 * int(offsets[-1]))
        held = np.flatnonzero(out == ESCAPE)
        skipped = 0 if not first_block else int((decode_chunk_raw(data, first_block) == ESCAPE).sum())
        out[held] = escapes[skipped : skipped + len(held)]
    return out


def decode_chunk_raw(data: bytes, blocks: int) -> np.ndarray:
    """The ids of the first blocks with escapes left as they are stored."""
    head = np.frombuffer(data, "<u4", 4).copy()
    head[3] = 0
    return decode_chunk(head.tobytes() + data[16:], 0, blocks)


#: A space before white space.
SPACE_RUN = re.compile(r" \s")
#: Latin letters, and words of them with at most one sign after them: a pre-token each.
LETTERS = re.compile("[A-Za-zÀ-ÖØ-öø-ɏ]+")
SIGNS = ".,;:!?"
PLAIN = f"^{LETTERS.pattern}[{SIGNS}]?$"


class CachedEncoder:
    """Ids of texts as little-endian 32-bit integers, word by word.

    The tokenizer merges bytes inside pre-tokens only, and a pre-token doesn't span a space unless white
    space follows. Texts are cut at their spaces by Arrow, and each distinct word of a slice of texts is looked up once; the
    ids of all its words are gathered in arrays. Letters with a sign after them are two pre-tokens, of which the letters are
    looked up. Words that are new, each with the space before it, are given to the library a
    thousand in one text, whose ids are cut where a token begins with a space; for words of letters, which are one pre-token
    each, the library cuts at spaces alone. Texts with a space between white space on both sides are encoded whole.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.model._resize_cache(0)  # what repeats is cached here
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=True)
        self.spaced = np.zeros(max(vocabulary.values()) + 1, bool)
        self.spaced[[i for t, i in vocabulary.items() if t.startswith("Ġ")]] = True
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.words: dict[str, bytes] = {}
        self.former: dict[str, bytes] = {}
        self.lettered, self.sign_ids = None, np.zeros(128, "<u4")
        kind = json.loads(self.tokenizer.to_str())
        cuts, signs = kind["pre_tokenizer"] or {}, self.whole(list(SIGNS))
        if cuts.get("type") == "ByteLevel" and cuts.get("use_regex", True) and not kind["normalizer"] and all(len(ids) == 4 for ids in signs):
            self.lettered = Tokenizer.from_file(path)
            self.lettered.model._resize_cache(0)
            self.lettered.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.CharDelimiterSplit(" "), pre_tokenizers.ByteLevel(add_prefix_space=True, use_regex=False)])
            self.sign_ids[[ord(c) for c in SIGNS]] = np.frombuffer(b"".join(signs), "<u4")

    def whole(self, texts: list[str]) -> list[bytes]:
        """Ids of texts by the library, a thousand at a time."""
        return [np.array(e.ids, "<u4").tobytes() for at in range(0, len(texts), 1000) for e in self.tokenizer.encode_batch_fast(texts[at : at + 1000], add_special_tokens=False)]

    def learn(self, words: list[str]) -> list[bytes]:
        """Ids of words, each with a space before it."""
        out: dict[str, bytes] = {}
        lettered = [w for w in words if LETTERS.fullmatch(w)] if self.lettered else []
        among = set(lettered)
        together = [w for w in words if w and w not in among and not w[0].isspace()]  # no space of theirs has white space after it
        for tokenizer, first, given in ((self.lettered, "", lettered), (self.tokenizer, " ", together)):
            for at in range(0, len(given), 1000):
                some = given[at : at + 1000]
                text = first + " ".join(some)
                if any(t in text for t in self.special):
                    continue
                ids = np.array(tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, "<u4")
                starts = np.flatnonzero(self.spaced[ids])
                if len(starts) == len(some):  # cut as expected
                    raw, ends = ids.tobytes(), (4 * starts).tolist()
                    out.update(zip(some, map(raw.__getitem__, map(slice, ends, [*ends[1:], len(raw)])), strict=True))
        rest = [w for w in words if w not in out]
        out.update(zip(rest, self.whole([" " + w for w in rest]), strict=True))
        return [out[w] for w in words]

    def look_up(self, words: list[str]) -> list[bytes]:
        """Ids of distinct words with a space before them. The cache is two dictionaries, of which the former is dropped when the
        other is full: words that are met again meanwhile stay."""
        if len(self.words) > CACHE_WORDS // 2:
            self.former, self.words = self.words, {}
        found = list(map(self.words.get, words))
        missing = [i for i, ids in enumerate(found) if ids is None]
        new = []
        for i in missing:
            found[i] = self.former.get(words[i])
            if found[i] is None:
                new.append(i)
        for i, ids in zip(new, self.learn([words[i] for i in new]), strict=True):
            found[i] = ids
        self.words.update((words[i], found[i]) for i in missing if len(words[i]) <= LONGEST)
        return found

    def spaced_words(self, words) -> tuple[np.ndarray, np.ndarray]:
        """(ids, numbers of ids) of an Arrow array of distinct words with a space before them."""
        import pyarrow.compute as pc

        if not self.lettered:
            return _pooled(self.look_up(words.to_pylist()))
        stems = pc.if_else(pc.match_substring_regex(words, PLAIN), pc.utf8_rtrim(words, SIGNS), words)
        signed = pc.binary_length(words).to_numpy() > pc.binary_length(stems).to_numpy()
        coded = stems.dictionary_encode()
        pool, sizes = _pooled(self.look_up(coded.dictionary.to_pylist()))
        codes = coded.indices.to_numpy()
        out, ends = _gathered(np.append(pool, np.uint32(0)), sizes, codes, signed)  # a place more for the sign
        last = np.frombuffer(words.buffers()[2] or b"", np.uint8)[np.frombuffer(words.buffers()[1], np.int64)[words.offset + 1 : words.offset + 1 + len(words)][signed] - 1]
        out[ends[signed] - 1] = self.sign_ids[last]
        return out, sizes[codes] + signed

    def encode(self, texts: list[str]) -> list[bytes]:
        import pyarrow as pa
        import pyarrow.compute as pc

        if not texts:
            return []
        alone = [i for i, text in enumerate(texts) if any(t in text for t in self.special) or SPACE_RUN.search(text) and _unsafe(text)]
        plain = list(texts)
        for i in alone:
            plain[i] = ""
        cut = pc.split_pattern(pa.array(plain, pa.large_string()), " ")
        bounds = cut.offsets.to_numpy()
        words, heads = cut.flatten(), bounds[:-1]
        later = np.ones(len(words), bool)
        later[heads] = False  # a text's first word has no space before it
        coded = words.filter(pa.array(later)).dictionary_encode()
        codes = np.empty(len(words), np.int64)
        codes[later] = coded.indices.to_numpy()
        codes[heads] = len(coded.dictionary) + np.arange(len(texts))
        (pool, sizes), (firsts, first_sizes) = self.spaced_words(coded.dictionary), _pooled(self.whole(words.take(pa.array(heads)).to_pylist()))
        ids, ends = _gathered(np.concatenate([pool, firsts]), np.concatenate([sizes, first_sizes]), codes)
        raw, stops = ids.tobytes(), [0, *(4 * ends[bounds[1:] - 1]).tolist()]
        out = [raw[s:e] for s, e in zip(stops, stops[1:], strict=False)]
        for i, ids in zip(alone, self.whole([texts[i] for i in alone]), strict=True):
            out[i] = ids
        return out


def _pooled(ids: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """All ids in a row, and the number of each."""
    return np.frombuffer(b"".join(ids), "<u4"), np.fromiter(map(len, ids), np.int64, len(ids)) // 4


def _gathered(pool: np.ndarray, sizes: np.ndarray, codes: np.ndarray, more: np.ndarray | int = 0) -> tuple[np.ndarray, np.ndarray]:
    """The ids of the codes in a row, with so many places more after each, and where each ends."""
    counts = sizes[codes] + more
    ends = np.cumsum(counts)
    at = np.repeat((np.cumsum(sizes) - sizes)[codes] - ends + counts, counts)
    at += np.arange(len(at))
    return pool[at], ends


def _unsafe(text: str) -> bool:
    """A space that has white space on both sides."""
    at = text.find(" ", 1)
    while 0 <= at < len(text) - 1:
        if text[at - 1].isspace() and text[at + 1].isspace():
            return True
        at = text.find(" ", at + 1)
    return False


_encoders: dict[str, CachedEncoder] = {}


def encoder_at(path: str) -> CachedEncoder:
    """This worker's encoder for a tokenizer file: kept, with its cache, for the worker's next tasks."""
    if path not in _encoders:
        _encoders[path] = CachedEncoder(path)
    return _encoders[path]


CHUNK_SCHEMA = "part int, chunk int, base bigint, doc_ids array<bigint>, lengths array<bigint>, payload binary"


def write_token_files(docs: DataFrame, path: str, tokenizer_path: str, end_id: int = END_ID, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Write every text's ids and the end id as chunks, in ascending order of the id column."""
    import pyarrow as pa

    def encode(batches: Iterator) -> Iterator:
        encoder = encoder_at(tokenizer_path)
        end = np.array([end_id], "<u4").tobytes()
        held: list[tuple[int | None, bytes]] = []
        size = base = number = 0
        part = 0

        def chunk():
            nonlocal held, size, base, number
            ids = np.frombuffer(b"".join(h[1] for h in held), "<u4")
            row = {"part": [part], "chunk": [number], "base": [base], "doc_ids": [[h[0] for h in held]], "lengths": [[len(h[1]) // 4 for h in held]], "payload": [encode_chunk(ids)]}
            kinds = (pa.int32(), pa.int32(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.binary())
            base, number, held, size = base + len(ids), number + 1, [], 0
            return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(row.values(), kinds, strict=True)], names=list(row))

        for batch in batches:
            for some in slices(batch, 1, ROWS):
                names, texts, parts = (some.column(k) for k in range(3))
                part = parts[0].as_py()
                for name, ids in zip(names.to_pylist(), encoder.encode([t or "" for t in texts.to_pylist()]), strict=True):
                    held.append((name, ids + end))
                    size += len(ids) // 4 + 1
                    if size >= CHUNK_IDS:
                        yield chunk()
        if held:
            yield chunk()

    n = session_partitions(docs.sparkSession)
    flat = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    # the text's hash spreads the rows of one id (null, say) over tasks
    order = [F.col("doc_id").asc_nulls_first(), F.xxhash64("text").asc()]
    placed = flat.repartitionByRange(n, *order).sortWithinPartitions(*order).withColumn("part", F.spark_partition_id())
    placed.mapInArrow(encode, CHUNK_SCHEMA).write.parquet(path)


def read_token_files(spark, path: str, keep_ids: bool = False) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 (and ids) of every document in the files at path."""
    import pyarrow as pa

    def decode(batches: Iterator) -> Iterator:
        for batch in batches:
            for row in (batch.slice(i, 1).to_pylist()[0] for i in range(batch.num_rows)):  # one payload at a time
                ids = decode_chunk(row["payload"]).astype("<u4")
                stops = np.cumsum(row["lengths"])
                each = np.split(ids, stops[:-1])
                columns = [
                    pa.array([row["part"]] * len(each), pa.int32()), pa.array(row["doc_ids"], pa.int64()), pa.array(row["base"] + stops - row["lengths"], pa.int64()),
                    pa.array(row["lengths"], pa.int64()), pa.array([zlib.crc32(x.tobytes()) for x in each], pa.int64()),
                ]
                names = ["part", "doc_id", "at", "n_tokens", "ids_crc32"]
                if keep_ids:
                    columns.append(pa.array([x.astype(np.int64) for x in each], pa.list_(pa.int64())))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(columns, names=names)

    schema = "part int, doc_id bigint, at bigint, n_tokens bigint, ids_crc32 bigint" + ", ids array<bigint>" * keep_ids
    chunks = spark.read.schema(CHUNK_SCHEMA).parquet(path)
    totals = {r[0]: r[1] for r in chunks.groupBy("part").agg(F.max(F.col("base") + F.aggregate("lengths", F.lit(0).cast("bigint"), lambda a, x: a + x))).collect()}  # a row for each file
    before, b = {}, 0
    for p in sorted(totals):
        before[p], b = b, b + totals[p]
    offsets = spark.createDataFrame(list(before.items()), "part int, part_start bigint")
    docs = chunks.mapInArrow(decode, schema).join(F.broadcast(offsets), "part")
    return docs.select("doc_id", (F.col("part_start") + F.col("at")).alias("start"), "n_tokens", "ids_crc32", *["ids"] * keep_ids)


def op4_token_output(spark, sf_dir: str) -> DataFrame:
    """Every document's place in the token files, from the files."""
    import public_tokenizers

    path = shared_path(spark, "tokens")
    write_token_files(table(spark, sf_dir, "documents"), path, public_tokenizers.path("byte_bpe_50k.json"))
    return read_token_files(spark, path)


QUERIES = {"op4_token_output": op4_token_output}
SQL: dict[str, str] = {}
