"""Near-duplicate classes by Order MinHash, verified by banded alignment.

Every distinct text is a sequence of five-word shingles, each labelled with its occurrence number. For each
of ``BANDS`` seeds the ``ORDER`` smallest labelled shingles are taken and put back into text order; the hash
of that short sequence is the band's key, so two texts share a key if they share the smallest shingles and
their order - edits far apart in the text leave most keys, a reordering changes them.

Candidates don't come from all pairs of a bucket. Copies of one text are one node. A node's weight is the
number of nodes it shares buckets with, and a bucket's centre is its heaviest member: the least edited text of
a family tends to be the centre of most of its buckets. Every node is first compared with its heaviest centre,
then with those of its other buckets that aren't in the same star already. What is linked so far forms classes. The
members of buckets that hold several classes then meet by exact prefix filtering: their labelled shingles are ranked by
how many of these texts hold them, rarest first, and two texts that reach the similarity share a shingle among the first
n - ceil(2s / (1 + s) n) + 1 of the shorter and n - ceil(s n) + 1 of the longer. Texts of different classes that share one,
with lengths and places that still allow the similarity, are aligned; so edits of one text that stay under the similarity
don't meet, however many there are. Nothing is capped. Pairs are verified by aligning the labelled shingles: the longest
common subsequence inside the diagonal band that a similarity of 0.8 leaves. The similarity is common / (a + b - common).
A text that many are compared with is sent once for many of them. Connected texts form a class, named by its least document id.

Defined cases: a null text is the empty text; texts of fewer than five words are one shingle, texts without
a word only have exact copies; null ids are members like others, a class of null ids alone has a null class;
repeated rows are repeated; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, small_batches, table
from .text_arrays import buffers, mix, release, slices, word_hashes

SHINGLE = 5
SIMILARITY = 0.8
BANDS = 24
ORDER = 4
#: Labelled shingles times seeds in memory at once.
CELLS = 1_000_000
#: Rows of a batch that are Python objects at once.
SLICE = 64
#: Pairs for which a text is sent once, on average, where it is compared with very many.
BLOCK = 256
#: Keys of several nodes (16 bytes and a hash entry each) up to which they are broadcast.
BROADCAST_KEYS = 500_000
#: Nodes (16 bytes and a hash entry each) up to which a candidate set is broadcast.
BROADCAST_NODES = 200_000


def shingles(words: np.ndarray, size: int = SHINGLE) -> np.ndarray:
    """Hashes of the occurrence-labelled shingles of one text, in order."""
    if not len(words):
        return np.zeros(0, np.uint64)
    k = min(size, len(words))
    rows = np.lib.stride_tricks.sliding_window_view(words, k)
    h = np.zeros(len(rows), np.uint64)
    for i in range(k):
        h = mix(h + rows[:, i], i + 1)
    order = np.argsort(h, kind="stable")
    ranked = h[order]
    fresh = np.concatenate([[True], ranked[1:] != ranked[:-1]])
    at = np.arange(len(h))
    times = np.empty(len(h), np.uint64)
    times[order] = (at - np.maximum.accumulate(np.where(fresh, at, 0))).astype(np.uint64)
    return mix(h + times * np.uint64(0xD6E8FEB86659FD93), 99)


def sketch(labelled: np.ndarray, bands: int = BANDS, order: int = ORDER) -> np.ndarray:
    """The band keys of one text."""
    n = len(labelled)
    if not n:
        return np.zeros(0, np.int64)
    take = min(order, n)
    keys = np.empty(bands, np.uint64)
    seeds = mix(np.arange(bands, dtype=np.uint64), 7) | np.uint64(1)
    step = max(1, CELLS // n)
    for b in range(0, bands, step):
        some = seeds[b : b + step, None]
        ranks = labelled[None, :] * some
        ranks ^= ranks >> np.uint64(29)
        ranks *= np.uint64(0xBF58476D1CE4E5B9)
        ranks ^= ranks >> np.uint64(32)
        least = np.sort(np.argpartition(ranks, take - 1, axis=1)[:, :take], axis=1) if take < n else np.broadcast_to(np.arange(n), (len(some), n))
        h = np.full(len(some), take, np.uint64)
        for i in range(take):
            h = mix(h + labelled[least[:, i]], i)
        keys[b : b + step] = mix(h + np.arange(b, b + len(some)).astype(np.uint64), 5)
    return keys.view(np.int64)


def longest_increasing(values: np.ndarray) -> int:
    """Length of the longest strictly increasing subsequence."""
    if len(values) < 2 or (np.diff(values) > 0).all():
        return len(values)
    from bisect import bisect_left

    tails: list[int] = []
    for v in values.tolist():
        i = bisect_left(tails, v)
        if i == len(tails):
            tails.append(v)
        else:
            tails[i] = v
    return len(tails)


def aligned_similarity(a: np.ndarray, b: np.ndarray, least: float = SIMILARITY) -> float:
    """Similarity of two texts' labelled shingles under the best in-order alignment, or 0 if it is under least.

    Labelled shingles are unique in each text, so the longest common subsequence is the longest increasing
    run of matched positions. An alignment of that similarity leaves at most (a + b)(1 - s)/(1 + s) shingles
    unmatched and can't leave the diagonal by more: matches outside the band are not looked at.
    """
    if not len(a) or not len(b):
        return 0.0
    total = len(a) + len(b)
    if min(len(a), len(b)) < least * max(len(a), len(b)):
        return 0.0
    _, at_a, at_b = np.intersect1d(a, b, assume_unique=True, return_indices=True)
    need = least * total / (1 + least)
    if len(at_a) < need - 1e-9:
        return 0.0
    band = total - 2 * need + 1
    inside = np.abs(at_a - at_b) <= band
    at_a, at_b = at_a[inside], at_b[inside]
    common = longest_increasing(at_b[np.argsort(at_a)])
    found = common / (total - common)
    return found if found >= least - 1e-12 else 0.0


def _named(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    return docs.select(F.col(id_col).alias("doc_id"), F.unhex(F.md5(text)).alias("node"), text.alias("text"))


def sketches(named: DataFrame, bands: int = BANDS, order: int = ORDER) -> DataFrame:
    """(node, keys) of every distinct text."""
    import pyarrow as pa

    def run(batches: Iterator) -> Iterator:
        for batch in batches:
            for at in range(0, batch.num_rows, SLICE):  # texts become Python objects a slice at a time
                some = batch.slice(at, SLICE)
                keys: list[np.ndarray] = []
                for _, encoded in buffers(some.column(1).to_pylist()):
                    words, offsets = word_hashes(encoded)
                    keys += [sketch(shingles(words[offsets[i] : offsets[i + 1]]), bands, order) for i in range(len(encoded))]
                yield pa.RecordBatch.from_arrays([some.column(0), pa.array(keys, pa.list_(pa.int64()))], names=["node", "keys"])
        release()

    # copies have equal sketches: partial aggregation leaves one for each task
    return named.select("node", "text").mapInArrow(run, "node binary, keys array<bigint>").groupBy("node").agg(F.first("keys").alias("keys"))


def _pairs(rows: DataFrame) -> DataFrame:
    """Each pair once, with the node of more pairs in its place as the centre."""
    one = rows.select("node", "centre", F.least("node", "centre").alias("a"), F.greatest("node", "centre").alias("b"))
    return one.groupBy("a", "b").agg(F.min(F.struct("node", "centre")).alias("p")).select("p.node", "p.centre")


def labelled_shingles(texts: list) -> list[np.ndarray]:
    """The labelled shingles of each text."""
    out: list[np.ndarray] = []
    for _, encoded in buffers(texts):
        words, offsets = word_hashes(encoded)
        out += [shingles(words[offsets[i] : offsets[i + 1]]) for i in range(len(encoded))]
    return out


def verify(pairs: DataFrame, texts: DataFrame, least: float = SIMILARITY) -> DataFrame:
    """(a, b, linked) of pairs (node, centre), a < b. texts: (node, text) of at least their nodes, each once.

    A centre's pairs are dealt into blocks by their nodes, as many as all pairs are BLOCKs; in a sorted partition each
    block is the centre's text and then those of its nodes.
    """
    import pyarrow as pa

    blocks = max(1, -(-pairs.count() // BLOCK))
    dealt = pairs.select("node", "centre", F.pmod(F.xxhash64("node"), F.lit(blocks)).alias("block"))
    members = dealt.join(texts, "node").select("centre", "block", "node", "text")
    centres = dealt.select("centre", "block").distinct().join(texts.withColumnRenamed("node", "centre"), "centre").select("centre", "block", F.lit(None).cast("binary").alias("node"), "text")
    rows = members.unionByName(centres).repartition("centre", "block").sortWithinPartitions("centre", "block", F.col("node").asc_nulls_first())

    def run(batches: Iterator) -> Iterator:
        own = np.zeros(0, np.uint64)
        for batch in batches:
            for some in slices(batch, 3, SLICE):
                centre, node = some.column(0).to_pylist(), some.column(2).to_pylist()
                a, b, linked = [], [], []
                for x, y, found in zip(centre, node, labelled_shingles(some.column(3).to_pylist()), strict=True):
                    if y is None:  # the block's centre comes first
                        own = found
                        continue
                    a.append(min(x, y))
                    b.append(max(x, y))
                    linked.append(aligned_similarity(own, found, least) > 0)
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.binary()), pa.array(b, pa.binary()), pa.array(linked, pa.bool_())], names=["a", "b", "linked"])
        release()

    return rows.mapInArrow(run, "a binary, b binary, linked boolean")


def shared_keys(members: DataFrame) -> DataFrame:
    """(key, node, n): members of buckets of n > 1 nodes. members: (key, node)."""
    counts = cut(members.groupBy("key").agg(F.count("*").alias("n")).where("n > 1"))
    return cut(members.join(F.broadcast(counts) if counts.count() <= BROADCAST_KEYS else counts, "key"))


def stars(shared: DataFrame) -> DataFrame:
    """(node, centre, heavy): members of buckets with their buckets' centres, each pair once. shared: (key, node, n); heavy is the centre's weight."""
    weighed = shared.join(shared.groupBy("node").agg(F.sum("n").alias("weight")), "node").select("key", "node", "weight")
    centres = weighed.groupBy("key").agg(F.max(F.struct("weight", "node")).alias("c"))
    joined = weighed.join(centres.select("key", F.col("c.node").alias("centre"), F.col("c.weight").alias("heavy")), "key").where("node <> centre")
    return joined.groupBy("node", "centre").agg(F.max("heavy").alias("heavy"))


def _ordered(rows: DataFrame) -> DataFrame:
    return rows.withColumn("a", F.least("node", "centre")).withColumn("b", F.greatest("node", "centre"))


def _not_done(pairs: DataFrame, done: DataFrame) -> DataFrame:
    return _ordered(pairs).join(done.select("a", "b"), ["a", "b"], "left_anti").select("node", "centre")


def _other_stars(rows: DataFrame, star: DataFrame) -> DataFrame:
    """The (node, centre) rows that aren't in one star. star: (node, star), for linked nodes."""
    of_node, of_centre = star.select("node", F.col("star").alias("s1")), star.select(F.col("node").alias("centre"), F.col("star").alias("s2"))
    joined = rows.join(of_node, "node", "left").join(of_centre, "centre", "left")
    return joined.where(F.coalesce("s1", "node") != F.coalesce("s2", "centre")).select("node", "centre")


def shingle_lists(texts: DataFrame) -> DataFrame:
    """(node, n, tokens): the labelled shingles of each text; they are distinct."""
    import pyarrow as pa

    def run(batches: Iterator) -> Iterator:
        for batch in batches:
            for some in slices(batch, 1, SLICE):
                found = [x.view(np.int64) for x in labelled_shingles(some.column(1).to_pylist())]
                yield pa.RecordBatch.from_arrays([some.column(0), pa.array([len(x) for x in found], pa.int64()), pa.array(found, pa.list_(pa.int64()))], names=["node", "n", "tokens"])
        release()

    return texts.select("node", "text").mapInArrow(run, "node binary, n bigint, tokens array<bigint>")


def prefixes(lists: DataFrame, least: float = SIMILARITY) -> DataFrame:
    """(token, node, n, at, first): the shingles by which texts can meet, with their places in the order of rarity; first where
    they are among those of the shorter text of a pair. lists: (node, n, tokens). Shingles of one text only take their
    places at the front and are no rows."""
    flat = lists.select("node", "n", F.explode("tokens").alias("token"))
    common = flat.groupBy("token").agg(F.count("*").alias("df")).where("df > 1")
    own = Window.partitionBy("node")
    ranked = flat.join(common, "token").withColumn("k", F.row_number().over(own.orderBy("df", "token"))).withColumn("m", F.count("*").over(own))
    placed = ranked.withColumn("at", F.col("n") - F.col("m") + F.col("k"))
    reach = lambda share: F.col("n") - F.ceil(F.col("n") * share - 1e-9) + 1
    return placed.where(F.col("at") <= reach(least)).select("token", "node", "n", "at", (F.col("at") <= reach(2 * least / (1 + least))).alias("first"))


def remaining_pairs(shared: DataFrame, roots: DataFrame, texts: DataFrame, least: float = SIMILARITY) -> DataFrame:
    """(node, centre), each pair once: nodes of buckets with several classes that aren't in one class and can have that similarity.

    shared: (key, node, n); roots: (node, root) of linked nodes.
    """
    placed = cut(shared.join(roots, "node", "left").select("key", "node", "n", F.coalesce("root", "node").alias("root")))
    # in a bucket of two both were compared: one is the centre
    several = placed.where("n > 2").groupBy("key").agg(F.min("root").alias("one"), F.max("root").alias("other")).where("one <> other").select("key")
    mixed = cut(placed.join(several, "key", "left_semi").select("node", "root").distinct())
    lists = cut(shingle_lists(texts.join(mixed.select("node"), "node", "left_semi")))
    found = cut(prefixes(lists, least).join(mixed, "node"))
    side = lambda p: [F.col(c).alias(f"{p}_{c}") for c in ("node", "root", "n", "at")]
    met = found.where("first").select("token", *side("x")).join(found.select("token", *side("y")), "token")
    n_x, n_y = F.col("x_n"), F.col("y_n")
    shorter = (n_x < n_y) | ((n_x == n_y) & (F.col("x_node") < F.col("y_node")))
    left = F.least(n_x - F.col("x_at"), n_y - F.col("y_at")) + 1  # of the first shingle they share, no more can be common
    able = (n_x >= least * n_y - 1e-9) & (left >= least * (n_x + n_y) / (1 + least) - 1e-9)
    return met.where(shorter & able & (F.col("x_root") != F.col("y_root"))).select(F.col("x_node").alias("node"), F.col("y_node").alias("centre")).distinct()


def candidate_links(keys: DataFrame, named: DataFrame, least: float = SIMILARITY) -> tuple[DataFrame, DataFrame]:
    """((a, b) of verified pairs of nodes, (node, root) of linked nodes). keys: (node, keys)."""
    shared = shared_keys(keys.select("node", F.explode("keys").alias("key")))
    rows = cut(stars(shared))
    nodes = cut(rows.select("node").union(rows.select(F.col("centre").alias("node"))).distinct())
    wanted = F.broadcast(nodes) if nodes.count() <= BROADCAST_NODES else nodes
    texts = cut(named.select("node", "text").join(wanted, "node", "left_semi").dropDuplicates(["node"]))
    # each node with its heaviest centre
    best = cut(rows.groupBy("node").agg(F.max(F.struct("heavy", "centre")).alias("c")).select("node", "c.centre"))
    checked = cut(verify(cut(_pairs(best)), texts, least))
    star = cut(_ordered(best).join(checked.where("linked").select("a", "b"), ["a", "b"]).select("node", F.col("centre").alias("star")))
    # with the centres of its other buckets, unless both are in one star
    others = cut(_other_stars(rows, star))
    done = checked.union(cut(verify(cut(_not_done(_pairs(others), checked)), texts, least)))
    links = done.where("linked").select("a", "b")
    # all others that share a bucket, unless both are in one class
    roots = cut(components(links))
    pairs = cut(_not_done(remaining_pairs(shared, roots, texts, least), done))
    found = cut(verify(pairs, texts, least).where("linked").select("a", "b"))
    if found.isEmpty():
        return links, roots
    return links.union(found), components(found.union(roots.select(F.col("node").alias("a"), F.col("root").alias("b"))))


def components(links: DataFrame) -> DataFrame:
    """(node, root): the least node that each linked node is connected to. Alternates large-star and small-star steps until nothing changes."""
    def state(e: DataFrame) -> tuple:
        return tuple(e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())

    edges = cut(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct())
    before = state(edges)
    while True:
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").where("v <> m").select(F.greatest("v", "m").alias("u"), F.least("v", "m").alias("v"))
        edges = cut(small.union(least.select("u", F.col("m").alias("v"))).distinct())
        after = state(edges)
        if after == before:
            break
        before = after
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).union(edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())


def _classified(named: DataFrame, least: float, bands: int, order: int) -> tuple[DataFrame, DataFrame]:
    """((node, first_id, root) of every distinct text, (a, b) of verified pairs). first_id is the text's least id."""
    with small_batches(named.sparkSession):  # all that reads texts runs here
        links, roots = candidate_links(cut(sketches(named, bands, order)), named, least)
    texts = named.groupBy("node").agg(F.min("doc_id").alias("first_id")).join(roots, "node", "left")
    return texts.withColumn("root", F.coalesce("root", "node")), links


def near_duplicate_classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: float = SIMILARITY, bands: int = BANDS, order: int = ORDER) -> DataFrame:
    """doc_id, class_id (the least id of its class), n_links (other texts that the text was verified with directly)."""
    named = _named(docs, id_col, text_col)
    texts, links = _classified(named, least, bands, order)
    degree = links.select(F.col("a").alias("node")).union(links.select(F.col("b").alias("node"))).groupBy("node").agg(F.count("*").alias("n_links"))
    classes = texts.groupBy("root").agg(F.min("first_id").alias("class_id"))
    by_text = texts.join(classes, "root").join(degree, "node", "left").select("node", "class_id", F.coalesce("n_links", F.lit(0)).alias("n_links"))
    return named.select("doc_id", "node").join(by_text, "node").select("doc_id", "class_id", "n_links")


def keep_one(docs: DataFrame) -> DataFrame:
    """One row of every class, with all its columns: of the least id that isn't null, then the least text hash. Of repeated rows one stays."""
    def key(node: Column, ident: Column) -> Column:
        return F.unhex(F.md5(F.concat(node, F.coalesce(ident.cast("string"), F.lit("null")).cast("binary"))))

    texts, _ = _classified(_named(docs, "doc_id", "text"), SIMILARITY, BANDS, ORDER)
    chosen = texts.groupBy("root").agg(F.min(F.struct(F.col("first_id").isNull().alias("none"), "first_id", "node")).alias("c"))
    kept = chosen.select(key(F.col("c.node"), F.col("c.first_id")).alias("\x00kept"))
    node = F.unhex(F.md5(F.coalesce(F.col("text").cast("string"), F.lit(""))))
    return docs.withColumn("\x00kept", key(node, F.col("doc_id"))).join(kept, "\x00kept", "left_semi").dropDuplicates(["\x00kept"]).drop("\x00kept")


def op8_minhash_near_dedup(spark, sf_dir: str) -> DataFrame:
    """Every document's near-duplicate class."""
    return near_duplicate_classes(table(spark, sf_dir, "documents"))


QUERIES = {"op8_minhash_near_dedup": op8_minhash_near_dedup}
SQL: dict[str, str] = {}
