"""Hard negatives of anchors by bit-sliced integer products.

Components are integers, and a candidate is cut into bit-planes in two's complement: the sign plane, then one plane of
zeros and ones for each power of two. An inner product with an anchor is the sum of the planes' products, and planes are
taken most significant first. What is left after some planes lies between bounds that need no further product: the low
planes' values are centred, so their product with the anchor is a known middle plus or minus the lesser of two radii, the
anchor's sum of magnitudes times half the largest rest and the product of the two norms. So every pair has an interval of
scores that each plane tightens. A pair is dropped once its interval misses all ranges asked for, or lies below as many
scores as are asked for that surely lie in the range. The last plane leaves exact scores.

Anchors and rows are dealt into blocks by a hash of their ids, and every pair of blocks is one task's group: first the
best rows of the same label (the positives), then, with each positive's range of scores known, the best rows of other
labels in it. A block returns as many rows for an anchor and a positive as are asked for, and the best of these are taken
by a window over pairs of ids. No row meets more than one block of anchors at a time, and no label is a group of its own.

Defined cases: rows with a null id, label or vector, with a null or non-finite component or with one of LARGEST or more
after scaling take no part; vectors of unequal lengths are filled with zeros, an empty vector scores 0; rows of one id
are one row, the least by label and components; ties go to the smaller id; anchors with fewer rows get all there are;
positives of a negative score have an empty range; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, table

#: Components are below this in magnitude, so that products of a hundred times 4,096 of them are 64-bit numbers.
LARGEST = 1 << 22
#: Rows and anchors of a block: a group holds so many pairs at most, but for the hash's unevenness.
ROWS = 1024
ANCHORS = 1024
#: Share of a block's pairs under which they are listed one by one.
SPARSE = 0.1
POSITIVES, NEGATIVES = 5, 3
#: A negative's score is between these percentages of the positive's.
LOW, HIGH = 50, 95
FAR = 2.0**60


def scaled(vectors: DataFrame, scale: int = 256) -> DataFrame:
    """(vec_id, label, v): rows that take part, with v = floor(scale * x). vectors: (vec_id, label, embedding)."""
    grown = F.transform("embedding", lambda x: x.cast("double") * scale)
    sound = F.forall(grown, lambda x: F.coalesce(F.abs(x) < LARGEST, F.lit(False)))  # NaN is more than any number
    kept = vectors.select("vec_id", "label", F.when(sound, F.transform(grown, lambda x: F.floor(x).try_cast("int"))).alias("v")).where("vec_id is not null and label is not null and v is not null")
    return kept.groupBy("vec_id").agg(F.min(F.struct("label", "v")).alias("r")).select("vec_id", "r.label", "r.v")


def _matrix(column, width: int) -> np.ndarray:
    """Rows of a list column, filled with zeros."""
    lists = column.combine_chunks() if hasattr(column, "combine_chunks") else column
    sizes = np.diff(lists.offsets.to_numpy())
    flat = lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
    out = np.zeros((len(sizes), width), np.int64)
    out[np.repeat(np.arange(len(sizes)), sizes), np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = flat
    return out


def qualifying(anchors: np.ndarray, rows: np.ndarray, allowed: np.ndarray, low: np.ndarray, high: np.ndarray, most: int, sparse: float = SPARSE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(anchor, row, score) of the allowed pairs that can be among the ``most`` best of one of their anchor's ranges.

    low, high: (anchors, ranges), inclusive; allowed: (anchors, rows). Of pairs outside all ranges none is returned.
    """
    bits = max(1, int(max(np.abs(rows).max(initial=0), 1)).bit_length())
    magnitude, norm = np.abs(anchors).sum(axis=1).astype(float), np.sqrt((anchors.astype(float) ** 2).sum(axis=1))
    total = anchors.sum(axis=1).astype(float)
    slack = 2 + 1e-13 * float(magnitude.max(initial=0)) * (1 << bits)  # for roundings of the bounds
    exact = np.float32 if magnitude.max(initial=0) < 1 << 24 else np.float64
    wide = anchors.T.astype(exact)
    floor, ceiling = low.min(axis=1), high.max(axis=1)
    held = rows & ((1 << bits) - 1)  # two's complement without the sign
    score = np.zeros(allowed.shape, np.int64)
    alive, a, r = allowed.copy(), None, None
    for plane in range(bits, -1, -1):
        weight = -(1 << bits) if plane == bits else 1 << plane
        slice_ = (rows < 0) if plane == bits else (held >> plane) & 1
        if a is None:
            score += (slice_.astype(exact) @ wide).T.astype(np.int64) * weight
        else:
            score += np.einsum("ij,ij->i", slice_[r].astype(np.int64), anchors[a]) * weight
        rest = (1 << min(plane, bits)) - 1  # the largest value of the planes to come
        centred = 2.0 * (held & rest) - rest
        spread = np.sqrt((centred**2).sum(axis=1)) / 2
        if a is None:
            radius = np.minimum(magnitude[:, None] * (rest / 2), norm[:, None] * spread[None, :]) + slack if rest else 0.0
            middle = score + (total * (rest / 2))[:, None]
            least, top = middle - radius, middle + radius
            alive &= (top >= floor[:, None]) & (least <= ceiling[:, None])
            if low.shape[1] == 1 and alive.shape[1] > most:
                sure = np.where(alive & (least >= low) & (top <= high), least, -np.inf)
                alive &= top >= np.partition(sure, sure.shape[1] - most, axis=1)[:, sure.shape[1] - most][:, None]
            if plane and alive.sum() > sparse * alive.size:
                continue
            a, r = np.nonzero(alive)
            score = score[a, r]
        radius = np.minimum(magnitude[a] * (rest / 2), norm[a] * spread[r]) + slack if rest else 0.0
        middle = score + total[a] * (rest / 2)
        keep = _possible(a, middle - radius, middle + radius, low, high, most)
        a, r, score = a[keep], r[keep], score[keep]
    return a, r, score


def _possible(a: np.ndarray, least: np.ndarray, top: np.ndarray, low: np.ndarray, high: np.ndarray, most: int) -> np.ndarray:
    """Which pairs of anchors a (ascending) may be among the most best scores of a range: (least, top) are their bounds."""
    keep = np.zeros(len(a), bool)
    for k in range(low.shape[1]):
        from_, to = low[:, k], high[:, k]
        sure = np.flatnonzero((least >= from_[a]) & (top <= to[a]))
        order = sure[np.lexsort((-least[sure], a[sure]))]
        first = np.searchsorted(a[order], np.arange(len(low)))
        place = first + most - 1
        there = (place < len(order)) & (place < np.append(first[1:], len(order)))
        bar = from_.astype(float).copy()
        bar[there] = np.maximum(bar[there], least[order[place[there]]])
        keep |= (top >= bar[a]) & (least <= to[a])
    return keep


def best_of(a: np.ndarray, ids: np.ndarray, score: np.ndarray, most: int) -> np.ndarray:
    """Indices of the most best pairs of each anchor: higher scores first, then smaller ids."""
    order = np.lexsort((ids, -score, a))
    ranked = a[order]
    fresh = np.concatenate([[True], ranked[1:] != ranked[:-1]]) if len(ranked) else np.zeros(0, bool)
    at = np.arange(len(ranked))
    return order[at - np.maximum.accumulate(np.where(fresh, at, 0)) < most]


def _blocks(rows: DataFrame, size: int, seed: int, name: str) -> tuple[DataFrame, int]:
    n = max(1, -(-rows.count() // size))
    return rows.withColumn(name, F.pmod(F.xxhash64(F.lit(seed), "vec_id"), F.lit(n)).cast("int")), n


def _every(n: int, name: str) -> Column:
    return F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias(name)


def mine(rows: DataFrame, anchors: DataFrame, positives: int = POSITIVES, negatives: int = NEGATIVES, low: int = LOW, high: int = HIGH, block: int = ROWS, anchor_block: int = ANCHORS) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score). rows and anchors: see scaled; anchors are rows too."""
    import pyarrow as pa

    rows, n_rows = _blocks(cut(rows), block, 3, "rb")
    anchors, n_anchors = _blocks(cut(anchors), anchor_block, 5, "ab")
    dealt = rows.select("vec_id", "label", "v", "rb", _every(n_anchors, "ab")).groupBy("ab", "rb")

    def sides(left: pa.Table, right: pa.Table) -> tuple:
        width = max([1, *(int(np.diff(t["v"].combine_chunks().offsets.to_numpy()).max(initial=0)) for t in (left, right) if t.num_rows)])
        return tuple((t["vec_id"].to_numpy(), t["label"].to_numpy(), _matrix(t["v"], width)) for t in (left, right))

    def nearest(left: pa.Table, right: pa.Table) -> pa.Table:
        found = []
        if left.num_rows and right.num_rows:
            (ids, labels, vectors), (others, kinds, bodies) = sides(left, right)
            for label in np.unique(labels):
                i, j = np.flatnonzero(labels == label), np.flatnonzero(kinds == label)
                if len(j):
                    open_ = np.full((len(i), 1), FAR)
                    a, r, s = qualifying(vectors[i], bodies[j], ids[i][:, None] != others[j][None, :], -open_, open_, positives)
                    at = best_of(a, others[j][r], s, positives)
                    found.append((ids[i][a[at]], others[j][r[at]], s[at]))
        parts = [np.concatenate([f[k] for f in found]) if found else np.zeros(0, np.int64) for k in range(3)]
        return pa.table(dict(zip(("anchor_id", "positive_id", "positive_score"), (pa.array(p, pa.int64()) for p in parts), strict=True)))

    asked = anchors.select("vec_id", "label", "v", "ab", _every(n_rows, "rb")).groupBy("ab", "rb")
    near = asked.cogroup(dealt).applyInArrow(nearest, "anchor_id bigint, positive_id bigint, positive_score bigint")
    best = _first(near, ["anchor_id"], "positive_score", "positive_id", positives)
    listed = best.groupBy(F.col("anchor_id").alias("vec_id")).agg(F.array_sort(F.collect_list(F.struct("_n", "positive_id", "positive_score"))).alias("p"))  # as many as asked for
    known = cut(anchors.join(listed, "vec_id").select("vec_id", "label", "v", "ab", F.transform("p", lambda x: x["positive_id"]).alias("pid"), F.transform("p", lambda x: x["positive_score"]).alias("ps")))

    def farther(left: pa.Table, right: pa.Table) -> pa.Table:
        found = []
        if left.num_rows and right.num_rows:
            (ids, labels, vectors), (others, kinds, bodies) = sides(left, right)
            sizes = np.diff(left["ps"].combine_chunks().offsets.to_numpy())
            score, name = _matrix(left["ps"], positives), _matrix(left["pid"], positives)
            there = np.arange(positives)[None, :] < sizes[:, None]
            from_ = np.where(there, -(-low * score // 100), FAR)
            to = np.where(there, high * score // 100, -FAR)
            a, r, s = qualifying(vectors, bodies, labels[:, None] != kinds[None, :], from_, to, negatives)
            for k in range(positives):
                inside = np.flatnonzero((s >= from_[a, k]) & (s <= to[a, k]))
                at = inside[best_of(a[inside], others[r[inside]], s[inside], negatives)]
                found.append((ids[a[at]], name[a[at], k], others[r[at]], score[a[at], k], s[at]))
        parts = [np.concatenate([f[k] for f in found]) if found else np.zeros(0, np.int64) for k in range(5)]
        return pa.table(dict(zip(("anchor_id", "positive_id", "negative_id", "positive_score", "negative_score"), (pa.array(p, pa.int64()) for p in parts), strict=True)))

    again = known.select("vec_id", "label", "v", "pid", "ps", "ab", _every(n_rows, "rb")).groupBy("ab", "rb")
    found = again.cogroup(dealt).applyInArrow(farther, "anchor_id bigint, positive_id bigint, negative_id bigint, positive_score bigint, negative_score bigint")
    ranked = _first(found, ["anchor_id", "positive_id"], "negative_score", "negative_id", negatives)
    return ranked.select("anchor_id", "positive_id", F.col("_n").alias("rank"), "negative_id", "positive_score", "negative_score")


def _first(rows: DataFrame, keys: list[str], score: str, ident: str, most: int) -> DataFrame:
    """The most best rows of each key, numbered from 1 as _n; tasks cut theirs before the exchange."""
    from pyspark.sql import Window

    order = Window.partitionBy(*keys).orderBy(F.desc(score), ident)
    return rows.withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= most)


def op13_hard_negatives(spark, sf_dir: str) -> DataFrame:
    """Three negatives for each of the five positives of every fiftieth vector, labels of every seventh moved on by one."""
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label")).alias("label"), "embedding")
    rows = cut(scaled(vectors))
    return mine(rows, rows.where("vec_id % 50 = 0"))


ORACLE_SQL = """
WITH e AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, [floor(256 * x::DOUBLE) FOR x IN embedding] AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT a.vec_id AS anchor_id, b.vec_id AS other_id, a.label = b.label AS same, list_inner_product(a.v, b.v)::BIGINT AS score
  FROM e a JOIN e b ON a.vec_id <> b.vec_id WHERE a.vec_id % 50 = 0
), p AS (
  SELECT anchor_id, other_id AS positive_id, score AS positive_score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other_id) <= 5
)
SELECT anchor_id, positive_id, row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, other_id)::INTEGER AS rank, other_id AS negative_id, positive_score, score AS negative_score
FROM p JOIN s USING (anchor_id) WHERE NOT same AND 50 * positive_score <= 100 * score AND 100 * score <= 95 * positive_score
QUALIFY rank <= 3
"""

QUERIES = {"op13_hard_negatives": op13_hard_negatives}
SQL = {"op13_hard_negatives": ORACLE_SQL}
