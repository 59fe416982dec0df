"""Toxicity by the nearest labelled examples under exact TF-IDF cosine.

Terms are all words of the examples and the first ``STEM`` characters of their longer words; none is left out. An
example is a unit vector of (1 + log tf) * idf * relevance: document frequencies are counted over all documents, and
a term's relevance is the square of the z-score of its log odds between the examples of the two labels, so that words
that say nothing of the label weigh little (README has figures without it). The examples of each label lie in an
inverted index of blocks. Postings of rarer terms are added up first; for the terms that many examples hold there is
a largest weight of each (block, term), a query's bound for a block is its best rare sum plus its product with
those maxima, and a block whose bound is under the k-th best cosine found is passed over, so the k neighbours are exact.

The nearest examples of either label vote with their cosines (a distance of 1 has no vote); the score is the toxic
share of the mean votes, calibrated by isotonic regression on leave-one-out shares of the examples, weighted by the
labels' shares among all labelled rows. Evidence is the ids of the nearest examples and their cosines.

Defined cases: null and empty texts, and texts without a term of the examples, get the share of toxic ones among such
examples; without labelled examples of both kinds every score is the share of toxic ones (0 without any); ties go to
the example with the lower id; repeated rows get equal results; an empty table gives an empty result; other columns
are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import id_remainder, table
from .samples import training_texts
from .text_arrays import buffers, release, slices, term_hashes

#: Labelled examples of each class to fit on, characters of a stem, neighbours of each label, examples in a block.
PER_CLASS = 3000
STEM = 5
NEIGHBOURS = 15
BLOCK = 64
EVIDENCE = 3
#: Terms in more than one of so many examples are summed block by block, others from their postings.
FREQUENT = 20
#: Texts scored together.
BATCH = 64


def term_counts(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, term hash, count) of every distinct term of every text, in order of text and hash."""
    parts = [(np.zeros(0, np.int32), np.zeros(0, np.uint64), np.zeros(0, np.int32))]
    for first, encoded in buffers(texts):
        hashes, owner = term_hashes(encoded, STEM)
        order = np.lexsort((hashes, owner))
        hashes, owner = hashes[order], owner[order]
        starts = np.flatnonzero(np.concatenate([[True], (hashes[1:] != hashes[:-1]) | (owner[1:] != owner[:-1])])) if len(hashes) else np.zeros(0, np.int64)
        parts.append(((owner[starts] + first).astype(np.int32), hashes[starts], np.diff(starts, append=len(hashes)).astype(np.int32)))
    return tuple(np.concatenate(x) for x in zip(*parts, strict=True))


@dataclass
class BlockMaxIndex:
    """Unit vectors of examples as postings by term: docs and weights at offsets[term]."""

    ids: np.ndarray
    offsets: np.ndarray
    docs: np.ndarray
    weights: np.ndarray
    block: int

    def __post_init__(self) -> None:
        self.dense: tuple | None = None

    def __getstate__(self) -> dict:
        return {**self.__dict__, "dense": None}  # made anew where it is sent to

    @staticmethod
    def build(ids: np.ndarray, owner: np.ndarray, term: np.ndarray, weight: np.ndarray, terms: int, block: int = BLOCK) -> BlockMaxIndex:
        """From (example, term, weight) entries. Examples in the order given; similar ones side by side make the bounds tight."""
        order = np.lexsort((owner, term))
        return BlockMaxIndex(np.asarray(ids), np.searchsorted(term[order], np.arange(terms + 1)), owner[order].astype(np.int32), weight[order], block)

    def _frequent(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(row of each frequent term, or -1; their weights by example; their largest weights by block), made where they are used."""
        if self.dense is None:
            n, size = len(self.ids), np.diff(self.offsets)
            held = np.flatnonzero(size * FREQUENT > n)
            row = np.full(len(size), -1)
            row[held] = np.arange(len(held))
            weights = np.zeros((len(held), -(-n // self.block) * self.block))
            at = np.concatenate([np.zeros(0, np.int64), *(np.arange(self.offsets[t], self.offsets[t + 1]) for t in held)])
            weights[np.repeat(np.arange(len(held)), size[held]), self.docs[at]] = self.weights[at]
            self.dense = row, weights, weights.reshape(len(held), weights.shape[1] // self.block, self.block).max(axis=2, initial=0)
        return self.dense

    def search(self, n: int, owner: np.ndarray, term: np.ndarray, weight: np.ndarray, k: int, skip: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """(positions, cosines) of the k nearest examples of n queries of (query, term, weight) entries, nearest first; -1
        where fewer have a positive cosine. skip: an example of each query to leave out, -1 for none."""
        size = len(self.ids)
        where, best = np.full((n, k), -1), np.zeros((n, k))
        if not n or not size:
            return where, best
        row, dense, maxima = self._frequent()
        width = dense.shape[1]
        rare = row[term] < 0
        q, t, w = owner[rare], term[rare], weight[rare]
        times = self.offsets[t + 1] - self.offsets[t]
        at = np.repeat(self.offsets[t] - np.cumsum(times) + times, times) + np.arange(times.sum())
        scores = np.bincount(np.repeat(q, times) * width + self.docs[at], np.repeat(w, times) * self.weights[at], n * width).astype(float).reshape(n, width)  # no entries: integers
        queries = np.zeros((n, len(dense)))
        queries[owner[~rare], row[term[~rare]]] = weight[~rare]
        bounds = queries @ maxima + scores.reshape(n, width // self.block, self.block).max(axis=2)
        out = np.zeros(bounds.shape, bool)
        kth = np.zeros(n)
        for b in np.argsort(-bounds.sum(axis=0), kind="stable"):
            go = np.flatnonzero((bounds[:, b] > 0) & (bounds[:, b] >= kth - 1e-9))
            if not len(go):
                continue
            span = slice(b * self.block, (b + 1) * self.block)
            found = scores[go, span] + queries[go] @ dense[:, span]
            if skip is not None:
                own = skip[go] - b * self.block
                mine = np.flatnonzero((skip[go] >= 0) & (own >= 0) & (own < self.block))
                found[mine, own[mine]] = 0
            scores[go, span] = found
            out[go, b] = True
            top = np.concatenate([best[go], found], axis=1)
            best[go] = np.partition(top, top.shape[1] - k, axis=1)[:, top.shape[1] - k :]
            kth[go] = best[go].min(axis=1)
        scores *= np.repeat(out, self.block, axis=1)
        q, d = np.nonzero((scores > 0) & (scores >= kth[:, None] - 1e-9))
        s = np.round(scores[q, d], 12)
        order = np.lexsort((self.ids[d], -s, q))
        q, d, s = q[order], d[order], s[order]
        place = np.arange(len(q)) - np.searchsorted(q, q)
        some = place < k
        best[:] = 0
        where[q[some], place[some]], best[q[some], place[some]] = d[some], s[some]
        return where, best


def isotonic(x: np.ndarray, y: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Knots of the weighted isotonic regression of y on x (pool adjacent violators)."""
    order = np.argsort(x, kind="stable")
    pools: list[list[float]] = []  # weight, mean, least x, greatest x
    for i in order:
        pools.append([w[i], y[i], x[i], x[i]])
        while len(pools) > 1 and (pools[-2][1] >= pools[-1][1] or pools[-2][3] == pools[-1][2]):
            b = pools.pop()
            a = pools[-1]
            total = a[0] + b[0]
            pools[-1] = [total, (a[0] * a[1] + b[0] * b[1]) / total, a[2], b[3]]
    xs = np.array([v for p in pools for v in (p[2], p[3])])
    ys = np.array([v for p in pools for v in (p[1], p[1])])
    return xs, ys


@dataclass
class Model:
    """terms: sorted hashes, weights: idf * relevance of each; indexes: of the examples labelled 0 and 1."""

    terms: np.ndarray
    weights: np.ndarray
    indexes: list[BlockMaxIndex]
    share: float
    empty_share: float
    knots: tuple[np.ndarray, np.ndarray]

    def vectors(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(text, term, weight) of unit vectors."""
        return unit_vectors(self.terms, self.weights, len(texts), *term_counts(texts))

    def votes(self, found: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
        """The toxic share of the mean votes; nan without any. found: the neighbours of label 0 and of label 1."""
        mean = [c.sum(axis=1) / np.maximum((w >= 0).sum(axis=1), 1) for w, c in found]
        with np.errstate(invalid="ignore"):
            return mean[1] / (mean[0] + mean[1])

    def nearest(self, n: int, entries: tuple, skip: list[np.ndarray] | None = None) -> list[tuple[np.ndarray, np.ndarray]]:
        return [index.search(n, *entries, NEIGHBOURS, None if skip is None else skip[y]) for y, index in enumerate(self.indexes)]

    def score(self, texts: list[str | None]) -> list[tuple[float, list[int], list[float]]]:
        """(score, ids of the nearest examples, their cosines) of every whole text."""
        out: list = []
        for s in range(0, len(texts), BATCH):
            some = texts[s : s + BATCH]
            found = self.nearest(len(some), self.vectors(some)) if self.indexes else []
            raw = self.votes(found) if found else np.full(len(some), np.nan)
            for j in range(len(some)):
                if np.isnan(raw[j]):
                    out.append((self.empty_share, [], []))
                    continue
                near = sorted((-c, int(self.indexes[y].ids[p])) for y, (w, cs) in enumerate(found) for p, c in zip(w[j, :EVIDENCE].tolist(), cs[j, :EVIDENCE].tolist(), strict=True) if p >= 0)[:EVIDENCE]
                out.append((float(np.interp(raw[j], *self.knots)), [i for _, i in near], [min(-c, 1.0) for c, _ in near]))
        return out


def unit_vectors(terms: np.ndarray, weights: np.ndarray, n: int, owner: np.ndarray, hashes: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, term, weight) entries of n texts' unit vectors; terms that aren't known or weigh nothing have no entry."""
    at = np.minimum(np.searchsorted(terms, hashes), max(len(terms) - 1, 0))
    known = np.flatnonzero(terms[at] == hashes) if len(terms) else np.zeros(0, np.int64)
    owner, at, w = owner[known], at[known], (1 + np.log(counts[known])) * weights[at[known]]
    norm = np.sqrt(np.bincount(owner, w * w, n))
    keep = w > 0
    return owner[keep], at[keep].astype(np.int32), w[keep] / norm[owner[keep]]


def relevance(toxic: np.ndarray, clean: np.ndarray, n_toxic: int, n_clean: int) -> np.ndarray:
    """The squared z-score of each term's log odds between the labels, from the examples of either that hold it."""
    odds = np.log((toxic + 0.5) / (n_toxic + 1)) - np.log((clean + 0.5) / (n_clean + 1))
    return odds * odds / (1 / (toxic + 0.5) + 1 / (clean + 0.5))


def document_frequencies(docs: DataFrame, terms: np.ndarray) -> tuple[np.ndarray, int]:
    """(documents that hold each term, all documents), over all documents: a row for each term that a task met is shuffled."""
    import pyarrow as pa

    def run(batches: Iterator) -> Iterator:
        held, n = np.zeros(len(terms) + 1, np.int64), 0
        for batch in batches:
            n += batch.num_rows
            for some in slices(batch, 0):
                _, hashes, _ = term_counts(some.column(0).to_pylist())
                at = np.minimum(np.searchsorted(terms, hashes), max(len(terms) - 1, 0))
                held[:-1] += np.bincount(at[terms[at] == hashes], minlength=len(terms)) if len(terms) else 0
        held[-1] = n
        met = np.flatnonzero(held)
        release()
        for s in range(0, len(met), 50_000):
            yield pa.RecordBatch.from_arrays([pa.array(met[s : s + 50_000]), pa.array(held[met[s : s + 50_000]])], names=["term", "n"])

    counted = docs.select(F.col("text").cast("string").alias("text")).mapInArrow(run, "term bigint, n bigint").groupBy("term").agg(F.sum("n").alias("n")).toArrow()  # a row for each term
    held = np.zeros(len(terms) + 1, np.int64)
    held[counted["term"].to_numpy()] = counted["n"].to_numpy()
    return held[:-1], int(held[-1])


def fit(docs: DataFrame, labels: DataFrame, label: str = "toxic", modulus: int = 3, held_out: int = 1, per_class: int = PER_CLASS) -> Model:
    """A model of at most about per_class examples of each class, none with the held-out remainder."""
    rows, counts = training_texts(docs, labels.select("doc_id", label), label, per_class, id_remainder(F.col("doc_id"), modulus) != held_out)
    unique: dict[str, tuple[int, int]] = {}
    for r in rows:  # equal texts are one example
        unique.setdefault(r["text"], (r["doc_id"], int(r[label] == 1)))
    texts = list(unique)
    ids = np.array([v[0] for v in unique.values()], np.int64)
    y = np.array([v[1] for v in unique.values()], np.int64)
    total = max(1, sum(counts.values()))
    share = counts.get(1, 0) / total
    if not 0 < y.sum() < len(y):
        return Model(np.zeros(0, np.uint64), np.zeros(0), [], share, share, (np.array([0.0, 1.0]), np.array([0.0, 1.0])))
    n_texts = len(texts)
    owner, hashes, times = term_counts(texts)
    del rows, unique, texts
    terms, at = np.unique(hashes, return_inverse=True)
    toxic, every = np.bincount(at, y[owner], len(terms)), np.bincount(at, minlength=len(terms))
    held, n = document_frequencies(docs, terms)
    weights = np.maximum(np.log((1 + n) / (1 + held)), 0) * relevance(toxic, every - toxic, int(y.sum()), int((1 - y).sum()))
    owner, term, weight = unit_vectors(terms, weights, n_texts, owner, hashes, times)
    del at, hashes, times
    heaviest = np.lexsort((-weight, owner))
    first = heaviest[np.concatenate([[True], np.diff(owner[heaviest]) > 0])] if len(owner) else heaviest
    lead = np.full(n_texts, -1)
    lead[owner[first]] = term[first]
    order = np.lexsort((ids, lead))  # examples of one heaviest term side by side
    indexes, places = [], np.full((2, n_texts), -1)
    for k in (0, 1):
        mine = order[(y[order] == k) & (lead[order] >= 0)]
        places[k, mine] = np.arange(len(mine))
        some = places[k, owner] >= 0
        indexes.append(BlockMaxIndex.build(ids[mine], places[k, owner[some]], term[some], weight[some], len(terms)))
    corrections = np.array([(total - counts.get(1, 0)) / (y == 0).sum(), counts.get(1, 0) / (y == 1).sum()])
    model = Model(terms, weights, indexes, share, share, (np.array([0.0, 1.0]), np.array([0.0, 1.0])))
    raw = np.empty(n_texts)
    bounds = np.searchsorted(owner, np.arange(n_texts + 1))
    for s in range(0, n_texts, BATCH):
        e = min(s + BATCH, n_texts)
        part = slice(bounds[s], bounds[e])
        raw[s:e] = model.votes(model.nearest(e - s, (owner[part] - s, term[part], weight[part]), [places[k, s:e] for k in (0, 1)]))
    for index in indexes:
        index.dense = None
    ok = ~np.isnan(raw)
    bare = corrections[y] * ~ok
    model.empty_share = float(((bare * y).sum() + share) / (bare.sum() + 1))
    w = corrections[y][ok]
    # two more cases of either kind keep the ends off 0 and 1
    x, t = np.concatenate([raw[ok], [0, 0, 1, 1]]), np.concatenate([y[ok], [0, 1, 0, 1]]).astype(float)
    tiny = w.mean() if len(w) else 1.0
    model.knots = isotonic(x, t, np.concatenate([w, [tiny, tiny * share * 0.1, tiny * 0.1, tiny]]))
    return model


def score_documents(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, score, neighbours and cosines of every document."""
    import pyarrow as pa

    def run(batches: Iterator) -> Iterator:
        for batch in batches:
            for some in slices(batch, 1):
                found = model.score(some.column(1).to_pylist())
                columns = [some.column(0), *(pa.array([f[i] for f in found], t) for i, t in enumerate((pa.float64(), pa.list_(pa.int64()), pa.list_(pa.float64()))))]
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "score", "neighbours", "cosines"])
        release()

    flat = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    return flat.mapInArrow(run, f"doc_id {dict(docs.dtypes)['doc_id']}, score double, neighbours array<bigint>, cosines array<double>")


def op1_toxicity(spark, sf_dir: str) -> DataFrame:
    """Every document's toxicity."""
    docs = table(spark, sf_dir, "documents")
    scored = score_documents(docs, fit(docs, table(spark, sf_dir, "labels")))
    return scored.select(
        "doc_id", (id_remainder(F.col("doc_id"), 3) == 1).alias("held_out"), "score",
        (F.col("score") >= 0.7).cast("int").alias("predicted"), "neighbours", "cosines",
    )


QUERIES = {"op1_toxicity": op1_toxicity}
SQL: dict[str, str] = {}
