"""Quality by co-training of two views.

The content view sees the whole text: its words and pairs of words, hashed to GRAMS slots with the log odds of the
labels, and shares of letters, capitals, digits, signs and breaks, word lengths and repetition. The metadata view sees the
document's other columns (source, lang and stated length, hashed). Each is a logistic regression. A text's mean log odds
is one column of it; of a text that is fitted on they are those without itself, so that rare words can't give a label
away. In every round each view is fitted, scores a bounded pool of unlabelled documents, and hands its most confident ones
of both kinds to the other view as labelled. The sum of the views' logits, in which no view has a negative weight, is
calibrated by cross-fitting: the labelled rows are dealt into folds, and each fold's logits are of views that were trained
on the others. One more part of the labelled rows is held out: neither fitted nor calibrated on.

Defined cases: null and empty texts have the features of an empty text; a null in the metadata is a value of
its own; a fold whose others lack a label doesn't calibrate, and where what is left lacks one the fitted rows' own logits
do; without labels of both kinds every score is the share of label 1 (0.5 without any); repeated rows get equal scores; an
empty table gives an empty result; doc_id and labels are no features.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import filter_texts, hash_order, id_remainder, table
from .samples import FIT_BYTES, training_texts
from .text_arrays import buffers, mix, release, slices, word_hashes

#: Labelled rows of each class and unlabelled rows to fit on; rounds; pseudo-labels of each kind handed over in a round.
PER_CLASS = 2000
POOL = 4000
ROUNDS = 5
HANDED = 100
#: Of the remainders of labelled rows' ids, 1 is held out and the others are folds.
PARTS = 5
#: Slots that words and pairs of words are hashed to, and documents of either label that each slot has seen beforehand.
GRAMS = 1 << 17
SEEN = 0.5
METADATA = ("source", "lang", "n_chars")
SLOTS = 64

#: Byte classes: 0 other, 1 a-z, 2 A-Z, 3 digit, 4 space, 5 line break, 6 beyond ASCII, 7 .,;: 8 ! 9 ? 10 | 11 #*$%&<> 12 quotes, dashes and brackets
CLASS = np.zeros(256, np.int64)
CLASS[97:123], CLASS[65:91], CLASS[48:58], CLASS[32], CLASS[10], CLASS[128:] = 1, 2, 3, 4, 5, 6
for _signs, _k in ((b".,;:", 7), (b"!", 8), (b"?", 9), (b"|", 10), (b"#*$%&<>", 11), (b"'\"-()[]{}", 12)):
    CLASS[list(_signs)] = _k
CLASSES = 13


def content_features(texts: list[str | None]) -> np.ndarray:
    """A row for each whole text."""
    out = np.zeros((len(texts), CLASSES + 6))
    for first, encoded in buffers(texts):
        n = len(encoded)
        lengths = np.array([len(e) for e in encoded])
        owner = np.repeat(np.arange(n), lengths)
        codes = CLASS[np.frombuffer(b"".join(encoded), np.uint8)]
        counts = np.bincount(owner * CLASSES + codes, minlength=n * CLASSES).reshape(n, CLASSES)
        size = np.maximum(lengths, 1)[:, None]
        hashes, offsets = word_hashes(encoded)
        words = np.diff(offsets)
        fresh = np.array([len(np.unique(hashes[offsets[i] : offsets[i + 1]])) for i in range(n)])
        letters = np.maximum(counts[:, 1] + counts[:, 2], 1)
        rest = np.stack([np.log1p(lengths), np.log1p(words), fresh / np.maximum(words, 1), counts[:, 2] / letters, (lengths - counts[:, 4] - counts[:, 5]) / np.maximum(words, 1), np.log1p(counts[:, 5])], axis=1)
        out[first : first + n] = np.concatenate([np.sqrt(counts / size), rest], axis=1)
    return out


@dataclass
class Content:
    """What the content view sees of texts: a row of figures, and the slots of their words and pairs, each once, from starts."""

    figures: np.ndarray
    starts: np.ndarray
    slots: np.ndarray

    @staticmethod
    def of(texts: list[str | None]) -> Content:
        parts, sizes = [np.zeros(0, np.int32)], []
        for _, encoded in buffers(texts):
            hashes, offsets = word_hashes(encoded)
            for i in range(len(encoded)):
                words = hashes[offsets[i] : offsets[i + 1]]
                grams = np.concatenate([mix(words, 1), mix(words[:-1] * np.uint64(3) + mix(words[1:], 2), 3)])
                parts.append(np.unique((grams % np.uint64(GRAMS)).astype(np.int32)))
                sizes.append(len(parts[-1]))
        return Content(content_features(texts), np.concatenate([[0], np.cumsum(np.array(sizes, np.int64))]), np.concatenate(parts))

    def __len__(self) -> int:
        return len(self.figures)

    def take(self, rows: np.ndarray) -> Content:
        slots = [self.slots[self.starts[r] : self.starts[r + 1]] for r in rows.tolist()]
        return Content(self.figures[rows], np.concatenate([[0], np.cumsum(np.diff(self.starts)[rows])]), np.concatenate([self.slots[:0], *slots]))

    def blocks(self, most: int = 1 << 20) -> Iterator[tuple[slice, np.ndarray, np.ndarray]]:
        """(texts, their slots, the text of each slot) of a bounded number of slots at a time: what is laid out beside them takes much more."""
        at = 0
        while at < len(self):
            to = max(at + 1, int(np.searchsorted(self.starts, self.starts[at] + most, side="right")) - 1)
            yield slice(at, to), self.slots[self.starts[at] : self.starts[to]], np.repeat(np.arange(to - at), np.diff(self.starts[at : to + 1]))
            at = to

    def plus(self, other: Content) -> Content:
        return Content(np.concatenate([self.figures, other.figures]), np.concatenate([self.starts, self.starts[-1] + other.starts[1:]]), np.concatenate([self.slots, other.slots]))


class ContentView:
    """The content view: log odds of slots, then a logistic regression."""

    def fit(self, x: Content, y: np.ndarray, w: np.ndarray) -> ContentView:
        self.model = Logistic()
        own = [w * (y == k) for k in (0, 1)]
        held, total = [np.zeros(GRAMS), np.zeros(GRAMS)], [o.sum() for o in own]
        for texts, slots, owner in x.blocks():
            for k in (0, 1):
                np.add.at(held[k], slots, own[k][texts][owner])
        self.odds = _odds(held[1], total[1], held[0], total[0]).astype(np.float32)

        def apart(texts: slice, slots: np.ndarray, owner: np.ndarray) -> np.ndarray:
            """Odds of slots without what each text itself has given to what its slots have seen."""
            mine = [o[texts][owner] for o in own]
            return _odds(held[1][slots] - mine[1], total[1] - mine[1], held[0][slots] - mine[0], total[0] - mine[0])

        self.model.fit(self._columns(x, apart), y, w)
        return self

    def _columns(self, x: Content, odds) -> np.ndarray:
        mean = np.zeros(len(x))
        for texts, slots, owner in x.blocks():
            n = texts.stop - texts.start
            mean[texts] = np.bincount(owner, odds(texts, slots, owner), n)
        return np.column_stack([x.figures, mean / np.maximum(np.diff(x.starts), 1)])

    def logit(self, x: Content) -> np.ndarray:
        return self.model.logit(self._columns(x, lambda texts, slots, owner: self.odds[slots]))


def _odds(good: np.ndarray, n_good: np.ndarray, bad: np.ndarray, n_bad: np.ndarray) -> np.ndarray:
    return np.log((good + SEEN) / (n_good + 2 * SEEN)) - np.log((bad + SEEN) / (n_bad + 2 * SEEN))


def _take(x, rows: np.ndarray):
    return x.take(rows) if isinstance(x, Content) else x[rows]


def _plus(x, other):
    return x.plus(other) if isinstance(x, Content) else np.concatenate([x, other])


def metadata_features(rows: pd.DataFrame) -> np.ndarray:
    """Hashed source and lang, and the stated length, of every row."""
    out = np.zeros((len(rows), SLOTS + 16 + 2))
    for name, start, slots in (("source", 0, SLOTS), ("lang", SLOTS, 16)):
        values = rows[name].astype(object).where(rows[name].notna(), "\x00null").astype(str)
        out[np.arange(len(rows)), start + np.array([zlib.crc32(v.encode()) % slots for v in values], np.int64)] = 1
    stated = pd.to_numeric(rows["n_chars"], errors="coerce").astype(float).to_numpy()
    out[:, -2] = np.isnan(stated)
    out[:, -1] = np.log1p(np.maximum(np.nan_to_num(stated), 0))
    return out


@dataclass
class Logistic:
    """Ridge logistic regression on standardised columns, fitted by Newton steps."""

    mean: np.ndarray = field(default_factory=lambda: np.zeros(0))
    scale: np.ndarray = field(default_factory=lambda: np.ones(0))
    weights: np.ndarray = field(default_factory=lambda: np.zeros(1))

    def fit(self, x: np.ndarray, y: np.ndarray, w: np.ndarray, ridge: float = 1.0) -> Logistic:
        self.mean, self.scale = x.mean(axis=0), x.std(axis=0) + 1e-9
        z = np.concatenate([(x - self.mean) / self.scale, np.ones((len(x), 1))], axis=1)
        b = np.zeros(z.shape[1])
        penalty = np.full(z.shape[1], ridge)
        penalty[-1] = 1e-6
        for _ in range(25):
            p = 1 / (1 + np.exp(-np.clip(z @ b, -30, 30)))
            step = np.linalg.solve((z * (w * p * (1 - p))[:, None]).T @ z + np.diag(penalty), z.T @ (w * (y - p)) - penalty * b)
            b += np.clip(step, -2, 2)
            if np.abs(step).max() < 1e-6:
                break
        self.weights = b
        return self

    def logit(self, x: np.ndarray) -> np.ndarray:
        return np.clip(((x - self.mean) / self.scale) @ self.weights[:-1] + self.weights[-1], -30, 30)


@dataclass
class Views:
    """The two fitted views and the calibrated sum; share is the score of everything if they are None."""

    share: float
    content: ContentView | None = None
    metadata: Logistic | None = None
    combined: Logistic | None = None

    def score(self, rows: pd.DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(score, content view's logit, metadata view's logit) of every row."""
        if self.combined is None:
            return np.full(len(rows), self.share), np.zeros(len(rows)), np.zeros(len(rows))
        a, b = self.content.logit(Content.of(rows["text"].tolist())), self.metadata.logit(metadata_features(rows))
        return 1 / (1 + np.exp(-self.combined.logit(np.stack([a, b], axis=1)))), a, b


def co_train(x: tuple[Content, np.ndarray], y: np.ndarray, w: np.ndarray, pool: tuple[Content, np.ndarray], rounds: int = ROUNDS, handed: int = HANDED) -> tuple[ContentView, Logistic]:
    """(content, metadata) after exchanging confident pseudo-labels. x and pool: what both views see."""
    models = [ContentView() if isinstance(x[0], Content) else Logistic(), Logistic()]
    given: list[dict[int, int]] = [{}, {}]  # pool row -> label, for each view
    for _ in range(rounds):
        for v in (0, 1):
            rows = np.array(sorted(given[v]), np.int64)
            labels = np.array([given[v][r] for r in rows.tolist()], float)
            # pseudo-labels weigh as much as the labelled rows do on average, and at most as much in all
            weight = min(w.mean(), w.sum() / max(len(rows), 1))
            models[v].fit(_plus(x[v], _take(pool[v], rows)), np.concatenate([y, labels]), np.concatenate([w, np.full(len(rows), weight)]))
        if not len(pool[0]):
            break
        for v in (0, 1):
            p = models[v].logit(pool[v])
            order = np.argsort(p, kind="stable")
            fresh = [i for i in order.tolist() if i not in given[1 - v]]
            share = (w * y).sum() / w.sum()
            low, high = max(1, round(handed * (1 - share))), max(1, round(handed * share))
            # only what the view is sure of: a probability of 0.95 or more
            given[1 - v].update({i: 0 for i in fresh[:low] if p[i] < -2.94})
            given[1 - v].update({i: 1 for i in fresh[::-1][:high] if p[i] > 2.94})
    return models[0], models[1]


def cross_fitted(x: tuple[Content, np.ndarray], y: np.ndarray, w: np.ndarray, pool: tuple[Content, np.ndarray], folds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(rows, their logits of both views trained on the other folds), of the folds whose others have both labels."""
    rows, logits = [], []
    for fold in np.unique(folds):
        mine, others = np.flatnonzero(folds == fold), np.flatnonzero(folds != fold)
        if 0 < y[others].sum() < len(others):
            models = co_train(tuple(_take(v, others) for v in x), y[others], w[others], pool)
            rows.append(mine)
            logits.append(np.stack([m.logit(_take(v, mine)) for m, v in zip(models, x, strict=True)], axis=1))
    return (np.concatenate(rows), np.concatenate(logits)) if rows else (np.zeros(0, np.int64), np.zeros((0, 2)))


def combine(logits: np.ndarray, y: np.ndarray, w: np.ndarray) -> Logistic:
    """The calibrated sum of the views' logits: a view that would count against itself is left out of it."""
    both = Logistic().fit(logits, y, w)
    for v in np.flatnonzero(both.weights[:-1] < 0):
        rest = logits.copy()
        rest[:, v] = 0
        both = Logistic().fit(rest, y, w)
        both.weights[v] = 0
        logits = rest
    both.weights[:-1] = np.maximum(both.weights[:-1], 0)
    return both


def part_of(ids: list) -> np.ndarray:
    """The remainder of each id: as id_remainder has it."""
    return np.array([zlib.crc32(str(i).encode()) % PARTS for i in ids], np.int64)


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality") -> Views:
    """Views fitted on bounded samples of labelled and unlabelled documents."""
    rows, counts = training_texts(docs, labels.select("doc_id", label), label, PER_CLASS, id_remainder(F.col("doc_id"), PARTS) != 1, METADATA)
    total = sum(counts.values())
    share = counts.get(1, 0) / total if total else 0.5
    y = np.array([int(r[label] == 1) for r in rows], float)
    if not 0 < y.sum() < len(y):
        return Views(share)
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    n, size = docs.agg(F.count("*"), F.coalesce(F.sum(F.octet_length(text)), F.lit(0))).first()
    draw = F.pmod(hash_order(29, F.col("doc_id"), text), F.lit(1 << 40)) / float(1 << 40)
    drawn = docs.where(F.col("doc_id").isNotNull() & (draw < min(POOL / max(n, 1), FIT_BYTES / max(size, 1))))
    unlabelled = drawn.select("doc_id", text.alias("text"), *METADATA).distinct().join(labels.where(F.col(label).isNotNull()).select("doc_id").distinct(), "doc_id", "left_anti")
    pool = unlabelled.toPandas().sort_values(["doc_id", "text"])  # about POOL rows
    frame = pd.DataFrame([r.asDict() for r in rows])
    weights = np.array([(total - counts.get(1, 0)) / max(1, (y == 0).sum()), counts.get(1, 0) / max(1, (y == 1).sum())])[y.astype(int)]
    seen, held = ((Content.of(d["text"].tolist()), metadata_features(d)) for d in (frame, pool))
    folds = part_of([r["doc_id"] for r in rows])
    del rows, frame, pool  # the driver holds no texts while it fits
    release()
    content, metadata = co_train(seen, y, weights, held)
    apart, logits = cross_fitted(seen, y, weights, held, folds)
    if not 0 < y[apart].sum() < len(apart):
        apart, logits = np.arange(len(y)), np.stack([content.logit(seen[0]), metadata.logit(seen[1])], axis=1)
    return Views(share, content, metadata, combine(logits, y[apart], weights[apart]))


def score_documents(docs: DataFrame, views: Views) -> DataFrame:
    """doc_id, score, content and metadata (the views' logits) of every document."""
    import pyarrow as pa

    def run(batches: Iterator) -> Iterator:
        for batch in batches:
            for some in slices(batch, 1):
                found = views.score(some.to_pandas())
                yield pa.RecordBatch.from_arrays([some.column(0), *(pa.array(f, pa.float64()) for f in found)], names=["doc_id", "score", "content", "metadata"])
        release()

    flat = docs.select("doc_id", F.col("text").cast("string").alias("text"), *METADATA)
    return flat.mapInArrow(run, f"doc_id {dict(docs.dtypes)['doc_id']}, score double, content double, metadata double")


def keep_good(docs: DataFrame, labels: DataFrame, least: float = 0.5) -> DataFrame:
    """The documents with a score of at least least, with all their columns."""
    views = fit(docs, labels)
    return filter_texts(docs, lambda: lambda some: views.score(some.to_pandas())[0] >= least, ("text", *METADATA))


def op10_quality_classifier(spark, sf_dir: str) -> DataFrame:
    """Every document's quality; held_out rows are neither fitted nor calibrated on."""
    docs = table(spark, sf_dir, "documents")
    scored = score_documents(docs, fit(docs, table(spark, sf_dir, "labels")))
    return scored.select("doc_id", (id_remainder(F.col("doc_id"), PARTS) == 1).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "content", "metadata")


QUERIES = {"op10_quality_classifier": op10_quality_classifier}
SQL: dict[str, str] = {}
