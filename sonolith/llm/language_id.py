"""Language identification by a byte convolutional network.

Texts become bytes with A-Z (and the two-byte capitals of the same block) lower-cased and ASCII other than
letters as spaces, cut into fixed-length windows that overlap by one filter. Filters of several widths slide
over the one-hot bytes; their rectified maxima over the window feed a softmax. It is trained here, in numpy,
by back-propagation through the maxima, on windows drawn from all windows of a bounded sample of labelled texts. A document's prediction is the
mean of its windows' probabilities, weighted by their lengths; every byte of the text is in some window.

Scoring a window sums table rows: a filter of width w over one-hot bytes is a sum of w rows, and rows of two
neighbouring bytes are added up beforehand, so widths 2, 3 and 4 take one, two and two lookups a byte.

Defined cases: a null text or one without a letter is ``und`` with score 0; without any labelled text all
others are ``und`` too; an empty table gives an empty result; repeated rows get equal results; only text,
and for fitting lang and doc_id, are read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import filter_texts, id_remainder, table
from .samples import training_texts
from .text_arrays import release, slices

WINDOW = 128
WIDTHS = (2, 3, 4)
FILTERS = 12
#: Labelled texts of each language to fit on, and windows drawn from all of theirs.
PER_LANGUAGE = 500
WINDOWS_PER_LANGUAGE = 2000
EPOCHS = 6
#: Windows scored together.
BATCH = 512
UNKNOWN = "und"

TABLE = np.full(256, 32, np.uint8)
TABLE[97:123] = np.arange(97, 123)
TABLE[65:91] = np.arange(97, 123)
TABLE[128:] = np.arange(128, 256)


def normalised(text: str) -> np.ndarray:
    """The text's bytes as the network sees them."""
    b = TABLE[np.frombuffer(text.encode("utf-8", "replace"), np.uint8)]
    capital = np.flatnonzero((b[:-1] == 0xC3) & (b[1:] >= 0x80) & (b[1:] <= 0x9E)) + 1
    b[capital] += 0x20
    return b


def windows_of(b: np.ndarray, size: int = WINDOW) -> tuple[np.ndarray, np.ndarray]:
    """(windows, bytes of text in each): overlapping by the widest filter less one, the last padded with spaces."""
    step = size - max(WIDTHS) + 1
    n = max(1, -(-(len(b) - max(WIDTHS) + 1) // step))
    padded = np.full((n - 1) * step + size, 32, np.uint8)
    padded[: len(b)] = b
    cut = np.lib.stride_tricks.sliding_window_view(padded, size)[::step]
    return cut, np.clip(len(b) - np.arange(n) * step, 1, size)


@dataclass
class Network:
    """kernels[k][j]: 256 x FILTERS weights of the byte at offset j under width WIDTHS[k]."""

    languages: list[str]
    kernels: list[np.ndarray]
    biases: list[np.ndarray]
    dense: np.ndarray
    offset: np.ndarray

    def __post_init__(self) -> None:
        self.pairs: list | None = None

    def features(self, windows: np.ndarray) -> np.ndarray:
        """Rectified maxima of all filters."""
        if self.pairs is None:
            pair = lambda a, b: np.ascontiguousarray((a[:, None, :] + b[None, :, :]).reshape(65536, -1))
            self.pairs = [[pair(k[j], k[j + 1]) if j + 1 < len(k) else k[j] for j in range(0, len(k), 2)] for k in self.kernels]
        wide = windows[:, :-1].astype(np.int32) * 256 + windows[:, 1:]
        out = []
        for k, tables, bias in zip(self.kernels, self.pairs, self.biases, strict=True):
            width, n = len(k), windows.shape[1] - len(k) + 1
            total = tables[0][wide[:, :n]]
            if len(tables) > 1:
                total += tables[1][wide[:, 2 : 2 + n]] if width % 2 == 0 else tables[1][windows[:, 2 : 2 + n]]
            out.append(np.maximum(total.max(axis=1) + bias, 0))
        return np.concatenate(out, axis=1)

    def probabilities(self, windows: np.ndarray) -> np.ndarray:
        z = self.features(windows) @ self.dense + self.offset
        z = np.exp(z - z.max(axis=1, keepdims=True))
        return z / z.sum(axis=1, keepdims=True)


def train(texts: list[str], langs: list[str], epochs: int = EPOCHS, filters: int = FILTERS, seed: int = 3) -> Network | None:
    """A network fitted on the given texts; None without any."""
    languages = sorted(set(langs))
    if not languages:
        return None
    rng = np.random.default_rng(seed)
    xs, ys = [], []
    for i, language in enumerate(languages):
        mine = [normalised(t) for t, lang in zip(texts, langs, strict=True) if lang == language]
        ends = np.cumsum([len(windows_of(b)[0]) for b in mine])
        drawn = np.sort(rng.permutation(ends[-1])[:WINDOWS_PER_LANGUAGE])
        owner = np.searchsorted(ends, drawn, side="right")
        xs += [windows_of(mine[k])[0][drawn[owner == k] - (ends[k - 1] if k else 0)] for k in np.unique(owner)]
        ys += [i] * len(drawn)
    x, y = np.concatenate(xs), np.array(ys)
    weight = (len(y) / (len(languages) * np.maximum(np.bincount(y, minlength=len(languages)), 1)))[y].astype(np.float32)
    kernels = [rng.normal(0, 0.3, (w, 256, filters)).astype(np.float32) for w in WIDTHS]
    biases = [np.zeros(filters, np.float32) for _ in WIDTHS]
    dense = rng.normal(0, 0.3, (filters * len(WIDTHS), len(languages))).astype(np.float32)
    offset = np.zeros(len(languages), np.float32)
    params = [*kernels, *biases, dense, offset]
    first, second = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
    step = 0
    for epoch in range(epochs):
        order = rng.permutation(len(x))
        for at in range(0, len(x), 64):
            some = order[at : at + 64]
            b, target = x[some], y[some]
            rows = np.arange(len(some))
            maxima, where = [], []
            for k, bias in zip(kernels, biases, strict=True):
                n = b.shape[1] - len(k) + 1
                total = sum(k[j][b[:, j : j + n]] for j in range(len(k)))
                peak = total.argmax(axis=1)
                where.append(peak)
                maxima.append(np.take_along_axis(total, peak[:, None, :], 1)[:, 0] + bias)
            pre = np.concatenate(maxima, axis=1)
            hidden = np.maximum(pre, 0)
            z = hidden @ dense + offset
            p = np.exp(z - z.max(axis=1, keepdims=True))
            p /= p.sum(axis=1, keepdims=True)
            p[rows, target] -= 1
            p *= (weight[some] / len(some))[:, None]
            back = (p @ dense.T) * (pre > 0)
            grads = [np.zeros_like(k) for k in kernels]
            for i, (g, peak) in enumerate(zip(grads, where, strict=True)):
                part = back[:, i * filters : (i + 1) * filters]
                f = np.broadcast_to(np.arange(filters), peak.shape)
                for j in range(len(g)):
                    np.add.at(g[j], (b[rows[:, None], peak + j], f), part)
            grads += [back[:, i * filters : (i + 1) * filters].sum(axis=0) for i in range(len(WIDTHS))]
            grads += [hidden.T @ p, p.sum(axis=0)]
            step += 1
            rate = 0.01 / (1 + epoch)
            for q, g, m, v in zip(params, grads, first, second, strict=True):
                m += 0.1 * (g - m)
                v += 0.01 * (g * g - v)
                q -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-6)
    return Network(languages, kernels, biases, dense, offset)


def predict(network: Network | None, texts: list[str | None]) -> list[tuple[str, float]]:
    """(language, score) of every whole text; windows of several texts are scored together."""
    out: list[tuple[str, float]] = [(UNKNOWN, 0.0)] * len(texts)
    if network is None:
        return out
    mass = np.zeros((len(texts), len(network.languages)))
    held: list[np.ndarray] = []
    owners: list[np.ndarray] = []
    sizes: list[np.ndarray] = []
    count = 0

    def flush() -> None:
        nonlocal held, owners, sizes, count
        if held:
            w, o, s = np.concatenate(held), np.concatenate(owners), np.concatenate(sizes)
            for at in range(0, len(w), BATCH):
                p = network.probabilities(w[at : at + BATCH]) * s[at : at + BATCH, None]
                np.add.at(mass, o[at : at + BATCH], p)
        held, owners, sizes, count = [], [], [], 0

    some = []
    for i, text in enumerate(texts):
        if text and any(map(str.isalpha, text)):
            some.append(i)
            w, s = windows_of(normalised(text))
            held.append(w)
            owners.append(np.full(len(w), i))
            sizes.append(s)
            count += len(w)
            if count >= 8 * BATCH:
                flush()
    flush()
    for i in some:
        p = mass[i] / mass[i].sum()
        best = int(p.argmax())
        out[i] = (network.languages[best], float(p[best]))
    return out


def fit(docs: DataFrame, modulus: int = 4, held_out: int = 2) -> Network | None:
    """A network fitted on at most about PER_LANGUAGE texts of each language, none with the held-out remainder."""
    rows, _ = training_texts(docs, None, "lang", PER_LANGUAGE, id_remainder(F.col("doc_id"), modulus) != held_out)
    return train([r["text"] for r in rows], [r["lang"] for r in rows])


def identify(docs: DataFrame, network: Network | None, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The kept columns, lang_pred and score of every document."""
    import pyarrow as pa

    def run(batches: Iterator) -> Iterator:
        for batch in batches:
            for some in slices(batch, 0):
                found = predict(network, some.column(0).to_pylist())
                yield pa.RecordBatch.from_arrays([*some.columns[1:], pa.array([f[0] for f in found]), pa.array([f[1] for f in found])], names=[*keep, "lang_pred", "score"])
        release()

    flat = docs.select(F.col("text").cast("string").alias("\x00text"), *keep)
    kinds = ", ".join(f"`{n}` {t}" for n, t in docs.select(*keep).dtypes)
    return flat.mapInArrow(run, f"{kinds}, lang_pred string, score double")


def confident(docs: DataFrame, least: float = 0.35) -> DataFrame:
    """The documents in an identified language, with all their columns: und and scores under least are rejected."""
    network = fit(docs)
    return filter_texts(docs, lambda: lambda some: [lang != UNKNOWN and score >= least for lang, score in predict(network, some.column(0).to_pylist())])


def op2_language_id(spark, sf_dir: str) -> DataFrame:
    """Every document's language."""
    docs = table(spark, sf_dir, "documents")
    found = identify(docs, fit(docs))
    return found.select("doc_id", (id_remainder(F.col("doc_id"), 4) == 2).alias("held_out"), "lang_pred", "score")


QUERIES = {"op2_language_id": op2_language_id}
SQL: dict[str, str] = {}
