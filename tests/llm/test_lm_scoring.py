import math
import os
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from sonolith.llm import lm_scoring as lm
from sonolith.llm import stores
from sonolith.llm.text_arrays import mix

SF = "/root/testdata/sf0.001"


def words_of(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return [w for w in re.split(r"[\x20\x09-\x0D]+", low) if w]


def discounts(counts):
    n = [sum(c == k for c in counts) for k in (1, 2, 3, 4)]
    if 0 in n:
        return [0, 0.5, 0.5, 0.5]
    y = n[0] / (n[0] + 2 * n[1])
    return [0, *(min(max(k - (k + 1) * y * n[k] / n[k - 1], 0), k) for k in (1, 2, 3))]


class Brute:
    """The model by dictionaries of words."""

    def __init__(self, texts):
        self.c, self.pairs = Counter(), Counter()
        for t in texts:
            seq = [*words_of(t), "</s>"]
            self.c.update(seq)
            self.pairs.update(zip(["<s>", *seq], seq))
        self.n, self.v = sum(self.c.values()), len(self.c)
        self.total, self.kinds, self.before = Counter(), defaultdict(Counter), Counter()
        for (v, w), k in self.pairs.items():
            self.total[v] += k
            self.kinds[v][min(k, 3)] += 1
            self.before[w] += 1
        self.d2, self.d1 = discounts(self.pairs.values()), discounts(self.before.values())
        self.types = len(self.pairs)
        self.left = sum(self.d1[min(b, 3)] for b in self.before.values()) / self.types if self.types else 1.0

    def word(self, w):
        b = self.before[w]
        return (max(b - self.d1[min(b, 3)], 0) / self.types if self.types else 0) + self.left / (self.v + 1)

    def p(self, w, v):
        if not self.total[v]:
            return self.word(w)
        k = self.pairs[v, w]
        left = sum(self.d2[x] * n for x, n in self.kinds[v].items()) / self.total[v]
        return max(k - self.d2[min(k, 3)], 0) / self.total[v] + left * self.word(w)

    def judged(self, text):
        seq = [*words_of(text), "</s>"]
        base = sum(math.log10((self.c[w] + 1) / (self.n + self.v + 1)) for w in seq)
        return len(seq), sum(self.c[w] > 0 for w in seq), base, sum(math.log10(self.p(w, v)) for v, w in zip(["<s>", *seq], seq))


def compare(spark, train, texts, **how):
    model = lm.train(spark.createDataFrame([(t,) for t in train], "text string"), **how)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    brute = Brute(train)
    got = {r.doc_id: r for r in lm.score(docs, model).collect()}
    assert len(got) == len(texts) and model.tokens == brute.n and model.distinct == brute.v and model.types == brute.types
    for i, t in enumerate(texts):
        n, known, base, score = brute.judged(t)
        r = got[i]
        assert (r.n_tokens, r.n_known) == (n, known) and r.base_score == pytest.approx(base, rel=1e-9) and r.score == pytest.approx(score, rel=1e-9, abs=1e-12)
        assert r.perplexity == pytest.approx(10 ** (-score / n), rel=1e-9)
    return model, brute


TEXTS = [None, "", "  \t\n", "a", "A a\x0ba é É", "the cat sat on the mat", "The dog sat on the log", "xx yy zz", "漢字 \xa0 b"]


@pytest.mark.parametrize("held", [1 << 21, 3])
def test_equals_brute_force(spark, held):
    """held: counts are passed on at the end of a task, or every few keys; a word with a third of all pairs, a long text, repeats."""
    rng = np.random.default_rng(5)
    zipf = [" ".join(f"w{min(int(k), 40)}" for k in rng.zipf(1.3, int(n))) for n in rng.integers(0, 60, 80)]
    train = [*TEXTS, *zipf, "the the the", "the the the", "again " * 20_000, *(" ".join(("hot", f"u{i}")) for i in range(200))]
    model, brute = compare(spark, train, [*TEXTS, *zipf[:20], "w1 w2 new w3", "hot u7 hot unseen", "again " * 30_000], held=held)
    assert model.pair_discounts != (0.5, 0.5, 0.5)
    # probabilities sum to one in a seen, a hot and an unseen context
    for v in ("hot", "w1", "<s>", "nothing"):
        assert sum(brute.p(w, v) for w in brute.c) + brute.p("\x00unknown", v) == pytest.approx(1, abs=1e-9)


def test_without_training_texts_and_of_one(spark):
    compare(spark, [], ["a b", None])
    compare(spark, ["one text"], ["one text", "text one", ""])
    model = lm.train(spark.createDataFrame([("a",)], "text string"))
    assert lm.score(spark.createDataFrame([], "doc_id long, text string"), model).count() == 0


def test_columns_of_clashing_names_and_null_ids(spark):
    docs = spark.createDataFrame([(None, "a b", 1, 2.0, "x"), (3, None, 1, 2.0, "y")], "doc_id long, text string, ident int, score double, `a.b` string")
    model = lm.train(docs)
    assert sorted(str(r.doc_id) for r in lm.score(docs, model).collect()) == ["3", "None"]


def test_scrambling_is_undone():
    x = np.random.default_rng(1).integers(0, 1 << 63, 1000).astype(np.uint64) * np.uint64(2)
    assert (lm.unmix(mix(x)) == x).all()


def test_stored_arrays(tmp_path):
    put, mapped = stores.put, stores.mapped
    for uri in (f"{tmp_path}/a/b", f"file://{tmp_path}/a%20c/b"):
        put(uri, np.arange(5, dtype="<u4"))
        assert mapped(uri, "<u4").tolist() == [0, 1, 2, 3, 4]
        put(uri, np.zeros(0, "<u4"))  # written anew
        assert not len(mapped(uri, "<u4"))
    assert sorted(os.listdir(tmp_path)) == ["a", "a c"] and os.listdir(f"{tmp_path}/a") == ["b"]


@pytest.mark.skipif(not os.path.exists(SF), reason="no test data")
def test_query_against_brute_force(spark):
    got = {r.doc_id: r for r in lm.op11_lm_scoring(spark, SF).collect()}
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    out = {i: zlib.crc32(str(i).encode()) % 7 == 2 for i, _ in rows}
    brute = Brute([t for i, t in rows if not out[i]])
    assert len(got) == len(rows)
    for i, t in rows:
        n, known, base, score = brute.judged(t)
        r = got[i]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (out[i], n, known, brute.n)
        assert r.base_score == pytest.approx(base, rel=1e-9) and r.score == pytest.approx(score, rel=1e-9)
    unseen = [r for r in got.values() if r.held_out]
    assert sum(r.score for r in unseen) > sum(r.base_score for r in unseen)
