import random
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from sonolith.llm import language_id as L
from sonolith.llm import quality_classifier as C
from sonolith.llm import text_arrays as A
from sonolith.llm import toxicity as T

EN, FR = "the of and to in is that for it with as was on be at by".split(), "le la les des une que est pour dans qui sur pas avec être à été".split()


def prose(rng, words, n):
    return " ".join(rng.choice(words) + rng.choice(["", "", "er", "ion"]) for _ in range(n))


# ---- word hashes


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text(alphabet="aB9é日 \n.,-\x00", max_size=30), max_size=6))
def test_word_hashes_follow_words(texts):
    import re

    words = [re.findall(r"[0-9a-z\x80-\U0010ffff]+", "".join(c.lower() if c < "\x80" else c for c in t)) for t in texts]
    for first, encoded in A.buffers(texts):
        hashes, offsets = A.word_hashes(encoded)
        for i in range(len(encoded)):
            mine = words[first + i]
            assert offsets[i + 1] - offsets[i] == len(mine)
            assert [int(h) for h in hashes[offsets[i] : offsets[i + 1]]] == [A.hash_of(w) for w in mine]


def test_buffers_are_bounded(monkeypatch):
    monkeypatch.setattr(A, "BUFFER", 100)
    got = list(A.buffers(["x" * 60, None, "y" * 60, "z" * 500, ""]))
    assert [f for f, _ in got] == [0, 2, 3, 4] and sum(len(e) for _, e in got) == 5


# ---- toxicity


def brute_nearest(vectors, ids, query, k):
    cosines = vectors @ query
    order = np.lexsort((ids, -np.round(cosines, 12)))
    return [(int(ids[i]), round(float(cosines[i]), 9)) for i in order[:k] if cosines[i] > 0]


@pytest.mark.parametrize("block, frequent", [(1, 20), (7, 3), (64, 20), (16, 1)])
def test_block_max_search_is_exact(block, frequent, monkeypatch):
    monkeypatch.setattr(T, "FREQUENT", frequent)
    rng = np.random.default_rng(block)
    n, terms = 300, 40
    dense = rng.random((n, terms)) * (rng.random((n, terms)) < np.linspace(0.01, 0.3, terms))
    dense[5] = dense[6]  # a tie
    norms = np.linalg.norm(dense, axis=1, keepdims=True)
    dense = np.divide(dense, norms, out=np.zeros_like(dense), where=norms > 0)
    ids = rng.permutation(n) * 3
    index = T.BlockMaxIndex.build(ids, *np.nonzero(dense), dense[np.nonzero(dense)], terms, block)
    queries = np.concatenate([dense[:40], np.zeros((1, terms))])
    entries = (*np.nonzero(queries), queries[np.nonzero(queries)])
    where, cosines = index.search(len(queries), *entries, 9)
    for q, w, c in zip(queries, where, cosines, strict=True):
        assert [(int(ids[i]), round(float(x), 9)) for i, x in zip(w, c, strict=True) if i >= 0] == brute_nearest(dense, ids, q, 9)
    where, _ = index.search(len(queries), *entries, 9, skip=np.r_[np.arange(40), -1])
    assert not any(i in w for i, w in enumerate(where[:40]))


def test_isotonic_is_monotone_and_keeps_the_mean():
    rng = np.random.default_rng(0)
    x, w = rng.random(200), rng.random(200) + 0.1
    y = (rng.random(200) < x).astype(float)
    xs, ys = T.isotonic(x, y, w)
    fitted = np.interp(x, xs, ys)
    assert (np.diff(ys) >= 0).all() and abs((w * fitted).sum() - (w * y).sum()) < 1e-9


def toxic_rows(n=600):
    rng = random.Random(2)
    rows = []
    for i in range(n):
        bad = i % 5 == 0
        words = prose(rng, EN, rng.choice([10, 60])).split()
        for _ in range(3 * bad):
            words.insert(rng.randrange(len(words)), rng.choice(["idiot", "moron", "scum"]))
        rows.append((i, " ".join(words), int(bad)))
    return rows


def test_toxicity_on_held_out_rows(spark):
    rows = toxic_rows()
    docs = spark.createDataFrame([r[:2] for r in rows] + [(None, None), (9000, ""), (9001, "idiot " * 20_000), (3, rows[3][1])], "doc_id bigint, text string").selectExpr("*", "1 as toxic", "'n' as neighbours")
    labels = spark.createDataFrame([(r[0], r[2]) for r in rows] + [(None, 1), (77, None)], "doc_id bigint, toxic int").selectExpr("*", "'x' as text")
    got = {r.doc_id: r for r in T.score_documents(docs, T.fit(docs, labels)).collect()}
    assert len(got) == len(rows) + 3 and all(0 <= r.score <= 1 for r in got.values())
    held = [(got[i].score >= 0.7, bool(y)) for i, _, y in rows if zlib.crc32(str(i).encode()) % 3 == 1]
    assert sum(a == b for a, b in held) / len(held) > 0.97
    assert got[9001].score > 0.7 and got[9000].score < 0.3 and got[0].neighbours
    assert all(zlib.crc32(str(n).encode()) % 3 != 1 for r in got.values() for n in r.neighbours)


def test_scores_follow_all_terms_of_the_texts(spark):
    """Against vectors, neighbours and votes computed from words and stems in Python, term by term."""
    import collections
    import math
    import re

    rows = toxic_rows(160) + [(700, "Réeuxment réeuxan moron", 1), (701, None, 0), (702, "", 0)]
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id bigint, text string")
    model = T.fit(docs, spark.createDataFrame([(r[0], r[2]) for r in rows], "doc_id bigint, toxic int"))
    got = {r.doc_id: r for r in T.score_documents(docs, model).collect()}

    def terms(text):
        words = re.findall(r"[0-9a-z\x80-\U0010ffff]+", "".join(c.lower() if c < "\x80" else c for c in text or ""))
        return collections.Counter(words + [w[:5] + "~" for w in words if len(w) > 5])

    counted = {i: terms(t) for i, t, _ in rows}
    held = collections.Counter(w for c in counted.values() for w in c)
    unique = {}
    for i, t, y in rows:
        if zlib.crc32(str(i).encode()) % 3 != 1:
            unique.setdefault(t or "", (i, y))
    examples = dict(unique.values())
    n = [sum(y == k for y in examples.values()) for k in (0, 1)]
    by = [collections.Counter(w for i, y in examples.items() if y == k for w in counted[i]) for k in (0, 1)]
    weight = {}
    for w in set(by[0]) | set(by[1]):
        odds = math.log((by[1][w] + 0.5) / (n[1] + 1)) - math.log((by[0][w] + 0.5) / (n[0] + 1))
        weight[w] = math.log((1 + len(rows)) / (1 + held[w])) * odds**2 / (1 / (by[1][w] + 0.5) + 1 / (by[0][w] + 0.5))

    def vector(i):
        v = {w: (1 + math.log(c)) * weight[w] for w, c in counted[i].items() if w in weight}
        size = math.sqrt(sum(x * x for x in v.values()))
        return {w: x / size for w, x in v.items()} if size else {}

    vectors = {i: vector(i) for i in examples}
    for i, t, _ in rows:
        q, mean = vector(i), []
        for k in (0, 1):
            near = sorted((-sum(q[w] * vectors[e].get(w, 0) for w in q), e) for e, y in examples.items() if y == k)
            near = [x for x in near if x[0] < -1e-12][: T.NEIGHBOURS]
            mean.append(-sum(c for c, _ in near) / max(len(near), 1))
        want = float(np.interp(mean[1] / sum(mean), *model.knots)) if sum(mean) > 0 else model.empty_share
        assert got[i].score == pytest.approx(want, abs=1e-6), (i, t)


def test_long_and_repeated_labelled_texts_are_drawn(spark):
    from sonolith.llm import samples

    docs = spark.createDataFrame([(1, "long " * 40_000), (1, "another"), (2, None), (3, "x"), (3, "x"), (None, "y")], "doc_id bigint, text string").selectExpr("*", "'s' as label", "2 as size")
    labels = spark.createDataFrame([(1, 1), (1, 0), (2, 1), (3, 0), (None, 1), (4, 1)], "doc_id bigint, toxic int")
    rows, counts = samples.training_texts(docs, labels, "toxic", 100)
    assert sorted((r.doc_id, len(r.text), r.toxic) for r in rows) == [(1, 7, 1), (1, 200_000, 1), (2, 0, 1), (3, 1, 0)] and counts == {1: 3, 0: 2}


@pytest.mark.parametrize("labels", [[], [(1, 1), (2, 1)], [(1, 0)]])
def test_toxicity_without_both_kinds(spark, labels):
    docs = spark.createDataFrame([(1, "a"), (2, "b"), (3, None)], "doc_id bigint, text string")
    model = T.fit(docs, spark.createDataFrame(labels, "doc_id bigint, toxic int"))
    assert {r.score for r in T.score_documents(docs, model).collect()} <= {0.0, 1.0}
    assert T.score_documents(docs.where("false"), model).count() == 0


# ---- language


def test_tables_equal_the_convolution():
    rng = np.random.default_rng(1)
    net = L.Network(["a", "b"], [rng.normal(size=(w, 256, 3)).astype(np.float32) for w in L.WIDTHS], [rng.normal(size=3).astype(np.float32) for _ in L.WIDTHS], rng.normal(size=(9, 2)), np.zeros(2))
    x = rng.integers(0, 256, (5, 20)).astype(np.uint8)
    hot = np.eye(256)[x]
    want = []
    for k, b in zip(net.kernels, net.biases, strict=True):
        out = np.stack([sum(hot[:, i + j] @ k[j] for j in range(len(k))) for i in range(20 - len(k) + 1)], axis=1)
        want.append(np.maximum(out.max(axis=1) + b, 0))
    assert np.allclose(net.features(x), np.concatenate(want, axis=1), atol=1e-4)


@settings(max_examples=100, deadline=None)
@given(st.integers(0, 700))
def test_windows_hold_every_filter_position(n):
    b = np.arange(n) % 251
    w, sizes = L.windows_of(b.astype(np.uint8), 32)
    held = {tuple(r[i : i + 4]) for r in w for i in range(29)}
    assert all(tuple(b[i : i + 4]) in held for i in range(n - 3)) and len(sizes) == len(w)


def test_language_on_held_out_rows(spark):
    rng = random.Random(4)
    rows = [(i, prose(rng, FR if i % 3 == 0 else EN, rng.choice([15, 80])), "fr" if i % 3 == 0 else "en") for i in range(400)]
    more = [(None, None, None), (900, "", "en"), (901, "123 ... !!", "fr"), (902, prose(rng, FR, 9000), None), (3, rows[3][1], "fr")]
    docs = spark.createDataFrame(rows + more, "doc_id bigint, text string, lang string").selectExpr("*", "0.5 as score", "'q' as lang_pred")
    got = {r.doc_id: (r.lang_pred, r.score) for r in L.identify(docs, L.fit(docs)).collect()}
    held = [(got[i][0], y) for i, _, y in rows if zlib.crc32(str(i).encode()) % 4 == 2]
    assert sum(a == b for a, b in held) / len(held) > 0.97
    assert got[None] == got[900] == got[901] == ("und", 0.0) and got[902][0] == "fr"
    kept = L.confident(docs)
    assert kept.columns == docs.columns and kept.where("text is null or doc_id in (900, 901)").count() == 0 and kept.count() >= 390


def test_no_labels_is_unknown(spark):
    docs = spark.createDataFrame([(1, "a text")], "doc_id bigint, text string").selectExpr("*", "cast(null as string) as lang")
    assert L.identify(docs, L.fit(docs)).first().lang_pred == "und"
    assert L.identify(docs.where("false"), None).count() == 0


# ---- quality


def quality_rows(n=500):
    rng = random.Random(6)
    rows = []
    for i in range(n):
        t = prose(rng, EN, rng.choice([20, 90]))
        bad = i % 6 == 0
        rows.append((i, t.upper().replace(" ", "!! ") if bad else t + ".", f"s{i % 7}", "en", len(t), None if i % 2 else int(not bad), int(not bad)))
    return rows


def test_quality_on_rows_without_labels(spark):
    rows = quality_rows()
    shape = "doc_id bigint, text string, source string, lang string, n_chars bigint"
    docs = spark.createDataFrame([r[:5] for r in rows] + [(None, None, None, None, None), (9000, "", "s1", "en", 0), (9001, "x y " * 40_000, None, "zz", -4), rows[0][:5]], shape).selectExpr("*", "1 as quality", "2 as content", "3 as metadata")
    labels = spark.createDataFrame([(r[0], r[5]) for r in rows], "doc_id bigint, quality int")
    views = C.fit(docs, labels)
    got = {r.doc_id: r.score for r in C.score_documents(docs, views).collect()}
    assert all(0 <= s <= 1 for s in got.values())
    free = [(got[i] >= 0.5, bool(y)) for i, *_, label, y in rows if label is None]
    assert sum(a == b for a, b in free) / len(free) > 0.97
    kept = C.keep_good(docs, labels)
    assert kept.columns == docs.columns and 400 <= kept.count() <= 425


@pytest.mark.parametrize("labels, share", [([], 0.5), ([(1, 1)], 1.0)])
def test_quality_without_both_kinds(spark, labels, share):
    docs = spark.createDataFrame([(1, "a", "s", "en", 1)], "doc_id bigint, text string, source string, lang string, n_chars bigint")
    views = C.fit(docs, spark.createDataFrame(labels, "doc_id bigint, quality int"))
    assert C.score_documents(docs, views).first().score == share and C.score_documents(docs.where("false"), views).count() == 0


def test_views_never_count_against_themselves():
    rng = np.random.default_rng(3)
    y = np.repeat([0.0, 1.0], 200)
    logits = np.stack([y * 4 - 2 + rng.normal(0, 1, 400), 1 - y + rng.normal(0, 1, 400)], axis=1)
    combined = C.combine(logits, y, np.ones(400))
    assert combined.weights[0] > 0 and combined.weights[1] == 0
    assert ((combined.logit(logits) > 0) == (y == 1)).mean() > 0.9
    assert (C.combine(-logits, y, np.ones(400)).weights[:-1] >= 0).all()


def test_quality_scores_follow_the_views(spark):
    """Each row's score from its own features, one row at a time."""
    rows = quality_rows(300)
    docs = spark.createDataFrame([r[:5] for r in rows], "doc_id bigint, text string, source string, lang string, n_chars bigint")
    views = C.fit(docs, spark.createDataFrame([(r[0], r[5]) for r in rows], "doc_id bigint, quality int"))
    got = {r.doc_id: r for r in C.score_documents(docs, views).collect()}
    for r in rows[::25]:
        import pandas as pd

        a = float(views.content.logit(C.Content.of([r[1]]))[0])
        b = float(views.metadata.logit(C.metadata_features(pd.DataFrame([dict(zip(("text", "source", "lang", "n_chars"), r[1:5], strict=True))])))[0])
        z = ((np.array([a, b]) - views.combined.mean) / views.combined.scale) @ views.combined.weights[:2] + views.combined.weights[2]
        assert got[r[0]].content == pytest.approx(a) and got[r[0]].metadata == pytest.approx(b)
        assert got[r[0]].score == pytest.approx(1 / (1 + np.exp(-z)), abs=1e-9)


def test_views_teach_each_other():
    rng = np.random.default_rng(0)
    y = np.repeat([0.0, 1.0], 30)
    content, meta = y[:, None] * 2 + rng.normal(0, 0.5, (60, 1)), y[:, None] * 4 + rng.normal(0, 0.5, (60, 1))
    truth = np.repeat([0.0, 1.0], 300)
    pool = (truth[:, None] * 2 + rng.normal(0, 0.5, (600, 1)), truth[:, None] * 4 + rng.normal(0, 0.5, (600, 1)))
    few = np.r_[0:3, 30:33]
    a, b = C.co_train((content[few], meta[few]), y[few], np.ones(6), pool)
    assert ((a.logit(pool[0]) > 0) == truth).mean() > 0.95 and ((b.logit(pool[1]) > 0) == truth).mean() > 0.98


def test_the_content_view_reads_words(spark):
    """Texts alike in all figures, good or bad by their words alone; the other columns say nothing."""
    rng = random.Random(8)
    good, bad = [f"ga{i}b" for i in range(30)], [f"ba{i}g" for i in range(30)]
    rows = [(i, " ".join(rng.choice(good if i % 2 else bad) for _ in range(40)), "s", "en", 200) for i in range(400)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, source string, lang string, n_chars bigint")
    labels = spark.createDataFrame([(i, i % 2) for i in range(0, 400) if i % 3 != 0], "doc_id bigint, quality int")
    got = {r.doc_id: r for r in C.score_documents(docs, C.fit(docs, labels)).collect()}
    free = [(got[i].score >= 0.5) == bool(i % 2) for i in range(0, 400, 3)]
    assert sum(free) / len(free) > 0.95


def test_a_texts_own_words_do_not_give_its_label_away():
    """Words of one text only say nothing of it: without its own share their odds are those of words never seen."""
    texts = [" ".join(f"w{i}x{j}" for j in range(20)) for i in range(60)]
    y = np.arange(60) % 2.0
    view = C.ContentView().fit(C.Content.of(texts), y, np.ones(60))
    assert abs(view.model.weights[-2]) < 3 and (np.abs(view.logit(C.Content.of(["new words only", ""]))) < 3).all()


def test_content_of_some_rows_is_that_of_their_texts():
    texts = ["a b c", None, "", "a a b", "long " * 300]
    x, some = C.Content.of(texts), np.array([3, 0, 1])
    a, b = x.take(some), C.Content.of([texts[i] for i in some])
    assert (a.slots == b.slots).all() and (a.starts == b.starts).all() and (a.figures == b.figures).all()
    c, d = x.plus(a), C.Content.of([*texts, *(texts[i] for i in some)])
    assert (c.slots == d.slots).all() and (c.starts == d.starts).all() and len(c) == 8


def test_folds_without_a_label_do_not_calibrate(spark):
    rows = quality_rows(60)
    docs = spark.createDataFrame([r[:5] for r in rows], "doc_id bigint, text string, source string, lang string, n_chars bigint")
    one = next(r[0] for r in rows if not r[6] and zlib.crc32(str(r[0]).encode()) % C.PARTS != 1)
    labels = spark.createDataFrame([(r[0], 1) for r in rows if r[6]][:30] + [(one, 0)], "doc_id bigint, quality int")
    scores = [r.score for r in C.score_documents(docs, C.fit(docs, labels)).collect()]
    assert len(set(scores)) > 1 and all(0 <= s <= 1 for s in scores)


def test_a_content_view_lays_out_a_bounded_part_of_its_slots():
    import tracemalloc

    rng = np.random.default_rng(2)
    sizes = rng.integers(0, 4000, 1500)
    x = C.Content(rng.random((1500, 4)), np.concatenate([[0], np.cumsum(sizes)]), rng.integers(0, C.GRAMS, sizes.sum()).astype(np.int32))
    y, w = rng.integers(0, 2, 1500).astype(float), rng.random(1500)
    tracemalloc.start()
    view = C.ContentView().fit(x, y, w)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 120e6  # 3 million slots: eight bytes of each take 24 MB, and a score of such arrays were there at once
    owner, odds = np.repeat(np.arange(1500), sizes), C._odds
    held, total = [np.bincount(x.slots, (w * (y == k))[owner], C.GRAMS) for k in (0, 1)], [(w * (y == k)).sum() for k in (0, 1)]
    assert np.array_equal(view.odds, odds(held[1], total[1], held[0], total[0]).astype(np.float32))
    own = [(w * (y == k))[owner] for k in (0, 1)]
    apart = np.bincount(owner, odds(held[1][x.slots] - own[1], total[1] - own[1], held[0][x.slots] - own[0], total[0] - own[0]), 1500) / np.maximum(sizes, 1)
    want = C.Logistic().fit(np.column_stack([x.figures, apart]), y, w)
    assert np.array_equal(view.model.weights, want.weights)
    rows = rng.permutation(1500)[:700]
    assert np.array_equal(x.take(rows).slots, np.concatenate([x.slots[x.starts[r] : x.starts[r + 1]] for r in rows])) and len(x.take(rows[:0]).slots) == 0
