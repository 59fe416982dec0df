import hashlib
import random

import numpy as np

from sonolith.llm import near_dedup as N
from sonolith.llm.text_arrays import word_hashes


def labelled(text):
    words, offsets = word_hashes([text.encode()])
    return N.shingles(words[: offsets[1]])


def lcs(a, b):
    """Plain dynamic programming."""
    d = np.zeros((len(a) + 1, len(b) + 1), int)
    for i in range(len(a)):
        for j in range(len(b)):
            d[i + 1, j + 1] = d[i, j] + 1 if a[i] == b[j] else max(d[i, j + 1], d[i + 1, j])
    return d[-1, -1]


def brute_classes(rows):
    """Connected components over all pairs of texts at 0.8 or more, by the least id."""
    prints = {t or "": labelled(t or "") for _, t in rows}
    names = list(prints)
    root = {t: t for t in names}

    def find(t):
        while root[t] != t:
            t = root[t]
        return t

    for i, x in enumerate(names):
        for y in names[:i]:
            a, b = prints[x], prints[y]
            shared = len(set(a.tolist()) & set(b.tolist()))
            if not shared or shared / (len(a) + len(b) - shared) < 0.8:
                continue  # no alignment has more than what they share
            c = lcs(a.tolist(), b.tolist()) if len(a) and len(b) else 0
            if c and c / (len(a) + len(b) - c) >= 0.8:
                root[find(x)] = find(y)
    least = {}
    for ident, t in rows:
        r = find(t or "")
        if ident is not None:
            least[r] = min(ident, least.get(r, ident))
    return sorted((str(i), str(least.get(find(t or "")))) for i, t in rows)


def family(seed, n, words, edits):
    rng = random.Random(seed)
    base = [rng.choice("abcdefghij") + str(rng.randrange(200)) for _ in range(words)]
    out = []
    for _ in range(n):
        w = list(base)
        for _ in range(rng.randrange(edits + 1)):
            at = rng.randrange(len(w))
            k = rng.randrange(3)
            if k == 0:
                w[at] = f"z{rng.randrange(1000)}"
            elif k == 1:
                w.insert(at, f"y{rng.randrange(1000)}")
            elif len(w) > 10:
                del w[at]
        out.append(" ".join(w))
    return out


def test_alignment_equals_plain_dynamic_programming():
    for seed in range(30):
        x, y = family(seed, 2, 120, 10)
        a, b = labelled(x), labelled(y)
        c = lcs(a.tolist(), b.tolist())
        s = c / (len(a) + len(b) - c)
        assert abs(N.aligned_similarity(a, b) - (s if s >= 0.8 else 0)) < 1e-12


def test_order_counts():
    w = [f"w{i}" for i in range(100)]
    a, b = labelled(" ".join(w)), labelled(" ".join(w[50:] + w[:50]))
    assert N.aligned_similarity(a, b) == 0 and N.aligned_similarity(a, a) == 1
    assert not set(N.sketch(a, 24, 60).tolist()) & set(N.sketch(b, 24, 60).tolist())


def test_sketches_don_t_depend_on_chunks(monkeypatch):
    a = labelled(family(1, 1, 400, 0)[0])
    whole = N.sketch(a).tolist()
    monkeypatch.setattr(N, "CELLS", 500)
    assert N.sketch(a).tolist() == whole


def test_classes_match_brute_force(spark):
    texts = [t for s in range(6) for t in family(s, 9, 60 + 10 * s, 5)]
    texts += ["short text", "Short TEXT!", "", None, "a b", "w " * 60, "w " * 61, family(50, 1, 3000, 0)[0], family(50, 1, 3000, 0)[0] + " tail"]
    rows = list(enumerate(texts)) + [(200, texts[0]), (201, texts[0]), (None, texts[5]), (None, "only nulls here"), (3, texts[3])]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").selectExpr("*", "'x' as node", "1 as class_id", "2 as key")
    got = sorted((str(r.doc_id), str(r.class_id)) for r in N.near_duplicate_classes(docs).collect())
    assert got == brute_classes(rows)


def test_a_large_family_stays_together(spark):
    texts = family(7, 400, 150, 2)
    rows = list(enumerate(texts)) + [(1000 + i, t) for i, t in enumerate(family(8, 30, 150, 1))]
    got = N.near_duplicate_classes(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()
    assert len(got) == len(rows) and {r.class_id for r in got} == {0, 1000}


def test_a_branch_far_from_the_centre_of_its_family(spark):
    """Texts around a base, and texts around an edit of it that is under 0.8 to everything near the base."""
    base = family(9, 1, 200, 0)[0].split()
    branch = [w if i % 20 else f"q{i}" for i, w in enumerate(base)]
    rng = random.Random(1)

    def near(words, tag):
        out = list(words)
        for _ in range(2):
            out[rng.randrange(len(out))] = f"{tag}{rng.randrange(10**6)}"
        return " ".join(out)

    rows = [(i, near(base, "a")) for i in range(60)] + [(100 + i, near(branch, "b")) for i in range(25)]
    got = {r.doc_id: r.class_id for r in N.near_duplicate_classes(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    assert sorted((str(k), str(v)) for k, v in got.items()) == brute_classes(rows)
    assert set(got.values()) == {0, 100}


def test_keep_one(spark):
    rows = [(5, "a b c d e f g"), (2, "a b c d e f g"), (None, "x y z"), (9, "other text here")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").selectExpr("*", "doc_id * 2 as n_links")
    kept = N.keep_one(docs)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == {2, None, 9}


def test_keep_one_row_of_repeated_and_null_ids(spark):
    a, b, c = "a b c d e f g", "quite another text than that", "x y z"
    rows = [(1, a), (3, a), (3, b), (3, b), (None, c), (None, c), (None, a), (7, None), (8, "")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    assert sorted(((r.doc_id, r.text) for r in N.keep_one(docs).collect()), key=str) == sorted([(1, a), (3, b), (None, c), (7, None)], key=str)


def test_empty_table(spark):
    assert N.near_duplicate_classes(spark.createDataFrame([], "doc_id bigint, text string")).count() == 0


def apart_from_centre(seed):
    """A text and two edits of it that are under 0.8 to it and at 0.8 to each other: eight places differ in all three, one only from the first."""
    rng = random.Random(seed)
    centre = [f"c{rng.randrange(10**9)}" for _ in range(400)]
    places = range(20, 380, 40)
    edits = [["same" if i == 20 else f"{tag}{i}" if i in places else w for i, w in enumerate(centre)] for tag in "xy"]
    return [" ".join(w) for w in (centre, *edits)]


def test_members_apart_from_their_centre_meet(spark, monkeypatch):
    texts = apart_from_centre(13)
    c, x, y = map(labelled, texts)
    assert N.aligned_similarity(c, x) == N.aligned_similarity(c, y) == 0 and N.aligned_similarity(x, y) >= 0.8
    # sketches of their differences to the centre don't bring them together
    assert not set(N.sketch(np.setxor1d(c, x), 72, 3).tolist()) & set(N.sketch(np.setxor1d(c, y), 72, 3).tolist())
    # all three share one bucket, and the first is the heaviest
    keys = dict(zip(texts, ([1, 2, 3], [1, 2], [1, 3]), strict=True))
    nodes = spark.createDataFrame([(bytearray(hashlib.md5(t.encode()).digest()), k) for t, k in keys.items()], "node binary, keys array<bigint>")
    monkeypatch.setattr(N, "sketches", lambda *_: nodes)
    rows = list(enumerate(texts))
    got = N.near_duplicate_classes(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()
    assert sorted((str(r.doc_id), str(r.class_id)) for r in got) == brute_classes(rows) and {r.class_id for r in got} == {0, 1}


def bucket_of(monkeypatch, spark, texts):
    """All texts in one bucket."""
    nodes = spark.createDataFrame([(bytearray(hashlib.md5(t.encode()).digest()), [1]) for t in set(texts)], "node binary, keys array<bigint>")
    monkeypatch.setattr(N, "sketches", lambda *_: nodes)


def test_every_pair_of_a_bucket_that_can_link_meets(spark, monkeypatch):
    """One bucket of unlinked texts, pairs of edits and texts of other lengths; a centre's pairs are dealt into many blocks."""
    monkeypatch.setattr(N, "BLOCK", 4)
    texts = [t for s in range(30) for t in family(100 + s, 2, 150, 1)]
    texts += [" ".join(t.split()[: 125 + i]) for i, t in enumerate(texts[:20])] + ["a b", "a b c", "", "w " * 300, "w " * 340]
    rows = list(enumerate(texts))
    bucket_of(monkeypatch, spark, texts)
    got = N.near_duplicate_classes(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()
    assert sorted((str(r.doc_id), str(r.class_id)) for r in got) == brute_classes(rows)


def test_edits_under_the_similarity_do_not_meet(spark):
    """Texts that share 300 of 345 words are at 0.77: none links, and pairs don't grow with the square of their number."""
    rng = random.Random(4)
    base = [f"c{i}" for i in range(300)]
    counts = []
    for n in (100, 200):
        texts = []
        for _ in range(n):
            own = [f"u{rng.randrange(10**9)}" for _ in range(45)]
            texts.append(" ".join(base[:150] + own + base[150:]))
        nodes = [bytearray(hashlib.md5(t.encode()).digest()) for t in texts]
        frame = spark.createDataFrame(list(zip(nodes, texts, strict=True)), "node binary, text string")
        shared = spark.createDataFrame([(1, x, n) for x in nodes], "key bigint, node binary, n bigint")
        none = spark.createDataFrame([], "node binary, root binary")
        counts.append(N.remaining_pairs(shared, none, frame).count())
    assert counts[1] <= 2 * max(counts[0], 1)
    # a pair at 0.8 among them does
    near = texts[0].split()
    near[20] = "z"
    node = bytearray(hashlib.md5(" ".join(near).encode()).digest())
    frame = frame.union(spark.createDataFrame([(node, " ".join(near))], frame.schema))
    shared = spark.createDataFrame([(1, x, n + 1) for x in [*nodes, node]], shared.schema)
    assert {frozenset(map(bytes, r)) for r in N.remaining_pairs(shared, none, frame).collect()} >= {frozenset(map(bytes, (nodes[0], node)))}
