import hashlib
import re

import pytest

from sonolith.llm import decontamination as D


def words(t):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if c < "\x80" else c for c in t or ""))


def brute(docs, items, size=10):
    windows = {}
    for item, t in items:
        w = words(t)
        for i in range(max(1, len(w) - size + 1) if w else 0):
            windows.setdefault(tuple(w[i : i + size]), set()).add(str(item))
    out = []
    for ident, t in docs:
        w, hit, held = words(t), set(), set()
        for p, names in windows.items():
            for i in range(len(w) - len(p) + 1):
                if tuple(w[i : i + len(p)]) == p:
                    hit |= set(range(i, i + len(p)))
                    held |= names
        out.append((ident, len(w), len(hit), len(held), hashlib.sha256(",".join(sorted(held)).encode()).hexdigest(), bool(hit)))
    return sorted(out, key=str)


PHRASE = "Alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu"
ITEMS = [(1, PHRASE), (2, "short ÉÉ item"), (3, ""), (4, None), (10, "x " + PHRASE), (5, "a a a a a a a a a a a")]
DOCS = [
    (1, f"zzz {PHRASE.upper()}! yyy {PHRASE}"), (2, "nothing here"), (None, "a short ÉÉ item."), (3, None), (4, ""), (5, "a " * 25), (1, "short éé item"),
    (6, "alpha beta gamma delta epsilon zeta eta theta iota kappa"), (7, "w " * 30_000 + PHRASE), (2, "nothing here"), (8, "kappa iota theta eta zeta epsilon delta gamma beta alpha"),
]


def frames(spark, docs=DOCS, items=ITEMS):
    d = spark.createDataFrame(docs, "doc_id bigint, text string").selectExpr("doc_id", "text", "1 as id", "2 as term", "3 as phrase")
    return d, spark.createDataFrame(items, "item_id bigint, text string").selectExpr("item_id", "text", "1 as items")


def test_matches_brute_force(spark):
    got = D.contamination(*frames(spark)).drop("items").collect()
    assert sorted(map(tuple, got), key=str) == brute(DOCS, ITEMS)


def test_lists_beyond_the_broadcasts_give_the_same(spark, monkeypatch):
    for name in ("BROADCAST_TERMS", "BROADCAST_KEYS", "BROADCAST_WINDOWS"):
        monkeypatch.setattr(D, name, 0)
    got = D.contamination(*frames(spark)).drop("items").collect()
    assert sorted(map(tuple, got), key=str) == brute(DOCS, ITEMS)


@pytest.mark.parametrize("docs, items", [([], ITEMS), (DOCS, []), ([], [])])
def test_empty_tables(spark, docs, items):
    got = D.contamination(*frames(spark, docs, items)).drop("items").collect()
    assert sorted(map(tuple, got), key=str) == brute(docs, items)


def test_decontaminate_keeps_columns_and_clean_rows(spark):
    d, items = frames(spark)
    kept = D.decontaminate(d, items)
    assert kept.columns == d.columns
    assert sorted(r.doc_id for r in kept.collect()) == [1, 2, 2, 3, 4, 8]  # the clean one of the two rows of id 1 stays


def test_repeated_contaminated_rows(spark):
    docs = [(1, f"zzz {PHRASE}"), (1, f"zzz {PHRASE}"), (None, f"yyy {PHRASE}"), (None, f"yyy {PHRASE}"), (5, "a " * 25), (5, "a " * 25), (5, "a " * 25), (6, "clean"), (7, PHRASE[:20]), (7, PHRASE[:20])]
    d, items = frames(spark, docs)
    assert sorted(map(tuple, D.contamination(d, items).drop("items").collect()), key=str) == brute(docs, ITEMS)
    assert sorted(r.doc_id for r in D.decontaminate(d, items).collect()) == [6, 7, 7]


def brute_near(docs, items, slop, counts, size=10):
    """counts: occurrences of each word in docs; the rarest word of a window, the first of equals, is at its place."""
    windows = {tuple(w[i : i + size]) for _, t in items for w in [words(t)] for i in range(max(1, len(w) - size + 1) if w else 0)}
    out = set()
    for ident, t in docs:
        w = words(t)
        for p in windows:
            if not all(counts.get(x) for x in p):
                continue
            lead = min(range(len(p)), key=lambda i: (counts[p[i]], i))
            for s in range(-len(p), len(w)):
                if not (0 <= s + lead < len(w) and w[s + lead] == p[lead]):
                    continue
                far = [min((abs(k) for k in range(-slop, slop + 1) if 0 <= s + i + k < len(w) and w[s + i + k] == x), default=None) for i, x in enumerate(p) if i != lead]
                if None not in far:
                    out.add((str(ident), s, max(far, default=0), p))
    return out


@pytest.mark.parametrize("slop", [0, 1, 3])
def test_near_matches_brute_force(spark, slop):
    import collections
    import random

    rng = random.Random(slop)
    items = [(1, "one two three four five"), (2, "six seven"), (3, None), (4, "seven seven one six two")]
    docs = [(i, " ".join(rng.choice("one two three four five six seven x".split()) for _ in range(30))) for i in range(40)]
    docs += [(100, "one two x three four five"), (101, "two one three five four"), (102, "ONE, two. three-four five"), (None, "six y seven"), (103, None), (104, "four five one two three")]
    counts = collections.Counter(x for _, t in docs for x in words(t))
    d, b = spark.createDataFrame(docs, "doc_id bigint, text string"), spark.createDataFrame(items, "item_id bigint, text string")
    got = [(str(r.doc_id), r.start, r.gap, tuple(r.phrase)) for r in D.near_matches(d, b, slop).collect()]
    assert len(got) == len(set(got)) and set(got) == brute_near(docs, items, slop, counts)


def test_ids_of_any_type(spark):
    docs = spark.createDataFrame([("a", PHRASE), ("b", "clean"), ("b", PHRASE), ("b", PHRASE), (None, "x")], "doc_id string, text string")
    items = frames(spark)[1]
    got = sorted((str(r.doc_id), r.contaminated) for r in D.contamination(docs, items).collect())
    assert got == [("None", False), ("a", True), ("b", False), ("b", True), ("b", True)]
    assert sorted(str(r.doc_id) for r in D.decontaminate(docs, items).collect()) == ["None", "b"]
