from itertools import permutations

import pytest
from pyspark.sql import functions as F

from sonolith.llm import filter_audit as fa

SCHEMA = "doc_id long, text string, source string"


def brute_masks(rows):
    """(doc_id, part, mask) by the conditions' words."""
    import re

    out = []
    for doc_id, text, source in rows:
        t = text or ""
        words = [w for w in re.split(r"[\x20\x09-\x0D]+", t) if w]
        smaller = any(d is not None and doc_id is not None and d < doc_id and (o or "") == t for d, o, _ in rows)
        fails = [len(words) < 50, 100 * len(set(words)) < 65 * len(words), 100 * sum("A" <= c <= "Z" for c in t) > 5 * len(t), any(c in "#$%&*|" for c in t), smaller]
        out.append((doc_id, source or "", sum(1 << i for i, f in enumerate(fails) if f)))
    return out


def brute_audit(rows, labels):
    good, toxic = {i for i, q, _ in labels if q == 1 and i is not None}, {i for i, _, x in labels if x == 1 and i is not None}
    masks = brute_masks(rows)
    out = {}
    for part in {m[1] for m in masks}:
        own = [m for m in masks if m[1] == part]
        shapley = dict.fromkeys("ABCDE", 0)
        mine = {}
        for order in map("".join, permutations("ABCDE")):
            left = own
            for step, letter in enumerate(order, 1):
                bit = 1 << "ABCDE".index(letter)
                gone = [m for m in left if m[2] & bit]
                kept = [m for m in left if not m[2] & bit]
                failing = [m for m in own if m[2] & bit]
                shapley[letter] += len(gone)
                mine[order, step] = (len(kept), len(gone), len(failing) - len(gone), sum(m[2] == bit for m in own), sum(m[0] in good for m in gone), sum(m[0] in toxic for m in gone))
                left = kept
        for (order, step), figures in mine.items():
            out[part, order, step] = (*figures, shapley[order[step - 1]])
    return out


def documents():
    words = " ".join(f"w{i}" for i in range(60))
    rows = [(i, words, "hot") for i in range(40, 0, -1)]  # copies over many ranges
    rows += [(3, words, "hot"), (3, words, "other"), (None, words, "hot"), (None, words, None)]  # repeated and null ids
    rows += [(100, None, None), (101, "", "hot"), (102, "   \t", "hot"), (103, words.upper(), "a.b"), (104, words + " $", "hot"), (105, "go " * 80, "hot"), (106, "\xa0é 漢字 " * 30, "other")]
    return [*rows, (107, "word " * 30_000, "long"), (108, "word " * 30_000, "hot"), (1, words + " x", "hot")]


LABELS = [(1, 1, 0), (1, 0, 1), (2, 1, 1), (104, 0, 1), (105, None, 1), (None, 1, 1), (103, 1, None), (102, 1, 0)]


@pytest.mark.parametrize("collide", [False, True])
def test_masks_and_counters_equal_brute_force(spark, collide):
    """collide: fingerprints of a few values only, so that ranges begin and end inside texts of one fingerprint."""
    rows = documents()
    docs = spark.createDataFrame(rows, SCHEMA).repartition(7)
    fingerprint = (lambda t: F.pmod(F.length(t), F.lit(3)).cast("bigint")) if collide else F.xxhash64
    before = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")  # no range is merged
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "3")
    spark.conf.set("spark.sql.shuffle.partitions", "9")
    try:
        marked = fa.marked(docs, fingerprint=fingerprint)
        assert sorted(map(str, ((r.doc_id, r.part, r.mask) for r in marked.collect()))) == sorted(map(str, brute_masks(rows)))
        labels = spark.createDataFrame(LABELS, "doc_id long, quality int, toxic int")
        got = {(r[0], r[1], r[2]): tuple(r)[3:] for r in fa.audit(fa.counters(marked, labels)).collect()}
        assert got == brute_audit(rows, LABELS) and len(got) == 5 * 600
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", before)
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
        spark.conf.set("spark.sql.shuffle.partitions", "4")


def test_an_empty_table_and_columns_of_clashing_names(spark):
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert fa.audit(fa.counters(fa.marked(spark.createDataFrame([], SCHEMA)), labels)).count() == 0
    rows = [(1, "a", "s", 9, "x", 5.0), (2, "a", "s", 9, "y", 6.0)]
    docs = spark.createDataFrame(rows, SCHEMA + ", mask int, `a.b` string, open double")
    assert sorted(r.mask for r in fa.marked(docs).collect()) == [1, 17]


def test_counters_add_up_over_shards(spark):
    rows = documents()
    labels = spark.createDataFrame(LABELS, "doc_id long, quality int, toxic int")
    marked = fa.marked(spark.createDataFrame(rows, SCHEMA))
    shards = [fa.counters(marked.where(f"coalesce(doc_id, 0) % 2 = {k}"), labels) for k in (0, 1)]
    both = shards[0].union(shards[1]).groupBy("part", "mask").agg(*(F.sum(c).alias(c) for c in ("n", "good", "toxic")))
    assert {tuple(r) for r in both.collect()} == {tuple(r) for r in fa.counters(marked, labels).collect()}
