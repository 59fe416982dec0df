import math

import numpy as np
import pytest

from sonolith.llm import hard_negatives as hn

SCHEMA = "vec_id long, embedding array<float>, label int"


def brute(rows):
    """The contract's rows, pair by pair; of equal ids the least row by label and components."""
    known = {}
    for vec_id, x, label in rows:
        if vec_id is None or label is None or x is None or any(c is None or not math.isfinite(c) or abs(256 * c) >= hn.LARGEST for c in x):
            continue
        label = (label + 1) % 10 if vec_id % 7 == 0 else label
        v = [math.floor(256 * float(np.float32(c))) for c in x]
        known[vec_id] = min(known.get(vec_id, (label, v)), (label, v))
    score = lambda a, b: sum(x * y for x, y in zip(known[a][1], known[b][1], strict=False))
    out = []
    for a in known:
        if a % 50:
            continue
        same = sorted((-score(a, b), b) for b in known if b != a and known[b][0] == known[a][0])[:5]
        other = sorted((-score(a, b), b) for b in known if known[b][0] != known[a][0])
        for p, pid in same:
            fit = [(n, nid) for n, nid in other if -50 * p <= -100 * n <= -95 * p][:3]
            out += [(a, pid, k, nid, -p, -n) for k, (n, nid) in enumerate(fit, 1)]
    return sorted(out)


def mined(spark, rows, **how):
    from pyspark.sql import functions as F

    e = spark.createDataFrame(rows, SCHEMA)
    e = e.withColumn("label", F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label")))
    s = hn.scaled(e)
    got = hn.mine(s, s.where("vec_id % 50 = 0"), **how)
    return sorted(tuple(r) for r in got.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score").collect())


@pytest.mark.parametrize("grid", [True, False])
def test_equals_brute_force_over_blocks(spark, grid):
    """grid: components of a few values, so that scores tie everywhere; a hot label; bad rows; repeated ids; short vectors."""
    rng = np.random.default_rng(3 + grid)
    x = rng.integers(-2, 3, (400, 6)) / 4 if grid else rng.normal(0, 0.3, (400, 6))
    labels = np.where(rng.random(400) < 0.5, 1, rng.integers(0, 4, 400))
    rows = [(int(i), [float(c) for c in x[i]], int(labels[i])) for i in range(400)]
    nan, inf = float("nan"), float("inf")
    rows += [(500, None, 1), (550, [1.0, None], 1), (600, [nan] * 6, 1), (650, [inf] * 6, 2), (700, [1.0] * 6, None), (None, [1.0] * 6, 1), (750, [1e6] * 6, 1), (701, [-inf], 1)]
    rows += [(800, [], 1), (850, [0.5, 0.5], 2), (851, [0.5, 0.5, 0.25, 1.0, 1.0, 1.0, 2.0], 1), rows[50], rows[50], (50, [9.0] * 6, 9)]
    want = brute(rows)
    assert len(want) > 50 and mined(spark, rows, block=64, anchor_block=4) == want


def test_few_or_no_rows(spark):
    assert mined(spark, []) == []
    assert mined(spark, [(50, [1.0], 1)]) == []
    rows = [(50, [1.0], 1), (51, [1.0], 1), (52, [0.75], 2), (53, [0.5], 2), (54, [0.25], 3), (55, [-1.0], 1)]
    assert mined(spark, rows) == brute(rows) != []


@pytest.mark.parametrize("sparse", [0.0, 0.3, 1.0])
@pytest.mark.parametrize("size", [5, 100_000])
def test_dropping_pairs_loses_none_that_qualifies(sparse, size):
    """sparse: pairs are listed one by one from the last plane, in between, or from the first."""
    rng = np.random.default_rng(size)
    anchors, rows = rng.integers(-size, size, (7, 9)), rng.integers(-size, size, (300, 9))
    score, allowed = anchors @ rows.T, rng.random((7, 300)) < 0.8
    top = score.max(axis=1)
    low, high = np.stack([top // 3, top // 2], 1).astype(float), np.stack([top * 0.6 // 1, top * 0.9 // 1], 1)
    a, r, s = hn.qualifying(anchors, rows, allowed, low, high, 3, sparse)
    assert (s == score[a, r]).all() and allowed[a, r].all()
    for i in range(7):
        for k in range(2):
            want = sorted(-x for x, ok in zip(score[i], allowed[i], strict=True) if ok and low[i, k] <= x <= high[i, k])[:3]
            assert sorted(-x for x in s[(a == i) & (s >= low[i, k]) & (s <= high[i, k])])[:3] == want


def test_intervals_drop_most_pairs_before_the_last_planes(monkeypatch):
    """Of random vectors few pairs are left one by one."""
    rng = np.random.default_rng(1)
    anchors, rows = np.floor(rng.normal(0, 32, (50, 64))).astype(np.int64), np.floor(rng.normal(0, 32, (1000, 64))).astype(np.int64)
    left = []
    possible = hn._possible
    monkeypatch.setattr(hn, "_possible", lambda a, *rest: left.append(len(a)) or possible(a, *rest))
    far = np.full((50, 1), hn.FAR)
    hn.qualifying(anchors, rows, np.ones((50, 1000), bool), -far, far, 5)
    assert 1 < len(left) and max(left) <= 5_000
