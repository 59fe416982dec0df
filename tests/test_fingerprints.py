from dataclasses import replace

import numpy as np
import pytest
from pyspark.sql import functions as F

from sonolith.functions import dsp
from sonolith.operators import grid, index, landmarks, match
from sonolith.operators.peaks import by_track, in_scale, local_maxima, peaks
from sonolith.presets import AMPLITUDE, AMPLITUDE_STREAM, LANDMARK, PRESETS, QUAD

RNG = np.random.default_rng(5)
GRID = RNG.integers(0, 6, (30, 24)).astype(float)


def frame(spark, grid, track=0):
    rows = [(track, t, f, float(grid[t, f])) for t in range(grid.shape[0]) for f in range(grid.shape[1])]
    return spark.createDataFrame(rows, "track_id bigint, t int, f int, m double")


def brute_maxima(g, rt, rf, strict):
    out = set()
    for t in range(g.shape[0]):
        for f in range(g.shape[1]):
            near = [g[a, b] for a in range(max(0, t - rt), min(g.shape[0], t + rt + 1)) for b in range(max(0, f - rf), min(g.shape[1], f + rf + 1)) if (a, b) != (t, f)]
            if all(n < g[t, f] if strict else n <= g[t, f] for n in near):
                out.add((t, f))
    return out


@pytest.mark.parametrize("rt, rf, strict", [(2, 3, False), (8, 8, False), (0, 3, True), (1, 15, False)])
def test_local_maxima_match_loops(spark, rt, rf, strict):
    got = {(r.t, r.f) for r in local_maxima(by_track(frame(spark, GRID)), rt, rf, strict).collect()}
    assert got == brute_maxima(GRID, rt, rf, strict)


def small(preset, **more):
    return replace(preset, bins=24, tested=(1, 22), **more)


@pytest.mark.parametrize("preset", [small(LANDMARK, threshold=1.0), small(QUAD, threshold=0.5, top_k=(3, 3)), small(AMPLITUDE, radius_t=2, radius_f=3, top_k=(4, 4)), small(AMPLITUDE_STREAM, radius_t=2, radius_f=3)])
@pytest.mark.parametrize("query", [False, True])
def test_arrays_and_windows_find_the_same_peaks(spark, preset, query):
    cells = frame(spark, GRID)
    m = GRID
    if preset.scale == "relative":  # the windows take powers
        low, high = preset.tested
        inside = np.maximum(m[:, low : high + 1].max(axis=1), 1e-12)
        top = np.full(len(m), inside.max()) if not preset.running_reference else np.maximum.accumulate(inside)[np.minimum(np.arange(len(m)) + preset.radius_t, len(m) - 1)]
        level = 10 * np.log10(np.maximum(m, 1e-12) / top[:, None])
        scaled = {(r.t, r.f): r.m for r in in_scale(cells, preset).collect()}
        assert all(abs(scaled[t, f] - level[t, f]) < 1e-9 for t in range(30) for f in range(24))
        m = m if preset.running_reference else level  # powers are compared where the reference runs
    t, f, v, place = dsp.peaks(m, preset, query)
    got = {(r.t, r.f): r.ord for r in peaks(cells, preset, query).collect()}
    assert got == {(int(a), int(b)): int(c) for a, b, c in zip(t, f, place, strict=True)}


PEAKS = [(0, 10, 5.0), (0, 20, 9.0), (1, 12, 7.0), (1, 30, 8.0), (2, 15, 6.0)]


def peak_rows(spark, preset, query=False, rows=PEAKS):
    from sonolith.operators.peaks import ranked

    return ranked(spark.createDataFrame([(0, *r) for r in rows], "track_id bigint, t int, f int, m double"), preset, query)


def test_landmark_pairs(spark):
    want = {(0, 10, 30, 1): 43980496568321, (0, 10, 12, 1): 43980477693953, (0, 10, 15, 2): 43980480839682, (0, 20, 30, 1): 87960961679361, (0, 20, 12, 1): 87960942804993, (0, 20, 15, 2): 87960945950722, (1, 12, 15, 1): 52776573861889, (1, 30, 15, 1): 131941411061761}
    for query in (False, True):
        got = landmarks.pairs(peak_rows(spark, LANDMARK, query), LANDMARK).collect()
        assert {(r.anchor_t, r.f1, r.f2, r.dt): r.hash for r in got} == want


def test_amplitude_pairs(spark):
    got = landmarks.pairs(peak_rows(spark, AMPLITUDE), AMPLITUDE).collect()
    assert {r.hash for r in got} == {1407439308062720, 1407400653357056, 1407404948389888, 2814814191616000, 2814775536910336, 2814779831943168, 1688879925035008, 4222154715430912}


def test_quad_values(spark):
    got = landmarks.quad_values(peak_rows(spark, QUAD), QUAD).collect()
    assert sorted(tuple(r)[2:] for r in got) == [(5, 6, 15, 7, 46, 46, 92), (10, 6, 15, 7, 46, 46, 92)]
    assert landmarks.fingerprints(peak_rows(spark, QUAD), QUAD).count() == landmarks.fingerprints(peak_rows(spark, QUAD), QUAD, seed=0).count() == 2


def test_five_targets_tell_the_orders_apart(spark):
    rows = [(0, 10, 9.0)] + [(1, f, float(m)) for f, m in ((5, 1), (6, 5), (7, 2), (8, 4), (9, 3))]
    targets = lambda q: {r.f2 for r in landmarks.pairs(peak_rows(spark, LANDMARK, q, rows), LANDMARK).where("anchor_t = 0").collect()}
    assert targets(False) == {6, 8, 9, 7} and targets(True) == {5, 6, 7, 8}


POSTINGS = [(1, 100, 10), (1, 200, 12), (1, 300, 20), (1, 100, 30), (2, 100, 3), (2, 200, 50)]
QUERY = [(100, 0), (100, 0), (200, 2), (300, 10), (400, 11)]


def clip(spark):
    return spark.createDataFrame([(7, *q) for q in QUERY], "query_id bigint, hash bigint, t1 bigint")


def prints(spark, rows=POSTINGS):
    return spark.createDataFrame(rows, "track_id bigint, hash bigint, anchor_t bigint")


def test_votes_and_confidence(spark):
    got = lambda p: [(r.track_id, r.offset_frames, r.votes, r.total_votes, round(r.confidence, 3), round(r.offset_seconds, 6)) for r in match.match(clip(spark), prints(spark), p).orderBy("rank").collect()]
    assert got(LANDMARK) == [(1, 10, 4, 6, 1.0, 0.928798), (2, 3, 2, 3, 0.5, 0.278639)]
    assert got(AMPLITUDE) == [(1, 10, 4, 6, 0.8, 0.464399), (2, 3, 2, 3, 0.4, 0.13932)]
    assert [g[:5] for g in got(QUAD)] == [(1, 10, 4, 6, 0.8)]
    counted = match.votes(clip(spark), prints(spark))
    assert all(r[0] == r[1] for r in counted.groupBy("track_id").agg(F.sum("votes"), F.max("total_votes")).select("sum(votes)", "max(total_votes)").collect())


def test_ties_take_the_negative_offset(spark):
    q = spark.createDataFrame([(1, 5, 10)], "query_id bigint, hash bigint, t1 bigint")
    best = match.best_offsets(match.votes(q, prints(spark, [(1, 5, 15), (1, 5, 5)]))).first()
    assert best.offset_frames == -5


def test_no_match_and_limits(spark):
    assert match.match(clip(spark), prints(spark, [(1, 999, 1)]), LANDMARK).count() == 0
    assert match.match(clip(spark), prints(spark), LANDMARK, limit=1).count() == 1
    assert match.match(clip(spark), prints(spark), LANDMARK, limit=0).count() == 2


def segments(spark):
    """One name in three segments with (votes, total, offset) of (5, 8, 10), (4, 4, 20) and (7, 9, 30)."""
    rows, tracks = [], []
    for s, (votes, total, offset) in enumerate(((5, 8, 10), (4, 4, 20), (7, 9, 30))):
        rows += [(s, s, 1, offset)] * votes + [(s, s, 1, 1000 + k) for k in range(total - votes)]
        tracks.append((s, s, "a", "b", "c"))
    postings = spark.createDataFrame(rows, "segment_id int, track_id bigint, hash bigint, anchor_t bigint")
    return postings, spark.createDataFrame(tracks, "segment_id int, track_id bigint, artist string, album string, title string")


def test_segment_merge(spark):
    q = spark.createDataFrame([(0, 1, 0)], "query_id bigint, hash bigint, t1 bigint")
    got = match.match_segments(q, *segments(spark), LANDMARK).first()
    assert (got.votes, got.total_votes, got.offset_frames, got.confidence) == (16, 21, 30, 1.0)
    assert match.match_segments(q, *segments(spark), LANDMARK, compat=True).first().offset_frames == 10


def test_compaction_keeps_results(spark):
    postings, tracks = segments(spark)
    moved_tracks, moved = index.compact(tracks, postings)
    assert sorted(r.track_id for r in moved_tracks.collect()) == [0, 1, 2]
    assert moved.count() == postings.count()
    q = spark.createDataFrame([(0, 1, 0)], "query_id bigint, hash bigint, t1 bigint")
    assert [r.votes for r in match.match(q, moved, LANDMARK).orderBy("rank").collect()] == [7, 5, 4]


def test_index_on_disk(spark, tmp_path):
    root = str(tmp_path / "index")
    tracks = spark.createDataFrame([(0, "a/b/c.wav"), (1, "d.wav")], "track_id bigint, rel_path string")
    index.write_segment(tracks, prints(spark), root, LANDMARK)
    index.write_segment(tracks.where("track_id = 0"), prints(spark).where("track_id = 1"), root, LANDMARK)
    assert [(r.segment_id, r.num_tracks) for r in index.manifest(spark, root).orderBy("segment_id").collect()] == [(0, 2), (1, 1)]
    with pytest.raises(ValueError, match="other parameters"):
        index.write_segment(tracks, prints(spark), root, QUAD)
    t, p = index.read_index(spark, root, [0])
    assert t.count() == 2 and p.count() == 6
    assert index.inspect_hash(p, "0000000000000064").count() == 3
    incoming = spark.createDataFrame([("d.wav",), ("new.wav",)], "rel_path string")
    assert [r.rel_path for r in index.not_indexed(incoming, t).collect()] == ["new.wav"]
    assert index.not_indexed(incoming, t, force=True).count() == 2 and index.indexed(incoming, t).count() == 1
    assert index.replaced(prints(spark), prints(spark, [(2, 1, 1)])).count() == 5


def test_last_wins_and_raw_rows(spark):
    assert {(r.hash, r.track_id, r.anchor_t) for r in index.last_wins(prints(spark)).collect()} == {(100, 2, 3), (200, 2, 50), (300, 1, 20)}
    raw = spark.createDataFrame([(bytes([0] * 7 + [9]), b"7|12\nbroken\n8|x\n")], "key binary, val binary")
    assert sorted(map(tuple, index.parse_kv(raw).collect())) == [(9, "7", 12), (9, "8", 0)]
    again = index.parse_kv(index.to_kv(prints(spark))).select(F.col("track_id").cast("bigint"), "hash", "anchor_t")
    assert sorted(map(tuple, again.collect())) == sorted(map(tuple, prints(spark).collect()))


def test_numbering_is_dense_and_ordered(spark):
    rows = spark.createDataFrame([(f"p{i:04d}",) for i in np.random.default_rng(1).permutation(500)], "rel_path string")
    assert [(r.rel_path, r.track_id) for r in index.number_tracks(rows).orderBy("track_id").collect()] == [(f"p{i:04d}", i) for i in range(500)]


def test_presets_and_short_clips():
    assert set(PRESETS) == {"landmark", "quad", "amplitude", "amplitude_db6", "amplitude_stream"}
    assert len(dsp.frames_of(np.ones(100), LANDMARK)) == 1 and len(dsp.frames_of(np.ones(100), QUAD)) == 0
    assert len(dsp.frames_of(np.ones(2048 + 1024), LANDMARK)) == 2
    assert dsp.spectrogram(np.zeros(0), AMPLITUDE).shape == (0, 1025)
    assert all(len(x) == 0 for x in dsp.peaks(np.zeros((0, 1025)), AMPLITUDE))


def test_describe(spark):
    r = landmarks.describe(peak_rows(spark, LANDMARK), LANDMARK, 3).first()
    assert (r.n_peaks, r.n_hashes, r.n_distinct, len(r.first)) == (5, 8, 8, 3)


def test_printed_confidence_is_rounded_as_c_prints_it(spark):
    shares = [6 / 160, 1 / 16, 3 / 16, 0.0005, 0.0015, 0.0025, 0.9995, 0.99949999, 1e-5, 0.0, 1.0, 2.0625, *(n / 2000 for n in range(1, 2000, 7)), *(n / 1008 for n in range(0, 1008, 5))]
    rows = spark.createDataFrame([(n, 1, n, 3, -5, c) for n, c in enumerate(shares)], "query_id long, rank int, track_id long, votes long, offset_frames long, confidence double")
    got = {r.query_id: r.line for r in match.printed(rows).collect()}
    assert got == {n: " 1. %d (votes 3, offset -5, confidence %.3f)" % (n, c) for n, c in enumerate(shares)}


@pytest.mark.parametrize("compat", [False, True])
def test_all_matches_of_a_segment_count_when_asked_for(spark, compat):
    """Sixty tracks of a segment, each name there twice: the names beyond the segment's first fifty matches are whole, too."""
    postings = spark.createDataFrame([(0, t, 1, t + k) for t in range(60) for k in range(60 - t)], "segment_id int, track_id bigint, hash bigint, anchor_t bigint")
    q = spark.createDataFrame([(0, 1, 0)], "query_id bigint, hash bigint, t1 bigint")
    tracks = spark.createDataFrame([(0, t, "a", "b", str(t % 30)) for t in range(60)], "segment_id int, track_id bigint, artist string, album string, title string")
    got = match.match_segments(q, postings, tracks, LANDMARK, limit=None, compat=compat, each=None).collect()
    assert {int(r.title): r.total_votes for r in got} == {n: 90 - 2 * n for n in range(30)}
    assert {(int(r.title), r.votes, r.offset_frames) for r in got} == {(n, 2, n) for n in range(30)}
    assert match.match_segments(q, postings, tracks, LANDMARK, compat=compat).count() == 10


def random_prints(spark, seed, n_clips=20, n_tracks=15):
    rng = np.random.default_rng(seed)
    q = [(f"q{c}", int(rng.integers(0, 12)), int(rng.integers(0, 9))) for c in range(n_clips) for _ in range(rng.integers(0, 25))]
    p = [(int(t % 3), int(t // 3), int(rng.integers(0, 14)), int(rng.integers(-5, 20))) for t in range(n_tracks) for _ in range(rng.integers(0, 40))]
    return spark.createDataFrame(q + q[:5], "query_id string, hash bigint, t1 bigint"), spark.createDataFrame(p, "segment_id int, track_id bigint, hash bigint, anchor_t bigint")


@pytest.mark.parametrize("block", [150, 1 << 19])
def test_a_grid_counts_the_votes_of_the_join(spark, block):
    keys = ("segment_id", "track_id")
    q, p = random_prints(spark, 3)
    rows = lambda found: sorted(map(tuple, found.select("query_id", *keys, "offset_frames", "votes", "total_votes").collect()))
    want = match.joined_votes(q, p, keys=keys)
    assert rows(match.grid_votes(q, p, False, keys, block, 100)) == rows(want)
    assert rows(match.grid_votes(q, p, True, keys, block, 100)) == rows(match.best_offsets(want, keys)) == rows(match.best_votes(q, p, keys=keys, clips=3))
    assert not match.grid_votes(q.where("hash < 0"), p).count() and not match.grid_votes(q, p.where("hash < 0")).count()


@pytest.mark.parametrize("hits", [1, 30, 1000])
def test_votes_of_a_cell_come_in_slices_of_bounded_hits(hits, monkeypatch):
    rng = np.random.default_rng(hits)
    clip, clip_hash, t1, times = rng.integers(0, 9, 80), rng.integers(0, 4, 80), rng.integers(0, 6, 80), rng.integers(1, 3, 80)
    track, track_hash, anchor = rng.integers(0, 7, 90), rng.integers(0, 5, 90), rng.integers(0, 6, 90) * (1 << 60 if hits == 30 else 1)
    sizes, counted = [], grid._counted
    monkeypatch.setattr(grid, "_counted", lambda pair, *rest: sizes.append((len(pair), len(np.unique(pair)))) or counted(pair, *rest))
    got = {(c, t, o): (v, s) for part in grid.votes_of(clip, clip_hash, t1, times, track, track_hash, anchor, False, hits) for c, t, o, v, s in zip(*(x.tolist() for x in part), strict=True)}
    want, total = {}, {}
    for i in range(80):
        for j in np.flatnonzero(track_hash == clip_hash[i]).tolist():
            pair = (int(clip[i]), int(track[j]))
            want[*pair, int(anchor[j] - t1[i])] = want.get((*pair, int(anchor[j] - t1[i])), 0) + int(times[i])
            total[pair] = total.get(pair, 0) + int(times[i])
    assert got == {k: (v, total[k[:2]]) for k, v in want.items()}
    assert all(n <= hits or pairs == 1 for n, pairs in sizes)


def test_many_clips_give_what_few_do(spark, monkeypatch):
    q, p = random_prints(spark, 8)
    p = p.selectExpr("segment_id * 100 + track_id as track_id", "hash", "anchor_t")
    tracks = p.select("track_id").distinct().where("track_id % 4 <> 1").selectExpr("track_id", "cast(-track_id % 3 as string) as title")
    for preset, known, limit in ((LANDMARK, None, 3), (LANDMARK, tracks, 3), (LANDMARK, tracks, 0), (AMPLITUDE, None, 3)):
        rows = lambda: sorted(map(tuple, match.match(q, p, preset, known, limit).select("query_id", "rank", "track_id", "votes", "total_votes", "offset_frames", "confidence").collect()))  # noqa: B023, E731
        found = rows()
        monkeypatch.setattr(match.best_votes, "__defaults__", (match.BROADCAST_HASHES, ("track_id",), 4))
        assert rows() == found
        monkeypatch.undo()


def test_more_cells_are_more_tasks(spark, monkeypatch):
    from sonolith.operators import peaks as P

    cells, preset = spark.range(40 * 50).selectExpr("id div 50 as track_id", "cast(id % 50 div 10 as int) as t", "cast(id % 10 as int) as f", "cast(hash(id) % 7 as double) as m"), replace(LANDMARK, bins=10, tested=(0, 9), radius_t=1, radius_f=1, threshold=-9.0)
    found = lambda: sorted(map(tuple, landmarks.fingerprints(peaks(cells, preset), preset).collect()))
    want = found()
    monkeypatch.setattr(P, "CELLS", 100, raising=False)
    assert found() == want
    assert by_track(cells).rdd.getNumPartitions() == 20
    assert max(by_track(cells).rdd.mapPartitions(lambda rows: [len(list(rows))]).collect()) <= 300  # of 2,000


def test_a_cell_of_the_grid_has_a_bounded_number_of_pairs(spark):
    q, p = random_prints(spark, 3, 60, 40)
    keys = ("segment_id", "track_id")
    rows = lambda found: sorted(map(tuple, found.select("query_id", *keys, "offset_frames", "votes", "total_votes").collect()))
    few = match.grid_votes(q, p, True, keys, pairs=100)
    assert rows(few) == rows(match.grid_votes(q, p, True, keys))
    sizes = few.rdd.mapPartitions(lambda found: [len(list(found))]).collect()
    assert len(sizes) >= 20 and max(sizes) <= 300  # pairs, of 2,400 in all


def test_pairs_meet_their_names_where_they_are_counted(spark, capsys):
    q, p = random_prints(spark, 8)
    p = p.selectExpr("segment_id * 100 + track_id as track_id", "hash", "anchor_t")
    tracks = p.select("track_id").distinct().selectExpr("track_id", "cast(-track_id % 3 as string) as title")
    match.match(q, p, LANDMARK, tracks, 3).explain()
    assert "BroadcastHashJoin [track_id" in capsys.readouterr().out


def plan_of(frame, capsys):
    capsys.readouterr()
    frame.explain()
    return capsys.readouterr().out


def test_pairs_are_not_shuffled_to_labels_too_large_to_broadcast(spark, capsys, tmp_path):
    """10,000 labels, of which two are of tracks; the engine itself may broadcast none."""
    from sonolith.plans.queries import QUERIES, SQL

    spark.range(140 * 50).selectExpr("id as vec_id", "transform(sequence(1, 64), x -> cast(hash(id, x) % 100 / 100 as float)) as embedding", "1 as label").write.parquet(str(tmp_path / "embeddings.parquet"))
    spark.range(10_000).selectExpr("id * 100 as doc_id", "cast(id % 3 as int) as quality", "0 as toxic").write.parquet(str(tmp_path / "labels.parquet"))
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        found = QUERIES["match_metadata_left"](spark, str(tmp_path))
        plan = plan_of(found, capsys)
        rows = sorted(map(tuple, found.collect()))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert "SortMergeJoin" not in plan and "BroadcastHashJoin [track_id" in plan
    duckdb = pytest.importorskip("duckdb").connect()
    for name in ("embeddings", "labels"):
        duckdb.sql(f"create view {name} as select * from '{tmp_path}/{name}.parquet/*.parquet'")
    assert rows == sorted(duckdb.sql(SQL["match_metadata_left"]).fetchall())


def test_the_pairs_of_a_batch_are_counted_once(spark, capsys, tmp_path):
    from sonolith.plans.queries import QUERIES

    spark.range(140 * 50).selectExpr("id as vec_id", "transform(sequence(1, 64), x -> cast(hash(id, x) % 100 / 100 as float)) as embedding").write.parquet(str(tmp_path / "embeddings.parquet"))
    found = QUERIES["batch_accuracy"](spark, str(tmp_path))
    assert "MapInArrow" not in plan_of(found, capsys)  # of each of the two plans that read the matches
    assert found.first().n == 140
