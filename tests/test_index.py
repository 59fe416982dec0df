"""Segments of several writers, buckets, heavy hashes, damage."""

import threading
from concurrent.futures import ThreadPoolExecutor

import pytest
from pyspark.sql import functions as F

from sonolith import commits
from sonolith.operators import index, match
from sonolith.presets import LANDMARK


def rows(spark, tracks, per=20):
    found = [(t, (t * 7 + k) % 50, k) for t in tracks for k in range(per)]
    return spark.createDataFrame([(t, f"p{t}") for t in tracks], "track_id bigint, rel_path string"), spark.createDataFrame(found, "track_id bigint, hash bigint, anchor_t bigint")


def test_a_name_is_published_once(spark, tmp_path):
    wins = []
    with ThreadPoolExecutor(8) as pool:
        wins = list(pool.map(lambda k: commits.publish(spark, f"{tmp_path}/x/line.json", str(k) * 10_000), range(8)))
    assert sum(wins) == 1 and (tmp_path / "x" / "line.json").read_text() == str(wins.index(True)) * 10_000
    assert [p.name for p in (tmp_path / "x").iterdir()] == ["line.json"]


def test_hadoops_rename_does_not_overwrite(spark, tmp_path):
    path = spark._jvm.org.apache.hadoop.fs.Path
    assert commits._rename(spark, path(f"{tmp_path}/.a"), path(f"{tmp_path}/line"), "é1") and not commits._rename(spark, path(f"{tmp_path}/.b"), path(f"{tmp_path}/line"), "2")
    assert (tmp_path / "line").read_text() == "é1" and not (tmp_path / ".b").exists()


def test_writers_at_once_get_segments_of_their_own(spark, tmp_path):
    root = str(tmp_path / "it's an index")
    barrier = threading.Barrier(4)

    def write(k):
        tracks, prints = rows(spark, [k, 9])  # track 9 is in all
        barrier.wait()
        return index.write_segment(tracks, prints, root, LANDMARK, buckets=4)

    with ThreadPoolExecutor(4) as pool:
        ids = list(pool.map(write, range(4)))
    assert sorted(ids) == [0, 1, 2, 3] and sorted(r.segment_id for r in index.manifest(spark, root).collect()) == ids_sorted(ids)
    tracks, prints = index.current(*index.read_index(spark, root))
    assert sorted(r.track_id for r in tracks.collect()) == [0, 1, 2, 3, 9] and prints.count() == 100
    assert {r.segment_id for r in tracks.where("track_id = 9").collect()} == {3}
    _, moved = index.compact(tracks, prints)
    assert moved.count() == 100
    assert index.bucket_rows(spark, root).agg(F.sum("n_postings")).first()[0] == 160


def ids_sorted(ids):
    return sorted(ids)


def test_one_run_twice_at_once_is_one_segment(spark, tmp_path):
    root = str(tmp_path / "index")
    barrier = threading.Barrier(2)

    def write(_):
        tracks, prints = rows(spark, [1])
        barrier.wait()
        return index.write_segment(tracks, prints, root, LANDMARK, run="same", buckets=4)

    with ThreadPoolExecutor(2) as pool:
        assert list(pool.map(write, range(2))) == [0, 0]
    assert index.manifest(spark, root).count() == 1 and index.read_index(spark, root)[1].count() == 20
    assert index.abandoned(spark, root).count() in (0, 2)  # the folders of the one that lost, if it had written any


def test_a_writer_that_failed_leaves_nothing_to_see(spark, tmp_path, monkeypatch):
    root = str(tmp_path / "index")
    tracks, prints = rows(spark, [1])
    monkeypatch.setattr(index, "publish", lambda *_: (_ for _ in ()).throw(RuntimeError("killed")))
    with pytest.raises(RuntimeError):
        index.write_segment(tracks, prints, root, LANDMARK, run="a", buckets=4)
    monkeypatch.undo()
    assert index.manifest(spark, root).isEmpty() and index.abandoned(spark, root).count() == 2
    assert index.write_segment(tracks, prints, root, LANDMARK, run="a", buckets=4) == 0
    assert index.read_index(spark, root)[0].count() == 1 and index.abandoned(spark, root).count() == 2


def batch(spark, n=40):
    return spark.createDataFrame([(q, (q * 7 + k) % 50, k) for q in range(n) for k in range(5)], "query_id bigint, hash bigint, t1 bigint")


def test_a_large_batch_leaves_the_postings_where_they_lie(spark, tmp_path):
    root = str(tmp_path / "index")
    for part in ([0, 1, 2], [3, 4], [2, 5]):
        index.write_segment(*rows(spark, part), root, LANDMARK, buckets=8)
    plain, bucketed = index.current(*index.read_index(spark, root)), index.current(*index.read_index(spark, root, bucketed=True))
    assert sorted(map(tuple, bucketed[1].select(*plain[1].columns).collect())) == sorted(map(tuple, plain[1].collect()))
    counted = match.votes(batch(spark), bucketed[1], most=10)
    want = match.votes(batch(spark), plain[1])
    assert sorted(map(tuple, counted.select(*want.columns).collect())) == sorted(map(tuple, want.collect()))
    joined = match.hits(batch(spark), bucketed[1], most=10)
    joined.write.format("noop").mode("overwrite").save()
    plan = joined._jdf.queryExecution().executedPlan().toString()
    scan = plan[: plan.index("Scan parquet")]
    # one exchange: the batch's; from the postings' scan up to the join there is none
    assert "Bucketed: true" in plan and "SortMergeJoin" in scan
    assert not index.read_index(spark, root, segments=[1], bucketed=True)[1].where("track_id < 3").count()


def test_a_hash_with_a_third_of_all_postings_is_dealt_out(spark):
    hot = spark.range(30_000).select((F.col("id") % 7).alias("track_id"), F.lit(5).cast("bigint").alias("hash"), F.col("id").alias("anchor_t"))
    rest = spark.range(60_000).select((F.col("id") % 7).alias("track_id"), (F.col("id") % 20_000 + 10).alias("hash"), F.col("id").alias("anchor_t"))
    postings, query = hot.union(rest), spark.createDataFrame([(1, 5, 3), (1, 5, 3), (2, 5, 4), (2, 12, 0), (3, 77, 1)], "query_id bigint, hash bigint, t1 bigint")
    spark.conf.set("spark.sql.shuffle.partitions", "16")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        assert [r.hash for r in match.heavy_hashes(postings, 16).collect()] == [5]
        got = match.hits(query, postings, most=1)
        want = match.hits(query, postings)
        assert sorted(map(tuple, got.select(*want.columns).collect())) == sorted(map(tuple, want.collect()))
        sizes = sorted(r["count"] for r in got.where("hash = 5").groupBy(F.spark_partition_id()).count().collect())
        assert len(sizes) >= 12 and sizes[-1] <= 5 * sizes[len(sizes) // 2]
        a, b = (match.votes(query, postings, most=m) for m in (1, 1000))
        assert sorted(map(tuple, a.select(*b.columns).collect())) == sorted(map(tuple, b.collect()))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
        spark.conf.set("spark.sql.adaptive.enabled", "true")


@pytest.mark.parametrize("harm", ["missing", "length", "contents"])
def test_damage_is_told_and_the_rest_searched(spark, tmp_path, harm):
    root = str(tmp_path / "index")
    for part in ([0, 1], [2, 3]):
        index.write_segment(*rows(spark, part), root, LANDMARK, buckets=4)
    assert index.damaged(spark, root, full=True).count() == 0
    line = index.manifest(spark, root).where("segment_id = 1").select(F.inline("files")).where("kind = 'fingerprints'").first()
    file = tmp_path / "index" / "fingerprints" / line.path / line.name
    data = bytearray(file.read_bytes())
    if harm == "missing":
        file.unlink()
    elif harm == "length":
        file.write_bytes(data[:-3])
    else:
        data[4:60] = bytes(56)
        file.write_bytes(data)
    (tmp_path / "index" / "fingerprints" / line.path / f".{line.name}.crc").unlink(missing_ok=True)
    assert index.damaged(spark, root).count() == (harm != "contents")
    told = index.damaged(spark, root, full=True).collect()
    assert [(r.segment_id, r.kind, r.name, r.problem) for r in told] == [(1, "fingerprints", line.name, harm)]
    if harm != "contents":
        tracks, prints = index.read_index(spark, root, skip_damaged=True)
        assert sorted(r.track_id for r in tracks.collect()) == [0, 1] and prints.count() == 40


def test_several_tables_of_one_run_appear_together(spark, tmp_path, monkeypatch):
    root = str(tmp_path / "it's")
    tables = {"a": spark.range(3), "b": spark.range(2).withColumnRenamed("id", "x")}
    monkeypatch.setattr(commits, "publish", lambda *_: (_ for _ in ()).throw(RuntimeError("killed")))
    with pytest.raises(RuntimeError):
        commits.commit_tables(tables, root, "run/1")
    monkeypatch.undo()
    assert commits.committed(spark, root, "a") is None
    assert commits.commit_tables(tables, root, "run/1") and not commits.commit_tables(tables, root, "run/1")
    assert commits.commit_tables({"a": spark.range(1)}, root, "it's 2")
    assert sorted((r.id, r.run) for r in commits.committed(spark, root, "a").collect()) == [(0, "it's 2"), (0, "run/1"), (1, "run/1"), (2, "run/1")]
    assert commits.committed(spark, root, "b").count() == 2
