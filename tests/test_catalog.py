import datetime as dt

from pyspark.sql import functions as F

from sonolith.operators import catalog, evaluate, monitor
from sonolith.sources import landing


def test_page_chains(spark):
    pages = spark.createDataFrame([("a", "b", ["1", "2"]), ("b", "c", ["3"]), ("c", "gone", ["4"]), ("x", None, ["9"]), ("p", "q", ["5"]), ("q", "p", ["6"])], "url string, next string, items array<string>")
    assert {r.url: (r["items"], r.n_pages) for r in catalog.merge_page_chains(pages).collect()} == {"a": (["1", "2", "3", "4"], 3), "x": (["9"], 1), "p": (["5", "6"], 2)}
    walked = catalog.follow_chain(spark, pages, spark.createDataFrame([("p",), ("b",)], "url string"))
    assert sorted(map(tuple, walked.collect())) == [("b", "b", 0), ("b", "c", 1), ("p", "p", 0), ("p", "q", 1)]


def test_long_chain_is_cut(spark):
    pages = spark.createDataFrame([(f"{i:03d}", f"{i + 1:03d}", [str(i)]) for i in range(205)], "url string, next string, items array<string>")
    got = catalog.merge_page_chains(pages).first()
    assert got.url == "000" and got.n_pages == 201


def test_landed_json(spark, tmp_path):
    (tmp_path / "p.json").write_text('{"url": "a", "data": {"items": ["1"], "next": "b"}}\n{"url": "b", "data": {"error": {"status": 404}}}\n')
    pages = landing.read_pages(spark, str(tmp_path / "p.json"))
    good = catalog.page_items(catalog.without_errors(pages)).collect()
    assert [(r.url, r.next, r["items"]) for r in good] == [("a", "b", ["1"])]
    (tmp_path / "seeds.json").write_text('{"x": "https://h/artist/1?a",\n "y": "u"}')
    assert sorted(map(tuple, landing.read_object(spark, str(tmp_path / "seeds.json")).collect())) == [("x", "https://h/artist/1?a"), ("y", "u")]
    lists = spark.createDataFrame([("#EXTM3U\n\n a.mp3 \nb.mp3",), ("#",)], "t string")
    assert [r[0] for r in lists.select(landing.playlist_entry(F.col("t"))).collect()] == ["a.mp3", None]
    assert landing.as_variant(pages).schema["data"].dataType.simpleString() == "variant"


def test_upserts(spark):
    old = spark.createDataFrame([(1, "a"), (2, "b")], "id int, v string")
    new = spark.createDataFrame([(2, "B"), (3, "C")], "id int, v string")
    assert sorted(map(tuple, catalog.upsert(old, new, "id").collect())) == [(1, "a"), (2, "B"), (3, "C")]
    assert sorted(map(tuple, catalog.missing(new.union(new), old, "id").collect())) == [(3, "C")]
    day = lambda d: dt.datetime(2020, 1, d)
    shape = "id int, name string, updated_at timestamp"
    touched = catalog.touch(spark.createDataFrame([(1, "a", day(1)), (2, "b", day(1))], shape), spark.createDataFrame([(2, "zz", day(2)), (3, "c", day(2))], shape), "id", F.lit(day(5)))
    assert sorted(map(tuple, touched.collect())) == [(1, "a", day(1)), (2, "b", day(5)), (3, "c", day(5))]
    rows = spark.createDataFrame([(1, 1, "x"), (1, 2, "y")], "k int, ts int, v string")
    assert [tuple(r) for r in catalog.latest(rows, "k", "ts").collect()] == [(1, 2, "y")]


def test_durations(spark):
    t = spark.createDataFrame([(1, -1), (2, 30), (3, None), (4, -2)], "id int, duration int")
    assert {r.id for r in catalog.without_duration(t).collect()} == {1, 3}
    up = spark.createDataFrame([(1, 99)], "id int, duration int")
    assert {r.id: r.duration for r in catalog.set_duration(t, up, "id").collect()} == {1: 99, 2: 30, 3: None, 4: -2}
    assert [r[0] for r in t.orderBy("id").select(catalog.duration_status(F.col("duration"))).collect()] == ["unknown", "known", "unknown", "absent"]
    assert [r.id for r in catalog.after(t, "id", 2, 1).collect()] == [3]


def test_gates_albums_and_relations(spark):
    now = F.lit(dt.datetime(2020, 1, 2))
    a = spark.createDataFrame([(1, dt.datetime(2020, 1, 1, 12), True), (2, dt.datetime(2019, 1, 1), True), (3, dt.datetime(2020, 1, 1, 12), False), (4, None, True)], "id int, updated_at timestamp, has_crawl_completed boolean")
    assert {r.id for r in catalog.stale(a, now).collect()} == {2, 3, 4}
    assert catalog.mark_completed(a, a.where("id = 3"), "id").where("has_crawl_completed").count() == 4
    albums = spark.sql("""select 'al' album_id, array(named_struct('id', 'x', 'name', 'X'), named_struct('id', 'y', 'name', 'Y')) artists,
      array(named_struct('url', 'u', 'height', 1)) images, array(named_struct('id', 't1', 'name', 'T')) tracks, 3 total_tracks""")
    parts = catalog.split_albums(albums)
    assert {k: v.count() for k, v in parts.items()} == {"albums": 1, "images": 1, "tracks": 1, "album_artists": 2}
    assert [r.id for r in catalog.other_artists(albums, F.lit("x")).collect()] == ["y"]
    assert catalog.changed_albums(albums, albums.select("album_id", F.lit(3).alias("total_tracks"))).count() == 0
    tracks = spark.createDataFrame([("t1", "T", "al"), ("t2", "U", None)], "track_id string, title string, album_id string")
    names = spark.createDataFrame([("al", "Album")], "album_id string, album string")
    people = spark.createDataFrame([("x", "X"), ("y", "Y")], "artist_id string, artist string")
    got = catalog.look_up_chain(tracks, names, parts["album_artists"], people).collect()
    assert sorted(map(tuple, got)) == [("t1", "T", "Album", "X"), ("t2", "U", "unknown", "unknown")]
    dates = spark.createDataFrame([("2001", "year"), ("2001-02", "month"), ("2001-02-03", "day")], "d string, p string")
    assert [str(r[0]) for r in dates.select(catalog.release_date(F.col("d"), F.col("p"))).collect()] == ["2001-01-01", "2001-02-01", "2001-02-03"]


def test_crawl_reaches_everything_once(spark):
    edges = spark.createDataFrame([(1, 2), (2, 3), (3, 1), (3, 4)], "id int, other int")
    expand = lambda f: f.join(edges, "id").select(F.col("other").alias("id"))
    assert {r.id for r in catalog.crawl(spark.createDataFrame([(1,)], "id int"), expand).collect()} == {1, 2, 3, 4}


def test_files_of_a_folder(spark):
    files = spark.createDataFrame([("d", "z.png"), ("d", "Cover.JPG"), ("e", "a.txt")], "dir string, name string")
    pictures = files.withColumn("p", catalog.cover_priority(F.col("name"))).where("p is not null")
    assert [r.name for r in catalog.best_of_folder(pictures, F.col("p")).collect()] == ["Cover.JPG"]


def test_evaluation(spark):
    found = spark.createDataFrame([(1, 1), (2, 2), (3, 0), (4, 10)], "query_id int, rank int")
    s = evaluate.summary(found).first()
    assert (s.n, s.found, round(s.mrr, 6), round(s.avg_rank, 3)) == (4, 3, 0.4, 2.5)
    assert [(r["rank"], r.n) for r in evaluate.histogram(found).where("n > 0").orderBy("rank").collect()] == [(1, 1), (2, 1), (10, 1)]
    expected = spark.createDataFrame([(1, "Halo"), (2, "One Two Three Four Five"), (3, "none")], "query_id int, expected string")
    candidates = spark.createDataFrame([(1, 1, "x"), (1, 2, "Beyoncé - Halo!!"), (2, 1, "three two one"), (3, 1, "else")], "query_id int, rank int, candidate string")
    assert {r.query_id: r["rank"] for r in evaluate.ranks(expected, candidates).collect()} == {1: 2, 2: 1, 3: 0}
    clips = spark.createDataFrame([(f"c{i}",) for i in range(30)], "path string")
    assert evaluate.sample(clips, 5).collect() == evaluate.sample(clips, 5).collect()


def test_candidates_are_not_broadcast_to_be_ranked(spark):
    expected = spark.range(1000).select(F.col("id").alias("query_id"), F.concat(F.lit("song"), F.col("id") % 12, F.lit("x")).alias("expected"))
    candidates = spark.range(1000).select(F.col("id").alias("query_id"), F.explode(F.sequence(F.lit(1), F.lit(10))).alias("rank")).withColumn("candidate", F.concat(F.lit("song"), "rank", F.lit("x")))
    found = evaluate.ranks(expected, candidates)
    rows = evaluate.histogram_with_mrr(found).orderBy("rank").collect()
    plan = evaluate.histogram_with_mrr(found)._jdf.queryExecution().executedPlan().toString()
    assert "Broadcast" not in plan and "SortMergeJoin" in plan
    assert [(r["rank"], r.n) for r in rows] == [(r["rank"], r.n) for r in evaluate.histogram(found).orderBy("rank").collect()]
    assert abs(rows[0].mrr - evaluate.summary(found).first().mrr) < 1e-9
    assert evaluate.histogram_with_mrr(found.where("rank < 0")).count() == 10


def test_monitoring(spark):
    at = lambda s: dt.datetime(2020, 1, 1, 0, 0, s)
    rows = spark.createDataFrame([(at(0),), (at(1),), (at(6),), (at(22),)], "ts timestamp")
    for kind in ("timestamp", "timestamp_ntz"):
        got = monitor.rates(monitor.ticks(rows.select(F.col("ts").cast(kind)), "ts", 5), 5).orderBy("tick").collect()
        assert [(r.tick.second, r.total, r.delta, r.rate) for r in got] == [(5, 3, 1, 0.2), (10, 3, 0, 0.0), (15, 3, 0, 0.0), (20, 4, 1, 0.2)]
    assert monitor.rates(monitor.ticks(rows.limit(0), "ts", 5), 5).count() == 0
    plan = monitor.rates(monitor.ticks(rows, "ts", 5), 5)._jdf.queryExecution().optimizedPlan().toString()
    assert "Window" in plan and all("_part" in line for line in plan.split("\n") if "Window [" in line)
    s = monitor.status(spark.range(4), F.col("id") < 2, F.col("id") == 3).first()
    assert (s.total, s.done, s.errors, s.in_flight, s.percent) == (4, 2, 1, 1, 50.0)


def test_chunks_keep_all_columns(spark):
    rows = spark.createDataFrame([(i, 100 - i) for i in range(7)], "track_id int, x int")
    got = catalog.chunks(rows, "x", 3).collect()
    assert sorted((r.track_id, r.x, r.chunk) for r in got) == [(i, 100 - i, (6 - i) // 3) for i in range(7)]


def test_crawl_goes_to_the_end(spark):
    start = spark.createDataFrame([(0,), (None,)], "id int")
    got = catalog.crawl(start, lambda f: f.where("id < 55").selectExpr("id + 1 as id").union(f.selectExpr("cast(null as int)")))
    assert sorted(r.id for r in got.collect()) == list(range(56))


PAGE = "url string, next string, items array<string>"


def walked(pages, start, longest=catalog.LONGEST_CHAIN):
    """The pages read from a url: (items, number), one page after the other."""
    known = {}
    for url, after, items in pages:
        if url is not None:
            known[url] = (after, items)
    if start not in known:
        return None
    after, items = known[start]
    out, seen = list(items or []), {start}
    while items is not None and after in known and after not in seen and len(seen) < longest and known[after][1] is not None:
        seen.add(after)
        after, more = known[after]
        out += more
    return out, len(seen)


def test_any_page_can_be_read_from(spark):
    """Two pages that lead to one, a cycle entered from outside and one of its own, a page without items, a null next, 205 pages."""
    pages = [("a", "c", ["1"]), ("b", "c", ["2"]), ("c", None, ["3", "33"]), ("in", "r1", ["i"]), ("r1", "r2", ["x"]), ("r2", "r3", []), ("r3", "r1", ["z"])]
    pages += [("p", "q", ["5"]), ("q", "p", ["6"]), ("self", "self", ["s"]), ("to bare", "bare", ["t"]), ("bare", "a", None), ("gone", "nowhere", ["g"]), (None, "a", ["n"])]
    pages += [(f"{i:03d}", f"{i + 1:03d}", [str(i)]) for i in range(205)] + [("fork", "100", ["f"])]
    frame = spark.createDataFrame(pages, PAGE)
    got = {r.url: (r["items"] or [], r.n_pages) for r in catalog.read_chains(frame).collect()}
    assert got == {p[0]: walked(pages, p[0]) for p in pages if p[0]}
    assert got["b"] == (["2", "3", "33"], 2) and got["in"][1] == 4 and got["000"][1] == 201 and got["fork"][1] == 106
    some = catalog.read_chains(frame, spark.createDataFrame([("b",), ("absent",), ("b",)], "url string")).collect()
    assert [(r.url, r["items"]) for r in some] == [("b", ["2", "3", "33"])]
    starts = {r.url for r in catalog.chain_starts(frame).collect()}
    assert starts == {"b", "in", "p", "self", "to bare", "gone", "000", "fork"}  # "bare" leads to "a"
    assert {r.url for r in catalog.merge_page_chains(frame).collect()} == starts


def test_a_repeated_page_counts_once(spark):
    frame = spark.createDataFrame([("a", "b", ["1"]), ("a", "b", ["1"]), ("b", None, ["2"])], PAGE)
    assert {r.url: (r["items"], r.n_pages) for r in catalog.read_chains(frame).collect()} == {"a": (["1", "2"], 2), "b": (["2"], 1)}
    assert catalog.read_chains(frame.where("url = 'x'")).count() == 0


def test_error_members_by_their_types(spark):
    values = {"0": False, "0.0": False, "-0": False, "0e5": False, "false": False, "null": False, '""': False, '"0"': True, '"false"': True, "1": True, "0.5": True, "true": True, "[]": True, "{}": True, '"x"': True}
    rows = [(v, f'{{"error": {v}, "items": []}}') for v in values] + [("absent", '{"items": []}'), ("broken", "{"), ("none", None), ("list", '[{"error": 1}]')]
    frame = spark.createDataFrame(rows, "k string, data string")
    kept = {r.k for r in catalog.without_errors(frame).collect()}
    assert kept == {v for v, truthy in values.items() if not truthy} | {"absent", "broken", "none", "list"}
    assert {r.k for r in catalog.cacheable(frame).collect()} == {"absent", "broken", "none", "list"}


def test_touch_goes_by_keys_and_not_by_times(spark):
    day = lambda d: dt.datetime(2020, 1, d)
    shape = "id int, `a.name` string, updated_at timestamp"
    old = spark.createDataFrame([(1, "a", None), (2, None, day(1)), (3, "c", day(1))], shape)
    new = spark.createDataFrame([(2, "zz", None), (4, "d", None), (4, "e", day(3)), (None, "n", None)], shape)
    got = sorted(map(tuple, catalog.touch(old, new, "id", F.lit(day(5))).collect()), key=str)
    assert got == sorted([(1, "a", None), (2, None, day(5)), (3, "c", day(1)), (4, "d", day(5)), (None, "n", day(5))], key=str)


def test_several_updates_of_a_track_are_one(spark):
    t = spark.createDataFrame([(1, -1), (2, 30)], "id int, duration int")
    up = spark.createDataFrame([(1, 50, 2), (1, 99, 1), (1, None, 3), (2, None, 1)], "id int, duration int, at int")
    assert sorted(map(tuple, catalog.set_duration(t, up, "id").collect())) == [(1, 99), (2, 30)]
    assert sorted(map(tuple, catalog.set_duration(t, up, "id", "at").collect())) == [(1, 50), (2, 30)]


def test_what_a_crawl_writes_grows_with_new_ids(spark, tmp_path):
    edges = spark.createDataFrame([(i, j) for i in range(300) for j in (i * 2 + 1, i * 2 + 2, i // 2)], "id long, other long")
    root = str(tmp_path / "crawl")
    got = catalog.crawl(spark.createDataFrame([(0,), (None,)], "id long"), lambda f: f.join(edges, "id").select(F.col("other").alias("id")), root)
    assert sorted(r.id for r in got.collect()) == list(range(601))
    written = spark.read.parquet(f"{root}/ids")
    assert written.count() == written.select("id").distinct().count() == 601  # no id is written twice


def test_the_crawls_filter_never_loses_an_id(spark, monkeypatch):
    ids, others = spark.range(0, 3000), spark.range(3000, 6000)
    for bits, most in ((1 << 26, 5), (1 << 15, 3000), (1 << 10, 3000)):
        monkeypatch.setattr(catalog, "FILTER_BITS", bits)
        bitmaps = catalog.id_filter(ids)
        assert catalog.maybe_in(ids, bitmaps).count() == 3000 and catalog.maybe_in(others, bitmaps).count() <= most


def test_jumps_are_made_once_for_all_walks(spark, monkeypatch):
    pages = spark.createDataFrame([*((f"a{n}", f"a{n + 1}", [str(n)]) for n in range(6)), ("r0", "r1", ["x"]), ("r1", "r2", ["y"]), ("r2", "r0", ["z"])], "url string, next string, items array<string>")
    made, jumps = [], catalog.page_jumps
    monkeypatch.setattr(catalog, "page_jumps", lambda *a: made.append(a) or jumps(*a))
    got = {r.url: (r.n_pages, r["items"]) for r in catalog.merge_page_chains(pages, 4).collect()}
    assert got == {"a0": (4, ["0", "1", "2", "3"]), "r0": (3, ["x", "y", "z"])}
    assert len(made) == 1
