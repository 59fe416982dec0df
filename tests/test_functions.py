from pyspark.sql import functions as F

from sonolith.functions import hashing, text


def one(spark, *columns):
    return spark.range(1).select(*columns).first()


def test_hash_layouts(spark):
    x = lambda *v: [F.lit(i) for i in v]
    r = one(spark, hashing.pack22(*x(1, 2, 3)), hashing.pack22(*x(1022, 1022, 60)), hashing.pack16(*x(1, 2, 3)), hashing.pack16q(*x(10, 30, 1)))
    assert tuple(r) == (4398048608259, 4494804605993020, 281483566841856, 1407439308062720)


def test_frames_to_milliseconds(spark):
    frames = [0, 1, 2, 3, 4, 5, 10, 11, 64, 65]
    rows = spark.createDataFrame([(f,) for f in frames], "t int").select("t", hashing.frame_to_ms(F.col("t")).alias("ms")).collect()
    assert {r.t: r.ms for r in rows} == dict(zip(frames, [0, 46, 92, 139, 185, 232, 464, 510, 2972, 3018], strict=True))


def test_quad_hash_seeds(spark):
    parts = [F.lit(v) for v in (1, 2, 3, 4, 46, 92, 139)]
    data = hashing.big_endian16(*parts)
    r = one(spark, F.hex(data), hashing.hash_hex(hashing.quad64(*parts)), hashing.hash_hex(hashing.xxhash64_seeded(data, 0)), hashing.hash_hex(hashing.xxhash64_seeded(data, 42)))
    assert tuple(r) == ("0001000200030004002E005C008B", "bfa245a3ddb972ed", "8dacac388f90d819", "bfa245a3ddb972ed")


def test_hex_keys(spark):
    r = one(spark, hashing.hash_of_hex(F.lit("ffffffffffffffff")), hashing.hash_of_hex(F.lit("000fA00000000001")), hashing.hash_of_hex(F.lit("12")), hashing.hash_hex(F.lit(-2).cast("bigint")))
    assert tuple(r) == (-1, 0x000FA00000000001, None, "fffffffffffffffe")


def test_names(spark):
    r = one(spark, text.normalise(F.lit("Beyoncé - Halo!!")), text.token_overlap(F.lit("a b c d e"), F.lit("c b a x")), text.tokens_match(F.lit("a b c d e"), F.lit("c b a")), text.tokens_match(F.lit("a b c d"), F.lit("a b")))
    assert tuple(r) == ("beyonc halo", 0.6, True, False)
    assert one(spark, text.token_overlap(F.lit(""), F.lit("x")))[0] == 0.0
    assert one(spark, text.token_overlap(F.lit("a a b"), F.lit("a")))[0] == 0.667


def test_path_metadata(spark):
    rows = spark.createDataFrame([("A/B/C.m4a",), ("x/A/B/C.m4a",), ("B/C.m4a",), ("",)], "p string").select(*text.path_metadata(F.col("p")).values()).collect()
    assert [tuple(r) for r in rows] == [("A", "B", "C"), ("A", "B", "C"), ("Unknown", "Unknown", "C.m4a"), ("Unknown", "Unknown", "")]


def test_identifiers(spark):
    ident = "0123456789abcdefghijAB"
    raw = [ident, f"spotify:track:{ident}", f"https://open.spotify.com/album/{ident}?si=1", "nothing", None, f"https://evil.example/track/{ident}", f" https://open.spotify.com/track/{ident}/x ", "spotify:track:short"]
    got = [r[0] for r in spark.createDataFrame([(x,) for x in raw], "x string").select(text.resolve_id(F.col("x"), "track")).collect()]
    assert [(g.id, g.reason) for g in got] == [(ident, None), (ident, None), (None, "not of kind track"), (None, "not an identifier"), (None, "not an identifier"), (None, "unsupported host"), (ident, None), (None, "not an identifier")]
    assert one(spark, text.seed_id(F.lit(f"https://h/artist/{ident}?x")))[0] == ident
    uri = f"spotify:track:{ident}"
    r = one(spark, text.download_uri(F.lit(ident), F.lit("")), text.download_uri(F.lit(None), F.lit(uri)), text.download_uri(F.lit("x"), F.lit(f"https://h/t/{ident}?a")), text.download_uri(F.lit("x"), F.lit(f"https://h/{ident}/more")))
    assert tuple(r) == (uri,) * 4


def test_small_functions(spark):
    r = one(
        spark, text.clip_base(F.lit("a_clip30_clip30.flac")), text.safe_file_name(F.lit("a  b\tc")), text.picture_extension(F.lit("image/PNG")), text.picture_extension(F.lit("x")), text.hms(F.lit(3725)),
        text.percent(F.lit(1), F.lit(0)), text.low_bitrate(F.lit(256_000)), text.low_bitrate(F.lit(288_000)), text.decimal_seconds(F.lit("1,5")), text.decimal_seconds(F.lit("?")), text.or_unknown(F.lit(" ")),
    )
    assert tuple(r) == ("a_clip30", "a_b_c", ".png", ".jpg", "01:02:05", 0.0, True, False, 1.5, 0.0, "unknown")
    assert one(spark, hashing.quad_bin(F.lit(2047)), hashing.quad_delta(F.lit(-4)), hashing.quad_delta(F.lit(70_000)))[0:3] == (1023, 0, 65535)
    assert one(spark, text.dynamic_text(F.lit('{"a": "x"}'), "$.a"), text.dynamic_number(F.lit('{"a": "x"}'), "$.a"), text.dynamic_number(F.lit("{"), "$.a"))[0:3] == ("x", 0, 0)


def test_dynamic_members_of_other_types(spark):
    rows = ['{"k": 5}', '{"k": 1.5}', '{"k": "5"}', '{"k": {"a": 1}}', '{"k": true}', '{"k": null}', "{}", "{", None]
    got = spark.createDataFrame([(i, x) for i, x in enumerate(rows)], "i int, x string").select("i", text.dynamic_number(F.col("x"), "$.k"), text.dynamic_text(F.col("x"), "$.k")).collect()
    assert [tuple(r)[1:] for r in sorted(got)] == [(5.0, ""), (1.5, ""), (0.0, "5"), *[(0.0, "")] * 6]
