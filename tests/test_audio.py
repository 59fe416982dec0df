import io
import wave

import numpy as np
import pytest
from pyspark.sql import functions as F

from sonolith.operators import index, landmarks, match
from sonolith.operators.monitor import Watch
from sonolith.presets import AMPLITUDE, LANDMARK
from sonolith.sources import audio
from sonolith.streaming import ingest


def tones(seed, seconds, rate=11025):
    rng = np.random.default_rng(seed)
    t = np.arange(int(rate * 0.5)) / rate
    parts = [sum(np.sin(2 * np.pi * f * t) for f in rng.uniform(200, 4000, 3)) for _ in range(int(seconds * 2))]
    return np.concatenate(parts) / 4


def wav(samples, rate=11025):
    out = io.BytesIO()
    with wave.open(out, "wb") as w:
        w.setnchannels(1)
        w.setsampwidth(2)
        w.setframerate(rate)
        w.writeframes((samples * 32767).astype("<i2").tobytes())
    return out.getvalue()


@pytest.fixture(scope="module")
def library(tmp_path_factory):
    root = tmp_path_factory.mktemp("music")
    for k in range(4):
        folder = root / f"artist{k}" / "album"
        folder.mkdir(parents=True)
        (folder / f"song{k}.WAV").write_bytes(wav(tones(k, 12)))
    (root / ".hidden.wav").write_bytes(wav(tones(9, 2)))
    (root / "tiny.wav").write_bytes(b"RIFF")
    (root / "wrong.wav").write_bytes(wav(tones(8, 4), 22050))
    (root / "notes.txt").write_text("x")
    return root


@pytest.mark.parametrize("preset", [LANDMARK, AMPLITUDE])
def test_a_cut_clip_is_found_at_its_offset(spark, library, tmp_path, preset):
    files = audio.scan(spark, str(library), ("wav",))
    valid, _ = audio.split_quarantine(files, audio.quarantine_reason(F.col("name"), F.col("length")))
    prints = landmarks.fingerprints(audio.clips_to_peaks(valid, preset).withColumnRenamed("rel_path", "track_id"), preset)
    start = 20
    (tmp_path / "clip.wav").write_bytes(wav(tones(2, 12)[start * preset.hop : start * preset.hop + 55000]))
    clip = audio.scan(spark, str(tmp_path), ("wav",))
    q = landmarks.fingerprints(audio.clips_to_peaks(clip, preset, query=True).withColumnRenamed("rel_path", "track_id"), preset)
    q = q.select(F.lit(1).cast("bigint").alias("query_id"), "hash", F.col("anchor_t").alias("t1"))
    best = match.match(q, prints, preset).orderBy("rank").first()
    assert best.track_id == "artist2/album/song2.WAV" and best.offset_frames == start


def test_scan_quarantine_and_probe(spark, library):
    files = audio.scan(spark, str(library), ("wav",))
    # the reader itself passes over names with a leading dot
    assert files.count() == 6 and audio.scan(spark, str(library), ("wav",), any_case=False).count() == 2
    _, held = audio.split_quarantine(files, audio.quarantine_reason(F.col("name"), F.col("length")))
    assert {(r.name, r.reason) for r in held.collect()} == {("tiny.wav", "too small")}
    assert spark.range(1).select(audio.quarantine_reason(F.lit("._x"), F.lit(99_999))).first()[0] == "hidden"
    found = {r.rel_path: r for r in audio.probe(files, LANDMARK).collect()}
    assert found["wrong.wav"].readable and not found["tiny.wav"].readable and found["tiny.wav"].reason.startswith("unreadable")
    assert abs(found["artist0/album/song0.WAV"].duration - 12) < 0.01
    assert audio.count_files(spark, str(library)).first().n_files >= 6


def test_track_rows_and_tags(spark, library):
    files = audio.scan(spark, str(library), ("wav",), content=False)
    tags = spark.createDataFrame([("artist1/album/song1.WAV", "Known", " ", "Name")], "rel_path string, artist string, album string, title string")
    got = {r.rel_path: (r.artist, r.album, r.title) for r in audio.track_rows(files, tags).collect()}
    assert got["artist1/album/song1.WAV"] == ("Known", "album", "Name") and got["tiny.wav"] == ("Unknown", "Unknown", "tiny.wav")
    probed = audio.probe_tags(spark.createDataFrame([('{"format": {"duration": "3,5", "tags": {"TITLE": "x", "artist": "y"}}}',), ("broken",)], "value string")).collect()
    assert [(r.title, r.artist, r.duration) for r in probed] == [("x", "y", 3.5), (None, None, 0.0)]


def test_stream_makes_segments_once(spark, library, tmp_path):
    root, check, watch = str(tmp_path / "index"), str(tmp_path / "check"), Watch()
    for _ in range(2):  # the second run has nothing new
        query = ingest.index_stream(ingest.stream_files(spark, str(library)), root, LANDMARK, check, every=None, watch=watch)
        query.awaitTermination(120)
        assert query.exception() is None
    tracks, prints = index.read_index(spark, root)
    assert tracks.count() == 5 and tracks.select("rel_path").distinct().count() == 5
    assert prints.select("track_id").distinct().count() == 5
    assert watch.counts == {"done": 5, "failed": 0, "hashes": prints.count()}
    assert [(r.segment_id, r.num_tracks) for r in index.manifest(spark, root).collect()] == [(0, 5)]


@pytest.mark.parametrize("first", ["batch", "stream"])
def test_batch_and_stream_share_an_index(spark, library, tmp_path, first):
    from sonolith.api import Engine

    one, two = tmp_path / "one" / "x" / "y", tmp_path / "two" / "x" / "y"
    for k, folder in enumerate((one, two)):
        folder.mkdir(parents=True)
        (folder / f"t{k}.wav").write_bytes(wav(tones(k + 7, 6)))
    engine = Engine(spark, str(tmp_path / "index"))

    def batch(folder):
        assert engine.add_segment(str(folder)) == 1

    def stream(folder):
        query = ingest.index_stream(ingest.stream_files(spark, str(folder)), engine.root, LANDMARK, str(tmp_path / "check"), every=None)
        query.awaitTermination(120)
        assert query.exception() is None

    for step, folder in zip((batch, stream) if first == "batch" else (stream, batch), ("one", "two"), strict=True):
        step(tmp_path / folder)
    tracks, prints = index.read_index(spark, engine.root)
    assert sorted((r.segment_id, r.rel_path) for r in tracks.select("segment_id", "rel_path").collect()) == [(0, "x/y/t0.wav"), (1, "x/y/t1.wav")]
    assert prints.select("track_id").distinct().count() == 2


def test_compaction_takes_the_latest_of_a_track(spark, tmp_path):
    from sonolith.api import Engine

    (tmp_path / "in" / "x" / "y").mkdir(parents=True)
    (tmp_path / "in" / "x" / "y" / "one.wav").write_bytes(wav(tones(3, 6)))
    engine = Engine(spark, str(tmp_path / "index"))
    assert engine.add_segment(str(tmp_path / "in")) == 1 and engine.add_segment(str(tmp_path / "in"), force=True) == 1
    engine.compact(str(tmp_path / "compact"))
    tracks, prints = index.read_index(spark, str(tmp_path / "compact"))
    assert [(r.track_id, r.rel_path) for r in tracks.collect()] == [(0, "x/y/one.wav")]
    assert prints.count() * 2 == index.read_index(spark, engine.root)[1].count()


def test_files_that_cannot_be_decoded_are_no_tracks(spark, tmp_path):
    from sonolith.api import Engine

    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "broken.wav").write_bytes(b"RIFF" + b"x" * 20_000)
    (tmp_path / "in" / "small.wav").write_bytes(b"x")
    (tmp_path / "in" / "good.wav").write_bytes(wav(tones(3, 6)))
    engine, watch = Engine(spark, str(tmp_path / "index")), Watch()
    assert engine.add_segment(str(tmp_path / "in"), watch=watch) == 1
    assert watch.counts == {"done": 1, "failed": 1, "hashes": index.read_index(spark, engine.root)[1].count()}
    assert {r.rel_path: r.reason.split(":")[0] for r in engine.rejected(str(tmp_path / "in")).collect()} == {"broken.wav": "unreadable", "small.wav": "too small"}


@pytest.mark.parametrize("rate", [44100, 22050, 8000, 16000])
def test_resampling_keeps_tones(rate):
    t = np.arange(rate) / rate
    got = audio.resample(np.sin(2 * np.pi * 440 * t), rate, 11025)
    want = np.sin(2 * np.pi * 440 * np.arange(11025) / 11025)
    assert len(got) == 11025 and np.abs(got - want)[200:-200].max() < 0.01
    if rate > 11025:  # what the lower rate can't hold is gone
        assert np.abs(audio.resample(np.sin(2 * np.pi * 7000 * t), rate, 11025))[200:-200].max() < 0.05


def test_sample_widths():
    x = np.array([-1.0, -0.5, 0.0, 0.5])
    assert np.allclose(audio.pcm(bytes(((x + 1) * 128).astype(np.uint8)), 1), x)
    assert np.allclose(audio.pcm((x * 32768).astype("<i2").tobytes(), 2), x)
    assert np.allclose(audio.pcm(b"".join(int(v * 8388608).to_bytes(3, "little", signed=True) for v in x), 3), x)
    assert np.allclose(audio.pcm((x * 2147483648).astype("<i4").tobytes() + b"odd", 4), x)


def test_engine_adds_queries_and_compacts(spark, library, tmp_path):
    from sonolith.api import Engine

    engine = Engine(spark, str(tmp_path / "index"))
    assert engine.add_segment(str(library)) == 5 and engine.add_segment(str(library)) == 0
    (tmp_path / "clips").mkdir()
    for k in (1, 3):
        (tmp_path / "clips" / f"c{k}.wav").write_bytes(wav(tones(k, 12)[10 * 1024 : 10 * 1024 + 50000]))
    best = {r.query_id.rpartition("/")[2]: (r.title, r.offset_frames) for r in engine.query(str(tmp_path / "clips"), 1).collect()}
    assert best == {"c1.wav": ("song1", 10), "c3.wav": ("song3", 10)}
    assert engine.add_segment(str(library), force=True) == 5
    again = {r.query_id.rpartition("/")[2]: r.votes for r in engine.query(str(tmp_path / "clips"), 1).collect()}
    engine.compact(str(tmp_path / "one"))
    assert Engine(spark, str(tmp_path / "one")).query(str(tmp_path / "clips"), 1).count() == len(again) == 2
    assert engine.describe(str(tmp_path / "clips" / "c1.wav")).first().n_hashes > 0


def test_a_root_with_quotes_is_scanned(spark, tmp_path):
    root = tmp_path / "it's 'so' here"
    (root / "a" / "b").mkdir(parents=True)
    (root / "a" / "b" / "x.wav").write_bytes(wav(tones(1, 2)))
    assert [r.rel_path for r in audio.scan(spark, str(root), ("wav",)).collect()] == ["a/b/x.wav"]
    assert "rel_path" in ingest.stream_files(spark, str(root)).columns
