"""Stateful stages over streams."""

import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from sonolith.functions import dsp
from sonolith.operators.peaks import peaks
from sonolith.presets import AMPLITUDE_STREAM
from sonolith.streaming import ring, ticks

PRESET = ring.Preset(**{**AMPLITUDE_STREAM.__dict__, "bins": 12, "tested": (1, 10), "radius_t": 2, "radius_f": 2})


def ran(stream, tmp_path, name):
    """All rows of a stream that ends."""
    out, check = str(tmp_path / name), str(tmp_path / f"{name}-check")
    query = stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", check).trigger(availableNow=True).start()
    query.awaitTermination(240)
    assert query.exception() is None
    return stream.sparkSession.read.schema(stream.schema).parquet(out)


def test_pieces_of_a_track_give_the_peaks_of_the_whole(spark, tmp_path):
    rng = np.random.default_rng(2)
    tracks = {k: rng.integers(0, 40, (n, 12)).astype(float) for k, n in ((1, 61), (2, 7), (3, 33))}
    chunks = []
    for k, power in tracks.items():
        at, seq = 0, 0
        while at < len(power):
            size = int(rng.integers(1, 9))
            chunks.append((k, seq, [float(x) for x in power[at : at + size].ravel()]))
            at, seq = at + size, seq + 1
    rng.shuffle(chunks)
    shape = "track_id bigint, seq int, power array<double>"
    for part in range(4):  # micro-batches, in which chunks come before their turn
        spark.createDataFrame([(int(c[0]), int(c[1]), list(c[2])) for c in chunks[part::4]], shape).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(shape).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    got = {(r.track_id, r.t, r.f): r.m for r in ran(ring.ring_peaks(stream, PRESET), tmp_path, "peaks").collect()}
    want = {}
    for k, power in tracks.items():
        t, f, m, _ = dsp.peaks(power, PRESET)
        want |= {(k, int(a), int(b)): float(c) for a, b, c in zip(t, f, m, strict=True)}
    assert got.keys() == want.keys() and len(want) > 40 and all(got[x] == pytest.approx(want[x], abs=1e-9) for x in want)
    cells = spark.createDataFrame([(k, t, f, float(p[t, f])) for k, p in tracks.items() for t in range(len(p)) for f in range(12)], "track_id bigint, t int, f int, m double")
    assert {(r.track_id, r.t, r.f) for r in peaks(cells, PRESET).collect()} == want.keys()


def test_idle_ticks_of_a_stream_have_rows(spark, tmp_path):
    at = lambda s: dt.datetime(2020, 1, 1) + dt.timedelta(seconds=s)
    for part in ([0, 1, 6], [7, 8, 29], [28, 5, 61], [200]):
        spark.createDataFrame([("a", at(s)) for s in part], "source string, ts timestamp").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("source string, ts timestamp").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    got = ran(ticks.tick_rates(stream, 5, "source", late="0 seconds", keep=3), tmp_path, "rates").orderBy("tick").collect()
    deltas = [r.delta for r in got]
    first = next(i for i, r in enumerate(got) if r.tick == at(5))
    assert first == 0 and [(r.tick - got[0].tick).total_seconds() for r in got] == [5 * i for i in range(len(got))]  # no gap
    assert sum(deltas) == got[-1].total - 2 and deltas.count(0) > 5 and got[-1].tick >= at(60)
    assert [r.rate for r in got] == [r.delta / 5 for r in got] and all(list(r.recent) == deltas[max(0, i - 2) : i + 1] for i, r in enumerate(got))


def test_ticks_go_on_while_nothing_comes(spark, tmp_path):
    import time

    spark.createDataFrame([("a", dt.datetime(2020, 1, 1))] * 4, "source string, ts timestamp").coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = ticks.tick_rates(spark.readStream.schema("source string, ts timestamp").parquet(str(tmp_path / "in")), 1, "source", late=None)
    query = stream.writeStream.format("memory").queryName("live_ticks").option("checkpointLocation", str(tmp_path / "check")).trigger(processingTime="1 seconds").start()
    try:
        until = time.time() + 120
        while time.time() < until and spark.table("live_ticks").count() < 3 and query.exception() is None:
            time.sleep(1)
        rows = spark.table("live_ticks").orderBy("tick").collect()
        assert len(rows) >= 3 and all((r.delta, r.total) == (0, 4) for r in rows)
    finally:
        query.stop()
