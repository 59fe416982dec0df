"""Rates of a live stream, also of ticks in which nothing came: a state with a timer for each source.

The timer fires at the end of a tick and gives a row for every tick since the last, with zeros for idle ones. Ticks are of
event time, closed by the watermark, or of processing time, which goes on while nothing comes.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

SHAPE = "source string, tick timestamp, total bigint, delta bigint, rate double, recent array<bigint>"


class TickRates(StatefulProcessor):
    """Rows (source, ms). A row that comes after its tick was told counts in the next one; the first tick is not told."""

    def __init__(self, seconds: int, live: bool, keep: int = 50):
        self.ms, self.live, self.keep = seconds * 1000, live, keep

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.head = handle.getValueState("head", "tick bigint, total bigint, told boolean, recent array<bigint>")
        self.counts = handle.getMapState("counts", "tick bigint", "n bigint")

    def _now(self, timerValues) -> int:
        return timerValues.getCurrentProcessingTimeInMs() if self.live else timerValues.getCurrentWatermarkInMs()

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        found: dict[int, int] = {}
        for batch in rows:
            ticks = pd.Series(self._now(timerValues), index=batch.index) if self.live else batch["ms"]
            for tick, n in (ticks // self.ms).value_counts().items():
                found[int(tick)] = found.get(int(tick), 0) + int(n)
        if not self.head.exists():
            first = min(found)
            self.head.update((first, 0, False, []))
            self.handle.registerTimer((first + 1) * self.ms)
        head = self.head.get()[0]
        for tick, n in found.items():
            tick = (max(tick, head),)
            self.counts.updateValue(tick, ((self.counts.getValue(tick)[0] if self.counts.containsKey(tick) else 0) + n,))
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        tick, total, told, recent = self.head.get()
        recent, rows, now = list(recent), [], self._now(timerValues)
        while (tick + 1) * self.ms <= now:
            n = self.counts.getValue((tick,))[0] if self.counts.containsKey((tick,)) else 0
            if n:
                self.counts.removeKey((tick,))
            total += n
            if told:
                recent = [*recent, n][-self.keep :]
                rows.append((key[0], pd.Timestamp(tick * self.ms, unit="ms", tz="UTC"), total, n, n * 1000 / self.ms, list(recent)))
            tick, told = tick + 1, True
        self.head.update((tick, total, told, recent))
        self.handle.registerTimer((tick + 1) * self.ms)
        if rows:
            yield pd.DataFrame(rows, columns=["source", "tick", "total", "delta", "rate", "recent"])


def tick_rates(events: DataFrame, seconds: int = 5, source: str | None = None, ts: str = "ts", late: str | None = "10 seconds", keep: int = 50) -> DataFrame:
    """(source, tick, total, delta, rate, recent) of a stream; recent: the last deltas. late: how long rows of a tick are
    waited for in event time, or None for ticks of processing time."""
    events.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    key = (F.col(source).cast("string") if source else F.lit("")).alias("source")
    rows = events.withWatermark(ts, late) if late else events
    rows = rows.select(key, F.unix_millis(F.col(ts).cast("timestamp")).alias("ms"), *([ts] if late else []))
    return rows.groupBy("source").transformWithStateInPandas(TickRates(seconds, late is None, keep), SHAPE, "Append", "EventTime" if late else "ProcessingTime")
