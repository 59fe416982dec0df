"""Ingest rates and progress."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import percent
from ..recovery import cut


def ticks(rows: DataFrame, ts: str, seconds: int = 5) -> DataFrame:
    """(tick, n): rows in each tick that has any."""
    return rows.groupBy(F.window(ts, f"{seconds} seconds").alias("w")).agg(F.count("*").alias("n")).select(F.col("w.start").alias("tick"), "n")


def every_tick(counted: DataFrame, seconds: int = 5) -> DataFrame:
    """counted with a row of n = 0 for each tick between the first and the last that has none."""
    kind = counted.schema["tick"].dataType
    least, most, span = counted.agg(F.min("tick").cast("string"), F.max("tick").cast("string"), F.timestamp_diff("SECOND", F.min("tick"), F.max("tick"))).first()
    if least is None:
        return counted
    made = counted.sparkSession.range(span // seconds + 1).select((F.lit(least).cast(kind) + F.make_dt_interval(secs=F.col("id") * seconds)).alias("tick"))
    return made.join(counted, "tick", "left").select("tick", F.coalesce("n", F.lit(0)).alias("n"))


def running_totals(rows: DataFrame, order: str, value: str, name: str) -> DataFrame:
    """rows with the sum of value up to each in order: ranges of order are summed in parallel and start from the sums of the
    ranges before them, of which the driver gets one number for each partition."""
    ranged = cut(rows.repartitionByRange(order).withColumn("_part", F.spark_partition_id()))
    sums = sorted(map(tuple, ranged.groupBy("_part").agg(F.sum(value)).collect()))
    before, total = [], 0
    for part, n in sums:
        before.append((part, total))
        total += n or 0
    starts = F.broadcast(rows.sparkSession.createDataFrame(before, "_part int, _before bigint"))
    inside = F.sum(value).over(Window.partitionBy("_part").orderBy(order).rowsBetween(Window.unboundedPreceding, 0))
    return ranged.withColumn(name, inside).join(starts, "_part").withColumn(name, F.col(name) + F.col("_before")).drop("_part", "_before")


def rates(counted: DataFrame, seconds: int = 5) -> DataFrame:
    """(tick, total, delta, rate): running totals, growth in each tick, also where it is 0, and per second; the first tick is dropped."""
    first = counted.agg(F.min("tick").alias("_first"))
    total = running_totals(every_tick(counted, seconds), "tick", "n", "total")
    rows = total.join(F.broadcast(first), F.col("tick") > F.col("_first"))  # one row
    return rows.select("tick", "total", F.col("n").alias("delta"), (F.col("n") / seconds).alias("rate"))


def history(rated: DataFrame, keep: int = 50) -> DataFrame:
    """The last ticks."""
    return rated.orderBy(F.desc("tick")).limit(keep)


class Watch:
    """Counts that a scan makes of its rows on the way, without a scan of their own: done, failed and what was made.

    Rows go through ``over``; once an action has read them, ``counts`` has the sums of all that was watched.
    """

    def __init__(self):
        self.seen: list[Observation] = []

    def over(self, rows: DataFrame, **what: Column) -> DataFrame:
        """rows, with the number of rows of each condition counted in passing; each name may be watched in several scans."""
        seen = Observation()
        self.seen.append(seen)
        return rows.observe(seen, *(F.count_if(c).alias(n) for n, c in what.items()))

    @property
    def counts(self) -> dict[str, int]:
        out: dict[str, int] = {}
        for seen in self.seen:
            for name, n in seen.get.items():
                out[name] = out.get(name, 0) + n
        return out


def running(spark: SparkSession) -> list[tuple[int, int, int, int]]:
    """(stage, tasks, done, failed) of what the session runs now."""
    tracker = spark.sparkContext.statusTracker()
    found = [tracker.getStageInfo(s) for s in tracker.getActiveStageIds()]
    return [(i.stageId, i.numTasks, i.numCompletedTasks, i.numFailedTasks) for i in found if i]


def status(rows: DataFrame, done: Column, failed: Column) -> DataFrame:
    """total, done, errors, in_flight and percent."""
    n = rows.agg(F.count("*").alias("total"), F.count_if(done).alias("done"), F.count_if(failed).alias("errors"))
    return n.withColumn("in_flight", F.col("total") - F.col("done") - F.col("errors")).withColumn("percent", percent(F.col("done"), F.col("total")))
