"""Small helpers shared by the operators of this subpackage."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from ..recovery import cut, shared_dir

#: Tasks that rows of one key are dealt to where a join is too large to broadcast.
SALTS = 64

__all__ = ["constant_array", "cut", "filter_texts", "hash_order", "id_remainder", "remove", "session_partitions", "shared_dir", "shared_path", "sized_join", "small_batches", "table"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the data directory; only Spark's reader touches the path."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_path(spark: SparkSession, kind: str) -> str:
    """A new path in the shared folder."""
    return f"{shared_dir(spark)}/{kind}-{uuid.uuid4().hex}"


@contextmanager
def small_batches(spark: SparkSession, most: str = "4m") -> Iterator[None]:
    """Within it, Arrow batches of plans that run hold so many bytes: whole texts otherwise fill the largest, which the
    executor holds twice while it grows, for each of its tasks."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(key, None)
    spark.conf.set(key, most)
    try:
        yield
    finally:
        spark.conf.unset(key) if before is None else spark.conf.set(key, before)


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder of ours in the shared one."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def id_remainder(column: Column, modulus: int) -> Column:
    """crc32 of the id's decimal text modulo ``modulus``; a null id counts as the empty text."""
    return F.pmod(F.crc32(F.coalesce(column.cast("string"), F.lit("")).cast("binary")), F.lit(modulus))


def constant_array(values: list, kind: str = "string") -> Column:
    """A constant array column of short values without commas, folded to one literal."""
    if not values:
        return F.array().cast(f"array<{kind}>")
    return F.split(F.lit(",".join(map(str, values))), ",").cast(f"array<{kind}>")


def hash_order(seed: int, *columns: Column) -> Column:
    """A deterministic pseudo-random order of rows."""
    return F.xxhash64(F.lit(seed), *columns)


def session_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions", "200"))


def sized_join(rows: DataFrame, right: DataFrame, keys: list[str], most: int, how: str = "inner") -> DataFrame:
    """rows joined with right on keys: right is broadcast if it has at most ``most`` rows.

    Beyond, both are shuffled and the rows of a key are dealt to SALTS tasks by their hash, each of which gets right's
    rows of that key: a key with a third of all rows is split. The salt is a function of the row, so a task that is run
    again after a lost executor gives the same.
    """
    if right.count() <= most:
        return rows.join(F.broadcast(right), keys, how)
    salt = "\x00salt"
    dealt = rows.withColumn(salt, F.pmod(F.xxhash64(*rows.columns), F.lit(SALTS)).cast("int"))
    every = right.withColumn(salt, F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return dealt.join(every, [*keys, salt], how).drop(salt)


def filter_texts(docs: DataFrame, keep: Callable[[], Callable], columns: tuple[str, ...] = ("text",)) -> DataFrame:
    """The rows that keep()(Arrow table of columns) marks, with all their columns. keep is called once in a task.

    Rows go through Arrow batches a slice at a time: neither side holds more rows than a batch.
    """
    import pyarrow as pa
    import pyarrow.compute as pc

    from .text_arrays import release, slices

    names = docs.columns
    places = [names.index(c) for c in columns]
    plain = [f"c{i}" for i in range(len(names))]  # theirs may hold dots or clash

    def run(batches: Iterator) -> Iterator:
        judge = keep()
        for batch in batches:
            texts = pc.cast(batch.column(places[0]), pa.string())
            asked = pa.RecordBatch.from_arrays([texts, *(batch.column(p) for p in places[1:])], names=list(columns))
            at = 0
            for some in slices(asked, 0):
                yield batch.slice(at, some.num_rows).filter(pa.array(judge(some), pa.bool_()))
                at += some.num_rows
        release()

    schema = StructType([StructField(n, f.dataType, f.nullable) for n, f in zip(plain, docs.schema, strict=True)])
    return docs.toDF(*plain).mapInArrow(run, schema).toDF(*names)
