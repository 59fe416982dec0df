"""Files that appear whole and once, by which writers that know nothing of each other agree.

``publish`` creates a file with its text or says that there is one already. On a mounted file system a finished file is
linked to the name, which fails if the name is taken; on other stores Hadoop's rename that doesn't overwrite does it.
Of several writers of one name exactly one succeeds, and no reader sees half a file. What a run writes lies in folders of
its own and counts once its line is published; several outputs of one line appear together.
"""

from __future__ import annotations

import json
import os
import uuid

from py4j.protocol import Py4JJavaError
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession


def _file_system(spark: SparkSession, path: str):
    """(Hadoop's path, its file system)."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where, where.getFileSystem(spark._jsc.hadoopConfiguration())


def publish(spark: SparkSession, path: str, text: str) -> bool:
    """Create a file with that text; False if the name is taken."""
    where, store = _file_system(spark, path)
    part = spark._jvm.org.apache.hadoop.fs.Path(where.getParent(), f".{where.getName()}.{uuid.uuid4().hex}")
    if store.getUri().getScheme() == "file":
        return _link(part.toUri().getPath(), where.toUri().getPath(), text)
    store.mkdirs(where.getParent())
    return _rename(spark, part, where, text)


def _link(part: str, path: str, text: str) -> bool:
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(part, "x", encoding="utf-8") as out:
        out.write(text)
        out.flush()
        os.fsync(out.fileno())
    try:
        os.link(part, path)
        return True
    except FileExistsError:
        return False
    finally:
        os.unlink(part)


def _rename(spark: SparkSession, part, where, text: str) -> bool:
    hadoop, conf = spark._jvm.org.apache.hadoop.fs, spark._jsc.hadoopConfiguration()
    store = where.getFileSystem(conf)
    out = store.create(part, False)
    out.write(bytearray(text.encode()))
    out.close()
    how = spark.sparkContext._gateway.new_array(hadoop.Options.Rename, 1)
    how[0] = hadoop.Options.Rename.NONE
    try:
        hadoop.FileContext.getFileContext(where.toUri(), conf).rename(part, where, how)
        return True
    except Py4JJavaError as e:
        if "FileAlreadyExistsException" not in e.java_exception.getClass().getName():
            raise
        return False
    finally:
        store.delete(part, False)


def lines(spark: SparkSession, folder: str, schema: str) -> DataFrame:
    """The published lines of a folder; an empty frame before the first."""
    try:
        return spark.read.schema(schema).json(folder)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


def commit_tables(tables: dict[str, DataFrame], root: str, run: str) -> bool:
    """Write several tables as one: all of them are seen once the run's line is there, none before. False if the run is there already.

    A run that failed, or one that lost to another of its name, leaves folders that no reader looks at.
    """
    spark = next(iter(tables.values())).sparkSession
    if not lines(spark, f"{root}/commits", COMMIT).where(f"run = {_literal(run)}").isEmpty():
        return False
    attempt = uuid.uuid4().hex
    for name, rows in tables.items():
        rows.write.parquet(f"{root}/{name}/attempt={attempt}")
    return publish(spark, f"{root}/commits/{_file_name(run)}.json", json.dumps({"run": run, "attempt": attempt, "tables": sorted(tables)}))


COMMIT = "run string, attempt string, tables array<string>"


def committed(spark: SparkSession, root: str, name: str) -> DataFrame | None:
    """The rows of a table over all runs that are committed, with run; None before the first."""
    done = lines(spark, f"{root}/commits", COMMIT).where(f"array_contains(tables, {_literal(name)})").select("run", "attempt").collect()  # a row for each run
    if not done:
        return None
    rows = spark.read.option("basePath", f"{root}/{name}").parquet(*(f"{root}/{name}/attempt={r.attempt}" for r in done))
    runs = spark.createDataFrame([(r.attempt, r.run) for r in done], "attempt string, run string")
    return rows.join(runs.hint("broadcast"), "attempt").drop("attempt")


def _literal(text: str) -> str:
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _file_name(run: str) -> str:
    """A name for any text: letters and digits as they are, others by number."""
    return "".join(c if c.isalnum() and c.isascii() or c in "-" else f"_{ord(c):x}_" for c in run)
