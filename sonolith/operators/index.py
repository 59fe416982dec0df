"""The fingerprint index: a Parquet table of postings by segment, bucketed and sorted by hash.

A run is one writing of one segment and has folders of its own. A segment exists once its line is published: a file of
the manifest named by its number, which exactly one of several writers can create; the others take the next number. The
guard of parameters holds for all lines before the one that is created. What a writer that failed has left is never
read. Of a track in several segments the latest one counts.

Postings are dealt into buckets by hash, as many in every segment, and each file is one bucket sorted by hash: row-group
statistics prune point look-ups, and a batch of queries too large to broadcast is dealt to the buckets where they lie,
without moving the postings. A line has every file's length, rows and checksum, so that damage is found and told.
"""

from __future__ import annotations

import hashlib
import json
import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..commits import lines, publish
from ..functions import hashing
from ..presets import Preset
from ..recovery import cut

#: Buckets of a new index, if the session has no more shuffle partitions: fewer would have the planner move the postings.
BUCKETS = 64
#: Replaced (track, segment) pairs up to which they are broadcast.
BROADCAST_REPLACED = 1_000_000
#: Hashes (8 bytes and a hash entry each) up to which a look-up broadcasts them.
BROADCAST_HASHES = 1_000_000


def number_tracks(tracks: DataFrame, order: str = "rel_path", name: str = "track_id") -> DataFrame:
    """tracks with dense ids in the order of a column: ranges of the column are numbered in parallel, offset by the ranges
    before them. The ranges are read twice, so they come from a checkpoint: drawn again they could differ."""
    spread = tracks.repartitionByRange(F.col(order)).sortWithinPartitions(order).withColumn("_part", F.spark_partition_id())
    spread = cut(spread.withColumn("_row", F.row_number().over(Window.partitionBy("_part").orderBy(order))))
    sizes = spread.groupBy("_part").agg(F.max("_row").alias("_n"))
    before = sizes.withColumn("_before", F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    return spread.join(F.broadcast(before.select("_part", "_before")), "_part").withColumn(name, F.col("_before") + F.col("_row") - 1).drop("_part", "_row", "_before")


def write_segment(tracks: DataFrame, fingerprints: DataFrame, root: str, preset: Preset, run: str | None = None, compression: str = "zstd", buckets: int | None = None) -> int:
    """Add a segment after the parameter guard: tracks, postings in buckets, then its line in the manifest; its id.

    A run that has a line already is left as it is, also where it got it meanwhile; one that failed before its line is
    written anew. An index keeps the number of buckets of its first segment.
    """
    spark = tracks.sparkSession
    known = _guarded(spark, root, preset)
    for line in known:
        if run and line.run == run:
            return line.segment_id
    n = known[0].buckets if known else buckets or max(BUCKETS, int(spark.conf.get("spark.sql.shuffle.partitions")))
    run = run or f"r{uuid.uuid4().hex}"
    path = f"run={uuid.uuid4().hex}"
    tracks.write.option("compression", compression).parquet(f"{root}/tracks/{path}")
    _write_buckets(fingerprints, f"{root}/fingerprints/{path}", n, compression)
    schemas = {"tracks": tracks.schema.json(), "fingerprints": fingerprints.schema.json()}
    files = [f.asDict() for kind, schema in schemas.items() for f in file_sums(spark, root, kind, [path], schema).collect()]  # a row for each file
    line = {
        "path": path, "run": run, "created_at": spark.sql("select cast(current_timestamp() as string)").first()[0], "num_tracks": sum(f["rows"] for f in files if f["kind"] == "tracks"),
        "params": {"sr": preset.sample_rate, "frame": preset.window, "hop": preset.hop}, "buckets": n, "files": files, "schemas": schemas,
    }
    while True:
        segment_id = max((k.segment_id for k in known), default=-1) + 1
        if publish(spark, f"{root}/manifest/{segment_id:010d}.json", json.dumps(line | {"segment_id": segment_id})):
            return segment_id
        known = _guarded(spark, root, preset)  # another writer was first
        for other in known:
            if other.run == run:
                return other.segment_id
            if other.buckets != n:
                raise ValueError(f"segment {other.path} has {other.buckets} buckets, not {n}: write it again")


def _write_buckets(fingerprints: DataFrame, path: str, n: int, compression: str) -> None:
    """One file for each bucket; the table that names the buckets is dropped, its files stay."""
    spark, name = fingerprints.sparkSession, f"sonolith_{uuid.uuid4().hex}"
    dealt = fingerprints.repartition(n, "hash").write.bucketBy(n, "hash").sortBy("hash")
    dealt.option("path", path).option("compression", compression).format("parquet").saveAsTable(name)
    spark.sql(f"DROP TABLE {name}")


def file_sums(spark: SparkSession, root: str, kind: str, paths: list[str], schema: str, readable_only: bool = False) -> DataFrame:
    """(kind, path, name, length, rows, checksum) of the files of runs of one schema, in JSON. readable_only passes over what can't be read."""
    how = {"ignoreCorruptFiles": "true", "ignoreMissingFiles": "true"} if readable_only else {}
    rows = spark.read.options(basePath=f"{root}/{kind}", **how).schema(StructType.fromJson(json.loads(schema))).parquet(*(f"{root}/{kind}/{p}" for p in paths))
    values = [c for c in rows.columns if c != "run"]
    total = F.sum(F.xxhash64(*values).cast("decimal(38,0)"))  # in any order of rows
    place = F.col("_metadata.file_path")
    found = rows.groupBy(F.element_at(F.split(place, "/"), -2).alias("path"), F.element_at(F.split(place, "/"), -1).alias("name"), F.col("_metadata.file_size").alias("length"))
    return found.agg(F.count("*").alias("rows"), total.cast("string").alias("checksum")).select(F.lit(kind).alias("kind"), "path", "name", "length", "rows", "checksum")


MANIFEST = """path string, segment_id int, run string, created_at timestamp, num_tracks int, params struct<sr:int,frame:int,hop:int>, buckets int,
  files array<struct<kind:string,path:string,name:string,length:bigint,rows:bigint,checksum:string>>, schemas map<string,string>"""


def manifest(spark: SparkSession, root: str) -> DataFrame:
    """The segments; an empty frame before the first."""
    return lines(spark, f"{root}/manifest", MANIFEST)


def _guarded(spark: SparkSession, root: str, preset: Preset) -> list:
    """(segment_id, run, path, buckets) of all segments, after the guard."""
    check_parameters(spark, root, preset)
    return manifest(spark, root).select("segment_id", "run", "path", "buckets").orderBy("segment_id").collect()


def bucket_rows(spark: SparkSession, root: str) -> DataFrame:
    """(segment_id, bucket, n_postings) from the manifest alone."""
    files = manifest(spark, root).select("segment_id", F.inline("files")).where("kind = 'fingerprints'")
    return files.groupBy("segment_id", F.regexp_extract("name", r"_(\d+)\.", 1).cast("int").alias("bucket")).agg(F.sum("rows").alias("n_postings"))


def damaged(spark: SparkSession, root: str, full: bool = False) -> DataFrame:
    """(segment_id, kind, path, name, problem): files of the manifest that are missing or of another length; full reads them
    all and tells those of other rows or another checksum, too."""
    wanted = manifest(spark, root).select("segment_id", "schemas", F.inline("files"))
    frames = []
    for kind in ("tracks", "fingerprints"):
        own = wanted.where(F.col("kind") == kind)
        paths = [r.path for r in own.select("path").distinct().collect()]  # a row for each segment
        if not paths:
            continue
        there = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(f"{root}/{kind}").select("path", F.col("length").alias("_length"))  # no file is opened
        parts = F.split("path", "/")
        there = there.select(F.element_at(parts, -2).alias("path"), F.element_at(parts, -1).alias("name"), "_length")
        state = own.join(there, ["path", "name"], "left").withColumn("problem", F.when(F.col("_length").isNull(), "missing").when(F.col("_length") != F.col("length"), "length"))
        if full:
            known = own.join(there.select("path").distinct(), "path", "left_semi").groupBy(F.col("schemas")[kind].alias("schema")).agg(F.collect_set("path").alias("paths")).collect()
            read = [file_sums(spark, root, kind, k.paths, k.schema, readable_only=True).select("path", "name", F.col("rows").alias("_rows"), F.col("checksum").alias("_checksum")) for k in known]
            if read:
                read = reduce(DataFrame.unionByName, read)
                state = state.join(read, ["path", "name"], "left").withColumn("problem", F.coalesce("problem", F.when(~(F.col("rows").eqNullSafe(F.col("_rows")) & F.col("checksum").eqNullSafe(F.col("_checksum"))), "contents")))
        frames.append(state.where("problem is not null").select("segment_id", "kind", "path", "name", "problem"))
    return frames[0].unionByName(frames[1]) if len(frames) == 2 else frames[0] if frames else spark.createDataFrame([], "segment_id int, kind string, path string, name string, problem string")


def abandoned(spark: SparkSession, root: str) -> DataFrame:
    """(kind, path) of folders of runs without a line: of writers that failed, or that are still at work."""
    known = manifest(spark, root).select("path").distinct()
    frames = []
    for kind in ("tracks", "fingerprints"):
        files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(f"{root}/{kind}").select("path")
        frames.append(files.select(F.lit(kind).alias("kind"), F.element_at(F.split("path", "/"), -2).alias("path")).distinct().join(known, "path", "left_anti"))
    return frames[0].unionByName(frames[1])


def mismatched(segments: DataFrame, preset: Preset) -> DataFrame:
    """Segments of other parameters; a rate of 0 or null is unset and fits anything."""
    own = F.struct(F.lit(preset.sample_rate).alias("sr"), F.lit(preset.window).alias("frame"), F.lit(preset.hop).alias("hop"))
    # inside a lambda, as the JSON reader can't take this predicate
    wrong = F.transform(F.array("params"), lambda p: (F.coalesce(p["sr"], F.lit(0)) != 0) & ~p.eqNullSafe(own))
    return segments.where(F.element_at(wrong, 1))


def check_parameters(spark: SparkSession, root: str, preset: Preset) -> None:
    wrong = mismatched(manifest(spark, root), preset).limit(1).collect()
    if wrong:
        raise ValueError(f"segment {wrong[0]['path']} has other parameters than {preset.name}")


def with_defaults(segments: DataFrame, preset: Preset) -> DataFrame:
    """Zero or absent parameters as the preset's."""
    fill = lambda k, v: F.coalesce(F.nullif(F.col(f"params.{k}"), F.lit(0)), F.lit(v)).alias(k)
    return segments.withColumn("params", F.struct(fill("sr", preset.sample_rate), fill("frame", preset.window), fill("hop", preset.hop)))


def read_index(spark: SparkSession, root: str, segments: list[int] | None = None, bucketed: bool = False, skip_damaged: bool = False) -> tuple[DataFrame, DataFrame]:
    """(tracks, fingerprints) of the segments in the manifest, or of some, with segment_id; only their folders are read.

    bucketed: the postings know that they lie in buckets, for batches too large to broadcast. skip_damaged leaves out
    the segments that ``damaged`` tells.
    """
    found = manifest(spark, root).select("segment_id", "path", "buckets").collect()  # a row for each segment
    if skip_damaged:
        bad = {r.segment_id for r in damaged(spark, root).select("segment_id").distinct().collect()}
        found = [r for r in found if r.segment_id not in bad]
    found = [r for r in found if segments is None or r.segment_id in segments]
    if not found:
        raise ValueError(f"no segment to read at {root}")
    runs = F.broadcast(spark.createDataFrame([(r.path.removeprefix("run="), r.segment_id) for r in found], "run string, segment_id int"))

    def plain(name: str) -> DataFrame:
        return spark.read.option("basePath", f"{root}/{name}").parquet(*(f"{root}/{name}/{r.path}" for r in found))

    postings = _buckets(spark, root, [r.path for r in found], found[0].buckets) if bucketed else plain("fingerprints")
    return tuple(f.withColumn("run", F.col("run").cast("string")).join(runs, "run").drop("run") for f in (plain("tracks"), postings))


def _buckets(spark: SparkSession, root: str, paths: list[str], n: int) -> DataFrame:
    """The postings as a table of the session's catalogue that names their buckets; the files are where they were."""
    shape = spark.read.parquet(f"{root}/fingerprints/{paths[0]}").schema
    name = f"sonolith_{hashlib.sha256(f'{root} {n} {shape.json()}'.encode()).hexdigest()[:24]}"
    place = root.replace("\\", "\\\\").replace("'", "\\'")
    columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in shape)
    spark.sql(f"CREATE TABLE IF NOT EXISTS {name} ({columns}, run string) USING parquet PARTITIONED BY (run) CLUSTERED BY (hash) SORTED BY (hash) INTO {n} BUCKETS LOCATION '{place}/fingerprints'")
    runs = [p.removeprefix("run=") for p in paths]
    spark.sql(f"ALTER TABLE {name} ADD IF NOT EXISTS " + " ".join(f"PARTITION (run='{r}')" for r in runs))  # of the manifest only
    spark.catalog.refreshTable(name)
    return spark.table(name).where(F.col("run").isin(runs))


def current(tracks: DataFrame, fingerprints: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Both without what a later segment has anew: of every track its latest segment. Postings aren't moved for it unless
    very many tracks were replaced."""
    latest = tracks.groupBy("track_id").agg(F.max("segment_id").alias("_latest"), F.min("segment_id").alias("_first")).where("_latest > _first")
    replaced = cut(tracks.join(latest, "track_id").where("segment_id < _latest").select("track_id", "segment_id").distinct())
    n = replaced.count()
    if not n:
        return tracks, fingerprints
    replaced = F.broadcast(replaced) if n <= BROADCAST_REPLACED else replaced
    return tuple(f.join(replaced, ["track_id", "segment_id"], "left_anti") for f in (tracks, fingerprints))


def not_indexed(incoming: DataFrame, tracks: DataFrame, force: bool = False) -> DataFrame:
    """Incoming files whose rel_path isn't indexed; force takes all."""
    return incoming if force else incoming.join(tracks.select("rel_path").distinct(), "rel_path", "left_anti")


def indexed(incoming: DataFrame, tracks: DataFrame) -> DataFrame:
    return incoming.join(tracks.select("rel_path").distinct(), "rel_path", "left_semi")


def replaced(old: DataFrame, new: DataFrame, key: str = "track_id") -> DataFrame:
    """old without the rows of new's keys, and new: write it, then swap."""
    return old.join(new.select(key).distinct(), key, "left_anti").unionByName(new)


def compact(tracks: DataFrame, fingerprints: DataFrame) -> tuple[DataFrame, DataFrame]:
    """All segments as one: dense new track ids in (segment, old id) order, and postings moved to them."""
    sizes = tracks.groupBy("segment_id").agg(F.count("*").alias("_n"))  # a row for each segment
    before = sizes.withColumn("_before", F.coalesce(F.sum("_n").over(Window.orderBy("segment_id").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    inside = F.row_number().over(Window.partitionBy("segment_id").orderBy("track_id")) - 1
    mapped = tracks.withColumn("_in", inside).join(F.broadcast(before.drop("_n")), "segment_id").withColumn("new_id", (F.col("_before") + F.col("_in")).cast("bigint")).drop("_before", "_in")
    moved = fingerprints.join(mapped.select("segment_id", "track_id", "new_id"), ["segment_id", "track_id"]).select(F.col("new_id").alias("track_id"), "hash", "anchor_t")
    return mapped.drop("segment_id", "track_id").withColumnRenamed("new_id", "track_id"), moved


def posting_stats(fingerprints: DataFrame) -> DataFrame:
    """(n_postings, n_hashes): how many hashes have so many postings."""
    return fingerprints.groupBy("hash").agg(F.count("*").alias("n_postings")).groupBy("n_postings").agg(F.count("*").alias("n_hashes"))


def last_wins(fingerprints: DataFrame) -> DataFrame:
    """One posting for each hash, the last in (track, anchor) order: a map-side maximum, no sort."""
    return fingerprints.groupBy("hash").agg(F.max(F.struct("track_id", "anchor_t")).alias("p")).select("hash", "p.track_id", "p.anchor_t")


def look_up(fingerprints: DataFrame, hashes: DataFrame) -> DataFrame:
    """Postings of a set of hashes (one column, hash)."""
    wanted = hashes.distinct()
    return fingerprints.join(F.broadcast(wanted) if wanted.limit(BROADCAST_HASHES + 1).count() <= BROADCAST_HASHES else wanted, "hash", "left_semi")


def inspect_hash(fingerprints: DataFrame, hex_key: Column | str) -> DataFrame:
    """Postings of one key of 16 hex characters."""
    return fingerprints.where(F.col("hash") == hashing.hash_of_hex(F.lit(hex_key) if isinstance(hex_key, str) else hex_key))


def parse_kv(rows: DataFrame) -> DataFrame:
    """(hash, track_id, anchor_t) of key-value rows: 8-byte big-endian keys, values of ``track|anchor`` lines; other lines
    are skipped, bad numbers are 0."""
    line = F.explode(F.split(F.col("val").cast("string"), "\n"))
    parts = F.split(F.col("line"), r"\|")
    flat = rows.select(hashing.hash_of_hex(F.hex("key")).alias("hash"), line.alias("line")).where(F.size(F.split("line", r"\|")) == 2)
    return flat.select("hash", parts[0].alias("track_id"), F.coalesce(parts[1].try_cast("bigint"), F.lit(0)).alias("anchor_t"))


def to_kv(fingerprints: DataFrame) -> DataFrame:
    """(key, val) rows in that format, one for each posting."""
    return fingerprints.select(F.unhex(hashing.hash_hex(F.col("hash"))).alias("key"), F.format_string("%s|%d\n", F.col("track_id").cast("string"), "anchor_t").alias("val"))
