"""Recognition: an equi-join on the hash, votes by time offset, the best offset of each track, ranking.

Everything carries query_id, so a batch of clips is one job. Orders are total: votes, total votes, absolute
offset, offset, track.

A batch up to BROADCAST_HASHES is broadcast. A larger one is dealt by hash: postings that lie in buckets stay where they
are, others are shuffled. A counting pass finds the hashes that would make one task's share too large (silence, tones);
their postings are read apart, dealt by a salt, and meet the batch's rows of these hashes in every salt. Either way the
batch's equal rows are one row with a number before they meet a posting.

The votes of many clips over many tracks grow with the product of both. A batch of more than CLIPS clips is therefore
counted in a grid: blocks of clips by blocks of tracks, a cell a task, in slices of a bounded number of hits. All votes of a
clip and a track lie in one cell, so that neither hits nor votes are shuffled, and more data are more cells, not larger ones.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import hashing
from ..presets import Preset
from ..recovery import cut
from .grid import cell_votes

#: Query rows up to which they are broadcast (24 bytes each).
BROADCAST_HASHES = 1_000_000
#: A hash is heavy if it has more than a task's mean share of the postings over this.
HEAVY = 4
#: Tasks that a heavy hash's postings are dealt to.
SALTS = 64
#: Clips of a batch up to which its hits are joined and grouped by the engine.
CLIPS = 128
#: Rows of a block of clips or tracks at most, about, and rows of tracks below which a block isn't divided for more tasks.
BLOCK, LEAST = 1 << 19, 1 << 15
#: Pairs of a clip and a track in a cell, about: where only the best tracks of a clip are asked for, a task sorts its cell's pairs.
PAIRS = 1 << 20
#: Tracks with names up to which these are broadcast to the cells.
NAMED = 500_000


def heavy_hashes(postings: DataFrame, tasks: int, share: int = HEAVY) -> DataFrame:
    """(hash) of the hashes with over 1 / (share * tasks) of all postings: fewer than share * tasks of them."""
    counts = postings.groupBy("hash").agg(F.count("*").alias("_n"))  # in place where postings lie in buckets
    total = postings.count()
    return cut(counts.where(F.col("_n") > F.lit(total / (share * tasks))).select("hash"))


def hits(query: DataFrame, postings: DataFrame, most: int = BROADCAST_HASHES, salts: int = SALTS) -> DataFrame:
    """Postings joined with query rows (query_id, hash, t1) of their hash; times is how often the row is there."""
    query = query.groupBy("query_id", "hash", "t1").agg(F.count("*").alias("times"))
    if query.limit(most + 1).count() <= most:
        return postings.join(F.broadcast(query), "hash")
    tasks = int(postings.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    heavy = heavy_hashes(postings, tasks)
    if heavy.isEmpty():
        return postings.join(query.hint("shuffle_merge"), "hash")
    few = F.broadcast(heavy)
    light = postings.join(few, "hash", "left_anti").join(query.join(few, "hash", "left_anti").hint("shuffle_merge"), "hash")
    salt = "\x00salt"
    dealt = postings.join(few, "hash", "left_semi").withColumn(salt, F.pmod(F.xxhash64("track_id", "anchor_t"), F.lit(salts)).cast("int"))
    every = query.join(few, "hash", "left_semi").withColumn(salt, F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return light.unionByName(dealt.join(every.hint("shuffle_merge"), ["hash", salt]).drop(salt))


def joined_votes(query: DataFrame, postings: DataFrame, most: int = BROADCAST_HASHES, salts: int = SALTS, keys: tuple[str, ...] = ("track_id",)) -> DataFrame:
    """The votes of a few clips, or of any where postings shall stay in their buckets: hits joined by hash and grouped."""
    hit = hits(query, postings, most, salts).select("query_id", *keys, (F.col("anchor_t") - F.col("t1")).alias("offset_frames"), "times")
    counted = hit.groupBy("query_id", *keys, "offset_frames").agg(F.sum("times").alias("votes"))
    return counted.withColumn("total_votes", F.sum("votes").over(Window.partitionBy("query_id", *keys)))


def grid_votes(query: DataFrame, postings: DataFrame, best: bool = False, keys: tuple[str, ...] = ("track_id",), block: int = BLOCK, least: int = LEAST, pairs: int = PAIRS) -> DataFrame:
    """The votes of many clips, cell by cell of a grid; best: those of the best offset only."""
    query = cut(query.where("hash is not null").groupBy("query_id", "hash", "t1").agg(F.count("*").alias("times")))
    postings = cut(postings.where("hash is not null").select(*keys, "hash", "anchor_t"))
    tasks = int(postings.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    sized = lambda frame, *by: frame.agg(F.count("*"), F.approx_count_distinct(F.xxhash64(*by))).first()
    (n_query, n_clips), (n_postings, n_tracks) = sized(query, "query_id"), sized(postings, *keys)
    wanted = n_clips * n_tracks / pairs  # in the shape that copies the fewest rows
    across = max(1, -(-n_query // block), min(n_clips, math.ceil(math.sqrt(wanted * n_query / max(n_postings, 1)))))
    down = max(1, -(-n_postings // block), min(-(-tasks // across), n_postings // least), min(n_tracks, math.ceil(wanted / across)))
    place = lambda n, *by: F.pmod(F.xxhash64(*by), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    none = lambda frame, name: F.lit(None).cast(frame.schema[name].dataType).alias(name)
    clips = query.withColumn("_x", place(across, "query_id")).withColumn("_y", every(down))
    tracks = postings.withColumn("_y", place(down, *keys)).withColumn("_x", every(across))
    cell = (F.col("_y") * across + F.col("_x")).cast("int").alias("_cell")
    both = clips.select(cell, "query_id", *(none(postings, k) for k in keys), "hash", F.col("t1").cast("bigint").alias("at"), "times").unionByName(
        tracks.select(cell, none(query, "query_id"), *keys, "hash", F.col("anchor_t").cast("bigint").alias("at"), F.lit(0).cast("bigint").alias("times")))
    dealt = both.repartitionById(across * down, F.col("_cell")).drop("_cell")  # a cell a partition, also an empty one

    def run(batches: Iterator) -> Iterator:
        yield from cell_votes(batches, keys, best)

    ids = ", ".join(f"`{c}` {kind}" for c, kind in dealt.dtypes if c in ("query_id", *keys))
    return dealt.mapInArrow(run, f"{ids}, offset_frames bigint, votes bigint, total_votes bigint")


def many_clips(query: DataFrame, clips: int = CLIPS) -> bool:
    return query.select("query_id").distinct().limit(clips + 1).count() > clips


def votes(query: DataFrame, postings: DataFrame, most: int = BROADCAST_HASHES, salts: int = SALTS, clips: int | None = CLIPS) -> DataFrame:
    """(query_id, track_id, offset_frames, votes, total_votes). query: (query_id, hash, t1); repeats count. clips: how many are
    joined and not counted in a grid; None for all."""
    query = cut(query)
    if clips is not None and many_clips(query, clips):
        return grid_votes(query, postings)
    return joined_votes(query, postings, most, salts)


def best_votes(query: DataFrame, postings: DataFrame, most: int = BROADCAST_HASHES, keys: tuple[str, ...] = ("track_id",), clips: int = CLIPS) -> DataFrame:
    """The row of votes of the best offset of each (query, track)."""
    if many_clips(query, clips):
        return grid_votes(query, postings, True, keys)
    return best_offsets(joined_votes(query, postings, most, keys=keys), keys)


def best_offsets(counted: DataFrame, keys: tuple[str, ...] = ("track_id",)) -> DataFrame:
    """The row of the best offset of each (query, track)."""
    order = Window.partitionBy("query_id", *keys).orderBy(F.desc("votes"), F.abs("offset_frames"), "offset_frames")
    return counted.withColumn("_n", F.row_number().over(order)).where("_n = 1").drop("_n")


def with_confidence(best: DataFrame, preset: Preset, n_queries: DataFrame | None = None) -> DataFrame:
    """confidence: votes over the best votes of the query's results, or over its number of hashes (n_queries: query_id, n_hashes)."""
    if preset.confidence == "best":
        top = best.groupBy("query_id").agg(F.greatest(F.max("votes"), F.lit(1)).alias("_top"))  # no task holds all candidates of a query
        return best.join(top, "query_id").withColumn("confidence", F.col("votes") / F.col("_top")).drop("_top")
    return best.join(n_queries, "query_id", "left").withColumn("confidence", F.col("votes") / F.greatest(F.coalesce("n_hashes", F.lit(1)), F.lit(1))).drop("n_hashes")


def ranking(preset: Preset, titled: bool = False) -> list:
    """The order of matches; titled: equal ones by their titles before their ids."""
    if preset.confidence == "best":
        return [F.desc("votes"), F.desc("total_votes"), F.abs("offset_frames"), *([F.col("title")] if titled else []), F.col("track_id")]
    if preset.hashing == "quad64":
        return [F.desc("votes"), F.desc("total_votes"), F.col("track_id")]
    return [F.desc("votes"), F.col("track_id")]


def top_matches(found: DataFrame, order: list, limit: int | None) -> DataFrame:
    """found with rank, the first limit of each query; None or 0 keeps all."""
    out = found.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(*order)))
    return out.where(F.col("rank") <= limit) if limit and limit > 0 else out


def top_with_confidence(best: DataFrame, order: list, limit: int, tracks: DataFrame | None) -> DataFrame:
    """The first limit matches of each query with their confidence, of one pass over the votes: the best votes of all are in
    the first match of the known tracks or of the others, as orders begin with votes."""
    known = F.lit(True)
    if tracks is not None:
        best, known = best.join(tracks.withColumn("_known", F.lit(True)), "track_id", "left"), F.coalesce("_known", F.lit(False))
    best = best.withColumn("_known", known)
    first = best.withColumn("rank", F.row_number().over(Window.partitionBy("query_id", "_known").orderBy(*order))).where(F.col("rank") <= limit)
    top = F.greatest(F.max("votes").over(Window.partitionBy("query_id")), F.lit(1))
    return first.withColumn("confidence", F.col("votes") / top).where("_known").drop("_known")


def names(tracks: DataFrame, most: int = NAMED) -> DataFrame:
    """tracks for a join with pairs of clips and tracks: up to ``most`` they are broadcast, as pairs are named where they are
    counted and a shuffle of all pairs by track grows with the square of the tracks."""
    return F.broadcast(tracks) if tracks.limit(most + 1).count() <= most else tracks


def match(query: DataFrame, postings: DataFrame, preset: Preset, tracks: DataFrame | None = None, limit: int | None = -1, most: int = BROADCAST_HASHES) -> DataFrame:
    """Ranked matches of every query; tracks: metadata to join (inner, as unknown tracks are no result)."""
    query = cut(query)  # read for the votes and for the number of hashes
    counted = best_votes(query, postings, most)
    tracks = None if tracks is None else names(tracks)
    limit = preset.limit if limit == -1 else limit
    order = ranking(preset, tracks is not None and "title" in tracks.columns)
    if preset.confidence == "best" and not preset.least_votes and limit and limit > 0:
        out = top_with_confidence(counted, order, limit, tracks)
    else:
        found = with_confidence(counted, preset, query.groupBy("query_id").agg(F.count("*").alias("n_hashes")))
        if preset.least_votes:
            found = found.where((F.col("votes") >= preset.least_votes) & (F.col("confidence") >= preset.least_confidence))
        if tracks is not None:
            found = found.join(tracks, "track_id")
        out = top_matches(found, order, limit)
    return out.withColumn("offset_seconds", hashing.offset_seconds(F.col("offset_frames"), preset.hop, preset.sample_rate) if preset.time_unit == "frame" else F.col("offset_frames") / 1000.0)


def match_segments(query: DataFrame, postings: DataFrame, tracks: DataFrame, preset: Preset, limit: int | None = 10, compat: bool = False, each: int | None = 50) -> DataFrame:
    """Matches over segments, merged by artist, album and title.

    postings and tracks carry segment_id. Each segment gives its best max(each, limit), all with each None; votes and totals
    of one name are summed. The offset is that of the strongest segment; compat compares each segment with the running sum
    instead. limit None keeps all names.
    """
    best = best_votes(cut(query), postings, keys=("segment_id", "track_id"))
    if each is not None and limit:
        order = Window.partitionBy("query_id", "segment_id").orderBy(F.desc("votes"), F.desc("total_votes"), F.abs("offset_frames"), "track_id")
        best = best.withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= max(each, limit)).drop("_n")
    named = best.join(tracks.select("segment_id", "track_id", "artist", "album", "title"), ["segment_id", "track_id"])
    if compat:
        rank = [(-F.col("votes")).alias("k0"), (-F.col("total_votes")).alias("k1"), F.abs("offset_frames").alias("k2"), "track_id"]
        item = F.struct("segment_id", *rank, "votes", "total_votes", "offset_frames")
        zero = F.struct(F.lit(0).cast("bigint").alias("v"), F.lit(0).cast("bigint").alias("t"), F.lit(0).cast("bigint").alias("o"), F.lit(True).alias("first"))
        step = lambda a, x: F.struct(
            (a["v"] + x["votes"]).alias("v"), (a["t"] + x["total_votes"]).alias("t"),
            F.when(a["first"] | (x["votes"] > a["v"]), x["offset_frames"]).otherwise(a["o"]).alias("o"), F.lit(False).alias("first"),
        )
        merged = named.groupBy("query_id", "artist", "album", "title").agg(F.aggregate(F.array_sort(F.collect_list(item)), zero, step).alias("s"))
        merged = merged.select("query_id", "artist", "album", "title", F.col("s.v").alias("votes"), F.col("s.t").alias("total_votes"), F.col("s.o").alias("offset_frames"))
    else:
        strongest = F.struct(-F.col("votes"), F.abs("offset_frames"), "offset_frames", "segment_id")
        merged = named.groupBy("query_id", "artist", "album", "title").agg(F.sum("votes").alias("votes"), F.sum("total_votes").alias("total_votes"), F.min_by("offset_frames", strongest).alias("offset_frames"))
    top = F.greatest(F.max("votes").over(Window.partitionBy("query_id")), F.lit(1))
    merged = merged.withColumn("confidence", F.col("votes") / top)
    final = [F.desc("votes"), F.desc("total_votes"), F.abs("offset_frames"), F.concat_ws("/", "artist", "album", "title")]
    return top_matches(merged, final, limit)


def thousandths(x: Column) -> Column:
    """A double below 65,536 in thousandths, rounded as C prints it: by its exact binary value, ties to even. Spark's own
    formats round its shortest decimal form, half up."""
    scale = float(1 << 26)
    high = F.floor(x * scale) / scale  # so few bits that its multiples are exact, and those of the rest
    k = F.floor(x * 1000)
    beyond = (high * 2000 - (2 * k + 1)) + (x - high) * 2000
    return F.when((beyond > 0) | ((beyond == 0) & (k % 2 == 1)), k + 1).otherwise(k)


def printed(matches: DataFrame) -> DataFrame:
    """One line of text for each match."""
    k = thousandths(F.col("confidence"))
    parts = ["rank", F.col("track_id").cast("string"), "votes", "offset_frames", F.floor(k / 1000), k % 1000]
    return matches.select("query_id", "rank", F.format_string("%2d. %s (votes %d, offset %d, confidence %d.%03d)", *parts).alias("line"))


def with_names(matches: DataFrame, tags: DataFrame, catalogue: DataFrame) -> DataFrame:
    """title and artist of matches: tags win where either is known, else the catalogue's. Both are keyed by track_id."""
    tag = tags.select("track_id", F.col("title").alias("_t"), F.col("artist").alias("_a"))
    named = matches.join(tag, "track_id", "left").join(catalogue.select("track_id", "title", "artist"), "track_id", "left")
    known = (F.coalesce("_t", F.lit("unknown")) != "unknown") | (F.coalesce("_a", F.lit("unknown")) != "unknown")
    pick = lambda tag, own: F.when(known, F.coalesce(tag, F.lit("unknown"))).otherwise(F.coalesce(own, F.lit("unknown")))
    return named.withColumn("title", pick(F.col("_t"), F.col("title"))).withColumn("artist", pick(F.col("_a"), F.col("artist"))).drop("_t", "_a")
