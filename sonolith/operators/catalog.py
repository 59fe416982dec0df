"""The catalogue: landed JSON pages, page chains, upserts, anti-joins, look-up chains and gates."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..commits import commit_tables
from ..recovery import cut, shared_dir

#: Pages a chain may have: the first and two hundred more.
LONGEST_CHAIN = 201


def _error(data: str) -> Column:
    """The response's error member as a variant: a null value is there, an absent member is none."""
    return F.try_variant_get(F.try_parse_json(data), "$.error", "variant")


def without_errors(pages: DataFrame, data: str = "data") -> DataFrame:
    """Landed responses without a truthy ``error`` member: null, false, any zero and the empty text are falsy; other texts,
    other numbers, lists and objects, also empty ones, are truthy."""
    error, kind = _error(data), F.schema_of_variant(_error(data))
    number = kind.rlike("^(BIGINT|DOUBLE|DECIMAL)") & (F.try_variant_get(error, "$", "double") == 0)
    falsy = (kind == "VOID") | ((kind == "BOOLEAN") & ~F.try_variant_get(error, "$", "boolean")) | number | ((kind == "STRING") & (F.try_variant_get(error, "$", "string") == ""))
    return pages.where(error.isNull() | F.coalesce(falsy, F.lit(False)))


def cacheable(pages: DataFrame, data: str = "data") -> DataFrame:
    """Responses without an ``error`` member, whatever its value."""
    return pages.where(_error(data).isNull())


def page_items(pages: DataFrame) -> DataFrame:
    """(url, next, items) of landed pages (url, data)."""
    shape = "struct<items:array<string>,next:string>"
    parsed = pages.withColumn("p", F.from_json("data", shape))
    return parsed.select("url", F.col("p.next").alias("next"), F.coalesce("p.items", F.array().cast("array<string>")).alias("items"))


def _one_of_url(pages: DataFrame) -> DataFrame:
    """(url, next, items), one row for a url: of several the least."""
    rest = F.struct("next", F.coalesce("items", F.array().cast("array<string>")).alias("items"), F.col("items").isNull().alias("bare"))
    one = pages.where("url is not null").groupBy("url").agg(F.min(rest).alias("r"))
    return one.select("url", "r.next", F.when(~F.col("r.bare"), F.col("r.items")).alias("items"))


def page_jumps(cached: DataFrame, longest: int = LONGEST_CHAIN) -> list[DataFrame]:
    """(url, to) of jumps of 1, 2, 4 ... pages: each is the one before applied twice."""
    there = cached.where("items is not null").select(F.col("url").alias("next"))
    jumps = [cut(cached.where("items is not null and next <> url").select("url", "next").join(there, "next", "left_semi").select("url", F.col("next").alias("to")))]
    while len(jumps) < (longest - 1).bit_length() and not jumps[-1].isEmpty():
        last = jumps[-1]
        jumps.append(cut(last.join(last.select(F.col("url").alias("to"), F.col("to").alias("_to")), "to").select("url", F.col("_to").alias("to"))))
    return jumps


def page_walks(pages: DataFrame, starts: DataFrame | None = None, longest: int = LONGEST_CHAIN) -> DataFrame:
    """(start, url, at): the pages that are read from each start, by binary lifting.

    A walk goes on while the next page is cached and has items, up to ``longest`` pages, and ends before a page it has
    seen. Jumps of 1, 2, 4 ... pages are functions of the url: each is the one before applied twice. A walk's places
    below twice as many pages are its places so far and the jump from each of them, so 201 pages take eight joins, and
    any number of walks may share pages or enter a cycle. The first visit of each page is kept: behind the first page
    that repeats, all do. pages: (url, next, items); starts: (url), all pages without.
    """
    cached = cut(_one_of_url(pages))
    return _walks(cached, page_jumps(cached, longest), starts, longest)


def _walks(cached: DataFrame, jumps: list[DataFrame], starts: DataFrame | None, longest: int) -> DataFrame:
    asked = cached.select("url") if starts is None else cached.select("url").join(starts.select("url").distinct(), "url", "left_semi")
    walks = cut(asked.select(F.col("url").alias("start"), "url", F.lit(0).alias("at")))
    for k, jump in enumerate(jumps):
        step = walks.join(jump, "url").select("start", F.col("to").alias("url"), (F.col("at") + (1 << k)).alias("at"))
        further = step.where(F.col("at") < longest)
        walks = cut(walks.unionByName(further).groupBy("start", "url").agg(F.min("at").alias("at")))
    return walks


def _read(pages: DataFrame, walks: DataFrame) -> DataFrame:
    own = _one_of_url(pages).select("url", "items")
    gathered = walks.join(own, "url").groupBy("start").agg(F.array_sort(F.collect_list(F.struct("at", "items"))).alias("p"))  # ``longest`` pages at most
    return gathered.select(F.col("start").alias("url"), F.flatten(F.transform("p", lambda x: x["items"])).alias("items"), F.size("p").alias("n_pages"))


def read_chains(pages: DataFrame, starts: DataFrame | None = None, longest: int = LONGEST_CHAIN) -> DataFrame:
    """(url, items, n_pages) of each start that is cached: the items of all pages of its walk, in order."""
    return _read(pages, page_walks(pages, starts, longest))


def chain_walks(pages: DataFrame, longest: int = LONGEST_CHAIN) -> DataFrame:
    """The walks (start, url, at) of chain_starts; the jumps are made once for all of them."""
    cached = cut(_one_of_url(pages))
    jumps = page_jumps(cached, longest)
    known = cut(pages.where("url is not null").select("url", "next").distinct())
    led_to = known.where("next is not null and next <> url").select(F.col("next").alias("url")).distinct()
    first = _walks(cached, jumps, known.select("url").distinct().join(led_to, "url", "left_anti"), longest)
    rest = cut(known.select("url").distinct().join(first.select("url").distinct(), "url", "left_anti"))
    if rest.isEmpty():
        return first
    walks = _walks(cached, jumps, rest, longest)
    back = walks.join(known, "url").where(F.col("next") == F.col("start")).select("start").distinct()  # others are further from a start than walks go
    least = walks.join(back, "start", "left_semi").groupBy("start").agg(F.min("url").alias("least")).where("start = least").select("start")
    return first.unionByName(walks.join(least, "start", "left_semi"))


def chain_starts(pages: DataFrame, longest: int = LONGEST_CHAIN) -> DataFrame:
    """(url) of the pages that no other page leads to, and of each cycle that no walk from these enters the least page."""
    return chain_walks(pages, longest).where("at = 0").select(F.col("start").alias("url"))


def merge_page_chains(pages: DataFrame, longest: int = LONGEST_CHAIN) -> DataFrame:
    """(url, items, n_pages) of the pages that chains start from; see chain_starts."""
    return _read(pages, chain_walks(pages, longest))


def follow_chain(spark: SparkSession, pages: DataFrame, seeds: DataFrame, longest: int = LONGEST_CHAIN) -> DataFrame:
    """(seed, url, at): the cached pages reached from given urls, cycles cut at the first page met again."""
    pages.select("url", "next").createOrReplaceTempView("_chain_pages")
    seeds.select("url").createOrReplaceTempView("_chain_seeds")
    return spark.sql(f"""
        WITH RECURSIVE walk(seed, url, next, at, seen) AS (
          SELECT s.url, p.url, p.next, 0, array(p.url) FROM _chain_seeds s JOIN _chain_pages p ON s.url = p.url
          UNION ALL
          SELECT w.seed, p.url, p.next, w.at + 1, concat(w.seen, array(p.url)) FROM walk w JOIN _chain_pages p ON w.next = p.url
          WHERE w.at + 1 < {longest} AND NOT array_contains(w.seen, p.url)
        ) SELECT seed, url, at FROM walk""")


def latest(rows: DataFrame, key: str, by: Column | str) -> DataFrame:
    """The latest row of each key: a map-side maximum of (by, row)."""
    rest = [c for c in rows.columns if c != key]
    by = F.col(by) if isinstance(by, str) else by
    return rows.groupBy(key).agg(F.max_by(F.struct(*rest), by).alias("r")).select(key, "r.*")


def upsert(existing: DataFrame, incoming: DataFrame, key: str) -> DataFrame:
    """existing with the rows of incoming's keys replaced, and the new ones added. incoming: one row for a key."""
    return existing.join(incoming.select(key), key, "left_anti").unionByName(incoming)


def touch(existing: DataFrame, incoming: DataFrame, key: str, now: Column) -> DataFrame:
    """Insert absent keys; of present ones only updated_at changes, of those that aren't incoming nothing. Of several
    incoming rows of a key the least is inserted."""
    rest = [c for c in existing.columns if c not in (key, "updated_at")]
    new = incoming.groupBy(key).agg(F.min(F.struct(*(F.col(f"`{c}`") for c in rest))).alias("r")) if rest else incoming.select(key).distinct().withColumn("r", F.lit(None))
    a, b = existing.withColumn("_old", F.lit(True)).alias("a"), new.withColumn("_new", F.lit(True)).alias("b")
    joined = a.join(b, key, "full")
    return joined.select(
        key, *(F.when(F.col("_old"), F.col(f"a.`{c}`")).otherwise(F.col("b.r").getField(c)).alias(c) for c in rest),
        F.when(F.col("_new"), now).otherwise(F.col("a.updated_at")).alias("updated_at"),
    ).select(*(f"`{c}`" for c in existing.columns))


def missing(incoming: DataFrame, existing: DataFrame, key: str) -> DataFrame:
    """Distinct incoming rows whose key isn't there yet."""
    return incoming.dropDuplicates([key]).join(existing.select(key), key, "left_anti")


def set_duration(tracks: DataFrame, updates: DataFrame, key: str, order: str | None = None) -> DataFrame:
    """tracks with the durations of updates where there is one. Of several updates of a key the last by ``order`` holds,
    the greatest duration where that ties or no order is given; updates without a duration change nothing."""
    by = F.struct(*([order] if order else []), "duration")
    new = updates.where("duration is not null").groupBy(key).agg(F.max_by("duration", by).alias("_new"))
    return tracks.join(new, key, "left").withColumn("duration", F.coalesce("_new", "duration")).drop("_new").select(*tracks.columns)


def duration_status(duration: Column) -> Column:
    """known, unknown (-1 or null) or absent (-2)."""
    return F.when(duration.isNull() | (duration == -1), "unknown").when(duration == -2, "absent").otherwise("known")


def without_duration(tracks: DataFrame, column: str = "duration") -> DataFrame:
    d = F.col(column)
    return tracks.where(d.isNull() | (d.cast("string") == "-1"))


def after(rows: DataFrame, key: str, last: object | None, limit: int) -> DataFrame:
    """The next page by key: unlike skipping, it loses no row when handled rows leave the filter."""
    return (rows if last is None else rows.where(F.col(key) > F.lit(last))).orderBy(key).limit(limit)


def stale(artists: DataFrame, now: Column, hours: int = 24) -> DataFrame:
    """Artists to resolve: not completed, or not updated in the last hours."""
    fresh = (F.col("updated_at") > now - F.expr(f"interval {hours} hours")) & F.col("has_crawl_completed")
    return artists.where(~F.coalesce(fresh, F.lit(False)))


def changed_albums(incoming: DataFrame, existing: DataFrame, key: str = "album_id") -> DataFrame:
    """Incoming albums that are new or have another number of tracks."""
    known = existing.select(key, F.col("total_tracks").alias("_known"))
    return incoming.join(known, key, "left").where(~F.col("total_tracks").eqNullSafe(F.col("_known"))).drop("_known")


def other_artists(albums: DataFrame, artist: Column) -> DataFrame:
    """The other artists of the first album: (id, name) rows of its nested list."""
    return albums.select(F.explode(F.filter(F.col("artists"), lambda a: a["id"] != artist)).alias("a")).select("a.*")


def split_albums(albums: DataFrame) -> dict[str, DataFrame]:
    """One nested album document as four tables: albums, images, tracks and album_artists."""
    minted = lambda kind, c: F.concat(F.lit(f"{kind}:"), F.substring(F.sha2(c, 256), 1, 24))
    return {
        "albums": albums.drop("images", "tracks", "artists").withColumn("id", minted("album", F.col("album_id"))),
        "images": albums.select("album_id", F.explode("images").alias("i")).select("album_id", "i.*"),
        "tracks": albums.select("album_id", F.explode("tracks").alias("t")).select("album_id", "t.*"),
        "album_artists": albums.select("album_id", F.explode("artists").alias("a")).select("album_id", F.col("a.id").alias("artist_id")),
    }


def insert_albums(albums: DataFrame, root: str, run: str) -> bool:
    """Add nested album documents to the four tables at root as one: all are seen at once, a run that is there already adds
    nothing. Read them with ``commits.committed``."""
    return commit_tables(split_albums(albums), root, run)


def release_date(text: Column, precision: Column) -> Column:
    padded = F.when(precision == "year", F.concat(text, F.lit("-01-01"))).when(precision == "month", F.concat(text, F.lit("-01"))).otherwise(text)
    return padded.try_cast("date")


def mark_completed(artists: DataFrame, done: DataFrame, key: str) -> DataFrame:
    flagged = done.select(key).distinct().withColumn("_done", F.lit(True))
    return artists.join(flagged, key, "left").withColumn("has_crawl_completed", F.coalesce("_done", "has_crawl_completed")).drop("_done")


def first_relation(relations: DataFrame, key: str, order: str) -> DataFrame:
    """One relation of each key: the least by order."""
    rest = [c for c in relations.columns if c != key]
    return relations.groupBy(key).agg(F.min_by(F.struct(*rest), F.col(order)).alias("r")).select(key, "r.*")


def look_up_chain(tracks: DataFrame, albums: DataFrame, relations: DataFrame, artists: DataFrame) -> DataFrame:
    """track -> album -> first relation -> artist, all optional; names default to unknown. Relations carry the artists' outer ids."""
    one = first_relation(relations, "album_id", "artist_id")
    joined = tracks.join(albums, "album_id", "left").join(one, "album_id", "left").join(artists, "artist_id", "left")
    unknown = lambda c: F.coalesce(F.col(c), F.lit("unknown")).alias(c)
    return joined.select("track_id", unknown("title"), unknown("album"), unknown("artist"))


def seeds(data: DataFrame, column: str = "value", keep: tuple[str, ...] = ()) -> DataFrame:
    """(name, url) rows of JSON objects, with the kept columns."""
    return data.select(*keep, F.explode(F.from_json(column, "map<string,string>")).alias("name", "url"))


def chunks(rows: DataFrame, order: str, size: int = 50) -> DataFrame:
    """rows with chunk: size rows each in the given order; ranges are numbered in parallel."""
    from .index import number_tracks

    numbered = number_tracks(rows, order, "_number")
    return numbered.withColumn("chunk", F.expr(f"cast(_number div {size} as int)")).drop("_number")


#: Bits of the crawl's filter: 8 MB of bitmaps, whatever the number of ids; when they are full, all ids take the exact join.
FILTER_BITS = 1 << 26
#: Bits that each id sets.
FILTER_HASHES = 3


def _places(ids: DataFrame) -> DataFrame:
    """(id, bucket, at): the bits of each id in bitmaps of 32,768 bits."""
    bits = F.array(*(F.pmod(F.xxhash64("id", F.lit(k)), F.lit(FILTER_BITS)) for k in range(FILTER_HASHES)))
    each = ids.select("id", F.explode(bits).alias("bit"))
    return each.select("id", F.bitmap_bucket_number("bit").alias("bucket"), F.bitmap_bit_position("bit").alias("at"))


def id_filter(ids: DataFrame) -> DataFrame:
    """(bucket, bits): the bitmaps of a set of ids."""
    return _places(ids).groupBy("bucket").agg(F.bitmap_construct_agg("at").alias("bits"))


def maybe_in(ids: DataFrame, bitmaps: DataFrame) -> DataFrame:
    """The ids, each once, whose bits are all set: those of the set and some others. bitmaps are bounded by FILTER_BITS."""
    joined = _places(ids).join(F.broadcast(bitmaps), "bucket")
    byte = F.conv(F.hex(F.substring(F.col("bits"), (F.col("at") / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    set_ = F.count_if(F.getbit(byte, (F.col("at") % 8).cast("int")) == 1)
    return joined.groupBy("id").agg(set_.alias("_n")).where(F.col("_n") == FILTER_HASHES).select("id")


def crawl(frontier: DataFrame, expand, root: str | None = None) -> DataFrame:
    """All ids reached from a frontier (column id): expand maps a frontier to new ids; ends when a round adds none. A null id is none.

    A round writes its new ids and their bitmaps, and nothing that was there before: what is written grows with the ids.
    Ids with a bit that no round has set are new; only the others are looked for among the earlier rounds. root: a new
    folder for the rounds, in the shared one without.
    """
    spark = frontier.sparkSession
    root = root or f"{shared_dir(spark)}/crawl-{uuid.uuid4().hex}"
    fresh, n = frontier.where("id is not null").select("id").distinct(), 0
    while True:
        fresh.write.parquet(f"{root}/ids/round={n}")
        added = spark.read.parquet(f"{root}/ids/round={n}")
        n += 1
        seen = spark.read.schema(added.schema).parquet(*(f"{root}/ids/round={k}" for k in range(n)))
        if added.isEmpty():
            return seen
        id_filter(added).coalesce(1).write.parquet(f"{root}/bits/round={n - 1}")
        bitmaps = spark.read.schema("bucket bigint, bits binary").parquet(*(f"{root}/bits/round={k}" for k in range(n))).groupBy("bucket").agg(F.bitmap_or_agg("bits").alias("bits"))
        found = cut(expand(added).select("id").where("id is not null").distinct())
        fresh = found.join(maybe_in(found, bitmaps).join(seen, "id", "left_semi"), "id", "left_anti")


def best_of_folder(files: DataFrame, priority: Column) -> DataFrame:
    """The first file of each directory (dir, name) by priority, then name."""
    order = Window.partitionBy("dir").orderBy(priority, "name")
    return files.withColumn("_n", F.row_number().over(order)).where("_n = 1").drop("_n")


def cover_priority(name: Column) -> Column:
    """Fixed order of cover names, then any picture; null for other files."""
    base = F.lower(name)
    order = F.when(base.rlike(r"^cover\.(jpe?g|png)$"), 0).when(base.rlike(r"^folder\.(jpe?g|png)$"), 1).when(base.rlike(r"^(front|album)\.(jpe?g|png)$"), 2)
    return order.when(base.rlike(r"\.(jpe?g|png|webp|gif|bmp)$"), 3)
