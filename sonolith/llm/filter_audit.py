"""How filters overlap in every order they can be applied in, by part of a corpus.

Each document gets a mask of the filters it fails. Four look at its text alone; the fifth fails every copy of a text
but the one of the least doc_id. Copies are found by sorting: records are ranged by the text's fingerprint and doc_id
(so that a text with a third of all rows is dealt to many ranges), sorted in each range by fingerprint, full text and
doc_id, and every record is compared with the one before it. A run of equal texts may begin in the range before or
go on in the one after: rows of a range's first and last fingerprint carry a digest of their text, and the least
doc_id of each such digest over all ranges (two fingerprints for each range at most) settles them.

Masks are merged into counters by part and mask, at most 32 of a part, which are additive: shards of a corpus can be
counted apart and summed. All orders and steps are read off the counters, never off the documents again.

Defined cases: a null text is the empty text, a null source the part ''; a null doc_id is smaller than no other and no
other is smaller than it, and it has no labels; rows of one doc_id and text are not copies of each other; of several
label rows of a document one with the value 1 suffices; an empty table gives an empty result; only doc_id, text and
source are read, whatever other columns are called.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from itertools import permutations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, table
from .quality_rules import words_of
from .text_arrays import release

LETTERS = "ABCDE"
#: Label rows (two flags and an id each) up to which they are broadcast.
BROADCAST_LABELS = 500_000


@dataclass(frozen=True)
class Limits:
    """A fails under ``min_words`` words, B under ``distinct_percent`` of distinct words, C over ``capital_percent`` of A-Z
    characters, D with any of ``symbols``; E fails copies of a smaller doc_id's text."""

    min_words: int = 50
    distinct_percent: int = 65
    capital_percent: int = 5
    symbols: str = "#$%&*|"


PRODUCTION = Limits()


def _bit(failed: Column, letter: str) -> Column:
    return F.when(failed, F.lit(1 << LETTERS.index(letter))).otherwise(F.lit(0))


def text_failures(rows: DataFrame, limits: Limits = PRODUCTION) -> DataFrame:
    """rows with ``mask``: the bits of the filters A to D that a text that isn't null fails."""
    text = F.col("text")
    counted = rows.withColumn("\x00w", words_of(text)).withColumn("\x00n", F.size("\x00w"))
    a = F.col("\x00n") < limits.min_words
    b = 100 * F.size(F.array_distinct("\x00w")) < limits.distinct_percent * F.col("\x00n")
    c = 100 * F.length(F.regexp_replace(text, "[^A-Z]+", "")).cast("bigint") > limits.capital_percent * F.length(text).cast("bigint")
    d = text.rlike("[" + "".join("\\" + s for s in limits.symbols) + "]")
    return counted.withColumn("mask", _bit(a, "A") + _bit(b, "B") + _bit(c, "C") + _bit(d, "D")).drop("\x00w", "\x00n")


def _compared(batches: Iterator) -> Iterator:
    """Sorted (fp, text, doc_id, part, mask) records of one range as (doc_id, part, mask, open): E's bit by comparison with
    the record before; open is the text's digest in the range's first and last fingerprint, else null."""
    import numpy as np
    import pyarrow as pa
    import pyarrow.compute as pc

    first_fp = before = held_fp = None  # before: (fp, text, first doc_id of the run) of the last record
    held: list = []  # rows of the fingerprint at hand, which may be the range's last
    names = ["doc_id", "part", "mask", "open"]

    def record(fields: list, texts, s: int, e: int, opened: bool):
        """Rows s to e; one digest for each run of equal texts if they are open."""
        own = pa.nulls(e - s, pa.binary())
        if opened:
            starts = s + np.flatnonzero(np.concatenate([[True], ~pc.equal(texts.slice(s + 1, e - s - 1), texts.slice(s, e - s - 1)).to_numpy(zero_copy_only=False)]))
            each = pa.array([hashlib.sha256(texts[int(i)].as_py().encode("utf-8", "surrogatepass")).digest() for i in starts], pa.binary())
            own = each.take(pa.array(np.repeat(np.arange(len(starts)), np.diff(np.append(starts, e)))))
        return pa.RecordBatch.from_arrays([*(f.slice(s, e - s) for f in fields), own], names=names)

    def released() -> Iterator:
        for rows in held:
            yield rows if held_fp == first_fp else pa.RecordBatch.from_arrays([*rows.columns[:3], pa.nulls(rows.num_rows, pa.binary())], names=names)
        held.clear()

    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        fps, texts, ids = batch.column(0).to_numpy(), batch.column(1), batch.column(2)
        new = np.ones(n, bool)
        new[1:] = (fps[1:] != fps[:-1]) | ~pc.equal(texts.slice(1), texts.slice(0, n - 1)).to_numpy(zero_copy_only=False)
        first_fp = fps[0] if first_fp is None else first_fp
        firsts = ids.take(pa.array(np.maximum.accumulate(np.where(new, np.arange(n), 0))))
        if before is not None and before[0] == fps[0] and before[1] == texts[0].as_py():  # the run goes on
            length = int(np.argmax(new[1:])) + 1 if new[1:].any() else n
            firsts = pa.concat_arrays([pa.array([before[2]] * length, ids.type), firsts.slice(length)])
        before = (fps[-1], texts[n - 1].as_py(), firsts[n - 1].as_py())
        later = pc.fill_null(pc.less(firsts, ids), False).to_numpy(zero_copy_only=False)
        mask = pa.array(batch.column(4).to_numpy() + later.astype(np.int32) * (1 << LETTERS.index("E")), pa.int32())
        fields = [ids, batch.column(3), mask]
        last = int(np.searchsorted(fps, fps[-1]))  # rows from here on have the batch's last fingerprint
        if held and (last > 0 or fps[0] != held_fp):
            yield from released()
        if last > 0:
            ends = int(np.searchsorted(fps, first_fp, side="right"))  # rows up to here have the range's first
            if ends:
                yield record(fields, texts, 0, ends, True)
            if last > ends:
                yield record(fields, texts, ends, last, False)
        held.append(record(fields, texts, last, n, True))
        held_fp = fps[-1]
    held_fp = first_fp  # the range's last: open
    yield from released()
    release()


def marked(docs: DataFrame, limits: Limits = PRODUCTION, fingerprint: Callable[[Column], Column] = F.xxhash64) -> DataFrame:
    """(doc_id, part, mask) of every document, from a checkpoint without texts. fingerprint: a bigint of a text."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = docs.select(F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"), "doc_id", F.coalesce(F.col("source").cast("string"), F.lit("")).alias("part"))
    # the last key deals rows of one id and text to several ranges: it follows from the scan's splits
    ranged = rows.withColumn("fp", fingerprint(F.col("text"))).withColumn("at", F.spark_partition_id()).repartitionByRange("fp", F.col("doc_id").asc_nulls_last(), "at")
    ordered = ranged.drop("at").sortWithinPartitions("fp", "text", F.col("doc_id").asc_nulls_last())
    compared = text_failures(ordered, limits).select("fp", "text", "doc_id", "part", "mask").mapInArrow(_compared, f"doc_id {kind}, part string, mask int, open binary")
    compared = cut(compared)
    # two fingerprints of a range are open: as many digests, but for texts of equal fingerprints
    least = compared.where("open is not null").groupBy("open").agg(F.min("doc_id").alias("least"))
    later = F.coalesce(F.col("doc_id") > F.col("least"), F.lit(False))
    settled = F.col("mask").bitwiseOR(_bit(later, "E"))
    return compared.join(F.broadcast(least), "open", "left").select("doc_id", "part", settled.alias("mask"))


def counters(rows: DataFrame, labels: DataFrame) -> DataFrame:
    """(part, mask, n, good, toxic): documents of each mask. rows: see marked; labels: (doc_id, quality, toxic)."""
    flag = lambda c: F.max(F.when(F.col(c) == 1, 1).otherwise(0)).alias(c)
    known = labels.where("doc_id is not null and (quality = 1 or toxic = 1)").groupBy("doc_id").agg(flag("quality"), flag("toxic"))
    known = F.broadcast(known) if known.limit(BROADCAST_LABELS + 1).count() <= BROADCAST_LABELS else known
    # ids are nearly unique; null ids, which may be many, stay out of the join
    joined = rows.where("doc_id is not null").join(known, "doc_id", "left").select("part", "mask", "quality", "toxic")
    joined = joined.unionByName(rows.where("doc_id is null").select("part", "mask", F.lit(0).alias("quality"), F.lit(0).alias("toxic")))
    total = lambda c: F.coalesce(F.sum(F.col(c).cast("bigint")), F.lit(0).cast("bigint"))
    return joined.groupBy("part", "mask").agg(F.count("*").alias("n"), total("quality").alias("good"), total("toxic").alias("toxic"))


def audit(counted: DataFrame) -> DataFrame:
    """A row for each part, order of the filters and step, from counters; see the module's text."""
    by_part = counted.groupBy("part").agg(F.collect_list(F.struct("mask", "n", "good", "toxic")).alias("c"))  # 32 at most
    orders = F.split(F.lit(",".join("".join(p) for p in permutations(LETTERS))), ",")
    steps = by_part.withColumn("filter_order", F.explode(orders)).withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(len(LETTERS)))))
    at = lambda letter: F.instr("filter_order", letter)
    bits = lambda test: sum((F.when(test(at(x)), 1 << i).otherwise(0) for i, x in enumerate(LETTERS)), F.lit(0))
    steps = steps.withColumn("own", bits(lambda p: p == F.col("step"))).withColumn("earlier", bits(lambda p: p < F.col("step")))
    own, earlier = F.col("own"), F.col("earlier")

    def total(value: str, test: Callable[[Column], Column], name: str) -> Column:
        return F.aggregate("c", F.lit(0).cast("bigint"), lambda s, x: s + F.when(test(x["mask"]), x[value]).otherwise(F.lit(0).cast("bigint"))).alias(name)

    hits = lambda m: m.bitwiseAND(own) != 0
    gone = lambda m: m.bitwiseAND(earlier) != 0
    removed = lambda m: hits(m) & ~gone(m)
    # of the orders, one in so many as it fails filters has this one first
    shapley = F.aggregate("c", F.lit(0).cast("bigint"), lambda s, x: s + F.when(hits(x["mask"]), x["n"] * F.floor(F.lit(120) / F.greatest(F.bit_count(x["mask"]), F.lit(1)))).otherwise(F.lit(0).cast("bigint")))
    return steps.select(
        "part", "filter_order", "step", total("n", lambda m: ~hits(m) & ~gone(m), "kept"), total("n", removed, "removed"), total("n", lambda m: hits(m) & gone(m), "redundant"),
        total("n", lambda m: m == own, "unique_fails"), total("good", removed, "good_lost"), total("toxic", removed, "toxic_lost"), shapley.alias("shapley"),
    )


def op12_filter_audit(spark, sf_dir: str) -> DataFrame:
    """The audit of the five filters over all documents."""
    return audit(counters(marked(table(spark, sf_dir, "documents")), table(spark, sf_dir, "labels")))


ORACLE_SQL = r"""
WITH d AS (
  SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t FROM documents
), w AS (
  SELECT doc_id, part, t, list_filter(string_split_regex(t, '[ \t\n\x0B\f\r]+'), lambda x: x <> '') AS ws, min(doc_id) OVER (PARTITION BY t) AS first_id FROM d
), l AS (
  SELECT doc_id, coalesce(max((quality = 1)::BIGINT), 0) AS good, coalesce(max((toxic = 1)::BIGINT), 0) AS toxic FROM labels WHERE doc_id IS NOT NULL GROUP BY doc_id
), m AS (
  SELECT part, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic, (len(ws) < 50)::INTEGER + 2 * (100 * len(list_distinct(ws)) < 65 * len(ws))::INTEGER
    + 4 * (100 * length(regexp_replace(t, '[^A-Z]+', '', 'g')) > 5 * length(t))::INTEGER + 8 * regexp_matches(t, '[#$%&*|]')::INTEGER + 16 * coalesce(doc_id > first_id, false)::INTEGER AS mask
  FROM w LEFT JOIN l USING (doc_id)
), c AS (
  SELECT part, mask, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM m GROUP BY ALL
), letters AS (
  SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS f, unnest([1, 2, 4, 8, 16]) AS bit
), orders AS (
  SELECT a.f || b.f || c.f || d.f || e.f AS filter_order FROM letters a, letters b, letters c, letters d, letters e
  WHERE len(list_distinct([a.f, b.f, c.f, d.f, e.f])) = 5
), steps AS (
  SELECT filter_order, step, (SELECT bit FROM letters WHERE f = filter_order[step]) AS own, (SELECT coalesce(sum(bit), 0)::INTEGER FROM letters WHERE instr(filter_order, f) < step) AS earlier
  FROM orders, range(1, 6) r(step)
)
SELECT part, filter_order, step::INTEGER AS step,
  coalesce(sum(n) FILTER (mask & (own | earlier) = 0), 0)::BIGINT AS kept,
  coalesce(sum(n) FILTER (mask & own <> 0 AND mask & earlier = 0), 0)::BIGINT AS removed,
  coalesce(sum(n) FILTER (mask & own <> 0 AND mask & earlier <> 0), 0)::BIGINT AS redundant,
  coalesce(sum(n) FILTER (mask = own), 0)::BIGINT AS unique_fails,
  coalesce(sum(good) FILTER (mask & own <> 0 AND mask & earlier = 0), 0)::BIGINT AS good_lost,
  coalesce(sum(toxic) FILTER (mask & own <> 0 AND mask & earlier = 0), 0)::BIGINT AS toxic_lost,
  coalesce(sum(n * (120 // greatest(bit_count(mask), 1))) FILTER (mask & own <> 0), 0)::BIGINT AS shapley
FROM c, steps GROUP BY part, filter_order, step
"""

QUERIES = {"op12_filter_audit": op12_filter_audit}
SQL = {"op12_filter_audit": ORACLE_SQL}
