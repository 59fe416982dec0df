"""Range sharding by sampled splitters.

Records are ordered by a content key (md5 of the text, then the id), so copies of one text lie side by
side. A size-weighted sample of the keys gives quantile boundaries; records are partitioned by those
boundaries, ranges that turn out overfull are sampled again and subdivided, and running sums inside each
range plus the sums of the ranges before it place every record in the global order. A shard is an equal
share of the total bytes of that order. Because boundaries only decide which task sorts which records,
the result doesn't depend on the sample: retried tasks and other cluster sizes give the same rows.

Defined cases: a null text has no bytes (size 1) and crc32 0; a null id sorts first among equal texts;
equal (text, id) rows are interchangeable; an empty table gives an empty result; other columns are not
read, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import constant_array, cut, hash_order, session_partitions, table

#: Sampled keys for each range, and most ranges; their product bounds what the driver receives.
OVERSAMPLE = 24
MOST_RANGES = 4096


def record_keys(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, size, text_crc32, order_key) of every record; order_key sorts as (md5 of text, id)."""
    text = F.coalesce(F.col(text_col), F.lit("")).cast("binary")
    ident = F.col(id_col).cast("bigint")
    sortable = F.coalesce(F.lpad(F.hex(ident.bitwiseXOR(F.lit(-(2**63)).cast("bigint"))), 16, "0"), F.lit(""))
    return docs.select(
        ident.alias("doc_id"),
        (F.octet_length(text) + 1).cast("bigint").alias("size"),
        F.crc32(text).alias("text_crc32"),
        F.concat(F.md5(text), sortable).alias("order_key"),
    )


def range_of(key: Column, splitters: list[str]) -> Column:
    """How many splitters are at or below the key: a two-level search of about 2·sqrt(n) comparisons."""
    if not splitters:
        return F.lit(0)
    group = max(1, round(len(splitters) ** 0.5))
    every = constant_array(splitters)
    first = constant_array(splitters[::group])
    above = F.size(F.filter(first, lambda s: s <= key))
    inner = F.size(F.filter(F.slice(every, (above - 1) * group + 1, group), lambda s: s <= key))
    return F.when(above == 0, F.lit(0)).otherwise((above - 1) * group + inner)


def _sampled(keys: DataFrame, rate: float, seed: int) -> list[str]:
    """Keys drawn with a chance in proportion to their size; the choice is a function of the key."""
    draw = F.pmod(hash_order(seed, F.col("order_key")), F.lit(1 << 30)) / float(1 << 30)
    return sorted(r[0] for r in keys.where(draw < F.col("size") * rate).select("order_key").distinct().collect())


def splitters_for(keys: DataFrame, total: int, ranges: int, seed: int = 17) -> tuple[list[str], list]:
    """Quantile boundaries of a size-weighted sample, and (range, bytes, rows) loads; overfull ranges are subdivided."""
    drawn = _sampled(keys, ranges * OVERSAMPLE / max(total, 1), seed)
    splitters = drawn[OVERSAMPLE - 1 :: OVERSAMPLE]
    loads: list = []
    for attempt in range(1, 5):
        where = range_of(F.col("order_key"), splitters)
        loads = keys.groupBy(where.alias("r")).agg(F.sum("size"), F.count("*")).collect()
        full = {r[0]: r[1] for r in loads if r[1] > 2.5 * total / ranges and r[2] > 1}
        if not full or len(splitters) >= 2 * MOST_RANGES:
            break
        inside = keys.where(where.isin(list(full)))
        more = _sampled(inside, ranges * OVERSAMPLE / total, seed + attempt)
        added = sorted(set(more[OVERSAMPLE // 2 :: OVERSAMPLE]) - set(splitters))
        if not added:
            break
        splitters = sorted([*splitters, *added])
    return splitters, loads


def shard_records(docs: DataFrame, shards: int = 8, id_col: str = "doc_id", text_col: str = "text", ranges: int | None = None) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard of every record; sizes of shards are near equal."""
    spark = docs.sparkSession
    keys = cut(record_keys(docs, id_col, text_col))
    total, rows = keys.agg(F.coalesce(F.sum("size"), F.lit(0)), F.count("*")).first()
    ranges = ranges or min(MOST_RANGES, max(4 * shards, session_partitions(spark)))
    splitters, loads = splitters_for(keys, total, ranges) if rows else ([], [])
    by_range = {r[0]: (r[1], r[2]) for r in loads}
    bytes_before, rows_before, b, n = [], [], 0, 0
    for r in range(len(splitters) + 1):
        bytes_before.append(b)
        rows_before.append(n)
        b, n = b + by_range.get(r, (0, 0))[0], n + by_range.get(r, (0, 0))[1]
    order = Window.partitionBy("range_id").orderBy("order_key", "size")
    so_far = F.sum("size").over(order.rowsBetween(Window.unboundedPreceding, 0))
    at = F.col("range_id") + 1
    placed = (
        keys.withColumn("range_id", range_of(F.col("order_key"), splitters))
        .withColumn("before", so_far - F.col("size") + F.element_at(constant_array(bytes_before, "bigint"), at))
        .withColumn("row", F.row_number().over(order) - 1 + F.element_at(constant_array(rows_before, "bigint"), at))
        .withColumn("shard", F.expr(f"cast((2 * before + size) * {shards} div {2 * max(total, 1)} as int)"))
    )
    starts = placed.groupBy("shard").agg(F.min("row").alias("first_row"))  # as many rows as shards
    return placed.join(F.broadcast(starts), "shard").select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard",
        (F.col("row") - F.col("first_row")).cast("bigint").alias("slot"), F.lit(None).cast("int").alias("grown_shard"),
    )


def op3_sharding(spark, sf_dir: str) -> DataFrame:
    """Every document's shard of eight."""
    return shard_records(table(spark, sf_dir, "documents"))


#: crc32 has no function in this SQL dialect: the 256-entry table follows from the polynomial.
ORACLE_SQL = """
WITH RECURSIVE steps(i, k, v) AS (
  SELECT i, 0, i::UBIGINT FROM range(256) t(i)
  UNION ALL
  SELECT i, k + 1, CASE WHEN v & 1 = 1 THEN xor(v >> 1, 3988292384::UBIGINT) ELSE v >> 1 END FROM steps WHERE k < 8
), crc AS (SELECT list(v ORDER BY i) AS t FROM steps WHERE k = 8
), docs AS (
  SELECT doc_id, coalesce(text, '') AS x FROM documents
), bytes AS (
  SELECT x, [('0x' || h)::UBIGINT FOR h IN regexp_extract_all(hex(encode(x)), '..')] AS b FROM (SELECT DISTINCT x FROM docs)
), sums AS (
  SELECT x, xor(list_reduce(list_prepend(4294967295::UBIGINT, b), lambda c, y: xor(c >> 8, t[(xor(c, y) & 255)::BIGINT + 1])), 4294967295::UBIGINT)::BIGINT AS text_crc32
  FROM bytes, crc
), placed AS (
  SELECT doc_id, strlen(d.x) + 1 AS size, text_crc32, md5(d.x) AS m,
    sum(strlen(d.x) + 1) OVER (ORDER BY md5(d.x), doc_id NULLS FIRST ROWS UNBOUNDED PRECEDING) AS upto,
    sum(strlen(d.x) + 1) OVER () AS total
  FROM docs d JOIN sums USING (x)
), shards AS (
  SELECT *, ((2 * upto - size) * 8 // (2 * total))::INTEGER AS shard FROM placed
)
SELECT doc_id, size::BIGINT AS size, text_crc32, 'bytes' AS law, shard,
  (row_number() OVER (PARTITION BY shard ORDER BY m, doc_id NULLS FIRST) - 1)::BIGINT AS slot, CAST(NULL AS INTEGER) AS grown_shard
FROM shards
"""

QUERIES = {"op3_sharding": op3_sharding}
SQL = {"op3_sharding": ORACLE_SQL}
