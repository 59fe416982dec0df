"""Bounded, repeatable samples of labelled rows for fitting.

A row is drawn by a hash of its id and text with one chance for all rows of its label: the chance that gives
about ``per_class`` rows, or ``FIT_BYTES`` of text if that is fewer. Long texts are drawn like others. The
driver receives the drawn rows only; equal rows are one row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import hash_order

#: Bytes of text of one label that are drawn on average: with per_class, the bound of a fit.
FIT_BYTES = 48 << 20


def _keyed(docs: DataFrame, label: str | None = None) -> DataFrame:
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    own = [F.col(label).alias("label")] if label else []
    return docs.where("doc_id is not null").select("doc_id", F.xxhash64(text).alias("text_hash"), F.octet_length(text).alias("size"), *own)


def chance(seed: int) -> Column:
    """A number below 1 that follows from doc_id and text_hash."""
    return F.pmod(hash_order(seed, F.col("doc_id"), F.col("text_hash")), F.lit(1 << 40)) / float(1 << 40)


def drawn(rows: DataFrame, per_class: int, seed: int = 11) -> tuple[DataFrame, dict]:
    """(the drawn rows; all rows by label). rows: (doc_id, text_hash, size, label)."""
    found = rows.groupBy("label").agg(F.count("*"), F.sum("size")).collect()  # a row for each label
    rate = F.lit(0.0)
    for label, n, size in found:
        rate = F.when(F.col("label") == F.lit(label), F.lit(min(1.0, per_class / n, FIT_BYTES / max(size, 1)))).otherwise(rate)
    return rows.where(chance(seed) < rate), {r[0]: r[1] for r in found}


def training_texts(docs: DataFrame, labels: DataFrame | None, label: str, per_class: int, allowed: Column | None = None, columns: tuple[str, ...] = (), seed: int = 11) -> tuple[list, dict]:
    """(drawn rows of doc_id, label, text and columns in order; counts of all allowed rows by label).

    labels: (doc_id, label), of several rows of an id the greatest label is used; None if the label is a column of docs.
    Null ids and null labels are left out; a null text is the empty text.
    """
    keys = _keyed(docs, None if labels is not None else label)
    if labels is not None:
        named = labels.where(F.col("doc_id").isNotNull() & F.col(label).isNotNull()).groupBy("doc_id").agg(F.max(label).alias("label"))
        keys = keys.join(named, "doc_id")
    keys = keys.where("label is not null")
    if allowed is not None:
        keys = keys.where(allowed)
    chosen, counts = drawn(keys, per_class, seed)
    wanted = F.broadcast(chosen.select("doc_id", "text_hash", "label").distinct())  # about per_class rows of 24 bytes for each label
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    body = docs.select("doc_id", F.xxhash64(text).alias("text_hash"), F.struct(text.alias("text"), *columns).alias("row"))
    one = body.join(wanted, ["doc_id", "text_hash"]).groupBy("doc_id", "text_hash").agg(F.max("label").alias(label), F.min("row").alias("row"))
    found = one.select("doc_id", "text_hash", label, "row.*").collect()
    return sorted(found, key=lambda r: (r["doc_id"], r["text_hash"])), counts
