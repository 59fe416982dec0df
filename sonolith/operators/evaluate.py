"""Batch accuracy: the rank of the right answer, rank histogram and mean reciprocal rank."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text


def accepts(expected: Column, candidate: Column, least: float = 0.6) -> Column:
    """Equal after normalisation, contained either way, or enough tokens in common."""
    a, b = text.normalise(expected), text.normalise(candidate)
    return (a == b) | ((a != "") & b.contains(a)) | text.tokens_match(expected, candidate, least)


def ranks(expected: DataFrame, candidates: DataFrame, most: int = 10) -> DataFrame:
    """(query_id, rank): the first accepted candidate's rank, 0 without one. expected: (query_id, expected); candidates: (query_id, rank, candidate)."""
    hit = F.when(accepts(F.col("expected"), F.col("candidate")) & (F.col("rank") <= most), F.col("rank"))
    # candidates are several of each query and may be made in the plan, where their size is not known: never broadcast
    joined = expected.hint("shuffle_merge").join(candidates.hint("shuffle_merge"), "query_id", "left")
    return joined.groupBy("query_id").agg(F.coalesce(F.min(hit), F.lit(0)).alias("rank"))


def histogram(found: DataFrame, most: int = 10) -> DataFrame:
    """(rank, n) for every rank from 1 to most: answers at exactly that rank."""
    every = found.sparkSession.range(1, most + 1).select(F.col("id").cast("int").alias("rank"))
    return every.join(found.where("rank > 0").groupBy(F.col("rank").cast("int").alias("rank")).agg(F.count("*").alias("n")), "rank", "left").select("rank", F.coalesce("n", F.lit(0)).alias("n"))


def histogram_with_mrr(found: DataFrame, most: int = 10) -> DataFrame:
    """(rank, n, mrr) for every rank from 1 to most, from one count of the ranks: a row of each rank."""
    counts = found.groupBy(F.col("rank").cast("int").alias("rank")).agg(F.count("*").alias("n"))
    held = F.when(F.col("rank") > 0, F.col("n") / F.col("rank")).otherwise(0.0)
    whole = counts.agg(F.map_from_entries(F.collect_list(F.struct("rank", "n"))).alias("by_rank"), (F.sum(held) / F.sum("n")).alias("mrr"))  # one row
    every = F.explode(F.sequence(F.lit(1), F.lit(most))).alias("rank")
    return whole.select(every, "by_rank", "mrr").select("rank", F.coalesce(F.col("by_rank")[F.col("rank")], F.lit(0)).alias("n"), "mrr")


def summary(found: DataFrame) -> DataFrame:
    """n, found, mrr and avg_rank (their harmonic mean, null without a hit)."""
    total = F.sum(F.when(F.col("rank") > 0, 1.0 / F.col("rank")).otherwise(0.0))
    return found.agg(F.count("*").alias("n"), F.count_if(F.col("rank") > 0).alias("found"), (total / F.count("*")).alias("mrr"), F.when(total > 0, F.count("*") / total).alias("avg_rank"))


def sample(clips: DataFrame, n: int = 100, seed: int = 1, key: str = "path") -> DataFrame:
    """n clips in a repeatable pseudo-random order."""
    return clips.orderBy(F.xxhash64(F.lit(seed), F.col(key)), key).limit(n)
