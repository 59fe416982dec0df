"""A training-corpus pipeline: language, quality, near-duplicates, decontamination, pieces.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of
documents. ``run`` writes every stage's result as Parquet in the shared folder and reads it again, so a lost
executor costs at most the stage at hand; a stage's folder is removed once the next one's is written.

Defined cases are those of the operators: null and empty texts are ``und`` and leave in the first stage.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from sonolith.llm import decontamination, language_id, near_dedup, piece_codec, quality_classifier
from sonolith.llm.common import remove, shared_path, table


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in an identified language."""
    return language_id.confident(docs)


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of good quality."""
    return quality_classifier.keep_good(docs, table(spark, sf_dir, "labels"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate class."""
    return near_dedup.keep_one(docs)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a benchmark window."""
    return decontamination.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_pieces, ids, ids_crc32 and round_trip of every document left."""
    return piece_codec.encode_and_check(docs, public_tokenizers.path("piece_bpe_32k.model"))


STAGES = [
    ("language ID", language),
    ("quality classifier", quality),
    ("MinHash near-dedup", near_duplicates),
    ("benchmark decontamination", decontaminated),
    ("SentencePiece encoding and decoding", pieces),
]

#: Fitted models and Viterbi segmentation can't be expressed in SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows over the documents of sf_dir."""
    return run_on(spark, table(spark, sf_dir, "documents"), sf_dir)


def run_on(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The last stage's rows over docs."""
    before = None
    for _, stage in STAGES:
        path = shared_path(spark, "pipeline")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        if before:
            remove(spark, before)
        before = path
    return docs
