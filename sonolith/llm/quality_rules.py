"""Quality rules with cross-document line frequency.

Base rules look at one document: too few words, or too many words inside repeated three-word windows. The
method looks across documents: the normalised lines of every document are hashed, the distinct documents of
each host that hold a line are counted (exact copies of a text count once), lines above the host's limit are
removed, and a document is rejected when too little of it is left. A document's host is its ``source``.

Everything is built-in expressions: per-document work stays inside the row, and only (host, line hash) pairs
are shuffled, pre-aggregated before the exchange, so a host with a third of all rows is spread by its lines.

Defined cases: a null text has no words (base_failed); a null source is a host of its own; repeated rows get
equal results; ids may be of any type; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, sized_join, table

SPACE = r"[ \t\n\x0B\f\r]"
NOT_SPACE = r"[^ \t\n\x0B\f\r]"
SYMBOLS = "#*$%&|<>"
#: Rows of frequent lines up to which they are broadcast (16 bytes each); beyond, the join shuffles with salted keys.
BROADCAST_LINES = 500_000


@dataclass(frozen=True)
class Limits:
    """A line is removed if at least ``least_docs`` distinct documents of its host hold it and they are at
    least ``percent_of_host`` of the host's distinct documents, or ``most_docs`` however large the host is. A document is rejected if fewer than
    ``left_words`` words, or than ``left_percent`` of its words, are left."""

    min_words: int = 50
    repeat_percent: int = 50
    least_docs: int = 10
    percent_of_host: int = 1
    most_docs: int = 100
    left_words: int = 50
    left_percent: int = 50


PRODUCTION = Limits()


def bind(value: Column, body) -> Column:
    """body(value), with the value computed once for each row."""
    return F.element_at(F.transform(F.array(value), body), 1)


def words_of(text: Column) -> Column:
    """Runs of characters other than ASCII white space."""
    return F.array_remove(F.split(text, SPACE + "+"), "")


def repeated_words(words: Column) -> Column:
    """How many words lie in three-word windows that occur twice or more.

    Window hashes are sorted with their positions, and equal neighbours are repeats: no step is quadratic
    in the text. 64-bit hashes of one text's windows stand for the windows themselves.
    """
    marked = F.transform(
        F.sequence(F.lit(0), F.size(words) - 3),
        lambda i: F.struct(F.xxhash64(F.get(words, i), F.get(words, i + 1), F.get(words, i + 2)).alias("h"), i.alias("p")),
    )
    twice = bind(F.sort_array(marked), lambda s: F.filter(s, lambda x, i: (x["h"] == F.get(s, i - 1)["h"]) | (x["h"] == F.get(s, i + 1)["h"])))
    covered = bind(F.transform(twice, lambda x: x["p"]), lambda p: F.size(F.array_distinct(F.concat(p, F.transform(p, lambda x: x + 1), F.transform(p, lambda x: x + 2)))))
    return F.when(F.size(words) >= 4, covered).otherwise(F.lit(0))


def normalised(line: Column) -> Column:
    """Lower case, digits as 0, runs of ASCII white space as one space, none at the ends."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(line), "[1-9]", "0"), SPACE + "+", " "))


def _keys(docs: DataFrame) -> DataFrame:
    """The columns every step starts from. doc and host stand for the ids with null as a value of its own."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return docs.select(
        F.col("doc_id"),
        F.struct(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("v"), F.col("doc_id").isNull().alias("n")).alias("doc"),
        F.xxhash64(F.coalesce(F.col("source"), F.lit("\x00null"))).alias("host"),
        F.xxhash64(text).alias("text_hash"),
        text.alias("text"),
    )


def base_figures(docs: DataFrame, limits: Limits = PRODUCTION) -> DataFrame:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words and base_failed of every document."""
    text = F.col("text")
    words = bind(words_of(text), lambda w: F.struct(F.size(w).alias("n"), repeated_words(w).alias("again")))
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(NOT_SPACE))
    return (
        _keys(docs)
        .withColumn("w", words)
        .select(
            "doc_id", "doc", "host", "text_hash",
            F.col("w.n").cast("bigint").alias("n_words"),
            F.length(F.regexp_replace(text, SPACE + "+", "")).cast("bigint").alias("word_chars"),
            F.length(F.regexp_replace(text, f"[^{SYMBOLS}]+", "")).cast("bigint").alias("n_symbols"),
            bind(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("bigint").alias("n_dup_lines"),
            F.col("w.again").cast("bigint").alias("n_repeat_words"),
        )
        .withColumn("base_failed", (F.col("n_words") < limits.min_words) | (100 * F.col("n_repeat_words") > limits.repeat_percent * F.col("n_words")))
    )


def line_rows(docs: DataFrame) -> DataFrame:
    """(doc, host, text_hash, pos, line, words) of every line with a word."""
    hashed = F.transform(F.split(F.col("text"), "\n"), lambda x: F.struct(F.xxhash64(normalised(x)).alias("line"), F.size(words_of(x)).alias("words")))
    flat = _keys(docs).select("doc", "host", "text_hash", F.posexplode(hashed).alias("pos", "l"))
    return flat.select("doc", "host", "text_hash", "pos", F.col("l.line").alias("line"), F.col("l.words").alias("words")).where("words > 0")


def frequent_lines(docs: DataFrame, limits: Limits = PRODUCTION) -> DataFrame:
    """(host, line) of lines above their host's limit; documents with equal texts count once."""
    counted = line_rows(docs).select("host", "line", "text_hash").distinct().groupBy("host", "line").agg(F.count("*").alias("n_docs")).where(F.col("n_docs") >= limits.least_docs)
    hosts = cut(_keys(docs).select("host", "text_hash").distinct().groupBy("host").agg(F.count("*").alias("host_docs")))
    share = 100 * F.col("n_docs") >= limits.percent_of_host * F.col("host_docs")
    return sized_join(counted, hosts, ["host"], BROADCAST_LINES).where(share | (F.col("n_docs") >= limits.most_docs)).select("host", "line")


def judge_documents(docs: DataFrame, limits: Limits = PRODUCTION) -> DataFrame:
    """The base figures, removed_words and kept of every document."""
    frequent = cut(frequent_lines(docs, limits))
    # repeated rows have the same positions: each position counts once
    removed = (
        sized_join(line_rows(docs), frequent, ["host", "line"], BROADCAST_LINES)
        .groupBy("doc", "host", "text_hash", "pos").agg(F.max("words").alias("words"))
        .groupBy("doc", "host", "text_hash").agg(F.sum("words").alias("removed_words"))
    )
    left = F.col("n_words") - F.col("removed_words")
    return (
        base_figures(docs, limits)
        .join(removed, ["doc", "host", "text_hash"], "left")
        .withColumn("removed_words", F.coalesce("removed_words", F.lit(0)))
        .withColumn("kept", ~F.col("base_failed") & (left >= limits.left_words) & (100 * left >= limits.left_percent * F.col("n_words")))
    )


def cleaned_texts(docs: DataFrame, limits: Limits = PRODUCTION) -> DataFrame:
    """(doc_id, text) of every document without its frequent lines; lines without a word stay."""
    frequent = cut(frequent_lines(docs, limits).withColumn("drop", F.lit(True)))
    parts = _keys(docs).select("doc_id", "doc", "host", "text_hash", F.posexplode(F.split("text", "\n")).alias("pos", "part"))
    kept = sized_join(parts.withColumn("line", F.xxhash64(normalised(F.col("part")))), frequent, ["host", "line"], BROADCAST_LINES, "left")
    kept = kept.where(F.col("drop").isNull() | ~F.col("part").rlike(NOT_SPACE))
    gathered = kept.groupBy("doc", "host", "text_hash").agg(F.array_sort(F.collect_set(F.struct("pos", "part"))).alias("p"), F.first("doc_id").alias("doc_id"))
    texts = gathered.select("doc", "host", "text_hash", F.array_join(F.transform("p", lambda x: x["part"]), "\n").alias("text"))
    every = _keys(docs).select("doc_id", "doc", "host", "text_hash")
    return every.join(texts, ["doc", "host", "text_hash"], "left").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))


COLUMNS = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "removed_words", "base_failed", "kept"]


def op5_quality_rules(spark, sf_dir: str) -> DataFrame:
    """Every document's figures and verdict."""
    return judge_documents(table(spark, sf_dir, "documents")).select(*COLUMNS)


ORACLE_SQL = r"""
WITH docs AS (
  SELECT doc_id, coalesce(source, chr(1) || 'null') AS host, coalesce(text, '') AS t FROM documents
), w AS (
  SELECT *, list_filter(string_split_regex(t, '[ \t\n\x0B\f\r]+'), lambda x: x <> '') AS ws,
    list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^ \t\n\x0B\f\r]')) AS ls
  FROM docs
), tri AS (
  SELECT DISTINCT t, unnest(range(1, greatest(len(ws) - 1, 1))) AS i, ws FROM w
), grams AS (
  SELECT t, i, count(*) OVER (PARTITION BY t, ws[i], ws[i + 1], ws[i + 2]) AS n FROM tri WHERE len(ws) >= 3
), again AS (
  SELECT t, count(DISTINCT p)::BIGINT AS n_repeat_words FROM (SELECT t, unnest([i, i + 1, i + 2]) AS p FROM grams WHERE n > 1) GROUP BY t
), lines AS (
  SELECT DISTINCT host, t, trim(regexp_replace(regexp_replace(lower(u.l), '[1-9]', '0', 'g'), '[ \t\n\x0B\f\r]+', ' ', 'g'), ' ') AS line, pos,
    len(list_filter(string_split_regex(u.l, '[ \t\n\x0B\f\r]+'), lambda x: x <> '')) AS words
  FROM (SELECT host, t, unnest(ls) AS l, unnest(range(len(ls))) AS pos FROM w) u
), hosts AS (
  SELECT host, count(DISTINCT t) AS host_docs FROM docs GROUP BY host
), frequent AS (
  SELECT host, line FROM (SELECT host, line, count(DISTINCT t) AS n_docs FROM lines GROUP BY host, line) JOIN hosts USING (host)
  WHERE n_docs >= 10 AND (100 * n_docs >= host_docs OR n_docs >= 100)
), removed AS (
  SELECT host, t, sum(words)::BIGINT AS removed_words FROM lines JOIN frequent USING (host, line) GROUP BY host, t
), figures AS (
  SELECT doc_id, len(ws)::BIGINT AS n_words, length(regexp_replace(t, '[ \t\n\x0B\f\r]+', '', 'g'))::BIGINT AS word_chars,
    length(regexp_replace(t, '[^#*$%&|<>]+', '', 'g'))::BIGINT AS n_symbols, (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines,
    coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words, coalesce(removed_words, 0)::BIGINT AS removed_words
  FROM w LEFT JOIN again USING (t) LEFT JOIN removed USING (host, t)
)
SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
  NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AND n_words - removed_words >= 50 AND 100 * (n_words - removed_words) >= 50 * n_words AS kept
FROM figures
"""

QUERIES = {"op5_quality_rules": op5_quality_rules}
SQL = {"op5_quality_rules": ORACLE_SQL}
