"""Benchmark decontamination with a distributed positional inverted index.

The benchmark's windows of ten words (a shorter item is one window) are the phrases to find. A first pass
counts how often each benchmark term occurs in all documents. Each window is then looked up by its two
rarest terms: the second pass stores the positional postings of those terms only - a window can't occur
where its rarest term doesn't - and the offset-adjusted lists are intersected on (document, start). What is
left is compared word by word with the text, so matches are exact. ``near_matches`` lets every word be a few
places off.

Only postings of rare terms are shuffled, by document; a passage held by a third of all documents gives
postings in proportion to those documents and no pairs. Texts are compared where they are scanned: those of
documents with a candidate are found by a broadcast of their keys while these are at most ``BROADCAST_KEYS``, and only
these texts are shuffled; beyond that the join shuffles texts by key. Items are joined to windows by number after
the comparison. Terms are broadcast while their number is under ``BROADCAST_TERMS``, beyond that the joins shuffle.

Defined cases: null and empty texts have no words, hits or items (items_sha256 of the empty string); items
without a word have no window; equal windows of several items count for each; a document is its id and text, so
rows that share an id, or have none, are judged by their own texts and repeated rows get equal results; ids may be of
any type; empty tables are allowed on both sides; other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, sized_join, table

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: What is between words once A-Z are lower-cased: ASCII other than 0-9 and a-z. In a text as it is, A-Z are letters too.
BETWEEN = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
WINDOW = 10
#: Terms (about 40 bytes each as a broadcast row) up to which they are broadcast.
BROADCAST_TERMS = 1_000_000
#: Keys of documents (16 bytes and a hash entry each) up to which they are broadcast.
BROADCAST_KEYS = 1_000_000
#: Windows (ten words and a number, about 200 bytes each) up to which they are broadcast.
BROADCAST_WINDOWS = 200_000


def ascii_lower(x: Column) -> Column:
    """A-Z lower-cased and nothing else: whole lower-casing is right where the text is ASCII."""
    return F.when(F.octet_length(x) == F.length(x), F.lower(x)).otherwise(F.translate(x, UPPER, LOWER))


def words_of(text: Column) -> Column:
    """Lower-cased words, in order; the case of each word is mapped after the split."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), BETWEEN), "")


def benchmark_windows(benchmark: DataFrame, size: int = WINDOW) -> DataFrame:
    """(phrase, items) of every distinct window: its words, and the items that hold it."""
    words = F.transform(words_of(F.col("text").cast("string")), ascii_lower)
    items = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item_id"), words.alias("w")).where(F.size("w") > 0)
    starts = F.sequence(F.lit(0), F.greatest(F.size("w") - size, F.lit(0)))
    flat = items.select("item_id", F.explode(F.transform(starts, lambda i: F.slice(F.col("w"), i + 1, size))).alias("phrase"))
    return flat.groupBy("phrase").agg(F.collect_set("item_id").alias("items"))


def numbered_windows(benchmark: DataFrame, size: int = WINDOW) -> DataFrame:
    """(phrase_id, phrase, items), from a checkpoint: the ids stay what they are."""
    return cut(benchmark_windows(benchmark, size).withColumn("phrase_id", F.monotonically_increasing_id()))


def _sized(df: DataFrame, most: int) -> DataFrame:
    """df, to be broadcast if it has few enough rows."""
    return F.broadcast(df) if df.count() <= most else df


def keyed(docs: DataFrame) -> DataFrame:
    """(doc_id, id, text_hash, text): hashes of id and text name the document."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return docs.select(F.col("doc_id"), *key_of(), text.alias("text"))


def key_of() -> list[Column]:
    """id and text_hash of a row of documents; a null id is an id of its own."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return [F.xxhash64(F.col("doc_id").cast("string")).alias("id"), F.xxhash64(text, F.col("doc_id").isNull()).alias("text_hash")]


def tokens(docs: DataFrame) -> DataFrame:
    """(id, text_hash, pos, term) of every word of keyed documents."""
    flat = docs.select("id", "text_hash", F.posexplode(words_of(F.col("text"))).alias("pos", "word"))
    return flat.select("id", "text_hash", "pos", F.xxhash64(ascii_lower(F.col("word"))).alias("term"))


def term_counts(docs: DataFrame, windows: DataFrame) -> DataFrame:
    """(term, n): how often each benchmark term occurs in all documents; absent terms have no row."""
    terms = windows.select(F.explode("phrase").alias("w")).select(F.xxhash64("w").alias("term")).distinct()
    words, n = tokens(docs).select("term"), F.count("*").alias("n")
    if terms.count() <= BROADCAST_TERMS:
        return words.join(F.broadcast(terms), "term", "left_semi").groupBy("term").agg(n)
    return words.groupBy("term").agg(n).join(terms, "term", "left_semi")  # counted before the shuffle: no term is hot


def rare_terms(windows: DataFrame, counts: DataFrame, lists: int = 2) -> DataFrame:
    """(phrase_id, term, offset, rank, n_lists): each window's rarest terms, ranked from 1; windows with an absent term are left out."""
    places = windows.select("phrase_id", F.size("phrase").alias("size"), F.posexplode("phrase").alias("offset", "w"))
    ranked = places.withColumn("term", F.xxhash64("w")).join(counts, "term").withColumn("whole", F.count("*").over(Window.partitionBy("phrase_id")))
    order = Window.partitionBy("phrase_id").orderBy("n", "offset")
    best = ranked.where("whole = size").withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= lists)
    return best.select("phrase_id", "term", "offset", "rank", F.least("size", F.lit(lists)).alias("n_lists"))


def postings(docs: DataFrame, rare: DataFrame) -> DataFrame:
    """The stored index: (term, id, text_hash, pos) of every occurrence of a rare term in all documents."""
    return cut(sized_join(tokens(docs), rare.select("term").distinct(), ["term"], BROADCAST_TERMS, "left_semi").select("term", "id", "text_hash", "pos"))


def adjusted(index: DataFrame, rare: DataFrame) -> DataFrame:
    """Offset-adjusted lists: (id, text_hash, start, phrase_id, offset, rank, n_lists)."""
    return sized_join(index, rare, ["term"], BROADCAST_TERMS).withColumn("start", F.col("pos") - F.col("offset")).drop("pos", "term")


def exact_candidates(lists: DataFrame) -> DataFrame:
    """(id, text_hash, start, phrase_id) where the lists of all of a window's rare terms meet. Repeated rows of a document repeat its entries: each list counts once."""
    lists = lists.withColumn("bit", F.expr("shiftleft(1L, rank)"))
    met = lists.groupBy("id", "text_hash", "start", "phrase_id").agg(F.bit_count(F.bit_or("bit")).alias("n"), F.first("n_lists").alias("n_lists"))
    return met.where((F.col("n") == F.col("n_lists")) & (F.col("start") >= 0)).select("id", "text_hash", "start", "phrase_id")


def candidate_texts(docs: DataFrame, found: DataFrame) -> DataFrame:
    """(id, text_hash, found, text) of every document with a candidate, once. found: (id, text_hash, start, phrase_id, phrase)."""
    found = cut(found)
    keys = cut(found.select("id", "text_hash").distinct())
    texts = docs.select("id", "text_hash", "text").join(_sized(keys, BROADCAST_KEYS), ["id", "text_hash"], "left_semi").dropDuplicates(["id", "text_hash"])
    by_doc = found.groupBy("id", "text_hash").agg(F.collect_list(F.struct("start", "phrase_id", "phrase")).alias("found"))
    return texts.join(by_doc, ["id", "text_hash"]).select("id", "text_hash", "found", "text")


def exact_hits(docs: DataFrame, windows: DataFrame) -> DataFrame:
    """(id, text_hash, hits) of the documents that hold a window; hits: start, phrase_id and size of each. docs: keyed."""
    rare = cut(rare_terms(windows, term_counts(docs, windows)))
    phrases = windows.select("phrase_id", "phrase")
    found = sized_join(exact_candidates(adjusted(postings(docs, rare), rare)), phrases, ["phrase_id"], BROADCAST_WINDOWS)

    def hits(w: Column) -> Column:
        held = F.filter("found", lambda c: F.slice(w, c["start"] + 1, F.size(c["phrase"])) == c["phrase"])
        return F.transform(held, lambda c: F.struct(c["start"].alias("start"), c["phrase_id"].alias("phrase_id"), F.size(c["phrase"]).alias("size")))

    # one element: the words are made once for each text, and the checkpoint keeps the filter from making them again
    once = F.element_at(F.transform(F.array(F.transform(words_of(F.col("text")), ascii_lower)), hits), 1)
    return cut(candidate_texts(docs, found).select("id", "text_hash", once.alias("hits"))).where(F.size("hits") > 0)


def near_matches(docs: DataFrame, benchmark: DataFrame, slop: int, size: int = WINDOW) -> DataFrame:
    """(doc_id, start, gap, phrase): windows whose rarest term is at its place and every other word within ``slop`` places of its own; gap is the greatest of these distances, 0 for exact matches."""
    docs, windows = keyed(docs), numbered_windows(benchmark, size)
    rare = cut(rare_terms(windows, term_counts(docs, windows)))
    leads = rare.where("rank = 1").select("phrase_id", F.col("offset").alias("lead"))
    lists = adjusted(postings(docs, rare), rare).withColumn("bucket", F.floor(F.col("start") / (slop + 1)))
    a = lists.where("rank = 1").select("id", "text_hash", "phrase_id", "start", "n_lists", F.explode(F.array(F.col("bucket") - 1, F.col("bucket"), F.col("bucket") + 1)).alias("bucket"))
    b = lists.where("rank = 2").select("id", "text_hash", "phrase_id", F.col("start").alias("other"), "bucket")
    both = a.join(b, ["id", "text_hash", "phrase_id", "bucket"], "left").where((F.abs(F.col("start") - F.col("other")) <= slop) | (F.col("n_lists") == 1))
    found = sized_join(both.select("id", "text_hash", "start", "phrase_id").distinct(), windows.join(leads, "phrase_id").select("phrase_id", "phrase", "lead"), ["phrase_id"], BROADCAST_WINDOWS)
    flat = candidate_texts(docs, found.withColumn("phrase", F.struct("phrase", "lead")))
    flat = flat.select("id", "text_hash", F.transform(words_of(F.col("text")), ascii_lower).alias("w"), F.explode("found").alias("c"))
    flat = flat.select("id", "text_hash", "w", F.col("c.start").alias("start"), F.col("c.phrase.phrase").alias("phrase"), F.col("c.phrase.lead").alias("lead"))

    def distance(word: Column, i: Column) -> Column:
        """How far word i of the phrase is from its place; slop + 1 where it isn't near, and for the rarest term off its place."""
        reach = F.when(i == F.col("lead"), F.lit(0)).otherwise(F.lit(slop))
        at = F.filter(F.sequence(-reach, reach), lambda k: F.get(F.col("w"), (F.col("start") + i + k).cast("int")).eqNullSafe(word))
        return F.coalesce(F.array_min(F.transform(at, F.abs)), F.lit(slop + 1))

    gaps = flat.withColumn("gap", F.array_max(F.transform("phrase", distance))).where(F.col("gap") <= slop)
    return docs.select("doc_id", "id", "text_hash").join(gaps, ["id", "text_hash"]).select("doc_id", F.col("start").cast("bigint").alias("start"), "gap", "phrase")


def contamination(docs: DataFrame, benchmark: DataFrame, size: int = WINDOW) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items, items_sha256, contaminated of every document."""
    docs = keyed(docs)
    windows = numbered_windows(benchmark, size)
    hits = exact_hits(docs, windows)
    covered = F.array_distinct(F.flatten(F.transform("hits", lambda h: F.sequence(h["start"], h["start"] + h["size"] - 1))))
    n_hit = hits.select("id", "text_hash", F.size(covered).cast("bigint").alias("n_hit"))
    met = hits.select("id", "text_hash", F.explode(F.array_distinct(F.transform("hits", lambda h: h["phrase_id"]))).alias("phrase_id"))
    items = met.join(windows.select("phrase_id", F.explode("items").alias("item")), "phrase_id").groupBy("id", "text_hash").agg(F.array_sort(F.collect_set("item")).alias("items"))
    figures = n_hit.join(items, ["id", "text_hash"])
    return (
        docs.select("doc_id", "id", "text_hash", F.size(words_of(F.col("text"))).cast("bigint").alias("n_words"))
        .join(figures, ["id", "text_hash"], "left")
        .select("doc_id", "n_words", F.coalesce("n_hit", F.lit(0).cast("bigint")).alias("n_hit"), F.coalesce("items", F.array().cast("array<string>")).alias("items"))
        .select(
            "doc_id", "n_words", "n_hit", F.size("items").cast("bigint").alias("n_items"), "items",
            F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"),
        )
    )


def decontaminate(docs: DataFrame, benchmark: DataFrame, size: int = WINDOW) -> DataFrame:
    """The documents that hold no benchmark window, with all their columns. A row is judged by its own text, whatever other rows share its id."""
    bad = cut(exact_hits(keyed(docs), numbered_windows(benchmark, size)).select("id", "text_hash").distinct())
    ident, text_hash = key_of()
    marked = docs.withColumn("\x00id", ident).withColumn("\x00hash", text_hash)
    named = bad.select(F.col("id").alias("\x00id"), F.col("text_hash").alias("\x00hash"))
    return marked.join(_sized(named, BROADCAST_KEYS), ["\x00id", "\x00hash"], "left_anti").select(*(F.col(f"`{c}`") for c in docs.columns))


def op9_benchmark_decontamination(spark, sf_dir: str) -> DataFrame:
    """Every document's benchmark hits."""
    found = contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


ORACLE_SQL = r"""
WITH d AS (
  SELECT DISTINCT coalesce(text, '') AS t, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w
  FROM documents
), b AS (
  SELECT item_id::VARCHAR AS item_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w
  FROM benchmark
), win AS (
  SELECT DISTINCT item_id, least(len(w), 10) AS n, array_to_string(w[i:i + 9], ' ') AS phrase
  FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS i FROM b WHERE len(w) > 0)
), sizes AS (
  SELECT DISTINCT n FROM win
), places AS (
  SELECT t, i, n, array_to_string(w[i:i + n - 1], ' ') AS phrase
  FROM (SELECT t, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, sizes WHERE len(w) >= n)
), hits AS (
  SELECT t, i, n, item_id FROM places JOIN win USING (n, phrase)
), covered AS (
  SELECT t, count(DISTINCT p) AS n_hit FROM (SELECT t, unnest(range(i, i + n)) AS p FROM (SELECT DISTINCT t, i, n FROM hits)) GROUP BY t
), items AS (
  SELECT t, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS ids FROM (SELECT DISTINCT t, item_id FROM hits) GROUP BY t
)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
  sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM documents JOIN d ON d.t = coalesce(text, '') LEFT JOIN covered USING (t) LEFT JOIN items USING (t)
"""

QUERIES = {"op9_benchmark_decontamination": op9_benchmark_decontamination}
SQL = {"op9_benchmark_decontamination": ORACLE_SQL}
