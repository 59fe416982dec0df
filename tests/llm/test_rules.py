import random
import zlib

import duckdb
import pandas as pd
import pytest

from sonolith.llm import quality_rules as Q
from sonolith.llm import sharding as S
from sonolith.llm import url_filters as U
from pyspark.sql import functions as F


def table_of(df: pd.DataFrame) -> list:
    return sorted(map(tuple, df[sorted(df.columns)].astype(object).where(lambda x: x.notna(), None).to_numpy().tolist()), key=str)


def oracle(sql, **tables):
    con = duckdb.connect()
    for name, df in tables.items():
        con.register(name, df)
    return con.sql(sql).df()


TEXTS = ["", None, "one", "a b c a b c a b c", "x\ny\nx\n\n \nx", "é ü\tß\x0bz \n #*$%&|<> ", "The  Line 12\nthe line 99\n" + "w " * 60, "w" * 70_000 + " end", " lead\n"]


def test_quality_rules_match_the_oracle(spark):
    rng = random.Random(3)
    rows = [(i, t, "s") for i, t in enumerate(TEXTS)]
    for i in range(60):  # a boilerplate line in many documents of one host
        body = " ".join(f"v{rng.randrange(10**6)}" for _ in range(rng.choice([20, 60, 120])))
        rows.append((100 + i, f"Common line {i % 10} of this host\n{body}\n{' '.join(['thin'] * 3)}", "host" if i % 3 else None))
    rows += [rows[20], rows[20], (None, rows[21][1], rows[21][2]), (None, "null id", None)]
    pdf = pd.DataFrame(rows, columns=["doc_id", "text", "source"])
    pdf["doc_id"] = pdf["doc_id"].astype("Int64")
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, source string").selectExpr("*", "1 as host", "'q' as line", "2 as words")
    got = Q.judge_documents(docs).select(*Q.COLUMNS).toPandas()
    assert table_of(got) == table_of(oracle(Q.ORACLE_SQL, documents=pdf))
    assert got.removed_words.max() > 0
    assert Q.judge_documents(docs.where("false")).count() == 0
    assert Q.cleaned_texts(docs).count() == len(rows)
    cleaned = {r.doc_id: r.text for r in Q.cleaned_texts(docs).collect()}
    assert "Common line" not in cleaned[101] and cleaned[4] == "x\ny\nx\n\n \nx"


def test_lines_beyond_the_broadcast_give_the_same(spark, monkeypatch):
    rows = [(i, f"common {i % 3} line\nu{i} v{i}\n" + " ".join(f"w{i}x{j}" for j in range(70 * (i % 2))), "h" if i % 4 else None) for i in range(80)] + [(3, None, "h")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, source string")
    want = [sorted(map(str, f.collect())) for f in (Q.judge_documents(docs).select(*Q.COLUMNS), Q.cleaned_texts(docs))]
    monkeypatch.setattr(Q, "BROADCAST_LINES", 0)
    assert [sorted(map(str, f.collect())) for f in (Q.judge_documents(docs).select(*Q.COLUMNS), Q.cleaned_texts(docs))] == want
    assert Q.judge_documents(docs).where("removed_words > 0").count() > 0


def test_repeated_windows_by_hand(spark):
    got = spark.createDataFrame([("a b c a b c",), ("a b c d",), ("a a a a",), ("a b",), ("x a b c y a b c",)], "t string").select(Q.bind(Q.words_of(F.col("t")), Q.repeated_words)).collect()
    assert [r[0] for r in got] == [6, 0, 4, 0, 6]


def test_ids_that_are_texts(spark):
    rows = [("a", "one two\n" * 3, "s"), ("0", "x " * 60, "s"), (None, "y", None), ("", "z", "s")]
    got = Q.judge_documents(spark.createDataFrame(rows, "doc_id string, text string, source string")).collect()
    assert sorted((str(r.doc_id), r.n_words) for r in got) == [("", 1), ("0", 60), ("None", 1), ("a", 6)]


def test_copies_of_one_text_count_once(spark):
    body = "one line of boilerplate\n" + " ".join(f"u{i}" for i in range(80))
    docs = spark.createDataFrame([(i, body, "h") for i in range(40)], "doc_id bigint, text string, source string")
    assert Q.judge_documents(docs).where("kept").count() == 40


def test_shards_match_the_oracle(spark):
    rng = random.Random(1)
    rows = [(i, "z" * rng.choice([0, 3, 50, 2000])) for i in range(400)] + [(1000 + i, "hot copy" * 20) for i in range(300)]
    rows += [(None, None), (None, "x"), (7, None), (7, None), (5000, "long " * 30_000), (5001, "é" * 10)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").selectExpr("*", "1 as size", "'k' as order_key", "3 as shard")
    got = S.shard_records(docs)
    pdf = got.toPandas()
    want = oracle(S.ORACLE_SQL, documents=pd.DataFrame(rows, columns=["doc_id", "text"]).astype({"doc_id": "Int64"}))
    assert table_of(pdf) == table_of(want)
    for shard, part in pdf.groupby("shard"):
        assert sorted(part.slot) == list(range(len(part)))
    want = {(i, zlib.crc32((t or "").encode())) for i, t in rows}
    assert {(r.doc_id, r.text_crc32) for r in got.collect()} == want


def test_shard_sizes_are_near_equal_and_ranges_split(spark):
    docs = spark.range(6000).selectExpr("id as doc_id", "case when id % 3 = 0 then 'same text' else concat('t', id) end as text")
    got = S.shard_records(docs, ranges=32).toPandas()
    sizes = got.groupby("shard")["size"].sum()
    assert len(sizes) == 8 and sizes.max() - sizes.min() <= 2 * got["size"].max()
    keys = S.record_keys(docs)
    total, _ = keys.agg(F.sum("size"), F.count("*")).first()
    _, loads = S.splitters_for(keys, total, 32)
    assert max(r[1] for r in loads) <= 2.5 * total / 32


def test_a_repeated_row_overfills_a_range(spark):
    """Rows of one id and text can't be ordered apart: their range stays full, the law holds all the same."""
    rows = [(7, "x" * 50)] * 3000 + [(i, f"t{i}") for i in range(500)]
    got = S.shard_records(spark.createDataFrame(rows, "doc_id bigint, text string"), ranges=16).collect()
    by = {}
    for r in got:
        by.setdefault(r.shard, []).append((r.slot, r.size))
    assert len(got) == 3500 and all(sorted(s for s, _ in v) == list(range(len(v))) for v in by.values())
    sizes = [sum(b for _, b in by.get(k, [])) for k in range(8)]
    assert max(sizes) - min(sizes) <= 2 * 51


def test_no_rows(spark):
    assert S.shard_records(spark.createDataFrame([], "doc_id bigint, text string")).count() == 0


URLS = [
    None, "", "no scheme", "http://", "http://Sub.Example.ORG/es/1", "https://example.org/en/1", "https://example.org/en/12", "https://example.org/en/", "http://notexample.org/es/", "http://org", "http://org/",
    "http://a.org?x=/", "http://x.com/fr/#top", "http://x.com/de", "http://x.com/de/a?b", "http://xcom/de/", "http://spam-farm.example.net/a", "http://my-casino.net", "http://casinos.net/", "http://a.b/://c", "http://u:p@x.org:80/", "http://É.org/", "http://x.org/A\nb#z",
    "http://b.net/top-casino-games", "http://b.net/.org\x00/x", "http://b.net/x.org/", "http://b.net/.spam.", "http://x.com/de/" + "a/" * 50_000, "http://" + "a." * 20_000 + "org/", "http://spam\x00x.net/", "HTTP://ORG/ES/",
]


def test_urls_match_the_oracle(spark):
    rows = list(enumerate(URLS)) + [(3, URLS[3]), (None, URLS[4])]
    pages = spark.createDataFrame(rows, "page_id bigint, url string").selectExpr("*", "'h' as host", "1 as token")
    got = U.filter_urls(pages, U.CONTRACT_RULES + U.OWN_RULES).toPandas()
    want = oracle(U.ORACLE_SQL, pages=pd.DataFrame(rows, columns=["page_id", "url"]).astype({"page_id": "Int64"}))
    assert table_of(got) == table_of(want)
    assert U.filter_urls(pages.where("false"), U.CONTRACT_RULES).count() == 0


def test_only_fetched_rules_run():
    rules = [U.prefix_rule("block", f"site{i}.net/p{i}/") for i in range(500)] + [U.prefix_rule("allow", "net/")]
    filed, loose = U.index_rules(rules, {"net": 1000, **{f"site{i}": 1 for i in range(500)}, **{f"p{i}": 2 for i in range(500)}})
    assert not loose and len(filed) == 501 and all(len(r) == 1 for r in filed.values())

    class Counting:
        def __init__(self):
            self.n = 0

        def __getitem__(self, rule):
            import re

            self.n += 1
            return re.compile(rule.host), re.compile(rule.path)

    compiled = Counting()
    found = U.judge("a.site7.net", "/p7/x", filed, loose, compiled)
    assert (found.name, found.verdict) == ("site7.net/p7/", "block") and compiled.n <= 2


def fits(host, path, name):
    ending, slash, rest = name.partition("/")
    return (host == ending or host.endswith("." + ending)) and path.startswith(slash + rest)


def test_many_rules_of_a_table_match_brute_force(spark, monkeypatch):
    rng = random.Random(9)
    names = sorted({f"{rng.choice('abcde')}{rng.randrange(40)}.{rng.choice(['net', 'org'])}/{rng.choice(['', 'p/', 'q/r', 'P1/x', 'x-1_'])}" for _ in range(600)} | {f"s{i}.com/" for i in range(10_000)})
    table = spark.createDataFrame([(rng.choice(["allow", "block"]), n) for n in names] + [("block", None), ("other", "a1.net/"), (None, "a2.net/")], "verdict string, rule string").union(spark.createDataFrame([("block", "a3.net/")], "verdict string, rule string"))
    verdict = {r: "block" if any(v == "block" for v, x in rows if x == r) else "allow" for rows in [[(x.verdict, x.rule) for x in table.collect() if x.rule and x.verdict in ("allow", "block")]] for _, r in rows}
    urls = [f"http://{rng.choice(['', 'w.', 'x'])}{rng.choice('abcdes')}{rng.randrange(60)}.{rng.choice(['net', 'org', 'com'])}/{rng.choice(['', 'p/z', 'q/rest', 'q/r/', 'P1/x', 'p1/x', 'x-1_y'])}" for _ in range(400)]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id bigint, url string")
    rules = U.rules_of(table)
    for most in (100_000, 4_000):
        monkeypatch.setattr(U, "MOST_RULES", most)
        got = {r.page_id: r for r in U.filter_urls(pages, rules).collect()}
        for i in range(len(urls)):
            r = got[i]
            mine = sorted((n for n in verdict if fits(r.host, r.path, n)), key=lambda n: (len(n), verdict[n]))
            assert (r.rule is None) == (not mine) and (r.verdict == verdict[mine[-1]] and len(r.rule) == len(mine[-1]) if mine else r.verdict == "allow"), (r, mine)
