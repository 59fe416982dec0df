"""URL filtering by pattern rules that are indexed by their rarest literal token.

A rule is a regular expression for the host and one for the start of the path, with the literal tokens that every matching
url must contain. The number of urls that hold each token is counted over all urls; a rule is filed under the token
with the lowest count. A url's own tokens fetch the rules filed under them, and only those rules run their
expressions. Rules without a literal token run on every url. The longest matching rule decides (of two of one length the
blocking one); without one the verdict is allow. Rules may come from a table, so a long list is looked up like a short one.

Defined cases: a null url, or one without ``://``, has an empty host and path, fits no rule and is allowed;
repeated rows are judged alike; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import table

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Runs of letters and digits; those of small ones; the tokens of a url, which other letters and digits don't adjoin.
TOKEN, SMALL = re.compile(r"[A-Za-z0-9]+"), re.compile(r"[a-z0-9]+")
URL_TOKEN = re.compile(r"(?<![A-Za-z0-9])[a-z0-9]+(?![A-Za-z0-9])")
#: Rules that are sent to the executors at once (about half a kilobyte each, compiled).
MOST_RULES = 100_000


@dataclass(frozen=True)
class Rule:
    """verdict for urls whose host holds the pattern ``host`` and whose path starts with the pattern ``path``; tokens: whole
    literal tokens of every match; name: what is reported (null for the method's own rules)."""

    verdict: str
    host: str
    path: str
    tokens: tuple[str, ...]
    weight: int
    name: str | None


def prefix_rule(verdict: str, name: str) -> Rule:
    """A rule like ``example.org/es/``: the host and its subdomains, and paths that start with the rest."""
    host, slash, rest = name.partition("/")
    path = slash + rest
    whole = TOKEN.findall(path)
    if whole and path[-1].isalnum():
        whole = whole[:-1]  # the last token may go on in the url
    tokens = tuple(dict.fromkeys([*TOKEN.findall(host), *(t for t in whole if SMALL.fullmatch(t))]))
    return Rule(verdict, rf"(?:^|\.){re.escape(host)}\Z", re.escape(path), tokens, len(name), name)


def label_rule(verdict: str, words: str) -> Rule:
    """A rule of the method's own: a part of the host made of the given tokens, between dots or hyphens."""
    return Rule(verdict, rf"(?:^|[.\x2d]){re.escape(words)}(?:[.\x2d]|\Z)", "", tuple(words.split("-")), -1, None)


def rules_of(table: DataFrame) -> list[Rule]:
    """The rules of a table (verdict, rule) like ``block``, ``example.org/es/``; equal rules once, null ones none."""
    rows = table.select(F.col("verdict").cast("string"), F.col("rule").cast("string")).where("verdict in ('allow', 'block') and rule is not null").distinct()
    return [prefix_rule(v, n) for v, n in sorted(map(tuple, rows.collect()))]  # a rule list is what the driver is given


#: Fixed rules of the contract: verdict and host with path.
CONTRACT_RULES = [
    prefix_rule("allow", "org/"),
    prefix_rule("block", "example.org/es/"),
    prefix_rule("block", "example.org/en/1"),
    prefix_rule("allow", "com/fr/"),
    prefix_rule("block", "com/de/"),
]
#: The method's own rules, for urls that no listed rule fits: host labels of unwanted sites.
OWN_RULES = [label_rule("block", w) for w in ("spam", "spam-farm", "casino", "porn", "xxx", "adult", "betting", "warez", "malware", "phishing", "doubleclick", "adserver", "clickbait", "torrent")]


def url_parts(url):
    """(host, path) columns: host after the first ``://`` with A-Z lower-cased, path up to ``?``, ``#`` or the end."""
    url = F.coalesce(url, F.lit(""))
    # (?s): a line break is part of host or path
    host = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    path = F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1)
    return F.translate(host, UPPER, LOWER), path


def tokens_of(host, path):
    """Literal tokens of a url: runs of a-z0-9 of its host and its path; path tokens keep their case."""
    return F.array_distinct(F.regexp_extract_all(F.concat(host, F.lit("\x00"), path), F.lit(r"(?<![A-Za-z0-9])[a-z0-9]+(?![A-Za-z0-9])"), F.lit(0)))


def token_counts(urls: DataFrame, rules: list[Rule]) -> dict[str, int]:
    """How many urls hold each token of the rules: at most one row for each of those tokens."""
    wanted = sorted({t for r in rules for t in r.tokens})
    if not wanted:
        return {}
    asked = urls.sparkSession.createDataFrame([(t,) for t in wanted], "token string")
    held = urls.select(F.explode(tokens_of(F.col("host"), F.col("path"))).alias("token"))
    return {r[0]: r[1] for r in held.join(F.broadcast(asked), "token", "left_semi").groupBy("token").count().collect()}


def index_rules(rules: list[Rule], counts: dict[str, int]) -> tuple[dict[str, list[Rule]], list[Rule]]:
    """Rules by their rarest token, and those without a token."""
    filed: dict[str, list[Rule]] = {}
    loose = []
    for r in rules:
        if r.tokens:
            filed.setdefault(min(r.tokens, key=lambda t: (counts.get(t, 0), t)), []).append(r)
        else:
            loose.append(r)
    return filed, loose


def order_of(rule: Rule) -> tuple:
    """Longer rules decide; of one length the blocking one, then the later in the alphabet."""
    return rule.weight, rule.verdict, rule.host, rule.path


def judge(host: str, path: str, filed: dict, loose: list, compiled: dict) -> Rule | None:
    """The matching rule that decides. Only rules fetched by the url's tokens run, host and path apart."""
    fetched = {r for t in set(URL_TOKEN.findall(f"{host}\x00{path}")) for r in filed.get(t, ())}
    best = None
    for r in [*fetched, *loose]:
        if best is None or order_of(r) > order_of(best):
            in_host, in_path = compiled[r]
            if in_host.search(host) and in_path.match(path):
                best = r
    return best


def filter_urls(pages: DataFrame, rules: list[Rule], id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """page_id, host, path, rule, verdict of every row. A list of more than MOST_RULES rules takes a pass for each part of it."""
    host, path = url_parts(F.col(url_col))
    urls = pages.select(F.col(id_col).alias("page_id"), host.alias("host"), path.alias("path"))
    counts = token_counts(urls, rules)
    kind = urls.schema["page_id"].dataType.simpleString()
    judged = urls.withColumn("rule", F.lit(None).cast("string")).withColumn("verdict", F.lit("allow")).withColumn("weight", F.lit(-2))
    ordered = sorted(set(rules), key=order_of)  # of equal weight the later part decides
    for at in range(0, len(ordered), MOST_RULES):
        filed, loose = index_rules(ordered[at : at + MOST_RULES], counts)

        def apply(batches: Iterator[pd.DataFrame], filed: dict = filed, loose: list = loose) -> Iterator[pd.DataFrame]:
            compiled = {r: (re.compile(r.host), re.compile(r.path)) for r in [*loose, *(r for rs in filed.values() for r in rs)]}
            for batch in batches:
                found = [judge(h, p, filed, loose, compiled) for h, p in zip(batch["host"], batch["path"], strict=True)]
                rows = zip(batch["rule"], batch["verdict"], batch["weight"], strict=True)
                now = [old if r is None or r.weight < old[2] else (r.name, r.verdict, r.weight) for old, r in zip(rows, found, strict=True)]
                yield batch.assign(rule=[x[0] for x in now], verdict=[x[1] for x in now], weight=[x[2] for x in now])

        judged = judged.mapInPandas(apply, f"page_id {kind}, host string, path string, rule string, verdict string, weight int")
    return judged.drop("weight")


def op7_url_filters(spark, sf_dir: str) -> DataFrame:
    """Every page's verdict."""
    return filter_urls(table(spark, sf_dir, "pages"), CONTRACT_RULES + OWN_RULES)


ORACLE_SQL = r"""
WITH u AS (
  SELECT page_id, translate(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    regexp_extract(coalesce(url, ''), '(?s)^.*?://[^/?#]*([^?#]*)', 1) AS path
  FROM pages
), rules(host_end, start, verdict) AS (
  VALUES ('org', '/', 'allow'), ('example.org', '/es/', 'block'), ('example.org', '/en/1', 'block'), ('com', '/fr/', 'allow'), ('com', '/de/', 'block')
), judged AS (
  SELECT page_id, host, path,
    (SELECT max_by({'rule': host_end || start, 'verdict': r.verdict}, length(host_end || start)) FROM rules r
     WHERE (u.host = host_end OR ends_with(u.host, '.' || host_end)) AND starts_with(u.path, start)) AS best
  FROM u
)
SELECT page_id, host, path, best.rule AS rule,
  coalesce(best.verdict, CASE WHEN regexp_matches(host, '(^|[.-])(spam|spam-farm|casino|porn|xxx|adult|betting|warez|malware|phishing|doubleclick|adserver|clickbait|torrent)([.-]|$)') THEN 'block' ELSE 'allow' END) AS verdict
FROM judged
"""

QUERIES = {"op7_url_filters": op7_url_filters}
SQL = {"op7_url_filters": ORACLE_SQL}
