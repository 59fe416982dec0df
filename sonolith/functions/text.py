"""Text, path and identifier expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed format: 22 characters of base 62.
BASE62_ID = "[0-9A-Za-z]{22}"
#: The scheme of identifiers and the end of a link's host.
SCHEME, HOST = "spotify", "spotify.com"


def normalise(text: Column) -> Column:
    """Lower case, everything but a-z, 0-9 and spaces as a space, single spaces."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(text), "[^a-z0-9 ]+", " "), " +", " "))


def token_overlap(expected: Column, candidate: Column) -> Column:
    """The share of expected tokens (with repeats) among the candidate's, to three decimals.

    Expected tokens are looked for in the distinct tokens that both have: array_intersect hashes them, so a long
    candidate is read once and not for every token.
    """
    tokens = lambda x: F.array_remove(F.split(normalise(x), " "), "")

    def share(held: Column) -> Column:
        a = held["a"]
        return F.when(F.size(a) > 0, F.round(F.size(F.filter(a, lambda x: F.array_contains(held["both"], x))) / F.size(a), 3)).otherwise(F.lit(0.0))

    def shared(held: Column) -> Column:
        return F.struct(held["a"].alias("a"), F.array_intersect(held["a"], held["b"]).alias("both"))

    # one element each: the lists are made once, not for every token
    both = F.transform(F.array(F.struct(tokens(expected).alias("a"), tokens(candidate).alias("b"))), shared)
    return F.element_at(F.transform(both, share), 1)


def tokens_match(expected: Column, candidate: Column, least: float = 0.6) -> Column:
    return token_overlap(expected, candidate) >= least


def path_metadata(path: Column) -> dict[str, Column]:
    """artist, album and title of a relative path: the last three parts, else Unknown twice and the base name."""
    parts = F.filter(F.split(path, "/"), lambda x: x != "")
    deep = F.size(parts) >= 3
    name = F.coalesce(F.try_element_at(parts, F.lit(-1)), F.lit(""))
    return {
        "artist": F.when(deep, F.try_element_at(parts, F.lit(-3))).otherwise("Unknown"),
        "album": F.when(deep, F.try_element_at(parts, F.lit(-2))).otherwise("Unknown"),
        "title": F.when(deep, F.regexp_replace(name, r"\.[^.]*$", "")).otherwise(name),
    }


def resolve_id(raw: Column, expected: str | None = None, host: str = HOST) -> Column:
    """struct(kind, id, reason): from a bare id, ``scheme:kind:id`` or a ``https://host/kind/id`` link on a host that ends in host."""
    raw = F.trim(raw)
    bare = F.regexp_extract(raw, f"^({BASE62_ID})$", 1)
    parts = F.split(raw, ":")
    is_uri, is_url = raw.startswith(f"{SCHEME}:"), raw.rlike("^https?://")
    steps = F.filter(F.split(F.regexp_extract(raw, r"^https?://[^/?#]*([^?#]*)", 1), "/"), lambda x: x != "")
    at_host = F.lower(F.regexp_extract(raw, r"^https?://(?:[^/?#@]*@)?([^/?#:@]*)", 1)).endswith(host)
    kind = F.when(is_uri, F.get(parts, F.lit(1))).when(is_url, F.get(steps, F.lit(0)))
    ident = F.when(bare != "", bare).when(is_uri, F.get(parts, F.lit(2))).when(is_url, F.get(steps, F.lit(1)))
    reason = F.when(is_url & ~at_host, F.lit("unsupported host")).when(~F.coalesce(ident.rlike(f"^{BASE62_ID}$"), F.lit(False)), F.lit("not an identifier"))
    if expected is not None:
        reason = reason.when((is_uri | is_url) & ~kind.eqNullSafe(F.lit(expected)), F.lit(f"not of kind {expected}"))
    kind = F.coalesce(kind, F.when(bare != "", F.lit(expected).cast("string")))
    return F.struct(F.when(reason.isNull(), kind).alias("kind"), F.when(reason.isNull(), ident).alias("id"), reason.alias("reason"))


def download_uri(ident: Column, uri: Column) -> Column:
    """The id if it is one, else a supported uri, else the last or second last path part that is an id."""
    parts = F.split(F.regexp_replace(uri, r"[?#].*$", ""), "[/:]")
    as_id = lambda x: F.when(x.rlike(f"^{BASE62_ID}$"), F.concat(F.lit("spotify:track:"), x))
    return F.coalesce(
        as_id(ident), F.when(uri.rlike(rf"^spotify:(track|album|episode|artist|playlist):{BASE62_ID}$"), uri),
        as_id(F.try_element_at(parts, F.lit(-1))), as_id(F.try_element_at(parts, F.lit(-2))),
    )


def seed_id(url: Column) -> Column:
    """What is between ``/artist/`` and the query string."""
    return F.nullif(F.regexp_extract(url, r"/artist/([^?]+)", 1), F.lit(""))


def clip_base(name: Column, suffix: str = "_clip30") -> Column:
    """A clip's file name without its extension and the suffix."""
    return F.regexp_replace(F.regexp_replace(name, r"\.[^.]*$", ""), f"{suffix}(?!.*{suffix})", "")


def or_unknown(text: Column) -> Column:
    return F.coalesce(F.nullif(F.trim(text), F.lit("")), F.lit("unknown"))


def safe_file_name(name: Column) -> Column:
    return F.regexp_replace(name, r"\s+", "_")


def picture_extension(mime: Column) -> Column:
    out = F.lit(".jpg")
    for kind in ("gif", "bmp", "webp", "png"):
        out = F.when(F.lower(mime).contains(kind), F.lit(f".{kind}")).otherwise(out)
    return out


def hms(seconds: Column) -> Column:
    s = seconds.cast("bigint")
    return F.format_string("%02d:%02d:%02d", F.floor(s / 3600), F.floor(s % 3600 / 60), s % 60)


def percent(done: Column, total: Column) -> Column:
    return F.when(total > 0, done * 100.0 / total).otherwise(F.lit(0.0))


def low_bitrate(bits_per_second: Column, wanted_kbps: int = 320) -> Column:
    """Whether the rate in kbit/s is under max(192, wanted - 32)."""
    return F.round(bits_per_second / 1000) < max(192, wanted_kbps - 32)


def decimal_seconds(text: Column) -> Column:
    """A duration with a decimal comma or point; 0 if it is none."""
    return F.coalesce(F.regexp_replace(text, ",", ".").try_cast("double"), F.lit(0.0))


def dynamic_text(data: Column, path: str) -> Column:
    """A string at a JSON path of a text column; empty for other types and broken JSON."""
    value = F.try_variant_get(F.try_parse_json(data), path, "variant")
    return F.when(F.coalesce(F.schema_of_variant(value) == "STRING", F.lit(False)), F.try_variant_get(value, "$", "string")).otherwise(F.lit(""))


def dynamic_number(data: Column, path: str) -> Column:
    """A number at a JSON path as a double; 0 for other types, a number in a string too."""
    value = F.try_variant_get(F.try_parse_json(data), path, "variant")
    number = F.coalesce(F.schema_of_variant(value).rlike("^(BIGINT|INT|SMALLINT|TINYINT|FLOAT|DOUBLE|DECIMAL)"), F.lit(False))
    return F.when(number, F.coalesce(F.try_variant_get(value, "$", "double"), F.lit(0.0))).otherwise(F.lit(0.0))
