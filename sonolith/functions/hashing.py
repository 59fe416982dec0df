"""Hash layouts and time conversions as expressions."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def _long(c: Column) -> Column:
    return c.cast("bigint")


def pack22(f1: Column, f2: Column, dt: Column) -> Column:
    """22 bits, 22 bits and 20 bits."""
    return F.shiftleft(_long(f1), 42).bitwiseOR(F.shiftleft(_long(f2), 20)).bitwiseOR(_long(dt))


def pack16(f1: Column, f2: Column, dt: Column) -> Column:
    """Three fields of 16 bits above 16 free ones."""
    return F.shiftleft(_long(f1), 48).bitwiseOR(F.shiftleft(_long(f2), 32)).bitwiseOR(F.shiftleft(_long(dt), 16))


def pack16q(f1: Column, f2: Column, dt: Column) -> Column:
    """pack16 of halved values."""
    half = lambda c: F.floor(c / 2)
    return pack16(half(f1), half(f2), half(dt))


def frame_to_ms(t: Column, hop: int = 2048, rate: int = 44100) -> Column:
    """Whole milliseconds at a frame's start, cut off: a step of one frame is 46 or 47."""
    return F.floor(_long(t) * (hop * 1000) / rate).cast("bigint")


def quad_bin(f: Column) -> Column:
    """A bin of 2048 on a scale of 1024, within 0..1023."""
    return F.least(F.greatest(F.floor(f / 2), F.lit(0)), F.lit(1023)).cast("bigint")


def quad_delta(d: Column) -> Column:
    return F.least(F.greatest(_long(d), F.lit(0)), F.lit(65535)).cast("bigint")


def big_endian16(*values: Column) -> Column:
    """The values as two big-endian bytes each."""
    return F.unhex(F.concat(*(F.lpad(F.hex(v), 4, "0") for v in values)))


def quad64(*values: Column) -> Column:
    """Spark's xxHash64 (seed 42) of the 14 bytes; see xxhash64_seeded for other seeds."""
    return F.xxhash64(big_endian16(*values))


def xxhash64_seeded(data: Column, seed: int = 0) -> Column:
    """xxHash64 of binary values with any seed, as a signed 64-bit integer."""
    def run(values: pd.Series) -> pd.Series:
        import xxhash

        return pd.Series([None if v is None else int.from_bytes(xxhash.xxh64_digest(bytes(v), seed), "big", signed=True) for v in values], dtype="Int64")

    return F.pandas_udf(run, "bigint")(data)


def hash_hex(h: Column) -> Column:
    """16 hex characters of a 64-bit key."""
    return F.lower(F.lpad(F.hex(h), 16, "0"))


def hash_of_hex(text: Column) -> Column:
    """The key of 16 hex characters; null for anything else. conv() reads unsigned values, the cast folds them."""
    ok = text.rlike("^[0-9a-fA-F]{16}$")
    high, low = F.conv(F.substring(text, 1, 8), 16, 10).cast("bigint"), F.conv(F.substring(text, 9, 8), 16, 10).cast("bigint")
    return F.when(ok, F.shiftleft(high, 32).bitwiseOR(low))


def offset_seconds(offset: Column, hop: int, rate: int) -> Column:
    return _long(offset) * hop / F.lit(float(rate))
