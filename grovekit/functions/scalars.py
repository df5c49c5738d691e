"""Column expressions: extractors, hashes, logs, scaling. All stay inside code generation."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_WRAP = 1 << 32


def wrap32(c: Column) -> Column:
    """A bigint as a signed 32-bit integer that overflowed."""
    low = F.pmod(c, F.lit(_WRAP))
    return F.when(low >= (1 << 31), low - _WRAP).otherwise(low)


def string_hash(c: Column) -> Column:
    """31-multiplier hash over UTF-16 code units, in 32 bits; '' gives 0, null gives null."""
    raw = F.encode(c, "UTF-16BE")
    unit = lambda i: F.conv(F.hex(F.substring(raw, i * 2 - 1, 2)), 16, 10).cast("long")
    n = (F.length(raw) / 2).cast("int")
    codes = F.when(n > 0, F.transform(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), unit)).otherwise(F.array().cast("array<bigint>"))
    return F.when(c.isNotNull(), F.aggregate(codes, F.lit(0).cast("long"), lambda h, x: wrap32(h * 31 + x))).cast("int")


def md5_fold(c: Column) -> Column:
    """The 16 signed bytes of the MD5 folded with multiplier 31 from 1, in 32 bits."""
    byte = lambda i: F.conv(F.substring(F.md5(c.cast("binary")), i * 2 - 1, 2), 16, 10).cast("long")
    signed = lambda b: F.when(b > 127, b - 256).otherwise(b)
    return F.when(c.isNotNull(), F.aggregate(F.transform(F.sequence(F.lit(1), F.lit(16)), byte), F.lit(1).cast("long"), lambda h, b: wrap32(h * 31 + signed(b)))).cast("int")


def extract(c: Column) -> Column:
    """A text field as a number: '' is 0, a numeric text its value, anything else its MD5 fold."""
    number = F.when(c.rlike("^[0-9+-]"), c.try_cast("double"))
    return F.when(c.isNull() | (c == ""), F.lit(0.0)).otherwise(F.coalesce(number, md5_fold(c).cast("double")))


def log10(c: Column) -> Column:
    """-Infinity for 0 and NaN below, where Spark's own is null."""
    x = c.cast("double")
    return F.when(x == 0, F.lit(float("-inf"))).when(x < 0, F.lit(float("nan"))).otherwise(F.log10(x))


def signed_log(c: Column, low: float, high: float) -> Column:
    """Decimal log that keeps the sign (0 gives ``low``), clipped to [low, high] and scaled to [0, 1]."""
    x = c.cast("double")
    v = F.when(x == 0, F.lit(float(low))).when(x < 0, -F.log10(-x)).otherwise(F.log10(x))
    return (clip(v, low, high) - float(low)) / (float(high) - float(low))


def clip(c: Column, low: float, high: float) -> Column:
    low, high = min(low, high), max(low, high)
    return F.greatest(F.least(c, F.lit(high)), F.lit(low))


def min_max(c: Column, low: float, high: float) -> Column:
    return (clip(c.cast("double"), float(low), float(high)) - float(low)) / (float(high) - float(low))


def z_score(c: Column, mean: float, std: float) -> Column:
    return (c.cast("double") - float(mean)) / float(std)


def or_default(c: Column, kind: str, default: float | int | str) -> Column:
    """A text cell as a number, or the default where it is absent or not one."""
    return F.coalesce(c.try_cast(kind), F.lit(default).cast(kind))


def ordinal(c: Column, values: list[str]) -> Column:
    """Place of an enum value, -1 if it is not listed."""
    return F.coalesce(F.array_position(F.array(*map(F.lit, values)), c) - 1, F.lit(-1)).cast("long")


def epoch_seconds(c: Column, fmt: str) -> Column:
    """A date text in epoch seconds, -1 if it does not parse."""
    return F.coalesce(F.unix_micros(F.try_to_timestamp(c, F.lit(fmt))) / 1e6, F.lit(-1.0))


def sniff(c: Column) -> Column:
    """The kind of a cell, commas in numbers ignored: long, double or string."""
    bare = F.regexp_replace(c, ",", "")
    return F.when(bare.try_cast("long").isNotNull() & ~bare.contains("."), "long").when(bare.try_cast("double").isNotNull() & bare.contains("."), "double").otherwise("string")
