"""Exact rounding, number formats and keyed randomness as plain column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def field(name: str):
    """A function that takes a struct's field, for use inside array functions."""
    return lambda x: x[name]


def let(value: Column, f) -> Column:
    """f of a value that is computed once, however often f uses it."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def tenths(value: Column) -> Column:
    """10 * value rounded half to even on the exact binary value, as a double.

    The double next to 10v lies on the same side of a tie as 10v unless it is the tie itself. Only then the error of the product
    counts: 10v is 8v + 2v, both exact, and TwoSum gives what their sum lost.
    """
    v = value.cast("double")
    s = v * F.lit(10.0)
    eight = v * F.lit(8.0)
    t = s - eight
    error = (eight - (s - t)) + (v * F.lit(2.0) - t)
    tie = F.when(error > 0, F.ceil(s).cast("double")).when(error < 0, F.floor(s).cast("double")).otherwise(F.rint(s))
    return F.when(s - F.floor(s) == 0.5, tie).otherwise(F.rint(s))


def round1(value: Column) -> Column:
    return tenths(value) / F.lit(10.0)


def _written(value: Column, t: Column) -> Column:
    """value as text, given its tenths as a whole number without sign."""
    rest = F.when(t % 10 > 0, F.concat(F.lit("."), (t % 10).cast("string"))).otherwise(F.lit(""))
    return F.when(value >= 100, F.rint(value).cast("bigint").cast("string")).otherwise(F.concat(F.when(value < 0, F.lit("-")).otherwise(F.lit("")), F.floor(t / 10).cast("string"), rest))


def fmt(value: Column) -> Column:
    """No decimals from 100 on, else one decimal without a trailing zero."""
    return _written(value, F.abs(tenths(value)).cast("bigint"))


def fmt_all(values: Column) -> Column:
    """fmt of each element of an array of doubles."""
    pairs = F.transform(values, lambda v: F.struct(v.alias("v"), F.abs(tenths(v)).cast("bigint").alias("t")))
    return F.transform(pairs, lambda p: _written(p["v"], p["t"]))


def printed(value: Column) -> Column:
    """The number that a reader of fmt(value) recovers, without going through text."""
    return F.when(value >= 100, F.rint(value)).otherwise(round1(value))


def _written_plain(value: Column, t: Column) -> Column:
    return F.when(value == F.floor(value), value.cast("bigint").cast("string")).otherwise(F.concat(F.floor(t / 10).cast("string"), F.lit("."), F.pmod(t, F.lit(10)).cast("string")))


def fmt_plain(value: Column) -> Column:
    """An integer where the value is whole, else one decimal."""
    return _written_plain(value, tenths(value).cast("bigint"))


def fmt_plain_all(values: Column) -> Column:
    """fmt_plain of each element of an array of doubles."""
    pairs = F.transform(values, lambda v: F.struct(v.alias("v"), tenths(v).cast("bigint").alias("t")))
    return F.transform(pairs, lambda p: _written_plain(p["v"], p["t"]))


def percent(value: Column) -> Column:
    """One decimal of 100 * value, empty for null."""
    t = tenths(value * F.lit(100.0)).cast("bigint")
    return F.coalesce(F.concat(F.floor(t / 10).cast("string"), F.lit("."), F.pmod(t, F.lit(10)).cast("string")), F.lit(""))


def unit(key: Column) -> Column:
    """A number in 0..1 from the first 32 bits of the key's SHA-256; the same in every engine and partitioning."""
    return F.conv(F.substring(F.sha2(F.encode(key, "UTF-8"), 256), 1, 8), 16, 10).cast("double") / F.lit(4294967295.0)


def draw(*parts: Column | str | int) -> Column:
    """A number in [0, 1) keyed by the parts: reproducible under any partitioning, unlike rand()."""
    key = F.concat_ws("/", *(p if isinstance(p, Column) else F.lit(str(p)) for p in parts))
    return F.conv(F.substring(F.sha2(F.encode(key, "UTF-8"), 256), 1, 12), 16, 10).cast("double") / F.lit(float(16**12))


def choose(options: list, at: Column) -> Column:
    """The option that a number in [0, 1) falls on."""
    return F.element_at(F.array(*(o if isinstance(o, Column) else F.lit(o) for o in options)), (F.floor(at * len(options)) + 1).cast("int"))


def to_number(text: Column) -> Column:
    """A finite or infinite double, null for what isn't one; spaces around and underscores between digits are allowed."""
    bare = F.regexp_replace(F.regexp_replace(text, r"^[\s ]+|[\s ]+$", ""), r"(?<=[0-9])_(?=[0-9])", "")
    ok = bare.rlike(r"^(?i:[+-]?(?:(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:e[+-]?[0-9]+)?|inf|infinity))$")
    named = F.lower(F.regexp_replace(bare, r"^[+-]", ""))
    return F.when(ok & named.isin("inf", "infinity"), F.when(bare.startswith("-"), F.lit(float("-inf"))).otherwise(F.lit(float("inf")))).when(ok, bare.try_cast("double"))


def strip(text: Column) -> Column:
    """Without white space of any kind at both ends."""
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def wilson_lower(hits: Column, n: Column, z: float = 1.959964) -> Column:
    """Lower end of the Wilson interval, 0 for no rows and never below 0."""
    h, m = hits.cast("double"), n.cast("double")
    p = h / m
    zz = F.lit(z * z)
    middle = p + zz / (m * F.lit(2.0))
    spread = F.lit(z) * F.sqrt((p * (F.lit(1.0) - p) + zz / (m * F.lit(4.0))) / m)
    return F.when(n <= 0, F.lit(0.0)).otherwise(F.greatest(F.lit(0.0), (middle - spread) / (F.lit(1.0) + zz / m)))
