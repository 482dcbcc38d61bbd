"""Scalar expressions shared by the operators."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def ratio(a: Column, b: Column, otherwise: float | None = 0.0) -> Column:
    """a / b where b isn't 0, else a constant; division by zero is an error otherwise."""
    return F.when(b != 0, a / b).otherwise(F.lit(otherwise).cast("double"))


def sigmoid(x: Column) -> Column:
    return 1 / (1 + F.exp(-x))


def softplus(x: Column) -> Column:
    """log(1 + e^x) without overflow."""
    return F.greatest(x, F.lit(0.0)) + F.log1p(F.exp(-F.abs(x)))


def improvement(before: Column, after: Column) -> Column:
    """Percentage by which ``after`` is below ``before``; 0 where before isn't positive."""
    return F.when(before > 0, (1 - after / before) * 100).otherwise(F.lit(0.0))


def finite_or_zero(w: Column) -> Column:
    return F.when(F.isnan(w) | (F.abs(w) == float("inf")), F.lit(0.0)).otherwise(w)


def hash_key(seed: int | str, *parts: Column) -> Column:
    """md5 of a seed and keys: the order it gives is a permutation any engine can rebuild."""
    return F.md5(F.concat_ws("|", F.lit(str(seed)), *[p.cast("string") for p in parts]))


def hash_uniform(seed: int | str, *parts: Column) -> Column:
    """A number in [0, 1) from the first 32 bits of ``hash_key``."""
    return F.conv(F.substring(hash_key(seed, *parts), 1, 8), 16, 10).cast("double") / 4294967296.0


def hash_integer(n: int | Column, seed: int | str, *parts: Column) -> Column:
    """A number in 0..n-1 from 48 bits of ``hash_key``."""
    return F.conv(F.substring(hash_key(seed, *parts), 1, 12), 16, 10).cast("bigint") % n


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def product(values: Column) -> Column:
    return F.aggregate(values, F.lit(1.0), lambda s, x: s * x)


def short_hash(text: Column) -> Column:
    """First 16 hex digits of a SHA-256."""
    return F.substring(F.sha2(text.cast("binary"), 256), 1, 16)


def fixed_point(c: Column, digits: int) -> Column:
    """A number as text with a fixed number of digits and no grouping."""
    return F.format_string(f"%.{digits}f", c.cast("double"))


def run_stamp(ts: Column) -> Column:
    """A moment as a folder name: date, T, time to the second, Z."""
    return F.date_format(F.to_utc_timestamp(ts, F.current_timezone()), "yyyy-MM-dd'T'HHmmss'Z'")


def merged(first: Column, second: Column) -> Column:
    """Two maps as one; the second's values win."""
    return F.map_concat(F.map_filter(first, lambda k, v: ~F.array_contains(F.map_keys(second), k)), second)
