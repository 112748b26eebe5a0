"""Similarity keys from features, as column expressions.  Features are unsigned; as longs they are ordered
by their decimal form with leading zeros."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def unsigned(value: Column) -> Column:
    """20 digits of the unsigned value of a long."""
    return F.lpad(F.conv(F.hex(value), 16, 10), 20, "0")


def digest(values: Column) -> Column:
    """A key of several features: equal if and only if they are (up to collisions of 128 bits)."""
    return F.md5(F.array_join(F.transform(values, lambda x: x.cast("string")), ",").cast("binary"))


def xxh64(values: Column) -> Column:
    """XXH64 with seed 42 of the bytes of several longs, each as eight bytes, the lowest first."""

    def low_first(x: Column) -> Column:
        digits = F.lpad(F.hex(x), 16, "0")
        return F.array_join(F.transform(F.sequence(F.lit(0), F.lit(7)), lambda k: F.substr(digits, F.lit(15) - k * 2, F.lit(2))), "")

    return F.xxhash64(F.unhex(F.array_join(F.transform(values, low_first), "")))


def super_features(features: Column, per: int = 4, sort: bool = False, key: Callable[[Column], Column] = digest) -> Column:
    """Keys of each run of ``per`` features, in their own order or (``sort``) after all features are put in ascending order;
    with one feature each, the features themselves are the keys."""
    if sort:
        features = F.transform(F.array_sort(F.transform(features, lambda x: F.struct(unsigned(x).alias("digits"), x.alias("x")))), lambda s: s["x"])
    if per == 1:
        return F.transform(features, unsigned)
    return F.transform(F.sequence(F.lit(0), F.lit(12 // per - 1)), lambda i: key(F.slice(features, i * per + 1, per)))


def random_id(seed: int | None = None) -> Column:
    """A random UUID for each row; with a seed, the same ones again for the same partitions."""
    return F.uuid() if seed is None else F.uuid(F.lit(seed))


def strided_super_features(features: Column, sort: bool = False) -> Column:
    """Keys of every third feature from the first, second and third on; with ``sort``, each three
    consecutive features are put in order first."""
    if sort:
        features = F.flatten(F.transform(F.sequence(F.lit(0), F.lit(3)), lambda k: F.array_sort(F.slice(features, k * 3 + 1, 3))))
    return F.transform(F.sequence(F.lit(0), F.lit(2)), lambda i: digest(F.transform(F.sequence(F.lit(0), F.lit(3)), lambda j: F.get(features, j * 3 + i))))


def sorted_features(features: Column) -> Column:
    """Features in ascending unsigned order, as 20 digits each."""
    return F.array_sort(F.transform(features, unsigned))


def hierarchy(features: Column) -> Column:
    """(a: the largest feature, b: key of the next three, c: key of the eight smallest)."""
    s = sorted_features(features)

    def key(values: Column) -> Column:
        return F.md5(F.array_join(values, ",").cast("binary"))

    return F.struct(F.element_at(s, 12).alias("a"), key(F.slice(s, 9, 3)).alias("b"), key(F.slice(s, 1, 8)).alias("c"))
