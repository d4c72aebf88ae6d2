"""Helpers that the operators of this package share."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SPACES = "[\\x20\\x09-\\x0D]+"
WORD = "[^\\x20\\x09-\\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def words(text: Column) -> Column:
    """The words of a text as an array; null has none."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), SPACES), "")


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of ``value``, which is evaluated once a row however often the body
    uses it (an expression repeated inside a lambda would be evaluated per element)."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def grams(tokens: Column, n: int) -> Column:
    """64-bit hashes of the n-grams of ``tokens``: the hash of a stretch is that of the
    hashes of its two parts, so an n-gram takes about log2(n) steps for each place."""

    def tail(a: Column, k: int) -> Column:
        return F.slice(a, k + 1, F.greatest(F.size(a) - k, F.lit(0)))

    def joined(a: Column, b: Column, k: int) -> Column:
        """Hash of the stretch at i in ``a`` and the one at i + k in ``b``."""
        after = tail(b, k)
        return F.zip_with(F.slice(a, 1, F.least(F.size(a), F.size(after))), after, lambda x, y: F.xxhash64(x, y))

    def build(m: int, of: Column) -> Column:
        if m == 1:
            return of
        half = m // 2
        if m % 2 == 0:
            return let(build(half, of), lambda h: joined(h, h, half))
        return let(of, lambda one: joined(build(m - 1, one), one, m - 1))

    return let(F.transform(tokens, lambda t: F.xxhash64(t)), lambda h: build(n, h))
