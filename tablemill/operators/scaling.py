"""Scaling, splitting and key-fixed random numbers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _hash32(key: Column, seed: int) -> Column:
    digest = F.md5(F.concat(key.cast("string"), F.lit(f"-{seed}")))
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("bigint")


def uniform_of(key: Column, seed: int) -> Column:
    """Number in [0, 1) fixed by key and seed, whatever the partitioning."""
    return _hash32(key, seed).cast("double") / F.lit(4294967296)


def normal_of(key: Column, seed: int) -> Column:
    """Standard normal number from two fixed uniform ones."""
    u, v = uniform_of(key, seed), uniform_of(key, seed + 1)
    return F.sqrt(-2 * F.log(1 - u)) * F.cos(2 * F.pi() * v)


def train_test_split(df: DataFrame, key: str, percent: int, seed: int) -> DataFrame:
    """Add ``test``: true for about ``percent`` of the rows, fixed by key and seed."""
    return df.withColumn("test", _hash32(F.col(key), seed) % 100 < percent)


def standardize(df: DataFrame, value: str, name: str) -> DataFrame:
    """(x - mean) / sample standard deviation; both are scalar subqueries."""
    fitted = df.agg(F.avg(value).alias("m"), F.stddev_samp(value).alias("s"))
    return df.withColumn(name, (F.col(value) - fitted.select("m").scalar()) / fitted.select("s").scalar())


def min_max_scale(df: DataFrame, value: str, name: str, fit_on: Column | None = None) -> DataFrame:
    """(x - minimum) / range with constants taken from the rows where ``fit_on`` holds."""
    base = df if fit_on is None else df.filter(fit_on)
    fitted = base.agg(F.min(value).alias("lo"), F.max(value).alias("hi"))
    low, high = fitted.select("lo").scalar(), fitted.select("hi").scalar()
    return df.withColumn(name, (F.col(value) - low) / (high - low))
