"""Matrices in long form: one row (i, j, v) per cell."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def elementwise(a: DataFrame, b: DataFrame) -> DataFrame:
    left, right = a.withColumnRenamed("v", "x"), b.withColumnRenamed("v", "y")
    x, y = F.col("x"), F.col("y")
    return left.join(right, ["i", "j"]).select("i", "j", (x + y).alias("added"), (x - y).alias("subtracted"),
                                              (x * y).alias("multiplied"), F.try_divide(x, y).alias("divided"))


def transpose(a: DataFrame) -> DataFrame:
    return a.select(F.col("j").alias("i"), F.col("i").alias("j"), "v")


def product(a: DataFrame, b: DataFrame) -> DataFrame:
    """Join on the inner index, then sum per cell; sums start before the shuffle."""
    left = a.select("i", F.col("j").alias("k"), F.col("v").alias("x"))
    right = b.select(F.col("i").alias("k"), "j", F.col("v").alias("y"))
    return left.join(right, "k").groupBy("i", "j").agg(F.sum(F.col("x") * F.col("y")).alias("v"))


def mask(a: DataFrame, keep: Column) -> DataFrame:
    return a.filter(keep)


def slice_rows(a: DataFrame, index: str, low=None, high=None) -> DataFrame:
    """Cells whose index lies between ``low`` and ``high``, both included."""
    if low is not None:
        a = a.filter(F.col(index) >= low)
    return a if high is None else a.filter(F.col(index) <= high)
