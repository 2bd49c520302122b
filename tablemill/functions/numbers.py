"""Numeric column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def money(column: Column | str) -> Column:
    """Exact two-decimal amount; sums of it do not depend on row order."""
    return (F.col(column) if isinstance(column, str) else column).cast("decimal(18,2)")


def total(column: Column | str) -> Column:
    """Exact sum of an amount as double."""
    return F.sum(money(column)).cast("double")


def guard_divisor(column: Column) -> Column:
    """Null and zero divisors become 1."""
    return F.when(column.isNull() | (column == 0), F.lit(1).cast("double")).otherwise(column)


def fahrenheit(celsius: Column) -> Column:
    return celsius * 9 / 5 + 32


# Unit factors used by the conversions below.
INCHES_PER_CM = 0.39370
POUNDS_PER_KG = 2.20462


def inches(cm: Column) -> Column:
    return cm * INCHES_PER_CM


def pounds(kg: Column) -> Column:
    return kg * POUNDS_PER_KG


def body_mass_index(weight: Column, height: Column) -> Column:
    return weight / (height * height)


def win_rate(wins: Column, games: Column) -> Column:
    """Share of games won, two decimals, half to even."""
    return F.bround(wins / games, 2)


def expected_win_rate(scored: Column, allowed: Column) -> Column:
    return F.bround(scored * scored / (scored * scored + allowed * allowed), 2)


def row_sum(*columns: str) -> Column:
    """Sum across columns of one row; null if any part is null."""
    out = F.col(columns[0])
    for c in columns[1:]:
        out = out + F.col(c)
    return out
