"""Record contracts: named rules turned into one boolean column each."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def range_rules(limits: dict[str, tuple]) -> dict[str, Column]:
    """One rule per column: the value lies within the limits, both included."""
    return {f"{c}_ok": F.col(c).between(low, high) for c, (low, high) in limits.items()}


def number_rule(column: str, minimum=None) -> Column:
    number = F.col(column).try_cast("double")
    return number.isNotNull() if minimum is None else number >= minimum


def date_rule(column: str) -> Column:
    return F.col(column).rlike("^[0-9]{4}-[0-9]{2}-[0-9]{2}$") & F.try_to_date(column, "yyyy-MM-dd").isNotNull()


def pattern_rule(column: str, pattern: str) -> Column:
    return F.col(column).rlike(pattern)


def check_rules(df: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """Add each rule as a column (null counts as broken) and ``accepted`` when all hold."""
    flagged = df.withColumns({n: F.coalesce(r, F.lit(False)) for n, r in rules.items()})
    every = F.lit(True)
    for n in rules:
        every = every & F.col(n)
    return flagged.withColumn("accepted", every)
