"""Column profiles and the health score of a table."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablemill.functions import dates
from tablemill.functions.names import date_columns, non_numeric_columns, numeric_columns, text_columns
from tablemill.plans.prepare import capped_counts, distinct_counts, nan_to_null


def _as_rows(row: DataFrame, names: Sequence[str], label: str = "column") -> DataFrame:
    """One-row frame of structs -> one row per struct."""
    return row.select(F.explode(F.array(*[F.struct(F.lit(c).alias(label), F.col(f"`{c}`").alias("s")) for c in names])).alias("r")).select(
        f"r.{label}", "r.s.*")


def day_order(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """How many cells read as day-first and as month-first; day-first wins only with strictly more."""
    row = df.agg(*[F.struct(F.count_if(dates.is_dayfirst(F.col(c))).alias("dayfirst"),
                            F.count_if(dates.is_monthfirst(F.col(c))).alias("monthfirst")).alias(c) for c in columns])
    return _as_rows(row, columns).withColumn("is_dayfirst", F.col("dayfirst") > F.col("monthfirst"))


def date_like(df: DataFrame) -> DataFrame:
    """Whether each text or numeric column can be read as dates.

    Text must parse in full.  Numbers count as nanoseconds since 1970 and need a range of more
    than a day that starts after 1970-01-01.
    """
    checks = []
    for c in text_columns(df):
        checks.append((F.count(F.when(F.col(c).isNotNull() & dates.parse_date(F.col(c)).isNull(), 1)) == 0).alias(c))
    for c in numeric_columns(df):
        checks.append(dates.is_nanoseconds(F.col(c)).alias(c))
    names = [*text_columns(df), *numeric_columns(df)]
    return df.agg(*checks).unpivot([], names, "column", "is_date")


def column_profile(df: DataFrame) -> DataFrame:
    """Rows, nulls and distinct values of every column: ``(column, kind, n_rows, n_null, n_distinct)``."""
    numeric, dated = set(numeric_columns(df)), set(date_columns(df))
    kinds = {c: "numeric" if c in numeric else "date" if c in dated else "other" for c in df.columns}
    df = nan_to_null(df)
    row = df.agg(*[F.struct(
        F.lit(kinds[c]).alias("kind"), F.count(F.lit(1)).alias("n_rows"),
        (F.count(F.lit(1)) - F.count(f"`{c}`")).alias("n_null")).alias(c) for c in df.columns])
    distinct = distinct_counts(df, df.columns).withColumnRenamed("n", "n_distinct")
    return _as_rows(row, df.columns).join(distinct, "column")


# Score table of the row-count part.
ROW_STEPS = [(7_500, 70.0), (15_000, 90.0)]
FULL_SCORE = 100.0
# Score by number of non-numeric columns with more than 100 distinct values.
BLOWOUT_SCORES = {0: 100.0, 1: 50.0, 2: 25.0}
MANY_VALUES = 100


def health_score(df: DataFrame) -> DataFrame:
    """One row: the four part scores and their mean."""
    n_columns, others = len(df.columns), non_numeric_columns(df)
    n_numeric = n_columns - len(others)
    df = nan_to_null(df)
    blown = capped_counts(df, others, MANY_VALUES).agg(F.count_if(F.col("n") > MANY_VALUES)).scalar()
    profile = df.agg(
        F.count(F.lit(1)).alias("n_rows"),
        sum((F.count(F.lit(1)) - F.count(f"`{c}`") for c in df.columns), F.lit(0)).alias("n_null")).withColumn("n_blown", blown)
    rows = F.col("n_rows")
    row_score = F.when(rows <= 1000, rows / 20)
    for limit, score in ROW_STEPS:
        row_score = row_score.when(rows < limit, score)
    blow_score = None
    for n, score in BLOWOUT_SCORES.items():
        blow_score = F.when(F.col("n_blown") == n, score) if blow_score is None else blow_score.when(F.col("n_blown") == n, score)
    parts = profile.select(
        "n_rows", "n_null", "n_blown",
        (100 * (1 - F.col("n_null") / (rows * n_columns))).alias("sparsity"),
        row_score.otherwise(FULL_SCORE).alias("row_count"),
        F.lit((min(100.0, 20.0 * n_numeric) + min(100.0, 20.0 * len(others))) / 2).alias("type_mix"),
        blow_score.otherwise(0.0).alias("blowout"))
    score = (F.col("sparsity") + F.col("row_count") + F.col("type_mix") + F.col("blowout")) / 4
    return parts.withColumn("health", score)


def recommendations(df: DataFrame, null_share: float = 0.02) -> DataFrame:
    """Advice per part as rows ``(part, message, column, value)``.

    The published list is always empty because it is cleared after each part; the rows below are
    what its dictionary carries.
    """
    profile = column_profile(df)
    n_numeric, n_other = len(numeric_columns(df)), len(non_numeric_columns(df))
    score = health_score(df)
    text, number = "cast(null as string)", "double"
    share = F.col("n_null") / F.col("n_rows")
    sparse = profile.filter(share > null_share).select(
        F.lit("sparsity").alias("part"), F.lit("many nulls").alias("message"), "column", share.alias("value"))
    few_rows = score.filter("row_count < 100").select(
        F.lit("row_count").alias("part"), F.lit("add rows").alias("message"), F.expr(text).alias("column"), F.col("n_rows").cast(number).alias("value"))
    out = sparse.unionByName(few_rows)
    for kind, n in (("numeric", n_numeric), ("categorical", n_other)):
        if n < 5:
            out = out.unionByName(score.select(
                F.lit("type_mix").alias("part"), F.lit(f"add {kind} fields").alias("message"),
                F.expr(text).alias("column"), F.lit(float(n)).alias("value")))
    blown = profile.filter((F.col("kind") != "numeric") & (F.col("n_distinct") > MANY_VALUES)).select(
        F.lit("blowout").alias("part"), F.lit("too many unique values").alias("message"), "column", F.col("n_distinct").cast(number).alias("value"))
    return out.unionByName(blown)
