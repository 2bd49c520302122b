"""Aggregations that need more than one grouped pass."""

from __future__ import annotations

from collections.abc import Sequence
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tablemill.operators.ordered import exact_quantiles, quantile_columns


def share_of_total(df: DataFrame, keys: Sequence[str], digits: int = 2) -> DataFrame:
    """Rows per key and their percentage of all rows; the total is one scalar subquery."""
    counted = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    whole = df.agg(F.count(F.lit(1))).scalar()
    return counted.withColumn("share", F.round(F.col("n") / whole * 100, digits))


def histogram(df: DataFrame, value: str, bins: int) -> DataFrame:
    """Counts in ``bins`` equal steps between minimum and maximum; the last step is closed."""
    ends = df.agg(F.struct(F.min(value).cast("double").alias("low"), F.max(value).cast("double").alias("high"))).scalar()
    low, high = ends["low"], ends["high"]
    step = (high - low) / bins
    place = F.least(F.floor((F.col(value) - low) / step), F.lit(bins - 1)).cast("int")
    counted = df.filter(F.col(value).isNotNull()).groupBy(place.alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    grid = df.sparkSession.range(bins).select(F.col("id").cast("int").alias("bin"))
    return grid.join(counted, "bin", "left").select(
        "bin", (low + F.col("bin") * step).alias("from_value"), F.coalesce("n", F.lit(0)).cast("bigint").alias("n"))


def describe(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Count, mean, std, min, quartiles and max, one row per column."""
    plain = df.agg(*[
        F.struct(F.count(c).alias("count"), F.avg(c).alias("mean"), F.stddev_samp(c).alias("std"),
                 F.min(c).cast("double").alias("min"), F.max(c).cast("double").alias("max")).alias(c)
        for c in columns])
    plain = plain.select(F.explode(F.array(*[
        F.struct(F.lit(c).alias("column"), F.col(c).alias("s")) for c in columns])).alias("r"))
    plain = plain.select("r.column", "r.s.*")
    long = df.select(F.explode(F.array(*[
        F.struct(F.lit(c).alias("column"), F.col(c).cast("double").alias("value")) for c in columns])).alias("r"))
    quartiles = quantile_columns(long.select("r.column", "r.value"), "value", {"q1": .25, "median": .5, "q3": .75}, ["column"])
    kinds = dict(df.dtypes)
    kind = F.create_map(*[x for c in columns for x in (F.lit(c), F.lit(kinds[c]))])
    return plain.join(F.broadcast(quartiles), "column", "left").withColumn("type", F.element_at(kind, F.col("column")))


def pair_moments(df: DataFrame, columns: Sequence[str]) -> dict[str, np.ndarray]:
    """Sums over the rows where both columns of a pair are known, for all pairs in one pass.

    ``n[i, j]`` counts them, ``s[i, j]`` and ``q[i, j]`` add up column i and its square, ``p[i, j]`` the
    product; values are taken less the column's ``mean``.  NaN counts as unknown.  A task reports a
    number per pair, and so many come to the driver, whatever the rows.
    """
    size = len(columns)
    plain = df.select(*[F.nanvl(F.col(f"`{c}`").cast("double"), F.lit(None).cast("double")).alias(f"c{i}") for i, c in enumerate(columns)])
    mean = np.array([v or 0.0 for v in plain.agg(*[F.avg(c).alias(c) for c in plain.columns]).first()], dtype=float)

    def sums(batches):
        total = np.zeros((4, size, size))
        for batch in batches:
            x = batch.to_numpy(dtype=float) - mean
            known = ~np.isnan(x)
            x = np.where(known, x, 0.0)
            k = known.astype(float)
            total += np.array([k.T @ k, x.T @ k, (x * x).T @ k, x.T @ x])
        i, j = np.indices((size, size))
        yield pd.DataFrame({"i": i.ravel(), "j": j.ravel(), **{f: total[m].ravel() for m, f in enumerate("nsqp")}})

    parts = plain.mapInPandas(sums, "i int, j int, n double, s double, q double, p double")
    out = {f: np.zeros((size, size)) for f in "nsqp"} | {"mean": mean}
    for row in parts.groupBy("i", "j").agg(*[F.sum(f).alias(f) for f in "nsqp"]).collect():
        for f in "nsqp":
            out[f][row["i"], row["j"]] = row[f]
    return out


def correlation_matrix(df: DataFrame, columns: Sequence[str]) -> np.ndarray:
    """Pearson correlations, each over the rows where both columns are known; NaN where one is constant there."""
    m = pair_moments(df, columns)
    with np.errstate(divide="ignore", invalid="ignore"):
        n = m["n"]
        spread = m["q"] - m["s"] ** 2 / n
        spread[spread <= 1e-12 * np.maximum(m["q"], 1e-300)] = np.nan
        return (m["p"] - m["s"] * m["s"].T / n) / np.sqrt(spread * spread.T)


def correlations(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Pearson correlation of all column pairs, long form."""
    found = correlation_matrix(df, columns)
    rows = [(a, b, None if np.isnan(found[i, j]) else float(found[i, j])) for (i, a), (j, b) in combinations(enumerate(columns), 2)]
    return df.sparkSession.createDataFrame(rows, "a string, b string, corr double")


def mode(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """Most frequent value per key; among equals the smallest."""
    counted = df.groupBy(*keys, value).agg(F.count(F.lit(1)).alias("n"))
    return counted.groupBy(*keys).agg(F.min(F.struct((-F.col("n")).alias("minus_n"), F.col(value).alias("value"))).alias("m")).select(
        *keys, F.col("m.value").alias("mode"), (-F.col("m.minus_n")).alias("n"))


def box_stats(df: DataFrame, key: str, value: str) -> DataFrame:
    """Quartiles, whiskers at 1.5 quartile ranges and outlier count per category."""
    quartiles = quantile_columns(df, value, {"q1": .25, "median": .5, "q3": .75}, [key])
    reach = 1.5 * (F.col("q3") - F.col("q1"))
    inside = F.col(value).between(F.col("q1") - reach, F.col("q3") + reach)
    # a row per category: Spark broadcasts it if it measures small, else it splits hot categories
    joined = df.select(key, value).join(quartiles, key)
    return joined.groupBy(key, "q1", "median", "q3").agg(
        F.min(F.when(inside, F.col(value))).alias("low_whisker"),
        F.max(F.when(inside, F.col(value))).alias("high_whisker"),
        F.sum(F.when(inside, 0).otherwise(1)).alias("n_outliers"))


def top_share_flag(df: DataFrame, measures: Sequence[str], share: float = 0.9) -> DataFrame:
    """Add ``<measure>_highlight``: 1 where the measure reaches its ``share`` quantile."""
    out = df
    for m in measures:
        bound = exact_quantiles(df, m, [share]).select("quantile").scalar()
        out = out.withColumn(f"{m}_highlight", F.when(F.col(m) >= bound, 1).otherwise(0))
    return out


def first_repeat(df: DataFrame, keys: Sequence[str], place: str, value: str) -> DataFrame:
    """Per key the value whose second occurrence comes first; null when nothing repeats."""
    by_value = Window.partitionBy(*keys, value).orderBy(place)
    second = df.select(*keys, place, value).withColumn("__rn", F.row_number().over(by_value)).filter("__rn <= 2")
    found = F.when(F.col("__rn") == 2, F.struct(F.col(place).alias("p"), F.col(value).alias("v")))
    return second.groupBy(*keys).agg(F.min(found)["v"].alias("first_repeat"))


def word_counts(text: DataFrame, words: Column, keys: Sequence[str] = ()) -> DataFrame:
    return text.select(*keys, F.explode(words).alias("word")).groupBy(*keys, "word").agg(F.count(F.lit(1)).alias("n"))
