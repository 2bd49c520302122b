"""Top-k, places, seeded samples and keep-first."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tablemill.operators.ordered import positions


def top_per_group(df: DataFrame, keys: Sequence[str], order: Sequence[Column], k: int) -> DataFrame:
    """The first ``k`` rows per key.  Spark cuts to ``k`` per task before the shuffle."""
    ranked = df.withColumn("__rn", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
    return ranked.filter(F.col("__rn") <= k).drop("__rn")


def keep_first(df: DataFrame, keys: Sequence[str], order: str, long_text: bool = False) -> DataFrame:
    """One row per key, the first in ``order``.

    With ``long_text`` rows are compared by a 256-bit digest of their keys, so whole texts are
    neither sorted nor used to place rows.
    """
    if not long_text:
        return top_per_group(df, keys, [F.col(order)], 1)
    # null and length marks keep different key lists apart
    marked = [F.coalesce(F.concat(F.length(F.col(k).cast("string")).cast("string"), F.lit(":"), F.col(k).cast("string")), F.lit("-")) for k in keys]
    digest = F.sha2(F.concat(*marked), 256)
    return top_per_group(df.withColumn("__digest", digest), ["__digest"], [F.col(order)], 1).drop("__digest")


def top_and_bottom(df: DataFrame, measure: str, key: str, n: int) -> DataFrame:
    top = df.orderBy(F.desc(measure), key).limit(n).select(F.lit("top").alias("part"), "*")
    bottom = df.orderBy(measure, key).limit(n).select(F.lit("bottom").alias("part"), "*")
    return top.unionByName(bottom)


def seeded_sample(df: DataFrame, key: str, n: int, seed: int) -> DataFrame:
    """``n`` rows that look random but are fixed by the key and the seed, however the rows are spread."""
    return df.orderBy(F.md5(F.concat(F.col(key).cast("string"), F.lit(f"-{seed}"))), key).limit(n)


def places(df: DataFrame, order: Sequence[Column], coarse: Sequence[str], fine: str, name: str = "place") -> DataFrame:
    """Global place when the leading sort columns have few distinct values.

    The place is the number of rows in earlier groups of ``coarse`` plus the place inside the
    group, which is counted in ranges of the numeric column ``fine``.
    """
    sizes = df.groupBy(*coarse).agg(F.count(F.lit(1)).alias("__n"))
    # one row per group of the coarse columns
    earlier = Window.orderBy(*order[:len(coarse)]).rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select(*coarse, F.coalesce(F.sum("__n").over(earlier), F.lit(0)).alias("__start"))
    inside = positions(df, order[len(coarse):], on=fine, keys=coarse, name="__pos")
    return inside.join(starts, list(coarse)).withColumn(name, F.col("__start") + F.col("__pos")).drop("__start", "__pos")
