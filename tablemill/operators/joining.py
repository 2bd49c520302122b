"""Join operators beyond a plain equi-join."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tablemill.operators.ordered import positions
from tablemill.session import stage


def blocks_for(rows: int, block_rows: int = 50_000) -> int:
    return max(1, -(-rows // block_rows))


def product(left: DataFrame, right: DataFrame, block_rows: int = 50_000) -> DataFrame:
    """Every row of ``left`` with every row of ``right``, laid out as a grid of blocks.

    Both sides are stored, counted and dealt into blocks of about ``block_rows`` rows, by their place in
    the stored files, so that equal rows are dealt apart as well.  A left row visits every right block and
    the other way round, so each grid cell is an equi-join of two blocks of known size and no cell grows
    with the tables.
    """
    left, right = stage(left, "product-left"), stage(right, "product-right")
    n_left, n_right = blocks_for(left.count(), block_rows), blocks_for(right.count(), block_rows)

    def dealt(df: DataFrame, blocks: int, own: str, other: str, others: int) -> DataFrame:
        mine = F.pmod(F.xxhash64("__place"), F.lit(blocks)).cast("int")
        # the place is fixed by the files, a repeated task deals its rows alike
        return df.withColumn("__place", F.monotonically_increasing_id()).withColumn(own, mine).drop("__place").withColumn(other, F.explode(F.sequence(F.lit(0), F.lit(others - 1))))

    a = dealt(left, n_left, "__left", "__right", n_right)
    b = dealt(right, n_right, "__right", "__left", n_left)
    return a.join(b, ["__left", "__right"]).drop("__left", "__right")


def latest_versions(df: DataFrame, keys: Sequence[str], version: Column, keep: Column) -> DataFrame:
    """Rows whose version is the highest of their key and which then pass ``keep``.

    Ties keep several rows.  ``keep`` is applied after the maximum, so a key whose latest row
    fails it disappears.  A null version or key part never matches.
    """
    known = df.withColumn("__v", version)
    for k in [*keys, "__v"]:
        known = known.filter(F.col(k).isNotNull())
    ranked = known.withColumn("__rank", F.rank().over(Window.partitionBy(*keys).orderBy(F.desc("__v"))))
    return ranked.filter((F.col("__rank") == 1)).filter(keep).drop("__v", "__rank")


def zip_rows(left: DataFrame, right: DataFrame, left_order: Sequence[Column], right_order: Sequence[Column],
             left_on: str, right_on: str, how: str = "inner") -> DataFrame:
    """Join the n-th row of one table to the n-th row of the other; ``how='full'`` pads with null."""
    a = positions(left, left_order, on=left_on)
    b = positions(right, right_order, on=right_on)
    return a.join(b, "pos", how)


def combinations(items: Column, k: int) -> Column:
    """All k-item subsets of a short array as an array of arrays, in array order."""

    def extend(chosen: Column, start: Column, left: int) -> Column:
        rest = F.slice(items, start, F.size(items))
        if left == 1:
            return F.transform(rest, lambda x: F.concat(chosen, F.array(x)))
        return F.flatten(F.transform(rest, lambda x, i: extend(F.concat(chosen, F.array(x)), start + i + 1, left - 1)))

    empty = F.slice(items, 1, 0)
    return F.when(F.size(items) >= k, extend(empty, F.lit(1), k)).otherwise(F.slice(F.array(empty), 1, 0))


def intersect_all(frames: Sequence[DataFrame]) -> DataFrame:
    return reduce(DataFrame.intersect, frames)


def union_all(frames: Sequence[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)


def pair_to_goal(df: DataFrame, keys: Sequence[str], place: str, value: str, goal: Column | float) -> DataFrame:
    """First pair of one group that adds up to ``goal``: the pair whose later member comes first.

    Two different values that add up to the goal share the smaller of the two, so one aggregation by that
    value finds the first place of either; rows meet no other rows.  Only of half the goal itself are the
    first two places looked for.
    """
    goal = F.lit(goal) if not isinstance(goal, Column) else goal
    kind = df.schema[value].dataType.simpleString()
    if kind in ("double", "float"):  # 0.1 + 0.2 is to meet 0.3
        df, goal = df.withColumn(value, F.col(value).cast("decimal(30,10)")), goal.cast("decimal(30,10)")
    known = df.select(*keys, place, value).filter(F.col(value).isNotNull())
    half = F.col(value) * 2 == goal
    once = known.filter(half).groupBy(*keys, value, place).agg(F.count(F.lit(1)).alias("__n"))
    by_value = Window.partitionBy(*keys, value).orderBy(place)
    seen = (
        once.withColumn("__rn", F.row_number().over(by_value)).filter(F.col("__rn") <= 2)
        .groupBy(*keys, value)
        .agg(F.min(place).alias("__first"),
             F.max(F.when(F.col("__rn") == 2, F.col(place))).alias("__next"),
             F.max(F.when(F.col("__rn") == 1, F.col("__n"))).alias("__n"))
    )
    # two equal values at the same place are a pair as well
    second = F.when(F.col("__n") > 1, F.col("__first")).otherwise(F.col("__next"))
    twice = seen.select(
        *keys, second.alias("__at"), F.col(value).alias("first_value"), F.col(value).alias("second_value")
    ).filter(F.col("__at").isNotNull())
    other = goal - F.col(value)
    below = F.col(value) < other
    met = (
        known.filter(~half).groupBy(*keys, F.least(F.col(value), other).alias("__low"))
        .agg(F.min(F.when(below, F.col(place))).alias("__low_at"), F.min(F.when(~below, F.col(place))).alias("__high_at"),
             F.max(below).alias("__has_low"), F.max(~below).alias("__has_high"))
        .filter("__has_low AND __has_high").withColumn("__high", goal - F.col("__low"))
    )
    # of two values first seen at one place the smaller comes first, and an unknown place before any other
    rising = F.coalesce(F.col("__low_at") <= F.col("__high_at"), F.col("__low_at").isNull())
    mixed = met.select(
        *keys, F.when(rising, F.col("__high_at")).otherwise(F.col("__low_at")).alias("__at"),
        F.when(rising, F.col("__low")).otherwise(F.col("__high")).alias("first_value"),
        F.when(rising, F.col("__high")).otherwise(F.col("__low")).alias("second_value"))
    # ties on the place: the smaller second value wins
    return twice.unionByName(mixed).groupBy(*keys).agg(
        F.min(F.struct("__at", "second_value", "first_value")).alias("p")
    ).select(*keys, F.col("p.first_value").cast(kind).alias("first_value"), F.col("p.second_value").cast(kind).alias("second_value"))
