"""Ordered operators that stay balanced when one key holds much of the table.

A plain window puts a whole key into one task.  The functions here first cut the ordering
column into ranges of about equal row count.  Work inside a (key, range) cell is an ordinary
window; what has to cross ranges is one small row per cell, combined afterwards.  The range
bounds only decide how rows are spread, never what the result is.
"""

from __future__ import annotations

from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tablemill.session import stage

RANGE = "__range"
#: Rows that a range is meant to hold, and sampled rows per range from which its bound is taken.
RANGE_ROWS = 2_000_000
SAMPLES = 16
#: Ranges up to which bounds are literals of the plan.
TOP = 1000
#: Whole numbers within so many of each other are not numbered anew.
CLOSE = 1 << 12


def _listed(on) -> list[Column]:
    columns = on if isinstance(on, (list, tuple)) else [on]
    return [F.col(c) if isinstance(c, str) else c for c in columns]


class Splitters(NamedTuple):
    """Where the order is cut: ``top`` bounds as literals and, in a table, the bounds within each top cell."""

    top: list
    inner: DataFrame | None = None
    width: int = 1


def _struct(columns: list[Column], bound=None, kinds=None) -> Column:
    if bound is not None:
        columns = [F.lit(v).cast(k) for v, k in zip(bound, kinds)]
    return F.struct(*[c.alias(f"o{i}") for i, c in enumerate(columns)])


def _bounds_below(listed: Column, most: int, own: Column) -> Column:
    """How many of the sorted bounds, ``most`` at most, are not above ``own``, by binary search."""
    steps = F.array(*[F.lit(1 << k) for k in reversed(range(most.bit_length()))])
    return F.aggregate(steps, F.lit(0), lambda at, step: F.when(F.get(listed, at + step - 1) <= own, at + step).otherwise(at))


def range_bounds(df: DataFrame, on, parts: int | None = None) -> Splitters:
    """Bounds that cut the order of ``on`` (one column or several) into ranges of about equal row count.

    There is a range for every ``RANGE_ROWS`` rows unless ``parts`` is given.  Bounds are values of the
    columns themselves, taken from a sample of ``SAMPLES`` rows a range; they decide how rows are spread and
    never a result.  At most ``TOP`` ranges are cut by literals.  Beyond, these are the top cells, and each
    has its own bounds in a stored table of one row per top cell, made by tasks: whatever the number of
    ranges, ``SAMPLES`` x ``TOP`` sampled rows come to the driver and ``TOP`` bounds into a plan.
    """
    columns = _listed(on)
    keyed = df.select(*[c.alias(f"o{i}") for i, c in enumerate(columns)])
    rows = keyed.count()
    wanted = parts or -(-rows // RANGE_ROWS)
    if wanted < 2 or not rows:
        return Splitters([])

    def sample(ranges: int, seed: int) -> DataFrame:
        share = SAMPLES * ranges / rows
        return keyed if share >= 1 else keyed.sample(withReplacement=False, fraction=share, seed=seed)

    cells = min(wanted, TOP)
    found = sample(cells, 1).orderBy(*keyed.columns).collect()
    picked = [found[i * len(found) // cells] for i in range(1, cells)] if found else []
    bounds: list = []
    for row in picked:
        if not bounds or repr(bounds[-1]) != repr(row):
            bounds.append(row)
    if wanted <= TOP or not bounds:
        return Splitters(bounds)
    per = -(-wanted // TOP)
    own = _struct([F.col(c) for c in keyed.columns])
    dealt = with_range(sample(wanted, 2).distinct(), keyed.columns, bounds=Splitters(bounds))
    order = Window.partitionBy(RANGE).orderBy(*keyed.columns)
    every = F.ceil(F.count(F.lit(1)).over(Window.partitionBy(RANGE)) / per)
    chosen = dealt.withColumn("__rn", F.row_number().over(order) - 1).withColumn("__every", every).where("__rn > 0 and __rn % __every = 0")
    # at most ``per`` bounds to a top cell
    inner = chosen.groupBy(F.col(RANGE).alias("__top")).agg(F.array_sort(F.collect_list(own)).alias("__bounds"))
    return Splitters(bounds, stage(inner, "range-bounds"), per + 1)


def with_range(df: DataFrame, on, parts: int | None = None, bounds: Splitters | None = None) -> DataFrame:
    """Add ``__range``: the number of bounds that are not above the row, by binary search.

    ``on`` is the leading order column, or the first few; with more than one, the rows of a frequent
    first value are cut by the next.  As in Spark's own order, null comes first and NaN last.
    """
    columns = _listed(on)
    bounds = range_bounds(df, columns, parts) if bounds is None else bounds
    if not bounds.top:
        return df.withColumn(RANGE, F.lit(0))
    kinds = [f.dataType for f in df.select(*columns).schema]
    listed = F.array(*[_struct(columns, row, kinds) for row in bounds.top])
    cut = df.withColumn(RANGE, _bounds_below(listed, len(bounds.top), _struct(columns)))
    if bounds.inner is None:
        return cut
    # one row per top cell, stored: Spark knows its size and broadcasts it or not
    met = cut.join(bounds.inner, F.col(RANGE) == F.col("__top"), "left")
    own = _bounds_below(F.col("__bounds"), bounds.width - 1, _struct(columns))
    return met.withColumn(RANGE, F.col(RANGE) * bounds.width + own).drop("__top", "__bounds")


def _join_cells(rows: DataFrame, cells: DataFrame, keys: Sequence[str], bounds: Splitters) -> DataFrame:
    """Join per-cell rows back; null keys meet null keys."""
    cells = cells.select(*[F.col(k).alias(f"__k_{k}") for k in keys],
                         F.col(RANGE).alias("__k_range"),
                         *[c for c in cells.columns if c not in (*keys, RANGE)])
    same = F.col(RANGE) == F.col("__k_range")
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"__k_{k}"))
    # without keys there is one cell per range: at most TOP of them, unless there are inner bounds
    side = cells if keys or bounds.inner is not None else F.broadcast(cells)
    return rows.join(side, same, "left").drop("__k_range", *[f"__k_{k}" for k in keys])


def positions(df: DataFrame, order: Sequence[Column], on, keys: Sequence[str] = (),
              name: str = "pos", parts: int | None = None) -> DataFrame:
    """Number the rows of each key 1, 2, 3 … in ``order``.

    ``on`` names the first ordering column, or the first two; ``order`` must be total.
    """
    keys = list(keys)
    bounds = range_bounds(df, on, parts)
    if not bounds.top:
        return df.withColumn(name, F.row_number().over(Window.partitionBy(*keys, F.lit(0)).orderBy(*order)).cast("long"))
    cut = with_range(df, on, bounds=bounds)
    cells = cut.groupBy(*keys, RANGE).agg(F.count(F.lit(1)).alias("__n"))
    earlier = Window.partitionBy(*keys).orderBy(RANGE).rowsBetween(Window.unboundedPreceding, -1)
    cells = cells.select(*keys, RANGE, F.coalesce(F.sum("__n").over(earlier), F.lit(0)).alias("__before"))
    rows = cut.withColumn("__rn", F.row_number().over(Window.partitionBy(*keys, RANGE).orderBy(*order)))
    return (
        _join_cells(rows, cells, keys, bounds)
        .withColumn(name, (F.col("__rn") + F.col("__before")).cast("long"))
        .drop("__rn", "__before", RANGE)
    )


def running_sums(df: DataFrame, order: Sequence[Column], on, sums: dict[str, Column],
                 keys: Sequence[str] = (), parts: int | None = None) -> DataFrame:
    """Add, per key, the running total of each expression in ``sums`` up to and with the row."""
    keys = list(keys)
    bounds = range_bounds(df, on, parts)
    if not bounds.top:
        upto = Window.partitionBy(*keys, F.lit(0)).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
        return df.select("*", *[F.sum(e).over(upto).alias(n) for n, e in sums.items()])
    cut = with_range(df, on, bounds=bounds)
    cut = cut.select("*", *[e.alias(f"__v_{n}") for n, e in sums.items()])
    cells = cut.groupBy(*keys, RANGE).agg(*[F.sum(f"__v_{n}").alias(f"__t_{n}") for n in sums])
    earlier = Window.partitionBy(*keys).orderBy(RANGE).rowsBetween(Window.unboundedPreceding, -1)
    cells = cells.select(*keys, RANGE, *[F.sum(f"__t_{n}").over(earlier).alias(f"__b_{n}") for n in sums])
    upto = Window.partitionBy(*keys, RANGE).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    rows = cut.select("*", *[F.sum(f"__v_{n}").over(upto).alias(f"__w_{n}") for n in sums])
    joined = _join_cells(rows, cells, keys, bounds)
    for n in sums:
        total = F.when(F.col(f"__w_{n}").isNull(), F.col(f"__b_{n}")).otherwise(
            F.col(f"__w_{n}") + F.coalesce(F.col(f"__b_{n}"), F.lit(0)))
        joined = joined.withColumn(n, total)
    return joined.drop(RANGE, *[f"__{p}_{n}" for p in "vwb" for n in sums])


def largest_gap(df: DataFrame, value: str, keys: Sequence[str] = (), name: str = "max_gap",
                parts: int | None = None) -> DataFrame:
    """Largest difference between neighbours of the sorted numeric column ``value`` per key."""
    keys = list(keys)
    known = df.filter(F.col(value).isNotNull())
    # equal values are one row with a count: they are a gap of zero
    single = known.groupBy(*keys, value).agg(F.count(F.lit(1)).alias("__n"))
    cut = with_range(single, value, bounds=range_bounds(known, value, parts))
    step = Window.partitionBy(*keys, RANGE).orderBy(value)
    same = F.when(F.col("__n") > 1, F.lit(0))
    cells = (
        cut.withColumn("__gap", F.greatest(F.col(value) - F.lag(value).over(step), same))
        .groupBy(*keys, RANGE)
        .agg(F.max("__gap").alias("__inner"), F.min(value).alias("__lo"), F.max(value).alias("__hi"))
    )
    across = Window.partitionBy(*keys).orderBy(RANGE)
    cells = cells.withColumn("__outer", F.col("__lo") - F.lag("__hi").over(across))
    return cells.groupBy(*keys).agg(F.max(F.greatest("__inner", "__outer")).alias(name))


def rolling(df: DataFrame, pos: str, width: int, keys: Sequence[str] = (), block: int = 100_000,
            **aggs) -> DataFrame:
    """Aggregate each row with its ``width - 1`` followers; ``pos`` counts 1, 2, 3 … per key.

    Blocks of consecutive positions are independent tasks: a row is copied to every earlier block
    from which a frame reaches it, so frames never cross a task.  Blocks hold a frame at least.
    """
    keys = list(keys)
    block = max(block, width)
    own = F.floor((F.col(pos) - 1) / block)
    first = F.greatest(F.floor((F.col(pos) - width) / block), F.lit(0).cast("long"))
    spread = df.withColumn("__own", own).withColumn("__block", F.explode(F.sequence(F.least(first, own), own)))
    frame = Window.partitionBy(*keys, "__block").orderBy(pos).rowsBetween(0, width - 1)
    out = spread.select("*", *[a.over(frame).alias(n) for n, a in aggs.items()])
    return out.filter(F.col("__own") == F.col("__block")).drop("__own", "__block")


def exact_quantiles(df: DataFrame, value: str, shares: Sequence[float], keys: Sequence[str] = (),
                    parts: int | None = None) -> DataFrame:
    """Exact quantiles with linear interpolation, one row per key and share: ``(keys, share, quantile)``.

    Equal values are counted first.  The cells then tell in which range a wanted rank lies, and
    only those cells are sorted.
    """
    keys = list(keys)
    counted = (
        df.filter(F.col(value).isNotNull())
        .groupBy(*keys, F.col(value).cast("double").alias("__v")).agg(F.count(F.lit(1)).alias("__n"))
    )
    # bounds from the rows themselves: a scan without a shuffle
    cut = with_range(counted, "__v", bounds=range_bounds(df, value, parts))
    cells = cut.groupBy(*keys, RANGE).agg(F.sum("__n").alias("__n"))
    by_range = Window.partitionBy(*keys).orderBy(RANGE)
    cells = cells.select(
        *keys, RANGE,
        F.sum("__n").over(by_range.rowsBetween(Window.unboundedPreceding, 0)).alias("__to"),
        F.sum("__n").over(Window.partitionBy(*keys)).alias("__all"),
        F.col("__n").alias("__here"),
    ).withColumn("__from", F.col("__to") - F.col("__here"))
    share = F.explode(F.array(*[F.lit(float(s)) for s in shares]))
    at = F.col("share") * (F.col("__all") - 1)
    wanted = (
        cells.withColumn("share", share)
        .withColumn("__low", F.floor(at)).withColumn("__high", F.ceil(at))
        .withColumn("__rank", F.explode(F.array_distinct(F.array("__low", "__high"))))
        .filter((F.col("__rank") >= F.col("__from")) & (F.col("__rank") < F.col("__to")))
        .select(*keys, RANGE, "share", "__low", "__high", "__rank", "__from", at.alias("__at"))
    )
    hit = wanted.groupBy(*keys, RANGE).agg(F.collect_list(F.struct(
        "share", "__low", "__high", "__rank", "__at")).alias("__want"), F.min("__from").alias("__from"))
    # at most two ranks per share and key: a short list by construction
    upto = Window.partitionBy(*keys, RANGE).orderBy("__v").rowsBetween(Window.unboundedPreceding, 0)
    hit = hit.select(*[F.col(k).alias(f"__k_{k}") for k in keys], F.col(RANGE).alias("__k_range"), "__want", "__from")
    same = F.col(RANGE) == F.col("__k_range")
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"__k_{k}"))
    sorted_cells = (
        cut.join(hit if keys else F.broadcast(hit), same)
        .withColumn("__to", F.sum("__n").over(upto) + F.col("__from"))
        .withColumn("__lo", F.col("__to") - F.col("__n"))
        .withColumn("__w", F.explode(F.filter(
            "__want", lambda w: (w["__rank"] >= F.col("__lo")) & (w["__rank"] < F.col("__to")))))
    )
    picked = sorted_cells.groupBy(*keys, F.col("__w.share").alias("share")).agg(
        F.max(F.when(F.col("__w.__rank") == F.col("__w.__low"), F.col("__v"))).alias("__a"),
        F.max(F.when(F.col("__w.__rank") == F.col("__w.__high"), F.col("__v"))).alias("__b"),
        F.max(F.col("__w.__at") - F.col("__w.__low")).alias("__f"),
    )
    return picked.select(*keys, "share", (F.col("__a") + (F.col("__b") - F.col("__a")) * F.col("__f")).alias("quantile"))


def quantile_columns(df: DataFrame, value: str, named: dict[str, float], keys: Sequence[str] = ()) -> DataFrame:
    """``exact_quantiles`` with one column per share."""
    long = exact_quantiles(df, value, sorted(set(named.values())), keys)
    return long.groupBy(*keys).agg(
        *[F.max(F.when(F.col("share") == s, F.col("quantile"))).alias(n) for n, s in named.items()])


def _numbered(cells: DataFrame, column: str, name: str) -> tuple[DataFrame, int]:
    """``cells`` with their ordered ``column`` numbered from 0, and a bound on the numbers.

    Whole numbers that lie close together number themselves; other values are numbered densely.
    """
    if cells.schema[column].dataType.typeName() in ("byte", "short", "integer", "long"):
        low, high = cells.agg(F.min(column).cast("decimal(20,0)"), F.max(column).cast("decimal(20,0)")).first()
        if low is None or high - low < CLOSE:
            return cells.withColumn(name, F.col(column) - F.lit(int(low or 0)).cast("long")), int(high - low) + 1 if low is not None else 1
    distinct = stage(cells.select(column).distinct(), "values")
    numbered = positions(distinct, [F.col(column)], on=column, name=name).withColumn(name, F.col(name) - 1)
    return cells.join(numbered, column), distinct.count()


def count_rising_pairs(df: DataFrame, keys: Sequence[str], place: str, value: str, name: str = "n_pairs") -> DataFrame:
    """Count pairs with ``place_i < place_j`` and ``value_i < value_j`` without forming a pair.

    Places are numbered.  Two numbers differ first at exactly one binary level, where the smaller has bit 0
    and the larger bit 1, so each pair meets once among the rows of a level and common prefix.  There the
    rows of bit 1 take the running count of smaller values of bit 0.  A row is copied once per level, and
    running counts are cut into ranges of values; a null takes part in no pair.
    """
    known = df.filter(F.col(place).isNotNull() & F.col(value).isNotNull())
    cells = known.groupBy(*keys, place, value).agg(F.count(F.lit(1)).alias("__n"))
    ranked, n = _numbered(stage(cells, "cells"), place, "__place")
    levels = F.array(*[F.struct(
        F.lit(b).alias("level"), F.shiftright("__place", b + 1).alias("prefix"), F.shiftright("__place", b).bitwiseAND(F.lit(1)).alias("bit"),
    ) for b in range(max(1, (n - 1).bit_length()))])
    spread = ranked.select(*keys, value, "__n", F.explode(levels).alias("__p"))
    inside = [*keys, "__level", "__prefix"]
    sides = spread.groupBy(*keys, F.col("__p.level").alias("__level"), F.col("__p.prefix").alias("__prefix"), value).agg(
        F.sum(F.when(F.col("__p.bit") == 0, F.col("__n")).otherwise(0)).alias("__low"),
        F.sum(F.when(F.col("__p.bit") == 1, F.col("__n")).otherwise(0)).alias("__high"))
    counted = running_sums(stage(sides, "sides"), [F.col(value)], value, {"__upto": F.col("__low")}, inside)
    return counted.groupBy(*keys).agg(F.sum(F.col("__high") * (F.col("__upto") - F.col("__low"))).alias(name))
