"""Regular time series: resampling, frequency choice, control statistics, autocorrelation, decomposition.

Raw rows are reduced to (series, hour) or (series, bucket) sums before anything is ordered, so
a window below sees at most one row per bucket of the calendar, however many rows a series has.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tablemill.operators.sorting import top_per_group
from tablemill.session import stage

# Frequencies from fine to coarse, and the periods used for decomposition.
FREQUENCIES = ["H", "D", "W", "MS", "QS", "YS"]
PERIODS = {"H": 24, "D": 7, "W": 52, "MS": 12, "QS": 4, "YS": 1}
RANKS = {f: len(FREQUENCIES) - 1 - i for i, f in enumerate(FREQUENCIES)}
MAX_TRIM = 20
MAX_EMPTY_YEARS = 500
# Empty buckets between two known ones that are filled in; a gap beyond is refused with an error.
MAX_GAP = 1_000_000


def bucket_index(at: Column, freq: str) -> Column:
    """Whole number of the calendar bucket; neighbours differ by one.  Weeks end on Sunday."""
    day = at.cast("date")
    if freq == "H":
        index = F.floor(F.unix_seconds(at.cast("timestamp")) / 3600)
    elif freq == "D":
        index = F.unix_date(day)
    elif freq == "W":
        index = F.floor((F.unix_date(day) - 4) / 7)
    elif freq == "MS":
        index = F.year(day) * 12 + F.month(day) - 1
    elif freq == "QS":
        index = F.year(day) * 4 + F.quarter(day) - 1
    else:
        index = F.year(day)
    return index.cast("long")


def bucket_label(index: Column, freq: str) -> Column:
    """First instant of the bucket; for weeks the Sunday that closes them."""
    if freq == "H":
        return F.timestamp_seconds(index * 3600)
    if freq in ("D", "W"):
        days = index if freq == "D" else index * 7 + 10
        return F.date_from_unix_date(days.cast("int")).cast("timestamp")
    per_year = {"MS": 12, "QS": 4, "YS": 1}[freq]
    year = F.floor(index / per_year).cast("int")
    month = (F.pmod(index, F.lit(per_year)) * (12 // per_year) + 1).cast("int")
    return F.make_date(year, month, F.lit(1)).cast("timestamp")


def pick(freq: Column, function, argument: Column) -> Column:
    """``function(argument, f)`` for the frequency named by a column."""
    out = None
    for f in FREQUENCIES:
        value = function(argument, f)
        out = F.when(freq == f, value) if out is None else out.when(freq == f, value)
    return out


def fill_buckets(buckets: DataFrame, keys: Sequence[str], value: str = "value") -> DataFrame:
    """Insert the missing buckets with null; adds ``idx`` counted from 0."""
    by_bucket = Window.partitionBy(*keys).orderBy("b")
    following = F.lead("b").over(by_bucket)
    first = F.min("b").over(Window.partitionBy(*keys))
    empty = F.coalesce(following - 1, F.col("b")) - F.col("b")
    bounded = F.when(empty > MAX_GAP, F.raise_error(F.lit(f"a gap of more than {MAX_GAP} empty buckets: is a date wrong, or the frequency too fine?")).cast("long"))
    spread = buckets.withColumn("__to", bounded.otherwise(F.coalesce(following - 1, F.col("b")))).withColumn("__first", first)
    return (
        spread.withColumn("__b", F.explode(F.sequence("b", "__to")))
        .withColumn(value, F.when(F.col("__b") == F.col("b"), F.col(value)))
        .withColumn("b", F.col("__b")).withColumn("idx", F.col("b") - F.col("__first"))
        .drop("__b", "__to", "__first")
    )


def resample(df: DataFrame, keys: Sequence[str], at: str, value: str, freq: str) -> DataFrame:
    """Mean per bucket with empty buckets as null: keys, b, value, idx, bucket."""
    known = df.filter(F.col(at).isNotNull() & F.col(value).isNotNull())
    buckets = known.groupBy(*keys, bucket_index(F.col(at), freq).alias("b")).agg(
        (F.sum(value).cast("double") / F.count(value)).alias("value"))
    return fill_buckets(buckets, keys).withColumn("bucket", bucket_label(F.col("b"), freq))


def hourly(df: DataFrame, keys: Sequence[str], at: str, value: str | None = None) -> DataFrame:
    """Rows (and sums) per series and hour."""
    known = df.filter(F.col(at).isNotNull())
    aggs = [F.count(F.lit(1)).alias("n")]
    if value:
        known = known.filter(F.col(value).isNotNull())
        aggs.append(F.sum(value).alias("total"))
    return known.groupBy(*keys, bucket_index(F.col(at), "H").alias("hour")).agg(*aggs)


def _all_buckets(hours: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows per series, frequency and bucket with the row count before and up to the bucket."""
    at = F.timestamp_seconds(F.col("hour") * 3600)
    every = F.explode(F.array(*[F.struct(F.lit(f).alias("freq"), bucket_index(at, f).alias("b")) for f in FREQUENCIES]))
    cells = hours.select(*keys, "n", every.alias("c")).groupBy(*keys, "c.freq", "c.b").agg(F.sum("n").alias("n"))
    order = Window.partitionBy(*keys, "freq").orderBy("b")
    return (
        cells.withColumn("upto", F.sum("n").over(order.rowsBetween(Window.unboundedPreceding, 0)))
        .withColumn("before", F.col("upto") - F.col("n"))
        .withColumn("gap", F.col("b") - F.lag("b").over(order) > 1)
        .withColumn("size", F.sum("n").over(Window.partitionBy(*keys, "freq")))
    )


def best_frequency(hours: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Finest frequency without an empty bucket and with at least three buckets, else yearly."""
    cells = _all_buckets(hours, keys)
    per_freq = cells.groupBy(*keys, "freq").agg(F.max(F.coalesce("gap", F.lit(False))).alias("gaps"), F.count(F.lit(1)).alias("buckets"))
    rank = pick(F.col("freq"), lambda _, f: F.lit(RANKS[f]), F.col("freq"))
    good = F.when(~F.col("gaps") & (F.col("buckets") >= 3), rank)
    best = per_freq.groupBy(*keys).agg(F.coalesce(F.max(good), F.lit(0)).alias("rank"))
    return best.select(*keys, _name_of(F.col("rank")).alias("period"))


def _name_of(rank: Column) -> Column:
    out = None
    for f, r in RANKS.items():
        out = F.when(rank == r, f) if out is None else out.when(rank == r, f)
    return out


def best_trim(hours: DataFrame, keys: Sequence[str]) -> DataFrame:
    """How many first and last rows to drop for a finer frequency: keys, period, drop_first, drop_last.

    The search visits (drop_last, drop_first) pairs up to ``m = min(20, round(0.2 n))``, keeps
    each strictly finer frequency and stops at hours or at the frequency seen with both ends
    trimmed by ``m + 1``.  A frequency without a gap in the middle first works at exactly one
    pair, given by the last gap near the start and the first gap near the end, so at most one
    row per frequency has to be looked at instead of the whole grid.
    """
    cells = _all_buckets(hours, keys).withColumn("m", F.least(F.lit(MAX_TRIM), F.bround(F.col("size") * 0.2)).cast("long"))
    i, m, n = F.col("before") - 1, F.col("m"), F.col("size")
    near_start, near_end = i <= m - 1, (i > m - 1) & (i >= n - m - 1)
    edge = F.struct("before", "upto", "b")
    per_freq = cells.groupBy(*keys, "freq", "size", "m").agg(
        F.coalesce(F.max(F.when(F.col("gap") & near_start, i)) + 1, F.lit(0)).alias("f"),
        F.coalesce(n - 1 - F.min(F.when(F.col("gap") & near_end, i)), F.lit(0)).alias("l"),
        F.count(F.when(F.col("gap") & ~near_start & ~near_end, 1)).alias("inner"),
        F.count(F.when(F.col("gap") & (i >= m + 1) & (i <= n - m - 3), 1)).alias("target_inner"),
        # each cell holds a row at least, so these lists have at most m + 2 entries
        F.collect_list(F.when(F.col("before") <= m + 1, edge)).alias("head"),
        F.collect_list(F.when(n - F.col("upto") <= m + 1, edge)).alias("tail"))

    def bucket_of(cells_: Column, row: Column) -> Column:
        return F.get(F.filter(cells_, lambda c: (c["before"] <= row) & (c["upto"] > row)), F.lit(0))["b"]

    def enough(first: Column, last: Column) -> Column:
        rows = F.coalesce(bucket_of(F.col("tail"), n - 1 - last) - bucket_of(F.col("head"), first) + 1, F.lit(0))
        return (rows >= 3) & (first + last < n)

    rank = pick(F.col("freq"), lambda _, f: F.lit(RANKS[f]), F.col("freq"))
    events = per_freq.select(
        *keys, rank.alias("rank"), "f", "l",
        ((F.col("inner") == 0) & enough(F.col("f"), F.col("l"))).alias("ok"),
        ((F.col("target_inner") == 0) & enough(m + 1, m + 1)).alias("target_ok"))
    series = Window.partitionBy(*keys)
    search = series.orderBy("l", "f", F.desc("rank"))
    top = max(RANKS.values())
    events = (
        events.withColumn("target", F.coalesce(F.max(F.when(F.col("target_ok"), F.col("rank"))).over(series), F.lit(0)))
        .withColumn("known", F.coalesce(F.max(F.when(F.col("ok"), F.col("rank"))).over(search.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
        .withColumn("better", F.col("ok") & (F.col("rank") > F.col("known")))
        .withColumn("at_start", F.max(F.when(F.col("ok") & (F.col("l") == 0) & (F.col("f") == 0), F.col("rank")).otherwise(0)).over(series))
    )
    step = F.struct("l", "f", "rank")
    stop = F.col("better") & ((F.col("rank") == F.col("target")) | (F.col("rank") == top))
    chosen = events.groupBy(*keys).agg(
        F.min(F.when(stop, step)).alias("hit"), F.max(F.when(F.col("better"), F.struct("rank", "l", "f"))).alias("last"),
        ((F.max("target") == 0) & (F.max("at_start") == 0)).alias("at_once"))

    def result(field: str) -> Column:
        return F.when(F.col("at_once"), 0).otherwise(F.coalesce(F.col("hit")[field], F.col("last")[field], F.lit(0)))

    return chosen.select(*keys, _name_of(result("rank")).alias("period"),
                         result("f").cast("long").alias("drop_first"), result("l").cast("long").alias("drop_last"))


def control_statistics(series: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Latest runs of one regular series per key: steps, side of the mean, beyond three deviations.

    Equal neighbours and values equal to the mean neither count nor break a run; a value inside
    the limits breaks the third kind.  A series with an empty bucket has no mean, hence no runs
    of the last two kinds.
    """
    whole = Window.partitionBy(*keys)
    v = F.col("value")
    full = F.count(F.when(v.isNull(), 1)).over(whole) == 0
    step = F.signum(v - F.lag(v).over(whole.orderBy("idx")))
    base = series.withColumns({"__mean": F.when(full, F.avg(v).over(whole)), "__std": F.when(full, F.stddev_samp(v).over(whole))})
    side = F.signum(v - F.col("__mean"))
    low, high = F.col("__mean") - 3 * F.col("__std"), F.col("__mean") + 3 * F.col("__std")
    beyond = F.when(low == high, None).when(v <= low, -1.0).when(v >= high, 1.0).when((v > low) & (v < high), 0.0)
    marked = base.withColumns({"__step": F.nullif(step, F.lit(0.0)), "__side": F.nullif(side, F.lit(0.0)), "__beyond": beyond})
    last = {}
    for name in ("__step", "__side", "__beyond"):
        s = F.col(name)
        last[f"{name}_nd"] = F.coalesce(F.max(F.when(s >= 0, F.col("idx"))).over(whole), F.lit(-1))
        last[f"{name}_nu"] = F.coalesce(F.max(F.when(s <= 0, F.col("idx"))).over(whole), F.lit(-1))
    marked = marked.withColumns(last)

    def runs(name: str, down: str, up: str) -> list[Column]:
        s, idx = F.col(name), F.col("idx")
        return [F.count(F.when((s < 0) & (idx > F.col(f"{name}_nd")), 1)).alias(down),
                F.count(F.when((s > 0) & (idx > F.col(f"{name}_nu")), 1)).alias(up)]

    return marked.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("nobs"), *runs("__step", "decr", "incr"), *runs("__side", "blw_mn", "abv_mn"),
        *runs("__beyond", "blw_lcl", "abv_ucl"))


def trimmed_series(rows: DataFrame, hours: DataFrame, keys: Sequence[str], at: str, value: str, order: str, choice: DataFrame) -> DataFrame:
    """Series at the chosen frequency after dropping the chosen first and last rows.

    ``hours`` are the hourly sums of the rows.  The hours that hold the dropped rows, ``MAX_TRIM`` at most at
    each end, follow from their counts; only rows of these hours are ranked, and the sums of those dropped are
    taken off the hourly sums.  The rows are read once, and not moved where the hours are few.
    """
    known = rows.filter(F.col(at).isNotNull() & F.col(value).isNotNull()).select(
        *keys, at, value, order, bucket_index(F.col(at), "H").alias("hour"))
    counts = hours.select(*keys, "hour", "n")
    wanted = []
    for count, direction in (("drop_first", F.asc), ("drop_last", F.desc)):
        earlier = Window.partitionBy(*keys).orderBy(direction("hour")).rowsBetween(Window.unboundedPreceding, -1)
        near = top_per_group(counts, keys, [direction("hour")], MAX_TRIM).withColumn("__before", F.coalesce(F.sum("n").over(earlier), F.lit(0)))
        left = F.col(count) - F.col("__before")
        wanted.append(near.join(choice, list(keys)).filter(left > 0).select(*keys, "hour", F.lit(count).alias("__end"), left.alias("__left")))
    # an hour gives its first or last rows, as many as are left to drop when the order comes to it
    asked = known.join(wanted[0].unionByName(wanted[1]), [*keys, "hour"])
    first, last = F.col("__end") == "drop_first", F.col("__end") == "drop_last"
    # one order for both ends: rows of the other end are null in it
    inwards = [F.when(first, F.col(at)), F.when(first, F.col(order)), F.desc(F.when(last, F.col(at))), F.desc(F.when(last, F.col(order)))]
    ranked = asked.withColumn("__rn", F.row_number().over(Window.partitionBy(*keys, "hour", "__end").orderBy(*inwards)))
    ends = ranked.filter((F.col("__rn") <= MAX_TRIM) & (F.col("__rn") <= F.col("__left"))).select(*keys, at, value)
    off = hourly(ends, keys, at, value).withColumnsRenamed({"n": "__n", "total": "__total"})
    left = hours.join(off, [*keys, "hour"], "left").select(
        *keys, "hour", (F.col("n") - F.coalesce("__n", F.lit(0))).alias("n"),
        (F.col("total") - F.coalesce("__total", F.lit(0))).alias("total")).filter("n > 0")
    placed = left.join(choice, list(keys)).withColumn("b", pick(F.col("period"), bucket_index, F.timestamp_seconds(F.col("hour") * 3600)))
    buckets = placed.groupBy(*keys, "period", "drop_first", "drop_last", "b").agg(
        (F.sum("total").cast("double") / F.sum("n")).alias("value"))
    return fill_buckets(buckets, keys).withColumn("bucket", pick(F.col("period"), bucket_label, F.col("b")))


def empty_years(hours: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Yearly buckets and how many of them are empty."""
    years = hours.select(*keys, bucket_index(F.timestamp_seconds(F.col("hour") * 3600), "YS").alias("b"))
    span = F.max("b") - F.min("b") + 1
    return years.groupBy(*keys).agg(span.alias("years"), (span - F.count_distinct("b")).alias("empty"))


def series_statistics(rows: DataFrame, keys: Sequence[str], at: str, value: str, order: str) -> DataFrame:
    """Control statistics per series; series with more than 500 empty years get zeros and ``YS``."""
    # hourly sums and choices are read several times; the rows themselves only for their ends
    hours = stage(hourly(rows, keys, at, value), "series-hours")
    years = stage(empty_years(hours, keys), "series-years")
    choice = stage(best_trim(hours, keys).join(years.filter(F.col("empty") <= MAX_EMPTY_YEARS).select(*keys), list(keys), "left_semi"), "series-choice")
    series = trimmed_series(rows, hours, keys, at, value, order, choice)
    found = control_statistics(series, keys).join(choice, list(keys))
    sparse = years.filter(F.col("empty") > MAX_EMPTY_YEARS).select(
        *keys, F.col("years").alias("nobs"), F.lit("YS").alias("period"),
        *[F.lit(0).cast("long").alias(c) for c in ("drop_first", "drop_last", "decr", "incr", "blw_mn", "abv_mn", "blw_lcl", "abv_ucl")])
    return found.unionByName(sparse)


# The six selection rules and the run length each must exceed.
SELECTION_RULES = {"decr": 7, "incr": 7, "blw_mn": 7, "abv_mn": 7, "blw_lcl": 0, "abv_ucl": 0}


def select_series(stats: DataFrame, time_column: str, feature: str, per_rule: int = 2) -> DataFrame:
    """Per time column the features with the longest runs of each kind, without repeats."""
    long = stats.select(time_column, feature, F.explode(F.array(*[
        F.struct(F.lit(r).alias("rule"), F.col(r).alias("run"), F.lit(limit).alias("above")) for r, limit in SELECTION_RULES.items()])).alias("r"))
    long = long.select(time_column, feature, "r.*").filter(F.col("run") > F.col("above"))
    return top_per_group(long, [time_column, "rule"], [F.desc("run"), F.col(feature)], per_rule).select(time_column, feature).distinct()


def autocorrelation(series: DataFrame, keys: Sequence[str], max_lag: int = 40) -> DataFrame:
    """Autocorrelation per lag 1 .. min(40, n-1), every lag divided by the same total; null values are left out first.

    All lags come from one window and one aggregation.  ``lag0`` counts from zero.
    """
    whole = Window.partitionBy(*keys)
    known = series.filter(F.col("value").isNotNull())
    known = known.withColumn("__x", F.col("value") - F.avg("value").over(whole))
    ahead = known.select(*keys, "__x", *[F.lead("__x", k).over(whole.orderBy("idx")).alias(f"__l{k}") for k in range(1, max_lag + 1)])
    sums = ahead.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.col("__x") * F.col("__x")).alias("__all"),
        F.array(*[F.sum(F.col("__x") * F.col(f"__l{k}")) for k in range(1, max_lag + 1)]).alias("__s"))
    return sums.select(*keys, "n", "__all", F.posexplode("__s").alias("lag0", "__v")).filter(F.col("lag0") + 1 < F.col("n")).select(
        *keys, (F.col("lag0") + 1).alias("lag"), "lag0", F.try_divide("__v", "__all").alias("acf"))


def sum_of_squared_acf(series: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Sum over the squared autocorrelations; infinite for fewer than two known points."""
    size = series.groupBy(*keys).agg(F.count("value").alias("n"))
    squares = autocorrelation(series, keys).groupBy(*keys).agg(F.sum(F.col("acf") * F.col("acf")).alias("s"))
    return size.join(squares, list(keys), "left").select(
        *keys, F.when(F.col("n") < 2, F.lit(float("inf"))).otherwise(F.col("s")).alias("acf_sos"))


def decompose(series: DataFrame, keys: Sequence[str], period: int, model: str = "add") -> DataFrame:
    """Trend, seasonality and residual of a regular series; adds columns of these names.

    Trend is the centred moving average over one period (half weights at both ends for an even
    period).  Seasonality is the mean of the detrended values per phase, centred on 0 or 1.
    Series with fewer than two periods, an empty bucket or, for ``mul``, a value that is not
    positive have null parts.
    """
    whole = Window.partitionBy(*keys)
    order = whole.orderBy("idx")
    v = F.col("value")
    half = period // 2
    frame = order.rowsBetween(-half, half)
    if period % 2:
        mean = F.sum(v).over(frame) / period
    else:
        inner = order.rowsBetween(-(half - 1), half - 1)
        mean = (F.sum(v).over(inner) + (F.lag(v, half).over(order) + F.lead(v, half).over(order)) / 2) / period
    size, known = F.count(F.lit(1)).over(whole), F.count(v).over(whole)
    usable = (size >= 2 * period) & (size == known)
    if model == "mul":
        usable = usable & (F.min(v).over(whole) > 0)
    inside = (F.col("idx") >= half) & (F.col("idx") < size - half)
    out = series.withColumn("__usable", usable).withColumn("trend", F.when(F.col("__usable") & inside, mean))
    rest = v - F.col("trend") if model == "add" else v / F.col("trend")
    out = out.withColumn("__phase", F.pmod("idx", F.lit(period))).withColumn("__rest", rest)
    out = out.withColumn("__at_phase", F.avg("__rest").over(Window.partitionBy(*keys, "__phase")))
    # every phase counts once: the first period holds each phase exactly one time
    centre = F.avg(F.when(F.col("idx") < period, F.col("__at_phase"))).over(whole)
    out = out.withColumn("__centre", centre)
    season = F.col("__at_phase") - F.col("__centre") if model == "add" else F.col("__at_phase") / F.col("__centre")
    out = out.withColumn("seasonality", F.when(F.col("__usable"), season))
    left = v - F.col("trend") - F.col("seasonality") if model == "add" else v / F.col("trend") / F.col("seasonality")
    return out.withColumn("residual", left).drop("__usable", "__phase", "__rest", "__at_phase", "__centre")


def season_choice(series: DataFrame, keys: Sequence[str], period: int) -> DataFrame:
    """Best seasonal model: the smaller residual autocorrelation, if below that of the raw series.

    Ties go to additive.  Columns: acf_sos, add_sos, mul_sos (null when the model failed), seasonality.
    """
    out = sum_of_squared_acf(series, keys)
    for model in ("add", "mul"):
        parts = decompose(series, keys, period, model)
        ok = parts.groupBy(*keys).agg(F.count("seasonality").alias("n")).filter("n > 0").select(*keys)
        score = sum_of_squared_acf(parts.select(*keys, "idx", F.col("residual").alias("value")), keys)
        score = score.join(ok, list(keys), "left_semi").withColumnRenamed("acf_sos", f"{model}_sos")
        out = out.join(score, list(keys), "left")
    add, mul, raw = F.col("add_sos"), F.col("mul_sos"), F.col("acf_sos")
    never = F.lit(float("inf"))
    a, b = F.coalesce(add, never), F.coalesce(mul, never)
    return out.withColumn("seasonality", F.when((a <= b) & (a < raw), "add").when((b <= a) & (b < raw), "mul").otherwise("None"))


def season_length(parts: DataFrame, keys: Sequence[str], tolerance: float = 1e-9) -> DataFrame:
    """Distance between the first two peaks of the seasonal part, at least 2."""
    whole = Window.partitionBy(*keys)
    peak = F.max("seasonality").over(whole)
    near = F.col("seasonality") >= peak - F.abs(peak) * tolerance - tolerance
    peaks = top_per_group(parts.withColumn("__peak", near).filter("__peak"), keys, [F.col("idx")], 2)
    found = peaks.groupBy(*keys).agg((F.max("idx") - F.min("idx")).alias("d"))
    every = parts.select(*keys).distinct()
    return every.join(found, list(keys), "left").select(*keys, F.greatest(F.coalesce("d", F.lit(2)), F.lit(2)).alias("season_length"))
