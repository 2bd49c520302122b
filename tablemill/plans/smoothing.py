"""Exponential smoothing over a grid of parameters, many series and candidates at once.

Smoothing is sequential inside a series, so a series travels as one array (one value per
calendar bucket) and each candidate folds over it; series and candidates run in parallel.  The
smoothing constants come from a fixed grid, not from an optimiser.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablemill.plans.series import bucket_label

# The parameter grid.
ALPHAS, BETAS, GAMMAS, PHIS = (0.2, 0.5, 0.8), (0.1, 0.3), (0.1, 0.3), (0.8, 0.95)
TRAIN_SHARE = 0.8
COPIES = 16


def candidates(alphas=ALPHAS, betas=BETAS, gammas=GAMMAS, phis=PHIS) -> list[dict]:
    """All (trend, damped) pairs with their constants; no damping without a trend."""
    out = []
    for trend in ("None", "add", "mul"):
        for damped in (False, True):
            if trend == "None" and damped:
                continue
            for alpha in alphas:
                for beta in betas if trend != "None" else (0.0,):
                    for phi in phis if damped else (1.0,):
                        for gamma in gammas:
                            out.append({"trend": trend, "damped": damped, "alpha": alpha, "beta": beta, "gamma": gamma, "phi": phi})
    return out


#: Values whose levels are gathered in one piece.
CHUNK = 256


def series_arrays(series: DataFrame, keys: Sequence[str]) -> DataFrame:
    """One row per series: values in bucket order; the array is as long as the calendar grid."""
    packed = F.array_sort(F.collect_list(F.struct("idx", "value")))
    return series.groupBy(*keys).agg(
        F.transform(packed, lambda s: s["value"]).alias("values"), F.max("b").alias("last_b"),
        (F.count(F.lit(1)) == F.count("value")).alias("complete"), F.min("value").alias("lowest"))


def _start(values: Column, season: Column, length: Column) -> Column:
    """First state: level, slope, seasonal parts and the levels so far."""
    seasonal = season != "None"
    head = F.slice(values, 1, length.cast("int"))
    mean = F.aggregate(head, F.lit(0.0), lambda a, x: a + x) / F.size(head)
    parts = F.when(season == "add", F.transform(head, lambda x: x - mean)).when(
        season == "mul", F.transform(head, lambda x: F.try_divide(x, mean))).otherwise(F.array().cast("array<double>"))
    first, second = F.try_element_at(values, F.lit(1)), F.coalesce(F.try_element_at(values, F.lit(2)), F.try_element_at(values, F.lit(1)))
    # with a season the slope starts flat: the first values differ by their seasonal parts
    slope = F.when(F.col("c.trend") == "mul", F.when(seasonal, 1.0).otherwise(F.try_divide(second, first))).otherwise(
        F.when(seasonal, 0.0).otherwise(second - first))
    return F.struct(F.when(seasonal, mean).otherwise(first).alias("level"), slope.alias("slope"), parts.alias("season"),
                    F.array().cast("array<double>").alias("levels"))


def _fold(values: Column, season: Column, length: Column, keep_levels: bool) -> Column:
    """The state after all values; with ``keep_levels`` also the level after each.

    Levels are gathered in pieces of CHUNK values that are put together at the end, so that the time grows
    with the length of the series and not with its square.
    """
    trend, alpha, beta = F.col("c.trend"), F.col("c.alpha"), F.col("c.beta")
    gamma, phi = F.col("c.gamma"), F.col("c.phi")

    def step(s, x):
        part = F.get(s["season"], F.lit(0))
        damped = F.when(trend == "mul", F.pow(s["slope"], phi)).otherwise(s["slope"] * phi)
        base = F.when(trend == "None", s["level"]).when(trend == "add", s["level"] + damped).otherwise(s["level"] * damped)
        bare = F.when(season == "add", x - part).when(season == "mul", F.try_divide(x, part)).otherwise(x)
        level = alpha * bare + (1 - alpha) * base
        slope = F.when(trend == "None", s["slope"]).when(
            trend == "add", beta * (level - s["level"]) + (1 - beta) * damped).otherwise(
            beta * F.try_divide(level, s["level"]) + (1 - beta) * damped)
        fresh = F.when(season == "add", gamma * (x - base) + (1 - gamma) * part).otherwise(
            gamma * F.try_divide(x, base) + (1 - gamma) * part)
        rotated = F.when(season == "None", s["season"]).otherwise(
            F.concat(F.slice(s["season"], F.lit(2), F.size(s["season"])), F.array(fresh)))
        levels = F.concat(s["levels"], F.array(level)) if keep_levels else s["levels"]
        return F.struct(level.alias("level"), slope.alias("slope"), rotated.alias("season"), levels.alias("levels"))

    start = _start(values, season, length)
    if not keep_levels:
        return F.aggregate(values, start, step)
    none = F.array().cast("array<double>")
    firsts = F.when(F.size(values) > 0, F.sequence(F.lit(1), F.size(values), F.lit(CHUNK))).otherwise(F.array().cast("array<int>"))

    def piece(s, first):
        begin = F.struct(s["level"].alias("level"), s["slope"].alias("slope"), s["season"].alias("season"), none.alias("levels"))
        done = F.aggregate(F.slice(values, first, F.lit(CHUNK)), begin, step)
        # one element, so that the fold is named once and its parts are taken from it
        return F.transform(F.array(done), lambda d: F.struct(
            d["level"].alias("level"), d["slope"].alias("slope"), d["season"].alias("season"), F.concat(s["pieces"], F.array(d["levels"])).alias("pieces")))[0]

    opened = F.struct(start["level"].alias("level"), start["slope"].alias("slope"), start["season"].alias("season"), F.array().cast("array<array<double>>").alias("pieces"))
    return F.transform(F.array(F.aggregate(firsts, opened, piece)), lambda s: F.struct(
        s["level"].alias("level"), s["slope"].alias("slope"), s["season"].alias("season"), F.flatten(s["pieces"]).alias("levels")))[0]


def _ahead(state: Column, season: Column, steps: Column) -> Column:
    """Array of forecasts for 1 .. steps."""
    trend, phi = F.col("c.trend"), F.col("c.phi")

    def at(h):
        reach = F.when(phi == 1, h.cast("double")).otherwise(phi * (1 - F.pow(phi, h)) / (1 - phi))
        base = F.when(trend == "None", state["level"]).when(trend == "add", state["level"] + reach * state["slope"]).otherwise(
            state["level"] * F.pow(state["slope"], reach))
        part = F.get(state["season"], ((h - 1) % F.greatest(F.size(state["season"]), F.lit(1))).cast("int"))
        return F.when(season == "add", base + part).when(season == "mul", base * part).otherwise(base)

    return F.when(steps >= 1, F.transform(F.sequence(F.lit(1), F.greatest(steps, F.lit(1)).cast("int")), at)).otherwise(
        F.array().cast("array<double>"))


def choose_smoothing(series: DataFrame, keys: Sequence[str], season: DataFrame, grid: list[dict] | None = None) -> DataFrame:
    """Best candidate per series by squared error on the last fifth.

    ``season`` has the keys, ``seasonality`` (add, mul or None) and ``season_length``.  A
    multiplicative trend is tried only where all values are positive.  Series with an empty
    bucket are not smoothed and are left out.
    """
    grid = grid or candidates()
    fields = ", ".join(f"{n} {k}" for n, k in (("trend", "string"), ("damped", "boolean"), ("alpha", "double"), ("beta", "double"), ("gamma", "double"), ("phi", "double")))
    listed = F.array(*[F.struct(*[F.lit(v).alias(k) for k, v in c.items()]) for c in grid]).cast(f"array<struct<{fields.replace(' ', ':').replace(',:', ',')}>>")
    rows = series_arrays(series, keys).filter("complete").join(season, list(keys))
    # without a season the seasonal constant has no effect: one value is enough
    one = F.lit(min(c["gamma"] for c in grid))
    listed = F.filter(listed, lambda c: ((c["trend"] != "mul") | (F.col("lowest") > 0)) & ((F.col("seasonality") != "None") | (c["gamma"] == one)))
    # a few copies of each series share its candidates, so few series still fill the cluster
    rows = rows.withColumn("copy", F.explode(F.sequence(F.lit(0), F.lit(COPIES - 1)))).repartition(*keys, "copy")
    tried = rows.withColumn("c", F.explode(F.filter(listed, lambda c, i: i % COPIES == F.col("copy"))))
    size = F.size("values")
    train = F.bround(size * F.lit(TRAIN_SHARE)).cast("int")
    kind, length = F.col("seasonality"), F.col("season_length")
    tried = tried.withColumn("state", _fold(F.slice("values", F.lit(1), train), kind, length, False))
    ahead = _ahead(F.col("state"), kind, size - train)
    wrong = F.zip_with(F.slice("values", train + 1, F.greatest(size, F.lit(1))), ahead, lambda a, b: (a - b) * (a - b))
    tried = tried.withColumn("sse", F.aggregate(wrong, F.lit(0.0), lambda a, x: a + x))
    order = F.struct("sse", "c.trend", "c.damped", "c.alpha", "c.beta", "c.gamma", "c.phi")
    # invalid scores become null inside the aggregate; a filter here would compute the fold twice
    scored = F.when(F.col("sse").isNotNull() & ~F.isnan("sse"), F.struct(order.alias("o"), F.col("c")))
    return tried.groupBy(*keys, "seasonality", "season_length").agg(F.min(scored).alias("best")).filter("best is not null").select(
        *keys, "seasonality", "season_length", "best.c.*", "best.o.sse")


def smooth(series: DataFrame, keys: Sequence[str], best: DataFrame) -> DataFrame:
    """Chosen candidates run over the whole history: keys, values, last_b, levels and forecasts.

    The forecast covers a quarter of the history, rounded up, after the last actual value.
    """
    packed = best.select(*keys, "seasonality", "season_length", F.struct("trend", "damped", "alpha", "beta", "gamma", "phi").alias("c"))
    rows = series_arrays(series, keys).join(packed, list(keys), "left")
    state = _fold(F.col("values"), F.col("seasonality"), F.col("season_length"), True)
    rows = rows.withColumn("state", F.when(F.col("c").isNotNull(), state))
    steps = F.ceil(F.size("values") / 4).cast("int")
    ahead = F.when(F.col("c").isNotNull(), _ahead(F.col("state"), F.col("seasonality"), steps))
    last = F.element_at("values", -1)
    return rows.select(*keys, "values", "last_b", "c", F.col("state.levels").alias("levels"),
                       F.concat(F.array(last), F.coalesce(ahead, F.array().cast("array<double>"))).alias("forecasts"))


def forecast_rows(smoothed: DataFrame, keys: Sequence[str], freq: str) -> DataFrame:
    """Step 0 repeats the last actual value; later steps are forecasts."""
    return smoothed.select(*keys, "last_b", F.posexplode("forecasts").alias("step", "forecast")).select(
        *keys, "step", bucket_label(F.col("last_b") + F.col("step"), freq).alias("bucket"), "forecast")


def level_parts(smoothed: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Without a season: trend is the smoothed level, the residual what is left."""
    zipped = F.arrays_zip(F.col("values").alias("value"), F.col("levels").alias("level"))
    return smoothed.filter(F.col("levels").isNotNull()).select(*keys, F.posexplode(zipped).alias("idx", "z")).select(
        *keys, "idx", F.col("z.value").alias("original"), F.col("z.level").alias("trend"),
        F.lit(None).cast("double").alias("seasonality"), (F.col("z.value") - F.col("z.level")).alias("residual"))


# Wording of the model summary.
TREND_TEXT = {
    "add": "Additive - overall amplitude of residuals is constant",
    "mul": "Multiplicative - overall amplitude of residuals varies with the level of the underlying variable",
    None: "None - no overall additive or multiplicative effects"}
SEASON_TEXT = {
    "add": "Additive - amplitude of seasonal effects is constant",
    "mul": "Multiplicative - amplitude of seasonal effects varies with the level of the underlying variable",
    None: "None - no seasonal effects"}


def _worded(column: Column, text: dict) -> Column:
    return F.when(column == "add", text["add"]).when(column == "mul", text["mul"]).otherwise(text[None])


def model_summary(best: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The chosen model in words."""
    trend, season = F.col("trend"), F.col("seasonality")
    has_trend, has_season = trend.isin("add", "mul"), season.isin("add", "mul")
    return best.select(
        *keys, _worded(trend, TREND_TEXT).alias("trend"),
        F.when(has_trend & F.col("damped"), "Y").when(has_trend, "N").otherwise("N/A").alias("damped"),
        _worded(season, SEASON_TEXT).alias("seasonality"),
        F.when(has_season, F.col("season_length").cast("string")).otherwise("N/A").alias("periods"))


def forecast_lines(history: DataFrame, forecasts: DataFrame, keys: Sequence[str]) -> DataFrame:
    """History and forecast under one another with a label: keys, kind, bucket, value."""
    return history.select(*keys, F.lit("history").alias("kind"), "bucket", "value").unionByName(
        forecasts.select(*keys, F.lit("forecast").alias("kind"), "bucket", F.col("forecast").alias("value")))


def latest_results(results: DataFrame, keys: Sequence[str], run: str) -> DataFrame:
    """Only the rows of each key's latest run."""
    newest = results.groupBy(*keys).agg(F.max(run).alias(run))
    return results.join(newest, [*keys, run], "left_semi")


def run_missing(pairs: DataFrame, done: DataFrame | None, keys: Sequence[str]) -> DataFrame:
    """Pairs that have no result yet."""
    return pairs if done is None else pairs.join(done.select(*keys).distinct(), list(keys), "left_anti")


# ---- trend with yearly and weekly cycles --------------------------------------------------

def cycle_terms(day: Column, yearly: int = 3, weekly: int = 2) -> dict[str, Column]:
    """Linear time and sine/cosine pairs of the year and the week."""
    number = F.unix_date(day).cast("double")
    terms = {"t": number / 365.25}
    for name, length, order in (("y", 365.25, yearly), ("w", 7.0, weekly)):
        for k in range(1, order + 1):
            angle = number * (2 * 3.141592653589793 * k / length)
            terms[f"{name}_sin{k}"], terms[f"{name}_cos{k}"] = F.sin(angle), F.cos(angle)
    return terms


def trend_forecast(daily: DataFrame, ahead: int = 365) -> DataFrame:
    """Least squares of a daily series (day, value) on trend and cycles, with ``ahead`` future days.

    Columns: day, kind (history or forecast), value, fitted.
    """
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.regression import LinearRegression

    terms = cycle_terms(F.col("day"))
    known = daily.filter(F.col("value").isNotNull())
    model = LinearRegression(featuresCol="features", labelCol="value", predictionCol="fitted", solver="normal")
    assemble = VectorAssembler(inputCols=list(terms), outputCol="features")
    fitted = model.fit(assemble.transform(known.select("value", *[e.alias(n) for n, e in terms.items()])))
    last = daily.agg(F.max("day").alias("last"))
    future = last.select(F.explode(F.sequence(F.date_add("last", 1), F.date_add("last", ahead))).alias("day"))
    rows = daily.select("day", F.lit("history").alias("kind"), "value").unionByName(
        future.select("day", F.lit("forecast").alias("kind"), F.lit(None).cast("double").alias("value")))
    rows = assemble.transform(rows.select("day", "kind", "value", *[e.alias(n) for n, e in terms.items()]))
    return fitted.transform(rows).select("day", "kind", "value", "fitted")
