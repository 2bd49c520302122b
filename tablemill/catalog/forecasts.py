"""Forecasting jobs (T12-T16)."""

from pyspark.sql import functions as F

from tablemill.catalog.timeseries import STATISTICS, acf_sql
from tablemill.functions.numbers import money
from tablemill.operators.joining import union_all
from tablemill.plans import results
from tablemill.plans import series as ts
from tablemill.plans import smoothing as sm
from tablemill.registry import job
from tablemill.session import stage


def monthly(t):
    rows = t.orders.select(F.col("o_orderstatus").alias("k"), "o_orderdate", money("o_totalprice").alias("v"))
    return stage(ts.resample(rows, ["k"], "o_orderdate", "v", "MS"), "monthly")


def season_of(series):
    return results.season_of(series, ["k"], ts.PERIODS["MS"])


def smoothed(t):
    series = monthly(t)
    best = stage(sm.choose_smoothing(series, ["k"], season_of(series)), "smoothing")
    return series, best


@job("t12_smoothing_forecast")
def smoothing_forecast(t):
    series, best = smoothed(t)
    rows = sm.forecast_rows(sm.smooth(series, ["k"], best), ["k"], "MS")
    # a series that could not be smoothed keeps its last value and has no model
    return rows.join(best.select("k", "trend", "damped", "seasonality", "sse"), "k", "left")


LEVELS = """
    WITH RECURSIVE kg AS (SELECT o_orderstatus AS k, year(o_orderdate) * 12 + month(o_orderdate) AS b, CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) / count(*) AS value FROM orders GROUP BY ALL),
      g AS (SELECT k, value, b - min(b) OVER (PARTITION BY k) AS idx FROM (SELECT k, unnest(generate_series(min(b), max(b))) AS b FROM kg GROUP BY k) LEFT JOIN kg USING (k, b)),
      s AS (SELECT k, list(value ORDER BY idx) AS v, count(*) AS n, CAST(round_even(count(*) * 0.8, 0) AS INTEGER) AS train FROM g GROUP BY k HAVING count(*) = count(value)),
      c AS (SELECT trend, damped, alpha::DOUBLE AS alpha, beta::DOUBLE AS beta, phi::DOUBLE AS phi FROM (VALUES ('None', false), ('add', false), ('add', true), ('mul', false), ('mul', true)) t(trend, damped),
              (VALUES (0.2), (0.5), (0.8)) a(alpha), (VALUES (0.0), (0.1), (0.3)) b(beta), (VALUES (1.0), (0.8), (0.95)) p(phi)
            WHERE (trend = 'None') = (beta = 0) AND damped = (phi < 1)),
      f AS (SELECT k, v, n, train, c.*, 0 AS i, v[1] AS level, CASE WHEN trend = 'mul' THEN coalesce(v[2], v[1]) / v[1] ELSE coalesce(v[2], v[1]) - v[1] END AS slope
            FROM s, c WHERE trend <> 'mul' OR list_min(v) > 0
            UNION ALL
            SELECT k, v, n, train, trend, damped, alpha, beta, phi, i + 1, now,
              CASE trend WHEN 'None' THEN slope WHEN 'add' THEN beta * (now - level) + (1 - beta) * eased ELSE beta * (now / level) + (1 - beta) * eased END
            FROM (SELECT *, alpha * v[i + 1] + (1 - alpha) * CASE trend WHEN 'None' THEN level WHEN 'add' THEN level + eased ELSE level * eased END AS now
                  FROM (SELECT *, CASE trend WHEN 'mul' THEN pow(slope, phi) ELSE slope * phi END AS eased FROM f WHERE i < n))),
      e AS (SELECT k, trend, damped, alpha, beta, phi, unnest(generate_series(1, n - train)) AS h, v, train, level, slope FROM f WHERE i = train),
      w AS (SELECT k, trend, damped, alpha, beta, phi, sum(pow(v[train + h] - CASE trend WHEN 'None' THEN level WHEN 'add' THEN level + reach * slope ELSE level * pow(slope, reach) END, 2)) AS sse
            FROM (SELECT *, CASE WHEN phi = 1 THEN h::DOUBLE ELSE phi * (1 - pow(phi, h)) / (1 - phi) END AS reach FROM e) GROUP BY ALL),
      best AS (SELECT * FROM w QUALIFY row_number() OVER (PARTITION BY k ORDER BY sse, trend, damped, alpha, beta, phi) = 1)"""


@job("t13_level_parts", LEVELS + """
    SELECT k, i - 1 AS idx, round(v[i], 4) AS original, round(level, 4) AS trend, CAST(NULL AS DOUBLE) AS seasonality, round(v[i] - level, 4) AS residual
    FROM f JOIN best USING (k, trend, damped, alpha, beta, phi) WHERE i > 0""")
def level_parts(t):
    series = monthly(t)
    none = series.select("k").distinct().select("k", F.lit("None").alias("seasonality"), F.lit(2).cast("long").alias("season_length"))
    best = stage(sm.choose_smoothing(series, ["k"], none), "smoothing")
    parts = sm.level_parts(sm.smooth(series, ["k"], best), ["k"])
    # a mean of cents can lie half way: scaled first, the double itself decides and not its shortest text
    return parts.withColumns({c: F.round(F.col(c) * 10_000) / 10_000 for c in ("original", "trend", "residual")})


@job("t14_run_missing", f"WITH {STATISTICS} SELECT * FROM st JOIN choice USING (k)")
def run_missing(t):
    """Two runs that append to one table: the first does the even users, the second finds the rest."""
    rows = t.events.select(F.col("user_id").alias("k"), "ts", money("value").alias("v"), "event_id")
    path = t.scratch("series-results")
    pairs = rows.select("k").distinct()
    done = None
    for wanted in (pairs.filter("k % 2 = 0"), pairs):
        todo = stage(sm.run_missing(wanted, done, ["k"]), "pairs")
        stats = ts.series_statistics(rows.join(todo, "k", "left_semi"), ["k"], "ts", "v", "event_id")
        stats.write.mode("append").parquet(path)
        done = t.spark.read.schema(stats.schema).parquet(path)
    return done


def appended(t):
    """The results of the monthly series, appended by two runs of which the second finds what is missing."""
    series = monthly(t)
    store = results.ResultStore(t.spark, t.scratch("series-results"), ["k"])
    pairs = series.select("k").distinct()
    for wanted in (pairs.filter("k = 'F'"), pairs):
        store.run_missing(wanted, lambda todo: results.series_results(series.join(todo, "k", "left_semi"), ["k"], "MS"))
    return store


@job("t14_appended_acf", f"""
    WITH kg AS (SELECT o_orderstatus AS k, year(o_orderdate) * 12 + month(o_orderdate) AS b, CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) / count(*) AS value FROM orders GROUP BY ALL),
      s AS (SELECT k, value, b - min(b) OVER (PARTITION BY k) AS idx FROM (SELECT k, unnest(generate_series(min(b), max(b))) AS b FROM kg GROUP BY k) LEFT JOIN kg USING (k, b)),
      {acf_sql('s', 'a')} SELECT k, lag, lag - 1 AS lag0, round(acf, 6) AS acf FROM a""")
def appended_acf(t):
    return appended(t).read("acf").withColumn("acf", F.round("acf", 6))


@job("t14_appended_results")
def appended_results(t):
    """Parts, forecasts and models of all runs as one table of texts and numbers."""
    store = appended(t)
    text = F.lit(None).cast("string")
    trends = store.read("trends").select("k", F.lit("trends").alias("kind"), F.col("idx").cast("string").alias("at"), F.col("trend").alias("value"), text.alias("words"))
    forecast = store.read("forecast").select("k", F.lit("forecast").alias("kind"), F.date_format("bucket", "yyyy-MM-dd").alias("at"), F.col("forecast").alias("value"), text.alias("words"))
    models = store.read("best_model").select("k", F.lit("best_model").alias("kind"), text.alias("at"), F.lit(None).cast("double").alias("value"),
                                             F.concat_ws(" | ", "trend", "damped", "seasonality", "periods").alias("words"))
    return union_all([trends, forecast, models])


@job("t15_trend_forecast")
def trend_forecast(t):
    daily = t.orders.groupBy(F.col("o_orderdate").cast("date").alias("day")).agg((F.sum(money("o_totalprice")).cast("double") / F.count(F.lit(1))).alias("value"))
    low = t.orders.filter("o_orderpriority = '5-LOW'").groupBy(F.col("o_orderdate").cast("date").alias("day")).agg(
        (F.sum(money("o_totalprice")).cast("double") / F.count(F.lit(1))).alias("value"))
    parts = [sm.trend_forecast(stage(d, "daily")).select(F.lit(n).alias("part"), "*") for n, d in (("all", daily), ("5-LOW", low))]
    return union_all(parts).withColumn("day", F.date_format("day", "yyyy-MM-dd"))


def _models(t):
    key = F.col("c_custkey")
    return t.customer.select(
        "c_custkey", F.element_at(F.array(F.lit("add"), F.lit("mul"), F.lit("None")), (key % 3 + 1).cast("int")).alias("trend"), (key % 2 == 0).alias("damped"),
        F.element_at(F.array(F.lit("mul"), F.lit("None"), F.lit("add")), (F.col("c_nationkey") % 3 + 1).cast("int")).alias("seasonality"),
        (F.col("c_nationkey") + 2).alias("season_length"))


@job("t16_model_summary", """
    WITH words AS (SELECT unnest(['add', 'mul', 'None']) AS kind,
        unnest(['Additive - overall amplitude of residuals is constant', 'Multiplicative - overall amplitude of residuals varies with the level of the underlying variable',
                'None - no overall additive or multiplicative effects']) AS trend_text,
        unnest(['Additive - amplitude of seasonal effects is constant', 'Multiplicative - amplitude of seasonal effects varies with the level of the underlying variable',
                'None - no seasonal effects']) AS season_text),
      m AS (SELECT c_custkey, ['add', 'mul', 'None'][c_custkey % 3 + 1] AS t, c_custkey % 2 = 0 AS d, ['mul', 'None', 'add'][c_nationkey % 3 + 1] AS s, c_nationkey + 2 AS n FROM customer)
    SELECT c_custkey, a.trend_text AS trend, CASE WHEN t = 'None' THEN 'N/A' WHEN d THEN 'Y' ELSE 'N' END AS damped, b.season_text AS seasonality,
      CASE WHEN s = 'None' THEN 'N/A' ELSE CAST(n AS VARCHAR) END AS periods
    FROM m JOIN words a ON a.kind = t JOIN words b ON b.kind = s""")
def model_summary(t):
    return sm.model_summary(_models(t), ["c_custkey"])


@job("t16_forecast_lines", """
    WITH m AS (SELECT o_orderstatus AS k, year(o_orderdate) AS y, CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) / count(*) AS value FROM orders GROUP BY ALL)
    SELECT k, 'history' AS kind, CAST(y AS VARCHAR) AS bucket, value FROM m UNION ALL
    SELECT k, 'forecast', CAST(max(y) + 1 AS VARCHAR), max_by(value, y) FROM m GROUP BY k""")
def forecast_lines(t):
    rows = t.orders.select(F.col("o_orderstatus").alias("k"), "o_orderdate", money("o_totalprice").alias("v"))
    history = ts.resample(rows, ["k"], "o_orderdate", "v", "YS").withColumn("bucket", F.date_format("bucket", "yyyy"))
    # the flat forecast of one year, stored by an older and a newer run; the newer one counts
    last = history.groupBy("k").agg(F.max(F.struct("b", "value")).alias("x"))
    runs = union_all([last.select("k", F.lit(run).alias("run"), (F.col("x.b") + 1).cast("string").alias("bucket"), (F.col("x.value") * factor).alias("forecast"))
                      for run, factor in ((1, 2.0), (2, 1.0))])
    return sm.forecast_lines(history, sm.latest_results(runs, ["k"], "run"), ["k"])


@job("t16_fitted_summary")
def fitted_summary(t):
    """The models that the smoothing chose, in words."""
    return sm.model_summary(smoothed(t)[1], ["k"])


@job("t16_fitted_lines")
def fitted_lines(t):
    """History and the forecasts of the chosen models under one another."""
    series, best = smoothed(t)
    forecasts = sm.forecast_rows(sm.smooth(series, ["k"], best), ["k"], "MS").filter("step > 0")
    return sm.forecast_lines(series, forecasts, ["k"])
