"""Time series jobs (W01-W03, T01-T11)."""

from pyspark.sql import functions as F

from tablemill.functions.numbers import money
from tablemill.operators.joining import union_all
from tablemill.plans import series as ts
from tablemill.registry import job


def bucket_sql(freq, at):
    day = f"date_diff('day', DATE '1970-01-01', {at}::DATE)"
    return {
        "H": f"CAST(floor(epoch({at}) / 3600) AS BIGINT)", "D": day, "W": f"CAST(floor(({day} - 4) / 7.0) AS BIGINT)",
        "MS": f"(year({at}) * 12 + month({at}) - 1)", "QS": f"(year({at}) * 4 + quarter({at}) - 1)", "YS": f"year({at})"}[freq]


def label_sql(freq, b):
    epoch = "DATE '1970-01-01'"
    return {
        "H": f"make_timestamp({b} * 3600 * 1000000)", "D": f"({epoch} + CAST({b} AS INTEGER))::TIMESTAMP",
        "W": f"({epoch} + CAST({b} * 7 + 10 AS INTEGER))::TIMESTAMP", "MS": f"make_date({b} // 12, {b} % 12 + 1, 1)::TIMESTAMP",
        "QS": f"make_date({b} // 4, {b} % 4 * 3 + 1, 1)::TIMESTAMP", "YS": f"make_date({b}, 1, 1)::TIMESTAMP"}[freq]


def series_sql(table, key, at, value, freq, name="s"):
    """CTEs for one regular series per key."""
    return f"""{name}_g AS (SELECT {key} AS k, {bucket_sql(freq, at)} AS b, CAST(sum(CAST({value} AS DECIMAL(18,2))) AS DOUBLE) / count(*) AS value
                            FROM {table} GROUP BY ALL),
      {name} AS (SELECT k, b, value, b - min(b) OVER (PARTITION BY k) AS idx FROM
               (SELECT k, unnest(generate_series(min(b), max(b))) AS b FROM {name}_g GROUP BY k) LEFT JOIN {name}_g USING (k, b))"""


RESAMPLED = (("events", "event_type", "ts", "value", "H"), ("events", "event_type", "ts", "value", "D"),
             ("orders", "o_orderstatus", "o_orderdate", "o_totalprice", "W"), ("orders", "o_orderstatus", "o_orderdate", "o_totalprice", "MS"),
             ("orders", "o_orderstatus", "o_orderdate", "o_totalprice", "QS"), ("orders", "o_custkey % 7", "o_orderdate", "o_totalprice", "D"),
             ("orders", "o_orderstatus", "o_orderdate", "o_totalprice", "YS"))


@job("t01_resample", " UNION ALL ".join(
    f"""(WITH {series_sql(*args)} SELECT '{args[4]}' AS period, CAST(k AS VARCHAR) AS series, strftime({label_sql(args[4], 'b')}, '%Y-%m-%d %H') AS bucket, value FROM s)"""
    for args in RESAMPLED))
def resample(t):
    parts = []
    for table, key, at, value, freq in RESAMPLED:
        rows = getattr(t, table).select(F.expr(key).cast("string").alias("series"), at, money(value).alias("v"))
        parts.append(ts.resample(rows, ["series"], at, "v", freq).select(
            F.lit(freq).alias("period"), "series", F.date_format("bucket", "yyyy-MM-dd HH").alias("bucket"), "value"))
    return union_all(parts)


def _all_frequencies(source):
    every = " UNION ALL ".join(f"SELECT k, i, n, '{f}' AS freq, {ts.RANKS[f]} AS rank, {bucket_sql(f, 'tm')} AS b FROM raw" for f in ts.FREQUENCIES)
    return f"raw AS ({source}), fr AS ({every})"


RAW_EVENTS = "SELECT user_id AS k, ts AS tm, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS i, count(*) OVER (PARTITION BY user_id) AS n FROM events"
RAW_ORDERS = "SELECT -1 - o_custkey % 3 AS k, o_orderdate AS tm, row_number() OVER (PARTITION BY o_custkey % 3 ORDER BY o_orderdate, o_orderkey) - 1 AS i, count(*) OVER (PARTITION BY o_custkey % 3) AS n FROM orders"
NAMES = "CASE {r} " + " ".join(f"WHEN {r} THEN '{f}'" for f, r in ts.RANKS.items()) + " END"


@job("t02_best_frequency", f"""
    WITH {_all_frequencies(RAW_EVENTS + ' UNION ALL ' + RAW_ORDERS)},
      g AS (SELECT k, freq, rank, count(DISTINCT b) AS nb, max(b) - min(b) + 1 AS span FROM fr GROUP BY ALL)
    SELECT k, {NAMES.format(r='coalesce(max(rank) FILTER (nb = span AND nb >= 3), 0)')} AS period FROM g GROUP BY k""")
def best_frequency(t):
    users = t.events.select(F.col("user_id").alias("k"), F.col("ts").alias("at"))
    groups = t.orders.select((-1 - F.col("o_custkey") % 3).alias("k"), F.col("o_orderdate").alias("at"))
    return ts.best_frequency(ts.hourly(users.unionByName(groups), ["k"], "at"), ["k"])


TRIM = f"""
      gaps AS (SELECT k, freq, i FROM (SELECT *, lead(b) OVER (PARTITION BY k, freq ORDER BY i) - b AS d FROM fr) WHERE d > 1),
      sz AS (SELECT DISTINCT k, n, CAST(least(20, round_even(0.2 * n, 0)) AS BIGINT) AS m FROM raw),
      cand AS (SELECT k, n, f, l, false AS is_target FROM (SELECT k, n, m, unnest(generate_series(0, m)) AS f FROM sz) JOIN
                 (SELECT k, unnest(generate_series(0, m)) AS l FROM sz) USING (k) UNION ALL SELECT k, n, m + 1, m + 1, true FROM sz),
      ok AS (SELECT c.k, c.f, c.l, c.is_target, a.rank FROM cand c JOIN fr a ON a.k = c.k AND a.i = c.f
               JOIN fr z ON z.k = c.k AND z.freq = a.freq AND z.i = c.n - 1 - c.l
             WHERE c.f + c.l < c.n AND z.b - a.b + 1 >= 3 AND NOT EXISTS
               (SELECT 1 FROM gaps g WHERE g.k = c.k AND g.freq = a.freq AND g.i >= c.f AND g.i <= c.n - c.l - 2)),
      best AS (SELECT c.k, c.f, c.l, c.is_target, coalesce(max(o.rank), 0) AS rank FROM cand c LEFT JOIN ok o USING (k, f, l, is_target) GROUP BY ALL),
      run AS (SELECT *, max(rank) OVER w AS best, row_number() OVER w AS c FROM best WHERE NOT is_target WINDOW w AS (PARTITION BY k ORDER BY l, f)),
      stop AS (SELECT run.k, min(c) AS c FROM run JOIN (SELECT k, rank AS target FROM best WHERE is_target) t ON t.k = run.k
               WHERE best = target OR best = 5 GROUP BY run.k),
      seen AS (SELECT run.* FROM run LEFT JOIN stop ON stop.k = run.k WHERE run.c <= coalesce(stop.c, 1000000)),
      top AS (SELECT k, max(rank) AS top FROM seen GROUP BY k),
      choice AS (SELECT seen.k, {NAMES.format(r='any_value(top)')} AS period, CASE WHEN any_value(top) = 0 THEN 0 ELSE min_by(f, c) END AS drop_first,
                   CASE WHEN any_value(top) = 0 THEN 0 ELSE min_by(l, c) END AS drop_last
                 FROM seen JOIN top USING (k) WHERE rank = top GROUP BY seen.k)"""


@job("t03_best_trim", f"WITH {_all_frequencies(RAW_EVENTS)}, {TRIM} SELECT * FROM choice")
def best_trim(t):
    users = t.events.select(F.col("user_id").alias("k"), F.col("ts").alias("at"))
    return ts.best_trim(ts.hourly(users, ["k"], "at"), ["k"])


def stats_sql(series):
    """CTEs ``st``: control statistics of the CTE ``series`` (k, idx, value)."""
    runs = []
    for name, down, up in (("step", "decr", "incr"), ("side", "blw_mn", "abv_mn"), ("beyond", "blw_lcl", "abv_ucl")):
        runs.append(f"count(*) FILTER ({name} < 0 AND idx > {name}_nd) AS {down}, count(*) FILTER ({name} > 0 AND idx > {name}_nu) AS {up}")
    lasts = ", ".join(f"coalesce(max(CASE WHEN {n} >= 0 THEN idx END) OVER (PARTITION BY k), -1) AS {n}_nd, "
                      f"coalesce(max(CASE WHEN {n} <= 0 THEN idx END) OVER (PARTITION BY k), -1) AS {n}_nu" for n in ("step", "side", "beyond"))
    return f"""st_m AS (SELECT k, CASE WHEN count(value) = count(*) THEN avg(value) END AS mean, CASE WHEN count(value) = count(*) THEN stddev_samp(value) END AS std
                 FROM {series} GROUP BY k),
      st_a AS (SELECT s.k, idx, value, nullif(sign(value - lag(value) OVER (PARTITION BY s.k ORDER BY idx)), 0) AS step, nullif(sign(value - mean), 0) AS side,
                 CASE WHEN std = 0 THEN NULL WHEN value <= mean - 3 * std THEN -1 WHEN value >= mean + 3 * std THEN 1
                      WHEN value > mean - 3 * std AND value < mean + 3 * std THEN 0 END AS beyond FROM {series} s JOIN st_m ON st_m.k = s.k),
      st_b AS (SELECT *, {lasts} FROM st_a),
      st AS (SELECT k, count(*) AS nobs, {', '.join(runs)} FROM st_b GROUP BY k)"""


@job("w01_w03_control_runs", f"""
    WITH {series_sql('events', 'event_type', 'ts', 'value', 'H', 'e')}, {series_sql('orders', 'o_orderpriority', 'o_orderdate', 'o_totalprice', 'W', 'o')},
      s AS (SELECT k, idx, value FROM e UNION ALL SELECT k, idx, value FROM o), {stats_sql('s')} SELECT * FROM st""")
def control_runs(t):
    hours = ts.resample(t.events.select(F.col("event_type").alias("k"), "ts", money("value").alias("v")), ["k"], "ts", "v", "H")
    weeks = ts.resample(t.orders.select(F.col("o_orderpriority").alias("k"), "o_orderdate", money("o_totalprice").alias("v")), ["k"], "o_orderdate", "v", "W")
    return ts.control_statistics(hours.unionByName(weeks).select("k", "idx", "value"), ["k"])


STATISTICS = f"""{_all_frequencies(RAW_EVENTS)}, {TRIM},
      kept AS (SELECT r.k, r.period, r.b, e.value FROM (SELECT user_id, ts, event_id, value, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS i FROM events) e
               JOIN (SELECT fr.k, fr.i, fr.b, choice.period FROM fr JOIN choice ON choice.k = fr.k AND choice.period = fr.freq
                     WHERE fr.i >= drop_first AND fr.i < fr.n - drop_last) r ON r.k = e.user_id AND r.i = e.i),
      kg AS (SELECT k, b, CAST(sum(CAST(value AS DECIMAL(18,2))) AS DOUBLE) / count(*) AS value FROM kept GROUP BY ALL),
      s AS (SELECT k, value, b - min(b) OVER (PARTITION BY k) AS idx FROM (SELECT k, unnest(generate_series(min(b), max(b))) AS b FROM kg GROUP BY k)
            LEFT JOIN kg USING (k, b)), {stats_sql('s')}"""


@job("t04_series_statistics", f"WITH {STATISTICS} SELECT * FROM st JOIN choice USING (k)")
def series_statistics(t):
    rows = t.events.select(F.col("user_id").alias("k"), "ts", money("value").alias("v"), "event_id")
    return ts.series_statistics(rows, ["k"], "ts", "v", "event_id")


FAR = """SELECT o_orderkey, o_custkey % 5 AS k, CAST(o_totalprice AS DECIMAL(18,2)) AS v,
    CASE WHEN o_custkey % 5 = 1 AND o_orderkey % 2 = 0 THEN make_date(year(o_orderdate) - 700, month(o_orderdate), 1) ELSE make_date(year(o_orderdate), month(o_orderdate), 1) END AS tm FROM orders"""


@job("t05_sparse_guard", f"""
    WITH x AS ({FAR}), y AS (SELECT k, max(year(tm)) - min(year(tm)) + 1 AS years, count(DISTINCT year(tm)) AS seen FROM x GROUP BY k)
    SELECT k, years > 500 + seen AS sparse, CASE WHEN years > 500 + seen THEN years END AS nobs_if_sparse, CASE WHEN years > 500 + seen THEN 'YS' END AS period_if_sparse FROM y""")
def sparse_guard(t):
    first = F.make_date(F.year("o_orderdate") - F.when((F.col("o_custkey") % 5 == 1) & (F.col("o_orderkey") % 2 == 0), 700).otherwise(0), F.month("o_orderdate"), F.lit(1))
    rows = t.orders.select("o_orderkey", (F.col("o_custkey") % 5).alias("k"), money("o_totalprice").alias("v"), first.alias("at"))
    sparse = ts.empty_years(ts.hourly(rows, ["k"], "at"), ["k"]).select("k", (F.col("empty") > ts.MAX_EMPTY_YEARS).alias("sparse"))
    stats = ts.series_statistics(rows, ["k"], "at", "v", "o_orderkey").join(sparse, "k")
    return stats.select("k", "sparse", F.when(F.col("sparse"), F.col("nobs")).alias("nobs_if_sparse"), F.when(F.col("sparse"), F.col("period")).alias("period_if_sparse"))


@job("t06_select_series", f"""
    WITH {STATISTICS}, r AS (SELECT k % 3 AS tc, k, unnest(['decr', 'incr', 'blw_mn', 'abv_mn', 'blw_lcl', 'abv_ucl']) AS rule,
        unnest([decr - 2, incr - 2, blw_mn - 2, abv_mn - 2, blw_lcl, abv_ucl]) AS run FROM st)
    SELECT DISTINCT tc AS time_variable, k AS feature FROM r WHERE run > 0 QUALIFY row_number() OVER (PARTITION BY tc, rule ORDER BY run DESC, k) <= 2""")
def select_series(t):
    """The short test series rarely run past 7, so the runs are lengthened by 5 before the rules apply."""
    stats = series_statistics(t).withColumns({c: F.col(c) + 5 for c in ("decr", "incr", "blw_mn", "abv_mn")})
    return ts.select_series(stats.select((F.col("k") % 3).alias("time_variable"), F.col("k").alias("feature"), *ts.SELECTION_RULES), "time_variable", "feature")


WEEKS = series_sql("orders", "o_orderstatus", "o_orderdate", "o_totalprice", "W")


def weekly(t):
    rows = t.orders.select(F.col("o_orderstatus").alias("k"), "o_orderdate", money("o_totalprice").alias("v"))
    return ts.resample(rows, ["k"], "o_orderdate", "v", "W").select("k", "idx", "bucket", "value")


def acf_sql(source, name):
    return f"""{name}_x AS (SELECT k, value - avg(value) OVER (PARTITION BY k) AS x, row_number() OVER (PARTITION BY k ORDER BY idx) AS i,
                   count(*) OVER (PARTITION BY k) AS n FROM {source} WHERE value IS NOT NULL),
      {name} AS (SELECT a.k, CAST(b.i - a.i AS INTEGER) AS lag, sum(a.x * b.x) / any_value(t.s) AS acf FROM {name}_x a JOIN {name}_x b ON a.k = b.k AND b.i > a.i AND b.i <= a.i + 40
                 JOIN (SELECT k, sum(x * x) AS s FROM {name}_x GROUP BY k) t ON t.k = a.k GROUP BY a.k, b.i - a.i)"""


@job("t07_autocorrelation", f"WITH {WEEKS}, {acf_sql('s', 'a')} SELECT k, lag, lag - 1 AS lag0, round(acf, 6) AS acf FROM a")
def autocorrelation(t):
    return ts.autocorrelation(weekly(t), ["k"]).withColumn("acf", F.round("acf", 6))


@job("t08_squared_autocorrelation", f"WITH {WEEKS}, {acf_sql('s', 'a')} SELECT k, round(sum(acf * acf), 6) AS acf_sos FROM a GROUP BY k")
def squared_autocorrelation(t):
    return ts.sum_of_squared_acf(weekly(t), ["k"]).withColumn("acf_sos", F.round("acf_sos", 6))


def parts_sql(model, period, name, source="s"):
    less, back = ("-", "-") if model == "add" else ("/", "/")
    half = period // 2
    if period % 2:
        mean = f"sum(value) OVER (PARTITION BY k ORDER BY idx ROWS BETWEEN {half} PRECEDING AND {half} FOLLOWING) / {period}"
    else:
        mean = f"""(sum(value) OVER (PARTITION BY k ORDER BY idx ROWS BETWEEN {half - 1} PRECEDING AND {half - 1} FOLLOWING)
                    + (lag(value, {half}) OVER (PARTITION BY k ORDER BY idx) + lead(value, {half}) OVER (PARTITION BY k ORDER BY idx)) / 2) / {period}"""
    positive = "AND min(value) OVER (PARTITION BY k) > 0" if model == "mul" else ""
    return f"""{name}_u AS (SELECT k, idx, value, count(*) OVER (PARTITION BY k) AS n, count(*) OVER (PARTITION BY k) >= {2 * period}
                 AND count(*) OVER (PARTITION BY k) = count(value) OVER (PARTITION BY k) {positive} AS usable FROM {source}),
      {name}_t AS (SELECT k, idx, value, usable, CASE WHEN usable AND idx >= {half} AND idx < n - {half} THEN {mean} END AS trend FROM {name}_u),
      {name}_p AS (SELECT k, idx % {period} AS p, avg(value {less} trend) AS m FROM {name}_t GROUP BY ALL),
      {name}_s AS (SELECT k, p, m {less} avg(m) OVER (PARTITION BY k) AS seasonality FROM {name}_p),
      {name} AS (SELECT t.k, idx, value, trend, CASE WHEN usable THEN seasonality END AS seasonality, value {back} trend {back} seasonality AS residual
                 FROM {name}_t t JOIN {name}_s s ON s.k = t.k AND s.p = t.idx % {period})"""


@job("t09_decompose", f"""
    WITH {WEEKS}, {parts_sql('add', 52, 'a')}, {parts_sql('mul', 52, 'm')}
    SELECT * FROM (SELECT 'add' AS model, k, idx, value, round(trend, 4) AS trend, round(seasonality, 4) AS seasonality, round(residual, 4) AS residual FROM a UNION ALL
                   SELECT 'mul', k, idx, value, round(trend, 4), round(seasonality, 4), round(residual, 4) FROM m)""")
def decompose(t):
    weeks = weekly(t)
    parts = [ts.decompose(weeks, ["k"], ts.PERIODS["W"], m).select(
        F.lit(m).alias("model"), "k", "idx", "value", *[F.round(c, 4).alias(c) for c in ("trend", "seasonality", "residual")]) for m in ("add", "mul")]
    return union_all(parts)


@job("t09_decompose_odd_period", f"""
    WITH {series_sql('events', 'event_type', 'ts', 'value', 'D')}, {parts_sql('add', 7, 'a')}
    SELECT k, idx, round(trend, 4) AS trend, round(seasonality, 4) AS seasonality, round(residual, 4) AS residual FROM a""")
def decompose_odd_period(t):
    days = ts.resample(t.events.select(F.col("event_type").alias("k"), "ts", money("value").alias("v")), ["k"], "ts", "v", "D")
    return ts.decompose(days, ["k"], ts.PERIODS["D"]).select("k", "idx", *[F.round(c, 4).alias(c) for c in ("trend", "seasonality", "residual")])


@job("t10_season_choice", f"""
    WITH {WEEKS}, {parts_sql('add', 52, 'a')}, {parts_sql('mul', 52, 'm')}, ar AS (SELECT k, idx, residual AS value FROM a), mr AS (SELECT k, idx, residual AS value FROM m),
      {acf_sql('s', 'a0')}, {acf_sql('ar', 'a1')}, {acf_sql('mr', 'a2')},
      j AS (SELECT k, r, x, y FROM (SELECT k, sum(acf * acf) AS r FROM a0 GROUP BY k) LEFT JOIN (SELECT k, sum(acf * acf) AS x FROM a1 GROUP BY k) USING (k)
            LEFT JOIN (SELECT k, sum(acf * acf) AS y FROM a2 GROUP BY k) USING (k))
    SELECT k, round(r, 6) AS acf_sos, round(x, 6) AS add_sos, round(y, 6) AS mul_sos,
           CASE WHEN x < r AND x <= coalesce(y, x) THEN 'add' WHEN y < r AND y <= coalesce(x, y) THEN 'mul' ELSE 'None' END AS seasonality FROM j""")
def season_choice(t):
    return ts.season_choice(weekly(t), ["k"], ts.PERIODS["W"]).withColumns({c: F.round(c, 6) for c in ("acf_sos", "add_sos", "mul_sos")})


@job("t11_season_length", f"""
    WITH {WEEKS}, {parts_sql('add', 52, 'a')}, p AS (SELECT k, idx FROM (SELECT *, max(seasonality) OVER (PARTITION BY k) AS top FROM a)
        WHERE seasonality >= top - abs(top) * 1e-9 - 1e-9 QUALIFY row_number() OVER (PARTITION BY k ORDER BY idx) <= 2)
    SELECT k, greatest(coalesce(max(p.idx) - min(p.idx), 2), 2) AS season_length FROM (SELECT DISTINCT k FROM s) LEFT JOIN p USING (k) GROUP BY k""")
def season_length(t):
    return ts.season_length(ts.decompose(weekly(t), ["k"], ts.PERIODS["W"]), ["k"])
