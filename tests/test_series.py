"""Series operators against step-by-step Python."""

import math
import random
import time
from datetime import date, datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from tablemill.plans import series as ts
from tablemill.plans import smoothing as sm


def index_of(at, freq):
    days = (at.date() - date(1970, 1, 1)).days
    return {"H": int(at.timestamp() // 3600), "D": days, "W": (days - 4) // 7, "MS": at.year * 12 + at.month - 1,
            "QS": at.year * 4 + (at.month - 1) // 3, "YS": at.year}[freq]


def plain_best(times):
    for freq in ts.FREQUENCIES:
        seen = {index_of(t, freq) for t in times}
        if seen and len(seen) >= 3 and max(seen) - min(seen) + 1 == len(seen):
            return freq
    return "YS"


def plain_trim(times):
    """The search as it is described, pair by pair."""
    n = len(times)
    if plain_best(times) == "H":
        return "H", 0, 0
    m = min(20, round(0.2 * n))
    target = plain_best(times[m + 1:n - m - 1])
    best = ("YS", 0, 0)
    for last in range(m + 1):
        for first in range(m + 1):
            found = plain_best(times[first:n - last])
            if ts.RANKS[found] > ts.RANKS[best[0]]:
                best = (found, first, last)
            if best[0] in ("H", target):
                return best
    return best


def random_times(rng):
    start = datetime(2020, 1, 1) + timedelta(hours=rng.randint(0, 5000))
    step = rng.choice([1, 3, 24, 30, 24 * 7, 24 * 31, 24 * 90, 24 * 400])
    n = rng.randint(1, 60)
    times, at = [], start
    for i in range(n):
        times.append(at)
        jump = step * (rng.choice([5, 20]) if rng.random() < (0.3 if i < 8 or i > n - 8 else 0.02) else 1)
        at = at + timedelta(hours=rng.randint(0, 2 * jump) if rng.random() < 0.5 else jump)
    return times


def test_trim_and_frequency_match_the_search(spark):
    rng = random.Random(5)
    series = {k: random_times(rng) for k in range(150)}
    df = spark.createDataFrame([(k, t) for k, times in series.items() for t in times], "k int, at timestamp")
    hours = ts.hourly(df, ["k"], "at").cache()
    best = {r.k: r.period for r in ts.best_frequency(hours, ["k"]).collect()}
    trim = {r.k: (r.period, r.drop_first, r.drop_last) for r in ts.best_trim(hours, ["k"]).collect()}
    for k, times in series.items():
        times = [t.replace() for t in times]
        assert best[k] == plain_best(times), k
        assert trim[k] == plain_trim(times), k
    assert len({p for p, _, _ in trim.values()}) >= 4 and any(f or l for _, f, l in trim.values())


def plain_runs(values):
    decr = incr = above = below = low_run = high_run = 0
    previous = None
    for v in reversed(values):
        if previous is not None:
            if v > previous:
                if incr:
                    break
                decr += 1
            if v < previous:
                if decr:
                    break
                incr += 1
        previous = v
    mean = np.mean(values)
    for v in reversed(values):
        if v < mean:
            if above:
                break
            below += 1
        if v > mean:
            if below:
                break
            above += 1
    if len(values) > 1:
        std = np.std(values, ddof=1)
        low, high = mean - 3 * std, mean + 3 * std
        if low != high:
            for v in reversed(values):
                if v <= low:
                    if high_run:
                        break
                    low_run += 1
                elif v >= high:
                    if low_run:
                        break
                    high_run += 1
                else:
                    break
    return decr, incr, below, above, low_run, high_run


def test_control_statistics(spark):
    rng = random.Random(7)
    series = {k: [float(rng.randint(0, 4)) for _ in range(rng.randint(1, 30))] for k in range(60)}
    series[100] = [1.0] * 40 + [100.0]
    series[101] = [1.0] * 40 + [-100.0]
    series[102] = [2.0] * 5
    series[103] = [float(i) for i in range(12)]
    df = spark.createDataFrame([(k, i, v) for k, vs in series.items() for i, v in enumerate(vs)], "k int, idx long, value double")
    for r in ts.control_statistics(df, ["k"]).collect():
        assert (r.decr, r.incr, r.blw_mn, r.abv_mn, r.blw_lcl, r.abv_ucl) == plain_runs(series[r.k]), series[r.k]
        assert r.nobs == len(series[r.k])


def test_resample_keeps_empty_buckets(spark):
    df = spark.createDataFrame([("a", datetime(2024, 1, 7), 1.0), ("a", datetime(2024, 1, 7), 3.0), ("a", datetime(2024, 1, 22), 5.0)], "k string, at timestamp, v double")
    got = [(str(r.bucket)[:10], r.value, r.idx) for r in ts.resample(df, ["k"], "at", "v", "W").orderBy("idx").collect()]
    assert got == [("2024-01-07", 2.0, 0), ("2024-01-14", None, 1), ("2024-01-21", None, 2), ("2024-01-28", 5.0, 3)]


def test_additive_parts_add_up(spark):
    values = [10 + i * 0.5 + [0, 3, -2, 1][i % 4] for i in range(24)]
    df = spark.createDataFrame([(1, i, float(v)) for i, v in enumerate(values)], "k int, idx long, value double")
    rows = ts.decompose(df, ["k"], 4).orderBy("idx").collect()
    for r in rows:
        if r.trend is not None:
            assert r.trend + r.seasonality + r.residual == pytest.approx(r.value)
            assert abs(r.residual) < 1e-9
    assert sum(r.seasonality for r in rows[:4]) == pytest.approx(0)
    assert rows[0].trend is None and rows[2].trend is not None
    assert ts.season_length(ts.decompose(df, ["k"], 4), ["k"]).first().season_length == 4
    short = df.filter("idx < 7")
    assert ts.decompose(short, ["k"], 4).filter("seasonality is not null").count() == 0
    negative = df.withColumn("value", F.col("value") - 100)
    assert ts.decompose(negative, ["k"], 4, "mul").filter("seasonality is not null").count() == 0


def test_autocorrelation(spark):
    rng = random.Random(2)
    x = np.array([rng.random() for _ in range(60)])
    df = spark.createDataFrame([(1, i, float(v)) for i, v in enumerate(x)], "k int, idx long, value double")
    got = {r.lag: r.acf for r in ts.autocorrelation(df, ["k"]).collect()}
    c = x - x.mean()
    assert sorted(got) == list(range(1, 41))
    for lag, value in got.items():
        assert value == pytest.approx((c[:-lag] * c[lag:]).sum() / (c * c).sum())
    single = df.filter("idx = 0")
    assert math.isinf(ts.sum_of_squared_acf(single, ["k"]).first().acf_sos)


# ---- smoothing ----------------------------------------------------------------------------

def plain_smooth(values, c, kind, p, steps):
    if kind == "None":
        level, season = values[0], []
        slope = values[1] / values[0] if c["trend"] == "mul" else values[1] - values[0]
    else:
        level = sum(values[:p]) / p
        season = [v - level if kind == "add" else v / level for v in values[:p]]
        slope = 1.0 if c["trend"] == "mul" else 0.0
    levels = []
    for x in values:
        s = season[0] if season else None
        damped = slope ** c["phi"] if c["trend"] == "mul" else slope * c["phi"]
        base = {"None": level, "add": level + damped, "mul": level * damped}[c["trend"]]
        bare = {"None": x, "add": x - (s or 0), "mul": x / (s or 1)}[kind]
        new = c["alpha"] * bare + (1 - c["alpha"]) * base
        if c["trend"] == "add":
            slope = c["beta"] * (new - level) + (1 - c["beta"]) * damped
        elif c["trend"] == "mul":
            slope = c["beta"] * new / level + (1 - c["beta"]) * damped
        if season:
            season = season[1:] + [c["gamma"] * ((x - base) if kind == "add" else x / base) + (1 - c["gamma"]) * s]
        level = new
        levels.append(level)
    out = []
    for h in range(1, steps + 1):
        reach = sum(c["phi"] ** i for i in range(1, h + 1))
        base = {"None": level, "add": level + reach * slope, "mul": level * slope ** reach}[c["trend"]]
        s = season[(h - 1) % p] if season else None
        out.append({"None": base, "add": base + (s or 0), "mul": base * (s or 1)}[kind])
    return levels, out


@pytest.mark.parametrize("kind,p", [("None", 2), ("add", 4), ("mul", 4)])
def test_smoothing_matches_plain_recursion(spark, kind, p):
    values = [20 + i * 0.7 + [0, 3, -2, 1][i % 4] + (i * 7 % 5) / 3 for i in range(30)]
    grid = [c for c in sm.candidates(alphas=(0.3, 0.6), betas=(0.2,), gammas=(0.2,), phis=(0.9,))]
    series = spark.createDataFrame([(1, i, i, float(v)) for i, v in enumerate(values)], "k int, idx long, b long, value double")
    season = spark.createDataFrame([(1, kind, p)], "k int, seasonality string, season_length long")
    best = sm.choose_smoothing(series, ["k"], season, grid).cache()
    scores = []
    for c in grid:
        _, ahead = plain_smooth(values[:24], c, kind, p, 6)
        scores.append((sum((a - b) ** 2 for a, b in zip(values[24:], ahead)), c))
    sse, chosen = min(scores, key=lambda s: s[0])
    row = best.first()
    assert row.sse == pytest.approx(sse) and (row.trend, row.damped, row.alpha) == (chosen["trend"], chosen["damped"], chosen["alpha"])
    run = sm.smooth(series, ["k"], best)
    levels, ahead = plain_smooth(values, chosen, kind, p, math.ceil(30 / 4))
    got = run.first()
    assert got.levels == pytest.approx(levels) and got.forecasts == pytest.approx([values[-1], *ahead])
    parts = sm.level_parts(run, ["k"]).collect()
    assert all(r.trend + r.residual == pytest.approx(r.original) for r in parts) and len(parts) == 30


def test_series_with_gap_is_not_smoothed(spark):
    series = spark.createDataFrame([(1, 0, 0, 1.0), (1, 1, 1, None), (1, 2, 2, 3.0)], "k int, idx long, b long, value double")
    season = spark.createDataFrame([(1, "None", 2)], "k int, seasonality string, season_length long")
    best = sm.choose_smoothing(series, ["k"], season)
    assert best.count() == 0
    assert sm.smooth(series, ["k"], best).first().forecasts == [3.0]


def test_trend_forecast_follows_a_line(spark):
    df = spark.range(800).select(F.date_add(F.lit("2020-01-01").cast("date"), F.col("id").cast("int")).alias("day"), (F.col("id") * 2.0 + 5).alias("value"))
    out = sm.trend_forecast(df, 10).filter("kind = 'forecast'").orderBy("day").collect()
    assert len(out) == 10 and out[0].fitted == pytest.approx(1605, rel=1e-3) and out[9].fitted == pytest.approx(1623, rel=1e-3)


@pytest.mark.parametrize("n", [1, 2, 255, 256, 257, 700])
def test_levels_in_pieces_follow_the_plain_recursion(spark, n):
    rng = random.Random(n)
    values = [rng.random() * 10 for _ in range(n)]
    df = spark.createDataFrame([(values,)], "v array<double>").withColumn("c", F.struct(
        F.lit("add").alias("trend"), F.lit(0.3).alias("alpha"), F.lit(0.2).alias("beta"), F.lit(0.1).alias("gamma"), F.lit(0.9).alias("phi")))
    state = df.select(sm._fold(F.col("v"), F.lit("None"), F.lit(2), True).alias("s"), sm._fold(F.col("v"), F.lit("None"), F.lit(2), False).alias("t")).first()
    level, slope, levels = values[0], (values[1] - values[0]) if n > 1 else 0.0, []
    for x in values:
        base = level + slope * 0.9
        fresh = 0.3 * x + 0.7 * base
        level, slope = fresh, 0.2 * (fresh - level) + 0.8 * (slope * 0.9)
        levels.append(level)
    assert state.s.levels == pytest.approx(levels)
    assert (state.s.level, state.s.slope) == (state.t.level, state.t.slope)


def test_a_hundred_thousand_buckets_in_linear_time(spark):
    spent = []
    for n in (50_000, 100_000):
        df = spark.range(1).select(F.transform(F.sequence(F.lit(1), F.lit(n)), lambda i: F.sin(i) + 5).alias("v"), F.struct(
            F.lit("None").alias("trend"), F.lit(0.3).alias("alpha"), F.lit(0.2).alias("beta"), F.lit(0.1).alias("gamma"), F.lit(1.0).alias("phi")).alias("c"))
        began = time.time()
        assert df.select(F.size(sm._fold(F.col("v"), F.lit("None"), F.lit(2), True)["levels"]).alias("n")).first().n == n
        spent.append(time.time() - began)
    assert spent[1] < 3 * spent[0] + 2 and spent[1] < 30


def test_results_appended_by_runs_equal_those_of_one(spark, tables, tmp_path):
    from tablemill.catalog.forecasts import monthly
    from tablemill.plans import results

    series = monthly(tables)
    compute = lambda todo: results.series_results(series.join(todo, "k", "left_semi"), ["k"], "MS")
    pairs = series.select("k").distinct().cache()
    one, two = (results.ResultStore(spark, f"file://{tmp_path}/{n}", ["k"]) for n in ("one", "two"))
    assert one.run_missing(pairs, compute) == pairs.count()
    assert two.run_missing(pairs.filter("k <> 'O'"), compute) == pairs.count() - 1
    # a run that breaks off before it is listed: its rows do not count and its pairs are missing
    with pytest.raises(RuntimeError):
        def broken(todo):
            made = compute(todo)
            made["acf"].withColumn("run", F.lit("broken")).write.mode("append").parquet(f"file://{tmp_path}/two/acf")
            raise RuntimeError
        two.run_missing(pairs, broken)
    assert two.run_missing(pairs, compute) == 1 and two.run_missing(pairs, compute) == 0
    for name in results.TABLES:
        assert sorted(map(repr, one.read(name).collect())) == sorted(map(repr, two.read(name).collect())), name
        assert {r.k for r in two.read(name).select("k").distinct().collect()} <= {r.k for r in pairs.collect()}
    assert two.read("forecast").filter("step > 0").count() > 0 and two.read("trends").count() > 0


def test_trimmed_ends_against_brute_force(spark):
    rng = random.Random(12)
    base = datetime(2021, 3, 1)
    # many rows in the first and last hours, equal times, a single row, all rows of a series dropped from both sides of one hour
    rows = [("hot", base + timedelta(minutes=rng.randint(0, 59)), i, float(rng.randint(1, 9))) for i in range(60)]
    rows += [("hot", base + timedelta(hours=rng.randint(1, 60)), 100 + i, float(rng.randint(1, 9))) for i in range(80)]
    rows += [("thin", base + timedelta(hours=2 * i), 300 + i, float(i)) for i in range(30)]
    rows += [("one hour", base + timedelta(minutes=i // 2), 400 + i, float(i)) for i in range(20)]
    drops = {"hot": (20, 20), "thin": (3, 7), "one hour": (4, 9)}
    df = spark.createDataFrame(rows, "k string, at timestamp, id long, v double").withColumn("v", F.col("v").cast("decimal(18,2)"))
    choice = spark.createDataFrame([(k, "H", *d) for k, d in drops.items()], "k string, period string, drop_first long, drop_last long")
    series = ts.trimmed_series(df, ts.hourly(df, ["k"], "at", "v"), ["k"], "at", "v", "id", choice)
    got = {(r.k, r.bucket.replace(tzinfo=None)): r.value for r in series.filter("value is not null").collect()}
    want = {}
    for k, (first, last) in drops.items():
        own = sorted((r[1], r[2], r[3]) for r in rows if r[0] == k)
        hours = {}
        for at, _, v in own[first:len(own) - last]:
            hours.setdefault(at.replace(minute=0), []).append(v)
        want |= {(k, h): pytest.approx(sum(vs) / len(vs)) for h, vs in hours.items()}
    assert got == want
