"""Ordered operators against plain Python, with one key that holds most of the rows."""

import random
from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import functions as F

from tablemill.operators import joining, ordered


@pytest.fixture(scope="module")
def skewed(spark):
    rng = random.Random(1)
    rows = [(1 if rng.random() < 0.6 else rng.randint(2, 9), i, rng.randint(0, 40), rng.randint(0, 300) / 4) for i in range(3000)]
    df = spark.createDataFrame(rows, "k int, id int, v int, x double").repartition(5).cache()
    return rows, df


def by_key(rows, order):
    out = {}
    for r in sorted(rows, key=order):
        out.setdefault(r[0], []).append(r)
    return out


def test_positions(skewed):
    rows, df = skewed
    got = {(r.k, r.id): r.pos for r in ordered.positions(df, [F.col("x"), F.col("id")], on="x", keys=["k"], parts=7).collect()}
    want = {(r[0], r[1]): i + 1 for group in by_key(rows, lambda r: (r[3], r[1])).values() for i, r in enumerate(group)}
    assert got == want


def test_positions_without_key_and_with_one_value(spark):
    df = spark.range(50).withColumn("same", F.lit(3))
    got = sorted((r.id, r.pos) for r in ordered.positions(df, [F.col("same"), F.col("id")], on="same").collect())
    assert got == [(i, i + 1) for i in range(50)]


def test_heavy_value_is_cut_by_the_second_column(spark):
    rng = random.Random(11)
    rows = [(7 if rng.random() < 0.7 else rng.randint(0, 20), i) for i in range(2000)]
    df = spark.createDataFrame(rows, "v int, id int")
    cut = ordered.with_range(df, ["v", "id"], parts=8)
    sizes = [r["count"] for r in cut.groupBy(ordered.RANGE).count().collect()]
    assert max(sizes) < 500
    got = sorted((r.v, r.id, r.pos) for r in ordered.positions(df, [F.col("v"), F.col("id")], on=["v", "id"], parts=8).collect())
    assert got == [(*r, i + 1) for i, r in enumerate(sorted(rows))]


def test_equal_values_are_a_gap_of_zero(spark):
    df = spark.createDataFrame([(1, 5.0), (1, 5.0)], "k int, x double")
    assert ordered.largest_gap(df, "x", ["k"]).first().max_gap == 0


def test_positions_with_null_and_text(spark):
    df = spark.createDataFrame([("b",), (None,), ("a",), ("éa",), ("zz",), ("ab",)], "s string")
    got = {r.s: r.pos for r in ordered.positions(df, [F.col("s")], on="s", parts=3).collect()}
    assert got == {None: 1, "a": 2, "ab": 3, "b": 4, "zz": 5, "éa": 6}


def test_positions_with_null_key(spark):
    df = spark.createDataFrame([(None, 3), (None, 1), (1, 2)], "k int, v int")
    got = sorted(((r.k or 0), r.v, r.pos) for r in ordered.positions(df, [F.col("v")], on="v", keys=["k"], parts=4).collect())
    assert got == [(0, 1, 1), (0, 3, 2), (1, 2, 1)]


def test_running_sums(skewed):
    rows, df = skewed
    got = {(r.k, r.id): r.total for r in ordered.running_sums(df, [F.col("x"), F.col("id")], "x", {"total": F.col("v")}, ["k"], parts=6).collect()}
    for group in by_key(rows, lambda r: (r[3], r[1])).values():
        for r, total in zip(group, np.cumsum([r[2] for r in group])):
            assert got[(r[0], r[1])] == total


def test_largest_gap(skewed):
    rows, df = skewed
    got = {r.k: r.max_gap for r in ordered.largest_gap(df, "x", ["k"], parts=9).collect()}
    want = {k: max(b[3] - a[3] for a, b in zip(g, g[1:])) for k, g in by_key(rows, lambda r: r[3]).items()}
    assert got == want


def test_largest_gap_of_single_value(spark):
    df = spark.createDataFrame([(1, 5.0)], "k int, x double")
    assert ordered.largest_gap(df, "x", ["k"]).first().max_gap is None


def test_rolling_crosses_blocks(spark):
    df = spark.createDataFrame([(k, p, p * p % 7) for k in (1, 2) for p in range(1, 40)], "k int, pos long, v int")
    out = ordered.rolling(df, "pos", 3, ["k"], block=5, total=F.sum("v"), n=F.count("v"))
    got = {(r.k, r.pos): (r.total, r.n) for r in out.collect()}
    values = [p * p % 7 for p in range(1, 40)]
    want = {(k, i + 1): (sum(values[i:i + 3]), len(values[i:i + 3])) for k in (1, 2) for i in range(39)}
    assert got == want


@pytest.mark.parametrize("shares", [[0.5], [0.0, 0.1, 0.25, 0.9, 1.0]])
def test_exact_quantiles(skewed, shares):
    rows, df = skewed
    got = {(r.k, r.share): r.quantile for r in ordered.exact_quantiles(df, "x", shares, ["k"], parts=5).collect()}
    for k, group in by_key(rows, lambda r: r[3]).items():
        for s in shares:
            assert got[(k, s)] == pytest.approx(np.quantile([r[3] for r in group], s))
    whole = {r.share: r.quantile for r in ordered.exact_quantiles(df, "x", shares).collect()}
    for s in shares:
        assert whole[s] == pytest.approx(np.quantile([r[3] for r in rows], s))


def test_quantile_of_two_and_one(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", 2.0), ("b", 7.0)], "k string, x double")
    assert {r.k: r.quantile for r in ordered.exact_quantiles(df, "x", [0.5], ["k"]).collect()} == {"a": 1.5, "b": 7.0}


def test_rising_pairs(spark):
    rng = random.Random(3)
    rows = [(rng.randint(0, 3), rng.randint(0, 60), rng.randint(0, 100)) for _ in range(400)]
    df = spark.createDataFrame(rows, "k int, p int, v int")
    got = {r.k: r.n_pairs for r in ordered.count_rising_pairs(df, ["k"], "p", "v").collect()}
    for k in {r[0] for r in rows}:
        group = [r for r in rows if r[0] == k]
        assert got[k] == sum(1 for a in group for b in group if a[1] < b[1] and a[2] < b[2])


def test_rising_pairs_of_any_numbers(spark):
    rng = random.Random(6)
    rows = [(1, rng.choice([-3.5, 0.25, 9.0, 1e6, None]), rng.choice([-74.2, -0.1, 10.2, 10.7, 74.0, None])) for _ in range(120)] + [(2, 1.0, 10.0), (2, 9.0, 74.0)]
    got = {r.k: r.n_pairs for r in ordered.count_rising_pairs(spark.createDataFrame(rows, "k int, p double, v double"), ["k"], "p", "v").collect()}
    for k in (1, 2):
        group = [r for r in rows if r[0] == k and None not in r]
        assert got[k] == sum(1 for a in group for b in group if a[1] < b[1] and a[2] < b[2])


@pytest.mark.parametrize(("width", "block"), [(8, 3), (5, 5), (2, 100), (1, 1)])
def test_rolling_frames_wider_than_a_block(spark, width, block):
    df = spark.range(1, 31).select(F.col("id").alias("pos"), (F.col("id") * F.col("id")).alias("v"))
    got = {r.pos: (r.total, r.n) for r in ordered.rolling(df, "pos", width, block=block, total=F.sum("v"), n=F.count("v")).collect()}
    assert got == {p: (sum(x * x for x in range(p, min(31, p + width))), min(31, p + width) - p) for p in range(1, 31)}


def test_texts_with_a_common_start_are_cut(spark):
    urls = [f"https://www.example.com/{i:05d}" for i in range(2000)] + [None, "", "ü", "日本"]
    df = spark.createDataFrame([(u,) for u in urls], "u string")
    sizes = [r["count"] for r in ordered.with_range(df, "u", parts=8).groupBy(ordered.RANGE).count().collect()]
    assert len(sizes) == 8 and max(sizes) < 600
    got = {r.u: r.pos for r in ordered.positions(df, [F.col("u")], on="u", parts=8).collect()}
    assert got == {u: i + 1 for i, u in enumerate(sorted(urls, key=lambda u: (u is not None, (u or "").encode())))}


@pytest.mark.parametrize("kind", ["double", "timestamp", "date", "decimal(12,3)", "boolean"])
def test_ranges_of_other_types(spark, kind):
    base = F.col("id") % 97
    value = {"double": F.when(base == 5, float("nan")).when(base == 6, None).otherwise(base / 7), "timestamp": F.timestamp_seconds(base * 86_401),
             "date": F.date_add(F.lit("2020-01-01").cast("date"), base.cast("int")), "decimal(12,3)": (base / 8).cast("decimal(12,3)"), "boolean": base > 40}[kind]
    df = spark.range(500).select("id", value.alias("v"))
    order = [F.col("v"), F.col("id")]
    got = {r.id: r.pos for r in ordered.positions(df, order, on=["v", "id"], parts=6).collect()}
    want = {r.id: i + 1 for i, r in enumerate(df.orderBy(*order).collect())}
    assert got == want


def test_equal_sums_of_doubles_meet(spark):
    df = spark.createDataFrame([(1, 1, 0.1), (1, 2, 0.2)], "k int, p int, v double")
    assert [tuple(r) for r in joining.pair_to_goal(df, ["k"], "p", "v", 0.3).collect()] == [(1, 0.1, 0.2)]


def test_pair_to_goal_joins_nothing(spark, capsys):
    rows = [(1, 1, 2), (1, 2, 4), (1, 3, 3), (1, 4, 3), (2, 1, 3), (2, 1, 3), (2, 2, 5), (2, 3, 1), (3, 2, 5), (3, 2, 1), (4, 1, 3), (5, None, 5), (5, 7, 1),
            (6, 1, None), (6, 2, 6), (None, 9, 0), (None, 8, 6), (7, None, 3), (7, 4, 3)]
    pairs = joining.pair_to_goal(spark.createDataFrame(rows, "k int, p int, v int"), ["k"], "p", "v", 6)
    assert sorted((tuple(r) for r in pairs.collect()), key=str) == [(1, 2, 4), (2, 3, 3), (3, 1, 5), (5, 5, 1), (7, 3, 3), (None, 6, 0)]
    pairs.explain()
    assert "Join" not in capsys.readouterr().out


@pytest.mark.parametrize("nums,goal,want", [([1, 2, 2, 10], 4, (2, 2)), ([4, 2, 10, 5, 1], 6, (4, 2)), ([5, 1, 4, 8, 3, 2], 7, (4, 3)), ([11, 20, 4, 2, 1, 5], 100, None)])
def test_pair_to_goal_golden(spark, nums, goal, want):
    df = spark.createDataFrame([(1, i, v) for i, v in enumerate(nums)], "g int, pos int, v int")
    got = joining.pair_to_goal(df, ["g"], "pos", "v", goal).collect()
    assert ([(r.first_value, r.second_value) for r in got] or [None]) == [want]


def test_combinations(spark):
    items = list("abcdef")
    df = spark.createDataFrame([(items,), (["x"],), ([],)], "l array<string>")
    for k in (1, 2, 3, 4):
        got = [r.c for r in df.select(joining.combinations(F.col("l"), k).alias("c")).collect()]
        assert got[0] == [list(c) for c in combinations(items, k)]
        assert got[2] == [] and (k == 1 or got[1] == [])


@pytest.mark.parametrize("block_rows", [1000, 3, 1])
def test_product(spark, block_rows):
    left, right = spark.range(7).toDF("a"), spark.range(10).toDF("b")
    got = sorted((r.a, r.b) for r in joining.product(left, right, block_rows).collect())
    assert got == [(a, b) for a in range(7) for b in range(10)]


def test_product_deals_equal_rows_apart(spark):
    left, right = spark.range(600).select(F.lit(1).alias("a")), spark.range(2).toDF("b")
    made = joining.product(left, right, 50)
    assert made.count() == 1200 and made.distinct().count() == 2


def test_latest_versions_rules(spark):
    rows = [("k1", "1", "Actualized"), ("k1", "2", "Planned"), ("k2", "3", "Actualized"), ("k2", "3", "Actualized"), ("k3", None, "Actualized"), (None, "1", "Actualized")]
    df = spark.createDataFrame(rows, "k string, v string, type string")
    got = joining.latest_versions(df, ["k"], F.col("v"), F.col("type") == "Actualized").collect()
    # k1's latest row fails the filter, ties of k2 stay, null versions and keys never match
    assert [(r.k, r.v) for r in got] == [("k2", "3"), ("k2", "3")]


def test_a_hundred_thousand_ranges(spark, skewed):
    """The bounds within top cells are a table; what reaches the driver and the plan does not grow with the ranges."""
    rows, df = skewed
    bounds = ordered.range_bounds(df, ["x", "id"], parts=100_000)
    assert len(bounds.top) < ordered.TOP and bounds.inner is not None
    cut = ordered.with_range(df, ["x", "id"], bounds=bounds)
    placed = sorted((r.x, r.id, r[ordered.RANGE]) for r in cut.collect())
    assert [p[2] for p in placed] == sorted(p[2] for p in placed) and len({p[2] for p in placed}) > 2000
    got = {(r.k, r.id): r.pos for r in ordered.positions(df, [F.col("x"), F.col("id")], on=["x", "id"], keys=["k"], parts=100_000).collect()}
    assert got == {(r[0], r[1]): i + 1 for group in by_key(rows, lambda r: (r[3], r[1])).values() for i, r in enumerate(group)}
    sums = {r.id: r.total for r in ordered.running_sums(df, [F.col("x"), F.col("id")], "x", {"total": F.col("v")}, parts=100_000).collect()}
    every = sorted(rows, key=lambda r: (r[3], r[1]))
    for r, total in zip(every, np.cumsum([r[2] for r in every])):
        assert sums[r[1]] == total


def test_inner_bounds_with_null_and_text(spark, monkeypatch):
    monkeypatch.setattr(ordered, "TOP", 3)
    words = [None, *sorted({f"w{i * 7919 % 1000:03}" for i in range(300)})]
    df = spark.createDataFrame([(w,) for w in words], "s string").repartition(4)
    got = {r.s: r.pos for r in ordered.positions(df, [F.col("s")], on="s", parts=60).collect()}
    assert got == {w: i + 1 for i, w in enumerate(words)}


def test_rising_pairs_of_a_hot_key_in_ranges(spark, monkeypatch):
    monkeypatch.setattr(ordered, "RANGE_ROWS", 150)
    monkeypatch.setattr(ordered, "CLOSE", 8)
    rng = random.Random(12)
    rows = [(None if rng.random() < 0.1 else 1, rng.randint(-10**12, 10**12), rng.randint(0, 90)) for _ in range(500)]
    got = {r.k: r.n_pairs for r in ordered.count_rising_pairs(spark.createDataFrame(rows, "k int, p long, v int"), ["k"], "p", "v").collect()}
    assert got[1] == sum(1 for a in rows for b in rows if a[0] == b[0] == 1 and a[1] < b[1] and a[2] < b[2])


def test_tree_totals(spark):
    from tablemill.operators.hierarchy import subtree_totals

    rng = random.Random(2)
    chain = [(i, i - 1 if i else None, 1) for i in range(5000)]
    bushy = [(10_000 + i, None if i == 0 else 10_000 + rng.randrange(i), rng.randint(0, 9) if i % 50 else None) for i in range(1500)]
    df = spark.createDataFrame(chain + bushy, "node long, parent long, value long")
    want = {n: [v, 1] for n, _, v in chain + bushy}
    for n, parent, _ in reversed(chain + bushy):
        if parent is not None:
            total, nodes = want[n]
            want[parent] = [total if want[parent][0] is None else want[parent][0] + (total or 0), want[parent][1] + nodes]
    assert {r.node: [r.total, r.nodes] for r in subtree_totals(df).collect()} == want
    with pytest.raises(ValueError, match="not a tree"):
        subtree_totals(spark.createDataFrame([(1, 2, 1), (2, 1, 1), (3, None, 1)], "node long, parent long, value long"))
