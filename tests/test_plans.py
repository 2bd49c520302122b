"""Preparation, baskets, evaluation, modelling, sources and feeds on small hand-made tables."""

import hashlib
import itertools
import random
import time
from itertools import combinations

import numpy as np
import pandas as pd
import pytest
from pyspark.ml.classification import LinearSVC, LogisticRegression
from pyspark.sql import functions as F

from tablemill.catalog.settlement import changed_settlement
from tablemill.operators.nearest import nearest_rows
from tablemill.operators.summary import correlation_matrix
from tablemill.plans import basket as mb
from tablemill.plans import evaluate as ev
from tablemill.plans import modelling as md
from tablemill.plans import prepare as prep
from tablemill.plans import profile, settlement
from tablemill.sources import readers, writers
from tablemill.streaming import feeds


# ---- profile and preparation --------------------------------------------------------------

def test_health_score_steps(spark):
    df = spark.range(500).select("id", F.concat(F.lit("t"), "id").alias("name"), F.when(F.col("id") % 2 == 0, 1).alias("half"))
    r = profile.health_score(df).first()
    assert (r.row_count, r.type_mix, r.blowout) == (25.0, (40 + 20) / 2, 50.0)
    assert r.sparsity == pytest.approx(100 * (1 - 250 / 1500)) and r.health == pytest.approx((r.sparsity + 25 + 30 + 50) / 4)


def test_vif_matches_regression(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(200, 3))
    x[:, 2] = x[:, 0] + 0.2 * x[:, 1] + 0.05 * rng.normal(size=200)
    df = spark.createDataFrame([tuple(map(float, r)) for r in x], "a double, b double, c double")
    got = prep.vifs(prep.cross_products(df, ["a", "b", "c"]), [0, 1, 2, 3])
    full = np.column_stack([np.ones(200), x])
    for i in range(4):
        rest = np.delete(full, i, axis=1)
        resid = full[:, i] - rest @ np.linalg.lstsq(rest, full[:, i], rcond=None)[0]
        base = full[:, i] - (full[:, i].mean() if i else 0)
        assert got[i] == pytest.approx((base @ base) / (resid @ resid), rel=1e-6)
    assert prep.collinear_columns(df, ["a", "b", "c"])[0] in ("a", "c")


def test_cross_products(spark):
    rng = np.random.default_rng(2)
    x = np.column_stack([rng.normal(size=300), rng.normal(size=300) * 100 + 7, np.full(300, 3.0), rng.normal(size=300) - 5])
    rows = [tuple(map(float, r)) for r in x] + [(1.0, None, 2.0, 3.0), (float("nan"), 1.0, 1.0, 1.0)]
    df = spark.createDataFrame(rows, "a double, b double, same double, c double").repartition(5).cache()
    full = np.column_stack([np.ones(300), x])
    assert np.allclose(prep.cross_products(df, df.columns), full.T @ full)
    assert "same" in prep.collinear_columns(df, df.columns)


def test_correlations_of_thirty_columns_with_nulls(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(200, 30))
    x[:, 1] += x[:, 0]
    x[rng.random((200, 30)) < 0.2] = np.nan
    x[:, 29] = 4.0
    df = spark.createDataFrame([tuple(None if np.isnan(v) else float(v) for v in r) for r in x], ", ".join(f"c{i} double" for i in range(30)))
    got = correlation_matrix(df, df.columns)
    want = pd.DataFrame(x).corr().to_numpy()
    assert np.allclose(got, want, equal_nan=True, atol=1e-9)


def test_item_columns_keep_their_meaning_at_any_width(spark):
    few = [(F.col("id") % 2).alias("odd"), (F.col("id") % 2).alias("odd_again"), F.when(F.col("id") > 60, F.col("id") % 3).alias("third")]
    many = [F.when(F.col("id") % 40 != i, F.pmod(F.hash("id", F.lit(i)), F.lit(2)).cast("long")).alias(f"x{i}") for i in range(30)]
    assert mb.item_columns(spark.range(100).select(*few)) == ["odd", "third"]
    assert mb.item_columns(spark.range(100).select(*few, *many))[:2] == ["odd", "third"]


def test_frequent_sets_of_many_items_per_row(spark):
    rows = [([f"i{k:03d}" for k in range(300)], 2), ([f"i{k:03d}" for k in range(0, 300, 100)], 5), (["z"], 3)]
    found = spark.createDataFrame(rows, "items array<string>, n long")
    got = {tuple(r["items"]): r["n"] for r in mb.frequent_itemsets(found, 0.5).collect()}
    often = ["i000", "i100", "i200"]
    assert got == {c: 7 for k in (1, 2, 3) for c in itertools.combinations(often, k)}


def test_vif_infinite_and_uncentred(spark):
    df = spark.range(100).select(F.rand(1).alias("a"), F.rand(2).alias("b")).withColumn("twice", F.col("a") * 2)
    gone = prep.collinear_columns(df.cache(), ["a", "b", "twice"])
    assert len({"a", "twice"} & set(gone)) == 1 and "b" not in gone
    products = prep.cross_products(df, ["a", "b"])
    a, b = (np.array([r[0] for r in df.select(c).collect()]) for c in "ab")
    assert prep.vifs(products, [1, 2])[0] == pytest.approx(1 / (1 - (a @ b) ** 2 / ((a @ a) * (b @ b))))


def test_dummies_of_known_values_sum_to_one(spark):
    df = spark.createDataFrame([("x", 1, 0), ("y", 2, 1), (None, 2, 0)], "c string, n int, label int")
    out, memory = prep.dummy_columns(df, "label")
    assert memory == {"c": ["c = x", "c = y"], "n": ["n = 1", "n = 2"]}
    rows = out.collect()
    assert [r["c = x"] + r["c = y"] for r in rows] == [1, 1, 0] and all(r["n = 1"] + r["n = 2"] == 1 for r in rows)
    assert "label" in out.columns


def test_null_modes(spark):
    holes = spark.range(1000).select("id", F.when(F.col("id") != 5, F.lit(2.0)).alias("x"))
    assert prep.handle_nulls(holes, "drop").count() == 999
    assert prep.handle_nulls(holes, "mean").filter("x is null").count() == 0
    many = spark.range(100).select(F.when(F.col("id") % 2 == 0, F.col("id")).alias("x"), F.when(F.col("id") % 2 == 0, "t").alias("s"))
    filled = prep.handle_nulls(many, "drop")
    assert filled.count() == 100 and filled.filter("x = 49").count() == 50 and filled.filter("s is null").count() == 50


def test_label_needs_two_values(spark):
    with pytest.raises(ValueError, match="has more"):
        prep.recode_label(spark.range(3).withColumnRenamed("id", "y"), "y", 1)
    with pytest.raises(ValueError, match="it has 1"):
        prep.recode_label(spark.range(1).withColumnRenamed("id", "y"), "y", 0)
    numbers = spark.createDataFrame([(1.0,), (0.0,), (None,)], "y double")
    assert [r.y for r in prep.recode_label(numbers, "y", "1").collect()] == [1, 0, None]
    with pytest.raises(ValueError, match="never takes"):
        prep.recode_label(numbers, "y", 7)
    flags = spark.createDataFrame([(True,), (False,)], "y boolean")
    assert [r.y for r in prep.recode_label(flags, "y", True).collect()] == [1, 0]
    assert sorted(r.y for r in prep.recode_label(spark.createDataFrame([("yes",), ("no",)], "y string"), "y", "yes").collect()) == [0, 1]


def test_prepare_chain(tables):
    from tablemill.catalog.preparation import PREPARE, raw_orders

    out = prep.prepare(raw_orders(tables), PREPARE)
    steps = dict(out.report)
    assert steps["block list"] == "customer" and "sparse" in steps["sparse"] and "order_key" in steps["cardinality"]
    assert set(out.memory) == {"segment", "priority"} and "priority = 1-URGENT" in out.table.columns
    assert out.time_columns == ["order_date"] and "order_date" not in out.table.columns
    assert {r.closed for r in out.table.select("closed").distinct().collect()} == {0, 1}


# ---- baskets ------------------------------------------------------------------------------

def test_itemsets_and_rules_match_counting(spark):
    rng = random.Random(4)
    names = ["a", "b", "c", "d", "e"]
    rows = [[1 if rng.random() < p else 0 for p in (0.7, 0.5, 0.4, 0.3, 0.05)] for _ in range(400)]
    df = spark.createDataFrame(rows, ", ".join(f"{n} int" for n in names))
    found = mb.signatures(df, names)
    got = {tuple(r["items"]): r.n for r in mb.frequent_itemsets(found, 0.1).collect()}
    sets_ = [{n for n, v in zip(names, r) if v} for r in rows]
    want = {c: n for k in (1, 2, 3) for c in combinations(names, k) if (n := sum(set(c) <= s for s in sets_)) >= 40}
    assert got == want
    rules = mb.find_rules(found).collect()
    assert rules
    lift = {(tuple(r.antecedents), tuple(r.consequents)): r.lift for r in rules}
    for (a, c), value in lift.items():
        n = len(rows)
        sa, sc, both = (sum(set(x) <= s for s in sets_) for x in (a, c, a + c))
        assert value == pytest.approx(both * n / (sa * sc)) and value >= 1
        if both < sc:  # otherwise the turned rule has infinite conviction and is left out
            assert lift[(c, a)] == pytest.approx(value)


def test_low_support_is_the_fallback(spark):
    df = spark.range(400).select((F.col("id") % 20 == 0).cast("int").alias("a"), (F.col("id") % 40 == 0).cast("int").alias("b"))
    assert mb.find_rules(mb.signatures(df, ["a", "b"])).count() == 1


def test_item_columns(spark):
    df = spark.range(100).select(
        (F.col("id") % 2).alias("odd"), (F.col("id") % 2).alias("odd_again"), (F.col("id") + 1).alias("never_zero"), (F.col("id") % 3).alias("third"), F.lit(0).alias("label"))
    assert mb.item_columns(df, "label") == ["odd", "third"]


# ---- evaluation and models ----------------------------------------------------------------

def test_area_equals_rank_statistic(spark):
    rng = random.Random(8)
    rows = [(rng.randint(0, 1), rng.randint(0, 20) / 20) for _ in range(300)]
    scored = spark.createDataFrame(rows, "label int, score double")
    area = ev.roc_area(ev.roc_points(scored)).first().auc
    good, bad = [s for y, s in rows if y], [s for y, s in rows if not y]
    assert area == pytest.approx(np.mean([(a > b) + 0.5 * (a == b) for a in good for b in bad]))


def test_metrics(spark):
    scored = spark.createDataFrame([(1, 1, 0.9), (1, 0, 0.4), (0, 0, 0.2), (0, 1, 0.6)], "label int, prediction int, score double")
    r = ev.classification_metrics(scored).first()
    assert (r.tp, r.fp, r.fn, r.tn) == (1, 1, 1, 1) and r.precision == r.recall == r.f1 == r.accuracy == 0.5
    assert r.log_loss == pytest.approx(-np.mean(np.log([0.9, 0.4, 0.8, 0.4]))) and r.log_loss_hard == pytest.approx(-np.log(1e-15) / 2, rel=1e-3)


@pytest.fixture(scope="module")
def learnable(spark):
    df = spark.range(600).select("id", (F.rand(1) + F.col("id") * 0).alias("x"), F.rand(2).alias("noise")).withColumn("y", (F.col("x") > 0.5).cast("int")).cache()
    return df, md.assemble(df, ["x", "noise"], "y").cache()


def test_importance_finds_the_feature(learnable):
    _, ready = learnable
    model = LogisticRegression().fit(ready)
    rows = md.permutation_importance(model, ready, "id", ["x", "noise"], seed=3).collect()
    assert rows[0].feature == "x" and rows[0].weight > 0.3 and abs(rows[1].weight) < 0.1
    parents = md.parent_importance(md.permutation_importance(model, ready, "id", ["x", "noise"], seed=3), {"p": ["x"]}).collect()
    assert [r.feature for r in parents] == ["p", "noise"]
    assert md.tree_importance(ready, ["x", "noise"]).first().feature == "x"
    text = {(r.side, r.place): r.sentence for r in md.weight_sentences(ready, ["x", "noise"]).collect()}
    assert text[("positive", 1)] == "The strongest predictor is x"


@pytest.mark.parametrize("cell_rows", [10**6, 70])
def test_importance_against_brute_force(spark, monkeypatch, cell_rows):
    monkeypatch.setattr(md, "RANGE_ROWS", cell_rows)
    rng = random.Random(4)
    rows = [(i, *[rng.randint(-4, 4) for _ in range(3)], rng.randint(0, 1)) for i in range(400)]
    ready = md.assemble(spark.createDataFrame(rows, "id long, a int, b int, c int, y int"), ["a", "b", "c"], "y")
    weights, start = (1.0, -0.5, 0.0), 0.25
    got = {r.feature: r.weight for r in md.permutation_importance(md.LinearRule(weights, start), ready, "id", ["a", "b", "c"], seed=5).collect()}
    order = lambda turn: sorted(rows, key=lambda r: (int(hashlib.md5(f"{r[0]}-{5 + turn}".encode()).hexdigest()[:8], 16), r[0]))
    hits = dict.fromkeys(range(-1, 3), 0)
    for ring in map(order, range(5)):
        for own, other in zip(ring, ring[1:] + ring[:1]):
            for j in hits:
                x = [other[1 + i] if i == j else own[1 + i] for i in range(3)]
                hits[j] += (sum(w * v for w, v in zip(weights, x)) + start > 0) == (own[4] == 1)
    assert got == {f: pytest.approx((hits[-1] - hits[i]) / 2000) for i, f in enumerate("abc")} and got["c"] == 0


def test_linear_rules_decide_as_their_models(learnable):
    _, ready = learnable
    x = np.array([r.features.toArray() for r in ready.orderBy("id").collect()])
    for model in (LogisticRegression(threshold=0.3).fit(ready), LinearSVC(threshold=0.2).fit(ready)):
        want = [r.prediction == 1 for r in model.transform(ready).orderBy("id").collect()]
        assert md.linear_rule(model)(x).tolist() == want
    tree = md.DecisionTreeClassifier(seed=1).fit(ready)
    assert md.linear_rule(tree) is None
    assert md.permutation_importance(tree, ready, "id", ["x", "noise"], seed=3).first().feature == "x"


def test_importance_of_few_rows(spark):
    one = md.assemble(spark.createDataFrame([(1, 2.0, 1)], "id long, x double, y int"), ["x"], "y")
    assert [r.weight for r in md.permutation_importance(md.LinearRule((1.0,)), one, "id", ["x"], seed=1).collect()] == [0.0]
    assert md.permutation_importance(md.LinearRule((1.0,)), one.limit(0), "id", ["x"], seed=1).collect() == []


def test_date_columns_by_their_gaps(spark):
    days = [F.date_add(F.lit("2020-01-01").cast("date"), F.col("id").cast("int") * step) for step in (1, 300, 400)]
    df = spark.range(6).select(days[0].alias("near"), days[1].alias("wide"), days[2].alias("gap"),
                               F.when(F.col("id") < 3, days[0]).alias("half"), F.when(F.col("id") < 2, days[0]).alias("few"))
    assert prep.time_columns(df) == ["near", "wide", "half"]
    assert prep.time_columns(df.limit(0)) == ["near", "wide", "gap", "half", "few"] and prep.time_columns(df.select(F.lit(1).alias("n"))) == []


def test_search_and_svm(learnable):
    _, ready = learnable
    table, best = md.search_models(ready, "id", folds=2)
    assert table.count() == 6 and table.agg(F.max("score")).first()[0] > 0.95 and best is not None
    grid = md.svm_grid(ready, "id", costs=(1.0, 10.0), folds=2)
    assert grid.filter("best").count() == 1 and grid.agg(F.max("accuracy")).first()[0] > 0.9
    scored = md.score(LogisticRegression().fit(ready), ready)
    assert scored.filter("score < 0 or score > 1").count() == 0 and scored.filter((F.col("score") > 0.5) != (F.col("prediction") == 1)).count() == 0


def test_oversampling_levels_the_classes(spark):
    rng = random.Random(6)
    rows = [(i, int(i % 7 == 0), rng.randint(0, 30), rng.random()) for i in range(200)]
    df = spark.createDataFrame(rows, "id int, y int, v int, w double")
    made = md.oversample_minority(df, "id", "y", ["v", "w"], seed=1).collect()
    small = {r[0]: r for r in rows if r[1] == 1}
    assert len(made) == sum(1 for r in rows if r[1] == 0) - len(small)
    for r in made:
        a, b = small[r.id], small[r.neighbour]
        gap = lambda o: (o[2] - a[2]) ** 2 + (o[3] - a[3]) ** 2  # noqa: B023, E731
        gaps = sorted(gap(o) for i, o in small.items() if i != r.id)
        assert r.id != r.neighbour and gap(b) <= gaps[4]
        assert r.v == pytest.approx(a[2] + r.weight * (b[2] - a[2])) and 0 <= r.weight < 1


@pytest.mark.parametrize("dims", [1, 2, 5, 10])
def test_nearest_rows_against_brute_force(spark, dims):
    rng = np.random.default_rng(dims)
    x = np.round(rng.normal(size=(400, dims)), 1 if dims < 5 else 3)
    x[:130] = x[0]  # a third of the rows have one vector
    x[130:150, 0] += 50
    df = spark.createDataFrame([(i, *map(float, r)) for i, r in enumerate(x)] + [(900, *[None] * dims), (901, *[float("nan")] * dims)],
                               "id long, " + ", ".join(f"c{i} double" for i in range(dims)))
    got = {}
    for r in nearest_rows(df, "id", df.columns[1:], 5, leaf=20).collect():
        got.setdefault(r.id, {})[r["rank"]] = (r.neighbour, r.distance)
    assert set(got) == set(range(400))
    for i in range(400):
        square = np.zeros(400)
        for k in range(dims):
            square += np.square(x[i, k] - x[:, k])
        want = [j for j in np.lexsort((np.arange(400), square)) if j != i][:5]
        assert [got[i][n + 1] for n in range(5)] == [(j, pytest.approx(np.sqrt(square[j]))) for j in want]
    assert nearest_rows(df.where("id >= 900"), "id", df.columns[1:], 5).collect() == []
    assert [r.neighbour for r in nearest_rows(df.where("id in (3, 140)"), "id", df.columns[1:], 5).orderBy("id").collect()] == [140, 3]


def test_five_hundred_columns_are_searched_for_collinear_ones():
    rng = np.random.default_rng(5)
    x = rng.normal(size=(3000, 100))
    x = np.c_[x, x @ rng.normal(size=(100, 395)) + 0.3 * rng.normal(size=(3000, 395)), x[:, :5]]
    one = np.c_[np.ones(3000), x]
    start = time.time()
    products = one.T @ one
    gone = prep.removals(products, prep.MAX_VIF)
    assert time.time() - start < 10
    assert max(prep.vifs(products, [c for c in range(501) if c not in gone])) <= prep.MAX_VIF


def test_removals_follow_plain_regressions():
    """The same columns go as when every factor is a regression of its own."""
    rng = np.random.default_rng(4)
    for turn in range(12):
        x = rng.normal(rng.normal(0, 2), 1, (150, 4))
        extra = [x[:, :0], x[:, :1] * 2, x[:, :1] + rng.normal(0, 0.1, (150, 1)), np.full((150, 1), 3.0)][turn % 4]
        one = np.c_[np.ones(150), x, extra]

        def factors(chosen):
            out = []
            for c in chosen:
                rest = one[:, [d for d in chosen if d != c]]
                left = one[:, c] - (rest @ np.linalg.lstsq(rest, one[:, c], rcond=None)[0] if rest.size else 0)
                base = one[:, c] - (one[:, c].mean() if c and 0 in chosen else 0)
                out.append(np.inf if left @ left <= 1e-10 * (one[:, c] @ one[:, c]) else float(f"{base @ base / (left @ left):.7g}") if rest.size else 1.0)
            return out

        chosen, gone = list(range(one.shape[1])), []
        while max(found := factors(chosen)) > 10:
            means = [float(f"{np.mean(factors([d for d in chosen if d != c])):.7g}") for c in chosen]
            at = means.index(min(means)) if np.isinf(max(found)) else found.index(max(found))
            gone.append(chosen.pop(at))
        assert prep.removals(one.T @ one, 10) == gone


def test_parent_limits(spark):
    df = spark.createDataFrame([(1, 0, 2.0), (0, 1, 5.0)], "`c = x` int, `c = y` int, n double")
    rows = md.parent_limits(md.feature_limits(df, df.columns), {"c": ["c = x", "c = y"]}).collect()
    assert sorted((r.feature, r.min, r.max) for r in rows) == [("c", None, None), ("n", 2.0, 5.0)]


# ---- settlement ---------------------------------------------------------------------------

def test_allocated_guards(spark):
    df = spark.createDataFrame([(10, 3, 4), (10, 3, 0), (10, 3, None), (None, 3, 4)], "a int, q int, b int")
    got = [float(r.v) for r in df.select(settlement.allocated(F.col("a"), F.col("q"), F.col("b")).alias("v")).collect()]
    assert got == [7.5, 30.0, 30.0, 0.0]
    first = df.select(settlement.allocated(F.lit(100), F.lit(1), F.lit(3), divide_first=True).alias("v")).first().v
    assert str(first) == "33.3333330000" or str(first).startswith("33.33333")


def test_changes_read_the_transactions_once(spark, capsys):
    """Choice, sums and latest versions read the stored lines; only the bridge reads the table again."""
    day = lambda text: f"timestamp_ntz'{text}'"
    lines = [(10, 5, 2, 1, 4.0, "A", "F", day("2000-07-01")), (10, 5, 2, 1, 6.0, "A", "F", day("1999-07-01")), (20, 5, 2, 1, 4.0, "A", "F", day("1999-07-01")),
             (30, 5, 2, 1, 4.0, "N", "F", day("2000-07-01")), (40, 5, 2, 1, 8.0, "R", "F", day("1999-07-01"))]
    orders = [(10, 3, "F", 100.0, day("1999-01-01")), (20, 3, "F", 100.0, day("1999-01-01")), (30, 3, "F", 100.0, day("2000-08-01")), (40, 3, "F", 100.0, day("2000-08-01"))]
    line = spark.createDataFrame([r[:7] for r in lines], "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, l_returnflag string, l_linestatus string")
    dates = lambda rows, at, key: F.expr("CASE " + " ".join(f"WHEN {key(r)} THEN {r[at]}" for r in rows) + " END")
    tables = type("Rows", (), {
        "lineitem": line.withColumn("l_shipdate", dates(lines, 7, lambda r: f"l_orderkey = {r[0]} AND l_quantity = {r[4]}")),
        "orders": spark.createDataFrame([r[:4] for r in orders], "o_orderkey long, o_custkey long, o_orderstatus string, o_totalprice double").withColumn(
            "o_orderdate", dates(orders, 4, lambda r: f"o_orderkey = {r[0]}")).withColumn("o_orderpriority", F.lit("1-URGENT")),
        "customer": spark.createDataFrame([(3, "AUTOMOBILE")], "c_custkey long, c_mktsegment string"),
        "part": spark.createDataFrame([(5, "TYPE", "name", "Brand")], "p_partkey long, p_type string, p_name string, p_brand string"),
        "supplier": spark.createDataFrame([(2, "second")], "s_suppkey long, s_name string"),
        "nation": spark.createDataFrame([(3, "third")], "n_nationkey int, n_name string")})
    loaded = changed_settlement(tables)
    rows = sorted((r.contract_number, r.contract_type, r.change_date, r.actualization_dt_id, r.total_quantity_contract_uom, r.product_name) for r in loaded.collect())
    assert rows == [(10, "SALE", "2000-07-01", 20000701, 10.0, "name"), (40, "PURCHASE", "2000-08-01", 19990702, 8.0, "name")]
    loaded.select("*").explain()
    assert capsys.readouterr().out.count("Scan ExistingRDD[l_orderkey") == 1


# ---- sources and feeds --------------------------------------------------------------------

def test_jdbc_options():
    got = readers.jdbc_options("postgresql", "census", "t", "db", user="u", password="p", split_column="id", low=0, high=9, parts=4)
    assert got == {"url": "jdbc:postgresql://db:5432/census", "dbtable": "t", "user": "u", "password": "p", "partitionColumn": "id",
                   "lowerBound": "0", "upperBound": "9", "numPartitions": "4"}
    assert readers.jdbc_options("sqlite", "/x.db", "t")["url"] == "jdbc:sqlite:/x.db"
    with pytest.raises(ValueError):
        readers.jdbc_options("dbase", "x", "t")


def test_unknown_source(spark):
    with pytest.raises(ValueError, match="unknown source"):
        readers.read_source(spark, readers.SourceConfig("fax"))


def test_messy_text(spark, tmp_path):
    folder = tmp_path / "messy"
    folder.mkdir()
    for i in (1, 2):
        (folder / f"{i}.txt").write_text(f"# top\nfree line\n\nsecond # tail\nthird\nname Jan Feb\n# note\nA{i} 1.5 2\nB{i} 3 4 # end\n")
    got = sorted(tuple(r) for r in readers.read_messy_text(spark, str(folder)).collect())
    assert got == [("A1", 1.5, 2.0), ("A2", 1.5, 2.0), ("B1", 3.0, 4.0), ("B2", 3.0, 4.0)]


def test_stream_equals_batch(spark, tmp_path):
    rows = [(str(i), "10:00:00", f"V{i % 5}", 1.0, 2.0, float(i % 90)) for i in range(200)]
    df = spark.createDataFrame(rows, feeds.GPS_SCHEMA).repartition(4)
    path = writers.write_gps(df, str(tmp_path / "gps"), df.columns)
    alerts = feeds.speed_alerts(feeds.gps_feed(spark, path, 1), str(tmp_path / "out"), str(tmp_path / "state"))
    assert alerts.select("batch").distinct().count() == 4
    assert {(r.vin, r.speed) for r in alerts.groupBy("vin").agg(F.max("speed").alias("speed")).collect()} == {
        (r.vin, r.speed) for r in df.groupBy("vin").agg(F.max("speed").alias("speed")).collect()}
    assert alerts.filter(F.col("alert") != (F.col("speed") > 45)).count() == 0
    averages = feeds.running_average(feeds.gps_feed(spark, path, 1), ["vin"], F.col("speed"), str(tmp_path / "avg"), str(tmp_path / "avg-state"))
    assert {(r.vin, r.n) for r in averages.collect()} == {(f"V{i}", 40) for i in range(5)}


def test_messy_files_with_their_own_headers(spark, tmp_path):
    folder = tmp_path / "mixed"
    folder.mkdir()
    head = "made by hand\n\nfor a test # so\nthree\n"
    (folder / "a.txt").write_text(head + "name jan feb\nx 1 2\n# no row\ny 3 4 # tail\n")
    (folder / "b.txt").write_text(head + "feb name mar\n20 z 30\n5 w odd\n")
    (folder / "c.txt").write_text(head + "name jan feb\nv 7\n")
    got = readers.read_messy_text(spark, str(folder))
    assert got.dtypes == [("name", "string"), ("jan", "double"), ("feb", "double"), ("mar", "double")]
    assert sorted(map(tuple, got.collect())) == [("v", 7.0, None, None), ("w", None, 5.0, None), ("x", 1.0, 2.0, None), ("y", 3.0, 4.0, None), ("z", None, 20.0, 30.0)]


def test_change_log_of_many_batches(spark, tmp_path):
    log = feeds.ChangeLog(spark, f"file://{tmp_path}/log", ["k"], "k long, v string")
    assert log.read().collect() == []
    want = {}
    for n in range(50):
        rows = [(k, f"{n}") for k in {n % 7, n % 5, 100 + n}]
        want |= dict(rows)
        batch = spark.createDataFrame(rows, "k long, v string").coalesce(1)
        log.write(batch, n)
        if n in (15, 31, 40):  # a batch that comes again
            before = sorted(map(tuple, log.read().collect()))
            log.write(batch, n)
            assert sorted(map(tuple, log.read().collect())) == before
    got = log.read()
    assert {r.k: r.v for r in got.collect()} == want
    assert len(got.inputFiles()) <= 20
    # a fold that was cut off does not count
    next(p for p in (tmp_path / "log" / "snapshot=47").iterdir() if p.name == "_SUCCESS").unlink()
    shown = {r.k: r.v for r in log.read().collect()}
    assert all(shown[k] == v for k, v in want.items() if int(v) <= 47 and k in shown) and len(shown) >= 90 - 40


def test_capped_counts_stop_at_the_cap(spark):
    n = F.col("id")
    df = spark.range(0, 5000, 1, 7).select(
        (n % 5).alias("five"), n.alias("many"), F.when(n % 3 > 0, (n % 101).cast("string")).alias("a.b"), F.lit(None).cast("string").alias("none"), (n % 2 == 0).alias("flag"),
        F.when(n % 2 == 0, -0.0).when(n % 5 == 0, float("nan")).otherwise(0.0).alias("zero"), F.array(n % 3).alias("list"), F.date_add(F.lit("2020-01-01"), (n % 102).cast("int")).alias("day"))
    df = prep.nan_to_null(df)
    exact = {r["column"]: r.n for r in prep.distinct_counts(df, df.columns).collect()}
    for most in (1, 5, 100, 10_000):
        assert {r["column"]: r.n for r in prep.capped_counts(df, df.columns, most).collect()} == {c: min(v, most + 1) for c, v in exact.items()}
    assert prep.capped_counts(df, [], 3).collect() == []
    assert {r.n for r in prep.capped_counts(df.limit(0), df.columns, 3).collect()} == {0}
