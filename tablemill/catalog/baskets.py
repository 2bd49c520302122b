"""Market-basket jobs (B)."""

from pyspark.sql import functions as F

from tablemill.functions.numbers import money
from tablemill.operators.joining import union_all
from tablemill.operators.sorting import top_and_bottom
from tablemill.plans import basket as mb
from tablemill.registry import job
from tablemill.session import stage

# column -> condition, evaluated alike by Spark and by the oracle
FLAGS = {
    "flag = A": "l_returnflag = 'A'", "flag = N": "l_returnflag = 'N'", "flag = R": "l_returnflag = 'R'",
    "status = F": "l_linestatus = 'F'", "status = O": "l_linestatus = 'O'", "bulk": "l_quantity > 25", "small": "l_quantity <= 10",
    "discounted": "l_discount >= 0.05", "taxed": "l_tax >= 0.04", "closed": "l_linestatus = 'F'", "late": "year(l_shipdate) >= 1999"}
MEASURES = ["l_quantity", "l_extendedprice"]
ITEMS = sorted(c for c in FLAGS if c not in ("closed", "late"))


def basket_table(t):
    flags = [F.when(F.expr(cond), 1).otherwise(0).alias(name) for name, cond in FLAGS.items()]
    return t.lineitem.select(*flags, *[money(m).alias(m) for m in MEASURES])


ROWS = "r AS (SELECT row_number() OVER () AS id, * FROM lineitem), i AS (" + " UNION ALL ".join(
    f"SELECT id, '{c}' AS item FROM r WHERE {FLAGS[c]}" for c in ITEMS) + ")"
SETS = f"""{ROWS}, n AS (SELECT count(*) AS n_rows FROM r),
    one AS (SELECT item, count(*) AS n FROM i GROUP BY 1),
    two AS (SELECT a.item AS x, b.item AS y, count(*) AS n FROM i a JOIN i b ON a.id = b.id AND a.item < b.item GROUP BY ALL),
    three AS (SELECT a.item AS x, b.item AS y, c.item AS z, count(*) AS n FROM i a JOIN i b ON a.id = b.id AND a.item < b.item JOIN i c ON a.id = c.id AND b.item < c.item GROUP BY ALL),
    sets AS (SELECT * FROM (SELECT [item] AS items, n FROM one UNION ALL SELECT [x, y], n FROM two UNION ALL SELECT [x, y, z], n FROM three), n WHERE n >= 0.1 * n_rows)"""
RULES = f"""{SETS}, split AS (
      SELECT items, n, n_rows, [items[j]] AS a, list_filter(items, lambda x: x <> items[j]) AS c FROM sets, (SELECT unnest([1, 2, 3]) AS j) WHERE len(items) >= 2 AND j <= len(items)
      UNION ALL SELECT items, n, n_rows, list_filter(items, lambda x: x <> items[j]) AS a, [items[j]] AS c FROM sets, (SELECT unnest([1, 2, 3]) AS j) WHERE len(items) = 3),
    rules AS (SELECT s.items, a, c, s.n::DOUBLE / s.n_rows AS support, s.n::DOUBLE / sa.n AS confidence, (s.n * s.n_rows)::DOUBLE / (sa.n * sc.n) AS lift,
        (1 - sc.n::DOUBLE / s.n_rows) / (1 - s.n::DOUBLE / sa.n) AS conviction
      FROM split s JOIN sets sa ON sa.items = s.a JOIN sets sc ON sc.items = s.c WHERE s.n * s.n_rows >= sa.n * sc.n AND s.n < sa.n)"""
BEST = f"""{RULES}, top AS (SELECT *, array_to_string(a, ', ') AS at_, array_to_string(c, ', ') AS ct FROM rules ORDER BY lift DESC, at_, ct LIMIT 100),
    best AS (SELECT items, array_to_string(items, ', ') AS basket, support, lift FROM top QUALIFY row_number() OVER (PARTITION BY items ORDER BY lift DESC, at_, ct) = 1)"""
LISTED = f"""{BEST}, flagged AS (SELECT *, CASE WHEN lift >= (SELECT quantile_cont(lift, 0.9) FROM best) THEN 1 ELSE 0 END AS lift_highlight,
      CASE WHEN support >= (SELECT quantile_cont(support, 0.9) FROM best) THEN 1 ELSE 0 END AS support_highlight FROM best),
    listed AS (SELECT * FROM flagged f WHERE NOT EXISTS (SELECT 1 FROM flagged g WHERE len(g.items) > len(f.items) AND list_has_all(g.items, f.items)))"""


def found(t):
    return stage(mb.signatures(basket_table(t), ITEMS), "basket-signatures")


@job("b01_item_columns", f"SELECT item, count(*) AS n FROM (WITH {ROWS} SELECT item FROM i) GROUP BY 1")
def item_columns(t):
    table = basket_table(t)
    items = mb.item_columns(table, label="late")
    exploded = mb.signatures(table, items).select(F.explode("items").alias("item"), "n")
    return exploded.groupBy("item").agg(F.sum("n").alias("n"))


@job("b02_frequent_itemsets", f"WITH {SETS} SELECT array_to_string(items, ', ') AS items, n, n::DOUBLE / n_rows AS support FROM sets")
def frequent_itemsets(t):
    return mb.frequent_itemsets(found(t), mb.MIN_SUPPORT).select(
        F.array_join("items", ", ").alias("items"), "n", (F.col("n") / F.col("n_rows")).alias("support"))


@job("b03_rules", f"WITH {RULES} SELECT array_to_string(a, ', ') AS antecedents, array_to_string(c, ', ') AS consequents, support, confidence, lift, conviction FROM rules")
def rules(t):
    return mb.find_rules(found(t)).select(
        F.array_join("antecedents", ", ").alias("antecedents"), F.array_join("consequents", ", ").alias("consequents"),
        "support", "confidence", "lift", "conviction")


@job("b04_best_baskets", f"WITH {BEST} SELECT basket, support, lift FROM best")
def best_baskets(t):
    return mb.best_baskets(mb.find_rules(found(t))).drop("items")


@job("b05_top_decile_flags", f"WITH {LISTED} SELECT basket, lift_highlight, support_highlight FROM flagged")
def top_decile_flags(t):
    return mb.flag_top(mb.best_baskets(mb.find_rules(found(t))), ["lift", "support"]).select("basket", "lift_highlight", "support_highlight")


@job("b06_specific_baskets", f"WITH {LISTED} SELECT basket, support, lift FROM listed")
def specific_baskets(t):
    return mb.specific_baskets(mb.best_baskets(mb.find_rules(found(t)))).drop("items")


_PARTS = [f"{m}_{u}_{p}" for m in MEASURES for u in ("basket", "pop") for p in ("sum", "mean", "count")]
MEASURED = f"""{LISTED}, tags AS (SELECT id, list(item) AS tags FROM i GROUP BY 1),
    m AS (SELECT basket, """ + ", ".join(
    f"CAST(sum(CAST({m} AS DECIMAL(18,2))) AS DOUBLE) AS {m}_basket_sum, CAST(sum(CAST({m} AS DECIMAL(18,2))) AS DOUBLE) / count({m}) AS {m}_basket_mean, count({m}) AS {m}_basket_count"
    for m in MEASURES) + """ FROM listed JOIN tags ON list_has_all(tags, items) JOIN r USING (id) GROUP BY 1),
    p AS (SELECT """ + ", ".join(
    f"CAST(sum(CAST({m} AS DECIMAL(18,2))) AS DOUBLE) AS {m}_pop_sum, CAST(sum(CAST({m} AS DECIMAL(18,2))) AS DOUBLE) / count({m}) AS {m}_pop_mean, count({m}) AS {m}_pop_count"
    for m in MEASURES) + " FROM r), w AS (SELECT l.basket, support, lift, lift_highlight, support_highlight, m.* EXCLUDE (basket), p.* FROM listed l LEFT JOIN m ON m.basket = l.basket, p)"


@job("b07_basket_measures", f"WITH {MEASURED} SELECT *, " + ", ".join(
    f"CASE WHEN {c} >= (SELECT quantile_cont({c}, 0.9) FROM w) THEN 1 ELSE 0 END AS {c}_highlight" for c in _PARTS) + " FROM w")
def basket_measures(t):
    return mb.basket_report(basket_table(t), ITEMS, MEASURES).drop("items")


@job("b08_basket_views", f"""
    WITH {LISTED}, v AS (SELECT basket, lift, support FROM listed)
    SELECT * FROM ((SELECT 'lift' AS measure, 'top' AS part, basket, lift AS value FROM v ORDER BY lift DESC, basket LIMIT 5)
      UNION ALL (SELECT 'lift', 'bottom', basket, lift FROM v ORDER BY lift, basket LIMIT 5)
      UNION ALL (SELECT 'support', 'top', basket, support FROM v ORDER BY support DESC, basket LIMIT 5)
      UNION ALL (SELECT 'support', 'bottom', basket, support FROM v ORDER BY support, basket LIMIT 5)
      UNION ALL (SELECT 'marker', 'scaled', basket, round(15 + 15 * (support - (SELECT min(support) FROM v)) / (SELECT max(support) - min(support) FROM v), 6) FROM v))""")
def basket_views(t):
    listed = stage(mb.specific_baskets(mb.best_baskets(mb.find_rules(found(t)))).select("basket", "lift", "support"), "basket-views")
    views = [top_and_bottom(listed, m, "basket", 5).select(F.lit(m).alias("measure"), "part", "basket", F.col(m).alias("value")) for m in ("lift", "support")]
    low, high = listed.agg(F.min("support")).scalar(), listed.agg(F.max("support")).scalar()
    marker = listed.select(F.lit("marker").alias("measure"), F.lit("scaled").alias("part"), "basket",
                           F.round(15 + 15 * (F.col("support") - low) / (high - low), 6).alias("value"))
    return union_all([*views, marker])


@job("b08_measure_views", f"""
    WITH {MEASURED} SELECT * FROM ((SELECT 'top' AS part, basket, l_quantity_basket_mean AS value FROM w ORDER BY value DESC, basket LIMIT 5)
      UNION ALL (SELECT 'bottom', basket, l_quantity_basket_mean AS value FROM w ORDER BY value, basket LIMIT 5))""")
def measure_views(t, measure="l_quantity_basket_mean"):
    """First and last five baskets by any measure of the report."""
    report = stage(mb.basket_report(basket_table(t), ITEMS, MEASURES), "basket-report")
    return top_and_bottom(report, measure, "basket", 5).select("part", "basket", F.col(measure).alias("value"))


@job("b08_basket_lookup", f"""
    WITH {MEASURED} SELECT * FROM w WHERE basket = (SELECT basket FROM w ORDER BY lift DESC, basket LIMIT 1)""")
def basket_lookup(t):
    """All measures of one basket: the one of the highest lift."""
    report = stage(mb.basket_report(basket_table(t), ITEMS, MEASURES), "basket-report").drop("items", *[f"{c}_highlight" for c in _PARTS])
    chosen = report.agg(F.min(F.struct((-F.col("lift")).alias("l"), "basket"))).scalar()["basket"]
    return report.filter(F.col("basket") == chosen)
