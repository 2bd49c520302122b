"""Projection, filter and predicate jobs (P)."""

from pyspark.sql import functions as F

from tablemill.functions import names
from tablemill.functions.numbers import guard_divisor, row_sum
from tablemill.operators.ordered import positions
from tablemill.registry import job


@job("p01_projection", "SELECT c_custkey, c_name FROM customer")
def projection(t):
    return t.customer.select("c_custkey", "c_name")


@job("p02_computed_column", """
    SELECT l_orderkey, l_linenumber, l_extendedprice - l_quantity AS price_change FROM lineitem""")
def computed_column(t):
    return t.lineitem.select("l_orderkey", "l_linenumber",
                             (F.col("l_extendedprice") - F.col("l_quantity")).alias("price_change"))


@job("p03_and_filter", """
    SELECT o_orderkey, o_orderstatus, o_totalprice FROM orders
    WHERE o_orderstatus = 'F' AND o_orderpriority <> '1-URGENT' AND o_totalprice > 100000""")
def and_filter(t):
    return t.orders.filter(
        (F.col("o_orderstatus") == "F") & (F.col("o_orderpriority") != "1-URGENT") & (F.col("o_totalprice") > 100000)
    ).select("o_orderkey", "o_orderstatus", "o_totalprice")


@job("p04_in_list", """
    SELECT c_custkey, c_mktsegment FROM customer WHERE c_mktsegment IN ('BUILDING', 'MACHINERY')""")
def in_list(t):
    return t.customer.filter(F.col("c_mktsegment").isin("BUILDING", "MACHINERY")).select("c_custkey", "c_mktsegment")


@job("p05_like", """
    SELECT p_partkey, p_name FROM part WHERE p_name LIKE '%widget' AND p_name NOT LIKE 'red%'""")
def like(t):
    return t.part.filter(F.col("p_name").like("%widget") & ~F.col("p_name").like("red%")).select("p_partkey", "p_name")


@job("p06_mask", """
    SELECT p_partkey, CASE WHEN p_partkey % 7 = 0 THEN NULL ELSE p_size END AS size FROM part
    WHERE CASE WHEN p_partkey % 7 = 0 THEN NULL ELSE p_size END >= 30""")
def mask(t):
    holed = t.part.select("p_partkey", F.when(F.col("p_partkey") % 7 != 0, F.col("p_size")).alias("size"))
    return holed.filter(F.col("size") >= 30)


@job("p07_split_by_predicate", """
    SELECT event_type, coalesce(value >= 50, false) AS passed, count(*) AS n,
           min(event_id) AS first_id
    FROM (SELECT event_id, event_type, CASE WHEN event_id % 7 = 0 THEN NULL ELSE value END AS value FROM events)
    GROUP BY ALL""")
def split_by_predicate(t):
    holed = t.events.select("event_id", "event_type",
                            F.when(F.col("event_id") % 7 != 0, F.col("value")).alias("value"))
    passed = F.coalesce(F.col("value") >= 50, F.lit(False))
    return holed.groupBy("event_type", passed.alias("passed")).agg(
        F.count(F.lit(1)).alias("n"), F.min("event_id").alias("first_id"))


@job("p08_drop_columns", "SELECT c_custkey, c_nationkey, c_mktsegment FROM customer")
def drop_columns(t, blocked=("c_name", "c_acctbal")):
    return t.customer.drop(*blocked)


@job("p09_rename", "SELECT o_orderkey AS ds, o_totalprice AS y FROM orders")
def rename(t):
    return t.orders.select("o_orderkey", "o_totalprice").withColumnsRenamed({"o_orderkey": "ds", "o_totalprice": "y"})


@job("p10_two_way_label", """
    SELECT l_orderkey, l_linenumber, l_partkey,
           CASE WHEN q > 25 THEN 'sufficient' ELSE 'insufficient' END AS supply
    FROM (SELECT *, CASE WHEN l_partkey % 7 = 0 THEN NULL ELSE l_quantity END AS q FROM lineitem)""")
def two_way_label(t):
    quantity = F.when(F.col("l_partkey") % 7 != 0, F.col("l_quantity"))
    return t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey",
                             F.when(quantity > 25, "sufficient").otherwise("insufficient").alias("supply"))


@job("p11_fill_nulls", """
    SELECT p_partkey, coalesce(CASE WHEN p_partkey % 7 = 0 THEN NULL ELSE p_size END, 4) AS p_size,
           CASE WHEN p_partkey % 5 = 0 THEN NULL ELSE p_retailprice END AS p_retailprice
    FROM part""")
def fill_nulls(t):
    holed = t.part.select(
        "p_partkey", F.when(F.col("p_partkey") % 7 != 0, F.col("p_size")).alias("p_size"),
        F.when(F.col("p_partkey") % 5 != 0, F.col("p_retailprice")).alias("p_retailprice"))
    return holed.fillna(4, subset=["p_size"])


@job("p12_cast", """
    SELECT l_orderkey, l_linenumber, CAST(CAST(l_extendedprice AS DECIMAL(28,10)) AS DOUBLE) AS price,
           CAST(l_quantity AS INTEGER) AS quantity,
           TRY_CAST(CASE WHEN l_partkey % 9 = 0 THEN 'n/a' ELSE CAST(l_linenumber AS VARCHAR) END AS INTEGER) AS dirty
    FROM lineitem""")
def cast(t):
    text = F.when(F.col("l_partkey") % 9 == 0, "n/a").otherwise(F.col("l_linenumber").cast("string"))
    return t.lineitem.select(
        "l_orderkey", "l_linenumber", F.col("l_extendedprice").cast("decimal(28,10)").cast("double").alias("price"),
        F.col("l_quantity").cast("int").alias("quantity"), text.try_cast("int").alias("dirty"))


@job("p13_null_and_zero_guards", """
    SELECT l_orderkey, l_linenumber, coalesce(q, 0) AS quantity,
           l_extendedprice / CASE WHEN coalesce(d, 0) = 0 THEN 1.0::DOUBLE ELSE d END AS per_unit,
           coalesce(CASE WHEN l_returnflag = 'A' THEN q WHEN l_returnflag = 'R' THEN d ELSE 0 END, 0) AS picked,
           greatest(q, d) AS larger
    FROM (SELECT *, CASE WHEN l_partkey % 7 = 0 THEN NULL ELSE l_quantity END AS q,
                 CASE WHEN l_partkey % 5 = 0 THEN NULL WHEN l_partkey % 3 = 0 THEN 0 ELSE l_tax + 1 END AS d
          FROM lineitem)""")
def null_and_zero_guards(t):
    q, d = F.col("q"), F.col("d")
    holed = t.lineitem.withColumns({
        "q": F.when(F.col("l_partkey") % 7 != 0, F.col("l_quantity")),
        "d": F.when(F.col("l_partkey") % 5 == 0, None).when(F.col("l_partkey") % 3 == 0, 0.0).otherwise(F.col("l_tax") + 1),
    })
    return holed.select(
        "l_orderkey", "l_linenumber", F.nvl(q, F.lit(0.0)).alias("quantity"),
        (F.col("l_extendedprice") / guard_divisor(d)).alias("per_unit"),
        F.nvl(F.when(F.col("l_returnflag") == "A", q).when(F.col("l_returnflag") == "R", d).otherwise(0.0), F.lit(0.0)).alias("picked"),
        F.greatest(q, d).alias("larger"))


@job("p14_composite_key", """
    SELECT o_orderkey, status || '|#|' || o_orderkey || '|#|' || o_custkey AS alternate_key,
           status || '|#|' || o_orderkey || '|#|' || o_custkey || '|#|' || change_id AS natural_key
    FROM (SELECT *, CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE o_orderstatus END AS status,
                 CAST(strftime(o_orderdate, '%Y%m%d') AS INTEGER) AS change_id FROM orders)""")
def composite_key(t, sep="|#|"):
    status = F.when(F.col("o_orderkey") % 7 != 0, F.col("o_orderstatus"))
    change_id = F.date_format("o_orderdate", "yyyyMMdd").cast("int")
    # concat keeps null -> null; concat_ws would skip the missing part
    alternate = F.concat(status, F.lit(sep), F.col("o_orderkey"), F.lit(sep), F.col("o_custkey"))
    return t.orders.select("o_orderkey", alternate.alias("alternate_key"),
                           F.concat(alternate, F.lit(sep), change_id).alias("natural_key"))


@job("p15_clean_names", """
    SELECT p_partkey AS part_key, p_name AS _1st_name, p_size AS Size_in_cm, p_brand AS Brand FROM part""")
def clean_names(t):
    odd = t.part.select(F.col("p_partkey").alias(" part key "), F.col("p_name").alias("1st name"),
                        F.col("p_size").alias("Size-in (cm)"), F.col("p_brand").alias("_Brand!"))
    return names.clean_names(odd)


@job("p16_strip_symbol", """
    SELECT c_custkey, replace('$' || c_custkey || '$', '$', '') AS amount, c_name FROM customer""")
def strip_symbol(t):
    priced = t.customer.select("c_custkey", F.concat(F.lit("$"), "c_custkey", F.lit("$")).alias("amount"), "c_name")
    return names.strip_symbol(priced)


@job("p17_columns_by_type", "SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, l_quantity, l_extendedprice, l_discount, l_tax FROM lineitem")
def columns_by_type(t):
    return t.lineitem.select(*names.numeric_columns(t.lineitem))


@job("p18_transpose", """
    SELECT o_orderpriority AS priority,
           count(*) FILTER (year(o_orderdate) = 1995) AS y1995, count(*) FILTER (year(o_orderdate) = 1996) AS y1996,
           count(*) FILTER (year(o_orderdate) = 1997) AS y1997, count(*) FILTER (year(o_orderdate) = 1998) AS y1998,
           count(*) FILTER (year(o_orderdate) = 1999) AS y1999, count(*) FILTER (year(o_orderdate) = 2000) AS y2000,
           count(*) FILTER (year(o_orderdate) = 2001) AS y2001
    FROM orders GROUP BY o_orderpriority""")
def transpose(t):
    priorities = ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]
    years = [f"y{y}" for y in range(1995, 2002)]
    by_year = (t.orders.groupBy(F.concat(F.lit("y"), F.year("o_orderdate")).alias("year"))
               .pivot("o_orderpriority", priorities).count().na.fill(0))
    # rows become columns: long form first, then the old row labels as pivot values
    long = by_year.unpivot("year", priorities, "priority", "n")
    return long.groupBy("priority").pivot("year", years).agg(F.max("n")).na.fill(0)


@job("p19_head_and_tail", """
    (SELECT 'head' AS part, o_orderkey, o_totalprice FROM orders ORDER BY o_orderkey LIMIT 10)
    UNION ALL (SELECT 'tail' AS part, o_orderkey, o_totalprice FROM orders ORDER BY o_orderkey DESC LIMIT 10)""")
def head_and_tail(t, n=10):
    o = t.orders.select("o_orderkey", "o_totalprice")
    head = o.orderBy("o_orderkey").limit(n).select(F.lit("head").alias("part"), "*")
    tail = o.orderBy(F.desc("o_orderkey")).limit(n).select(F.lit("tail").alias("part"), "*")
    return head.unionByName(tail)


@job("p20_enumerate", """
    SELECT c_custkey, c_acctbal, row_number() OVER (ORDER BY c_acctbal, c_custkey) - 1 AS from_zero,
           row_number() OVER (ORDER BY c_acctbal, c_custkey) AS from_one FROM customer""")
def enumerate_rows(t):
    numbered = positions(t.customer.select("c_custkey", "c_acctbal"), [F.col("c_acctbal"), F.col("c_custkey")],
                         on=["c_acctbal", "c_custkey"], name="from_one")
    return numbered.withColumn("from_zero", F.col("from_one") - 1)


@job("p21_row_sum", "SELECT l_orderkey, l_linenumber, l_quantity + l_discount + l_tax AS row_total FROM lineitem")
def row_total(t):
    return t.lineitem.select("l_orderkey", "l_linenumber", row_sum("l_quantity", "l_discount", "l_tax").alias("row_total"))
