"""Join jobs (J)."""

from pyspark.sql import functions as F

from tablemill.functions.numbers import total
from tablemill.operators import joining
from tablemill.operators.ordered import count_rising_pairs
from tablemill.registry import job


@job("j01_inner_join", """
    SELECT o_orderkey, c_name, c_mktsegment FROM orders JOIN customer ON o_custkey = c_custkey""")
def inner_join(t):
    return t.orders.join(t.customer, F.col("o_custkey") == F.col("c_custkey")).select("o_orderkey", "c_name", "c_mktsegment")


@job("j02_product", """
    SELECT c_custkey, r_name FROM customer, region""")
def product(t):
    return joining.product(t.customer.select("c_custkey"), t.region.select("r_name"))


@job("j03_self_join", """
    SELECT m.c_name AS manager, e.c_name AS employee FROM customer m JOIN customer e ON m.c_custkey = e.c_custkey // 4
    WHERE e.c_custkey > 0""")
def self_join(t):
    people = t.customer.select("c_custkey", "c_name", F.expr("c_custkey div 4").alias("mgr"))
    m, e = people.alias("m"), people.filter("c_custkey > 0").alias("e")
    return m.join(e, F.col("m.c_custkey") == F.col("e.mgr")).select(
        F.col("m.c_name").alias("manager"), F.col("e.c_name").alias("employee"))


@job("j04_reports_per_manager", """
    SELECT m.c_name AS manager, count(e.c_custkey) AS reports
    FROM customer m JOIN customer e ON m.c_custkey = e.c_custkey // 4 WHERE e.c_custkey > 0 GROUP BY m.c_name""")
def reports_per_manager(t):
    # count per manager key first, so the join carries one row per manager
    reports = (t.customer.filter("c_custkey > 0").groupBy(F.expr("c_custkey div 4").alias("mgr"))
               .agg(F.count(F.lit(1)).alias("reports")))
    return t.customer.join(reports, F.col("c_custkey") == F.col("mgr")).groupBy(F.col("c_name").alias("manager")).agg(
        F.sum("reports").alias("reports"))


@job("j05_left_join", """
    SELECT s_suppkey, n_name FROM supplier LEFT JOIN (SELECT * FROM nation WHERE n_nationkey < 20) ON s_nationkey = n_nationkey""")
def left_join(t):
    nation = t.nation.filter("n_nationkey < 20")
    return t.supplier.join(nation, F.col("s_nationkey") == F.col("n_nationkey"), "left").select("s_suppkey", "n_name")


@job("j06_join_measures_back", """
    SELECT o_orderkey, m.n_lines, m.qty FROM orders LEFT JOIN
      (SELECT l_orderkey, count(*) AS n_lines, CAST(sum(CAST(l_quantity AS DECIMAL(18,2))) AS DOUBLE) AS qty
       FROM lineitem GROUP BY 1) m ON l_orderkey = o_orderkey""")
def join_measures_back(t):
    measures = t.lineitem.groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(
        F.count(F.lit(1)).alias("n_lines"), total("l_quantity").alias("qty"))
    return t.orders.select("o_orderkey").join(measures, "o_orderkey", "left")


@job("j07_five_way_join", """
    SELECT n_name, p_brand, year(o_orderdate) AS year, count(*) AS n_lines,
           CAST(sum(CAST(l_extendedprice AS DECIMAL(18,2))) AS DOUBLE) AS amount
    FROM lineitem, (SELECT o_orderkey, o_orderdate FROM orders WHERE o_orderstatus = 'F') o, part, supplier, nation
    WHERE l_orderkey = o_orderkey AND l_partkey = p_partkey AND l_suppkey = s_suppkey AND s_nationkey = n_nationkey
    GROUP BY ALL""")
def five_way_join(t):
    closed = t.orders.filter(F.col("o_orderstatus") == "F").select("o_orderkey", F.year("o_orderdate").cast("bigint").alias("year"))
    return (
        t.lineitem.join(closed, F.col("l_orderkey") == F.col("o_orderkey"))
        .join(t.part, F.col("l_partkey") == F.col("p_partkey"))
        .join(t.supplier, F.col("l_suppkey") == F.col("s_suppkey"))
        .join(t.nation, F.col("s_nationkey") == F.col("n_nationkey"))
        .groupBy("n_name", "p_brand", "year")
        .agg(F.count(F.lit(1)).alias("n_lines"), total("l_extendedprice").alias("amount"))
    )


@job("j08_latest_version", """
    SELECT l_orderkey, l_linenumber, l_suppkey, l_linestatus, l_returnflag
    FROM lineitem i
    WHERE l_suppkey || strftime(l_shipdate, '%Y-%m-%d') || l_linestatus =
          (SELECT max(l_suppkey || strftime(l_shipdate, '%Y-%m-%d') || l_linestatus) FROM lineitem
           WHERE l_orderkey = i.l_orderkey AND l_linenumber = i.l_linenumber)
      AND l_returnflag IN ('A', 'R')""")
def latest_version(t):
    version = F.concat(F.col("l_suppkey"), F.date_format("l_shipdate", "yyyy-MM-dd"), F.col("l_linestatus"))
    return joining.latest_versions(t.lineitem, ["l_orderkey", "l_linenumber"], version,
                                   F.col("l_returnflag").isin("A", "R")).select(
        "l_orderkey", "l_linenumber", "l_suppkey", "l_linestatus", "l_returnflag")


@job("j09_semi_join", "SELECT c_custkey FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_totalprice > 400000)")
def semi_join(t):
    big = t.orders.filter("o_totalprice > 400000")
    return t.customer.join(big, F.col("c_custkey") == F.col("o_custkey"), "left_semi").select("c_custkey")


@job("j10_anti_join", """
    SELECT c_custkey FROM customer WHERE NOT EXISTS
      (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 400000)""")
def anti_join(t):
    big = t.orders.filter("o_totalprice > 400000")
    return t.customer.join(big, F.col("c_custkey") == F.col("o_custkey"), "left_anti").select("c_custkey")


@job("j11_lookup_with_default", """
    SELECT event_id, coalesce(n_name, 'not in the table') AS place FROM events LEFT JOIN nation ON user_id = n_nationkey""")
def lookup_with_default(t):
    return t.events.join(t.nation, F.col("user_id") == F.col("n_nationkey"), "left").select(
        "event_id", F.coalesce("n_name", F.lit("not in the table")).alias("place"))


@job("j12_unordered_pairs", """
    WITH seen AS (SELECT DISTINCT user_id, event_type FROM events)
    SELECT a.event_type AS first_type, b.event_type AS second_type, count(*) AS n_users
    FROM seen a JOIN seen b ON a.user_id = b.user_id AND a.event_type < b.event_type GROUP BY ALL""")
def unordered_pairs(t):
    # the array holds distinct event types, a short list whatever the number of events
    seen = t.events.groupBy("user_id").agg(F.array_sort(F.collect_set("event_type")).alias("types"))
    pair = F.explode(joining.combinations(F.col("types"), 2)).alias("pair")
    # equal type lists are counted once before they are expanded
    counted = seen.groupBy("types").agg(F.count(F.lit(1)).alias("n"))
    return counted.select(pair, "n").groupBy(
        F.col("pair")[0].alias("first_type"), F.col("pair")[1].alias("second_type")).agg(F.sum("n").alias("n_users"))


@job("j12_combinations_of_four", """
    WITH seen AS (SELECT DISTINCT user_id, event_type AS e FROM events)
    SELECT a.e || '+' || b.e || '+' || c.e || '+' || d.e AS types, count(*) AS n_users
    FROM seen a JOIN seen b ON a.user_id = b.user_id AND a.e < b.e JOIN seen c ON a.user_id = c.user_id AND b.e < c.e
    JOIN seen d ON a.user_id = d.user_id AND c.e < d.e GROUP BY ALL""")
def combinations_of_four(t):
    seen = t.events.groupBy("user_id").agg(F.array_sort(F.collect_set("event_type")).alias("types"))
    counted = seen.groupBy("types").agg(F.count(F.lit(1)).alias("n"))
    four = F.transform(joining.combinations(F.col("types"), 4), lambda c: F.array_join(c, "+"))
    return counted.select(F.explode(four).alias("types"), "n").groupBy("types").agg(F.sum("n").alias("n_users"))


@job("j13_rising_pairs", """
    SELECT a.l_orderkey, CAST(count(*) FILTER (a.l_linenumber < b.l_linenumber AND a.l_quantity < b.l_quantity) AS BIGINT) AS n_pairs
    FROM lineitem a JOIN lineitem b ON a.l_orderkey = b.l_orderkey GROUP BY 1 HAVING n_pairs > 0""")
def rising_pairs(t):
    pairs = count_rising_pairs(t.lineitem, ["l_orderkey"], "l_linenumber", "l_quantity")
    return pairs.filter("n_pairs > 0")


@job("j14_pair_to_goal", """
    WITH pairs AS (
      SELECT a.l_orderkey, a.l_quantity AS x, b.l_quantity AS y, b.l_linenumber AS place
      FROM lineitem a JOIN lineitem b ON a.l_orderkey = b.l_orderkey AND a.l_quantity + b.l_quantity = 50
        AND (a.l_linenumber < b.l_linenumber OR (a.l_linenumber = b.l_linenumber AND
             (a.l_quantity < b.l_quantity OR (a.l_quantity = b.l_quantity AND a.rowid_ < b.rowid_)))))
    SELECT l_orderkey, x AS first_value, y AS second_value FROM pairs
    QUALIFY row_number() OVER (PARTITION BY l_orderkey ORDER BY place, y, x) = 1""".replace(
    "FROM lineitem a JOIN lineitem b", """FROM (SELECT *, row_number() OVER () AS rowid_ FROM lineitem) a
      JOIN (SELECT *, row_number() OVER () AS rowid_ FROM lineitem) b"""))
def pair_to_goal(t):
    return joining.pair_to_goal(t.lineitem.select("l_orderkey", "l_linenumber", "l_quantity"),
                                ["l_orderkey"], "l_linenumber", "l_quantity", 50.0)


@job("j15_zip_shortest", """
    SELECT c.pos, c_custkey, s_suppkey FROM
      (SELECT c_custkey, row_number() OVER (ORDER BY c_custkey) AS pos FROM customer) c JOIN
      (SELECT s_suppkey, row_number() OVER (ORDER BY s_suppkey) AS pos FROM supplier) s ON c.pos = s.pos""")
def zip_shortest(t):
    return joining.zip_rows(t.customer.select("c_custkey"), t.supplier.select("s_suppkey"),
                            [F.col("c_custkey")], [F.col("s_suppkey")], "c_custkey", "s_suppkey")


@job("j15_zip_padded_arrays", """
    SELECT p_partkey, i - 1 AS pos, w[i] AS word, b[i] AS brand_part FROM
      (SELECT p_partkey, string_split(p_name, ' ') AS w, [p_brand] AS b,
              unnest(generate_series(1, greatest(len(string_split(p_name, ' ')), 1))) AS i FROM part)""")
def zip_padded_arrays(t):
    zipped = F.arrays_zip(F.split("p_name", " ").alias("w"), F.array("p_brand").alias("b"))
    return (t.part.select("p_partkey", F.posexplode(zipped).alias("pos", "z"))
            .select("p_partkey", F.col("pos").cast("bigint").alias("pos"), F.col("z.w").alias("word"), F.col("z.b").alias("brand_part")))


@job("j16_columns_side_by_side", """
    SELECT coalesce(p.pos, s.pos) AS pos, p_partkey, s_suppkey, s_name FROM
      (SELECT p_partkey, row_number() OVER (ORDER BY p_partkey) AS pos FROM part) p FULL JOIN
      (SELECT s_suppkey, s_name, row_number() OVER (ORDER BY s_suppkey) AS pos FROM supplier) s ON p.pos = s.pos""")
def columns_side_by_side(t):
    return joining.zip_rows(t.part.select("p_partkey"), t.supplier.select("s_suppkey", "s_name"),
                            [F.col("p_partkey")], [F.col("s_suppkey")], "p_partkey", "s_suppkey", how="full")
