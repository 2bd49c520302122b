"""Profiling and preparation jobs (D)."""

from pyspark.sql import functions as F

from tablemill.functions.names import clean_names, strip_symbol
from tablemill.operators.joining import union_all
from tablemill.plans import prepare as prep
from tablemill.plans import profile
from tablemill.registry import job

HEALTH = """SELECT '{t}' AS "table", n_rows, 100 * (1 - n_null / (n_rows * {cols})::DOUBLE) AS sparsity,
    CASE WHEN n_rows <= 1000 THEN n_rows / 20 WHEN n_rows < 7500 THEN 70 WHEN n_rows < 15000 THEN 90 ELSE 100 END::DOUBLE AS row_count,
    (least(100, 20 * {num}) + least(100, 20 * {other})) / 2.0::DOUBLE AS type_mix,
    CASE n_blown WHEN 0 THEN 100 WHEN 1 THEN 50 WHEN 2 THEN 25 ELSE 0 END::DOUBLE AS blowout
    FROM (SELECT count(*) AS n_rows, {nulls} AS n_null, {blown} AS n_blown FROM {src})"""


def _health_sql(table, numeric, other, src=None):
    blown = " + ".join(f"CASE WHEN count(DISTINCT {c}) > 100 THEN 1 ELSE 0 END" for c in other) or "0"
    nulls = " + ".join(f"(count(*) - count({c}))" for c in [*numeric, *other])
    return HEALTH.format(t=table, cols=len(numeric) + len(other), num=len(numeric), other=len(other), nulls=nulls, blown=blown, src=src or table)


DIRTY_SQL = """(SELECT c_custkey, CASE WHEN c_custkey % 20 = 3 THEN NULL ELSE c_mktsegment END AS segment, CASE WHEN c_custkey % 5 = 0 THEN NULL ELSE c_nationkey END AS nation,
    CASE WHEN c_custkey % 5 < 3 THEN NULL ELSE c_acctbal END AS balance, c_name, 1 AS same FROM customer)"""
# table -> numeric columns and others
_COLUMNS = {
    "region": (["r_regionkey"], ["r_name"]), "nation": (["n_nationkey", "n_regionkey"], ["n_name"]),
    "customer": (["c_custkey", "c_nationkey", "c_acctbal"], ["c_name", "c_mktsegment"]),
    "supplier": (["s_suppkey", "s_nationkey", "s_acctbal"], ["s_name"]),
    "part": (["p_partkey", "p_size", "p_retailprice"], ["p_name", "p_brand", "p_type"]),
    "orders": (["o_orderkey", "o_custkey", "o_totalprice"], ["o_orderstatus", "o_orderdate", "o_orderpriority"]),
    "lineitem": (["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax"],
                 ["l_returnflag", "l_linestatus", "l_shipdate"]),
    "events": (["event_id", "user_id", "value"], ["ts", "event_type", "props"]),
    "documents": (["doc_id", "n_chars"], ["text", "lang", "source"]), "embeddings": (["vec_id", "label"], ["embedding"]),
    "pages": (["page_id"], ["url", "html"]), "benchmark": (["item_id"], ["text"]), "labels": (["doc_id", "quality", "toxic"], []),
    "conversations": (["conv_id", "turn"], ["role", "text"])}
_HEALTH_SOURCES = [*(_health_sql(n, *c) for n, c in _COLUMNS.items()), _health_sql("dirty", ["c_custkey", "nation", "balance", "same"], ["segment", "c_name"], DIRTY_SQL)]


def dirty_customer(t):
    """Customers with nulls at about 5, 20 and 60 %, a constant column and a key."""
    key = F.col("c_custkey")
    return t.customer.select(
        "c_custkey", F.when(key % 20 != 3, F.col("c_mktsegment")).alias("segment"), F.when(key % 5 != 0, F.col("c_nationkey")).alias("nation"),
        F.when(key % 5 >= 3, F.col("c_acctbal")).alias("balance"), "c_name", F.lit(1).alias("same"))


@job("d01_health_score", "SELECT *, (sparsity + row_count + type_mix + blowout) / 4 AS health FROM (" + " UNION ALL ".join(_HEALTH_SOURCES) + ")")
def health_score(t):
    tables = {name: getattr(t, name) for name in _COLUMNS} | {"dirty": dirty_customer(t)}
    return union_all([profile.health_score(df).select(
        F.lit(name).alias("table"), "n_rows", "sparsity", "row_count", "type_mix", "blowout", "health") for name, df in tables.items()])


@job("d02_recommendations", f"""
    WITH d AS (FROM {DIRTY_SQL}), p AS (SELECT count(*) AS n, count(DISTINCT c_name) AS names, count(DISTINCT segment) AS segments FROM d)
    SELECT 'sparsity' AS part, 'many nulls' AS message, 'segment' AS "column", (n - (SELECT count(segment) FROM d))::DOUBLE / n AS value FROM p UNION ALL
    SELECT 'sparsity', 'many nulls', 'nation', (n - (SELECT count(nation) FROM d))::DOUBLE / n FROM p UNION ALL
    SELECT 'sparsity', 'many nulls', 'balance', (n - (SELECT count(balance) FROM d))::DOUBLE / n FROM p UNION ALL
    SELECT 'row_count', 'add rows', NULL, n::DOUBLE FROM p WHERE n < 15000 UNION ALL
    SELECT 'type_mix', 'add numeric fields', NULL, 4.0::DOUBLE UNION ALL SELECT 'type_mix', 'add categorical fields', NULL, 2.0::DOUBLE UNION ALL
    SELECT 'blowout', 'too many unique values', 'c_name', names::DOUBLE FROM p WHERE names > 100""")
def recommendations(t):
    return profile.recommendations(dirty_customer(t))


@job("d03_drop_sparse_columns", f"SELECT c_custkey, segment, c_name, same FROM {DIRTY_SQL}")
def drop_sparse_columns(t):
    return prep.drop_sparse(dirty_customer(t))


@job("d03_null_profile", f"""
    SELECT "column", kind, n_rows, n_rows - n AS n_null, nd AS n_distinct FROM (SELECT count(*) AS n_rows, unnest(['c_custkey', 'segment', 'nation', 'balance', 'c_name', 'same']) AS "column",
      unnest(['numeric', 'other', 'numeric', 'numeric', 'other', 'numeric']) AS kind,
      unnest([count(c_custkey), count(segment), count(nation), count(balance), count(c_name), count(same)]) AS n,
      unnest([count(DISTINCT c_custkey), count(DISTINCT segment), count(DISTINCT nation), count(DISTINCT balance), count(DISTINCT c_name), count(DISTINCT same)]) AS nd
      FROM {DIRTY_SQL})""")
def null_profile(t):
    return profile.column_profile(dirty_customer(t))


TEXT_SQL = """(SELECT o_orderkey, o_orderpriority, CASE WHEN o_orderkey % 50 = 0 THEN ' ' WHEN o_orderkey % 50 = 1 THEN 'n/a' ELSE CAST(o_custkey AS VARCHAR) END AS mostly,
    CASE WHEN o_orderkey % 3 = 0 THEN 'unknown' ELSE CAST(o_custkey AS VARCHAR) END AS rarely, o_orderdate FROM orders)"""


def text_orders(t):
    key, cust = F.col("o_orderkey"), F.col("o_custkey").cast("string")
    return t.orders.select("o_orderkey", "o_orderpriority", F.when(key % 50 == 0, " ").when(key % 50 == 1, "n/a").otherwise(cust).alias("mostly"),
                           F.when(key % 3 == 0, "unknown").otherwise(cust).alias("rarely"), "o_orderdate")


@job("d04_cardinality", f"""
    WITH s AS (SELECT count(DISTINCT o_orderkey) / count(*) AS a, count(DISTINCT o_orderpriority) / count(*) AS b, count(DISTINCT mostly) / count(*) AS c,
                 count(DISTINCT rarely) / count(*) AS d, count(*) FILTER (TRY_CAST(trim(mostly) AS DOUBLE) IS NULL) / count(*) AS cb,
                 count(*) FILTER (TRY_CAST(trim(rarely) AS DOUBLE) IS NULL) / count(*) AS db FROM {TEXT_SQL})
    SELECT 'o_orderkey' AS "column", CASE WHEN a >= 0.98 THEN 'drop' ELSE 'keep' END AS action FROM s UNION ALL
    SELECT 'o_orderpriority', CASE WHEN b >= 0.98 THEN 'drop' ELSE 'keep' END FROM s UNION ALL
    SELECT 'mostly', CASE WHEN c < 0.1 THEN 'keep' WHEN c >= 0.98 OR cb > 0.1 THEN 'drop' ELSE 'repair' END FROM s UNION ALL
    SELECT 'rarely', CASE WHEN d < 0.1 THEN 'keep' WHEN d >= 0.98 OR db > 0.1 THEN 'drop' ELSE 'repair' END FROM s UNION ALL SELECT 'o_orderdate', 'keep'""")
def cardinality(t):
    actions = prep.cardinality_actions(text_orders(t))
    return t.spark.createDataFrame(list(actions.items()), "column string, action string")


@job("d05_repair_number", f"""
    SELECT o_orderkey, TRY_CAST(trim(mostly) AS DOUBLE) AS mostly FROM {TEXT_SQL}""")
def repair_number(t):
    return prep.repair_number(text_orders(t).select("o_orderkey", "mostly"), "mostly")


SERIAL_SQL = "date_diff('day', DATE '1899-12-30', o_orderdate::DATE)"


@job("d06_excel_dates", f"""
    SELECT 'serial' AS "column", min(s) > 25569 AND max(s) - min(s) > 1 AND max(s) < date_diff('day', DATE '1899-12-30', DATE '2005-01-01') + 3650 AS is_date FROM (SELECT {SERIAL_SQL} AS s FROM orders)
    UNION ALL SELECT 'o_custkey', min(o_custkey) > 25569 FROM orders UNION ALL SELECT 'o_totalprice', max(o_totalprice) < 40000 FROM orders""")
def excel_dates(t):
    days = F.date_diff(F.col("o_orderdate").cast("date"), F.lit("1899-12-30").cast("date"))
    table = t.orders.select(days.alias("serial"), "o_custkey", "o_totalprice")
    found = prep.excel_date_columns(table, "2005-01-01")
    return t.spark.createDataFrame([(c, c in found) for c in table.columns], "column string, is_date boolean")


# column -> pattern of the texts that are to be read as dates
DATE_TEXTS = {
    "day_first": "dd/MM/yyyy", "month_first": "MM/dd/yyyy", "one_digit": "d/M/yyyy", "with_time": "dd/MM/yyyy HH:mm:ss", "two_digit_year": "M/d/yy",
    "year_first": "yyyy-M-d", "with_t": "yyyy-MM-dd'T'HH:mm:ss", "month_name": "MMM d, yyyy", "long_name": "d MMMM yyyy", "dashed_name": "dd-MMM-yyyy"}


@job("d06_convert_dates", """
    SELECT o_orderkey, o_orderpriority, """ + ", ".join(f"strftime(o_orderdate, '%Y-%m-%d') AS {c}" for c in (
        "serial", *DATE_TEXTS)) + " FROM orders")
def convert_dates(t):
    days = F.date_diff(F.col("o_orderdate").cast("date"), F.lit("1899-12-30").cast("date"))
    texts = [F.date_format("o_orderdate", pattern).alias(c) for c, pattern in DATE_TEXTS.items()]
    raw = t.orders.select("o_orderkey", days.alias("serial"), *texts, "o_orderpriority")
    made = prep.handle_dates(raw, "csv", "2005-01-01")
    return made.withColumns({c: F.date_format(c, "yyyy-MM-dd") for c in ("serial", *DATE_TEXTS)})


@job("d06_nanosecond_dates", """
    SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d') AS nanos, o_custkey FROM orders""")
def nanosecond_dates(t):
    """Numbers of nanoseconds in input that is neither csv nor excel."""
    raw = t.orders.select("o_orderkey", (F.unix_micros(F.col("o_orderdate").cast("timestamp")) * 1000).alias("nanos"), "o_custkey")
    return prep.handle_dates(raw, "parquet", "2005-01-01").withColumn("nanos", F.date_format("nanos", "yyyy-MM-dd"))


@job("d07_blown_columns", """
    SELECT doc_id, lang, source, n_chars FROM documents""")
def blown_columns(t):
    return prep.drop_blown(t.documents)


@job("d08_null_rows_dropped", """
    SELECT p_partkey, p_size, p_type FROM (SELECT p_partkey, CASE WHEN p_partkey % 200 = 0 THEN NULL ELSE p_size END AS p_size, p_type FROM part) WHERE p_size IS NOT NULL""")
def null_rows_dropped(t):
    rare = t.part.select("p_partkey", F.when(F.col("p_partkey") % 200 != 0, F.col("p_size")).alias("p_size"), "p_type")
    return prep.handle_nulls(rare, "drop")


@job("d08_means_filled", """
    WITH x AS (SELECT p_partkey, CASE WHEN p_partkey % 7 = 0 THEN NULL ELSE p_size END AS p_size, CASE WHEN p_partkey % 9 = 0 THEN NULL ELSE p_type END AS p_type,
                 CASE WHEN p_partkey % 5 = 0 THEN NULL ELSE p_size * 2 END AS holes FROM part)
    SELECT p_partkey::DOUBLE AS p_partkey, coalesce(p_size::DOUBLE, (SELECT sum(p_size)::DOUBLE / count(p_size) FROM x)) AS p_size, p_type,
      coalesce(holes::DOUBLE, (SELECT sum(holes)::DOUBLE / count(holes) FROM x)) AS holes FROM x""")
def means_filled(t):
    """Nulls and NaN alike take the mean of what is known."""
    key = F.col("p_partkey")
    holed = t.part.select("p_partkey", F.when(key % 7 != 0, F.col("p_size")).alias("p_size"), F.when(key % 9 != 0, F.col("p_type")).alias("p_type"),
                          F.when(key % 5 != 0, F.col("p_size") * 2.0).otherwise(F.lit(float("nan"))).alias("holes"))
    return prep.handle_nulls(holed, "drop")


@job("d09_variance_inflation", """
    WITH r AS (SELECT corr(l_quantity, l_extendedprice) AS a, corr(l_quantity, l_discount) AS b, corr(l_extendedprice, l_discount) AS c FROM lineitem),
         d AS (SELECT *, 1 + 2 * a * b * c - a ** 2 - b ** 2 - c ** 2 AS det FROM r)
    SELECT 'l_quantity' AS "column", round((1 - c ** 2) / det, 5) AS vif FROM d UNION ALL
    SELECT 'l_extendedprice', round((1 - b ** 2) / det, 5) FROM d UNION ALL SELECT 'l_discount', round((1 - a ** 2) / det, 5) FROM d""")
def variance_inflation(t):
    columns = ["l_quantity", "l_extendedprice", "l_discount"]
    found = prep.vifs(prep.cross_products(t.lineitem, columns), [0, 1, 2, 3])
    return t.spark.createDataFrame([(c, round(v, 5)) for c, v in zip(columns, found[1:])], "column string, vif double")


@job("d09_collinear_columns")
def collinear_columns(t):
    """A column, its double and a near copy: the repeats must go, the independent columns stay."""
    table = t.lineitem.select("l_quantity", "l_discount", "l_tax", (F.col("l_quantity") * 2).alias("twice"),
                              (F.col("l_discount") + F.col("l_linenumber") / 10000).alias("near"))
    gone = prep.collinear_columns(table, table.columns)
    return t.spark.createDataFrame([(i, c) for i, c in enumerate(gone)], "round int, column string")


ORDER_CUSTOMER = """(SELECT o_orderkey, o_totalprice, o_orderstatus, o_orderpriority, c_mktsegment, CAST(o_orderkey % 3 AS INTEGER) AS third, CASE WHEN o_orderkey % 2 = 0 THEN 'True' ELSE 'False' END AS even FROM orders JOIN customer ON c_custkey = o_custkey)"""
_DUMMIES = [("o_orderstatus", ["F", "O", "P"]), ("o_orderpriority", ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]),
            ("c_mktsegment", ["AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY"]), ("third", [0, 1, 2]), ("even", ["False", "True"])]


def order_customer(t):
    return t.orders.join(t.customer, F.col("o_custkey") == F.col("c_custkey")).select(
        "o_orderkey", "o_totalprice", "o_orderstatus", "o_orderpriority", "c_mktsegment", (F.col("o_orderkey") % 3).cast("int").alias("third"),
        (F.col("o_orderkey") % 2 == 0).alias("even"))


@job("d10_dummy_columns", "SELECT o_orderkey, o_totalprice, " + ", ".join(
    f"""CASE WHEN {c} = '{v}' THEN 1 ELSE 0 END AS "{c} = {v}" """ for c, vs in _DUMMIES for v in vs) + f" FROM {ORDER_CUSTOMER}")
def dummy_columns(t):
    return prep.dummy_columns(order_customer(t))[0]


@job("d10_dummy_memory", " UNION ALL ".join(f"SELECT DISTINCT '{c}' AS parent, '{c} = ' || {c} AS child FROM {ORDER_CUSTOMER}" for c, _ in _DUMMIES))
def dummy_memory(t):
    return prep.memory_table(t.spark, prep.dummy_columns(order_customer(t))[1])


@job("d11_recode_label", "SELECT doc_id, quality, quality AS numbers, quality AS flags FROM labels")
def recode_label(t):
    """Texts, doubles against the text 1, and booleans."""
    good = F.col("quality") == 1
    worded = t.labels.select("doc_id", F.when(good, "good").otherwise("bad").alias("quality"), F.col("quality").cast("double").alias("numbers"), good.alias("flags"))
    for column, positive in (("quality", "good"), ("numbers", "1"), ("flags", True)):
        worded = prep.recode_label(worded, column, positive)
    return worded


@job("d12_series_columns", """
    SELECT 'o_orderdate' AS "column", 'time' AS role FROM orders HAVING count(*) > 0 UNION ALL SELECT 'o_totalprice', 'feature' UNION ALL
    SELECT 'urgent', 'feature' FROM orders HAVING avg(CASE WHEN o_orderpriority = '1-URGENT' THEN 1 ELSE 0 END) BETWEEN 0.05 AND 0.95 UNION ALL
    SELECT 'rare', 'feature' FROM orders HAVING avg(CASE WHEN o_orderkey % 100 = 0 THEN 1 ELSE 0 END) BETWEEN 0.05 AND 0.95""")
def series_columns(t):
    key = F.col("o_orderkey")
    table = t.orders.select(
        "o_orderdate", "o_totalprice", F.when(F.col("o_orderpriority") == "1-URGENT", 1).otherwise(0).alias("urgent"),
        F.when(key % 100 == 0, 1).otherwise(0).alias("rare"), F.when(key % 3 == 0, F.col("o_orderdate")).alias("mostly_null"),
        F.when(F.year("o_orderdate") != 1998, F.col("o_orderdate")).alias("gap_year"))
    rows = [(c, "time") for c in prep.time_columns(table)] + [(c, "feature") for c in prep.feature_columns(table)]
    return t.spark.createDataFrame(rows, "column string, role string")


def raw_orders(t):
    """Orders with customers as they might come from a file: odd names, money texts, holes, keys."""
    key = F.col("o_orderkey")
    return t.orders.join(t.customer, F.col("o_custkey") == F.col("c_custkey")).select(
        key.alias("order key"), F.concat(F.lit("$"), F.col("o_totalprice").cast("decimal(18,2)").cast("string")).alias("Total Price-USD"),
        F.col("c_acctbal").alias("balance"), F.when(key % 300 != 0, F.col("c_nationkey")).alias("nation"),
        (F.col("c_nationkey") * 2 + F.col("c_custkey") % 2).alias("nation twice"), F.col("c_mktsegment").alias("segment"),
        F.col("c_name").alias("customer"), F.when(key % 4 == 0, F.col("o_orderpriority")).alias("sparse"), F.col("o_orderpriority").alias("priority"),
        F.date_format("o_orderdate", "yyyy-MM-dd").alias("order date"), F.when(F.col("o_orderstatus") == "F", "yes").otherwise("no").alias("closed"))


PREPARE = prep.PrepareConfig(label="closed", positive="yes", block_list=("customer",), now="2005-01-01")


@job("d13_prepare_table")
def prepare_table(t):
    return prep.prepare(raw_orders(t), PREPARE).table


@job("d13_prepare_report")
def prepare_report(t):
    return prep.prepare(raw_orders(t), PREPARE).report_table()


@job("d14_label_values", """SELECT o_orderstatus AS value, count(*) AS n FROM orders GROUP BY 1""")
def label_values(t, field="o_orderstatus"):
    return t.orders.groupBy(F.col(field).alias("value")).agg(F.count(F.lit(1)).alias("n"))


@job("d14_field_names", """
    SELECT unnest(['o_orderkey', 'o_custkey', 'o_orderstatus', 'o_totalprice', 'o_orderdate', 'o_orderpriority']) AS field, count(*) AS n_rows FROM orders""")
def field_names(t):
    counted = t.orders.agg(*[F.count(F.lit(1)).alias(c) for c in t.orders.columns])
    return counted.unpivot([], t.orders.columns, "field", "n_rows")


@job("d15_first_rows", """
    SELECT 'raw' AS stage, '$' || c_custkey AS balance, c_name FROM (SELECT * FROM customer ORDER BY c_custkey LIMIT 1) UNION ALL
    SELECT 'clean', CAST(c_custkey AS VARCHAR), c_name FROM (SELECT * FROM customer ORDER BY c_custkey LIMIT 1)""")
def first_rows(t):
    raw = t.customer.select("c_custkey", F.concat(F.lit("$"), F.col("c_custkey")).alias("balance"), "c_name")
    clean = strip_symbol(clean_names(raw))
    return union_all([df.orderBy("c_custkey").limit(1).select(F.lit(s).alias("stage"), "balance", "c_name") for s, df in (("raw", raw), ("clean", clean))])
