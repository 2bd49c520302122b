"""Aggregation jobs (A)."""

import string

from pyspark.sql import Window
from pyspark.sql import functions as F

from tablemill.functions import text as tx
from tablemill.functions.numbers import money, total
from tablemill.operators import summary
from tablemill.operators.ordered import exact_quantiles, positions
from tablemill.registry import job

PUNCTUATION = string.punctuation.replace("'", "''")
BLANKS = "[ \\t\\n\\r\\f]+"
PLAIN_WORDS = f"""(SELECT doc_id, unnest(list_filter(string_split_regex(lower(translate(text, '{PUNCTUATION}', '')), '{BLANKS}'),
        lambda w: w <> '')) AS word FROM documents)"""


@job("a01_group_sum", """
    SELECT o_orderstatus, CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) AS amount, count(*) AS n
    FROM orders GROUP BY 1""")
def group_sum(t):
    return t.orders.groupBy("o_orderstatus").agg(total("o_totalprice").alias("amount"), F.count(F.lit(1)).alias("n"))


@job("a02_count_distinct", """
    SELECT l_returnflag, count(DISTINCT l_partkey) AS parts, count(DISTINCT l_suppkey) AS suppliers FROM lineitem GROUP BY 1""")
def count_distinct(t):
    return t.lineitem.groupBy("l_returnflag").agg(
        F.count_distinct("l_partkey").alias("parts"), F.count_distinct("l_suppkey").alias("suppliers"))


@job("a03_global_totals", """
    SELECT CAST(sum(CAST(l_quantity AS DECIMAL(18,2))) AS DOUBLE) AS total, count(*) AS n,
           CAST(sum(CAST(l_quantity AS DECIMAL(18,2))) AS DOUBLE) / count(*) AS average,
           CAST(sum(CAST(CASE WHEN l_quantity > 1000 THEN l_quantity END AS DECIMAL(18,2))) AS DOUBLE)
             / nullif(count(CASE WHEN l_quantity > 1000 THEN 1 END), 0) AS average_of_none FROM lineitem""")
def global_totals(t):
    large = F.when(F.col("l_quantity") > 1000, F.col("l_quantity"))
    return t.lineitem.agg(total("l_quantity").alias("total"), F.count(F.lit(1)).alias("n"),
                          (total("l_quantity") / F.count(F.lit(1))).alias("average"),
                          (total(large) / F.nullif(F.count(large), F.lit(0))).alias("average_of_none"))


@job("a04_conditional_share", """
    SELECT user_id, CAST(sum(CASE WHEN event_type = 'purchase' THEN CAST(value AS DECIMAL(18,2)) ELSE 0 END) AS DOUBLE)
           / CAST(sum(CAST(value AS DECIMAL(18,2))) AS DOUBLE) * 100 AS percent FROM events GROUP BY 1""")
def conditional_share(t):
    bought = F.when(F.col("event_type") == "purchase", F.col("value")).otherwise(0.0)
    return t.events.groupBy("user_id").agg((total(bought) / total("value") * 100).alias("percent"))


@job("a05_sum_over_join", """
    SELECT r_name, n_name, CAST(sum(CAST(c_acctbal AS DECIMAL(18,2))) AS DOUBLE) AS balance, count(*) AS customers
    FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY ALL""")
def sum_over_join(t):
    # one row per nation key before the join, so only totals meet the dimensions
    by_nation = t.customer.groupBy("c_nationkey").agg(
        F.sum(money("c_acctbal")).alias("balance"), F.count(F.lit(1)).alias("customers"))
    return (
        by_nation.join(t.nation, F.col("c_nationkey") == F.col("n_nationkey"))
        .join(t.region, F.col("n_regionkey") == F.col("r_regionkey"))
        .groupBy("r_name", "n_name")
        .agg(F.sum("balance").cast("double").alias("balance"), F.sum("customers").alias("customers")))


@job("a06_top_change", """
    SELECT c_mktsegment, c_nationkey, CAST(sum(CAST(c_acctbal AS DECIMAL(18,2)) - 1000) AS DOUBLE) AS change
    FROM customer GROUP BY ALL ORDER BY change DESC, c_mktsegment, c_nationkey LIMIT 5""")
def top_change(t):
    """The published query selects a bare column next to a group; the sum per group is meant."""
    return (t.customer.groupBy("c_mktsegment", "c_nationkey")
            .agg(F.sum(money("c_acctbal") - 1000).cast("double").alias("change"))
            .orderBy(F.desc("change"), "c_mktsegment", "c_nationkey").limit(5))


@job("a07_max_above_threshold", """
    SELECT user_id, max(value) AS max_value FROM events GROUP BY 1 HAVING max(value) > 45""")
def max_above_threshold(t, threshold=45):
    return t.events.groupBy("user_id").agg(F.max("value").alias("max_value")).filter(F.col("max_value") > threshold)


@job("a08_extremes", """
    SELECT l_returnflag, min(l_extendedprice) AS low, max(l_extendedprice) AS high,
           abs(max(l_extendedprice) - min(l_extendedprice)) AS spread FROM lineitem GROUP BY 1""")
def extremes(t):
    low, high = F.min("l_extendedprice"), F.max("l_extendedprice")
    return t.lineitem.groupBy("l_returnflag").agg(low.alias("low"), high.alias("high"), F.abs(high - low).alias("spread"))


@job("a09_median", "SELECT l_returnflag, median(l_extendedprice) AS median FROM lineitem GROUP BY 1")
def median(t):
    """Median of the sorted values; the published function forgets to sort."""
    found = exact_quantiles(t.lineitem, "l_extendedprice", [0.5], ["l_returnflag"])
    return found.select("l_returnflag", F.col("quantile").alias("median"))


@job("a10_mode", """
    SELECT l_orderkey, l_quantity AS mode, n FROM (SELECT l_orderkey, l_quantity, count(*) AS n FROM lineitem GROUP BY ALL)
    QUALIFY row_number() OVER (PARTITION BY l_orderkey ORDER BY n DESC, l_quantity) = 1""")
def mode(t):
    return summary.mode(t.lineitem, ["l_orderkey"], "l_quantity")


@job("a11_value_counts", "SELECT p_type, left(p_name, 1) AS initial, count(*) AS n FROM part GROUP BY ALL")
def value_counts(t):
    return t.part.groupBy("p_type", F.substring("p_name", 1, 1).alias("initial")).agg(F.count(F.lit(1)).alias("n"))


@job("a12_share_of_total", """
    SELECT p_brand, count(*) AS n, round(count(*)::DOUBLE / (SELECT count(*) FROM part)::DOUBLE * 100, 2) AS share FROM part GROUP BY 1""")
def share_of_total(t):
    return summary.share_of_total(t.part, ["p_brand"])


@job("a13_top_words", f"""
    SELECT word, count(*) AS n FROM {PLAIN_WORDS} GROUP BY 1 ORDER BY n DESC, word DESC LIMIT 10""")
def top_words(t, k=10):
    counted = summary.word_counts(t.documents, tx.plain_words(F.col("text")))
    return counted.orderBy(F.desc("n"), F.desc("word")).limit(k)


@job("a14_char_counts", """
    WITH lines AS (SELECT trim(trim(upper(unnest(string_split(replace(text, 'ß', 'SS'), chr(10)))), E' \\t\\n\\r\\f'), '-') AS line FROM documents)
    SELECT c, count(*) AS n FROM (SELECT unnest(string_split(line, '')) AS c FROM lines WHERE line <> '') GROUP BY 1""")
def char_counts(t):
    line = t.documents.select(F.explode(tx.lines(F.col("text"))).alias("line"))
    line = line.select(F.btrim(F.btrim(F.upper("line"), F.lit(" \t\n\r\f")), F.lit("-")).alias("line"))
    # count equal blank-separated pieces once, then spell out the distinct ones; a piece that is
    # not the first of its line brings the blank in front of it along
    pieces = line.select(F.explode(F.transform(
        F.split("line", " "), lambda w, i: F.when(i > 0, F.concat(F.lit(" "), w)).otherwise(w))).alias("piece"))
    counted = pieces.groupBy("piece").agg(F.count(F.lit(1)).alias("n"))
    chars = counted.select(F.explode(F.split("piece", "")).alias("c"), "n")
    return chars.filter("c <> ''").groupBy("c").agg(F.sum("n").alias("n"))


@job("a15_words_without_repeats", f"""
    WITH w AS (SELECT doc_id, list_filter(string_split_regex(text, '{BLANKS}'), lambda x: x <> '') AS l FROM documents),
         k AS (SELECT doc_id, unnest(list_filter(l, lambda x, i: i = 1 OR x <> l[i - 1])) AS word FROM w)
    SELECT doc_id, word, count(*) AS n FROM k GROUP BY ALL""")
def words_without_repeats(t):
    return summary.word_counts(t.documents, tx.skip_repeats(tx.words(F.col("text"))), ["doc_id"])


@job("a16_keyword_counts", """
    SELECT 'the' AS keyword, count(*) FILTER (contains(lower(text), 'the')) AS n FROM documents
    UNION ALL SELECT 'que', count(*) FILTER (contains(lower(text), 'que')) FROM documents
    UNION ALL SELECT 'license', count(*) FILTER (contains(lower(text), 'license')) FROM documents""")
def keyword_counts(t, keywords=("the", "que", "license")):
    low = F.lower("text")
    hits = t.documents.agg(*[F.sum(F.contains(low, F.lit(k)).cast("bigint")).alias(k) for k in keywords])
    return hits.unpivot([], list(keywords), "keyword", "n")


@job("a17_histogram", """
    WITH b AS (SELECT min(n_chars)::DOUBLE AS lo, (max(n_chars)::DOUBLE - min(n_chars)::DOUBLE) / 25 AS w FROM documents),
         c AS (SELECT CAST(least(floor((n_chars - lo) / w), 24) AS INTEGER) AS bin, count(*) AS n FROM documents, b GROUP BY 1)
    SELECT CAST(i AS INTEGER) AS bin, lo + i * w AS from_value, coalesce(n, 0) AS n
    FROM range(25) r(i), b LEFT JOIN c ON c.bin = i""")
def histogram(t):
    return summary.histogram(t.documents, "n_chars", 25)


_NUMERIC = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax"]
_TYPES = {"l_orderkey": "bigint", "l_partkey": "bigint", "l_suppkey": "bigint", "l_linenumber": "int"}
DESCRIBE = " UNION ALL ".join(f"""
    SELECT '{c}' AS "column", '{_TYPES.get(c, "double")}' AS type, count({c}) AS count, round(avg({c}), 4) AS mean, round(stddev_samp({c}), 4) AS std,
           min({c})::DOUBLE AS min, round(quantile_cont({c}, 0.25), 6) AS q1, round(quantile_cont({c}, 0.5), 6) AS median,
           round(quantile_cont({c}, 0.75), 6) AS q3, max({c})::DOUBLE AS max FROM lineitem""" for c in _NUMERIC)


@job("a18_describe", DESCRIBE)
def describe(t):
    found = summary.describe(t.lineitem, _NUMERIC)
    return found.withColumns({c: F.round(c, 4) for c in ("mean", "std")} | {c: F.round(c, 6) for c in ("q1", "median", "q3")})


@job("a19_correlations", " UNION ALL ".join(
    f"SELECT '{a}' AS a, '{b}' AS b, round(corr({a}, {b}), 6) AS corr FROM lineitem"
    for i, a in enumerate(_NUMERIC) for b in _NUMERIC[i + 1:]))
def correlations(t):
    return summary.correlations(t.lineitem, _NUMERIC).withColumn("corr", F.round("corr", 6))


@job("a20_mean_per_category", """
    SELECT event_type, CAST(sum(CAST(value AS DECIMAL(18,2))) AS DOUBLE) / count(value) AS mean FROM events GROUP BY 1""")
def mean_per_category(t):
    return t.events.groupBy("event_type").agg((total("value") / F.count("value")).alias("mean"))


@job("a21_box_stats", """
    WITH q AS (SELECT o_orderpriority AS k, quantile_cont(o_totalprice, 0.25) AS q1, quantile_cont(o_totalprice, 0.5) AS median,
                      quantile_cont(o_totalprice, 0.75) AS q3 FROM orders GROUP BY 1)
    SELECT k AS o_orderpriority, round(q1, 4) AS q1, round(median, 4) AS median, round(q3, 4) AS q3,
           min(CASE WHEN o_totalprice BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1) THEN o_totalprice END) AS low_whisker,
           max(CASE WHEN o_totalprice BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1) THEN o_totalprice END) AS high_whisker,
           CAST(sum(CASE WHEN o_totalprice BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1) THEN 0 ELSE 1 END) AS BIGINT) AS n_outliers
    FROM orders JOIN q ON k = o_orderpriority GROUP BY k, q1, median, q3""")
def box_stats(t):
    found = summary.box_stats(t.orders, "o_orderpriority", "o_totalprice")
    return found.withColumns({c: F.round(c, 4) for c in ("q1", "median", "q3")})


@job("a22_category_composition", """
    SELECT quality, lang, n, n::DOUBLE / (sum(n) OVER (PARTITION BY quality))::DOUBLE AS share
    FROM (SELECT quality, lang, count(*) AS n FROM labels JOIN documents USING (doc_id) GROUP BY ALL)""")
def category_composition(t):
    joined = t.labels.join(t.documents.select("doc_id", "lang"), "doc_id")
    counted = joined.groupBy("quality", "lang").agg(F.count(F.lit(1)).alias("n"))
    # a row per quality and language: small whatever the tables
    whole = F.sum("n").over(Window.partitionBy("quality"))
    return counted.select("quality", "lang", "n", (F.col("n") / whole).alias("share"))


@job("a23_longest_and_shortest", """
    SELECT lang, arg_min(doc_id, (length(text), doc_id)) AS shortest, min(length(text)) AS min_length,
           arg_max(doc_id, (length(text), -doc_id)) AS longest, max(length(text)) AS max_length FROM documents GROUP BY 1""")
def longest_and_shortest(t):
    length = F.length("text").cast("bigint")
    short = F.min(F.struct(length.alias("n"), F.col("doc_id")))
    long = F.min(F.struct((-length).alias("n"), F.col("doc_id")))
    return t.documents.groupBy("lang").agg(
        short["doc_id"].alias("shortest"), short["n"].alias("min_length"),
        long["doc_id"].alias("longest"), (-long["n"]).alias("max_length"))


@job("a25_sum_of_numbers_only", """
    WITH x AS (SELECT o_custkey, CASE WHEN o_orderkey % 5 = 0 THEN 'n/a' ELSE CAST(CAST(o_totalprice AS DECIMAL(18,2)) AS VARCHAR) END AS v,
                      row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) - 1 AS i FROM orders)
    SELECT o_custkey, CAST(sum(TRY_CAST(v AS DECIMAL(18,2))) AS DOUBLE) AS numbers,
           CAST(sum(CASE WHEN i BETWEEN 1 AND 3 THEN TRY_CAST(v AS DECIMAL(18,2)) END) AS DOUBLE) AS slice FROM x GROUP BY 1""")
def sum_of_numbers_only(t, start=1, end=3):
    """Sum of the values that are numbers, and of those at places start..end (end included)."""
    numbered = positions(t.orders.select("o_custkey", "o_orderkey", "o_orderdate", "o_totalprice"),
                         [F.col("o_orderdate"), F.col("o_orderkey")], on=["o_orderdate", "o_orderkey"], keys=["o_custkey"])
    value = F.when(F.col("o_orderkey") % 5 == 0, "n/a").otherwise(money("o_totalprice").cast("string"))
    number = value.try_cast("decimal(18,2)")
    return numbered.groupBy("o_custkey").agg(
        F.sum(number).cast("double").alias("numbers"),
        F.sum(F.when((F.col("pos") - 1).between(start, end), number)).cast("double").alias("slice"))


@job("a27_matrix_totals", """
    SELECT o_orderstatus AS row_label, o_orderpriority AS col_label, CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) AS total
    FROM orders GROUP BY GROUPING SETS ((o_orderstatus), (o_orderpriority), ())""")
def matrix_totals(t):
    cells = t.orders.groupBy("o_orderstatus", "o_orderpriority").agg(F.sum(money("o_totalprice")).alias("v"))
    nothing, amount = F.lit(None).cast("string"), F.sum("v").cast("double").alias("total")
    by_row = cells.groupBy(F.col("o_orderstatus").alias("row_label")).agg(amount).select("row_label", nothing.alias("col_label"), "total")
    by_col = cells.groupBy(F.col("o_orderpriority").alias("col_label")).agg(amount).select(nothing.alias("row_label"), "col_label", "total")
    overall = cells.agg(amount).select(nothing.alias("row_label"), nothing.alias("col_label"), "total")
    return by_row.unionByName(by_col).unionByName(overall)


@job("a28_tree_totals", """
    WITH RECURSIVE up(node, anc) AS (
      SELECT c_custkey, c_custkey FROM customer UNION ALL SELECT node, anc // 4 FROM up WHERE anc > 0)
    SELECT anc AS c_custkey, CAST(sum(CAST(c_acctbal AS DECIMAL(18,2))) AS DOUBLE) AS subtree_total, count(*) AS nodes
    FROM up JOIN customer ON node = c_custkey GROUP BY 1""")
def tree_totals(t):
    from tablemill.operators.hierarchy import subtree_totals

    tree = t.customer.select(F.col("c_custkey").alias("node"), F.expr("nullif(c_custkey, 0) div 4").alias("parent"),
                             money("c_acctbal").alias("value"))
    return subtree_totals(tree).select(F.col("node").alias("c_custkey"), F.col("total").cast("double").alias("subtree_total"), "nodes")


@job("a29_extreme_map_keys", """
    SELECT p_partkey, list_min(map_keys(m)) AS low_key, list_max(map_keys(m)) AS high_key
    FROM (SELECT p_partkey, MAP {p_brand: 1, p_type: 2, p_name: 3} AS m FROM part)""")
def extreme_map_keys(t):
    keys = F.map_keys(F.create_map("p_brand", F.lit(1), "p_type", F.lit(2), "p_name", F.lit(3)))
    return t.part.select("p_partkey", F.array_min(keys).alias("low_key"), F.array_max(keys).alias("high_key"))


@job("a30_concatenate_in_order", """
    SELECT c_nationkey, string_agg(c_mktsegment, ',' ORDER BY c_mktsegment) AS segments
    FROM (SELECT DISTINCT c_nationkey, c_mktsegment FROM customer) GROUP BY 1""")
def concatenate_in_order(t):
    # distinct first: the list is as long as the domain, not as the table
    distinct = t.customer.select("c_nationkey", "c_mktsegment").distinct()
    return distinct.groupBy("c_nationkey").agg(F.array_join(F.array_sort(F.collect_list("c_mktsegment")), ",").alias("segments"))


@job("a32_first_repeat", """
    WITH x AS (SELECT o_custkey, o_orderdate, o_orderkey, o_orderpriority,
                 row_number() OVER (PARTITION BY o_custkey, o_orderpriority ORDER BY o_orderdate, o_orderkey) AS rn FROM orders)
    SELECT o_custkey, arg_min(o_orderpriority, (o_orderdate, o_orderkey)) FILTER (rn = 2) AS first_repeat FROM x GROUP BY 1""")
def first_repeat(t):
    placed = t.orders.select("o_custkey", F.struct("o_orderdate", "o_orderkey").alias("place"), "o_orderpriority")
    return summary.first_repeat(placed, ["o_custkey"], "place", "o_orderpriority")


@job("a33_top_decile_flag", """
    SELECT p_partkey, CASE WHEN p_retailprice >= (SELECT quantile_cont(p_retailprice, 0.9) FROM part) THEN 1 ELSE 0 END AS p_retailprice_highlight,
           CASE WHEN p_size >= (SELECT quantile_cont(p_size, 0.9) FROM part) THEN 1 ELSE 0 END AS p_size_highlight FROM part""")
def top_decile_flag(t):
    flagged = summary.top_share_flag(t.part.select("p_partkey", "p_retailprice", "p_size"), ["p_retailprice", "p_size"])
    return flagged.select("p_partkey", "p_retailprice_highlight", "p_size_highlight")


@job("a34_map_totals", """
    SELECT l_orderkey, l_linenumber, 3 AS size, array_to_string(list_sort([l_quantity, l_discount, l_tax]), ',') IS NOT NULL AS sorted_ok,
           list_sort([l_quantity, l_discount, l_tax])[1] AS smallest, l_quantity + l_discount + l_tax AS total,
           (l_quantity + l_discount + l_tax) / 3 AS average FROM lineitem""")
def map_totals(t):
    values = F.map_values(F.create_map(F.lit("quantity"), "l_quantity", F.lit("discount"), "l_discount", F.lit("tax"), "l_tax"))
    summed = F.aggregate(values, F.lit(0.0), lambda a, x: a + x)
    ordered = F.array_sort(values)
    return t.lineitem.select(
        "l_orderkey", "l_linenumber", F.size(values).alias("size"),
        (F.element_at(ordered, 1) <= F.element_at(ordered, -1)).alias("sorted_ok"),
        F.element_at(ordered, 1).alias("smallest"), summed.alias("total"), (summed / F.size(values)).alias("average"))
