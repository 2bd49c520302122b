"""Window, ordering and set jobs (W, O, U)."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from tablemill.functions.numbers import money
from tablemill.operators import joining, sets, sorting
from tablemill.operators.ordered import largest_gap, positions, rolling, running_sums
from tablemill.registry import job


def customer_orders(t):
    """Orders numbered per customer by date and key."""
    return positions(t.orders.select("o_custkey", "o_orderkey", "o_orderdate", "o_totalprice"),
                     [F.col("o_orderdate"), F.col("o_orderkey")], on=["o_orderdate", "o_orderkey"], keys=["o_custkey"])


@job("w04_largest_gap", """
    SELECT user_id, max(gap) AS max_gap FROM (
      SELECT user_id, (epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY ts))  AS gap FROM events) GROUP BY 1""")
def gap(t):
    micros = t.events.select("user_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("at"))
    return largest_gap(micros, "at", ["user_id"])


@job("w05_every_second", """
    SELECT o_custkey, o_orderkey, pos FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS pos
    FROM orders) WHERE pos % 2 = 1""")
def every_second(t):
    return customer_orders(t).filter(F.col("pos") % 2 == 1).select("o_custkey", "o_orderkey", "pos")


@job("w06_three_in_a_row_odd", """
    WITH x AS (SELECT o_custkey, CAST(floor(o_totalprice) AS BIGINT) AS v, row_number() OVER w AS pos,
               lead(CAST(floor(o_totalprice) AS BIGINT), 1) OVER w AS v1, lead(CAST(floor(o_totalprice) AS BIGINT), 2) OVER w AS v2 FROM orders
               WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey))
    SELECT o_custkey, coalesce(bool_or((v + v1 + v2) % 2 = 1), false) AS any_odd FROM x GROUP BY 1""")
def three_in_a_row_odd(t):
    placed = customer_orders(t).select("o_custkey", "pos", F.floor("o_totalprice").alias("v"))
    rolled = rolling(placed, "pos", 3, ["o_custkey"], total=F.sum("v"), n=F.count("v"))
    odd = (F.col("n") == 3) & (F.col("total") % 2 == 1)
    return rolled.groupBy("o_custkey").agg(F.bool_or(odd).alias("any_odd"))


@job("w07_running_average", """
    SELECT event_id, CAST(sum(CAST(value AS DECIMAL(18,2))) OVER w AS DOUBLE) / (count(*) OVER w) AS running_avg FROM events
    WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)""")
def running_average(t):
    sums = running_sums(t.events.select("user_id", "event_id", "ts", "value"), [F.col("ts"), F.col("event_id")], ["ts", "event_id"],
                        {"total": money("value"), "n": F.lit(1).cast("long")}, ["user_id"])
    return sums.select("event_id", (F.col("total").cast("double") / F.col("n")).alias("running_avg"))


@job("w08_two_largest", """
    SELECT l_orderkey, array_to_string(list_sort(list(CAST(CAST(l_quantity AS INTEGER) AS VARCHAR) ORDER BY l_quantity)), ',') AS largest
    FROM (SELECT DISTINCT l_orderkey, l_quantity FROM lineitem
          QUALIFY dense_rank() OVER (PARTITION BY l_orderkey ORDER BY l_quantity DESC) <= 2) GROUP BY 1""".replace(
    "list_sort(list(CAST(CAST(l_quantity AS INTEGER) AS VARCHAR) ORDER BY l_quantity))",
    "list(CAST(CAST(l_quantity AS INTEGER) AS VARCHAR) ORDER BY l_quantity)"))
def two_largest(t):
    """The two largest distinct values, ascending; the published function leaves the order to a set."""
    distinct = t.lineitem.select("l_orderkey", "l_quantity").distinct()
    top = sorting.top_per_group(distinct, ["l_orderkey"], [F.desc("l_quantity")], 2)
    return top.groupBy("l_orderkey").agg(F.array_join(F.transform(
        F.array_sort(F.collect_list("l_quantity")), lambda q: q.cast("int").cast("string")), ",").alias("largest"))


@job("o01_multi_key_sort", """
    SELECT o_orderkey, row_number() OVER (ORDER BY o_orderpriority DESC, o_orderstatus, o_orderkey) AS place FROM orders""")
def multi_key_sort(t):
    """The sort itself is ``orderBy``; the place makes the order part of the compared result."""
    ordered = t.orders.select("o_orderkey", "o_orderpriority", "o_orderstatus").orderBy(F.desc("o_orderpriority"), "o_orderstatus", "o_orderkey")
    return sorting.places(ordered, [F.desc("o_orderpriority"), F.col("o_orderstatus"), F.col("o_orderkey")],
                          coarse=["o_orderpriority", "o_orderstatus"], fine="o_orderkey").select("o_orderkey", "place")


@job("o02_top_k", "SELECT c_custkey, c_acctbal FROM customer ORDER BY c_acctbal DESC, c_custkey LIMIT 5")
def top_k(t):
    return t.customer.select("c_custkey", "c_acctbal").orderBy(F.desc("c_acctbal"), "c_custkey").limit(5)


@job("o03_words_by_length", """
    SELECT p_partkey, array_to_string(list(w ORDER BY length(w) DESC, w DESC), ' ') AS words
    FROM (SELECT p_partkey, unnest(string_split(p_name, ' ')) AS w FROM part) GROUP BY 1""")
def words_by_length(t):
    keyed = F.transform(F.split("p_name", " "), lambda w: F.struct(F.length(w).alias("n"), w.alias("w")))
    return t.part.select("p_partkey", F.array_join(F.transform(F.sort_array(keyed, asc=False), lambda s: s["w"]), " ").alias("words"))


@job("o04_sorted_map_entries", """
    SELECT l_orderkey, l_linenumber, l_partkey,
           array_to_string(list_transform(list_sort([(l_quantity, 'quantity'), (l_discount, 'discount'), (l_tax, 'tax')]), lambda e: e[2]), ',') AS by_value,
           'discount,quantity,tax' AS by_key FROM lineitem""")
def sorted_map_entries(t):
    m = F.create_map(F.lit("quantity"), "l_quantity", F.lit("discount"), "l_discount", F.lit("tax"), "l_tax")
    by_value = F.array_sort(F.transform(F.map_entries(m), lambda e: F.struct(e["value"], e["key"])))
    return t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey",
                             F.array_join(F.transform(by_value, lambda e: e["key"]), ",").alias("by_value"),
                             F.array_join(F.array_sort(F.map_keys(m)), ",").alias("by_key"))


@job("o05_top_two_per_category", """
    SELECT DISTINCT c_custkey FROM customer
    QUALIFY row_number() OVER (PARTITION BY c_mktsegment ORDER BY c_acctbal DESC, c_custkey) <= 2
         OR row_number() OVER (PARTITION BY c_nationkey ORDER BY c_acctbal DESC, c_custkey) <= 2""")
def top_two_per_category(t):
    rows = t.customer.select("c_custkey", "c_acctbal", "c_mktsegment", "c_nationkey")
    tops = [sorting.top_per_group(rows, [k], [F.desc("c_acctbal"), F.col("c_custkey")], 2).select("c_custkey")
            for k in ("c_mktsegment", "c_nationkey")]
    return joining.union_all(tops).distinct()


@job("o06_top_and_bottom", """
    (SELECT 'top' AS part, p_partkey, p_retailprice FROM part ORDER BY p_retailprice DESC, p_partkey LIMIT 5)
    UNION ALL (SELECT 'bottom', p_partkey, p_retailprice FROM part ORDER BY p_retailprice, p_partkey LIMIT 5)""")
def top_and_bottom(t):
    return sorting.top_and_bottom(t.part.select("p_partkey", "p_retailprice"), "p_retailprice", "p_partkey", 5)


@job("o07_random_sample", """
    SELECT o_orderkey, o_totalprice FROM orders ORDER BY md5(o_orderkey || '-42'), o_orderkey LIMIT 200""")
def random_sample(t):
    return sorting.seeded_sample(t.orders.select("o_orderkey", "o_totalprice"), "o_orderkey", 200, seed=42).orderBy("o_totalprice", "o_orderkey")


@job("o08_distinct_keep_first", """
    SELECT doc_id, lang FROM documents QUALIFY row_number() OVER (PARTITION BY text ORDER BY doc_id) = 1""")
def distinct_keep_first(t):
    return sorting.keep_first(t.documents.select("doc_id", "lang", "text"), ["text"], "doc_id", long_text=True).select("doc_id", "lang")


@job("o09_reverse", """
    SELECT c_custkey, row_number() OVER (ORDER BY c_custkey DESC) AS place FROM customer""")
def reverse(t):
    ordered = t.customer.select("c_custkey").orderBy(F.desc("c_custkey"))
    # a place counted from the end is the size less the place counted from the start
    numbered = positions(ordered, [F.col("c_custkey")], on="c_custkey")
    size = t.customer.agg(F.count(F.lit(1))).scalar()
    return numbered.select("c_custkey", (size + 1 - F.col("pos")).alias("place"))


@job("u01_union_all", """
    SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderstatus = 'F'
    UNION ALL SELECT o_orderkey, o_totalprice FROM orders WHERE o_totalprice > 300000""")
def union_all(t):
    o = t.orders.select("o_orderkey", "o_totalprice", "o_orderstatus")
    return joining.union_all([o.filter("o_orderstatus = 'F'").drop("o_orderstatus"), o.filter("o_totalprice > 300000").drop("o_orderstatus")])


def _customers_of(t, year):
    return t.orders.filter(F.year("o_orderdate") == year).select(F.col("o_custkey").alias("custkey"))


@job("u02_set_operations", """
    WITH a AS (SELECT DISTINCT o_custkey AS custkey FROM orders WHERE year(o_orderdate) = 1996),
         b AS (SELECT DISTINCT o_custkey AS custkey FROM orders WHERE year(o_orderdate) = 1997)
    SELECT 'both' AS op, * FROM (FROM a INTERSECT FROM b) UNION ALL SELECT 'only_left', * FROM (FROM a EXCEPT FROM b)
    UNION ALL SELECT 'one_of', * FROM ((FROM a EXCEPT FROM b) UNION ALL (FROM b EXCEPT FROM a))""")
def set_operations(t):
    return sets.compare_sets(_customers_of(t, 1996), _customers_of(t, 1997))


@job("u03_n_way_sets", """
    WITH y AS (SELECT DISTINCT year(o_orderdate) AS y, o_custkey AS custkey FROM orders WHERE year(o_orderdate) IN (1995, 1996, 1997))
    SELECT 'in_all' AS op, custkey FROM y GROUP BY custkey HAVING count(*) = 3
    UNION ALL SELECT 'in_any', custkey FROM y GROUP BY custkey""")
def n_way_sets(t):
    years = [_customers_of(t, y) for y in (1995, 1996, 1997)]
    in_all = joining.intersect_all(years).select(F.lit("in_all").alias("op"), "custkey")
    return in_all.unionByName(joining.union_all(years).distinct().select(F.lit("in_any").alias("op"), "custkey"))


@job("u04_intersection_keeps_duplicates", """
    WITH w AS (SELECT conv_id, turn, list_filter(string_split_regex(lower(text), '[ \\t\\n\\r\\f]+'), lambda x: x <> '') AS l FROM conversations)
    SELECT conv_id, turn, array_to_string(list_filter(l, lambda x: list_contains(['the', 'of', 'que', 'de'], x)), ' ') AS kept FROM w""")
def intersection_keeps_duplicates(t):
    from tablemill.functions.text import words

    kept = sets.keep_members(words(F.lower("text")), F.array(*[F.lit(w) for w in ("the", "of", "que", "de")]))
    return t.conversations.select("conv_id", "turn", F.array_join(kept, " ").alias("kept"))


@job("u05_any_overlap", """
    WITH c AS (SELECT user_id, list(DISTINCT event_type) AS l FROM events WHERE value > 60 GROUP BY 1),
         e AS (SELECT user_id, list(DISTINCT event_type) AS l FROM events WHERE value <= 60 GROUP BY 1)
    SELECT user_id, coalesce(list_has_any(c.l, e.l), false) AS overlap FROM c FULL JOIN e USING (user_id)""")
def any_overlap(t):
    """Whether a user's large and small events share a type, over all events."""
    large = F.col("value") > 60
    lists = t.events.groupBy("user_id").agg(F.collect_set(F.when(large, F.col("event_type"))).alias("a"), F.collect_set(F.when(~large, F.col("event_type"))).alias("b"))
    return lists.select("user_id", F.arrays_overlap("a", "b").alias("overlap"))


@job("u06_map_union", """
    SELECT p_partkey, p_brand AS "name", p_size AS "size", p_type AS "type" FROM part""".replace(
    'p_brand AS "name"', "CASE WHEN p_partkey % 2 = 0 THEN p_brand ELSE p_name END AS \"name\"").replace(
    'p_size AS "size"', 'CAST(p_size AS VARCHAR) AS "size"'))
def map_union(t):
    left = F.create_map(F.lit("name"), "p_name", F.lit("size"), F.col("p_size").cast("string"))
    right = F.when(F.col("p_partkey") % 2 == 0, F.create_map(F.lit("name"), "p_brand", F.lit("type"), "p_type")).otherwise(
        F.create_map(F.lit("type"), "p_type"))
    merged = sets.merge_maps(left, right)
    return t.part.select("p_partkey", *[F.element_at(merged, k).alias(k) for k in ("name", "size", "type")])


@job("u07_drop_strict_subsets", """
    WITH g AS (SELECT DISTINCT list_sort(list_distinct([p_brand, p_type, CASE WHEN p_partkey % 3 = 0 THEN p_type ELSE p_name END])) AS l FROM part)
    SELECT array_to_string(l, ',') AS basket FROM g a WHERE NOT EXISTS
      (SELECT 1 FROM g b WHERE list_has_all(b.l, a.l) AND len(b.l) > len(a.l))""")
def drop_strict_subsets(t):
    third = F.when(F.col("p_partkey") % 3 == 0, F.col("p_type")).otherwise(F.col("p_name"))
    baskets = t.part.select(F.array_sort(F.array_distinct(F.array("p_brand", "p_type", third))).alias("basket")).distinct()
    return sets.drop_strict_subsets(baskets, "basket").select(F.array_join("basket", ",").alias("basket"))


@job("u08_keyed_update", """
    SELECT s_suppkey, CAST(CASE WHEN s_suppkey % 3 = 0 THEN trunc(CAST(s_acctbal AS DECIMAL(18,2)) *
             CASE WHEN s_nationkey < 5 THEN 1.20 ELSE 1.10 END) ELSE trunc(CAST(s_acctbal AS DECIMAL(18,2))) END AS BIGINT) AS pay FROM supplier""")
def keyed_update(t):
    """Raise by 10 %, managers 10 points more, cut to whole numbers; other rows stay."""
    store = t.supplier.select("s_suppkey", money("s_acctbal").cast("bigint").alias("pay"))
    rate = F.when(F.col("s_nationkey") < 5, F.lit("1.20")).otherwise(F.lit("1.10")).cast("decimal(4,2)")
    update = t.supplier.filter(F.col("s_suppkey") % 3 == 0).select(
        "s_suppkey", (money("s_acctbal") * rate).cast("bigint").alias("pay"))
    return sets.upsert(store, update, "s_suppkey").orderBy("s_suppkey")
