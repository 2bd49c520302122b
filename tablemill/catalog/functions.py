"""Jobs for user-defined function surfaces (E)."""

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import functions as F

from tablemill.functions import udf
from tablemill.functions.arrays import fold
from tablemill.registry import job


@job("e01_column_function", """
    SELECT p_partkey, p_retailprice * 1.1::DOUBLE AS raised, CASE WHEN p_size > 25 THEN 'large' ELSE 'small' END AS size_class FROM part""")
def column_function(t):
    return udf.apply_columns(t.part, raised=lambda: F.col("p_retailprice") * 1.1,
                             size_class=lambda: F.when(F.col("p_size") > 25, "large").otherwise("small")).select("p_partkey", "raised", "size_class")


@job("e01_vectorised_function", "SELECT p_partkey, upper(left(p_name, 1)) || substr(p_name, 2) AS capital FROM part")
def vectorised_function(t):
    capital = udf.vectorised(lambda names: names.str.slice(0, 1).str.upper() + names.str.slice(1), "string")
    return t.part.select("p_partkey", capital("p_name").alias("capital"))


@job("e02_passed_comparator", """
    SELECT l_orderkey, l_linenumber, l_partkey, least(l_quantity, l_discount, l_tax) AS smallest, greatest(l_quantity, l_discount, l_tax) AS largest,
      list_reverse_sort([l_quantity, l_discount, l_tax])[2] AS second_largest FROM lineitem""")
def passed_comparator(t):
    items = F.array("l_quantity", "l_discount", "l_tax")
    falling = udf.sort_by(items, lambda a, b: F.when(a > b, -1).when(a < b, 1).otherwise(0))
    return t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey", udf.extreme(items, lambda x, y: x < y).alias("smallest"),
                             udf.extreme(items, lambda x, y: x > y).alias("largest"), falling[1].alias("second_largest"))


@job("e03_fold", "SELECT vec_id, list_sum(list_transform(embedding, lambda x: CAST(round(x * 1000) AS BIGINT)))::BIGINT AS total, CAST(len(embedding) AS INTEGER) AS n FROM embeddings")
def fold_array(t):
    step = lambda acc, x: acc + F.round(x * 1000).cast("bigint")
    return t.embeddings.select("vec_id", fold(F.col("embedding"), F.lit(0).cast("bigint"), step).alias("total"), F.size("embedding").alias("n"))


@job("e04_row_generator", "SELECT c_custkey, unnest(generate_series(0, c_nationkey, 2))::INTEGER AS step FROM customer")
def row_generator(t):
    return udf.generate(t.customer.select("c_custkey", "c_nationkey"), F.sequence(F.lit(0), F.col("c_nationkey"), F.lit(2)), "step").drop("c_nationkey")


@job("e05_parallel_map", "SELECT o_orderkey, o_totalprice * 2 AS doubled FROM orders")
def parallel_map(t):
    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([batch.column("o_orderkey"), pc.multiply(batch.column("o_totalprice"), 2.0)], ["o_orderkey", "doubled"])

    return udf.map_batches(t.orders.select("o_orderkey", "o_totalprice"), work, "o_orderkey bigint, doubled double")
