"""Source and sink jobs (S): each writes a given table in the format and reads it back."""

from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablemill.catalog.feeds import gps_files
from tablemill.functions import text as tx
from tablemill.functions.numbers import money, total
from tablemill.operators.joining import union_all
from tablemill.operators.ordered import positions, running_sums
from tablemill.registry import TABLES, job
from tablemill.session import stage
from tablemill.sources import contract, readers, writers
from tablemill.streaming.feeds import GPS_SCHEMA


@job("s01_csv_inferred", "SELECT * FROM customer")
def csv_inferred(t):
    path = writers.write_csv(t.customer, t.scratch("customer"))
    return readers.read_csv(t.spark, path).withColumn("c_custkey", F.col("c_custkey").cast("bigint"))


@job("s02_csv_declared", "SELECT * FROM part")
def csv_declared(t):
    return readers.read_csv(t.spark, writers.write_csv(t.part, t.scratch("part")), t.part.schema)


PART_SCHEMA = T.StructType([T.StructField("p_partkey", T.LongType()), T.StructField("p_name", T.StringType()), T.StructField("p_size", T.IntegerType())])


def _bad_parts(t):
    size = F.when(F.col("p_partkey") % 10 == 0, "n/a").otherwise(F.col("p_size").cast("string"))
    return writers.write_csv(t.part.select("p_partkey", "p_name", size.alias("p_size")), t.scratch("bad-part"))


@job("s03_csv_drop_malformed", "SELECT p_partkey, p_name, p_size FROM part WHERE p_partkey % 10 <> 0")
def csv_drop_malformed(t):
    return readers.read_csv_dropping_bad(t.spark, _bad_parts(t), PART_SCHEMA)


@job("s03_csv_rejects", "SELECT p_partkey % 10 = 0 AS rejected, count(*) AS n FROM part GROUP BY 1")
def csv_rejects(t):
    return readers.split_bad_rows(t.spark, _bad_parts(t), PART_SCHEMA).groupBy("rejected").agg(F.count("p_partkey").alias("n"))


@job("s04_gps_text", "SELECT CAST(event_id AS VARCHAR) AS record_id, strftime(ts, '%H:%M:%S') AS timestamp, 'V' || user_id AS vin, user_id / 8 AS lon, user_id / 4 - 90 AS lat, value AS speed FROM events")
def gps_text(t):
    return readers.read_csv(t.spark, gps_files(t), GPS_SCHEMA, header=False, sep=" ")


@job("s05_other_delimiters", "SELECT ';' AS sep, * FROM supplier UNION ALL SELECT 'tab', * FROM supplier")
def other_delimiters(t):
    parts = [readers.read_csv(t.spark, writers.write_csv(t.supplier, t.scratch("supplier"), sep=sep), t.supplier.schema, sep=sep).select(F.lit(name).alias("sep"), "*")
             for name, sep in ((";", ";"), ("tab", "\t"))]
    return union_all(parts)


MONTHS = ["Jan", "Feb", "Mar", "Apr", "May", "Jun", "Jul", "Aug", "Sep", "Oct", "Nov", "Dec"]


def messy_files(t):
    """Monthly order totals per customer as blank-separated text: three free lines, the header, comments in between."""
    month = F.month("o_orderdate")
    wide = t.orders.groupBy("o_custkey").agg(*[F.coalesce(F.sum(F.when(month == i + 1, money("o_totalprice"))), F.lit(0)).alias(m) for i, m in enumerate(MONTHS)])
    line = F.concat_ws(" ", F.concat(F.lit("c"), "o_custkey"), *[F.col(m).cast("string") for m in MONTHS])
    start = F.array(F.lit("free line one"), F.lit("free line two"), F.lit("free line three"), F.lit(" ".join(["name", *MONTHS])), F.lit("# the line above has the labels"))
    # the low 33 bits of the id count the rows of a task, hence of a file
    at = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    rows = wide.select(line.alias("line"), at.alias("at")).select(F.explode(F.concat(
        F.when(F.col("at") == 0, start).otherwise(F.array().cast("array<string>")), F.array("line"),
        F.when(F.col("at") % 10 == 9, F.array(F.lit("# that was row ten"), F.lit(""))).otherwise(F.array().cast("array<string>")))).alias("value"))
    return writers.write_lines(rows, "value", t.scratch("messy"))


@job("s06_messy_text", "SELECT 'c' || o_custkey AS name, " + ", ".join(
    f"CAST(coalesce(sum(CASE WHEN month(o_orderdate) = {i + 1} THEN CAST(o_totalprice AS DECIMAL(18,2)) END), 0) AS DOUBLE) AS \"{m}\"" for i, m in enumerate(MONTHS)) + " FROM orders GROUP BY o_custkey")
def messy_text(t):
    return readers.read_messy_text(t.spark, messy_files(t))


@job("s07_relabel_header", "SELECT c_custkey AS id, c_name AS label, c_nationkey AS place, c_acctbal AS balance, c_mktsegment AS kind FROM customer")
def relabel_header(t):
    path = writers.write_csv(t.customer, t.scratch("customer"))
    return readers.relabel(readers.read_csv(t.spark, path, t.customer.schema), ["id", "label", "place", "balance", "kind"])


def _table_name(t, label):
    return t.scratch(label).rsplit("/", 1)[1].replace("-", "_")


@job("s08_load_declared_table", "SELECT * FROM supplier")
def load_declared_table(t):
    path = writers.write_csv(t.supplier, t.scratch("supplier"), header=False)
    name, place = _table_name(t, "supplier"), t.scratch("supplier-table")
    t.spark.sql(f"CREATE TABLE {name} (s_suppkey BIGINT, s_name STRING, s_nationkey INT, s_acctbal DOUBLE) USING parquet LOCATION '{place}'")
    readers.read_csv(t.spark, path, t.supplier.schema, header=False).write.insertInto(name)
    loaded = t.spark.table(name).schema
    t.spark.sql(f"DROP TABLE {name}")  # the files stay at their place
    return t.spark.read.schema(loaded).parquet(place)


@job("s09_whole_table", """
    SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice, strftime(o_orderdate, '%Y-%m-%d') AS o_orderdate, o_orderpriority FROM orders""")
def whole_table(t):
    """The catalog stands in for the database; the JDBC options are tested on their own."""
    t.orders.createOrReplaceTempView("tablemill_orders")
    orders = readers.read_source(t.spark, readers.SourceConfig("table", "tablemill_orders"))
    return orders.withColumn("o_orderdate", F.date_format("o_orderdate", "yyyy-MM-dd"))


@job("s10_stage_table", "SELECT l_returnflag, count(*) AS n, CAST(sum(CAST(l_quantity AS DECIMAL(18,2))) AS DOUBLE) AS quantity FROM lineitem GROUP BY 1")
def stage_table(t):
    from tablemill.session import stage

    return stage(t.lineitem.select("l_returnflag", "l_quantity"), "lines").groupBy("l_returnflag").agg(
        F.count(F.lit(1)).alias("n"), total("l_quantity").alias("quantity"))


def _documents(t):
    records = F.array(F.struct(F.lit("status").alias("name"), F.col("o_orderstatus").alias("value")), F.struct(F.lit("priority").alias("name"), F.col("o_orderpriority").alias("value")))
    return t.orders.select(F.col("o_orderkey").alias("id"), F.transform(records, lambda r: r.withField("id", F.col("o_orderkey"))).alias("records"))


@job("s11_nested_json", "SELECT 'status' AS name, o_orderstatus AS value, o_orderkey AS id FROM orders UNION ALL SELECT 'priority', o_orderpriority, o_orderkey FROM orders")
def nested_json(t):
    docs = _documents(t)
    return readers.read_records(t.spark, writers.write_json(docs, t.scratch("nested")), "records", docs.schema)


@job("s12_json_lines", "SELECT text, lang FROM documents")
def json_lines(t):
    path = writers.write_json(t.documents, t.scratch("documents"))
    return readers.read_json(t.spark, path, t.documents.schema).select("text", "lang")


@job("s13_drop_fields", """
    SELECT o_orderkey AS id, '[{"name":"status","value":"' || o_orderstatus || '"},{"name":"priority","value":"' || o_orderpriority || '"}]' AS records FROM orders""")
def drop_fields(t):
    docs = _documents(t)
    read = readers.read_json(t.spark, writers.write_json(docs, t.scratch("nested")), docs.schema)
    slim = read.select("id", F.transform("records", lambda r: r.dropFields("id")).alias("records"))
    back = readers.read_json(t.spark, writers.write_json(slim, t.scratch("slim")), slim.schema)
    return back.select("id", F.to_json("records").alias("records"))


PERSON = "_id BIGINT, name STRING, size INT, price DOUBLE"


def _people(t):
    return t.part.select(F.col("p_partkey").alias("_id"), F.col("p_name").alias("name"), F.col("p_size").alias("size"), F.col("p_retailprice").alias("price"))


@job("s14_xml_rows", """SELECT p_partkey AS "_id", p_name AS name, p_size AS size, p_retailprice AS price FROM part""")
def xml_rows(t):
    return readers.read_xml(t.spark, writers.write_xml(_people(t), t.scratch("people"), "group", "person"), "person", PERSON)


@job("s14_xml_column", "SELECT c_custkey, c_name AS name, c_nationkey AS place FROM customer")
def xml_column(t):
    text = F.concat(F.lit("<user><name>"), "c_name", F.lit("</name><place>"), F.col("c_nationkey").cast("string"), F.lit("</place></user>"))
    return t.customer.select("c_custkey", readers.parse_xml(text, "name STRING, place INT").alias("x")).select("c_custkey", "x.*")


@job("s15_xml_edit", """
    SELECT p_partkey AS "_id", CASE WHEN p_partkey % 100 = 0 THEN 'renamed' ELSE p_name END AS name, p_size AS size, p_retailprice AS price FROM part
    UNION ALL SELECT -1, 'added', 1, 2.5""")
def xml_edit(t):
    source = readers.read_xml(t.spark, writers.write_xml(_people(t), t.scratch("people"), "group", "person"), "person", PERSON)
    edited = source.withColumn("name", F.when(F.col("_id") % 100 == 0, "renamed").otherwise(F.col("name")))
    added = t.spark.createDataFrame([(-1, "added", 1, 2.5)], PERSON)
    path = writers.write_xml(edited.unionByName(added), t.scratch("people-edited"), "group", "person")
    return readers.read_xml(t.spark, path, "person", PERSON)


def text_lines(t):
    return t.documents.select(F.explode(tx.lines(F.col("text"))).alias("line"))


@job("s16_text_lines", "SELECT line, count(*) AS n FROM (SELECT unnest(string_split(text, chr(10))) AS line FROM documents) GROUP BY 1")
def read_text_lines(t):
    path = writers.write_lines(text_lines(t), "line", t.scratch("lines"))
    return readers.read_lines(t.spark, path).groupBy(F.col("value").alias("line")).agg(F.count(F.lit(1)).alias("n"))


@job("s17_folder_of_files", "SELECT c_custkey, c_name, c_acctbal, true AS has_file FROM customer")
def folder_of_files(t):
    path = t.scratch("folder")
    slim = t.customer.select("c_custkey", "c_name", "c_acctbal")
    for i in range(3):
        writers.write_csv(slim.filter(F.col("c_custkey") % 3 == i), f"{path}/part{i}", header=False)
    return readers.read_folder(t.spark, path, slim.schema).withColumn("has_file", F.contains("file", F.lit("/part"))).drop("file")


def _file_tree(t):
    path = t.scratch("tree")
    writers.write_lines(text_lines(t), "line", f"{path}/a/b")
    writers.write_csv(t.customer, f"{path}/c", header=False)
    return path


@job("s18_lines_by_extension", """
    SELECT 'txt' AS extension, count(*) AS n_lines FROM (SELECT unnest(string_split(text, chr(10))) FROM documents) UNION ALL SELECT 'csv', count(*) FROM customer""")
def lines_by_extension(t):
    return readers.lines_by_extension(t.spark, _file_tree(t)).drop("n_files")


@job("s18_file_inventory", """
    SELECT 'csv' AS extension, CAST(sum(strlen(concat_ws(',', c_custkey, c_name, c_nationkey, c_acctbal, c_mktsegment)) + 1) AS BIGINT) AS bytes FROM customer""")
def file_inventory(t):
    """Sizes add up to the bytes written, however many files there are."""
    files = readers.file_inventory(t.spark, _file_tree(t), "*.csv")
    return files.groupBy("extension").agg(F.sum("length").alias("bytes"))


@job("s19_csv_out", "SELECT o_orderkey, o_totalprice, o_orderpriority FROM orders")
def csv_out(t):
    slim = t.orders.select("o_orderkey", "o_totalprice", "o_orderpriority")
    return readers.read_csv(t.spark, writers.write_csv(slim, t.scratch("orders")), slim.schema)


@job("s20_stamped_csv", "SELECT *, true AS stamped FROM supplier")
def stamped_csv(t):
    """The stamp itself changes with every load, so the result only says that it is there and recent."""
    path = writers.write_stamped_csv(t.supplier, t.scratch("stamped"))
    read = readers.read_csv(t.spark, path, T.StructType([*t.supplier.schema.fields, T.StructField("created_at", T.TimestampType())]))
    recent = F.col("created_at").between(F.current_timestamp() - F.expr("interval 1 hour"), F.current_timestamp() + F.expr("interval 1 hour"))
    return read.withColumn("stamped", F.coalesce(recent, F.lit(False))).drop("created_at")


@job("s21_table_from_values", """
    SELECT 'CA' AS state, c_custkey, unnest(['phone', 'mail']) AS channel, unnest([1, 2]) AS priority FROM customer""")
def table_from_values(t):
    """A fixed value down a column, and lists zipped into rows, for every customer."""
    lists = F.arrays_zip(F.array(F.lit("phone"), F.lit("mail")).alias("channel"), F.array(F.lit(1), F.lit(2)).alias("priority"))
    return t.customer.select(F.lit("CA").alias("state"), "c_custkey", F.inline(lists))


@job("s22_create_insert_drop", "SELECT n_name AS title, CAST(count(*) AS INTEGER) AS plays FROM customer JOIN nation ON n_nationkey = c_nationkey GROUP BY 1")
def create_insert_drop(t):
    name, place = _table_name(t, "tracks"), t.scratch("tracks-table")
    t.spark.sql(f"DROP TABLE IF EXISTS {name}")
    t.spark.sql(f"CREATE TABLE {name} (title STRING, plays INT) USING parquet LOCATION '{place}'")
    plays = t.customer.join(t.nation, F.col("c_nationkey") == F.col("n_nationkey")).groupBy("n_name").agg(F.count(F.lit(1)).cast("int").alias("plays"))
    plays.write.insertInto(name)
    schema = t.spark.table(name).schema
    t.spark.sql(f"DROP TABLE {name}")
    return t.spark.read.schema(schema).parquet(place)


@job("s23_table_listing", " UNION ALL ".join(
    f"""SELECT 'tablemill_{n}' AS "table", column_name AS "column", (SELECT count(*) FROM {n}) AS n_rows FROM (DESCRIBE {n})""" for n in TABLES))
def table_listing(t):
    sizes = []
    for name in TABLES:
        getattr(t, name).createOrReplaceTempView(f"tablemill_{name}")
        sizes.append(getattr(t, name).agg(F.count(F.lit(1)).alias("n_rows")).select(F.lit(f"tablemill_{name}").alias("table"), "n_rows"))
    listed = t.spark.createDataFrame(readers.catalog_columns(t.spark, [f"tablemill_{n}" for n in TABLES]), "`table` string, `column` string, type string")
    return listed.join(union_all(sizes), "table").select("table", "column", "n_rows")


@job("s24_record_contract", """
    SELECT o_orderkey, o_orderkey % 11 <> 0 AS price_ok, o_orderkey % 7 <> 0 AS quantity_ok, o_orderkey % 5 <> 0 AS date_ok, o_orderkey % 3 <> 0 AS country_ok,
      o_orderkey % 11 <> 0 AND o_orderkey % 7 <> 0 AND o_orderkey % 5 <> 0 AND o_orderkey % 3 <> 0 AS accepted FROM orders""")
def record_contract(t):
    key = F.col("o_orderkey")
    records = t.orders.select(
        "o_orderkey", F.when(key % 11 == 0, "free").otherwise(F.col("o_totalprice").cast("string")).alias("price"),
        F.when(key % 7 == 0, "0").otherwise((key % 7).cast("string")).alias("quantity"),
        F.when(key % 5 == 0, F.date_format("o_orderdate", "dd.MM.yyyy")).otherwise(F.date_format("o_orderdate", "yyyy-MM-dd")).alias("date"),
        F.when(key % 3 == 0, "usa").otherwise("US").alias("countrycode"))
    rules = {"price_ok": contract.number_rule("price"), "quantity_ok": contract.number_rule("quantity", 1), "date_ok": contract.date_rule("date"),
             "country_ok": contract.pattern_rule("countrycode", "^[A-Z]{2}$")}
    return contract.check_rules(records, rules).select("o_orderkey", *rules, "accepted")


@job("s25_chunk_totals", """
    WITH n AS (SELECT CAST(o_totalprice AS DECIMAL(18,2)) AS v, (row_number() OVER (ORDER BY o_orderkey) - 1) // 1000 AS chunk FROM orders),
         c AS (SELECT chunk, sum(v) AS s FROM n GROUP BY 1)
    SELECT chunk, CAST(s AS DOUBLE) AS chunk_total, CAST(sum(s) OVER (ORDER BY chunk) AS DOUBLE) AS running_total FROM c""")
def chunk_totals(t):
    numbered = positions(t.orders.select("o_orderkey", "o_totalprice"), [F.col("o_orderkey")], on="o_orderkey")
    chunks = readers.chunk_totals(numbered, "pos", money("o_totalprice"), 1000)
    summed = running_sums(stage(chunks, "chunks"), [F.col("chunk")], "chunk", {"running_total": F.col("chunk_total")})
    return summed.select("chunk", *[F.col(c).cast("double").alias(c) for c in ("chunk_total", "running_total")])


@job("s26_source_selector", " UNION ALL ".join(f"SELECT '{k}' AS kind, count(*) AS n, CAST(sum(CAST(s_acctbal AS DECIMAL(18,2))) AS DOUBLE) AS balance FROM supplier" for k in ("csv", "json", "parquet", "table", "xml")))
def source_selector(t):
    s, schema = t.supplier, "s_suppkey BIGINT, s_name STRING, s_nationkey INT, s_acctbal DOUBLE"
    stored = t.scratch("supplier-parquet")
    s.write.parquet(stored)
    s.createOrReplaceTempView("tablemill_supplier")
    configs = [
        readers.SourceConfig("csv", writers.write_csv(s, t.scratch("supplier-csv")), schema), readers.SourceConfig("json", writers.write_json(s, t.scratch("supplier-json")), schema),
        readers.SourceConfig("parquet", stored), readers.SourceConfig("table", "tablemill_supplier"),
        readers.SourceConfig("xml", writers.write_xml(s, t.scratch("supplier-xml"), "suppliers", "supplier"), schema, {"row_tag": "supplier"})]
    return union_all([readers.read_source(t.spark, c).agg(F.count(F.lit(1)).alias("n"), total("s_acctbal").alias("balance")).select(F.lit(c.kind).alias("kind"), "*") for c in configs])


@job("s27_copy_matching_lines", """
    SELECT count(*) AS n, CAST(sum(CAST(value AS DECIMAL(18,2))) AS DOUBLE) AS total, CAST(sum(CAST(value AS DECIMAL(18,2))) AS DOUBLE) / count(*) AS average FROM events WHERE event_type = 'click'""")
def copy_matching_lines(t):
    """Lines that start with a mark go to a new file; the number after the colon is averaged on the way back."""
    log = t.events.select(F.concat("event_type", F.lit(": "), money("value").cast("string")).alias("line"))
    read = readers.read_lines(t.spark, writers.write_lines(log, "line", t.scratch("log")))
    copied = readers.read_lines(t.spark, writers.write_lines(read.filter(F.col("value").startswith("click:")), "value", t.scratch("matching")))
    number = tx.number_after_colon(F.col("value"))
    return copied.agg(F.count(F.lit(1)).alias("n"), total(number).alias("total"), (total(number) / F.count(F.lit(1))).alias("average"))
