"""Streaming jobs (X)."""

from pyspark.sql import functions as F

from tablemill.functions.numbers import money
from tablemill.registry import job
from tablemill.sources import writers
from tablemill.streaming import feeds

GPS = ["record_id", "timestamp", "vin", "lon", "lat", "speed"]


def gps_records(t):
    return t.events.select(
        F.col("event_id").cast("string").alias("record_id"), F.date_format("ts", "HH:mm:ss").alias("timestamp"), F.concat(F.lit("V"), "user_id").alias("vin"),
        (F.col("user_id") / 8).alias("lon"), (F.col("user_id") / 4 - 90).alias("lat"), F.col("value").alias("speed"))


def gps_files(t):
    return writers.write_gps(gps_records(t).repartition(6, "record_id"), t.scratch("gps"), GPS)


@job("x01_speed_alerts", "SELECT 'V' || user_id AS vin, max(value) AS speed FROM events GROUP BY 1 HAVING max(value) > 45")
def speed_alerts(t):
    """Alerts of each delivery, merged per vehicle; equal to one batch over all records."""
    feed = feeds.gps_feed(t.spark, gps_files(t), files_per_batch=3)
    alerts = feeds.speed_alerts(feed, t.scratch("alerts"), t.scratch("alerts-state"))
    return alerts.filter("alert").groupBy("vin").agg(F.max("speed").alias("speed"))


@job("x01_overall_top_speeds", "SELECT 'V' || user_id AS vin, max(value) AS speed FROM events GROUP BY 1")
def overall_top_speeds(t):
    feed = feeds.gps_feed(t.spark, gps_files(t), files_per_batch=3)
    return feeds.overall_top_speeds(feed, t.scratch("speeds"), t.scratch("speeds-state"))


@job("x02_created_objects", """
    SELECT 'o/' || o_orderkey || '.csv' AS key, o_custkey AS size, strftime(o_orderdate, '%Y-%m-%dT%H:%M:%SZ') AS at FROM orders WHERE o_orderstatus = 'F' AND o_custkey % 3 <> 0""")
def created_objects(t):
    record = F.struct(
        F.when(F.col("o_orderstatus") == "F", "ObjectCreated:Put").otherwise("ObjectRemoved:Delete").alias("eventName"),
        F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("eventTime"),
        F.struct(F.struct(F.when(F.col("o_custkey") % 3 == 0, "other").otherwise("vehicle-data").alias("name")).alias("bucket"),
                 F.struct(F.concat(F.lit("o/"), "o_orderkey", F.lit(".csv")).alias("key"), F.col("o_custkey").alias("size")).alias("object")).alias("s3"))
    notices = t.orders.select(F.to_json(F.struct(F.array(record).alias("Records"))).alias("notice"))
    return feeds.created_objects(notices, "notice", "vehicle-data")


KEYWORDS = ["the", "que", "und"]
TRACKED = "(SELECT * FROM conversations WHERE contains(lower(text), 'the') OR contains(lower(text), 'que') OR contains(lower(text), 'und'))"


def tracked(t):
    schema = "conv_id BIGINT, turn BIGINT, role STRING, text STRING"
    source = writers.write_json(t.conversations.repartition(4, "conv_id"), t.scratch("statuses"))
    path = t.scratch("tracked")
    feeds.tracked_feed(feeds.json_feed(t.spark, source, schema, files_per_batch=2), "text", KEYWORDS, path, t.scratch("tracked-state"))
    return t.spark.read.schema(schema).json(path)


@job("x03_keyword_counts", " UNION ALL ".join(f"SELECT '{k}' AS keyword, count(*) FILTER (contains(lower(text), '{k}')) AS n FROM {TRACKED}" for k in KEYWORDS))
def keyword_counts(t):
    return feeds.keyword_counts(tracked(t), "text", KEYWORDS)


@job("x03_first_hundred", f"SELECT conv_id, turn, role FROM {TRACKED} ORDER BY conv_id, turn LIMIT 100")
def first_hundred(t):
    """The feed stops after 100 statuses: here the first 100 in order of conversation and turn."""
    return tracked(t).orderBy("conv_id", "turn").limit(100).select("conv_id", "turn", "role")


@job("x04_converted_lines", "SELECT upper(role) || ' ' || conv_id || ' ' || turn AS value FROM conversations")
def converted_lines(t):
    lines = t.conversations.select(F.concat_ws(" ", "role", F.col("conv_id").cast("string"), F.col("turn").cast("string")).alias("value"))
    source = writers.write_lines(lines.repartition(4), "value", t.scratch("lines"))
    return feeds.convert_feed(feeds.text_feed(t.spark, source), F.upper, t.scratch("upper"), t.scratch("upper-state"))


@job("x04_running_average", "SELECT 'V' || user_id AS vin, CAST(sum(CAST(value AS DECIMAL(18,2))) AS DOUBLE) / count(*) AS average, count(*) AS n FROM events GROUP BY 1")
def running_average(t):
    feed = feeds.gps_feed(t.spark, gps_files(t), files_per_batch=3)
    return feeds.running_average(feed, ["vin"], money("speed"), t.scratch("averages"), t.scratch("averages-state"))


@job("x05_produce_records", """
    SELECT event_id || ' ' || strftime(ts, '%H:%M:%S') || ' V' || user_id || ' ' || CAST(CAST(value AS DECIMAL(18,2)) AS VARCHAR) AS value FROM events""")
def produce_records(t):
    records = gps_records(t).withColumn("speed", money("speed"))
    path = writers.write_gps(records, t.scratch("records"), ["record_id", "timestamp", "vin", "speed"])
    return t.spark.read.text(path)
