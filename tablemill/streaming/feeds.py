"""Micro-batch feeds over delivered files.

New files are the deliveries.  A batch result is written under its batch number, so a batch that
is repeated after a failure replaces its own earlier output.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

GPS_SCHEMA = "record_id STRING, timestamp STRING, vin STRING, lon DOUBLE, lat DOUBLE, speed DOUBLE"
# Fixed value: speeds above this raise an alert.
SPEED_LIMIT = 45


def gps_feed(spark: SparkSession, path: str, files_per_batch: int = 1000) -> DataFrame:
    return (spark.readStream.schema(GPS_SCHEMA).option("sep", " ").option("recursiveFileLookup", True)
            .option("maxFilesPerTrigger", files_per_batch).csv(path))


def text_feed(spark: SparkSession, path: str, files_per_batch: int = 1000) -> DataFrame:
    return spark.readStream.option("maxFilesPerTrigger", files_per_batch).text(path)


def json_feed(spark: SparkSession, path: str, schema: str, files_per_batch: int = 1000) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).json(path)


def run_batches(feed: DataFrame, work: Callable[[DataFrame, int], None], checkpoint: str, mode: str = "append") -> None:
    """Process everything that has been delivered so far, then stop."""
    query = feed.writeStream.outputMode(mode).foreachBatch(work).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()


def batch_writer(shape: Callable[[DataFrame], DataFrame], path: str) -> Callable[[DataFrame, int], None]:
    def write(batch: DataFrame, number: int) -> None:
        shape(batch).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return write


class ChangeLog:
    """The latest state of every key, from batches of changes.

    A batch writes its changes beside those since the last snapshot.  Every ``every``-th batch folds the
    snapshot before it and these changes into the next one, in a folder of its own that counts once Spark
    has marked it as complete.  A repeated batch writes the same files again.  A read opens one snapshot and
    the changes of fewer than ``every`` batches (of the fold before, if one is being written), however many
    batches there have been.
    """

    def __init__(self, spark: SparkSession, path: str, keys: Sequence[str], schema: str, every: int = 16):
        self.spark, self.path, self.keys, self.schema, self.every = spark, path, list(keys), schema, every

    def _exists(self, name: str) -> bool:
        at = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
        return at.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(at)

    def _read(self, after: int, upto: int) -> list[DataFrame]:
        """The snapshot ``after`` and the changes from there to batch ``upto``, each with its batch."""
        plain = self.spark.read.schema(f"{self.schema}, batch long")
        parts = [plain.parquet(f"{self.path}/snapshot={after}")] if after >= 0 else []
        changes = [f"{self.path}/after={after}/change={n}" for n in range(after + 1, upto + 1) if self._exists(f"after={after}/change={n}/_SUCCESS")]
        return parts + ([plain.parquet(*changes)] if changes else [])

    def _fold(self, parts: list[DataFrame]) -> DataFrame:
        rest = [c for c in parts[0].columns if c not in (*self.keys, "batch")]
        every = parts[0]
        for part in parts[1:]:
            every = every.unionByName(part)
        last = every.groupBy(*self.keys).agg(F.max_by(F.struct(*rest, "batch"), "batch").alias("last"))
        return last.select(*self.keys, *[f"last.{c}" for c in rest], "last.batch")

    def write(self, batch: DataFrame, number: int) -> None:
        after = number // self.every * self.every - 1
        marked = batch.withColumn("batch", F.lit(number).cast("long"))
        marked.write.mode("overwrite").parquet(f"{self.path}/after={after}/change={number}")
        if (number + 1) % self.every == 0:
            self._fold(self._read(after, number)).write.mode("overwrite").parquet(f"{self.path}/snapshot={number}")

    def read(self) -> DataFrame:
        """The keys and their latest values."""
        after = -1
        while self._exists(f"snapshot={after + self.every}/_SUCCESS"):
            after += self.every
        parts = self._read(after, after + self.every)
        if not parts:
            return self.spark.createDataFrame([], self.schema)
        return self._fold(parts).drop("batch")


def top_speeds(batch: DataFrame) -> DataFrame:
    """Highest speed per vehicle of one delivery, with the alert flag."""
    return batch.groupBy("vin").agg(F.max("speed").alias("speed")).withColumn("alert", F.col("speed") > SPEED_LIMIT)


def speed_alerts(feed: DataFrame, path: str, checkpoint: str) -> DataFrame:
    """Maxima and alerts of each delivery: batch, vin, speed, alert."""
    run_batches(feed, batch_writer(top_speeds, path), checkpoint)
    return feed.sparkSession.read.parquet(path)


def overall_top_speeds(feed: DataFrame, path: str, checkpoint: str) -> DataFrame:
    """The stateful variant: maxima over all deliveries, each change written once."""
    state = feed.groupBy("vin").agg(F.max("speed").alias("speed"))
    log = ChangeLog(feed.sparkSession, path, ["vin"], "vin string, speed double")
    run_batches(state, log.write, checkpoint, mode="update")
    return log.read()


NOTICE_SCHEMA = ("Records array<struct<eventName: string, eventTime: string, "
                 "s3: struct<bucket: struct<name: string>, object: struct<key: string, size: bigint>>>>")


def created_objects(notices: DataFrame, column: str, bucket: str) -> DataFrame:
    """Objects that were put into ``bucket`` according to notification texts."""
    records = notices.select(F.explode(F.from_json(column, NOTICE_SCHEMA)["Records"]).alias("r"))
    wanted = (F.col("r.eventName") == "ObjectCreated:Put") & (F.col("r.s3.bucket.name") == bucket)
    return records.filter(wanted).select(F.col("r.s3.object.key").alias("key"), F.col("r.s3.object.size").alias("size"), F.col("r.eventTime").alias("at"))


def tracks(text: Column, keywords: Sequence[str]) -> Column:
    """Any keyword occurs in the text, upper or lower case, also inside a word."""
    low = F.lower(text)
    out = F.lit(False)
    for k in keywords:
        out = out | F.contains(low, F.lit(k.lower()))
    return out


def tracked_feed(feed: DataFrame, column: str, keywords: Sequence[str], path: str, checkpoint: str) -> None:
    """Texts with a keyword go to JSON lines as they arrive."""
    query = (feed.filter(tracks(F.col(column), keywords)).writeStream.format("json").option("path", path)
             .option("checkpointLocation", checkpoint).trigger(availableNow=True).start())
    query.awaitTermination()


def keyword_counts(rows: DataFrame, column: str, keywords: Sequence[str]) -> DataFrame:
    """Number of texts per keyword."""
    counts = rows.agg(*[F.count_if(F.contains(F.lower(F.col(column)), F.lit(k.lower()))).alias(k) for k in keywords])
    return counts.unpivot([], list(keywords), "keyword", "n")


def convert_feed(feed: DataFrame, convert: Callable[[Column], Column], path: str, checkpoint: str) -> DataFrame:
    """Read lines, convert each, write them on."""
    lines = feed.select(convert(F.col("value")).alias("value"))
    query = lines.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return feed.sparkSession.read.parquet(path)


def running_average(feed: DataFrame, keys: Sequence[str], value: Column, path: str, checkpoint: str) -> DataFrame:
    """Average over all deliveries so far; a batch writes the keys that it changed, and the last word counts."""
    state = feed.groupBy(*keys).agg((F.sum(value).cast("double") / F.count(value)).alias("average"), F.count(value).alias("n"))
    kinds = dict(state.dtypes)
    log = ChangeLog(feed.sparkSession, path, keys, ", ".join(f"`{c}` {kinds[c]}" for c in state.columns))
    run_batches(state, log.write, checkpoint, mode="update")
    return log.read()
