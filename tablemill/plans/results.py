"""All results of series, appended run by run."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tablemill.operators.joining import union_all
from tablemill.plans import series as ts
from tablemill.plans import smoothing as sm
from tablemill.session import stage

TABLES = ("acf", "trends", "forecast", "best_model")


def season_of(series: DataFrame, keys: Sequence[str], period: int) -> DataFrame:
    """Seasonal model and length per series, from the decomposition."""
    keys = list(keys)
    choice = ts.season_choice(series, keys, period).select(*keys, "seasonality")
    lengths = [ts.season_length(ts.decompose(series, keys, period, m), keys).select(*keys, F.lit(m).alias("seasonality"), "season_length") for m in ("add", "mul")]
    joined = choice.join(union_all(lengths), [*keys, "seasonality"], "left")
    return joined.select(*keys, "seasonality", F.coalesce("season_length", F.lit(2)).cast("long").alias("season_length"))


def series_results(series: DataFrame, keys: Sequence[str], freq: str) -> dict[str, DataFrame]:
    """Autocorrelation, parts, forecast and best model of every series of one frequency.

    The parts are those of the chosen seasonal model; without a season the trend is the smoothed level.  A
    series that cannot be smoothed keeps its last value as forecast and has no model and no level.
    """
    keys, period = list(keys), ts.PERIODS[freq]
    season = stage(season_of(series, keys, period), "results-season")
    best = stage(sm.choose_smoothing(series, keys, season), "results-models")
    smoothed = stage(sm.smooth(series, keys, best), "results-smoothed")
    columns = ["idx", "original", "trend", "seasonality", "residual"]
    parts = []
    for model in ("add", "mul"):
        own = series.join(season.filter(F.col("seasonality") == model).select(*keys), keys, "left_semi")
        parts.append(ts.decompose(own, keys, period, model).withColumnRenamed("value", "original"))
    none = smoothed.join(season.filter("seasonality = 'None'").select(*keys), keys, "left_semi")
    parts.append(sm.level_parts(none, keys))
    trends = union_all([p.select(*keys, F.col("idx").cast("long").alias("idx"), *columns[1:]) for p in parts])
    return {"acf": ts.autocorrelation(series, keys), "trends": trends, "forecast": sm.forecast_rows(smoothed, keys, freq), "best_model": sm.model_summary(best, keys)}


class ResultStore:
    """Result tables that runs append to, and the list of the pairs that have run.

    A run writes its rows under a number of its own and is listed last, so a run that breaks off leaves
    nothing behind that a read would see, and its pairs are found missing again.
    """

    def __init__(self, spark: SparkSession, path: str, keys: Sequence[str]):
        self.spark, self.path, self.keys = spark, path, list(keys)

    def _stored(self, name: str) -> DataFrame | None:
        at = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
        if not at.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(at):
            return None
        return self.spark.read.parquet(f"{self.path}/{name}")

    def runs(self) -> DataFrame | None:
        return self._stored("runs")

    def run_missing(self, wanted: DataFrame, results: Callable[[DataFrame], dict[str, DataFrame]]) -> int:
        """Compute and append the results of the wanted pairs that have not run; the number of them."""
        todo = stage(sm.run_missing(wanted.select(*self.keys).distinct(), self.runs(), self.keys), "results-pairs")
        missing = todo.count()
        if missing:
            run = uuid.uuid4().hex
            for name, frame in results(todo).items():
                frame.withColumn("run", F.lit(run)).write.mode("append").parquet(f"{self.path}/{name}")
            todo.withColumn("run", F.lit(run)).write.mode("append").parquet(f"{self.path}/runs")
        return missing

    def read(self, name: str) -> DataFrame:
        """A result table over all complete runs."""
        return self._stored(name).join(self.runs().select("run").distinct(), "run", "left_semi").drop("run")
