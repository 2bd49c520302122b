"""How a user brings own functions: column expressions first, Arrow batches where Python is needed."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def apply_columns(df: DataFrame, **functions: Callable[[], Column]) -> DataFrame:
    """Add a column per ``() -> Column`` function."""
    return df.withColumns({name: make() for name, make in functions.items()})


def vectorised(function, returns: str):
    """A function from pandas Series to Series as a column function; for logic Spark has no expression for."""
    return F.pandas_udf(function, returns)


def sort_by(items: Column, before: Callable[[Column, Column], Column]) -> Column:
    """Sort an array with a comparator given as column expression."""
    return F.array_sort(items, before)


def extreme(items: Column, better: Callable[[Column, Column], Column]) -> Column:
    """The item that wins every comparison, by a test passed in."""
    return F.aggregate(F.slice(items, 2, 1 << 30), F.get(items, F.lit(0)), lambda best, x: F.when(better(x, best), x).otherwise(best))


def generate(df: DataFrame, items: Column, name: str) -> DataFrame:
    """One row per item that an expression generates from a row."""
    return df.withColumn(name, F.explode(items))


def map_batches(df: DataFrame, function: Callable[[pa.RecordBatch], pa.RecordBatch], schema: str) -> DataFrame:
    """Run a function over the Arrow batches of every partition in parallel."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield function(batch)

    return df.mapInArrow(run, schema)
