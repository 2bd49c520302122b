"""Writers; every one writes a folder of part files in parallel."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_csv(df: DataFrame, path: str, sep: str = ",", header: bool = True, mode: str = "errorifexists") -> str:
    df.write.mode(mode).option("header", header).option("sep", sep).csv(path)
    return path


def write_stamped_csv(df: DataFrame, path: str) -> str:
    """CSV with the time of the load in ``created_at``."""
    return write_csv(df.withColumn("created_at", F.current_timestamp()), path)


def write_json(df: DataFrame, path: str) -> str:
    df.write.json(path)
    return path


def write_xml(df: DataFrame, path: str, root_tag: str, row_tag: str) -> str:
    """Columns with a leading underscore become attributes."""
    df.write.format("xml").option("rootTag", root_tag).option("rowTag", row_tag).save(path)
    return path


def write_lines(df: DataFrame, column: str, path: str) -> str:
    df.select(F.col(column).cast("string").alias("value")).write.text(path)
    return path


def write_gps(df: DataFrame, path: str, columns: list[str]) -> str:
    """One record per line, values joined by blanks, no header."""
    df.select(F.concat_ws(" ", *[F.col(c).cast("string") for c in columns]).alias("value")).write.text(path)
    return path
