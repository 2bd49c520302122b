"""Column-name and column-type helpers; they look at the schema only."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def clean_name(name: str) -> str:
    """Trim; blanks and dashes to underscores; drop other symbols and one leading underscore;
    a leading digit gets an underscore in front."""
    name = name.strip().replace(" ", "_").replace("-", "_").removeprefix("_")
    name = re.sub(r"\W", "", name)
    return "_" + name if name[:1].isdigit() else name


def clean_names(df: DataFrame) -> DataFrame:
    return df.toDF(*[clean_name(c) for c in df.columns])


def numeric_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.NumericType)]


def date_columns(df: DataFrame) -> list[str]:
    kinds = (T.DateType, T.TimestampType, T.TimestampNTZType)
    return [f.name for f in df.schema.fields if isinstance(f.dataType, kinds)]


def text_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)]


def non_numeric_columns(df: DataFrame) -> list[str]:
    numeric = set(numeric_columns(df))
    return [c for c in df.columns if c not in numeric]


def strip_symbol(df: DataFrame, symbol: str = "$") -> DataFrame:
    """Remove ``symbol`` from every text column."""
    return df.withColumns({c: F.replace(F.col(c), F.lit(symbol), F.lit("")) for c in text_columns(df)})
