"""Readers for delimited, JSON, XML, text and table sources."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field
from urllib.parse import quote_plus

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablemill.operators.sorting import top_per_group

CORRUPT = "_corrupt_record"


def read_csv(spark: SparkSession, path: str, schema: T.StructType | str | None = None, header: bool = True,
             sep: str = ",", mode: str = "PERMISSIVE", **options) -> DataFrame:
    """Delimited text; types are guessed only when no schema is given."""
    reader = spark.read.option("header", header).option("sep", sep).option("mode", mode).options(**options)
    if schema is None:
        return reader.option("inferSchema", True).csv(path)
    return reader.schema(schema).csv(path)


def _all_columns_read(columns: Sequence[str]) -> Column:
    """Always true, but keeps every column in the scan: a cell is only checked when its column is read."""
    return F.length(F.concat_ws("", *[F.col(c).cast("string") for c in columns])) >= 0


def read_csv_dropping_bad(spark: SparkSession, path: str, schema: T.StructType | str, **options) -> DataFrame:
    """Rows that do not fit the schema are left out, whichever columns the query uses later."""
    rows = read_csv(spark, path, schema, mode="DROPMALFORMED", columnPruning=False, **options)
    return rows.filter(_all_columns_read(rows.columns))


def split_bad_rows(spark: SparkSession, path: str, schema: T.StructType, **options) -> DataFrame:
    """All rows with a flag and the raw text of those that do not fit, so rejects can be counted."""
    wide = T.StructType([*schema.fields, T.StructField(CORRUPT, T.StringType())])
    rows = read_csv(spark, path, wide, columnNameOfCorruptRecord=CORRUPT, columnPruning=False, **options)
    return rows.withColumn("rejected", F.col(CORRUPT).isNotNull() & _all_columns_read([f.name for f in wide.fields[:-1]]))


def relabel(df: DataFrame, names: Sequence[str]) -> DataFrame:
    """Replace the header by other labels."""
    return df.toDF(*names)


def read_messy_text(spark: SparkSession, path: str, header_line: int = 3, comment: str = "#", sep: str = " ",
                    number_type: str = "double") -> DataFrame:
    """Delimited text with lines before the header and comments in between.

    Comments run to the end of the line; blank lines do not count.  The header is line
    ``header_line`` (from 0) of what is left of each file.  Only the start of a file can hold
    it, so a few lines per file are ordered and the rest is read in parallel.  Files may have other
    columns, or the same in another order: columns are united by name, in the order in which files
    name them, and are null where a file lacks them.  The first column of all is text.
    """
    raw = spark.read.text(path).select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("id"),
        F.rtrim(F.regexp_replace("value", f"\\Q{comment}\\E.*$", "")).alias("line"))
    kept = raw.filter("line <> ''")
    first = top_per_group(kept.filter("block = 0"), ["file"], [F.col("id")], header_line + 1)
    cut = first.groupBy("file").agg(F.max("id").alias("cut"), F.split(F.max_by("line", "id"), sep, -1).alias("header"))
    # each file is read by its own header; what comes to the driver is the different headers
    headers = [r["header"] for r in cut.groupBy("header").agg(F.min("file").alias("file")).orderBy("file").collect()]
    names = list(dict.fromkeys(n for h in headers for n in h))
    width = max(map(len, headers), default=0)
    body = kept.join(cut, "file").filter((F.col("block") > 0) | (F.col("id") > F.col("cut")))
    cells = F.from_csv("line", F.lit(", ".join(f"c{i} string" for i in range(max(width, 1)))), {"sep": sep})
    row = body.select("header", cells.alias("r")).select("header", F.array(*[F.col(f"r.c{i}") for i in range(max(width, 1))]).alias("cells"))

    def value(name: str, kind: str) -> Column:
        at = F.array_position("header", F.lit(name))
        return F.when(at > 0, F.get("cells", at.cast("int") - 1)).try_cast(kind).alias(name)

    return row.select(*[value(n, "string" if i == 0 else number_type) for i, n in enumerate(names)])


def read_json(spark: SparkSession, path: str, schema: T.StructType | str | None = None, whole_file: bool = False) -> DataFrame:
    """JSON lines, or one document per file."""
    reader = spark.read.option("multiLine", whole_file)
    return (reader.schema(schema) if schema is not None else reader).json(path)


def read_records(spark: SparkSession, path: str, array_field: str, schema: T.StructType | str | None = None,
                 whole_file: bool = False) -> DataFrame:
    """Documents that hold an array of records -> one row per record."""
    return read_json(spark, path, schema, whole_file).select(F.inline(F.col(array_field)))


def read_xml(spark: SparkSession, path: str, row_tag: str, schema: T.StructType | str | None = None) -> DataFrame:
    """Repeated element -> rows; attributes become columns with a leading underscore."""
    reader = spark.read.format("xml").option("rowTag", row_tag)
    return (reader.schema(schema) if schema is not None else reader).load(path)


def parse_xml(text: Column, schema: str) -> Column:
    return F.from_xml(text, schema)


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path)


def read_folder(spark: SparkSession, path: str, schema: T.StructType | str, sep: str = ",", header: bool = False) -> DataFrame:
    """Every file under a folder or pattern as one table, with the file each row came from."""
    rows = spark.read.schema(schema).option("sep", sep).option("header", header).option("recursiveFileLookup", True).csv(path)
    return rows.withColumn("file", F.input_file_name())


def file_inventory(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """Files under a folder with size and extension; contents are not read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(path)
    return files.select("path", "length", "modificationTime", F.regexp_extract("path", "\\.([A-Za-z0-9]+)$", 1).alias("extension"))


def lines_by_extension(spark: SparkSession, path: str) -> DataFrame:
    """Files and lines per extension, counted line by line in parallel."""
    rows = spark.read.option("recursiveFileLookup", True).text(path).select(F.col("_metadata.file_path").alias("file"))
    per_file = rows.groupBy("file").agg(F.count(F.lit(1)).alias("n"))
    extension = F.regexp_extract("file", "\\.([A-Za-z0-9]+)$", 1).alias("extension")
    return per_file.groupBy(extension).agg(F.count(F.lit(1)).alias("n_files"), F.sum("n").alias("n_lines"))


# URL prefix and default port per database kind.
DATABASES = {"mysql": ("jdbc:mysql", 3306), "postgresql": ("jdbc:postgresql", 5432), "sqlite": ("jdbc:sqlite", None)}


def jdbc_options(kind: str, database: str, table: str, host: str = "", port: int | None = None, user: str = "", password: str = "",
                 split_column: str | None = None, low=None, high=None, parts: int = 32) -> dict[str, str]:
    """Options of a parallel JDBC read; without a split column one task reads the table."""
    if kind not in DATABASES:
        raise ValueError(f"unknown database kind {kind}")
    prefix, default_port = DATABASES[kind]
    url = f"{prefix}:{database}" if kind == "sqlite" else f"{prefix}://{host}:{port or default_port}/{quote_plus(database)}"
    out = {"url": url, "dbtable": table}
    if user:
        out |= {"user": user, "password": password}
    if split_column:
        out |= {"partitionColumn": split_column, "lowerBound": str(low), "upperBound": str(high), "numPartitions": str(parts)}
    return out


@dataclass(frozen=True)
class SourceConfig:
    """Where the data of a run comes from."""

    kind: str
    path: str = ""
    schema: str | None = None
    options: dict = field(default_factory=dict)


def read_source(spark: SparkSession, config: SourceConfig) -> DataFrame:
    """Read the configured source; an unknown kind is an error."""
    kind, path, schema = config.kind, config.path, config.schema
    if kind in ("csv", "excel"):  # spreadsheets arrive exported as csv
        if path.lower().rstrip("/").endswith((".xls", ".xlsx", ".xlsm", ".xlsb")):
            raise ValueError(f"{path} is a workbook; export its sheet as csv first")
        return read_csv(spark, path, schema, **config.options)
    if kind == "json":
        return read_json(spark, path, schema)
    if kind == "xml":
        return read_xml(spark, path, config.options["row_tag"], schema)
    if kind == "text":
        return read_lines(spark, path)
    if kind in ("parquet", "binary"):
        return spark.read.parquet(path)
    if kind == "table":
        return spark.table(path)
    if kind == "sql":
        return spark.read.format("jdbc").options(**jdbc_options(**config.options)).load()
    raise ValueError(f"unknown source kind {kind}")


def chunk_totals(numbered: DataFrame, pos: str, value: Column, chunk_rows: int) -> DataFrame:
    """Sum per chunk of consecutive rows."""
    chunk = F.floor((F.col(pos) - 1) / chunk_rows).alias("chunk")
    return numbered.groupBy(chunk).agg(F.sum(value).alias("chunk_total"), F.count(F.lit(1)).alias("rows"))


def catalog_columns(spark: SparkSession, tables: Sequence[str]) -> list[tuple[str, str, str]]:
    """Table, column and type of the named catalog tables."""
    return [(name, c.name, c.dataType) for name in tables for c in spark.catalog.listColumns(name)]


