"""Session factory and the shared folder in which jobs keep their stage files."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession

_local_scratch: str | None = None
_tried: set[str] = set()


def get_session(app: str = "tablemill", master: str | None = None, **conf: str) -> SparkSession:
    """Return a session with the settings the jobs rely on.

    Only semantics are pinned here (UTC, ANSI, AQE).  Executor counts, memory and shuffle
    partitions belong to the cluster and are taken from its own defaults unless passed in.
    """
    builder = (
        SparkSession.builder.appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
    )
    if master:
        builder = builder.master(master)
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor can reach, as named by ``spark.checkpoint.dir``.

    Where the setting is absent, a temporary folder serves one process on one machine.  On a cluster
    it has to be set: executors would else write to their own disks, and a later read would miss those
    files without an error.  A folder that can lie on such a disk, a ``file:`` one or one that leaves its
    file system to Hadoop's default, is tried once: what executors write there must be seen by the driver
    and by the others.
    """
    global _local_scratch
    named = spark.conf.get("spark.checkpoint.dir", None)
    alone = spark.sparkContext.master == "local" or spark.sparkContext.master.startswith("local[")
    if not alone and not named:
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    if named:
        if not alone and (named.startswith("file:") or "://" not in named) and named not in _tried:
            _try_folder(spark, named.rstrip("/"))
            _tried.add(named)
        return named.rstrip("/")
    if _local_scratch is None:
        _local_scratch = tempfile.mkdtemp(prefix="tablemill-")
    return _local_scratch


def _try_folder(spark: SparkSession, folder: str) -> None:
    """Refuse a folder in which some rows that executors write cannot be read back, for whatever reason."""
    path, rows = f"{folder}/tablemill/probe-{uuid.uuid4().hex}", 32
    try:
        spark.range(0, rows, 1, rows).write.parquet(path)
        seen = spark.read.schema("id long").parquet(path).count()
    except Exception as error:
        raise ValueError(f"spark.checkpoint.dir names {folder}, which executors do not share") from error
    if seen != rows:
        raise ValueError(f"spark.checkpoint.dir names {folder}, which executors do not share")


def scratch_path(spark: SparkSession, label: str) -> str:
    """A fresh path under the shared folder."""
    return f"{shared_dir(spark)}/tablemill/{label}-{uuid.uuid4().hex}"


def stage(df, label: str):
    """Write ``df`` once as parquet in the shared folder and return the table read back.

    Cuts the lineage and keeps the result when executors are lost.
    """
    spark = df.sparkSession
    path = scratch_path(spark, label)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)

