"""Registry that ties a job name to its builder and, where SQL can state it, its oracle."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from tablemill.session import scratch_path

TABLES = (
    "region nation customer supplier part orders lineitem events documents "
    "embeddings pages benchmark labels conversations"
).split()


class Tables:
    """Lazy access to the parquet tables of one scale-factor folder."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark = spark
        self._dir = sf_dir.rstrip("/")

    def __getattr__(self, name: str) -> DataFrame:
        if name not in TABLES:
            raise AttributeError(name)
        return self.spark.read.parquet(f"{self._dir}/{name}.parquet")

    def scratch(self, label: str) -> str:
        return scratch_path(self.spark, label)


@dataclass(frozen=True)
class Job:
    name: str
    build: Callable[[Tables], DataFrame]
    oracle: str | None


JOBS: dict[str, Job] = {}


def job(name: str, oracle: str | None = None):
    """Register ``build(tables) -> DataFrame`` under ``name``."""

    def register(build):
        if name in JOBS:
            raise ValueError(f"job {name} is registered twice")
        JOBS[name] = Job(name, build, oracle)
        return build

    return register


def load_all() -> dict[str, Job]:
    """Import every catalog module and return the filled registry."""
    import importlib
    import pkgutil

    import tablemill.catalog as catalog

    for module in sorted(m.name for m in pkgutil.iter_modules(catalog.__path__)):
        importlib.import_module(f"tablemill.catalog.{module}")
    return JOBS
