"""Registration of driver queries and the tables they read."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

from terrascore.session import configure, scratch_path

# schemas by table path: inferring one costs a job that reads a file footer
_SCHEMAS: dict[str, StructType] = {}
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


class Tables:
    """Driver tables of one scale factor as attributes: ``t.orders``."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark = configure(spark)
        self.folder = folder

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_"):
            raise AttributeError(name)
        path = f"{self.folder}/{name}.parquet"
        if path not in _SCHEMAS:
            _SCHEMAS[path] = self.spark.read.parquet(path).schema
        return self.spark.read.schema(_SCHEMAS[path]).parquet(path)

    def scratch(self, label: str) -> str:
        return scratch_path(self.spark, label)


def query(key: str, sql: str | None = None):
    """Register ``fn(tables) -> DataFrame`` under ``key`` with its SQL text."""

    def add(fn: Callable[[Tables], DataFrame]):
        if key in QUERIES:
            raise ValueError(f"query {key} registered twice")
        QUERIES[key] = lambda spark, folder: fn(Tables(spark, folder))
        if sql is not None:
            SQL[key] = sql
        return fn

    return add
