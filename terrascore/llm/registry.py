"""Queries of this package by key, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(key: str, sql: str | None = None):
    """Register ``fn(spark, sf_dir) -> DataFrame`` under ``key``."""

    def add(fn: Callable[[SparkSession, str], DataFrame]):
        QUERIES[key] = fn
        if sql is not None:
            SQL[key] = sql
        return fn

    return add
