"""Registered queries: each operator on the driver's tables, with its SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

REGISTRY: dict[str, tuple[Callable[[SparkSession, str], DataFrame], str | None]] = {}


def query(sql: str | None = None):
    """Registers a function of (spark, sf_dir) under its name, with the
    equivalent DuckDB SQL where there is one."""

    def add(f: Callable[[SparkSession, str], DataFrame]):
        REGISTRY[f.__name__] = (f, sql)
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
