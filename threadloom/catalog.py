"""All registered queries of the engine and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from threadloom.plans import REGISTRY, audits, eventlog, evaluation, graphs, matching, readmodel, relational, table, timeline, transcripts  # noqa: F401


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Episodes: sessionised, cut where speakers change mode, assembled."""
    return REGISTRY["episodes"][0](spark, sf_dir)


def queries() -> dict:
    return {name: f for name, (f, _) in REGISTRY.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for name, (_, sql) in REGISTRY.items() if sql}
