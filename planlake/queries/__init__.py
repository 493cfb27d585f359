"""The query catalogue over the driver's tables: Spark plans and, for each, the SQL that says the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from planlake.queries import aggregates, construction, files, graphs, insql, joins, plans, scoring, series, texts

_MODULES = (aggregates, joins, graphs, texts, scoring, plans, construction, series, insql, files)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: q for m in _MODULES for name, q in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for m in _MODULES for name, sql in m.SQL.items()}


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Depth, width and parallelism of the turn graphs of conversations."""
    return queries()["q29_turn_dag_depth"](spark, sf_dir)
