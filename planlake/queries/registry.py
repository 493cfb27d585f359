"""A decorator that files a query and its SQL under the function's name."""

from __future__ import annotations

from pyspark.sql import SparkSession

from planlake.sources.tables import parquet


class Tables:
    """tables.orders is the orders table of a folder."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self._dir = spark, sf_dir

    def __getattr__(self, name: str):
        return parquet(self.spark, self._dir, name)


def catalogue():
    queries, sql = {}, {}

    def query(oracle: str | None = None):
        def file(fn):
            queries[fn.__name__] = lambda spark, sf_dir: fn(Tables(spark, sf_dir))
            if oracle:
                sql[fn.__name__] = oracle
            return fn

        return file

    return query, queries, sql
