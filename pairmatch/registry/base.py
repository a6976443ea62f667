"""How a query is registered."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from pairmatch.fixtures import duckdb_sql, table, view_sql


class Tables:
    """The given tables and derived views of one data folder, by name."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark = spark
        self._dir = sf_dir

    def __getitem__(self, name: str) -> DataFrame:
        return table(self.spark, self._dir, name)


def register(queries: dict, oracles: dict, views: str = "", sql: str | None = None, ctes: str = ""):
    """Decorator: add a function of ``Tables`` under its name, and its SQL over ``views``."""

    def add(fn: Callable[[Tables], DataFrame]):
        name = fn.__name__
        queries[name] = lambda spark, sf_dir: fn(Tables(spark, sf_dir))
        if sql is not None:
            parts = [p for p in (view_sql(*views.split()) if views else "", duckdb_sql(ctes)) if p]
            prefix = f"with recursive {', '.join(parts)} " if parts else ""
            oracles[name] = prefix + duckdb_sql(sql)
        return fn

    return add
