"""Registered queries and their SQL. describe() lists them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    """Registers a function by its name, with the SQL that gives the same rows where there is one."""

    def register(function: Query) -> Query:
        QUERIES[function.__name__] = function
        if sql:
            ORACLES[function.__name__] = sql
        return function

    return register


def describe(spark: SparkSession) -> DataFrame:
    rows = [(name, (f.__doc__ or "").strip(), name in ORACLES) for name, f in QUERIES.items()]
    return spark.createDataFrame(rows, "name string, summary string, has_sql boolean")
