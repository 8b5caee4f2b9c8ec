"""Registration of queries and of the SQL that says the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    """Register a function of (spark, sf_dir) under its own name."""

    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def typed(**columns: str) -> None:
    """Name the types of columns whose SQL literals are decimals: query_name="column TYPE, ..."."""
    for name, types in columns.items():
        casts = ", ".join(f"CAST({c} AS {t}) AS {c}" for c, t in (x.split() for x in types.split(", ")))
        SQL[name] = f"SELECT * REPLACE ({casts}) FROM ({SQL[name]}) AS oracle"
