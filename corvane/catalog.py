"""All registered queries with the SQL that says the same."""

from __future__ import annotations

from importlib import import_module

from pyspark.sql import DataFrame, SparkSession

from corvane.registry import QUERIES, SQL, Query

PLANS = ("analytics", "windows", "texts", "filters", "vectors", "studies", "rules", "matching", "builders", "storage", "events")


def _load() -> None:
    for name in PLANS:
        import_module(f"corvane.plans.{name}")


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Section statistics over a corpus of runs."""
    return queries()["agg1_section_stats"](spark, sf_dir)


def queries() -> dict[str, Query]:
    _load()
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    _load()
    return dict(SQL)
