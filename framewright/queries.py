"""Every query of the engine by name, with the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from framewright.functions.scalar import r6

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def names(text: str) -> list[str]:
    return [x.strip() for x in text.split(",") if x.strip()]


def show(df: DataFrame, columns: str, numbers: str = "") -> DataFrame:
    """Plain columns, and numbers to six decimals."""
    return df.select(*names(columns), *[r6(c).alias(c) for c in names(numbers)])


def register(name: str, query: Callable[[SparkSession, str], DataFrame], sql: str | None = None) -> None:
    QUERIES[name] = query
    if sql is not None:
        ORACLE_SQL[name] = sql


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Change events of every job, counted: scan, windows, exact percentiles, sessions, argmax, renumbering."""
    return QUERIES["event_stats"](spark, sf_dir)


from framewright.plans import phases, records, sequential, speech, visual  # noqa: E402, F401  they register their queries
__all__ = ["F", "ORACLE_SQL", "QUERIES", "flagship", "names", "register", "show"]
