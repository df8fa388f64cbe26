"""Registration of queries with their check SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from gridevents.catalog.views import Views, with_views

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register ``fn(views) -> DataFrame`` under ``name``."""
    def register(fn: Callable[[Views], DataFrame]):
        def run(spark: SparkSession, folder: str) -> DataFrame:
            return fn(Views(spark, folder))
        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = with_views(sql)
        return fn
    return register


def r6(column: str | Column, name: str | None = None) -> Column:
    """Rounded to six places, without negative zero.

    The small shift moves exact halves off the rounding edge, where the last bit
    of a sum would decide.
    """
    col = F.col(column) if isinstance(column, str) else column
    return (F.round(col + F.lit(1e-9), 6) + F.lit(0.0)).alias(name or column)


def s6(expression: str) -> str:
    """The same in SQL."""
    return f"(round({expression} + 1e-9, 6) + 0.0)"
