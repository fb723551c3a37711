"""Collects queries and their SQL counterparts by name."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def register(function: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"query {name} is registered twice")
        QUERIES[name] = function
        if sql is not None:
            SQL[name] = sql
        return function

    return register


# Share of the last digit added before rounding: means of cents often lie exactly half-way, where the
# summation order of an engine would decide.
NUDGE = 0.0123


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """All double columns rounded for comparison across engines, without negative zero."""
    doubles = [name for name, kind in df.dtypes if kind == "double"]
    nudge = F.lit(NUDGE * 10.0**-digits)
    return df.withColumns({c: F.round(F.col(c) + nudge, digits) + F.lit(0.0) for c in doubles}) \
        if doubles else df


def r(expression: str, digits: int = 6) -> str:
    """The same rounding in SQL."""
    return f"(round({expression} + {NUDGE * 10.0**-digits!r}, {digits}) + 0.0)"
