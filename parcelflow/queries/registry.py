"""Named queries and their oracle SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}


def query(name: str, oracle: str | None = None) -> Callable[[Query], Query]:
    def keep(fn: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"query {name} registered twice")
        QUERIES[name] = fn
        if oracle is not None:
            ORACLE[name] = oracle
        return fn

    return keep


def R(expr: str, digits: int = 4) -> str:
    """SQL text rounding a double half away from zero on its decimal form, as Spark does."""
    return f"CAST(round(CAST(CAST({expr} AS VARCHAR) AS DECIMAL(38,18)), {digits}) AS DOUBLE)"


def MED(expr: str) -> str:
    """SQL text for the mean of the two middle values (the middle one when odd)."""
    items = f"list_sort(list({expr}))"
    return f"(({items}[(count({expr}) + 1) // 2] + {items}[count({expr}) // 2 + 1]) / 2)"
