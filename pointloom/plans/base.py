"""The table of named queries and helpers that make rows comparable across engines."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query, with its SQL where that can express it."""

    def add(f: Query) -> Query:
        QUERIES[name] = f
        if sql is not None:
            ORACLE_SQL[name] = sql
        return f

    return add


def r6(c: Column | str) -> Column:
    """Six decimals, and no negative zero, for comparison across engines."""
    return F.round(c, 6) + F.lit(0.0)


def rounded(df: DataFrame, *names: str) -> DataFrame:
    return df.withColumns({n: r6(n) for n in names})


def sql_round(*names: str) -> str:
    return ", ".join(f"round({n.split(' AS ')[0]}, 6) + 0.0::DOUBLE AS {n.split(' AS ')[-1].split('.')[-1]}" for n in names)
