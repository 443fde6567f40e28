"""Registry of queries with the SQL that checks them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None, name: str | None = None) -> Callable[[Query], Query]:
    """Register a query under its function name, with its oracle if it has one."""
    def register(f: Query) -> Query:
        key = name or f.__name__
        QUERIES[key] = f
        if sql is not None:
            ORACLES[key] = sql.strip()
        return f
    return register


def rounded(column: Column | str, digits: int = 6) -> Column:
    """Double rounded for comparison, without negative zero."""
    c = F.col(column) if isinstance(column, str) else column
    return F.round(c.cast("double"), digits) + F.lit(0.0)


def stamp(column: str) -> Column:
    """Timestamp as microseconds since 1970."""
    return F.unix_micros(F.col(column).cast("timestamp"))


def load() -> None:
    """Import the modules that register queries."""
    from . import queries_explain, queries_log, queries_model, queries_profile, queries_trained  # noqa: F401
