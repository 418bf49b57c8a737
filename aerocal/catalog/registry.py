"""Query functions and the SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

Query = Callable[[SparkSession, str], DataFrame]

_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    """Register a function under its own name, with its SQL when SQL can say it."""

    def register(fn: Query) -> Query:
        _QUERIES[fn.__name__] = fn
        if sql is not None:
            _SQL[fn.__name__] = sql
        return fn

    return register


def queries() -> dict[str, Query]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)


def r(c: Column | str, digits: int = 6) -> Column:
    """Rounded, with negative zero made plain zero."""
    return F.round(c, digits) + F.lit(0.0)


def label(c: Column | str, pattern: str = "yyyy-MM-dd HH:mm:ss") -> Column:
    """A time as text, cut to the pattern's length.

    ``date_format`` would pass a zone-free time through the session's zone first.
    """
    c = F.col(c) if isinstance(c, str) else c
    return F.substring(c.cast("string"), 1, len(pattern))


def rs(expression: str, digits: int = 6) -> str:
    """The SQL form of :func:`r`."""
    return f"round({expression}, {digits}) + 0e0"


def ls(expression: str, pattern: str = "%Y-%m-%d %H:%M:%S") -> str:
    """The SQL form of :func:`label`."""
    return f"strftime({expression}, '{pattern}')"
