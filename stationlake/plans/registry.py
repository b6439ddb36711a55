"""Registry of queries: a Spark plan and, where SQL can say the same, its SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(plan):
        QUERIES[name] = plan
        if sql is not None:
            ORACLE_SQL[name] = sql
        return plan

    return register


def tidy(c: Column | str) -> Column:
    """Six decimals; the small amount keeps exact ties off the rounding edge."""
    c = F.col(c) if isinstance(c, str) else c
    return F.round(c.cast("double") + 3e-8, 6)


def t(expression: str) -> str:
    """SQL twin of `tidy`."""
    return f"round(CAST({expression} AS DOUBLE) + 3e-8, 6)"


def big(c: Column | str) -> Column:
    return (F.col(c) if isinstance(c, str) else c).cast("long")


def stamp(c: Column | str) -> Column:
    return F.date_format(c, "yyyy-MM-dd HH:mm:ss")


def sql_stamp(c: str) -> str:
    return f"strftime({c}, '%Y-%m-%d %H:%M:%S')"
