"""Registers queries with their SQL counterparts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(oracle: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if oracle:
            ORACLES[f.__name__] = oracle
        return f

    return add


def r6(column: str | Column, name: str | None = None) -> Column:
    """Transcendental results agree between engines to six decimals."""
    c = F.col(column) if isinstance(column, str) else column
    return F.round(c, 6).alias(name or (column if isinstance(column, str) else "value"))
