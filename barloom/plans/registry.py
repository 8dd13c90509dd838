"""Registry of queries and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

Query = Callable[[SparkSession, str], DataFrame]
_queries: dict[str, Query] = {}
_sql: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def keep(f: Query) -> Query:
        _queries[name] = f
        if sql:
            _sql[name] = sql
        return f

    return keep


def queries() -> dict[str, Query]:
    return dict(_queries)


def oracle_sql() -> dict[str, str]:
    return dict(_sql)


def rounded(df: DataFrame, digits: int = 6, rough: tuple[str, ...] = ()) -> DataFrame:
    """Doubles to `digits` places (those in rough to 4): sums in another order differ in the last bits."""
    return df.select(*(F.round(c, 4 if c in rough else digits).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes))


