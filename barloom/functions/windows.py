"""Column helpers over bars: ordered windows, full frames and divisions that give null."""

from __future__ import annotations

from pyspark.sql import Column, Window, WindowSpec
from pyspark.sql import functions as F

KEY, ORDER = "symbol", "ts"


def ordered(key: str = KEY, order: str = ORDER) -> WindowSpec:
    return Window.partitionBy(key).orderBy(order)


def last(n: int, key: str = KEY, order: str = ORDER) -> WindowSpec:
    """The row and the n - 1 before it."""
    return ordered(key, order).rowsBetween(-(n - 1), 0)


def so_far(key: str = KEY, order: str = ORDER) -> WindowSpec:
    return ordered(key, order).rowsBetween(Window.unboundedPreceding, 0)


def full(agg: Column, x: Column, n: int, least: int | None = None) -> Column:
    """agg over the last n rows; null unless x has `least` values there (n if not given)."""
    return F.when(F.count(x).over(last(n)) >= (least or n), agg.over(last(n)))


def lag(x: Column, n: int = 1) -> Column:
    return F.lag(x, n).over(ordered())


def div(a: Column, b: Column) -> Column:
    """a / b, null where b is 0."""
    return F.try_divide(a, b)


def change(x: Column, n: int) -> Column:
    """x relative to n rows before, less one."""
    return div(x, lag(x, n)) - 1

