"""Joins over time: as-of with expiry, reconciliation of two books, pairs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

C = F.col


def as_of(left: DataFrame, right: DataFrame, key: str, left_ts: str, right_ts: str, columns: list[str], *, most_age: Column | None = None) -> DataFrame:
    """left with `columns` of the last row of right at or before it (null if there is none, or it is older than the interval most_age).

    Both sides are stacked and the last right row is carried forward: one shuffle and sort by key, no row meets more than one other.
    Of right rows at one time the greatest by `columns` counts.
    """
    value = F.struct(C(right_ts).alias("_at"), *columns)
    r = right.groupBy(key, C(right_ts).alias(left_ts)).agg(F.max(value).alias("_r")).withColumn("_left", F.lit(None).cast(f"struct<{','.join(f'`{c}`:{t}' for c, t in left.dtypes)}>"))
    stacked = left.select(key, left_ts, F.lit(None).cast(dict(r.dtypes)["_r"]).alias("_r"), F.struct(*left.columns).alias("_left")).unionByName(r)
    # at equal times the right row comes first
    w = Window.partitionBy(key).orderBy(left_ts, C("_left").isNotNull()).rowsBetween(Window.unboundedPreceding, 0)
    out = stacked.withColumn("_last", F.last("_r", ignorenulls=True).over(w)).where("_left is not null")
    fresh = F.lit(True) if most_age is None else C(left_ts) <= C("_last._at") + most_age
    return out.select("_left.*", *(F.when(fresh, C(f"_last.{c}")).alias(c) for c in columns))


def reconcile(own: DataFrame, other: DataFrame, near: float = 1e-4) -> DataFrame:
    """symbol, own_qty, other_qty, kind of the positions (symbol, qty) that differ: ghost (only own), missing (only other), mismatch."""
    both = own.select("symbol", C("qty").alias("a")).join(other.select("symbol", C("qty").alias("b")), "symbol", "full")
    a, b = F.coalesce("a", F.lit(0.0)), F.coalesce("b", F.lit(0.0))
    kind = F.when(F.abs(b) <= near, "ghost").when(F.abs(a) <= near, "missing").otherwise("mismatch")
    return both.select("symbol", a.alias("own_qty"), b.alias("other_qty"), kind.alias("kind")).where(F.abs(C("own_qty") - C("other_qty")) > near)


def pairs(wide: DataFrame, value: str) -> DataFrame:
    """a, b, ts, x, y for each pair of symbols a < b at one time."""
    one = wide.select("symbol", "ts", value)
    left, right = one.select(C("symbol").alias("a"), "ts", C(value).alias("x")), one.select(C("symbol").alias("b"), "ts", C(value).alias("y"))
    return left.join(right, "ts").where("a < b")


def pair_statistics(wide: DataFrame, value: str = "close") -> DataFrame:
    """a, b, n, corr, beta, alpha of y on x over the times that both have."""
    p = pairs(wide, value).dropna(subset=["x", "y"])
    return p.groupBy("a", "b").agg(F.count("*").alias("n"), F.corr("x", "y").alias("corr"), F.regr_slope("y", "x").alias("beta"), F.regr_intercept("y", "x").alias("alpha"))
