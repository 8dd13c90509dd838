"""Scaling of features: with learned statistics, in trailing windows, across symbols; and the whole way from bars to scaled features."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barloom.functions.windows import last, ordered
from barloom.operators import features

C = F.col
LEAST = 1e-8


def fit(df: DataFrame, columns: list[str], kind: str = "robust") -> DataFrame:
    """symbol and, of each column c, c_centre and c_scale: median and quartile range (else the deviation), mean and deviation (standard), or least and
    range (minmax); a scale below 1e-8 counts as 1, a column without values has 0 and 1."""
    parts: list[Column] = []
    for c in columns:
        x = C(c)
        dev = F.coalesce(F.stddev_samp(x), F.lit(0.0))
        if kind == "robust":
            spread = F.percentile(x, 0.75) - F.percentile(x, 0.25)
            centre, scale = F.percentile(x, 0.5), F.when(spread <= LEAST, dev).otherwise(spread)
        elif kind == "standard":
            centre, scale = F.avg(x), dev
        elif kind == "minmax":
            centre, scale = F.min(x), F.max(x) - F.min(x)
        else:
            raise ValueError(f"no such scaler: {kind}")
        parts += [F.coalesce(centre, F.lit(0.0)).alias(f"{c}_centre"), F.when(scale > LEAST, scale).otherwise(1.0).alias(f"{c}_scale")]
    return df.groupBy("symbol").agg(*parts)


def _clipped(z: Column, kind: str, clip: float | None) -> Column:
    return z if clip is None or kind == "minmax" else F.when(z.isNotNull(), F.greatest(F.lit(-clip), F.least(F.lit(clip), z)))


def transform(df: DataFrame, stats: DataFrame, columns: list[str], kind: str = "robust", clip: float | None = 5.0) -> DataFrame:
    """df with its columns scaled by what `fit` learned, clipped unless kind is minmax. Symbols that stats lacks have nulls."""
    both = df.join(stats, "symbol", "left")
    return both.withColumns({c: _clipped((C(c) - C(f"{c}_centre")) / C(f"{c}_scale"), kind, clip) for c in columns}).select(*df.columns)


def transform_rolling(df: DataFrame, columns: list[str], kind: str = "robust", n: int = 252, clip: float | None = 5.0) -> DataFrame:
    """df with its columns scaled by the last n rows, of which none may be null; a scale of 0 counts as 1."""
    w = last(n)
    out = {}
    for c in columns:
        x = C(c)
        if kind == "robust":
            centre, scale = F.percentile(x, 0.5).over(w), F.percentile(x, 0.75).over(w) - F.percentile(x, 0.25).over(w)
        elif kind == "standard":
            centre, scale = F.avg(x).over(w), F.stddev_samp(x).over(w)
        elif kind == "minmax":
            centre, scale = F.min(x).over(w), F.max(x).over(w) - F.min(x).over(w)
        else:
            raise ValueError(f"no such scaler: {kind}")
        z = (x - centre) / F.when(scale == 0, 1.0).otherwise(scale)
        out[c] = F.when(F.count(x).over(w) == n, _clipped(z, kind, clip))
    return df.withColumns(out)


def transform_across(df: DataFrame, columns: list[str], kind: str = "standard") -> DataFrame:
    """df with its columns scaled at each time over all symbols: standard, or ranks from -1 to 1 (ties share their mean rank). Columns with one value or
    none at a time stay as they are."""
    at = Window.partitionBy("ts")
    out = {}
    for c in columns:
        x = C(c).cast("double")
        n = F.count(x).over(at)
        if kind == "standard":
            dev = F.stddev_samp(x).over(at)
            z = (x - F.avg(x).over(at)) / F.when(dev > LEAST, dev).otherwise(1.0)
        elif kind == "rank":
            some = Window.partitionBy("ts", x.isNull())
            place = F.rank().over(some.orderBy(x)) + (F.count("*").over(Window.partitionBy("ts", x)) - 1) / 2
            z = F.when(x.isNotNull(), (place / n - 0.5) * 2)
        else:
            raise ValueError(f"no such scaler: {kind}")
        out[c] = F.when(n <= 1, x).otherwise(z)
    return df.withColumns(out)


def clean(df: DataFrame, columns: list[str], most_fill: int = 5, drop: bool = True) -> DataFrame:
    """df with nulls of its columns filled from up to most_fill rows before; rows that still have one are dropped."""
    w = ordered().rowsBetween(-most_fill, 0)
    out = df.withColumns({c: F.last(c, ignorenulls=True).over(w) for c in columns}) if most_fill else df
    return out.dropna(subset=columns) if drop else out


def pipeline(bars: DataFrame, columns: list[str], train: Column, kind: str = "robust", most_fill: int = 5, clip: float | None = 5.0) -> DataFrame:
    """symbol, ts and the scaled features of bars: computed, filled, cleaned, and scaled by the rows for which `train` (over symbol, ts) holds."""
    own = clean(features.compute(bars, columns).select("symbol", "ts", *columns), columns, most_fill)
    return transform(own, fit(own.where(train), columns, kind), columns, kind, clip)
