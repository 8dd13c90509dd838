"""Queries on bars: the feature families."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from barloom.operators import features
from barloom.plans import bars_sql
from barloom.plans.registry import query, rounded
from barloom.sources.bars import event_bars


def _select(spark: SparkSession, sf_dir: str, names: list[str], rough: tuple[str, ...] = (), more: tuple[str, ...] = ()) -> DataFrame:
    return rounded(features.compute(event_bars(spark, sf_dir), names).select("symbol", "ts", *more, *names), rough=rough)


@query("bar_features", bars_sql.BAR_FEATURES)
def bar_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _select(spark, sf_dir, ["mom_5d", "bb_middle", "zscore_20d", "bb_pct_b"], more=("close", "volume"))


@query("momentum_suite", bars_sql.MOMENTUM)
def momentum_suite(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _select(spark, sf_dir, [f.name for f in features.registered("momentum")])


@query("mean_reversion_suite", bars_sql.REVERSION)
def mean_reversion_suite(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _select(spark, sf_dir, [f.name for f in features.registered("mean_reversion")], rough=("half_life_120",))


@query("volume_suite", bars_sql.VOLUME)
def volume_suite(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _select(spark, sf_dir, [f.name for f in features.registered("volume")], rough=("amihud", "amihud_20"))


@query("microstructure_suite", bars_sql.MICRO)
def microstructure_suite(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _select(spark, sf_dir, [f.name for f in features.registered("microstructure")])


@query("cross_momentum", bars_sql.CROSS)
def cross_momentum(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(features.cross_momentum(event_bars(spark, sf_dir)))


_NEAR = "(PARTITION BY symbol ORDER BY ts ROWS BETWEEN {} PRECEDING AND CURRENT ROW)"


@query(
    "chart_rows",
    f"""WITH {bars_sql.BARS}, n AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY ts DESC) AS nth FROM bars), l AS (SELECT * FROM n WHERE nth <= 90),
m AS (SELECT *, avg(close) OVER {_NEAR.format(19)} AS m, coalesce(stddev_samp(close) OVER {_NEAR.format(19)}, 0) AS d, avg(close) OVER {_NEAR.format(59)} AS s FROM l)
SELECT symbol, ts, round(open, 6) AS open, round(high, 6) AS high, round(low, 6) AS low, round(close, 6) AS close, volume, round(m, 6) AS sma20, round(s, 6) AS sma60, round(m + 2 * d, 6) AS bb_upper, round(m - 2 * d, 6) AS bb_lower FROM m""",
)
def chart_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last 90 bars of each symbol with their means and bands, to six places."""
    return features.chart_rows(event_bars(spark, sf_dir), 90, 6)
