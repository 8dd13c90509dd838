"""Queries on the evaluation of models over time, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barloom.operators import features, metrics, models
from barloom.plans.analytics import RET
from barloom.plans.bars_sql import BARS, W, full, lag
from barloom.plans.registry import query, rounded
from barloom.sources.bars import event_bars

_XY = f"""{BARS}, f AS (SELECT symbol, ts, close / nullif({lag('close', 5)}, 0) - 1 AS mom, lead(close) OVER {W} AS nxt, close, {full('avg(close)', 'close', 20)} AS m, {full('stddev_samp(close)', 'close', 20)} AS d FROM bars),
xy AS (SELECT symbol, ts, mom, CASE WHEN nxt > close THEN 1 ELSE 0 END AS y, CASE WHEN d = 0 AND close = m THEN 0 ELSE (close - m) / nullif(d, 0) END AS z FROM f WHERE mom IS NOT NULL AND nxt IS NOT NULL AND m IS NOT NULL),
s AS (SELECT *, 1 / (1 + exp(z)) AS p, 0.5 AS q FROM xy)"""


def _labelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """symbol, ts, mom_5d, zscore_20d, the direction y of the next bar, and a score p that expects reversion."""
    b = features.compute(event_bars(spark, sf_dir), ["mom_5d", "zscore_20d"])
    y = features.target(F.col("close"))
    out = b.select("symbol", "ts", "mom_5d", "zscore_20d", F.when(y.isNotNull(), (y > 0).cast("int")).alias("y"))
    return out.dropna().withColumns({"p": 1 / (1 + F.exp("zscore_20d")), "q": F.lit(0.5)})


@query(
    "reversion_scores",
    f"""WITH {_XY}, r AS (SELECT *, rank() OVER (PARTITION BY symbol ORDER BY p) + (count(*) OVER (PARTITION BY symbol, p) - 1) / 2.0 AS rk FROM s),
c AS (SELECT symbol, count_if(y = 1 AND p >= 0.5) AS tp, count_if(y = 0 AND p >= 0.5) AS fp, count_if(y = 1 AND p < 0.5) AS fn, count_if(y = 0 AND p < 0.5) AS tn, avg((p - y) ^ 2) AS brier, sum(rk * y) AS rs, sum(y) AS np, count(*) AS n FROM r GROUP BY symbol)
SELECT symbol, round((tp + tn) / n, 6) AS accuracy, round((coalesce(tp / nullif(tp + fn, 0), 0) + coalesce(tn / nullif(tn + fp, 0), 0)) / 2, 6) AS balanced, round(coalesce(tp / nullif(tp + fp, 0), 0), 6) AS precision,
  round(coalesce(tp / nullif(tp + fn, 0), 0), 6) AS recall, round(2 * tp / (2 * tp + fp + fn), 6) AS f1, round(brier, 6) AS brier, round((rs - np * (np + 1) / 2) / (np * (n - np)), 6) AS auc FROM c""",
)
def reversion_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(models.classification(_labelled(spark, sf_dir), ["symbol"]))


@query(
    "forecast_comparison",
    f"""WITH {_XY}, d AS (SELECT symbol, ts, (p - y) ^ 2 - (q - y) ^ 2 AS d FROM s), e AS (SELECT *, d - avg(d) OVER (PARTITION BY symbol) AS e FROM d), g AS (SELECT *, lag(e) OVER {W} AS e1 FROM e),
v AS (SELECT symbol, count(*) AS n, avg(d) AS m, sum(e * e) / count(*) AS g0, sum(e * e1) / count(*) AS g1 FROM g GROUP BY symbol)
SELECT symbol, n, round(m, 6) AS mean, round(sqrt((n + 1 - 4 + 2.0 / n) / n) * m / sqrt(greatest(g0 + g1, 0) / n), 4) AS statistic FROM v""",
)
def forecast_comparison(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(models.diebold_mariano(_labelled(spark, sf_dir), lags=1), rough=("statistic",))


def _loss_sql(name: str, form: str) -> str:
    return f"SELECT '{name}' AS loss, symbol, ts, {form.format(p='p')} - {form.format(p='q')} AS d FROM s"


_CLIP = "least(greatest({p}, 1e-7), 1 - 1e-7)"
_LOSSES = " UNION ALL ".join((_loss_sql("brier", "({p} - y) ^ 2"), _loss_sql("logloss", f"-(y * ln({_CLIP}) + (1 - y) * ln(1 - {_CLIP}))"), _loss_sql("directional", "CASE WHEN CAST({p} >= 0.5 AS INTEGER) = y THEN 0 ELSE 1 END")))


@query(
    "forecast_losses",
    f"""WITH {_XY}, d AS ({_LOSSES}), v AS (SELECT loss, symbol, count(*) AS n, avg(d) AS m, var_pop(d) AS g FROM d GROUP BY 1, 2)
SELECT loss, symbol, n, round(m, 6) AS mean, round(sqrt((n - 1.0) / n) * m / sqrt(g / n), 4) AS statistic FROM v""",
)
def forecast_losses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The comparison of two forecasts by three losses."""
    rows = _labelled(spark, sf_dir)
    out = None
    for loss in ("brier", "logloss", "directional"):
        one = models.diebold_mariano(rows, loss=loss).select(F.lit(loss).alias("loss"), "*")
        out = one if out is None else out.unionByName(one)
    return rounded(out, rough=("statistic",))


@query(
    "volatility_halves",
    f"""WITH {RET}, v AS (SELECT *, {full('stddev_samp(ret)', 'ret', 21)} * sqrt(252) * 100 AS v FROM ret), q AS (SELECT symbol, quantile_cont(v, 0.5) AS q FROM v GROUP BY symbol)
SELECT symbol, ts, round(v, 4) AS volatility, v > q AS wild FROM v JOIN q USING (symbol) WHERE v IS NOT NULL""",
)
def volatility_halves(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(metrics.median_regime(metrics.returns(event_bars(spark, sf_dir))).where("volatility is not null").select("symbol", "ts", "volatility", "wild"), 4)


def _folds_sql(rows: str, rolling: bool) -> str:
    """Common table expressions over rows(symbol, ts, ..): parts(.., fold, part), 100 rows or more of training, an embargo of 5."""
    start = "lo - 105" if rolling else "0"
    return f"""nth AS (SELECT *, row_number() OVER {W} - 1 AS nth, count(*) OVER (PARTITION BY symbol) AS total FROM {rows}),
lo AS (SELECT nth.*, fold, greatest(1, (total - 125) // 5) AS size, greatest(total - 5 * greatest(1, (total - 125) // 5), 105) + (fold - 1) * greatest(1, (total - 125) // 5) AS lo FROM nth, (SELECT unnest(range(1, 6)) AS fold) WHERE total > 125),
parts AS (SELECT * EXCLUDE (fold), CAST(fold AS INTEGER) AS fold, CASE WHEN nth < lo THEN 'train' ELSE 'test' END AS part FROM lo WHERE (nth >= {start} AND nth < lo - 5) OR (nth >= lo AND nth < lo + size))"""


def _sizes(spark: SparkSession, sf_dir: str, rolling: bool) -> DataFrame:
    ret = metrics.returns(event_bars(spark, sf_dir))
    return rounded(models.with_folds(ret, models.symbol_folds(ret, rolling=rolling)).groupBy("symbol", "fold", "part").agg(F.count("*").alias("n"), F.avg("ret").alias("mean")))


@query("fold_sizes", f"WITH {RET}, {_folds_sql('ret', False)} SELECT symbol, fold, part, count(*) AS n, round(avg(ret), 6) AS mean FROM parts GROUP BY 1, 2, 3")
def fold_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows and mean return of the parts of five expanding folds over all rows of each symbol."""
    return _sizes(spark, sf_dir, rolling=False)


@query("fold_sizes_rolling", f"WITH {RET}, {_folds_sql('ret', True)} SELECT symbol, fold, part, count(*) AS n, round(avg(ret), 6) AS mean FROM parts GROUP BY 1, 2, 3")
def fold_sizes_rolling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As fold_sizes, with the 100 rows before each embargo as training rows."""
    return _sizes(spark, sf_dir, rolling=True)


@query(
    "persistence_scores",
    f"""WITH {_XY}, {_folds_sql('xy', False)}, l AS (SELECT *, lag(y) OVER (PARTITION BY symbol, fold ORDER BY ts) AS p FROM parts)
SELECT symbol, fold, count(*) AS n, round(avg(CASE WHEN p = y THEN 1 ELSE 0 END), 6) AS accuracy FROM l WHERE part = 'test' GROUP BY 1, 2""",
)
def persistence_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often the label of the row before is right, by fold."""
    rows = _labelled(spark, sf_dir)
    own = models.persistence(models.with_folds(rows.drop("p"), models.symbol_folds(rows)))
    return rounded(own.groupBy("symbol", "fold").agg(F.count("*").alias("n"), F.avg((F.col("p") == F.col("y")).cast("double")).alias("accuracy")))


@query(
    "rank_correlation",
    f"""WITH {_XY}, r AS (SELECT symbol, rank() OVER (PARTITION BY symbol ORDER BY mom) + (count(*) OVER (PARTITION BY symbol, mom) - 1) / 2.0 AS x, rank() OVER (PARTITION BY symbol ORDER BY z) + (count(*) OVER (PARTITION BY symbol, z) - 1) / 2.0 AS w FROM xy)
SELECT symbol, round(corr(x, w), 6) AS rho FROM r GROUP BY symbol""",
)
def rank_correlation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(models.spearman(_labelled(spark, sf_dir), "mom_5d", "zscore_20d"))


@query("bootstrap_fan")
def bootstrap_fan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return models.fan(models.bootstrap(metrics.returns(event_bars(spark, sf_dir))))


@query("walk_forward_gbt")
def walk_forward_gbt(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Out-of-fold probabilities of gradient-boosted trees on two features, two folds over all rows of each symbol."""
    rows = _labelled(spark, sf_dir)
    return models.walk_forward(rows, ["mom_5d", "zscore_20d"], "y", models.symbol_folds(rows, folds=2))


@query("sequence_windows")
def sequence_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Windows of 20 bars at every bar, with the next bar's return as target (null at the end)."""
    b = event_bars(spark, sf_dir).withColumn("next", features.target(F.col("close")))
    return models.sequences(b, ["close", "volume"], 20, target="next")
