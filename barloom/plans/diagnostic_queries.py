"""Queries on diagnostics, scaling, production features and trading books, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barloom.operators import diagnostics, joins, metrics, portfolio, production, scaling
from barloom.operators import models as models_
from barloom.plans.analytics import _ACF, _PAIR_Z, RET
from barloom.plans.bars_sql import BARS, W, full, lag
from barloom.plans.model_queries import _XY, _labelled
from barloom.plans.registry import oracle_sql, query, rounded
from barloom.sources.bars import event_bars


def _two_sided(z: str) -> str:
    t = f"(1 / (1 + 0.3275911 * abs({z}) / sqrt(2)))"
    return f"((((1.061405429 * {t} - 1.453152027) * {t} + 1.421413741) * {t} - 0.284496736) * {t} + 0.254829592) * {t} * exp(-({z}) * ({z}) / 2)"


def _above(x: str, freedom: int) -> str:
    terms = " + ".join(["1"] + [f"({x} / 2) ^ {k} / factorial({k})" for k in range(1, freedom // 2)])
    return f"exp(-{x} / 2) * ({terms})"


def _returns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.returns(event_bars(spark, sf_dir))


@query("volatility_proxies", f"WITH {RET} SELECT symbol, ts, round(ret, 6) AS ret, round(ret * ret, 6) AS squared, round(abs(ret), 6) AS absolute FROM ret")
def volatility_proxies(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(diagnostics.proxies(_returns(spark, sf_dir)))


@query("second_differences", f"WITH {BARS}, d AS (SELECT symbol, ts, close - {lag('close')} AS d FROM bars), e AS (SELECT symbol, ts, d - {lag('d')} AS close FROM d) SELECT symbol, ts, round(close, 6) AS close FROM e WHERE close IS NOT NULL")
def second_differences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(diagnostics.differences(event_bars(spark, sf_dir).select("symbol", "ts", "close"), "close", 2))


@query(
    "correlogram",
    f"""WITH {_ACF}, c AS (SELECT *, coalesce(sum(acf * acf) OVER (PARTITION BY symbol ORDER BY lag ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS b FROM acf)
SELECT symbol, n, CAST(lag AS INTEGER) AS lag, round(acf, 6) AS acf, round(1.959963984540054 * sqrt((1 + 2 * b) / n), 6) AS half FROM c""",
)
def correlogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(diagnostics.correlogram(_returns(spark, sf_dir)).drop("pacf", "pacf_half"))


@query(
    "partial_autocorrelation",
    f"""WITH RECURSIVE {_ACF}, c AS (SELECT symbol, any_value(n) AS n, list_prepend(1.0, list(acf * n / (n - lag) ORDER BY lag)) AS c FROM acf GROUP BY symbol),
p AS (SELECT symbol, n, c, 1 AS lag, [c[2]] AS phi FROM c
  UNION ALL SELECT symbol, n, c, lag + 1, list_append(list_transform(phi, lambda x, j: x - last * phi[lag + 1 - j]), last)
  FROM (SELECT *, (c[lag + 2] - list_sum(list_transform(phi, lambda x, j: x * c[lag + 2 - j]))) / (1 - list_sum(list_transform(phi, lambda x, j: x * c[j + 1]))) AS last FROM p WHERE lag < 10))
SELECT symbol, CAST(lag AS INTEGER) AS lag, round(phi[lag], 6) AS pacf, round(1.959963984540054 / sqrt(n), 6) AS pacf_half FROM p""",
)
def partial_autocorrelation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(diagnostics.correlogram(_returns(spark, sf_dir)).select("symbol", "lag", "pacf", "pacf_half"))


@query("portmanteau", f"WITH {_ACF}, q AS (SELECT symbol, sum(n * (n + 2) * acf * acf / (n - lag)) AS q FROM acf GROUP BY symbol) SELECT symbol, round(q, 4) AS q, round({_above('q', 10)}, 4) AS p_value, {_above('q', 10)} < 0.05 AS dependent FROM q")
def portmanteau(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(diagnostics.portmanteau(diagnostics.correlogram(_returns(spark, sf_dir)), 10), 4)


def _dependence_sql(name: str, x: str) -> str:
    return f"""m_{name} AS (SELECT symbol, ts, {x} - avg({x}) OVER (PARTITION BY symbol) AS d, row_number() OVER {W} AS i FROM ret), v_{name} AS (SELECT symbol, sum(d * d) AS v, count(*) AS n FROM m_{name} GROUP BY symbol),
a_{name} AS (SELECT a.symbol, v.n, l.lag, sum(a.d * b.d) / any_value(v.v) AS acf FROM m_{name} a JOIN l ON true JOIN m_{name} b ON a.symbol = b.symbol AND a.i = b.i + l.lag JOIN v_{name} v ON v.symbol = a.symbol GROUP BY 1, 2, 3),
q_{name} AS (SELECT '{name}' AS series, symbol, n, sum(n * (n + 2) * acf * acf / (n - lag)) FILTER (lag <= 10) AS q10, sum(n * (n + 2) * acf * acf / (n - lag)) AS q20 FROM a_{name} GROUP BY symbol, n)"""


_DEPENDENT = " UNION ALL ".join(f"SELECT series, symbol, {_above('q10', 10)} < 0.05 OR {_above('q20', 20)} < 0.05 AS any_lag, {_above('q10', 10)} < 0.05 AND {_above('q20', 20)} < 0.05 AS all_lags FROM q_{n} WHERE n >= 20" for n in ("raw", "squared"))


@query("dependence", f"WITH {RET}, l AS (SELECT unnest(range(1, 21)) AS lag), {_dependence_sql('raw', 'ret')}, {_dependence_sql('squared', 'ret * ret')} {_DEPENDENT}")
def dependence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether any, or each, of the tests over 10 and 20 lags finds returns (raw) or their squares (squared) dependent."""
    ret = _returns(spark, sf_dir)
    each = [diagnostics.dependence(diagnostics.correlogram(diagnostics.proxies(ret), c, 20)).select(F.lit(n).alias("series"), "symbol", "any_lag", "all_lags") for n, c in (("raw", "ret"), ("squared", "squared"))]
    return each[0].unionByName(each[1])


def _ratio_sql(k: int) -> str:
    theta = " + ".join(f"({2 * (k - j) / k!r}) ^ 2 * d{j}" for j in range(1, k))
    return f"SELECT symbol, {k} AS k, n, v{k} / ({k} * (n - {k} + 1) * (1 - {k} / n)) / (s / (n - 1)) AS ratio, sqrt(2.0 * {(2 * k - 1) * (k - 1)} / (3.0 * {k} * n)) AS plain, sqrt(({theta}) / (s * s)) AS robust FROM g WHERE n >= 30 AND {k} < n // 2"


_LAGS = ", ".join(f"lag(s, {j}) OVER {W} AS s{j}" for j in range(1, 20))
_MOVES = ", ".join(f"p - lag(p, {k}) OVER {W} - {k} * mu AS m{k}" for k in (2, 5, 10, 20))


@query(
    "variance_ratios",
    f"""WITH {BARS}, p AS (SELECT symbol, ts, ln(close) AS p FROM bars), r AS (SELECT *, p - {lag('p')} AS r FROM p), m AS (SELECT *, avg(r) OVER (PARTITION BY symbol) AS mu FROM r), q AS (SELECT *, (r - mu) ^ 2 AS s FROM m),
l AS (SELECT symbol, r, s, {_LAGS}, {_MOVES} FROM q),
g AS (SELECT symbol, count(r) AS n, sum(s) AS s, {', '.join(f'sum(s * s{j}) AS d{j}' for j in range(1, 20))}, {', '.join(f'sum(m{k} * m{k}) AS v{k}' for k in (2, 5, 10, 20))} FROM l GROUP BY symbol),
u AS ({' UNION ALL '.join(map(_ratio_sql, (2, 5, 10, 20)))}), z AS (SELECT *, (ratio - 1) / robust AS zr FROM u)
SELECT symbol, CAST(k AS INTEGER) AS k, round(ratio, 4) AS ratio, round((ratio - 1) / plain, 4) AS z, round(zr, 4) AS z_robust, round({_two_sided('zr')}, 4) AS p_value, CASE WHEN zr < -1.96 THEN 'mean-reversion' WHEN zr > 1.96 THEN 'momentum' ELSE 'random-walk' END AS verdict FROM z""",
)
def variance_ratios(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(diagnostics.variance_ratios(event_bars(spark, sf_dir)), 4)


@query(
    "streaks",
    f"""WITH {RET}, s AS (SELECT symbol, ts, ret > 0 AS up FROM ret WHERE ret <> 0), n AS (SELECT *, CASE WHEN up = lag(up) OVER {W} THEN 0 ELSE 1 END AS new FROM s), g AS (SELECT *, sum(new) OVER {W} AS run FROM n),
c AS (SELECT symbol, run, up, count(*) AS m FROM g GROUP BY 1, 2, 3), a AS (SELECT symbol, CAST(sum(m) FILTER (up) AS DOUBLE) AS u, CAST(sum(m) FILTER (NOT up) AS DOUBLE) AS d, count(*) AS runs, avg(m) FILTER (up) AS mean_up, max(m) FILTER (up) AS longest_up, avg(m) FILTER (NOT up) AS mean_down, max(m) FILTER (NOT up) AS longest_down FROM c GROUP BY symbol),
z AS (SELECT *, 1 + 2 * u * d / (u + d) AS e, sqrt(2 * u * d * (2 * u * d - u - d) / ((u + d) ^ 2 * (u + d - 1))) AS se FROM a), y AS (SELECT *, (runs - e) / se AS z FROM z)
SELECT symbol, CAST(u AS BIGINT) AS n_up, CAST(d AS BIGINT) AS n_down, runs, round(mean_up, 4) AS mean_up, longest_up, round(mean_down, 4) AS mean_down, longest_down, round(e, 4) AS expected, round(z, 4) AS z, round({_two_sided('z')}, 4) AS p_value, CASE WHEN z < -1.96 THEN 'longer than random' WHEN z > 1.96 THEN 'shorter than random' ELSE 'random' END AS verdict FROM y""",
)
def streaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(diagnostics.streaks(_returns(spark, sf_dir)), 4)


@query("arch_effects")
def arch_effects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether volatility clusters: Ljung-Box on squared returns, and the regression of squared deviations on those before."""
    return rounded(diagnostics.clustering(_returns(spark, sf_dir)), 4)


@query(
    "dickey_fuller",
    f"""WITH {BARS}, d AS (SELECT symbol, {lag('close')} AS x, close - {lag('close')} AS d FROM bars), e AS (SELECT * FROM d WHERE d IS NOT NULL),
f AS (SELECT symbol, count(*) AS n, regr_slope(d, x) AS b, (regr_syy(d, x) - regr_slope(d, x) * regr_sxy(d, x)) / (count(*) - 2) AS s2, regr_sxx(d, x) AS sxx FROM e GROUP BY symbol)
SELECT symbol, n, round(b / sqrt(s2 / sxx), 4) AS statistic, round(-3.43035 - 6.5393 / n - 16.786 / n ^ 2 - 79.433 / n ^ 3, 4) AS crit_1, round(-2.86154 - 2.8903 / n - 4.234 / n ^ 2 - 40.04 / n ^ 3, 4) AS crit_5, round(-2.56677 - 1.5384 / n - 2.809 / n ^ 2, 4) AS crit_10,
  b / sqrt(s2 / sxx) < -2.86154 - 2.8903 / n - 4.234 / n ^ 2 - 40.04 / n ^ 3 AS stationary FROM f""",
)
def dickey_fuller(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(diagnostics.dickey_fuller(event_bars(spark, sf_dir)), 4)


@query(
    "kpss",
    f"""WITH {BARS}, e AS (SELECT symbol, ts, close - avg(close) OVER (PARTITION BY symbol) AS e FROM bars), l AS (SELECT *, sum(e) OVER {W} AS s, {', '.join(f'lag(e, {k}) OVER {W} AS e{k}' for k in range(1, 5))} FROM e),
g AS (SELECT symbol, count(*) AS n, sum(s * s) / count(*) ^ 2 / ((sum(e * e) + {' + '.join(f'{2 * (1 - k / 5)!r} * sum(e * e{k})' for k in range(1, 5))}) / count(*)) AS x FROM l GROUP BY symbol),
p AS (SELECT *, CASE WHEN x <= 0.347 THEN 0.1 WHEN x <= 0.463 THEN 0.1 - (x - 0.347) / 0.116 * 0.05 WHEN x <= 0.574 THEN 0.05 - (x - 0.463) / 0.111 * 0.025 WHEN x <= 0.739 THEN 0.025 - (x - 0.574) / 0.165 * 0.015 ELSE 0.01 END AS p FROM g)
SELECT symbol, n, round(x, 4) AS statistic, round(CAST(p AS DOUBLE), 4) AS p_value, p >= 0.05 AS stationary FROM p""",
)
def kpss(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(diagnostics.kpss(event_bars(spark, sf_dir)), 4)


_BOTH_ROOTS = f"SELECT symbol, a.stationary AS adf, k.stationary AS kpss, CASE WHEN a.stationary AND k.stationary THEN 'stationary' WHEN NOT a.stationary AND NOT k.stationary THEN 'non-stationary' WHEN a.stationary THEN 'difference-stationary' ELSE 'trend-stationary' END AS verdict FROM ({oracle_sql()['dickey_fuller']}) a JOIN ({oracle_sql()['kpss']}) k USING (symbol)"


@query("stationarity", _BOTH_ROOTS)
def stationarity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return diagnostics.stationarity(event_bars(spark, sf_dir))


@query(
    "horizons",
    f"""WITH {BARS}, n AS (SELECT symbol, ts, close, row_number() OVER {W} - 1 AS nth FROM bars), h AS (SELECT unnest([1, 5, 20]) AS horizon), e AS (SELECT n.*, horizon FROM n, h WHERE nth % horizon = 0),
r AS (SELECT symbol, horizon, ln(close / lag(close) OVER (PARTITION BY symbol, horizon ORDER BY ts)) AS r FROM e) SELECT symbol, horizon, count(r) AS n, round(avg(r), 6) AS mean, round(stddev_samp(r), 6) AS dev FROM r GROUP BY 1, 2""",
)
def horizons(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean and deviation of log returns over 1, 5 and 20 bars that don't overlap."""
    own = diagnostics.horizon_returns(event_bars(spark, sf_dir))
    return rounded(own.groupBy("symbol", "horizon").agg(F.count("ret").alias("n"), F.avg("ret").alias("mean"), F.stddev_samp("ret").alias("dev")))


@query(
    "histogram",
    f"""WITH {RET}, s AS (SELECT symbol, count(*) AS total, min(ret) AS lo, max(ret) AS hi, avg(ret) AS mean, stddev_samp(ret) AS dev, least(100, greatest(30, count(*) // 25)) AS bins FROM ret GROUP BY symbol),
b AS (SELECT s.*, (hi - lo) / bins AS width, least(bins - 1, CAST(floor((ret - lo) / ((hi - lo) / bins)) AS BIGINT)) AS bin FROM ret JOIN s USING (symbol)),
g AS (SELECT symbol, bin, any_value(lo) AS lo, any_value(width) AS width, any_value(total) AS total, any_value(mean) AS mean, any_value(dev) AS dev, count(*) AS n FROM b GROUP BY 1, 2)
SELECT symbol, CAST(bin AS INTEGER) AS bin, round(lo + bin * width, 4) AS low, n, round(n / (total * width), 4) AS density, round(exp(-0.5 * ((lo + bin * width + width / 2 - mean) / dev) * ((lo + bin * width + width / 2 - mean) / dev)) / (dev * sqrt(2 * pi())), 4) AS normal FROM g""",
)
def histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(diagnostics.histogram(_returns(spark, sf_dir)), 4)


@query(
    "half_lives",
    f"""WITH {BARS}, d AS (SELECT symbol, {lag('close')} AS x, close - {lag('close')} AS d FROM bars), b AS (SELECT symbol, regr_slope(d, x) AS b FROM d WHERE d IS NOT NULL GROUP BY symbol)
SELECT symbol, round(CASE WHEN b < 0 AND 1 + b > 0 THEN ln(2) / -ln(1 + b) ELSE CAST('inf' AS DOUBLE) END, 6) AS half_life FROM b""",
)
def half_lives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(diagnostics.half_life(event_bars(spark, sf_dir), ["symbol"], "close"))


_SCALED = ("close", "volume")


@query(
    "scaled_features",
    f"""WITH {BARS}, t AS (SELECT * FROM bars WHERE ts < TIMESTAMP '2024-01-15'), s AS (SELECT symbol, {', '.join(f'quantile_cont({c}, 0.5) AS {c}_m, quantile_cont({c}, 0.75) - quantile_cont({c}, 0.25) AS {c}_q, stddev_samp({c}) AS {c}_d' for c in _SCALED)} FROM t GROUP BY symbol)
SELECT symbol, ts, {', '.join(f'round(greatest(-5, least(5, ({c} - {c}_m) / CASE WHEN {c}_q > 1e-8 THEN {c}_q WHEN {c}_d > 1e-8 THEN {c}_d ELSE 1 END)), 6) AS {c}' for c in _SCALED)} FROM bars JOIN s USING (symbol)""",
)
def scaled_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Close and volume scaled by what the bars of the first two weeks tell."""
    b = event_bars(spark, sf_dir).select("symbol", "ts", *_SCALED)
    return rounded(scaling.transform(b, scaling.fit(b.where("ts < TIMESTAMP_NTZ'2024-01-15'"), list(_SCALED)), list(_SCALED)))


@query(
    "rolling_scaled",
    f"""WITH {BARS} SELECT symbol, ts, round(greatest(-5, least(5, (close - {full('avg(close)', 'close', 50)}) / CASE WHEN {full('stddev_samp(close)', 'close', 50)} = 0 THEN 1 ELSE {full('stddev_samp(close)', 'close', 50)} END)), 6) AS close,
  CASE WHEN count(volume) OVER (PARTITION BY symbol ORDER BY ts ROWS 49 PRECEDING) = 50 THEN round(greatest(-5, least(5, (volume - {full('avg(volume)', 'volume', 50)}) / CASE WHEN {full('stddev_samp(volume)', 'volume', 50)} = 0 THEN 1 ELSE {full('stddev_samp(volume)', 'volume', 50)} END)), 6) END AS volume FROM bars""".replace("SELECT symbol, ts, round(", "SELECT symbol, ts, CASE WHEN count(close) OVER (PARTITION BY symbol ORDER BY ts ROWS 49 PRECEDING) = 50 THEN round(").replace(", 6) AS close", ", 6) END AS close"),
)
def rolling_scaled(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = event_bars(spark, sf_dir).select("symbol", "ts", *_SCALED)
    return rounded(scaling.transform_rolling(b, list(_SCALED), "standard", 50))


@query(
    "scaled_across",
    f"""WITH {BARS}, n AS (SELECT *, count(*) OVER (PARTITION BY ts) AS n, avg(close) OVER (PARTITION BY ts) AS m, stddev_samp(close) OVER (PARTITION BY ts) AS d, rank() OVER (PARTITION BY ts ORDER BY volume) + (count(*) OVER (PARTITION BY ts, volume) - 1) / 2.0 AS r FROM bars)
SELECT symbol, ts, round(CASE WHEN n <= 1 THEN close ELSE (close - m) / CASE WHEN d > 1e-8 THEN d ELSE 1 END END, 6) AS close, round(CASE WHEN n <= 1 THEN volume ELSE (r / n - 0.5) * 2 END, 6) AS volume FROM n""",
)
def scaled_across(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Closes as z-scores and volumes as ranks over all symbols of a time."""
    b = event_bars(spark, sf_dir).select("symbol", "ts", *_SCALED)
    return rounded(scaling.transform_across(scaling.transform_across(b, ["close"]), ["volume"], "rank"))


@query(
    "feature_pipeline",
    f"""WITH {BARS}, a AS (SELECT symbol, ts, close / nullif({lag('close', 5)}, 0) - 1 AS mom, {full('avg(close)', 'close', 20)} AS m, {full('stddev_samp(close)', 'close', 20)} AS d, close FROM bars),
z AS (SELECT symbol, ts, mom AS mom_5d, CASE WHEN d = 0 AND close = m THEN 0 ELSE (close - m) / nullif(d, 0) END AS zscore_20d FROM a), c AS (SELECT * FROM z WHERE mom_5d IS NOT NULL AND zscore_20d IS NOT NULL),
s AS (SELECT symbol, {', '.join(f'quantile_cont({c}, 0.5) AS {c}_m, quantile_cont({c}, 0.75) - quantile_cont({c}, 0.25) AS {c}_q' for c in ('mom_5d', 'zscore_20d'))} FROM c WHERE ts < TIMESTAMP '2024-01-15' GROUP BY symbol)
SELECT symbol, ts, {', '.join(f'round(greatest(-5, least(5, ({c} - {c}_m) / {c}_q)), 6) AS {c}' for c in ('mom_5d', 'zscore_20d'))} FROM c JOIN s USING (symbol)""",
)
def feature_pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """From bars to scaled features; the scalers see the first two weeks."""
    return rounded(scaling.pipeline(event_bars(spark, sf_dir), ["mom_5d", "zscore_20d"], F.expr("ts < TIMESTAMP_NTZ'2024-01-15'")))


@query(
    "production_features",
    f"""WITH RECURSIVE {BARS}, b AS (SELECT *, row_number() OVER {W} AS i, {lag('close')} AS before FROM bars),
e AS (SELECT symbol, i, ts, close AS e12, close AS e26, CAST(0 AS DOUBLE) AS sig FROM b WHERE i = 1 UNION ALL SELECT b.symbol, b.i, b.ts, e.e12 * (1 - 2 / 13.0) + b.close * 2 / 13.0, e.e26 * (1 - 2 / 27.0) + b.close * 2 / 27.0,
  e.sig * 0.8 + 0.2 * (e.e12 * (1 - 2 / 13.0) + b.close * 2 / 13.0 - e.e26 * (1 - 2 / 27.0) - b.close * 2 / 27.0) FROM e JOIN b ON b.symbol = e.symbol AND b.i = e.i + 1),
c AS (SELECT b.*, e12 - e26 AS macd_line, sig AS macd_signal, lead(close) OVER (PARTITION BY b.symbol ORDER BY b.ts) AS nxt, close / nullif(before, 0) - 1 AS ret_1d, close / nullif(lag(close, 5) OVER (PARTITION BY b.symbol ORDER BY b.ts), 0) - 1 AS ret_5d, close / nullif(lag(close, 20) OVER (PARTITION BY b.symbol ORDER BY b.ts), 0) - 1 AS ret_20d,
  CASE WHEN before IS NOT NULL THEN greatest(close - before, 0) END AS up, CASE WHEN before IS NOT NULL THEN greatest(before - close, 0) END AS down, greatest(high - low, abs(high - before), abs(low - before)) AS tr FROM b JOIN e ON b.symbol = e.symbol AND b.i = e.i),
d AS (SELECT *, {full('stddev_samp(ret_1d)', 'ret_1d', 20)} AS vol_20d, {full('avg(up)', 'up', 14)} / ({full('avg(down)', 'down', 14)} + 1e-9) AS rs, 100 * {full('avg(tr)', 'tr', 14)} / close AS natr_14, volume / ({full('avg(volume)', 'volume', 20)} + 1e-9) AS volume_ratio_20 FROM c)
SELECT symbol, ts, {', '.join(f'round({c}, 6) AS {c}' for c in ('close', 'ret_1d', 'ret_5d', 'ret_20d', 'vol_20d'))}, round(100 - 100 / (1 + rs), 6) AS rsi_14, {', '.join(f'round({c}, 6) AS {c}' for c in ('macd_line', 'macd_signal', 'natr_14', 'volume_ratio_20'))}, CAST(0 AS DOUBLE) AS news_headline_volume, CAST(0 AS DOUBLE) AS news_sentiment_volatility, CASE WHEN nxt > close THEN 1 ELSE 0 END AS y
FROM d WHERE nxt IS NOT NULL AND ret_20d IS NOT NULL AND vol_20d IS NOT NULL""",
)
def production_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(production.dataset(event_bars(spark, sf_dir)))


@query("production_scores")
def production_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """From bars to scored folds: features, walk-forward training, and what trading on the probabilities gives."""
    return rounded(production.evaluate(production.dataset(event_bars(spark, sf_dir))))


@query(
    "rolling_kelly",
    f"""WITH {_XY}, r AS (SELECT symbol, ts, close / nullif({lag('close')}, 0) - 1 AS ret FROM bars), j AS (SELECT s.symbol, s.ts, s.p, r.ret FROM s JOIN r ON s.symbol = r.symbol AND s.ts = r.ts),
k AS (SELECT *, count(ret) OVER p60 AS n, count_if(ret <> 0) OVER p60 AS nz, count_if(ret > 0) OVER p60 AS up, count_if(ret < 0) OVER p60 AS dn, avg(CASE WHEN ret > 0 THEN ret END) OVER p60 / (avg(CASE WHEN ret < 0 THEN -ret END) OVER p60 + 1e-9) AS pay FROM j WINDOW p60 AS (PARTITION BY symbol ORDER BY ts ROWS BETWEEN 60 PRECEDING AND 1 PRECEDING)),
w AS (SELECT symbol, ts, p, CASE WHEN n < 60 THEN NULL WHEN nz < 5 THEN 0.5 WHEN up = 0 THEN 0 WHEN dn = 0 THEN 1 ELSE round(up / nz, 4) END AS r, CASE WHEN n < 60 THEN NULL WHEN nz < 5 OR up = 0 THEN 1 WHEN dn = 0 THEN 2 ELSE round(pay, 4) END AS b FROM k),
fk AS (SELECT *, CASE WHEN r IS NULL THEN NULL WHEN r <= 0 OR r >= 1 OR b <= 0 OR r * b - (1 - r) <= 0 THEN 0 ELSE (r * b - (1 - r)) / b END AS k FROM w)
SELECT symbol, ts, CAST(r AS DOUBLE) AS win_rate, CAST(b AS DOUBLE) AS payoff, round(CAST(k AS DOUBLE), 6) AS kelly, CAST(CASE WHEN k IS NULL THEN NULL WHEN p < 0.52 THEN 0 ELSE round(least(0.25, k * 0.5 * least(2, 1 + 4 * (p - 0.52))), 4) END AS DOUBLE) AS size FROM fk""",
)
def rolling_kelly(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = _labelled(spark, sf_dir).join(metrics.returns(event_bars(spark, sf_dir)), ["symbol", "ts"])
    return rounded(portfolio.rolling_kelly(own).select("symbol", "ts", "win_rate", "payoff", "kelly", "size"))


_PAIR_BOOKS = f"""{_PAIR_Z}, g AS (SELECT a, b, ts, i, CASE WHEN z <= -2 THEN 1 WHEN z >= 2 THEN -1 ELSE 0 END AS signal FROM z WHERE i = 1
  UNION ALL SELECT z.a, z.b, z.ts, z.i, CASE WHEN z.z IS NULL THEN 0 WHEN g.signal = 0 THEN CASE WHEN z.z <= -2 THEN 1 WHEN z.z >= 2 THEN -1 ELSE 0 END WHEN g.signal = 1 THEN CASE WHEN z.z <= -3.5 OR z.z >= 0 THEN 0 ELSE 1 END ELSE CASE WHEN z.z >= 3.5 OR z.z <= 0 THEN 0 ELSE -1 END END
  FROM g JOIN z ON z.a = g.a AND z.b = g.b AND z.i = g.i + 1),
j AS (SELECT s.a, s.b, s.ts, x, y, coalesce(beta, 1) AS beta, coalesce(lag(signal) OVER p, 0) AS pos, coalesce(y / nullif(lag(y) OVER p, 0) - 1, 0) AS ry, coalesce(x / nullif(lag(x) OVER p, 0) - 1, 0) AS rx FROM s JOIN g ON s.a = g.a AND s.b = g.b AND s.ts = g.ts WINDOW p AS (PARTITION BY s.a, s.b ORDER BY s.ts)),
w AS (SELECT *, pos / (1 + abs(beta)) AS wy, -pos * beta / (1 + abs(beta)) AS wx FROM j),
k AS (SELECT *, wy * ry + wx * rx - 0.0005 * (abs(wy - coalesce(lag(wy) OVER p, 0)) + abs(wx - coalesce(lag(wx) OVER p, 0))) AS ret FROM w WINDOW p AS (PARTITION BY a, b ORDER BY ts)),
q AS (SELECT *, product(1 + ret) OVER p AS equity FROM k WINDOW p AS (PARTITION BY a, b ORDER BY ts)), dd AS (SELECT *, equity / max(equity) OVER (PARTITION BY a, b ORDER BY ts) - 1 AS drawdown FROM q)"""


def _books(spark: SparkSession, sf_dir: str) -> DataFrame:
    spread = portfolio.hedge(joins.pairs(event_bars(spark, sf_dir), "close").select("a", "b", "ts", "x", "y"))
    return portfolio.pairs_backtest(spread.join(portfolio.pair_signals(spread, ["a", "b"]), ["a", "b", "ts"]))


@query("pairs_books", f"WITH RECURSIVE {_PAIR_BOOKS} SELECT a, b, ts, round(wx, 4) AS w_x, round(wy, 4) AS w_y, round(ret, 4) AS ret, round(equity, 4) AS equity, round(drawdown, 4) AS drawdown, CAST(pos AS INTEGER) AS position FROM dd")
def pairs_books(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(_books(spark, sf_dir), 4)


@query(
    "pair_trade_counts",
    f"""WITH RECURSIVE {_PAIR_BOOKS}, m AS (SELECT *, CASE WHEN lag(pos) OVER p IS NULL THEN pos <> 0 ELSE (pos <> 0) <> (lag(pos) OVER p <> 0) END AS c FROM dd WINDOW p AS (PARTITION BY a, b ORDER BY ts)),
t AS (SELECT *, lead(equity) OVER (PARTITION BY a, b ORDER BY ts) - equity AS pnl FROM m WHERE c) SELECT a, b, count(*) AS n_trades, count_if(pnl > 0) AS n_wins, round(sum(pnl), 4) AS pnl FROM t WHERE pos <> 0 AND pnl IS NOT NULL GROUP BY 1, 2""",
)
def pair_trade_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = portfolio.pair_trades(_books(spark, sf_dir))
    return rounded(own.groupBy("a", "b").agg(F.count("*").alias("n_trades"), F.count_if(F.col("pnl") > 0).alias("n_wins"), F.sum("pnl").alias("pnl")), 4)


@query(
    "regime_performance",
    f"""WITH {RET}, v AS (SELECT *, {full('stddev_samp(ret)', 'ret', 20)} AS v FROM ret), q AS (SELECT symbol, quantile_cont(v, 1 / 3.0) AS lo, quantile_cont(v, 2 / 3.0) AS hi FROM v GROUP BY symbol),
g AS (SELECT v.*, CASE WHEN v <= lo THEN 0 WHEN v <= hi THEN 1 ELSE 2 END AS regime FROM v JOIN q USING (symbol) WHERE v IS NOT NULL)
SELECT symbol, CAST(regime AS INTEGER) AS regime, count(*) AS n, round(count(*) / sum(count(*)) OVER (PARTITION BY symbol), 4) AS share, round(exp(sum(ln(1 + ret))) - 1, 4) AS total_return, round(stddev_samp(ret) * sqrt(252), 4) AS volatility, round(sqrt(252) * avg(ret) / stddev_samp(ret), 4) AS sharpe FROM g GROUP BY 1, 2""",
)
def regime_performance(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = metrics.by_regime(metrics.volatility_regime(_returns(spark, sf_dir)))
    return rounded(own.select("symbol", "regime", "n", "share", "total_return", "volatility", "sharpe"), 4)


@query(
    "signal_returns",
    f"""WITH {_XY}, t AS (SELECT symbol, ts, CASE WHEN p >= 0.5 THEN 1 ELSE -1 END * (lead(close) OVER {W} / close - 1) AS ret FROM bars JOIN s USING (symbol, ts)) SELECT symbol, count(ret) AS n, round(avg(ret), 6) AS mean, round(stddev_samp(ret), 6) AS dev FROM t GROUP BY symbol""",
)
def signal_returns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Returns of being long or short by the reversion score."""
    close = event_bars(spark, sf_dir).select("symbol", "ts", "close")
    both = _labelled(spark, sf_dir).join(close, ["symbol", "ts"])
    from pyspark.sql import Window

    both = both.withColumns({"next": F.lead("close").over(Window.partitionBy("symbol").orderBy("ts")) / F.col("close") - 1, "p": (F.col("p") >= 0.5).cast("int")})
    return rounded(metrics.strategy_returns(both).groupBy("symbol").agg(F.count("ret").alias("n"), F.avg("ret").alias("mean"), F.stddev_samp("ret").alias("dev")))


@query(
    "split_rows",
    f"""WITH {RET}, n AS (SELECT *, row_number() OVER {W} - 1 AS nth, count(*) OVER (PARTITION BY symbol) AS total FROM ret) SELECT symbol, CASE WHEN nth < floor(total * 0.8) THEN 'train' ELSE 'test' END AS part, count(*) AS n, round(avg(ret), 6) AS mean FROM n GROUP BY 1, 2""",
)
def split_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = models_.temporal_split(_returns(spark, sf_dir))
    return rounded(own.groupBy("symbol", "part").agg(F.count("*").alias("n"), F.avg("ret").alias("mean")))


@query(
    "ensembles",
    f"""WITH {_XY}, w AS (SELECT symbol, ts, p, 1 / (1 + exp(-mom)) AS q FROM s) SELECT symbol, ts, round((p + q) / 2, 6) AS mean, round((p * (abs(p - 0.5) + 1e-4) + q * (abs(q - 0.5) + 1e-4)) / (abs(p - 0.5) + abs(q - 0.5) + 2e-4), 6) AS conviction, round((p * 0.1 + q * 0.01) / 0.11, 6) AS accuracy FROM w""",
)
def ensembles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blends of two probabilities of the next bar's direction."""
    both = {"p": F.col("p"), "q": 1 / (1 + F.exp(-F.col("mom_5d")))}
    e = models_.ensemble
    return rounded(_labelled(spark, sf_dir).select("symbol", "ts", e(both).alias("mean"), e(both, by="conviction").alias("conviction"), e(both, {"p": 0.55, "q": 0.4}, by="accuracy").alias("accuracy")))
