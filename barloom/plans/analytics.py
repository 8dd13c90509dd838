"""Queries on cleaning, statistics, joins over time and portfolios, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barloom.operators import cleaning, joins, metrics, portfolio, recurrences
from barloom.plans.bars_sql import BARS, W, frame, full, lag
from barloom.plans.registry import query, rounded
from barloom.sources.bars import event_bars, flag_bars

RET = f"{BARS}, r AS (SELECT symbol, ts, close / nullif({lag('close')}, 0) - 1 AS ret FROM bars), ret AS (SELECT * FROM r WHERE ret IS NOT NULL)"
FLAGS = f"""{BARS}, a AS (SELECT *, {lag('close')} AS p, lead(close) OVER {W} AS q FROM bars),
flags AS (SELECT *, coalesce(least(open, high, low, close) <= 0, false) AS bad, volume <= 0 AS empty,
  coalesce(close > 0 AND p > 0 AND q > 0 AND abs((close - p) / nullif(p, 0)) >= 0.15 AND (close - p) * (q - close) < 0 AND abs((q - p) / nullif(p, 0)) <= 0.05, false) AS spike FROM a)"""


@query("clean_flags", f"WITH {FLAGS} SELECT symbol, ts, false AS is_duplicate, bad AS is_bad_price, empty AS is_zero_volume, spike AS is_spike FROM flags")
def clean_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cleaning.flags(event_bars(spark, sf_dir)).select("symbol", "ts", "is_duplicate", "is_bad_price", "is_zero_volume", "is_spike")


@query(
    "quality_report",
    f"WITH {FLAGS} SELECT symbol, count(*) AS n_rows, CAST(0 AS BIGINT) AS n_duplicate, count_if(bad) AS n_bad_price, count_if(empty) AS n_zero_volume, count_if(spike) AS n_spike, count_if(bad) + count_if(empty) + count_if(spike) AS n_issues, round(100.0 * count_if(bad OR empty OR spike) / count(*), 6) AS affected_pct FROM flags GROUP BY symbol",
)
def quality_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(cleaning.quality_report(cleaning.flags(event_bars(spark, sf_dir))))


@query(
    "fill_forward",
    f"""WITH {FLAGS}, h AS (SELECT symbol, ts, CASE WHEN NOT (bad OR spike) THEN close END AS close, CASE WHEN NOT empty THEN volume END AS volume FROM flags)
SELECT symbol, ts, round(coalesce(last_value(close IGNORE NULLS) OVER (PARTITION BY symbol ORDER BY ts ROWS UNBOUNDED PRECEDING), first_value(close IGNORE NULLS) OVER (PARTITION BY symbol ORDER BY ts ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)), 6) AS close, volume FROM h""",
)
def fill_forward(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(cleaning.fill_forward(cleaning.flags(event_bars(spark, sf_dir))).select("symbol", "ts", "close", "volume"))


@query("two_bar_spikes")
def two_bar_spikes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cleaning.two_bar_spikes(event_bars(spark, sf_dir))


@query(
    "split_candidates",
    f"""WITH {BARS}, a AS (SELECT *, CASE WHEN close > 0 AND {lag('close')} > 0 THEN close / {lag('close')} END AS q, volume / nullif({lag('volume')}, 0) AS v FROM bars),
b AS (SELECT *, CASE WHEN q <= 0.6 THEN 1 / q WHEN q >= 1.5 THEN q END AS f FROM a), c AS (SELECT *, round_even(f, 0) AS k FROM b)
SELECT symbol, ts, round(q, 6) AS ratio, round(CASE WHEN q <= 0.6 THEN k ELSE 1 / k END, 6) AS factor,
  round(CASE WHEN q <= 0.6 AND v >= 1.2 THEN least(1, greatest(0, 1 - abs(f - k)) + 0.1) ELSE greatest(0, 1 - abs(f - k)) END, 6) AS confidence FROM c WHERE k >= 2 AND abs(f - k) / k <= 0.15""",
)
def split_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(cleaning.splits(event_bars(spark, sf_dir)))


@query(
    "missing_days",
    """WITH d AS (SELECT DISTINCT l_returnflag AS symbol, CAST(l_shipdate AS DATE) AS date FROM lineitem), s AS (SELECT symbol, min(date) AS lo, max(date) AS hi FROM d GROUP BY symbol),
c AS (SELECT CAST(unnest(generate_series((SELECT min(lo) FROM s), (SELECT max(hi) FROM s), INTERVAL 1 DAY)) AS DATE) AS date)
SELECT s.symbol, c.date FROM s JOIN c ON c.date BETWEEN s.lo AND s.hi WHERE isodow(c.date) < 6 AND NOT EXISTS (SELECT 1 FROM d WHERE d.symbol = s.symbol AND d.date = c.date)""",
)
def missing_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cleaning.missing_sessions(flag_bars(spark, sf_dir))


@query(
    "validation",
    f"""WITH {BARS}, b AS (SELECT *, coalesce(ts <= {lag('ts')}, false) AS back FROM bars),
n AS (SELECT count_if(least(open, high, low, close) <= 0 OR volume < 0 OR high < low OR high < greatest(open, close) OR low > least(open, close)) AS wrong, count_if(back) AS back, CASE WHEN date_diff('day', CAST(max(ts) AS DATE), DATE '2024-02-01') > 5 THEN 1 ELSE 0 END AS stale,
  sum(CASE WHEN false THEN 1 ELSE 0 END) AS none FROM b),
r AS (SELECT 'schema' AS rule, 'critical' AS severity, CAST(none AS BIGINT) AS affected FROM n UNION ALL SELECT 'range', 'critical', wrong FROM n UNION ALL SELECT 'order', 'critical', back FROM n UNION ALL SELECT 'freshness', 'warning', stale FROM n)
SELECT rule, affected = 0 AS passed, severity, CAST(affected AS BIGINT) AS affected FROM r""",
)
def validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cleaning.validate(event_bars(spark, sf_dir), "2024-02-01")


_CARD = "count(ret) AS n, round(avg(ret), 6) AS mean, round(stddev_samp(ret), 6) AS dev, round(CASE WHEN count(ret) < 2 OR stddev_samp(ret) <= 1e-12 THEN 0 ELSE sqrt(252) * avg(ret) / stddev_samp(ret) END, 6) AS sharpe, round(CASE WHEN count(ret) < 2 OR sqrt(avg(least(ret, 0) ^ 2)) <= 1e-12 THEN 0 ELSE sqrt(252) * avg(ret) / sqrt(avg(least(ret, 0) ^ 2)) END, 6) AS sortino, round(coalesce(count_if(ret > 0) / nullif(count_if(ret <> 0), 0), 0), 6) AS win_rate, round(CASE WHEN sum(CASE WHEN ret < 0 THEN -ret ELSE 0 END) > 1e-12 THEN sum(CASE WHEN ret > 0 THEN ret ELSE 0 END) / sum(CASE WHEN ret < 0 THEN -ret ELSE 0 END) WHEN max(ret) > 0 THEN CAST('inf' AS DOUBLE) ELSE 0 END, 6) AS profit_factor, round(skewness(ret), 4) AS skew, round(kurtosis(ret), 4) AS kurtosis, round(min(ret), 6) AS worst, round(max(ret), 6) AS best"


@query("scorecard", f"WITH {RET} SELECT symbol, {_CARD} FROM ret GROUP BY symbol UNION ALL SELECT 'AGGREGATE', {_CARD} FROM ret")
def scorecard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(metrics.scorecard(metrics.returns(event_bars(spark, sf_dir))), rough=("skew", "kurtosis"))


@query(
    "drawdown",
    f"""WITH {BARS}, w AS (SELECT symbol, ts, CASE WHEN row_number() OVER {W} > 1 THEN close / first_value(close) OVER {W} END AS wealth FROM bars),
d AS (SELECT symbol, ts, wealth / max(wealth) OVER {W} - 1 AS dd FROM w WHERE wealth IS NOT NULL),
i AS (SELECT *, sum(CASE WHEN dd >= -1e-12 THEN 1 ELSE 0 END) OVER {W} AS run FROM d), g AS (SELECT symbol, run, min(dd) AS low, count_if(dd < -1e-12) AS n FROM i GROUP BY 1, 2)
SELECT symbol, round(min(low), 6) AS max_drawdown, max(n) AS longest_drawdown FROM g GROUP BY symbol""",
)
def drawdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(metrics.underwater(metrics.drawdowns(metrics.returns(event_bars(spark, sf_dir)))))


@query(
    "rolling_risk",
    f"""WITH {RET}, a AS (SELECT *, {full('stddev_samp(ret)', 'ret', 126)} AS d, {full('avg(ret)', 'ret', 126)} AS m, CASE WHEN ret > 0 THEN 1.0 ELSE 0.0 END AS up FROM ret)
SELECT symbol, ts, round(d * sqrt(252), 6) AS volatility, round(m / (d + 1e-9) * sqrt(252), 6) AS sharpe, round({full('avg(up)', 'ret', 126)}, 6) AS win_rate FROM a""",
)
def rolling_risk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(metrics.rolling(metrics.returns(event_bars(spark, sf_dir))))


@query(
    "seasonality",
    f"""WITH {RET}, u AS (SELECT 'weekday' AS unit, isodow(ts) - 1 AS nth, ret FROM ret WHERE isodow(ts) < 6 UNION ALL SELECT 'month', month(ts), ret FROM ret)
SELECT unit, CAST(nth AS INTEGER) AS nth, round(avg(ret), 6) AS mean, round(stddev_samp(ret), 6) AS dev, count(ret) AS n, round(stddev_samp(ret) / sqrt(count(ret)), 6) AS sem FROM u GROUP BY 1, 2""",
)
def seasonality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(metrics.seasonality(metrics.returns(event_bars(spark, sf_dir))))


_ACF = f"""{RET}, m AS (SELECT symbol, ts, ret - avg(ret) OVER (PARTITION BY symbol) AS d FROM ret), l AS (SELECT unnest(range(1, 11)) AS lag),
n AS (SELECT symbol, ts, d, row_number() OVER {W} AS i FROM m), v AS (SELECT symbol, sum(d * d) AS v, count(*) AS n FROM m GROUP BY symbol),
acf AS (SELECT a.symbol, v.n, l.lag, sum(a.d * b.d) / any_value(v.v) AS acf FROM n a JOIN l ON true JOIN n b ON a.symbol = b.symbol AND a.i = b.i + l.lag JOIN v ON v.symbol = a.symbol GROUP BY 1, 2, 3)"""


@query("autocorrelation", f"WITH {_ACF} SELECT symbol, n, CAST(lag AS INTEGER) AS lag, round(acf, 6) AS acf FROM acf")
def autocorrelation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(metrics.autocorrelation(metrics.returns(event_bars(spark, sf_dir))))


@query("ljung_box", f"WITH {_ACF} SELECT symbol, CAST(max(lag) AS INTEGER) AS lags, round(sum(n * (n + 2) * acf ^ 2 / (n - lag)), 4) AS q FROM acf GROUP BY symbol")
def ljung_box(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(metrics.ljung_box(metrics.autocorrelation(metrics.returns(event_bars(spark, sf_dir)))), 4)


@query(
    "runs_test",
    f"""WITH {RET}, s AS (SELECT symbol, ts, sign(ret) AS s FROM ret WHERE ret <> 0), n AS (SELECT *, CASE WHEN s = lag(s) OVER {W} THEN 0 ELSE 1 END AS new FROM s),
g AS (SELECT *, sum(new) OVER {W} AS run FROM n), c AS (SELECT symbol, run, count(*) AS n FROM g GROUP BY 1, 2) SELECT symbol, CAST(sum(n) AS BIGINT) AS n, count(*) AS runs, max(n) AS longest FROM c GROUP BY symbol""",
)
def runs_test(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.runs_test(metrics.returns(event_bars(spark, sf_dir)))


@query(
    "scalers",
    f"""WITH {BARS}, s AS (SELECT symbol, median(close) AS centre, quantile_cont(close, 0.75) - quantile_cont(close, 0.25) AS q, stddev_samp(close) AS d FROM bars GROUP BY symbol)
SELECT symbol, round(centre, 6) AS centre, round(CASE WHEN q > 1e-8 THEN q WHEN d > 1e-8 THEN d ELSE 1 END, 6) AS scale FROM s""",
)
def scalers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(metrics.scaler(event_bars(spark, sf_dir), "close"))


@query(
    "pair_statistics",
    f"WITH {BARS} SELECT a.symbol AS a, b.symbol AS b, count(*) AS n, round(corr(a.close, b.close), 6) AS corr, round(regr_slope(b.close, a.close), 6) AS beta, round(regr_intercept(b.close, a.close), 4) AS alpha FROM bars a JOIN bars b ON a.ts = b.ts AND a.symbol < b.symbol GROUP BY 1, 2",
)
def pair_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(joins.pair_statistics(event_bars(spark, sf_dir)), rough=("alpha",))


@query("covariances", f"WITH {RET} SELECT a.symbol AS a, b.symbol AS b, round(252 * covar_samp(a.ret, b.ret), 4) AS cov FROM ret a JOIN ret b ON a.ts = b.ts AND a.symbol <= b.symbol GROUP BY 1, 2")
def covariances(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(portfolio.covariances(metrics.returns(event_bars(spark, sf_dir))), 4)


@query(
    "as_of_orders",
    """SELECT o.o_orderkey, o.o_custkey, o.o_orderdate, (SELECT max(e.ts) FROM (SELECT user_id, ts FROM events) e WHERE e.user_id = o.o_custkey AND e.ts <= TIMESTAMP '2024-01-15' + INTERVAL 1 SECOND * (o.o_orderkey % 1000000)) AS event_ts
FROM orders o""",
)
def as_of_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last event of the customer's number before a moment drawn from the order's key."""
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey", "o_custkey", "o_orderdate")
    moment = F.expr("TIMESTAMP_NTZ'2024-01-15 00:00:00' + make_dt_interval(0, 0, 0, o_orderkey % 1000000)")
    left = orders.withColumn("moment", moment).withColumnRenamed("o_custkey", "user_id")
    events = spark.read.parquet(f"{sf_dir}/events.parquet").select("user_id", F.col("ts").alias("at"), F.col("ts").alias("event_ts"))
    out = joins.as_of(left, events, "user_id", "moment", "at", ["event_ts"])
    return out.select("o_orderkey", F.col("user_id").alias("o_custkey"), "o_orderdate", "event_ts")


@query(
    "kelly_sizes",
    f"""WITH {RET}, k AS (SELECT symbol, count_if(ret <> 0) AS n, count_if(ret > 0) AS w, count_if(ret < 0) AS l, avg(CASE WHEN ret > 0 THEN ret END) / (avg(CASE WHEN ret < 0 THEN -ret END) + 1e-9) AS pay FROM ret GROUP BY symbol),
p AS (SELECT symbol, CASE WHEN n < 5 THEN 0.5 WHEN w = 0 THEN 0 WHEN l = 0 THEN 1 ELSE round(w / n, 4) END AS p, CASE WHEN n < 5 OR w = 0 THEN 1 WHEN l = 0 THEN 2 ELSE round(pay, 4) END AS b FROM k)
SELECT symbol, CAST(p AS DOUBLE) AS win_rate, CAST(b AS DOUBLE) AS payoff, round(CASE WHEN p <= 0 OR p >= 1 OR b <= 0 OR p * b - (1 - p) <= 0 THEN 0 ELSE (p * b - (1 - p)) / b END, 6) AS kelly FROM p""",
)
def kelly_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    rate, ratio = portfolio.kelly_parameters(F.col("ret"))
    out = metrics.returns(event_bars(spark, sf_dir)).groupBy("symbol").agg(rate.cast("double").alias("win_rate"), ratio.cast("double").alias("payoff"))
    return rounded(out.withColumn("kelly", portfolio.kelly(F.col("win_rate"), F.col("payoff"))))


def _pair(n: int) -> str:
    return f"(PARTITION BY a, b ORDER BY ts ROWS {n - 1} PRECEDING)"


_PAIR_Z = f"""{BARS}, p AS (SELECT l.symbol AS a, r.symbol AS b, l.ts, l.close AS x, r.close AS y FROM bars l JOIN bars r ON l.ts = r.ts AND l.symbol < r.symbol),
h AS (SELECT *, CASE WHEN count(*) OVER {_pair(60)} >= 30 THEN covar_samp(x, y) OVER {_pair(60)} / nullif(var_samp(x) OVER {_pair(60)}, 0) END AS beta, avg(x) OVER {_pair(60)} AS mx, avg(y) OVER {_pair(60)} AS my FROM p),
s AS (SELECT *, y - beta * x - (my - beta * mx) AS spread FROM h),
z AS (SELECT a, b, ts, CASE WHEN count(spread) OVER {_pair(30)} >= 10 THEN (spread - avg(spread) OVER {_pair(30)}) / nullif(stddev_samp(spread) OVER {_pair(30)}, 0) END AS z, row_number() OVER (PARTITION BY a, b ORDER BY ts) AS i FROM s)"""


@query(
    "pair_signals",
    f"""WITH RECURSIVE {_PAIR_Z},
g AS (SELECT a, b, ts, i, CASE WHEN z <= -2 THEN 1 WHEN z >= 2 THEN -1 ELSE 0 END AS signal FROM z WHERE i = 1
  UNION ALL SELECT z.a, z.b, z.ts, z.i, CASE WHEN z.z IS NULL THEN 0 WHEN g.signal = 0 THEN CASE WHEN z.z <= -2 THEN 1 WHEN z.z >= 2 THEN -1 ELSE 0 END
    WHEN g.signal = 1 THEN CASE WHEN z.z <= -3.5 OR z.z >= 0 THEN 0 ELSE 1 END ELSE CASE WHEN z.z >= 3.5 OR z.z <= 0 THEN 0 ELSE -1 END END
  FROM g JOIN z ON z.a = g.a AND z.b = g.b AND z.i = g.i + 1)
SELECT a, b, ts, CAST(signal AS INTEGER) AS signal FROM g""",
)
def pair_signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return portfolio.pair_signals(portfolio.hedge(joins.pairs(event_bars(spark, sf_dir), "close").select("a", "b", "ts", "x", "y")), ["a", "b"])


@query("pair_spreads", f"WITH {_PAIR_Z} SELECT s.a, s.b, s.ts, round(beta, 6) AS beta, round(spread, 4) AS spread, round(z, 4) AS z FROM s JOIN z ON s.a = z.a AND s.b = z.b AND s.ts = z.ts")
def pair_spreads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rolling hedge ratio, spread and its z-score of each pair."""
    out = portfolio.hedge(joins.pairs(event_bars(spark, sf_dir), "close").select("a", "b", "ts", "x", "y"))
    return rounded(out.select("a", "b", "ts", "beta", "spread", "z"), rough=("spread", "z"))


@query(
    "performance",
    f"""WITH {RET}, w AS (SELECT symbol, ts, exp(sum(ln(1 + ret)) OVER {W}) AS wealth FROM ret), d AS (SELECT symbol, ts, wealth / max(wealth) OVER {W} - 1 AS dd FROM w),
i AS (SELECT *, sum(CASE WHEN dd >= -1e-12 THEN 1 ELSE 0 END) OVER {W} AS run FROM d), g AS (SELECT symbol, run, min(dd) AS low, count_if(dd < -1e-12) AS n FROM i GROUP BY 1, 2), u AS (SELECT symbol, min(low) AS low, max(n) AS longest FROM g GROUP BY symbol),
m AS (SELECT symbol, count(*) AS n, exp(sum(ln(1 + ret))) - 1 AS total, exp(sum(ln(1 + ret)) * 252 / count(*)) - 1 AS yearly, stddev_samp(ret) * sqrt(252) AS vol, sqrt(252) * avg(ret) / stddev_samp(ret) AS sharpe, sqrt(252) * avg(ret) / sqrt(avg(least(ret, 0) ^ 2)) AS sortino,
  count_if(ret > 0) / count_if(ret <> 0) AS wins, sum(CASE WHEN ret > 0 THEN ret ELSE 0 END) / sum(CASE WHEN ret < 0 THEN -ret ELSE 0 END) AS pf FROM ret GROUP BY symbol)
SELECT symbol, n, round(total, 4) AS total_return, round(yearly, 4) AS annual_return, round(vol, 4) AS volatility, round(sharpe, 4) AS sharpe, round(sortino, 4) AS sortino, round(wins, 4) AS win_rate, round(pf, 4) AS profit_factor, round(low, 4) AS max_drawdown, longest AS longest_drawdown, round(yearly / abs(low), 4) AS calmar FROM m JOIN u USING (symbol)""",
)
def performance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(metrics.performance(metrics.returns(event_bars(spark, sf_dir))), 4)


_RECURRED = f"""{BARS}, b AS (SELECT *, row_number() OVER {W} AS i, {lag('close')} AS before FROM bars),
c AS (SELECT *, greatest(high - low, abs(high - before), abs(low - before)) AS tr, greatest(close - before, 0) AS up, greatest(before - close, 0) AS down FROM b),
s AS (SELECT *, avg(tr) OVER {frame(14)} AS tr14, avg(up) OVER {frame(14)} AS up14, avg(down) OVER {frame(14)} AS down14 FROM c),
e AS (SELECT symbol, i, ts, close AS e20, close AS e12, close AS e26, CAST(NULL AS DOUBLE) AS sig, CAST(NULL AS DOUBLE) AS atr, CAST(NULL AS DOUBLE) AS u, CAST(NULL AS DOUBLE) AS d FROM s WHERE i = 1
  UNION ALL SELECT s.symbol, s.i, s.ts, e.e20 * (1 - 2 / 21.0) + s.close * 2 / 21.0, e.e12 * (1 - 2 / 13.0) + s.close * 2 / 13.0, e.e26 * (1 - 2 / 27.0) + s.close * 2 / 27.0,
    CASE WHEN s.i < 26 THEN NULL WHEN s.i = 26 THEN e.e12 * (1 - 2 / 13.0) + s.close * 2 / 13.0 - e.e26 * (1 - 2 / 27.0) - s.close * 2 / 27.0 ELSE e.sig * 0.8 + 0.2 * (e.e12 * (1 - 2 / 13.0) + s.close * 2 / 13.0 - e.e26 * (1 - 2 / 27.0) - s.close * 2 / 27.0) END,
    CASE WHEN s.i < 14 THEN NULL WHEN s.i = 14 THEN s.tr14 ELSE (e.atr * 13 + s.tr) / 14 END, CASE WHEN s.i < 15 THEN NULL WHEN s.i = 15 THEN s.up14 ELSE (e.u * 13 + s.up) / 14 END, CASE WHEN s.i < 15 THEN NULL WHEN s.i = 15 THEN s.down14 ELSE (e.d * 13 + s.down) / 14 END
  FROM e JOIN s ON s.symbol = e.symbol AND s.i = e.i + 1)"""


@query(
    "recurrences",
    f"""WITH RECURSIVE {_RECURRED}
SELECT symbol, ts, round(e20, 6) AS ema_20, round(CASE WHEN d = 0 THEN CASE WHEN u = 0 THEN 50 ELSE 100 END ELSE 100 - 100 / (1 + u / d) END, 6) AS rsi_wilder_14, round(atr, 6) AS atr_14,
  round(CASE WHEN i >= 26 THEN e12 - e26 END, 6) AS macd_line, round(CASE WHEN i >= 34 THEN sig END, 6) AS macd_signal FROM e""",
)
def recurrence_suite(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(recurrences.recurrences(event_bars(spark, sf_dir)))


_DIST = ", ".join(f"round(CASE WHEN atr = 0 AND close = {full('avg(close)', 'close', n)} THEN 0 ELSE (close - {full('avg(close)', 'close', n)}) / nullif(atr, 0) END, 6) AS ma_dist_atr_{n}" for n in (20, 50))


@query(
    "recurrence_features",
    f"""WITH RECURSIVE {_RECURRED}, g AS (SELECT symbol, ts, close, atr, CASE WHEN e.i >= 26 THEN e12 - e26 END AS line, CASE WHEN e.i >= 34 THEN sig END AS signal, CASE WHEN d = 0 THEN CASE WHEN u = 0 THEN 50 ELSE 100 END ELSE 100 - 100 / (1 + u / d) END AS rsi FROM e JOIN b USING (symbol, ts)),
h AS (SELECT *, CASE WHEN line > signal THEN 1.0 WHEN line <= signal THEN 0.0 END AS bullish FROM g)
SELECT symbol, ts, round(line - signal, 6) AS macd_hist, round(line / nullif(close, 0), 6) AS macd_norm, CAST(bullish AS DOUBLE) AS macd_bullish, CAST(coalesce(bullish - {lag('bullish')}, 0.0) AS DOUBLE) AS macd_cross,
  CAST(CASE WHEN rsi < 30 THEN 1.0 WHEN rsi > 70 THEN -1.0 WHEN rsi IS NOT NULL THEN 0.0 END AS DOUBLE) AS rsi_reversion_signal, round((rsi - 50) / 50, 6) AS rsi_stretch, {_DIST} FROM h""",
)
def recurrence_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(recurrences.derived(event_bars(spark, sf_dir)))
