"""Queries on orders, books of backtests, summaries and the latest bars, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barloom.operators import features, ledger, metrics, models, nlp, policy, portfolio
from barloom.plans.analytics import RET
from barloom.plans.bars_sql import BARS, full
from barloom.plans.registry import query, rounded
from barloom.sources.bars import event_bars

_INTENTS = """i AS (SELECT CAST(o_orderkey AS VARCHAR) AS ticker, CASE WHEN o_orderkey % 3 = 0 THEN 'SELL' ELSE 'BUY' END AS action, o_totalprice / 100 AS quantity, 10.0 + o_custkey % 90 AS price, o_orderkey % 17 = 0 AS closing,
  100000.0 - o_custkey % 7 * 3000 AS equity, 100000.0 AS peak, 100000.0 AS day_start, -(o_orderkey % 5) * 900.0 AS pnl, (o_custkey % 11 - 5) * 5200.0 AS held, (o_custkey % 13) * 8500.0 AS gross, (o_custkey % 9 - 4) * 24000.0 AS net,
  CASE WHEN o_custkey % 4 > 0 THEN 's' END AS sector, (o_custkey % 8) * 6000.0 AS sector_held, 0.1 + o_orderkey % 6 * 0.1 AS forecast, CASE WHEN o_orderkey % 10 > 0 THEN 0.2 END AS baseline FROM orders)"""


def _intents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders with a made-up book for each, that meets every rule."""
    o = spark.read.parquet(f"{sf_dir}/orders.parquet")
    return o.selectExpr(
        "string(o_orderkey) ticker", "if(o_orderkey % 3 = 0, 'SELL', 'BUY') action", "o_totalprice / 100 quantity", "double(10 + o_custkey % 90) price", "o_orderkey % 17 = 0 is_closing", "double(100000 - o_custkey % 7 * 3000) equity", "100000d peak", "100000d day_start",
        "double(-(o_orderkey % 5) * 900) pnl_today", "double((o_custkey % 11 - 5) * 5200) held", "double(o_custkey % 13 * 8500) gross", "double((o_custkey % 9 - 4) * 24000) net", "if(o_custkey % 4 > 0, 's', null) sector", "double(o_custkey % 8 * 6000) sector_held",
        "0.1d + o_orderkey % 6 * 0.1d forecast_vol", "if(o_orderkey % 10 > 0, 0.2d, null) baseline_vol",
    )


@query(
    "order_gate",
    f"""WITH {_INTENTS}, a AS (SELECT *, quantity * CASE WHEN baseline IS NULL OR forecast <= 1.5 * baseline THEN 1 ELSE round(greatest(0.2, least(1, baseline / forecast)), 4) END AS scaled, closing OR (held > 0 AND action = 'SELL') OR (held < 0 AND action = 'BUY') AS reducing FROM i),
b AS (SELECT *, greatest(0, 0.25 * equity - abs(held)) / price AS r1, CASE WHEN sector IS NOT NULL THEN greatest(0, 0.4 * equity - sector_held) / price ELSE 1e18 END AS r2, greatest(0, equity - gross) / price AS r3 FROM a),
c AS (SELECT *, least(scaled, r1) AS q1, least(scaled, r1, r2) AS q2, least(scaled, r1, r2, r3) AS q3 FROM b),
d AS (SELECT *, CASE WHEN NOT reducing AND (peak - equity) / peak >= 0.15 THEN 'DRAWDOWN_KILL_SWITCH' WHEN NOT reducing AND -pnl / day_start >= 0.03 THEN 'DAILY_LOSS_LIMIT' WHEN reducing THEN NULL WHEN r1 <= 0 THEN 'POSITION_LIMIT' WHEN r2 <= 0 THEN 'SECTOR_CONCENTRATION_LIMIT' WHEN r3 <= 0 THEN 'GROSS_EXPOSURE_LIMIT'
  WHEN abs(net + CASE WHEN action = 'BUY' THEN q3 ELSE -q3 END * price) > equity THEN 'NET_EXPOSURE_LIMIT' END AS block FROM c)
SELECT ticker, CASE WHEN block IS NOT NULL THEN 'BLOCKED' WHEN reducing OR q3 >= quantity THEN 'APPROVED' ELSE 'RESIZED' END AS status,
  coalesce(block, CASE WHEN reducing THEN 'NONE' WHEN q3 < q2 THEN 'GROSS_EXPOSURE_LIMIT' WHEN q2 < q1 THEN 'SECTOR_CONCENTRATION_LIMIT' WHEN q1 < scaled THEN 'POSITION_LIMIT' WHEN scaled < quantity THEN 'VOLATILITY_DERISKING' ELSE 'NONE' END) AS rule,
  round(CASE WHEN block IS NOT NULL THEN 0 WHEN reducing THEN quantity ELSE q3 END, 6) AS approved FROM d""",
)
def order_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(portfolio.risk_gate(_intents(spark, sf_dir)).select("ticker", "status", "rule", "approved"))


@query("latest_bars", f"WITH {BARS}, n AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY ts DESC) AS n FROM bars) SELECT symbol, ts, close FROM n WHERE n > 2 AND n <= 7")
def latest_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five bars of each symbol, after the last two."""
    from pyspark.sql import Window

    nth = F.row_number().over(Window.partitionBy("symbol").orderBy(F.col("ts").desc()))
    return event_bars(spark, sf_dir).withColumn("n", nth).where("n > 2 and n <= 7").select("symbol", "ts", "close")


@query("bar_summary", f"WITH {BARS} SELECT symbol, count(*) AS n, CAST(min(ts) AS DATE) AS first, CAST(max(ts) AS DATE) AS last, count(ts) - count(DISTINCT ts) AS duplicates, count_if(least(open, high, low, close) < 0 OR volume < 0) AS negatives, CASE WHEN count_if(least(open, high, low, close) < 0 OR volume < 0) > 0 THEN count_if(least(open, high, low, close) < 0 OR volume < 0) || ' negatives' ELSE 'none' END AS issues FROM bars GROUP BY symbol")
def bar_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return policy.summary(event_bars(spark, sf_dir))


@query(
    "regime_counts",
    f"""WITH {RET}, v AS (SELECT *, {full('stddev_samp(ret)', 'ret', 20)} AS v FROM ret), q AS (SELECT symbol, quantile_cont(v, 1 / 3.0) AS lo, quantile_cont(v, 2 / 3.0) AS hi FROM v GROUP BY symbol)
SELECT symbol, CAST(CASE WHEN v <= lo THEN 0 WHEN v <= hi THEN 1 ELSE 2 END AS INTEGER) AS regime, count(*) AS n FROM v JOIN q USING (symbol) WHERE v IS NOT NULL GROUP BY 1, 2""",
)
def regime_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.volatility_regime(metrics.returns(event_bars(spark, sf_dir))).where("regime is not null").groupBy("symbol", "regime").agg(F.count("*").alias("n"))


_RUN = f"""{BARS.replace("arg_max(value, ts) AS close", "100 + arg_max(value, ts) / 100 AS close")}, m AS (SELECT *, close / nullif(lag(close, 5) OVER (PARTITION BY symbol ORDER BY ts), 0) - 1 AS mom FROM bars),
g AS (SELECT strategy, symbol, ts, close, volume, CASE WHEN (strategy = 'rising') = (mom > 0) THEN 0.1 ELSE 0.0 END AS weight FROM m, (SELECT unnest(['rising', 'falling']) AS strategy)),
l AS (SELECT *, coalesce(lag(weight) OVER (PARTITION BY strategy, symbol ORDER BY ts), 0.0) AS w FROM g),
grid AS (SELECT strategy, symbol, ts FROM (SELECT DISTINCT strategy, ts FROM g), (SELECT DISTINCT symbol FROM g)),
t AS (SELECT strategy, ts, row_number() OVER (PARTITION BY strategy ORDER BY ts) AS i, list(symbol ORDER BY symbol) AS names, list(coalesce(close, 0) ORDER BY symbol) AS p, list(coalesce(volume, 0) ORDER BY symbol) AS v, list(coalesce(w, 0) ORDER BY symbol) AS w FROM grid LEFT JOIN l USING (strategy, symbol, ts) GROUP BY strategy, ts),
b AS (SELECT DISTINCT strategy, CAST(0 AS BIGINT) AS i, 100000.0::DOUBLE AS cash, 100000.0::DOUBLE AS equity, 0.0::DOUBLE AS ret, 0.0::DOUBLE AS turnover, 0.0::DOUBLE AS slippage, list_transform(p, lambda x: 0.0::DOUBLE) AS shares, list_transform(p, lambda x: 0.0::DOUBLE) AS step, list_transform(p, lambda x: 0.0::DOUBLE) AS slip FROM t
UNION ALL SELECT strategy, i, cash - list_dot_product(step, p) - list_sum(slip) - 5e-4 * turnover AS cash, cash - list_dot_product(step, p) - list_sum(slip) - 5e-4 * turnover + list_dot_product(list_transform(shares, lambda x, j: x + step[j]), p) AS equity,
  (cash - list_dot_product(step, p) - list_sum(slip) - 5e-4 * turnover + list_dot_product(list_transform(shares, lambda x, j: x + step[j]), p)) / before - 1 AS ret, turnover, list_sum(slip) AS slippage, list_transform(shares, lambda x, j: x + step[j]) AS shares, step, slip
FROM (SELECT *, list_dot_product(list_transform(step, lambda x: abs(x)), p) AS turnover, list_transform(step, lambda x, j: abs(x) * p[j] * 5e-4 * greatest(1, sqrt(CASE WHEN v[j] > 0 THEN abs(x) / v[j] / 0.01 ELSE 0 END))) AS slip
  FROM (SELECT *, list_transform(shares, lambda x, j: CASE WHEN p[j] > 0 AND abs(w[j] * worth / p[j] - x) >= 1e-4 THEN w[j] * worth / p[j] - x ELSE 0 END) AS step
    FROM (SELECT b.strategy, t.i, b.cash, b.equity AS before, b.shares, t.p, t.v, t.w, b.cash + list_dot_product(b.shares, t.p) AS worth FROM b JOIN t ON t.strategy = b.strategy AND t.i = b.i + 1))))"""


def _priced(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two strategies over all symbols: those that rose over five bars, and those that fell, in equal parts. A price moves with a hundredth of the events' value, as values of events are no
    prices; volumes are the numbers of events, so that larger orders slip."""
    b = features.compute(event_bars(spark, sf_dir).withColumn("close", 100 + F.col("close") / 100), ["mom_5d"]).select("symbol", "ts", "close", "volume", "mom_5d")
    own = b.withColumn("strategy", F.explode(F.array(F.lit("rising"), F.lit("falling"))))
    weight = F.when((F.col("strategy") == "rising") == (F.col("mom_5d") > 0), 0.1).otherwise(0.0)
    return own.withColumn("weight", F.coalesce(weight, F.lit(0.0))).drop("mom_5d")


@query("backtest_books", f"WITH RECURSIVE {_RUN} SELECT strategy, ts, round(equity, 4) AS equity, round(cash, 4) AS cash, round(ret, 4) AS ret, round(turnover, 4) AS turnover, round(5e-4 * turnover, 4) AS commission, round(slippage, 4) AS slippage FROM b JOIN t USING (strategy, i)")
def backtest_books(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(ledger.run(_priced(spark, sf_dir)).select("strategy", "ts", "equity", "cash", "ret", "turnover", "commission", "slippage"), 4)


@query("gated_books")
def gated_books(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same strategies four times as large, with the risk gate: blocked and cut orders beside the books."""
    big = _priced(spark, sf_dir).withColumn("weight", 4 * F.col("weight"))
    return rounded(ledger.run(big, gate=ledger.Gate()).drop("fills", "nth"), 4)


@query("backtest_performance")
def backtest_performance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(metrics.performance(ledger.run(_priced(spark, sf_dir)).select("strategy", "ts", "ret"), "strategy"), 4)


_TRADES = f"""{_RUN}, u AS (SELECT strategy, i, ts, unnest(names) AS symbol, unnest(step) AS step, unnest(slip) AS slip, unnest(p) AS p FROM b JOIN t USING (strategy, i)),
f AS (SELECT *, p + sign(step) * slip / abs(step) AS price, abs(step) * p * 5e-4 AS fee, sum(step) OVER (PARTITION BY strategy, symbol ORDER BY i) AS s FROM u WHERE step <> 0),
h AS (SELECT *, CASE WHEN abs(s) < 1e-4 THEN 0 ELSE s END AS now, coalesce(lag(CASE WHEN abs(s) < 1e-4 THEN 0 ELSE s END) OVER (PARTITION BY strategy, symbol ORDER BY i), 0) AS held FROM f),
o AS (SELECT *, CASE WHEN now <> 0 AND sign(now) <> sign(held) THEN i END AS opened, CASE WHEN now <> 0 AND sign(now) <> sign(held) THEN price END AS paid FROM h),
e AS (SELECT *, last_value(opened IGNORE NULLS) OVER q AS entry, last_value(paid IGNORE NULLS) OVER q AS entry_price FROM o WINDOW q AS (PARTITION BY strategy, symbol ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
tr AS (SELECT strategy, greatest(1, i - entry) AS bars, least(abs(step), abs(held)) * (price - entry_price) * sign(held) - fee - slip AS pnl FROM e WHERE held * step < 0 AND entry IS NOT NULL)"""


@query(
    "backtest_trades",
    f"""WITH RECURSIVE {_TRADES}, a AS (SELECT strategy, count(*) AS n_trades, count_if(pnl > 0) AS n_wins, count_if(pnl < 0) AS n_losses, coalesce(sum(pnl) FILTER (pnl > 0), 0) AS gain, coalesce(-sum(pnl) FILTER (pnl < 0), 0) AS lost, avg(pnl) AS mean_pnl, coalesce(avg(pnl) FILTER (pnl > 0), 0) AS mean_win, coalesce(avg(pnl) FILTER (pnl < 0), 0) AS mean_loss, max(pnl) AS best, min(pnl) AS worst, avg(bars) AS mean_bars, max(bars) AS longest_bars FROM tr GROUP BY strategy)
SELECT strategy, n_trades, n_wins, n_losses, round(100 * n_wins / n_trades, 2) AS win_rate_pct, round(CASE WHEN lost > 0 THEN gain / lost WHEN gain > 0 THEN gain ELSE 1 END, 2) AS profit_factor, round(mean_pnl, 2) AS mean_pnl, round(mean_win, 2) AS mean_win, round(mean_loss, 2) AS mean_loss, round(CASE WHEN mean_loss <> 0 THEN abs(mean_win / mean_loss) ELSE mean_win END, 2) AS payoff, round(best, 2) AS best, round(worst, 2) AS worst, round(mean_bars, 2) AS mean_bars, longest_bars FROM a""",
)
def backtest_trades(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(portfolio.trade_statistics(ledger.trades(ledger.fills(ledger.run(_priced(spark, sf_dir))))), 2)


@query("sharpe_differences")
def sharpe_differences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Holding a symbol against holding it only after a bar that rose."""
    from pyspark.sql import Window

    ret = metrics.returns(event_bars(spark, sf_dir))
    up = F.coalesce((F.lag("ret").over(Window.partitionBy("symbol").orderBy("ts")) > 0).cast("double"), F.lit(0.0))
    return rounded(models.sharpe_difference(ret.withColumn("held", up * F.col("ret")), "ret", "held", paths=200), 4)


@query("call_features")
def call_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Features of each conversation's turns as transcripts."""
    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    calls = turns.select(F.concat_ws("-", "conv_id", "turn").alias("ticker"), F.lit("2024-01-01").alias("call_date"), F.coalesce("text", F.lit("")).alias("text"))
    return nlp.call_features(calls, ["may", "might", "could", "approximately", "possibly", "uncertain"])
