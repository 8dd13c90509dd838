"""Statistics of returns and of trades, per group."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barloom.functions.windows import change, div, full, last

C = F.col
YEAR = 252


def returns(bars: DataFrame) -> DataFrame:
    """symbol, ts, ret; without the first bar."""
    return bars.select("symbol", "ts", change(C("close"), 1).alias("ret")).where("ret is not null")


def sharpe(r: Column, yearly_rate: float = 0.0) -> Column:
    """0 for fewer than two returns or none that differ."""
    dev = F.stddev_samp(r)
    return F.when((F.count(r) < 2) | (dev <= 1e-12), 0.0).otherwise(F.sqrt(F.lit(float(YEAR))) * (F.avg(r) - yearly_rate / YEAR) / dev)


def sortino(r: Column) -> Column:
    """The downside counts over all returns, gains as 0."""
    down = F.sqrt(F.avg(F.pow(F.least(r, F.lit(0.0)), 2)))
    return F.when((F.count(r) < 2) | (down <= 1e-12), 0.0).otherwise(F.sqrt(F.lit(float(YEAR))) * F.avg(r) / down)


def total_return(r: Column) -> Column:
    return F.product(1 + r) - 1


def annual_return(r: Column) -> Column:
    """-1 where all is lost."""
    return F.when(F.product(1 + r) <= 0, -1.0).otherwise(F.pow(F.product(1 + r), YEAR / F.count(r)) - 1)


def drawdowns(ret: DataFrame, key: str = "symbol") -> DataFrame:
    """key, ts, wealth, drawdown; the peak starts with the first wealth, not with 1."""
    w = Window.partitionBy(key).orderBy("ts").rowsBetween(Window.unboundedPreceding, 0)
    wealth = ret.select(key, "ts", "ret", F.product(1 + C("ret")).over(w).alias("wealth"))
    return wealth.withColumn("drawdown", C("wealth") / F.max("wealth").over(w) - 1)


def underwater(draw: DataFrame, key: str = "symbol") -> DataFrame:
    """key, max_drawdown and the longest run of bars below a former peak."""
    w = Window.partitionBy(key).orderBy("ts").rowsBetween(Window.unboundedPreceding, 0)
    island = draw.withColumn("run", F.sum((C("drawdown") >= 0).cast("int")).over(w))
    runs = island.groupBy(key, "run").agg(F.min("drawdown").alias("low"), F.count_if(C("drawdown") < 0).alias("n"))
    return runs.groupBy(key).agg(F.min("low").alias("max_drawdown"), F.max("n").alias("longest_drawdown"))


def win_rate(r: Column) -> Column:
    return F.coalesce(div(F.count_if(r > 0), F.count_if(r != 0)), F.lit(0.0))


def profit_factor(r: Column) -> Column:
    """Gains over losses; infinite without a loss, 0 without a gain."""
    up, down = F.sum(F.when(r > 0, r).otherwise(0.0)), -F.sum(F.when(r < 0, r).otherwise(0.0))
    return F.when(F.coalesce(down, F.lit(0.0)) > 1e-12, up / down).when(up > 0, float("inf")).otherwise(0.0)


def bias_corrected(r: Column) -> tuple[Column, Column]:
    """Skewness and excess kurtosis of a sample; Spark's own are those of a population."""
    n = F.count(r)
    skew = F.when(n > 2, F.sqrt(n * (n - 1)) / (n - 2) * F.skewness(r))
    kurt = F.when(n > 3, (n - 1) / ((n - 2) * (n - 3)) * ((n + 1) * F.kurtosis(r) + 6))
    return skew, kurt


def scorecard(ret: DataFrame, key: str = "symbol") -> DataFrame:
    """Metrics of each group of returns, and of all together under AGGREGATE."""
    r = C("ret")
    skew, kurt = bias_corrected(r)
    parts = [F.count(r).alias("n"), F.avg(r).alias("mean"), F.stddev_samp(r).alias("dev"), sharpe(r).alias("sharpe"), sortino(r).alias("sortino"), win_rate(r).alias("win_rate"), profit_factor(r).alias("profit_factor"), skew.alias("skew"), kurt.alias("kurtosis"), F.min(r).alias("worst"), F.max(r).alias("best")]
    out = ret.rollup(key).agg(F.grouping(key).alias("_all"), *parts)
    return out.withColumn(key, F.when(C("_all") == 1, "AGGREGATE").otherwise(C(key))).drop("_all")


def against(ret: DataFrame, market: DataFrame, key: str = "symbol") -> DataFrame:
    """beta, alpha (yearly), tracking_error, information_ratio, corr of returns to those of market(ts, m)."""
    r, m = C("ret"), C("m")
    both = ret.join(market, "ts").dropna(subset=["ret", "m"])
    var = F.var_samp(m)
    beta = F.when(var <= 1e-12, 1.0).otherwise(F.covar_samp(r, m) / var)
    te = F.stddev_samp(r - m) * F.sqrt(F.lit(float(YEAR)))
    return both.groupBy(key).agg(F.count("*").alias("n"), beta.alias("beta"), (YEAR * (F.avg(r) - beta * F.avg(m))).alias("alpha"), te.alias("tracking_error"), div(YEAR * F.avg(r - m), te).alias("information_ratio"), F.corr(r, m).alias("corr"))


def seasonality(ret: DataFrame) -> DataFrame:
    """unit (weekday 0 to 4 or month), mean, dev, n and standard error of returns."""
    day = ret.select(F.lit("weekday").alias("unit"), F.weekday("ts").alias("nth"), "ret").where("nth < 5")
    month = ret.select(F.lit("month").alias("unit"), F.month("ts").alias("nth"), "ret")
    dev = F.stddev_samp("ret")
    return day.union(month).groupBy("unit", "nth").agg(F.avg("ret").alias("mean"), dev.alias("dev"), F.count("ret").alias("n"), (dev / F.sqrt(F.count("ret"))).alias("sem"))


def rolling(ret: DataFrame, n: int = 126) -> DataFrame:
    """symbol, ts and the volatility, Sharpe ratio and win rate of the last n returns."""
    r = C("ret")
    dev, mean = full(F.stddev_samp(r), r, n), full(F.avg(r), r, n)
    root = F.sqrt(F.lit(float(YEAR)))
    return ret.select("symbol", "ts", (dev * root).alias("volatility"), (mean / (dev + 1e-9) * root).alias("sharpe"), full(F.avg((r > 0).cast("double")), r, n).alias("win_rate"))


def autocorrelation(ret: DataFrame, lags: int = 10) -> DataFrame:
    """symbol, lag, acf with the sample's mean and variance."""
    by = Window.partitionBy("symbol")
    order = by.orderBy("ts")
    off = ret.withColumn("d", C("ret") - F.avg("ret").over(by))
    terms = [F.sum(C("d") * C(f"d{k}")) for k in range(1, lags + 1)]
    wide = off.withColumns({f"d{k}": F.lag("d", k).over(order) for k in range(1, lags + 1)}).groupBy("symbol").agg(F.count("*").alias("n"), *(div(t, F.sum(C("d") * C("d"))).alias(str(k)) for k, t in enumerate(terms, 1)))
    return wide.unpivot(["symbol", "n"], [str(k) for k in range(1, lags + 1)], "lag", "acf").withColumn("lag", C("lag").cast("int"))


def ljung_box(acf: DataFrame) -> DataFrame:
    """symbol, lags, q: the portmanteau statistic over the lags of autocorrelation()."""
    return acf.groupBy("symbol").agg(F.max("lag").alias("lags"), F.sum(C("n") * (C("n") + 2) * F.pow("acf", 2) / (C("n") - C("lag"))).alias("q"))


def runs_test(ret: DataFrame) -> DataFrame:
    """symbol, n, runs and longest run of signs of non-zero returns."""
    w = Window.partitionBy("symbol").orderBy("ts")
    s = ret.where("ret <> 0").withColumn("s", F.signum("ret"))
    s = s.withColumn("new", F.coalesce((C("s") != F.lag("s").over(w)).cast("int"), F.lit(1)))
    s = s.withColumn("run", F.sum("new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    runs = s.groupBy("symbol", "run").agg(F.count("*").alias("n"))
    return runs.groupBy("symbol").agg(F.sum("n").alias("n"), F.count("*").alias("runs"), F.max("n").alias("longest"))


def performance(ret: DataFrame, key: str = "symbol", yearly_rate: float = 0.0) -> DataFrame:
    """key, n, total and annual return, volatility, Sharpe, Sortino and Calmar ratios, drawdown and its longest time, win rate and profit factor
    of returns(key, ts, ret); all 0 for fewer than two."""
    own = ret.where(C("ret").isNotNull() & ~F.isnan("ret"))
    rate = (1 + yearly_rate) ** (1 / YEAR) - 1
    r, few = C("ret"), F.count("ret") < 2
    excess = r - rate
    root = F.sqrt(F.lit(float(YEAR)))
    down, dev = F.sqrt(F.avg(F.pow(F.least(excess, F.lit(0.0)), 2))), F.stddev_samp(r)
    ratio = lambda a, b: F.when(few | (b <= 1e-12), 0.0).otherwise(a / b)
    some = lambda x: F.when(few, 0.0).otherwise(x)
    parts = own.groupBy(key).agg(
        F.count(r).alias("n"), some(total_return(r)).alias("total_return"), some(annual_return(r)).alias("annual_return"), some(dev * root).alias("volatility"),
        ratio(root * F.avg(excess), dev).alias("sharpe"), ratio(root * F.avg(excess), down).alias("sortino"), some(win_rate(r)).alias("win_rate"), some(profit_factor(r)).alias("profit_factor"),
    )
    both = parts.join(underwater(drawdowns(own, key), key), key)
    both = both.withColumns({c: F.when(C("n") < 2, 0).otherwise(C(c)) for c in ("max_drawdown", "longest_drawdown")})
    return both.withColumn("calmar", F.when((C("n") < 2) | (F.abs("max_drawdown") <= 1e-12), 0.0).otherwise(C("annual_return") / F.abs("max_drawdown")))


def by_regime(ret: DataFrame, key: str = "symbol", label: str = "regime") -> DataFrame:
    """key, label, n, share of the time and the performance of the returns in each regime; returns of one regime count as if they followed each other."""
    own = ret.dropna(subset=["ret", label])
    both = own.withColumn("_k", F.struct(key, label))
    total = own.groupBy(key).agg(F.count("*").alias("_all"))
    out = performance(both, "_k").select(C(f"_k.{key}").alias(key), C(f"_k.{label}").alias(label), "*").drop("_k")
    return out.join(total, key).withColumn("share", C("n") / C("_all")).drop("_all")


def volatility_regime(ret: DataFrame, n: int = 20, low: float = 1 / 3, high: float = 2 / 3) -> DataFrame:
    """ret with regime 0, 1, 2 of the volatility of the last n returns against its quantiles over the whole sample (so it looks ahead: for reports only)."""
    w = Window.partitionBy("symbol").orderBy("ts").rowsBetween(-(n - 1), 0)
    v = ret.withColumn("_v", F.when(F.count("ret").over(w) == n, F.stddev_samp("ret").over(w)))
    q = v.groupBy("symbol").agg(F.percentile("_v", low).alias("_lo"), F.percentile("_v", high).alias("_hi"))
    out = v.join(q, "symbol").withColumn("regime", F.when(C("_v").isNull(), None).when(C("_v") <= C("_lo"), 0).when(C("_v") <= C("_hi"), 1).otherwise(2))
    return out.drop("_v", "_lo", "_hi")


def median_regime(ret: DataFrame, n: int = 21, quantile: float = 0.5) -> DataFrame:
    """ret with volatility (yearly, in percent, of the last n returns) and wild (above its quantile over the whole sample, so it looks ahead: for reports only)."""
    w = Window.partitionBy("symbol").orderBy("ts").rowsBetween(-(n - 1), 0)
    v = ret.withColumn("volatility", F.when(F.count("ret").over(w) == n, F.stddev_samp("ret").over(w) * math.sqrt(YEAR) * 100))
    return v.join(v.groupBy("symbol").agg(F.percentile("volatility", quantile).alias("_q")), "symbol").withColumn("wild", C("volatility") > C("_q")).drop("_q")


def strategy_returns(df: DataFrame, prediction: str = "p", future: str = "next", *, long_only: bool = False) -> DataFrame:
    """df with ret: the future return times the position of a prediction (1: long, 0: short, or flat if long_only; else flat); rows without a
    prediction or return are left out."""
    p = C(prediction)
    side = F.when(p == 1, 1.0).when((p == 0) & ~F.lit(long_only), -1.0).otherwise(0.0)
    return df.dropna(subset=[prediction, future]).withColumn("ret", side * C(future))


def crisis_windows(ret: DataFrame, windows: DataFrame, least: int = 5) -> DataFrame:
    """name, symbol, n, total and volatility of returns within windows(name, start, stop)."""
    month = lambda c: F.trunc(C(c).cast("date"), "month")
    parts = windows.withColumn("_month", F.explode(F.sequence(month("start"), month("stop"), F.expr("interval 1 month"))))
    both = ret.withColumn("_month", month("ts")).join(parts, "_month").where(C("ts").between(C("start"), C("stop")))
    out = both.groupBy("name", "symbol").agg(F.count("*").alias("n"), total_return(C("ret")).alias("total"), (F.stddev_samp("ret") * F.sqrt(F.lit(float(YEAR)))).alias("volatility"))
    return out.where(C("n") >= least)


def scaler(df: DataFrame, column: str, key: str = "symbol", kind: str = "robust") -> DataFrame:
    """key, centre, scale learned from df: robust (median and linear quartile range, else the deviation), standard or minmax."""
    x = C(column)
    dev = F.coalesce(F.stddev_samp(x), F.lit(0.0))
    if kind == "robust":
        centre, scale = F.percentile(x, 0.5), F.percentile(x, 0.75) - F.percentile(x, 0.25)
        scale = F.when(scale <= 1e-8, dev).otherwise(scale)
    elif kind == "standard":
        centre, scale = F.avg(x), dev
    else:
        centre, scale = F.min(x), F.max(x) - F.min(x)
    return df.groupBy(key).agg(centre.alias("centre"), F.when(scale <= 1e-8, 1.0).otherwise(scale).alias("scale"))
