"""Features of bars as window expressions: momentum, mean reversion, volume, microstructure and range volatility.

All share one window (symbol, ts), so a select of any number of them sorts and shuffles once. Frames that are not full give null; so does a
division by zero, except where a feature defines it.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barloom.functions.windows import change, div, full, lag, last, ordered, so_far

C = F.col


@dataclass(frozen=True)
class Feature:
    name: str
    family: str
    build: Callable[[DataFrame], Column]
    needs: tuple[str, ...]
    lookback: int
    status: str = "production"
    stages: tuple[tuple[str, Callable[[], Column]], ...] = field(default=())  # helper columns, in order


_registry: dict[str, Feature] = {}


def feature(name: str, family: str, needs: str, lookback: int, stages: dict[str, Callable[[], Column]] | None = None):
    """Register a Column builder under a name."""

    def keep(build: Callable[[], Column]) -> Callable[[], Column]:
        _registry[name] = Feature(name, family, lambda df: build(), tuple(needs.split()), lookback, stages=tuple((stages or {}).items()))
        return build

    return keep


def registered(family: str | None = None, status: str | None = None) -> list[Feature]:
    same = lambda a, b: b is None or a.lower() == b.lower()
    return sorted((f for f in _registry.values() if same(f.family, family) and same(f.status, status)), key=lambda f: f.name)


def compute(bars: DataFrame, names: list[str]) -> DataFrame:
    """bars with the features: their helper columns in as few selects as they nest deep, then one select."""
    chosen = [_registry[n] for n in names]
    if missing := sorted({c for f in chosen for c in f.needs} - set(bars.columns)):
        raise ValueError(f"bars lack {missing}")
    depth = max((len(f.stages) for f in chosen), default=0)
    out, own = bars, list(bars.columns)
    for k in range(depth):
        out = out.withColumns({n: b() for f in chosen if len(f.stages) > k for n, b in [f.stages[k]]})
    return out.select(*own, *(f.build(out).alias(f.name) for f in chosen))


def average(x: str | Column, n: int) -> Column:
    x = C(x) if isinstance(x, str) else x
    return full(F.avg(x), x, n)


def deviation(x: str | Column, n: int) -> Column:
    x = C(x) if isinstance(x, str) else x
    return full(F.stddev_samp(x), x, n)


def total(x: str | Column, n: int) -> Column:
    x = C(x) if isinstance(x, str) else x
    return full(F.sum(x), x, n)


def momentum(x: Column, n: int) -> Column:
    if n < 1:
        raise ValueError("a window has one row at least")
    return change(x, n)


def momentum_skip(x: Column, n: int, skip: int) -> Column:
    """From n rows before to `skip` rows before."""
    if n <= skip:
        raise ValueError("the window must be longer than what it skips")
    return div(lag(x, skip) - lag(x, n), lag(x, n))


for _n in (5, 10, 20, 60, 120, 252):
    feature(f"mom_{_n}d", "momentum", "close", _n)(lambda n=_n: momentum(C("close"), n))
feature("mom_12_1m", "momentum", "close", 252)(lambda: momentum_skip(C("close"), 252, 21))
for _n in (10, 20):
    feature(f"roc_{_n}", "momentum", "close", _n)(lambda n=_n: 100 * momentum(C("close"), n))


def spread(fast: int, slow: int) -> Column:
    return div(average("close", fast) - average("close", slow), average("close", slow))


def bullish(fast: int, slow: int) -> Column:
    return F.when(average("close", fast) > average("close", slow), 1.0).when(average("close", slow).isNotNull(), 0.0)


feature("sma_50_200_spread", "momentum", "close", 200)(lambda: spread(50, 200))
feature("sma_50_200_bullish", "momentum", "close", 200)(lambda: bullish(50, 200))
feature("sma_50_200_cross", "momentum", "close", 201, {"_bull_50_200": lambda: bullish(50, 200)})(lambda: F.coalesce(C("_bull_50_200") - lag(C("_bull_50_200")), F.lit(0.0)))


def zscore(x: Column, n: int) -> Column:
    """Deviations from the mean; 0 where all values are equal."""
    mean, dev = average(x, n), deviation(x, n)
    return F.when((dev == 0) & (x == mean), 0.0).otherwise(div(x - mean, dev))


for _n in (10, 20, 50):
    feature(f"zscore_{_n}d", "mean_reversion", "close", _n)(lambda n=_n: zscore(C("close"), n))


def band(n: int, width: float, side: int) -> Column:
    return average("close", n) + side * width * deviation("close", n)


feature("bb_middle", "mean_reversion", "close", 20)(lambda: average("close", 20))
feature("bb_upper", "mean_reversion", "close", 20)(lambda: band(20, 2.0, 1))
feature("bb_lower", "mean_reversion", "close", 20)(lambda: band(20, 2.0, -1))
feature("bb_pct_b", "mean_reversion", "close", 20)(lambda: F.when((deviation("close", 20) == 0) & (C("close") == average("close", 20)), 0.5).otherwise(div(C("close") - band(20, 2.0, -1), band(20, 2.0, 1) - band(20, 2.0, -1))))
feature("bb_bandwidth", "mean_reversion", "close", 20)(lambda: div(band(20, 2.0, 1) - band(20, 2.0, -1), average("close", 20)))


def true_range() -> Column:
    """The first row has no close before it; greatest() leaves nulls out."""
    before = lag(C("close"))
    return F.greatest(C("high") - C("low"), F.abs(C("high") - before), F.abs(C("low") - before))


feature("true_range", "mean_reversion", "high low close", 1)(true_range)
for _n in (20, 50):
    feature(f"ma_dist_std_{_n}", "mean_reversion", "close", _n)(lambda n=_n: F.when((deviation("close", n) == 0) & (C("close") == average("close", n)), 0.0).otherwise(div(C("close") - average("close", n), deviation("close", n))))


def half_life(slope: Column) -> Column:
    """Of an AR(1) regression of changes on levels; null where it does not revert."""
    return F.when((slope < 0) & (1 + slope > 0), F.log(F.lit(2.0)) / -F.log(1 + slope))


def _rolling_half_life(n: int = 120) -> Column:
    x, before = C("_off_mean"), C("_off_mean_lag")
    slope = F.regr_slope(x - before, before).over(ordered().rowsBetween(-(n - 2), 0))
    whole = F.count(x).over(last(n)) == n
    return F.when(whole, F.least(F.coalesce(half_life(slope), F.lit(float(n))), F.lit(float(n))))


feature("half_life_120", "mean_reversion", "close", 140, {"_off_mean": lambda: C("close") - average("close", 20), "_off_mean_lag": lambda: lag(C("_off_mean"))})(_rolling_half_life)


def fast_k(n: int = 14) -> Column:
    low, high = full(F.min("low"), C("low"), n), full(F.max("high"), C("high"), n)
    return F.when((high == low) & (C("close") == low), 50.0).otherwise(100 * div(C("close") - low, high - low))


_STOCHASTIC = {"_fast_k": fast_k, "_slow_k": lambda: average("_fast_k", 3), "_slow_d": lambda: average("_slow_k", 3)}
feature("stoch_fast_k", "mean_reversion", "high low close", 14)(fast_k)
feature("stoch_slow_k", "mean_reversion", "high low close", 16, _STOCHASTIC)(lambda: C("_slow_k"))
feature("stoch_slow_d", "mean_reversion", "high low close", 18, _STOCHASTIC)(lambda: C("_slow_d"))


@feature("stoch_signal", "mean_reversion", "high low close", 19, _STOCHASTIC)
def _stochastic_signal() -> Column:
    """1 where slow K crosses above D below 25, -1 where it crosses below D above 75; a missing bar before counts as not above or below."""
    k, d = C("_slow_k"), C("_slow_d")
    was_above, was_below = F.coalesce(lag(k) > lag(d), F.lit(False)), F.coalesce(lag(k) < lag(d), F.lit(False))
    up, down = (k > d) & ~was_above & (k < 25), (k < d) & ~was_below & (k > 75)
    return F.when(up, 1.0).when(down, -1.0).otherwise(0.0)


#: The first bar adds its own volume.
feature("obv", "volume", "close volume", 1, {"_obv_step": lambda: F.coalesce(F.signum(C("close") - lag(C("close"))), F.lit(1.0)) * C("volume")})(lambda: F.sum("_obv_step").over(so_far()))


def typical() -> Column:
    return (C("high") + C("low") + C("close")) / 3


feature("vwap_20", "volume", "high low close volume", 20)(lambda: div(total(typical() * C("volume"), 20), total("volume", 20)))


@feature("vwap_session", "volume", "high low close volume", 1)
def _vwap_session() -> Column:
    w = Window.partitionBy("symbol", F.to_date("ts")).orderBy("ts").rowsBetween(Window.unboundedPreceding, 0)
    return div(F.sum(typical() * C("volume")).over(w), F.sum("volume").over(w))


def close_location() -> Column:
    return F.when(C("high") == C("low"), 0.0).otherwise(div(2 * C("close") - C("high") - C("low"), C("high") - C("low")))


feature("adl", "volume", "high low close volume", 1)(lambda: F.sum(close_location() * C("volume")).over(so_far()))
feature("cmf_20", "volume", "high low close volume", 20)(lambda: div(total(close_location() * C("volume"), 20), total("volume", 20)))
feature("volume_roc_10", "volume", "volume", 10)(lambda: div(C("volume") - lag(C("volume"), 10), lag(C("volume"), 10)))
feature("volume_z_20", "volume", "volume", 20)(lambda: div(C("volume") - average("volume", 20), deviation("volume", 20)))
_ILLIQUID = {"_illiquid": lambda: 1e6 * div(F.abs(change(C("close"), 1)), C("close") * C("volume"))}
feature("amihud", "volume", "close volume", 2, _ILLIQUID)(lambda: C("_illiquid"))
feature("amihud_20", "volume", "close volume", 21, _ILLIQUID)(lambda: average("_illiquid", 20))


def log_range(a: str, b: str) -> Column:
    """ln(a / b), null unless both are positive."""
    return F.when((C(a) > 0) & (C(b) > 0), F.log(C(a) / C(b)))


def _corwin_schultz() -> Column:
    k = 3 - 2 * F.sqrt(F.lit(2.0))
    one = F.pow(log_range("high", "low"), 2)
    beta = one + lag(one)
    high, low = full(F.max("high"), C("high"), 2), full(F.min("low"), C("low"), 2)
    gamma = F.when((high > 0) & (low > 0), F.pow(F.log(high / low), 2))
    alpha = (F.sqrt(F.lit(2.0)) - 1) * F.sqrt(beta) / k - F.sqrt(gamma / k)
    return F.greatest(F.lit(0.0), 2 * (F.exp(alpha) - 1) / (1 + F.exp(alpha))) + 0 * alpha


feature("cs_spread_20", "microstructure", "high low", 21, {"_cs": _corwin_schultz})(lambda: average("_cs", 20))


def _roll() -> Column:
    d, before = C("_dp"), C("_dp_lag")
    cov = F.when(F.count(before).over(last(20)) == 20, F.covar_samp(d, before).over(last(20)))
    return div(F.when(cov < 0, 2 * F.sqrt(-cov)).when(cov.isNotNull(), 0.0), C("close"))


feature("roll_spread_20", "microstructure", "close", 22, {"_dp": lambda: C("close") - lag(C("close")), "_dp_lag": lambda: lag(C("_dp"))})(_roll)


def _imbalance() -> Column:
    bought = F.when(C("high") == C("low"), 0.5).otherwise(div(C("close") - C("low"), C("high") - C("low")))
    return F.abs(2 * bought - 1) * C("volume")


feature("vpin_20", "microstructure", "high low close volume", 20)(lambda: div(total(_imbalance(), 20), total("volume", 20)))


def _garman_klass() -> Column:
    v = 0.5 * F.pow(log_range("high", "low"), 2) - (2 * F.log(F.lit(2.0)) - 1) * F.pow(log_range("close", "open"), 2)
    return F.when(v.isNotNull(), F.greatest(F.lit(0.0), v))


feature("gk_vol_20", "microstructure", "open high low close", 20, {"_gk": _garman_klass})(lambda: F.sqrt(average("_gk", 20)) * F.sqrt(F.lit(252.0)))
feature("parkinson_vol_20", "microstructure", "high low", 20)(lambda: F.sqrt(average(F.pow(log_range("high", "low"), 2) / (4 * F.log(F.lit(2.0))), 20)) * F.sqrt(F.lit(252.0)))


def percent_rank_by_time(x: Column, time: str = "ts") -> Column:
    """Rank among the symbols of one time over their number; ties share their average, nulls stay null."""
    same = Window.partitionBy(time, x.isNull())
    ties = F.count("*").over(Window.partitionBy(time, x))
    return F.when(x.isNotNull(), (F.rank().over(same.orderBy(x)) + (ties - 1) / 2) / F.count(x).over(same))


def cross_momentum(bars: DataFrame, n: int = 252, skip: int = 21) -> DataFrame:
    """symbol, ts and the percentile rank of the skipped momentum among all symbols at ts."""
    m = bars.select("symbol", "ts", momentum_skip(C("close"), n, skip).alias("m"))
    return m.select("symbol", "ts", percent_rank_by_time(C("m")).alias("xs_momentum"))


def target(x: Column, horizon: int = 1) -> Column:
    """What comes `horizon` rows later, relative to now."""
    return div(F.lead(x, horizon).over(ordered()) - x, x)


def chart_rows(bars: DataFrame, n: int = 30, digits: int = 2) -> DataFrame:
    """symbol, ts, prices and volume of the last n bars of each symbol, with means over 20 and 60 bars and bands of two deviations. The windows begin at the first of these bars and take what there is, and all is rounded to
    `digits` places."""
    w = Window.partitionBy("symbol")
    late = bars.withColumn("_nth", F.row_number().over(w.orderBy(F.desc("ts")))).where(C("_nth") <= n)
    near = lambda k: w.orderBy("ts").rowsBetween(-(k - 1), 0)
    mean, dev = F.avg("close").over(near(20)), F.coalesce(F.stddev_samp("close").over(near(20)), F.lit(0.0))
    two = lambda c, name: F.round(c, digits).alias(name)
    return late.select("symbol", "ts", *(two(C(c), c) for c in ("open", "high", "low", "close")), "volume", two(mean, "sma20"), two(F.avg("close").over(near(60)), "sma60"), two(mean + 2 * dev, "bb_upper"), two(mean - 2 * dev, "bb_lower"))
