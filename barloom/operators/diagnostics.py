"""Diagnostics of return series by symbol: proxies, partial autocorrelation, variance ratios, tests of independence and of unit roots.

Sums over lagged products are aggregates in Spark; of each symbol only a small matrix of sums reaches Python, where one is solved.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from barloom.functions.windows import div

C = F.col

# The rational approximation of the error function (absolute error below 1.5e-7), critical values of the KPSS level test with their
# levels, and of the Dickey-Fuller test with a constant by sample size (the response surfaces' terms in 1, 1/n, 1/n^2, 1/n^3).
ERF = (0.3275911, (0.254829592, -0.284496736, 1.421413741, -1.453152027, 1.061405429))
KPSS = ((0.347, 0.10), (0.463, 0.05), (0.574, 0.025), (0.739, 0.01))
DICKEY_FULLER = {"crit_1": (-3.43035, -6.5393, -16.786, -79.433), "crit_5": (-2.86154, -2.8903, -4.234, -40.04), "crit_10": (-2.56677, -1.5384, -2.809, 0.0)}


def _by(order: str | None = None) -> WindowSpec:
    w = Window.partitionBy("symbol")
    return w.orderBy(order) if order else w


def two_sided(z: Column) -> Column:
    """The probability of a standard normal value at least as far from 0."""
    x = F.abs(z) / math.sqrt(2)
    t = 1 / (1 + ERF[0] * x)
    poly = sum((a * F.pow(t, k) for k, a in enumerate(ERF[1][1:], 2)), ERF[1][0] * t)
    return poly * F.exp(-x * x)


def chi_square_above(x: Column, freedom: int) -> Column:
    """The probability that a chi-square value with this freedom exceeds x."""
    half = x / 2
    if freedom % 2 == 0:
        return F.exp(-half) * sum((F.pow(half, k) / math.factorial(k) for k in range(1, freedom // 2)), F.lit(1.0))
    rest = sum((F.pow(half, k - 0.5) / math.gamma(k + 0.5) for k in range(1, (freedom - 1) // 2 + 1)), F.lit(0.0))
    return two_sided(F.sqrt(x)) + F.exp(-half) * rest


def proxies(ret: DataFrame) -> DataFrame:
    """ret with the squared and the absolute return."""
    return ret.withColumns({"squared": C("ret") * C("ret"), "absolute": F.abs("ret")})


def differences(df: DataFrame, column: str, order: int = 1) -> DataFrame:
    """df with `column` less its value a row before, `order` times; without the rows that have none."""
    if order < 1:
        raise ValueError("order must be 1 or more")
    for _ in range(order):
        df = df.withColumn(column, C(column) - F.lag(column).over(_by("ts")))
    return df.where(C(column).isNotNull())


def correlogram(df: DataFrame, column: str = "ret", lags: int = 10) -> DataFrame:
    """symbol, n, lag, acf, half (of its 95 % interval by Bartlett's formula), pacf (Yule-Walker with sums over n - lag), pacf_half."""
    off = df.select("symbol", "ts", (C(column) - F.avg(column).over(_by())).alias("d"))
    wide = off.withColumns({f"d{k}": F.lag("d", k).over(_by("ts")) for k in range(1, lags + 1)})
    sums = wide.groupBy("symbol").agg(F.count("d").alias("n"), F.array(F.sum(C("d") * C("d")), *(F.coalesce(F.sum(C("d") * C(f"d{k}")), F.lit(0.0)) for k in range(1, lags + 1))).alias("s"))

    @F.pandas_udf("array<double>")
    def partial(s: pd.Series, n: pd.Series) -> pd.Series:
        def one(sums: np.ndarray, n: int) -> list[float | None]:
            most = min(len(sums) - 1, n // 2 - 1)
            cov = sums / (n - np.arange(len(sums)))
            out, before = [], np.zeros(0)
            for k in range(1, most + 1):
                with np.errstate(divide="ignore", invalid="ignore"):
                    last = (cov[k] - before @ cov[k - 1 : 0 : -1]) / (cov[0] - before @ cov[1:k])
                before = np.append(before - last * before[::-1], last)
                out.append(float(last) if np.isfinite(last) else None)
            return out

        return pd.Series([one(np.asarray(a, float), int(m)) for a, m in zip(s, n, strict=True)])

    sums = sums.withColumn("p", partial("s", "n"))
    rows = sums.select("symbol", "n", "p", F.posexplode("s").alias("lag", "x"), C("s")[0].alias("s0")).where("lag > 0 and lag <= greatest(1, n div 2 - 1)")
    rows = rows.withColumn("acf", div(C("x"), C("s0")))
    before = F.coalesce(F.sum(C("acf") * C("acf")).over(_by("lag").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    z = 1.959963984540054
    return rows.select("symbol", "n", "lag", "acf", (z * F.sqrt((1 + 2 * before) / C("n"))).alias("half"), F.try_element_at("p", C("lag")).alias("pacf"), (z / F.sqrt("n")).alias("pacf_half"))


def portmanteau(acf: DataFrame, lags: int, alpha: float = 0.05) -> DataFrame:
    """symbol, q, p_value and dependent (p below alpha) of the Ljung-Box test over `lags` lags of acf(symbol, n, lag, acf)."""
    q = acf.where(C("lag") <= lags).groupBy("symbol").agg(F.sum(C("n") * (C("n") + 2) * C("acf") * C("acf") / (C("n") - C("lag"))).alias("q"))
    return q.withColumn("p_value", chi_square_above(C("q"), lags)).withColumn("dependent", C("p_value") < alpha)


def dependence(acf: DataFrame, lags: tuple[int, ...] = (10, 20), alpha: float = 0.05, least: int = 20) -> DataFrame:
    """symbol, lags and p_values (arrays), any_lag and all_lags (some, or each, of the Ljung-Box tests over these numbers of lags rejects) of the symbols with `least` values or more. Returns count as
    autocorrelated if any test rejects; volatility, of squared returns, as clustered only if all do."""
    out = acf.where(C("n") >= least).select("symbol").distinct()
    for k in lags:
        out = out.join(portmanteau(acf, k, alpha).select("symbol", C("p_value").alias(f"_{k}")), "symbol")
    p = F.array(*(C(f"_{k}") for k in lags))
    return out.select("symbol", F.lit(list(lags)).alias("lags"), p.alias("p_values"), F.exists(p, lambda x: x < alpha).alias("any_lag"), F.forall(p, lambda x: x < alpha).alias("all_lags"))


def variance_ratios(prices: DataFrame, horizons: tuple[int, ...] = (2, 5, 10, 20), price: str = "close") -> DataFrame:
    """symbol, k, ratio, z, z_robust, p_value (of z_robust) and verdict of overlapping k-bar log returns; symbols of under 30 returns, and horizons
    of half the sample or more, are left out."""
    r = prices.select("symbol", "ts", F.log(price).alias("p")).withColumn("r", C("p") - F.lag("p").over(_by("ts")))
    r = r.withColumn("mu", F.avg("r").over(_by())).withColumn("s", F.pow(C("r") - C("mu"), 2))
    r = r.withColumns({f"s{j}": F.lag("s", j).over(_by("ts")) for j in range(1, max(horizons))} | {f"m{k}": C("p") - F.lag("p", k).over(_by("ts")) - k * C("mu") for k in horizons})
    sums = r.groupBy("symbol").agg(F.count("r").alias("n"), F.sum("s").alias("s"), F.array(*(F.sum(C("s") * C(f"s{j}")) for j in range(1, max(horizons)))).alias("d"), *(F.sum(C(f"m{k}") * C(f"m{k}")).alias(f"v{k}") for k in horizons))
    rows = sums.where("n >= 30").select("symbol", "n", "s", "d", F.explode(F.create_map(*[x for k in horizons for x in (F.lit(k), C(f"v{k}"))])).alias("k", "v")).where("k >= 2 and k < n div 2")
    n, k = C("n"), C("k")
    ratio = C("v") / (k * (n - k + 1) * (1 - k / n)) / (C("s") / (n - 1))
    rows = rows.where(C("s") / (n - 1) > 1e-12).withColumn("ratio", ratio)
    plain = F.sqrt(2 * (2 * k - 1) * (k - 1) / (3 * k * n))
    weighted = F.transform(F.slice("d", 1, k - 1), lambda x, j: x * F.pow(2 * (k - 1 - j) / k, 2))
    theta = F.aggregate(weighted, F.lit(0.0), lambda a, x: a + x) / (C("s") * C("s"))
    rows = rows.withColumns({"z": (C("ratio") - 1) / plain, "z_robust": (C("ratio") - 1) / F.when(theta > 0, F.sqrt(theta)).otherwise(plain)})
    verdict = F.when(C("z_robust") < -1.96, "mean-reversion").when(C("z_robust") > 1.96, "momentum").otherwise("random-walk")
    return rows.select("symbol", "k", "ratio", "z", "z_robust", two_sided(C("z_robust")).alias("p_value"), verdict.alias("verdict"))


def streaks(ret: DataFrame) -> DataFrame:
    """symbol, counts of signs and runs, expected runs, z, p_value, mean and longest streaks, verdict, of the signs of non-zero returns; symbols with one
    sign alone are left out."""
    s = ret.where("ret <> 0").withColumn("up", C("ret") > 0)
    s = s.withColumn("new", F.coalesce(C("up") != F.lag("up").over(_by("ts")), F.lit(True)).cast("int"))
    runs = s.withColumn("run", F.sum("new").over(_by("ts").rowsBetween(Window.unboundedPreceding, 0))).groupBy("symbol", "run", "up").agg(F.count("*").alias("m"))
    up, down = F.when(C("up"), C("m")), F.when(~C("up"), C("m"))
    out = runs.groupBy("symbol").agg(
        F.coalesce(F.sum(up), F.lit(0)).alias("n_up"), F.coalesce(F.sum(down), F.lit(0)).alias("n_down"), F.count("*").alias("runs"), F.avg(up).alias("mean_up"), F.max(up).alias("longest_up"), F.avg(down).alias("mean_down"), F.max(down).alias("longest_down")
    ).where("n_up > 0 and n_down > 0")
    n, two = C("n_up") + C("n_down"), 2.0 * C("n_up") * C("n_down")
    var = two * (two - n) / (n * n * (n - 1))
    out = out.withColumn("expected", 1 + two / n).withColumn("z", (C("runs") - C("expected")) / F.when(var > 0, F.sqrt(var)).otherwise(1.0))
    verdict = F.when(C("z") < -1.96, "longer than random").when(C("z") > 1.96, "shorter than random").otherwise("random")
    return out.withColumns({"p_value": two_sided(C("z")), "verdict": verdict})


def _regression(df: DataFrame, y: str, x: list[str]) -> DataFrame:
    """symbol, n, and beta, se (arrays, the constant first), ssr and sst of y on a constant and x, over rows without nulls. The sums are Spark's; the solution
    of each symbol's few equations is numpy's."""
    rows = df.dropna(subset=[y, *x])
    names = [F.lit(1.0), *(C(c) for c in x)]
    cells = [F.sum(a * b) for i, a in enumerate(names) for b in names[i:]]
    sums = rows.groupBy("symbol").agg(F.count("*").alias("n"), F.array(*cells).alias("xx"), F.array(*(F.sum(a * C(y)) for a in names)).alias("xy"), F.sum(C(y) * C(y)).alias("yy"))

    @F.pandas_udf("struct<beta:array<double>, se:array<double>, ssr:double, sst:double>")
    def solve(n: pd.Series, xx: pd.Series, xy: pd.Series, yy: pd.Series) -> pd.DataFrame:
        out = []
        for m, a, b, s in zip(n, xx, xy, yy, strict=True):
            size = len(b)
            full = np.zeros((size, size))
            full[np.triu_indices(size)] = a
            full = full + np.triu(full, 1).T
            b = np.asarray(b, float)
            inverse = np.linalg.pinv(full)
            beta = inverse @ b
            ssr = max(0.0, s - beta @ b)
            se = np.sqrt(np.maximum(np.diag(inverse), 0) * ssr / max(1, m - size))
            out.append((beta.tolist(), se.tolist(), ssr, s - b[0] ** 2 / m))
        return pd.DataFrame(out, columns=["beta", "se", "ssr", "sst"])

    return sums.withColumn("_f", solve("n", "xx", "xy", "yy")).select("symbol", "n", "_f.*")


def arch_lm(ret: DataFrame, lags: int = 10) -> DataFrame:
    """symbol, n, lm and p_value: squared deviations regressed on those of the `lags` bars before; symbols need three times as many returns."""
    off = ret.withColumn("_m", F.count("*").over(_by())).where(C("_m") >= 3 * (lags + 1)).withColumn("e", F.pow(C("ret") - F.avg("ret").over(_by()), 2))
    # of a common scale, so that sums of squares keep their digits
    off = off.withColumn("e", div(C("e"), F.avg("e").over(_by())))
    fit = _regression(off.withColumns({f"e{k}": F.lag("e", k).over(_by("ts")) for k in range(1, lags + 1)}), "e", [f"e{k}" for k in range(1, lags + 1)])
    out = fit.withColumn("lm", C("n") * (1 - div(C("ssr"), C("sst"))))
    return out.select("symbol", "n", "lm", chi_square_above(C("lm"), lags).alias("p_value"))


def clustering(ret: DataFrame, lags: int = 10, alpha: float = 0.05) -> DataFrame:
    """symbol, p_squared (Ljung-Box on squared returns), p_arch and verdict: confirmed if both reject, absent if neither does, else inconclusive."""
    squared = portmanteau(correlogram(proxies(ret), "squared", lags), lags, alpha).select("symbol", C("p_value").alias("p_squared"))
    both = squared.join(arch_lm(ret, lags).select("symbol", C("p_value").alias("p_arch")), "symbol")
    a, b = C("p_squared") < alpha, C("p_arch") < alpha
    return both.withColumn("verdict", F.when(a & b, "confirmed").when(~a & ~b, "absent").otherwise("inconclusive"))


def dickey_fuller(df: DataFrame, column: str = "close", lags: int = 0) -> DataFrame:
    """symbol, n, statistic, its critical values and stationary (below that of 5 %): the change regressed on the level before, a constant and `lags`
    changes before."""
    rows = df.select("symbol", "ts", C(column).alias("x0"), F.lag(column).over(_by("ts")).alias("x")).withColumn("d", C("x0") - C("x"))
    rows = rows.withColumns({f"d{k}": F.lag("d", k).over(_by("ts")) for k in range(1, lags + 1)})
    # the level less its mean: the constant takes up the rest, and the sums keep their digits
    rows = rows.withColumn("x", C("x") - F.avg("x").over(_by()))
    fit = _regression(rows, "d", ["x", *(f"d{k}" for k in range(1, lags + 1))])
    crit = {c: sum((a / F.pow("n", k) for k, a in enumerate(terms) if k), F.lit(terms[0])) for c, terms in DICKEY_FULLER.items()}
    out = fit.select("symbol", "n", div(C("beta")[1], C("se")[1]).alias("statistic")).withColumns(crit)
    return out.withColumn("stationary", C("statistic") < C("crit_5"))


def kpss(df: DataFrame, column: str = "close", lags: int | None = None) -> DataFrame:
    """symbol, n, statistic, p_value (between the tabled 0.01 and 0.1) and stationary (p at least 0.05) around a level; lags of the long-run variance: 4 by default."""
    l = 4 if lags is None else lags  # noqa: E741
    off = df.select("symbol", "ts", (C(column) - F.avg(column).over(_by())).alias("e"))
    off = off.withColumn("s", F.sum("e").over(_by("ts").rowsBetween(Window.unboundedPreceding, 0))).withColumns({f"e{k}": F.lag("e", k).over(_by("ts")) for k in range(1, l + 1)})
    long_run = sum((2 * (1 - k / (l + 1)) * F.coalesce(F.sum(C("e") * C(f"e{k}")), F.lit(0.0)) for k in range(1, l + 1)), F.sum(C("e") * C("e"))) / F.count("e")
    out = off.groupBy("symbol").agg(F.count("e").alias("n"), div(F.sum(C("s") * C("s")) / (F.count("e") * F.count("e")), long_run).alias("statistic"))
    x, p = C("statistic"), F.when(C("statistic") <= KPSS[0][0], KPSS[0][1])
    for (a, pa), (b, pb) in zip(KPSS, KPSS[1:]):
        p = p.when(x <= b, pa + (x - a) / (b - a) * (pb - pa))
    return out.withColumn("p_value", p.otherwise(KPSS[-1][1])).withColumn("stationary", C("p_value") >= 0.05)


def stationarity(df: DataFrame, column: str = "close", lags: int = 0) -> DataFrame:
    """symbol, adf, kpss (do they find it stationary) and verdict: stationary if both do, non-stationary if neither; one alone tells
    a difference-stationary (adf) or a trend-stationary (kpss) series."""
    a, k = dickey_fuller(df, column, lags).select("symbol", C("stationary").alias("adf")), kpss(df, column).select("symbol", C("stationary").alias("kpss"))
    verdict = F.when(C("adf") & C("kpss"), "stationary").when(~C("adf") & ~C("kpss"), "non-stationary").when(C("adf"), "difference-stationary").otherwise("trend-stationary")
    return a.join(k, "symbol").withColumn("verdict", verdict)


def horizon_returns(bars: DataFrame, horizons: tuple[int, ...] = (1, 5, 20)) -> DataFrame:
    """symbol, horizon, ts, ret: log returns between every horizon-th bar from the first, which don't overlap."""
    nth = bars.select("symbol", "ts", "close", (F.row_number().over(_by("ts")) - 1).alias("nth"))
    each = nth.withColumn("horizon", F.explode(F.array(*map(F.lit, horizons)))).where("nth % horizon = 0")
    own = Window.partitionBy("symbol", "horizon").orderBy("ts")
    return each.select("symbol", "horizon", "ts", F.log(div(C("close"), F.lag("close").over(own))).alias("ret")).where("ret is not null")


def histogram(ret: DataFrame) -> DataFrame:
    """symbol, bin, low, n, density and normal (of the same mean and deviation, at the bin's middle) of returns in min(100, max(30, n / 25)) equal bins; empty bins are left out."""
    s = ret.groupBy("symbol").agg(F.count("ret").alias("total"), F.min("ret").alias("lo"), F.max("ret").alias("hi"), F.avg("ret").alias("mean"), F.stddev_samp("ret").alias("dev"))
    s = s.withColumn("bins", F.least(F.lit(100), F.greatest(F.lit(30), F.floor(C("total") / 25)))).withColumn("width", (C("hi") - C("lo")) / C("bins"))
    at = F.least(C("bins") - 1, F.coalesce(F.floor(div(C("ret") - C("lo"), C("width"))), F.lit(0))).cast("int")
    by = ret.join(s, "symbol").groupBy("symbol", at.alias("bin"), "lo", "width", "total", "mean", "dev").agg(F.count("*").alias("n"))
    low = C("lo") + C("bin") * C("width")
    normal = F.exp(-F.pow(div(low + C("width") / 2 - C("mean"), C("dev")), 2) / 2) / (C("dev") * math.sqrt(2 * math.pi))
    return by.select("symbol", "bin", low.alias("low"), "n", div(C("n"), C("total") * C("width")).alias("density"), normal.alias("normal"))


def half_life(df: DataFrame, keys: list[str], column: str) -> DataFrame:
    """keys and half_life of the reversion of a column: from the slope b of its change on its value before, ln 2 / -ln(1 + b); infinite unless -1 < b < 0.
    Keys of under ten values are left out."""
    w = Window.partitionBy(*keys).orderBy("ts")
    rows = df.select(*keys, C(column).alias("x"), F.lag(column).over(w).alias("before")).where("before is not null and x is not null")
    b = rows.groupBy(*keys).agg(F.count("*").alias("n"), F.regr_slope(C("x") - C("before"), C("before")).alias("b")).where("n >= 9")
    return b.select(*keys, F.when((C("b") < 0) & (1 + C("b") > 0), math.log(2) / -F.log(1 + C("b"))).otherwise(float("inf")).alias("half_life"))
