"""Unit roots and cointegration: tests with the choice of lags, Johansen's statistics from one aggregation, screening of all pairs by blocks.

A regression is solved from its matrix of products. One Cholesky factor of that matrix, the lags in their order and the dependent variable last, holds the
squared residuals of all nested regressions, so the choice of lags by Akaike's criterion costs no more than the largest regression.

Pairs are screened by blocks: symbols are dealt to blocks by hash, a task holds the series of two blocks, and every pair is tested in one task. No join by time
takes place, and a series is copied once for each block, not for each other symbol.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

C = F.col
#: Values that a test of a pair, and one of a single series, needs.
LEAST, LEAST_SINGLE = 30, 10

# MacKinnon's response surfaces with a constant, for one series and for the residuals of two. Of each: the statistic's range and where its two polynomials meet, their
# coefficients, and the critical values' terms in 1, 1/n, 1/n^2 and 1/n^3 at 1, 5 and 10 %.
SURFACES = {
    1: ((-18.83, -1.61, 2.74), (2.1659, 1.4412, 0.038269), (1.7339, 0.93202, -0.12745, -0.010368), ((-3.43035, -6.5393, -16.786, -79.433), (-2.86154, -2.8903, -4.234, -40.04), (-2.56677, -1.5384, -2.809, 0.0))),
    2: ((-18.86, -2.62, 0.92), (2.92, 1.5012, 0.039796), (2.1945, 0.64695, -0.29198, -0.042377), ((-3.89644, -10.9519, -22.527, 0.0), (-3.33613, -6.1101, -6.823, 0.0), (-3.04445, -4.2412, -2.72, 0.0))),
}
# Critical values at 95 % of Johansen's trace and largest-eigenvalue statistics with a constant, by the number of series less the rank.
TRACE_95 = {1: 3.8415, 2: 15.4943, 3: 29.7961, 4: 47.8545, 5: 69.8189}
LARGEST_95 = {1: 3.8415, 2: 14.2639, 3: 21.1314, 4: 27.5858, 5: 33.8777}
# The KPSS level test's statistics and levels.
KPSS_TABLE = ((0.347, 0.463, 0.574, 0.739), (0.10, 0.05, 0.025, 0.01))


def p_value(statistic: float, series: int = 1) -> float:
    """MacKinnon's approximate p-value of a unit-root statistic."""
    (low, star, high), small, large, _ = SURFACES[series]
    if math.isnan(statistic) or statistic > high:
        return 1.0
    if statistic < low:
        return 0.0
    z = sum(c * statistic**k for k, c in enumerate(small if statistic <= star else large))
    return math.erfc(-z / math.sqrt(2)) / 2


def critical_values(n: int, series: int = 1) -> tuple[float, float, float]:
    """At 1, 5 and 10 %."""
    return tuple(sum(c / n**k for k, c in enumerate(terms)) for terms in SURFACES[series][3])


def _factor(columns: list[np.ndarray]) -> np.ndarray:
    """The triangular factor of the columns, each scaled to length 1 and given back at its scale; a column that depends on those before it has a diagonal of almost 0."""
    m = np.stack(columns, axis=1)
    width = np.sqrt((m * m).sum(0))
    width[width == 0] = 1
    return np.linalg.qr(m / width, mode="r") * width


def dickey_fuller(x: np.ndarray, *, constant: bool = True, lags: int | None = None) -> tuple[float, int, int]:
    """(statistic, lags, rows): the change regressed on the level before, a constant if asked for, and changes before. The number of lags, if not given, is
    the one of Akaike's least criterion up to 12 (n / 100)^(1/4), all compared over the same rows."""
    x = np.asarray(x, float)
    n = len(x)
    change = np.diff(x)

    def columns(p: int) -> list[np.ndarray]:
        own = [np.ones(n - 1 - p)] if constant else []
        return [*own, x[p:-1], *(change[p - k : len(change) - k] for k in range(1, p + 1)), change[p:]]

    if lags is None:
        most = max(0, min(n // 2 - constant - 1, math.ceil(12 * (n / 100) ** 0.25)))
        r = _factor(columns(most))
        rows, first = n - 1 - most, 1 + constant
        # squared residuals of the regressions on the first columns alone
        left = np.cumsum((r[:, -1] ** 2)[::-1])[::-1]
        aic = [rows * math.log(max(left[k], 1e-300) / rows) + 2 * k for k in range(first, first + most + 1)]
        lags = int(np.argmin(aic))
    # the level goes last before the dependent variable, so its own row of the factor gives the coefficient and its error
    c = columns(lags)
    level = c.pop(1 if constant else 0)
    r = _factor([*c[:-1], level, c[-1]])
    free = len(change) - lags - (r.shape[1] - 1)
    if free <= 0 or r.shape[0] < r.shape[1]:
        return math.nan, lags, n - 1 - lags
    with np.errstate(divide="ignore", invalid="ignore"):
        return float(r[-2, -1] / r[-2, -2] / (np.sqrt(r[-1, -1] ** 2 / free) / np.abs(r[-2, -2]))), lags, n - 1 - lags


def kpss(x: np.ndarray, lags: int | None = None) -> tuple[float, int]:
    """(statistic, lags) of the level test; the number of lags, if not given, follows from the autocovariances (Hobijn, Franses and Ooms)."""
    e = np.asarray(x, float) - np.mean(x)
    n = len(e)
    if lags is None:
        few = int(n ** (2 / 9))
        cov = [2 * float(e[k:] @ e[: n - k]) / n for k in range(1, few + 1)]
        s0, s1 = float(e @ e) / n + sum(cov), sum(k * c for k, c in enumerate(cov, 1))
        lags = min(int(1.1447 * ((s1 / s0) ** 2 * n) ** (1 / 3)), n - 1) if s0 else 0
    long_run = (float(e @ e) + sum(2 * (1 - k / (lags + 1)) * float(e[k:] @ e[: n - k]) for k in range(1, lags + 1))) / n
    return (float((np.cumsum(e) ** 2).sum()) / n**2 / long_run if long_run > 0 else math.nan), lags


def unit_roots(df: DataFrame, column: str = "close", alpha: float = 0.05) -> DataFrame:
    """symbol, n, adf, adf_lags, adf_p, kpss, kpss_lags, kpss_p and verdict of every symbol of ten values or more: stationary if both tests say so, non-stationary if neither does, else
    inconclusive. A task holds whole series, eight bytes a value."""
    ok = df.where(C(column).isNotNull() & ~F.isnan(column) & (F.abs(column) < float("inf")))
    series = ok.groupBy("symbol").agg(F.transform(F.array_sort(F.collect_list(F.struct("ts", C(column).alias("x")))), lambda s: s["x"]).alias("x"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for symbol, x in zip(batch["symbol"], batch["x"], strict=True):
                x = np.asarray(x, float)
                if len(x) < LEAST_SINGLE:
                    continue
                stat, lags, _ = dickey_fuller(x) if x.std() > 0 else (math.nan, 0, 0)
                level, own = kpss(x)
                p, q = p_value(stat), float(np.interp(level, *KPSS_TABLE)) if not math.isnan(level) else math.nan
                a, k = p < alpha, not q < alpha
                verdict = "stationary" if a and k else "non-stationary" if not a and not k else "inconclusive"
                out.append((symbol, len(x), None if math.isnan(stat) else stat, lags, p, None if math.isnan(level) else level, own, None if math.isnan(q) else q, verdict))
            yield pd.DataFrame(out, columns=["symbol", "n", "adf", "adf_lags", "adf_p", "kpss", "kpss_lags", "kpss_p", "verdict"])

    kind = df.schema["symbol"].dataType.simpleString()
    return series.mapInPandas(run, f"symbol {kind}, n long, adf double, adf_lags int, adf_p double, kpss double, kpss_lags int, kpss_p double, verdict string")


def johansen_eigenvalues(cov: np.ndarray, series: int) -> np.ndarray | None:
    """Squared canonical correlations, greatest first, of changes and levels, both less what the lagged changes explain. cov: covariances of the `series` changes, the lagged changes and the
    `series` levels, in this order; none for series that depend on each other."""
    d, z, l = slice(0, series), slice(series, len(cov) - series), slice(len(cov) - series, len(cov))  # noqa: E741
    gone = np.linalg.pinv(cov[z, z]) if len(cov) > 2 * series else np.zeros((0, 0))
    rest = lambda a, b: cov[a, b] - cov[a, z] @ gone @ cov[z, b]
    factors = []
    for part in (l, d):
        own, before = rest(part, part), np.diag(cov[part, part])
        width = np.sqrt(np.maximum(np.diag(own), 0))
        if (width**2 <= 1e-12 * before).any() or np.linalg.eigvalsh(own / np.outer(width, width)).min() < 1e-10:
            return None
        factors.append(np.linalg.inv(np.linalg.cholesky(own)))
    outer, inner = factors
    return np.clip(np.linalg.svd(outer @ rest(l, d) @ inner.T, compute_uv=False) ** 2, 0, 1 - 1e-15)


def johansen_statistics(eigenvalues: np.ndarray, rows: int) -> tuple[np.ndarray, np.ndarray]:
    """(trace, largest-eigenvalue statistics) for the ranks 0, 1, .."""
    each = -rows * np.log1p(-eigenvalues)
    return np.cumsum(each[::-1])[::-1], each


def johansen(df: DataFrame, keys: list[str], columns: list[str], lags: int = 1) -> DataFrame:
    """keys, n, trace and largest (arrays, by rank from 0), trace_95, largest_95 and cointegrated (both statistics of rank 0 above their 95 % values) of the price columns of each key.

    One aggregation over df(keys, ts, columns) gives all covariances; of a key only these few numbers reach Python. Keys of fewer than 30 rows, or whose series depend on each other, have null
    statistics. Up to five columns."""
    k = len(columns)
    w = Window.partitionBy(*keys).orderBy("ts")
    rows = df.dropna(subset=columns).select(*keys, "ts", *columns)
    names: list[str] = []

    def keep(name: str, value) -> None:
        nonlocal rows
        rows = rows.withColumn(name, value)
        names.append(name)

    for c in columns:
        keep(f"_d_{c}", C(c) - F.lag(c).over(w))
    for j in range(1, lags + 1):
        for c in columns:
            keep(f"_d{j}_{c}", F.lag(f"_d_{c}", j).over(w))
    for c in columns:
        keep(f"_l_{c}", F.lag(c, max(lags, 1)).over(w))
    total = rows.groupBy(*keys).agg(F.count("*").alias("n"))
    cells = [F.covar_pop(a, b) for i, a in enumerate(names) for b in names[i:]]
    sums = rows.dropna(subset=names).groupBy(*keys).agg(F.count("*").alias("rows"), F.array(*cells).alias("cov"))

    @F.pandas_udf("struct<trace:array<double>, largest:array<double>>")
    def solve(cov: pd.Series, count: pd.Series) -> pd.DataFrame:
        out = []
        for c, m in zip(cov, count, strict=True):
            full = np.zeros((len(names), len(names)))
            full[np.triu_indices(len(names))] = c
            values = johansen_eigenvalues(full + np.triu(full, 1).T, k)
            out.append((None, None) if values is None else tuple(s.tolist() for s in johansen_statistics(values, int(m))))
        return pd.DataFrame(out, columns=["trace", "largest"])

    found = sums.withColumn("_s", solve("cov", "rows"))
    out = total.join(found, keys, "left").select(*keys, "n", F.when(C("n") >= LEAST, C("_s.trace")).alias("trace"), F.when(C("n") >= LEAST, C("_s.largest")).alias("largest"))
    out = out.withColumns({"trace_95": F.lit(TRACE_95[k]), "largest_95": F.lit(LARGEST_95[k])})
    return out.withColumn("cointegrated", (C("trace")[0] > C("trace_95")) & (C("largest")[0] > C("largest_95")))


def engle_granger(y: np.ndarray, x: np.ndarray, lags: int | None = None) -> tuple:
    """(n, hedge_ratio, intercept, statistic, lags, p_value, crit_1, crit_5, crit_10, half_life) of y on x by Engle and Granger: the residuals' unit-root test without a constant. Without
    variance of x nothing is found; residuals of almost nothing have the statistic minus infinity."""
    n, dx, dy = len(x), x - x.mean(), y - y.mean()
    if not dx @ dx > 0:
        return n, 0.0, 0.0, 0.0, 0, 1.0, 0.0, 0.0, 0.0, math.inf
    beta = float(dx @ dy / (dx @ dx))
    e = dy - beta * dx
    d, before = np.diff(e), e[:-1] - e[:-1].mean()
    slope = float(before @ d / (before @ before)) if before @ before > 0 else 0.0
    half = math.log(2) / -math.log1p(slope) if -1 < slope < 0 else math.inf
    if e @ e <= 100 * 2**-26 * (dy @ dy):
        stat, used, p = -math.inf, 0, 0.0
    else:
        stat, used, _ = dickey_fuller(e, constant=False, lags=lags)
        p = p_value(stat, 2)
    return n, beta, float(y.mean() - beta * x.mean()), stat, used, p, *critical_values(n - 1, 2), half


def pair_moments(y: np.ndarray, x: np.ndarray, lags: int = 1) -> tuple[np.ndarray, int]:
    """(covariances for johansen_eigenvalues, rows) of two series."""
    d = np.diff(np.stack([y, x]), axis=1)
    n = d.shape[1]
    v = np.concatenate([d[:, lags:], *(d[:, lags - j : n - j] for j in range(1, lags + 1)), np.stack([y, x])[:, 1 : n + 1 - lags]])
    return np.cov(v, bias=True), v.shape[1]


_PAIR = "n long, hedge_ratio double, intercept double, statistic double, lags int, p_value double, crit_1 double, crit_5 double, crit_10 double, half_life double, trace double, largest double, cointegrated boolean"


def screen_pairs(df: DataFrame, column: str = "close", *, method: str = "engle_granger", alpha: float = 0.05, half_lives: tuple[float, float] = (1.0, 126.0), lags: int | None = None, block: int = 32) -> DataFrame:
    """y, x, n, hedge_ratio, intercept, statistic, lags, p_value, crit_1, crit_5, crit_10, half_life, trace, largest and cointegrated of all pairs of symbols y < x with 30 times or more in
    common.

    Cointegrated: the residuals' test rejects at alpha (engle_granger), or both statistics of Johansen's exceed their 95 % values (johansen), and the half-life of the spread is within
    half_lives. A task holds two blocks of about `block` series, 16 bytes a value."""
    if method not in ("engle_granger", "johansen"):
        raise ValueError(method)
    ok = df.where(C(column).isNotNull() & ~F.isnan(column) & (F.abs(column) < float("inf")) & C("symbol").isNotNull())
    series = ok.groupBy("symbol").agg(F.array_sort(F.collect_list(F.struct(F.unix_micros(C("ts").cast("timestamp")).alias("t"), C(column).cast("double").alias("v")))).alias("s"))
    series = series.select("symbol", C("s.t").alias("t"), C("s.v").alias("v"))
    blocks = F.ceil(F.count("*").over(Window.partitionBy(F.lit(0))) / block).cast("int")
    # one row for each symbol, without its values, stands in that window
    sized = ok.select("symbol").distinct().select("symbol", blocks.alias("_blocks"))
    sized = sized.withColumn("_own", F.pmod(F.xxhash64("symbol"), "_blocks").cast("int")).withColumn("_other", F.explode(F.sequence(F.lit(0), C("_blocks") - 1)))
    dealt = series.join(sized, "symbol").select("symbol", "t", "v", "_own", F.least("_own", "_other").alias("_i"), F.greatest("_own", "_other").alias("_j"))

    def run(group: pd.DataFrame) -> pd.DataFrame:
        i, j = group["_i"].iloc[0], group["_j"].iloc[0]
        rows = sorted(zip(group["symbol"], group["_own"], group["t"], group["v"], strict=True), key=lambda r: r[0])
        out = []
        for a, (name, own, t, v) in enumerate(rows):
            for other, its, u, z in rows[a + 1 :]:
                if {own, its} != {i, j}:
                    continue
                y, x = np.asarray(v, float), np.asarray(z, float)
                if not np.array_equal(t, u):
                    _, p, q = np.intersect1d(t, u, return_indices=True)
                    y, x = y[p], x[q]
                if len(y) < LEAST:
                    continue
                found = engle_granger(y, x, lags)
                cov, count = pair_moments(y, x)
                values = johansen_eigenvalues(cov, 2)
                trace, largest = (None, None) if values is None else (float(s[0]) for s in johansen_statistics(values, count))
                holds = found[5] <= alpha if method == "engle_granger" else trace is not None and trace > TRACE_95[2] and largest > LARGEST_95[2]
                out.append((name, other, *found, trace, largest, bool(holds and half_lives[0] <= found[-1] <= half_lives[1])))
        return pd.DataFrame(out, columns=["y", "x", *(c.split()[0] for c in _PAIR.split(", "))])

    kind = df.schema["symbol"].dataType.simpleString()
    return dealt.groupBy("_i", "_j").applyInPandas(run, f"y {kind}, x {kind}, {_PAIR}")
