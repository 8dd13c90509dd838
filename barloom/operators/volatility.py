"""Conditional variance models: fits by maximum likelihood, selection, forecasts, and refits along a series.

A series is a row with an array of its returns; a task takes many of them as one padded matrix. The variance recursion then runs once over time for all series and
all candidate parameters of the search together, so a step costs the same for one series as for a thousand. Rolling refits are rows too: every return is dealt to the windows
that hold it, so the refits of one symbol are fitted side by side, and none of them sees a later return.

The models, of 100 times the return less its mean, e, with variance v and z = e / sqrt(v):

* garch: v' = omega + alpha e^2 + beta v
* gjr: v' = omega + (alpha + gamma (e < 0)) e^2 + beta v
* egarch: ln v' = omega + alpha (|z| - sqrt(2 / pi)) + gamma z + beta ln v

Before the first return stands a variance of the first 75 squared deviations, with weights that fall by 0.94 each.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barloom.operators import diagnostics

C = F.col
MODELS = ("garch", "gjr", "egarch")
#: Free parameters of each model, the mean with them; returns that a fit needs.
FREE, LEAST = {"garch": 4, "gjr": 5, "egarch": 5}, 30
SCALE = 100.0
_MEAN_ABS = math.sqrt(2 / math.pi)
_MOST_LOG = 50.0
_NAMES = ("mu", "omega", "alpha", "gamma", "beta")
_FITTED = "loglik double, " + ", ".join(f"{c} double" for c in _NAMES) + ", next_variance double"


def _logistic(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def natural(model: str, theta: np.ndarray, mean: np.ndarray, var: np.ndarray) -> np.ndarray:
    """(mu, omega, alpha, gamma, beta) along the first axis, of free numbers around a sample's mean and variance: positive where they must be, and stationary."""
    mu, w = mean + np.sqrt(var) * theta[0], np.clip(theta[1], -_MOST_LOG, _MOST_LOG)
    if model == "egarch":
        beta = np.tanh(theta[4])
        return np.stack([mu, w + np.log(var) * (1 - beta), theta[2], theta[3], beta])
    persistence = _logistic(theta[2])
    if model == "garch":
        share = _logistic(theta[3])
        return np.stack([mu, var * np.exp(w), persistence * share, np.zeros_like(mu), persistence * (1 - share)])
    up, down = np.exp(np.clip(theta[3], -30, 30)), np.exp(np.clip(theta[4], -30, 30))
    each = persistence / (1 + up + down)
    return np.stack([mu, var * np.exp(w), 2 * each * up, 2 * each * (down - up), each])


def persistence(model: Column, alpha: Column, gamma: Column, beta: Column) -> Column:
    """How much of a shock to the variance is left after a bar; below 1 for stationary models."""
    return F.when(model == "egarch", F.abs(beta)).otherwise(alpha + beta + gamma / 2)


def variances(model: str, p: np.ndarray, x: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(v of every return, v of the bar after the last) of the series x[time, series] with `size` returns each and parameters p[5, ..., series]."""
    mu, omega, alpha, gamma, beta = p
    e = x[(slice(None), *[None] * (mu.ndim - 1))] - mu
    live = np.arange(len(x))[:, None] < size
    weights = 0.94 ** np.arange(min(75, len(x)))
    weights = weights[:, None] * live[: len(weights)]
    before = np.einsum("t...s,ts->...s", e[: len(weights)] ** 2, weights / np.maximum(weights.sum(0), 1e-300))
    v = np.empty((len(x) + 1, *mu.shape))
    with np.errstate(over="ignore", invalid="ignore", divide="ignore"):
        if model == "egarch":
            log = np.clip(omega + beta * np.log(np.maximum(before, 1e-12)), -_MOST_LOG, _MOST_LOG)
            v[0] = np.exp(log)
            for t in range(len(x)):
                z = e[t] / np.sqrt(v[t])
                log = np.clip(omega + alpha * (np.abs(z) - _MEAN_ABS) + gamma * z + beta * log, -_MOST_LOG, _MOST_LOG)
                v[t + 1] = np.exp(log)
        else:
            v[0] = omega + (alpha + gamma / 2 + beta) * before
            shock = (alpha + gamma * (e < 0)) * e**2 + omega
            for t in range(len(x)):
                np.multiply(beta, v[t], out=v[t + 1])
                v[t + 1] += shock[t]
    after = np.take_along_axis(v, np.broadcast_to(size, v.shape[1:])[None].astype(int), axis=0)[0]
    return v[:-1], after


def log_likelihood(model: str, p: np.ndarray, x: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Normal log-likelihoods of parameters p[5, ..., series]."""
    v, _ = variances(model, p, x, size)
    e = x[(slice(None), *[None] * (p.ndim - 2))] - p[0]
    live = np.arange(len(x))[:, None] < size
    with np.errstate(all="ignore"):
        each = np.log(2 * math.pi * v) + e**2 / v
        total = -0.5 * np.where(live[(slice(None), *[None] * (p.ndim - 2))], each, 0).sum(0)
    return np.where(np.isfinite(total), total, -1e300)


def starts(model: str) -> np.ndarray:
    """A grid of free numbers [parameter, candidate]."""
    grid = []
    for keeps in (0.3, 0.6, 0.85, 0.95, 0.985):
        for share in (0.03, 0.1, 0.25):
            odds = math.log(keeps / (1 - keeps))
            if model == "garch":
                grid.append((0, math.log(1 - keeps), odds, math.log(share / (1 - share))))
            elif model == "gjr":
                grid += [(0, math.log(1 - keeps), odds, math.log(share * up), math.log(share * (2 - up))) for up in (0.2, 1.0)]
            else:
                grid += [(0, 0, 3 * share, lean, math.atanh(keeps)) for lean in (0.0, -0.08)]
    return np.array(grid, float).T


#: Steps along a direction that are valued together, and the width of differences.
_STEPS, _WIDTH = np.array([4, 2, 1, 0.5, 0.25, 0.1, 0.03, 0.01, 1e-3, 1e-5]), 1e-4


def climb(f: Callable[[np.ndarray, np.ndarray], np.ndarray], start: np.ndarray, most: int = 150, near: float = 1e-10) -> tuple[np.ndarray, np.ndarray]:
    """Quasi-Newton ascent (BFGS, central differences) for many searches at once: the highest points of f and their values. start[parameter, search]; f takes
    [parameter, candidate, search] and the searches' numbers. All differences, and all steps along a direction, are valued in one call. Each search stops for itself, so it ends at
    the same point whatever runs beside it."""
    dims, n = start.shape
    point, top, live = start.copy(), f(start[:, None], np.arange(n))[0], np.arange(n)
    off = np.concatenate([np.eye(dims), -np.eye(dims)]).T[:, :, None] * _WIDTH

    def slope(x: np.ndarray, of: np.ndarray) -> np.ndarray:
        got = f(x[:, None] + off, of)
        return np.clip((got[:dims] - got[dims:]) / (2 * _WIDTH), -1e8, 1e8)

    g, h, fresh = slope(point, live), np.repeat(np.eye(dims)[None], n, 0), np.ones(n, bool)
    for _ in range(most):
        x, at = point[:, live], top[live]
        way = np.einsum("sij,js->is", h, g)
        uphill = (way * g).sum(0) > 0
        way = np.where(uphill, way, g)
        # the first step of a search is a small one
        way = way / np.maximum(1, np.abs(way).max(0) / np.where(fresh, 0.5, 3.0))
        tried = f(x[:, None] + _STEPS[None, :, None] * way[:, None], live)
        best = tried.argmax(0)
        gain = np.take_along_axis(tried, best[None], 0)[0] - at
        moved = gain > 0
        step = np.where(moved, _STEPS[best] * way, 0)
        point[:, live], top[live] = x + step, at + np.where(moved, gain, 0)
        done = np.where(moved, gain <= near * (1 + np.abs(at)), True) & fresh
        again = ~done & ((gain <= near * (1 + np.abs(at))) | ~uphill)
        new = np.zeros_like(g)
        new[:, ~done] = slope((x + step)[:, ~done], live[~done])
        y, sy = g - new, ((g - new) * step).sum(0)
        ok = moved & ~done & ~again & (sy > 1e-12)
        rho = 1 / np.where(ok, sy, 1)
        left = np.eye(dims)[None] - rho[:, None, None] * np.einsum("is,js->sij", step, y)
        h = np.where(ok[:, None, None], left @ h @ left.transpose(0, 2, 1) + rho[:, None, None] * np.einsum("is,js->sij", step, step), np.where(again[:, None, None], np.eye(dims), h))
        fresh, g = again, new
        live, h, g, fresh = live[~done], h[~done], g[:, ~done], fresh[~done]
        if not len(live):
            break
    return point, top


def _fit(model: str, x: np.ndarray, size: np.ndarray, mean: np.ndarray, var: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(natural parameters, log-likelihoods) of the series x[time, series]."""
    f = lambda theta, of: log_likelihood(model, natural(model, theta, mean[of], var[of]), x[:, of], size[of])
    grid = np.repeat(starts(model)[:, :, None], len(size), axis=2)
    if model == "gjr":  # the symmetric fit is one of its own
        p, _ = _fit("garch", x, size, mean, var)
        share, held = p[2] / np.maximum(p[2] + p[4], 1e-9), np.clip(p[2] + p[4], 1e-9, 1 - 1e-9)
        lean = np.log(np.clip(share / 2, 1e-9, 1) / np.clip(1 - share, 1e-9, 1))
        own = np.stack([(p[0] - mean) / np.sqrt(var), np.log(p[1] / var), np.log(held / (1 - held)), lean, lean])
        grid = np.concatenate([grid, own[:, None]], axis=1)
    at = f(grid, np.arange(len(size))).argmax(0)
    found, value = climb(f, np.take_along_axis(grid, np.broadcast_to(at, (len(grid), 1, len(at))), 1)[:, 0])
    return natural(model, found, mean, var), value


def fit_many(model: str, series: list[np.ndarray]) -> np.ndarray:
    """[series, 7]: log-likelihood, mu, omega, alpha, gamma, beta and the variance of the next bar; without numbers where a fit is impossible (fewer than LEAST
    returns, no variance)."""
    out = np.full((len(series), 7), np.nan)
    series = [np.asarray(s, float) * SCALE for s in series]
    good = [k for k, s in enumerate(series) if len(s) >= LEAST and np.isfinite(s).all() and s.var() > 1e-10]
    for lo in range(0, len(good), 256):
        some = good[lo : lo + 256]
        size = np.array([len(series[k]) for k in some])
        x = np.zeros((size.max(), len(some)))
        for c, k in enumerate(some):
            x[: size[c], c] = series[k]
        p, value = _fit(model, x, size, *(np.array([g(series[k]) for k in some]) for g in (np.mean, np.var)))
        out[some, 0], out[some, 1:6], out[some, 6] = value, p.T, variances(model, p, x, size)[1]
    return out


def _series(df: DataFrame, keys: list[str], column: str) -> DataFrame:
    """keys and x, the column's values in order of ts; nulls and values that are not finite are left out."""
    ok = df.where(C(column).isNotNull() & ~F.isnan(column) & (F.abs(column) < float("inf")))
    return ok.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct("ts", C(column).alias("x")))), lambda s: s["x"]).alias("x"))


def _fits(series: DataFrame, keys: list[str], models: tuple[str, ...]) -> DataFrame:
    """keys, model, n and what fit_many gives, of every row's array x and every model."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for model, own in batch.groupby("model"):
                made = pd.DataFrame(fit_many(model, list(own["x"])), columns=["loglik", *_NAMES, "next_variance"]).astype(object)
                yield pd.concat([own[[*keys, "model"]].reset_index(drop=True).assign(n=[len(s) for s in own["x"]]), made.where(made.notna(), None)], axis=1)

    kinds = [f"{k} {series.schema[k].dataType.simpleString()}" for k in keys]
    each = series.withColumn("model", F.explode(F.array(*map(F.lit, models)))).repartition(*keys, "model")
    return each.mapInPandas(run, ", ".join([*kinds, "model string, n int", _FITTED]))


def fit(ret: DataFrame, models: tuple[str, ...] = MODELS, *, column: str = "ret") -> DataFrame:
    """symbol, model, n, loglik, mu, omega, alpha, gamma, beta (of 100 times the returns), next_variance, aic, bic, persistence and stationary. A task holds whole series, eight bytes
    a bar; symbols of under 30 returns, or without variance, have null figures."""
    out = _fits(_series(ret, ["symbol"], column), ["symbol"], models)
    k = F.create_map(*[x for m in MODELS for x in (F.lit(m), F.lit(FREE[m]))])[C("model")]
    held = persistence(C("model"), C("alpha"), C("gamma"), C("beta"))
    return out.withColumns({"aic": 2 * k - 2 * C("loglik"), "bic": k * F.log("n") - 2 * C("loglik"), "persistence": held, "stationary": held < 1})


def filtered(ret: DataFrame, params: DataFrame, *, column: str = "ret") -> DataFrame:
    """symbol, model, ts, vol (conditional deviation of the returns) and z (standardised deviation from the mean) at the bars of ret, for each row (symbol, model, mu, omega, alpha, gamma,
    beta) of params; of parameters without numbers there is nothing."""
    ok = ret.where(C(column).isNotNull() & ~F.isnan(column) & (F.abs(column) < float("inf")))
    rows = ok.groupBy("symbol").agg(F.array_sort(F.collect_list(F.struct("ts", C(column).alias("x")))).alias("s")).join(params.dropna(subset=["omega"]), "symbol")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for r in batch.itertuples():
                x = np.asarray(r.x, float)[:, None] * SCALE
                p = np.array([r.mu, r.omega, r.alpha, r.gamma, r.beta], float)[:, None]
                v = variances(r.model, p, x, np.array([len(x)]))[0][:, 0]
                yield pd.DataFrame({"symbol": r.symbol, "model": r.model, "ts": r.at, "vol": np.sqrt(v) / SCALE, "z": (x[:, 0] - r.mu) / np.sqrt(v)})

    kinds = {f.name: f.dataType.simpleString() for f in ret.schema.fields}
    rows = rows.select("symbol", "model", *_NAMES, C("s.ts").alias("at"), C("s.x").alias("x"))
    return rows.mapInPandas(run, f"symbol {kinds['symbol']}, model string, ts {kinds['ts']}, vol double, z double")


def next_variance(model: Column, v: Column, e: Column, omega: Column, alpha: Column, gamma: Column, beta: Column) -> Column:
    """The variance after a bar of variance v and deviation e."""
    z = e / F.sqrt(v)
    log = omega + alpha * (F.abs(z) - _MEAN_ABS) + gamma * z + beta * F.log(v)
    return F.when(model == "egarch", F.exp(log)).otherwise(omega + (alpha + F.when(e < 0, gamma).otherwise(0.0)) * e * e + beta * v)


def leftover_effects(states: DataFrame, lags: int = 5) -> DataFrame:
    """symbol, model, lm, p_value and remaining (p below 0.05): whether filtered()'s standardised deviations still cluster."""
    z = states.select(F.struct("symbol", "model").alias("symbol"), "ts", C("z").alias("ret"))
    return diagnostics.arch_lm(z, lags).select("symbol.symbol", "symbol.model", "lm", "p_value", (C("p_value") < 0.05).alias("remaining"))


def select(fits: DataFrame, criterion: str = "aic") -> DataFrame:
    """The model of the least criterion for every symbol; ties by name."""
    w = Window.partitionBy("symbol").orderBy(C(criterion).isNull(), criterion, "model")
    return fits.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")


def _normal_below(x: Column) -> Column:
    return F.when(x < 0, diagnostics.two_sided(x) / 2).otherwise(1 - diagnostics.two_sided(x) / 2)


def forecast(fits: DataFrame, horizon: int = 5) -> DataFrame:
    """symbol, model, h and vol, the deviation expected h bars after the last, for h from 1 to `horizon`.

    garch and gjr go back to their long-run variance geometrically. For egarch the expectation of the variance is a product of moments of exp(b (alpha |z| + gamma z)),
    which are known for normal z, so nothing is drawn at random."""
    held = C("alpha") + C("beta") + C("gamma") / 2
    h = C("h")
    rows = fits.where("next_variance is not null").withColumn("h", F.explode(F.sequence(F.lit(1), F.lit(horizon))))
    steps = F.pow(held, h - 1)
    plain = C("next_variance") * steps + C("omega") * F.when(held == 1, h - 1).otherwise(F.try_divide(1 - steps, 1 - held))
    moment = F.lit(0.0)
    for i in range(horizon - 1):
        b = F.pow("beta", F.lit(i))
        up, down = b * (C("alpha") + C("gamma")), b * (C("alpha") - C("gamma"))
        one = F.log(F.exp(up * up / 2) * _normal_below(up) + F.exp(down * down / 2) * _normal_below(down)) - b * C("alpha") * _MEAN_ABS + b * C("omega")
        moment = moment + F.when(h - 1 > i, one).otherwise(0.0)
    own = F.exp(F.pow("beta", h - 1) * F.log("next_variance") + moment)
    return rows.select("symbol", "model", "h", (F.sqrt(F.when(C("model") == "egarch", own).otherwise(plain)) / SCALE).alias("vol"))


def refit_windows(rows: DataFrame, values: Column, window: int, every: int, skip: int = 0) -> DataFrame:
    """symbol, refit and x: the values, in order, of the `window` rows before each refit but for the first `skip` of them. rows(symbol, nth, ..) has its row numbers from 0; refits are
    at window, window + every, .. up to the last row. Each row is dealt to the refits that see it, so a group holds a window."""
    last = F.floor((C("_n") - 1 - window) / every)
    # row j is seen by refit i = window + k * every when i - window + skip <= j < i
    first, stop = F.greatest(F.lit(0), F.ceil((C("nth") + 1 - window) / every)), F.least(last, F.floor((C("nth") - skip) / every))
    sized = rows.withColumn("_n", F.count("*").over(Window.partitionBy("symbol")))
    dealt = sized.withColumns({"_first": first.cast("int"), "_stop": stop.cast("int")}).where("_first <= _stop").withColumn("_k", F.explode(F.sequence("_first", "_stop")))
    out = dealt.groupBy("symbol", (C("_k") * every + window).cast("int").alias("refit")).agg(F.array_sort(F.collect_list(F.struct("nth", values.alias("x")))).alias("_s"))
    return out.select("symbol", "refit", F.transform("_s", lambda s: s["x"]).alias("x"))


def rolling(ret: DataFrame, model: str = "garch", *, window: int = 252, every: int = 20, column: str = "ret", yearly: int = 252) -> DataFrame:
    """symbol, ts, garch_vol, garch_vol_annualized: at each bar the forecast that the last refit made for the bar after its window, so a value is
    held until the next refit and rests on earlier returns alone.

    A refit that fails takes the forecast of the one before; where there is none yet, the deviation of the 20 returns before the bar stands. The first `window` bars are null. Windows have 60
    bars or more."""
    if window < 60:
        raise ValueError("a window needs 60 bars")
    w = Window.partitionBy("symbol").orderBy("ts")
    rows = ret.select("symbol", "ts", C(column).alias("ret")).where("ret is not null").withColumn("nth", (F.row_number().over(w) - 1).cast("int"))
    fits = _fits(refit_windows(rows, C("ret"), window, every), ["symbol", "refit"], (model,))
    by = Window.partitionBy("symbol").orderBy("refit").rowsBetween(Window.unboundedPreceding, 0)
    told = fits.select("symbol", "refit", F.last(F.sqrt("next_variance") / SCALE, ignorenulls=True).over(by).alias("told"))
    at = F.when(C("nth") >= window, window + F.floor((C("nth") - window) / every) * every).cast("int")
    near = F.stddev_samp("ret").over(w.rowsBetween(-20, -1))
    out = rows.withColumns({"refit": at, "near": near}).join(told, ["symbol", "refit"], "left")
    vol = F.when(C("refit").isNotNull(), F.coalesce("told", "near"))
    return out.select("symbol", "ts", vol.alias("garch_vol"), (vol * math.sqrt(yearly)).alias("garch_vol_annualized"))


def garch_features(bars: DataFrame, model: str = "garch", *, window: int = 252, every: int = 20) -> DataFrame:
    """rolling() over the log returns of bars(symbol, ts, close); the first bar of a symbol, which has no return, is null."""
    w = Window.partitionBy("symbol").orderBy("ts")
    ret = bars.select("symbol", "ts", F.log(F.try_divide(C("close"), F.lag("close").over(w))).alias("ret"))
    return bars.select("symbol", "ts").join(rolling(ret, model, window=window, every=every), ["symbol", "ts"], "left")
