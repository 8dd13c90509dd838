"""Allocation over several assets: risk contributions, equal risk, least variance, greatest Sharpe ratio, and their rebalancing along a series.

Times are rows with an array of all assets' returns. Every rebalancing is a row with the window of times before it, dealt out as its own group, so rebalancings are solved side by side, and
none sees its own or a later return. A group holds a window of `lookback` times.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

C = F.col
_FLOOR = 1e-12


def risk_contributions(weights: DataFrame, cov: DataFrame, keys: list[str]) -> DataFrame:
    """keys, symbol, weight, marginal (covariance with the whole over its deviation), contribution (weight times that) and share of the whole's variance, from weights(keys, symbol, weight) and cov(a, b, cov) with
    a <= b. Symbols without a covariance count as 0."""
    off = cov.where("a <> b")
    both = cov.select("a", "b", "cov").unionByName(off.select(C("b").alias("a"), C("a").alias("b"), "cov"))
    other = weights.select(*keys, C("symbol").alias("b"), C("weight").alias("_w"))
    with_whole = other.join(both, "b").groupBy(*keys, C("a").alias("symbol")).agg(F.sum(C("_w") * C("cov")).alias("_c"))
    out = weights.select(*keys, "symbol", "weight").join(with_whole, [*keys, "symbol"], "left").withColumn("_c", F.coalesce("_c", F.lit(0.0)))
    variance = F.greatest(F.lit(_FLOOR), F.sum(C("weight") * C("_c")).over(Window.partitionBy(*keys)))
    out = out.withColumn("_v", variance)
    return out.select(*keys, "symbol", "weight", (C("_c") / F.sqrt("_v")).alias("marginal"), (C("weight") * C("_c") / F.sqrt("_v")).alias("contribution"), (C("weight") * C("_c") / C("_v")).alias("share"))


def intensity(cov: np.ndarray, squares: float, n: int) -> float:
    """Ledoit and Wolf's shrinkage of a covariance (over n) towards its mean variance times the unit matrix; squares: the mean over time of the sum of all products of squared deviations."""
    p, trace = len(cov), np.trace(cov)
    mu, own = trace / p, float((cov**2).sum())
    beta, delta = (squares - own) / (p * n), (own - 2 * mu * trace + p * mu**2) / p
    beta = min(beta, delta)
    return 0.0 if beta <= 0 or delta <= 0 else beta / delta


def shrunk(x: np.ndarray) -> tuple[np.ndarray, float]:
    """(covariance, shrinkage) of x[time, asset]."""
    x = x - x.mean(0)
    cov = x.T @ x / len(x)
    s = intensity(cov, float(((x**2).sum(1) ** 2).mean()), len(x))
    return (1 - s) * cov + s * np.trace(cov) / len(cov) * np.eye(len(cov)), s


def covariance(x: np.ndarray, method: str = "ledoit_wolf", yearly: int = 252) -> tuple[np.ndarray, float | None]:
    """(yearly covariance, shrinkage or none) by 'ledoit_wolf' or 'sample'."""
    if method == "ledoit_wolf":
        cov, s = shrunk(x)
        return cov * yearly, s
    if method != "sample":
        raise ValueError(method)
    return np.atleast_2d(np.cov(x, rowvar=False)) * yearly, None


def onto_weights(w: np.ndarray, low: float, high: float) -> np.ndarray:
    """The nearest weights that sum to 1 and lie in [low, high], of every row; equal weights where no such weights exist."""
    n = w.shape[-1]
    if low * n > 1 or high * n < 1:
        return np.full_like(w, 1 / n)
    # the sum of the clipped weights falls piecewise linearly as all are lowered; it bends where one of them meets a bound
    bends = np.sort(np.concatenate([w - low, w - high], axis=-1), axis=-1)
    sums = np.clip(w[..., None, :] - bends[..., None], low, high).sum(-1)
    right = np.clip((sums >= 1).sum(-1, keepdims=True), 1, bends.shape[-1] - 1)
    x0, x1 = np.take_along_axis(bends, right - 1, -1), np.take_along_axis(bends, right, -1)
    y0, y1 = np.take_along_axis(sums, right - 1, -1), np.take_along_axis(sums, right, -1)
    down = x0 + (x1 - x0) * np.where(y0 > y1, (y0 - 1) / np.where(y0 > y1, y0 - y1, 1), 0)
    return np.clip(w - down, low, high)


def equal_risk(cov: np.ndarray, low: float = 1e-4, high: float = 1.0, budget: np.ndarray | None = None, rounds: int = 500, near: float = 1e-12) -> np.ndarray:
    """Weights [case, asset] with which every asset gives its budget's share (equal ones, if none is given) of the variance, of covariances [case, asset, asset].

    Coordinates in turn go to the least of w'Cw / 2 - sum of b ln w, all cases at once. Weights that come out beyond a bound stand at it, and the others share the rest in the same way."""
    cases, n = cov.shape[:2]
    b = np.full(n, 1 / n) if budget is None else np.asarray(budget, float) / np.sum(budget)
    if low * n > 1 or high * n < 1:
        return np.full((cases, n), 1 / n)
    var = np.maximum(np.einsum("cii->ci", cov), _FLOOR)
    free, fixed = np.ones((cases, n), bool), np.zeros((cases, n))
    weights = np.full((cases, n), 1 / n)
    for _ in range(n + 1):
        w = np.where(free, 1 / np.sqrt(var), 0.0)
        for _ in range(rounds):
            before = w.copy()
            for i in range(n):
                c = np.einsum("cj,cj->c", cov[:, i], w) - cov[:, i, i] * w[:, i]
                w[:, i] = np.where(free[:, i], (-c + np.sqrt(c * c + 4 * var[:, i] * b[i])) / (2 * var[:, i]), 0.0)
            if np.abs(w - before).max() <= near * np.abs(w).max():
                break
        total = w.sum(1, keepdims=True)
        weights = np.where(free, w / np.where(total > 0, total, 1) * (1 - fixed.sum(1, keepdims=True)), fixed)
        over, under = free & (weights > high + 1e-12), free & (weights < low - 1e-12)
        # the worse side first: what it gives or takes can bring the other back
        side = (np.where(over, weights - high, 0).sum(1) >= np.where(under, low - weights, 0).sum(1))[:, None]
        hit = np.where(side, over, under)
        if not hit.any():
            break
        fixed, free = np.where(hit, np.where(side, high, low), fixed), free & ~hit
    return onto_weights(weights, low, high)


def efficient(cov: np.ndarray, mean: np.ndarray, low: float, high: float, rounds: int = 2000) -> np.ndarray:
    """Weights [case, asset] of least w'Cw / 2 - mean'w within the bounds, by accelerated projected gradients."""
    step = 1 / np.maximum(np.linalg.eigvalsh(cov)[:, -1], _FLOOR)[:, None]
    w = onto_weights(np.full(mean.shape, 1 / mean.shape[1]), low, high)
    ahead, t = w, 1.0
    for _ in range(rounds):
        new = onto_weights(ahead - step * (np.einsum("cij,cj->ci", cov, ahead) - mean), low, high)
        nxt = (1 + np.sqrt(1 + 4 * t * t)) / 2
        if np.abs(new - w).max() < 1e-13:
            return new
        ahead, w, t = new + (t - 1) / nxt * (new - w), new, nxt
    return w


def least_variance(cov: np.ndarray, low: float = 0.0, high: float = 1.0) -> np.ndarray:
    scale = np.maximum(np.einsum("cii->c", cov) / cov.shape[1], _FLOOR)[:, None, None]
    return efficient(cov / scale, np.zeros(cov.shape[:2]), low, high)


def greatest_sharpe(cov: np.ndarray, mean: np.ndarray, low: float = 0.0, high: float = 1.0, free_rate: float = 0.0) -> np.ndarray:
    """Weights of the greatest (return - free_rate) / deviation: it lies on the frontier that weighs return against variance, so that weight is searched."""
    scale = np.maximum(np.einsum("cii->c", cov) / cov.shape[1], _FLOOR)[:, None, None]
    cov, mean = cov / scale, mean - free_rate
    unit = np.maximum(np.abs(mean).max(1, keepdims=True), _FLOOR)

    cases, n = mean.shape
    lo, hi = np.full(cases, -6.0), np.full(cases, 6.0)
    for _ in range(4):  # ever finer grids, all their points solved at once
        grid = np.linspace(lo, hi, 17)
        each = np.tile(cov, (len(grid), 1, 1))
        w = efficient(each, (mean / unit * np.exp(grid)[..., None]).reshape(-1, n), low, high).reshape(len(grid), cases, n)
        sharpe = (w * mean).sum(-1) / np.sqrt(np.maximum(np.einsum("gci,cij,gcj->gc", w, cov, w), _FLOOR))
        best = sharpe.argmax(0)
        lo, hi = (grid[np.clip(best + d, 0, len(grid) - 1), np.arange(cases)] for d in (-1, 1))
    return w[best, np.arange(cases)]


def by_time(ret: DataFrame, keys: list[str]) -> DataFrame:
    """keys, ts, names and r (returns in order of names), of the times at which all symbols of a key have a return."""
    ok = ret.where("ret IS NOT NULL AND NOT isnan(ret)")
    rows = ok.groupBy(*keys, "ts").agg(F.array_sort(F.collect_list(F.struct("symbol", "ret"))).alias("s"))
    total = ok.groupBy(*keys).agg(F.count_distinct("symbol").alias("_n"))
    return rows.join(total, keys).where("size(s) = _n").select(*keys, "ts", C("s.symbol").alias("names"), C("s.ret").alias("r"))


#: The last day of the period that a time lies in.
PERIOD_ENDS: dict[str, Callable[[Column], Column]] = {
    "week": lambda t: F.date_add(F.date_trunc("week", t), 6),
    "month": lambda t: F.last_day(t),
    "quarter": lambda t: F.date_add(F.add_months(F.date_trunc("quarter", t), 3), -1),
    "year": lambda t: F.make_date(F.year(t), F.lit(12), F.lit(31)),
}


def rebalances(rows: DataFrame, keys: list[str], lookback: int, period: str) -> DataFrame:
    """keys and nth of the rows(keys, ts, nth) at which weights are set: row `lookback`, and for every period with a later row the first row at or after its last day's start."""
    late = rows.where(C("nth") >= lookback).withColumn("_end", PERIOD_ENDS[period](C("ts")))
    each = late.groupBy(*keys, "_end").agg(F.min("nth").alias("_first"), F.min(F.when(C("ts") >= C("_end"), C("nth"))).alias("_at"))
    # where a period's last day has no row, the next period's first row is the first after it; a row for each period stands in that window
    after = F.coalesce("_at", F.lead("_first").over(Window.partitionBy(*keys).orderBy("_end")))
    first = late.where(C("nth") == lookback).select(*keys, "nth")
    return each.select(*keys, after.alias("nth")).where("nth IS NOT NULL").unionByName(first).distinct()


def rebalanced(ret: DataFrame, objective: str = "equal_risk", *, keys: list[str] | None = None, lookback: int = 126, period: str = "month", method: str = "ledoit_wolf", low: float | None = None, high: float = 0.5, free_rate: float = 0.0) -> DataFrame:
    """keys, nth, ts, set (weights are set at this row), names, weights, shrinkage (of the last setting) and ret (of the whole) of the rows of by_time() from row `lookback` on.

    objective: equal_risk, least_variance, or greatest_sharpe with the window's yearly mean returns. Weights rest on the `lookback` rows before they are set and hold until they are set again."""
    if objective not in ("equal_risk", "least_variance", "greatest_sharpe"):
        raise ValueError(objective)
    low = (1e-4 if objective == "equal_risk" else 0.0) if low is None else low
    one = keys is None
    keys = keys or ["_all"]
    wide = by_time(ret.withColumn("_all", F.lit(0)) if one else ret, keys)
    rows = wide.withColumn("nth", (F.row_number().over(Window.partitionBy(*keys).orderBy("ts")) - 1).cast("int"))
    when = rebalances(rows, keys, lookback, period).select(*keys, C("nth").alias("at"))
    # a window reaches over two stretches of `lookback` rows; both sides meet by key and stretch
    parts = when.withColumn("_part", F.explode(F.expr(f"sequence((at - {lookback}) div {lookback}, (at - 1) div {lookback})")))
    seen = rows.withColumn("_part", F.expr(f"nth div {lookback}").cast("int")).join(parts.withColumn("_part", C("_part").cast("int")), [*keys, "_part"]).where(f"nth >= at - {lookback} AND nth < at")
    windows = seen.groupBy(*keys, "at").agg(F.transform(F.array_sort(F.collect_list(F.struct("nth", "r"))), lambda s: s["r"]).alias("x"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = batch[[*keys, "at"]].copy()
            got = []
            for x in batch["x"]:
                x = np.array([list(r) for r in x], float)
                cov, s = covariance(x, method)
                mean = x.mean(0)[None] * 252
                w = equal_risk(cov[None], low, high) if objective == "equal_risk" else least_variance(cov[None], low, high) if objective == "least_variance" else greatest_sharpe(cov[None], mean, low, high, free_rate)
                got.append((w[0].tolist(), s))
            out["weights"], out["shrinkage"] = [g[0] for g in got], pd.Series([g[1] for g in got], dtype=object, index=out.index)
            yield out

    kinds = ", ".join(f"{c} {rows.schema[c].dataType.simpleString()}" for c in keys)
    solved = windows.repartition(*keys, "at").mapInPandas(run, f"{kinds}, at int, weights array<double>, shrinkage double")
    held = F.last(C("at"), ignorenulls=True).over(Window.partitionBy(*keys).orderBy("nth").rowsBetween(Window.unboundedPreceding, 0))
    marked = rows.join(when.withColumn("nth", C("at")), [*keys, "nth"], "left").withColumn("set", C("at").isNotNull()).withColumn("at", held).where("at IS NOT NULL")
    value = F.aggregate(F.zip_with("weights", "r", lambda w, r: w * r), F.lit(0.0), lambda a, x: a + x)
    out = marked.join(solved, [*keys, "at"]).select(*keys, "nth", "ts", "set", "names", "weights", "shrinkage", value.alias("ret"))
    return out.drop("_all") if one else out


def moments(wide: DataFrame) -> DataFrame:
    """a, b, n, mean_a, cov (over n) and squares (mean product of squared deviations) of all ordered pairs of symbols of by_time()'s rows. The means come first; then every task adds up
    the products of its own times as matrices, and only assets by assets numbers of each task are shuffled."""
    means = {s: m for s, m in wide.select(F.explode(F.arrays_zip("names", "r")).alias("p")).groupBy("p.names").agg(F.avg("p.r")).collect()}

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total: dict[tuple, list] = {}
        for batch in batches:
            for names, own in batch.groupby(batch["names"].map(tuple)):
                x = np.array([list(r) for r in own["r"]], float) - np.array([means[s] for s in names])
                kept = total.setdefault(names, [0, 0.0, 0.0])
                kept[0], kept[1], kept[2] = kept[0] + len(x), kept[1] + x.T @ x, kept[2] + (x**2).T @ (x**2)
        for names, (n, products, squares) in total.items():
            a, b = np.meshgrid(np.array(names, object), np.array(names, object), indexing="ij")
            yield pd.DataFrame({"a": a.ravel(), "b": b.ravel(), "n": n, "p": products.ravel(), "q": squares.ravel(), "mean_a": [means[s] for s in a.ravel()]})

    kind = wide.schema["names"].dataType.elementType.simpleString()
    parts = wide.select("names", "r").mapInPandas(run, f"a {kind}, b {kind}, n long, p double, q double, mean_a double")
    return parts.groupBy("a", "b").agg(F.sum("n").alias("n"), F.first("mean_a").alias("mean_a"), (F.sum("p") / F.sum("n")).alias("cov"), (F.sum("q") / F.sum("n")).alias("squares"))


def compared(ret: DataFrame, *, method: str = "ledoit_wolf", high: float = 0.5, free_rate: float = 0.0, yearly: int = 252) -> DataFrame:
    """strategy, symbol, weight, share (of the variance), and expected (yearly return), deviation and sharpe of the whole, of equal weights, least variance, greatest Sharpe ratio and equal
    risk over all times at which all symbols have a return. Only the moments, assets by assets numbers, meet in one task."""

    def run(group: pd.DataFrame) -> pd.DataFrame:
        names, n = sorted(group["a"].unique()), int(group["n"].iloc[0])
        cov = group.pivot(index="a", columns="b", values="cov").loc[names, names].to_numpy(float)
        mean = group.drop_duplicates("a").set_index("a").loc[names, "mean_a"].to_numpy(float) * yearly
        if method == "ledoit_wolf":
            s = intensity(cov, float(group["squares"].sum()), n)
            cov = (1 - s) * cov + s * np.trace(cov) / len(cov) * np.eye(len(cov))
        else:
            cov = cov * n / max(1, n - 1)
        cov, p, out = cov * yearly, len(names), []
        for strategy, w in (("equal", np.full(p, 1 / p)), ("least_variance", least_variance(cov[None], 0.0, high)[0]), ("greatest_sharpe", greatest_sharpe(cov[None], mean[None], 0.0, high, free_rate)[0]), ("equal_risk", equal_risk(cov[None], 1e-4, high)[0])):
            var = max(float(w @ cov @ w), _FLOOR)
            out += [(strategy, s, a, a * c / var, float(w @ mean), var**0.5, (float(w @ mean) - free_rate) / var**0.5) for s, a, c in zip(names, w, cov @ w, strict=True)]
        return pd.DataFrame(out, columns=["strategy", "symbol", "weight", "share", "expected", "deviation", "sharpe"])

    kind = ret.schema["symbol"].dataType.simpleString()
    found = moments(by_time(ret.withColumn("_all", F.lit(0)), ["_all"])).withColumn("_all", F.lit(0))
    return found.groupBy("_all").applyInPandas(run, f"strategy string, symbol {kind}, weight double, share double, expected double, deviation double, sharpe double")
