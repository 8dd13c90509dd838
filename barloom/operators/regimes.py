"""Regimes of return and volatility: Gaussian hidden Markov models and mixtures with full covariances, for many series at once.

A series, or the window of a refit, is a row with an array of its inputs; a task takes many of them together. The chain's messages are products of small
matrices, and products are associative: time is cut into chunks, the products within all chunks are formed side by side, then the chunks' products are passed on. So an
iteration of Baum-Welch takes about twice the square root of a series' length in steps, for all series of the batch at once. Inputs are standardised for the fit.

States are numbered by the variance of the volatility in them, so state 0 is the calm one.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from barloom.operators.volatility import refit_windows

C = F.col
#: Rows that a fit needs, rounds of expectation-maximisation at most, and the gain in log-likelihood at which it ends.
LEAST, ROUNDS, NEAR = 60, 150, 1e-5
_PARTS = ("start", "trans", "means", "covs")
_MODEL = "n int, loglik double, " + ", ".join(f"{c} array<double>" for c in _PARTS)


def inputs(bars: DataFrame, window: int = 20, yearly: int = 252) -> DataFrame:
    """symbol, ts, nth (row number from 0), ret (log return) and vol (yearly deviation of the last `window` returns, null before there are that many)."""
    w = Window.partitionBy("symbol").orderBy("ts")
    out = bars.select("symbol", "ts", (F.row_number().over(w) - 1).cast("int").alias("nth"), F.log(F.try_divide(C("close"), F.lag("close").over(w))).alias("ret"))
    near = w.rowsBetween(-(window - 1), 0)
    return out.withColumn("vol", F.when(F.count("ret").over(near) == window, F.stddev_samp("ret").over(near) * math.sqrt(yearly)))


def _products(m: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(products m[0] .. m[t] for every t, scaled to a greatest entry of 1, and the logs of the scales) of m[series, time, k, k], in chunks of time."""
    b, t, k, _ = m.shape
    size = max(1, math.isqrt(t))
    chunks = -(-t // size)
    full = np.broadcast_to(np.eye(k), (b, chunks * size, k, k)).copy()
    full[:, :t] = m
    full = full.reshape(b, chunks, size, k, k)
    out, log = np.empty_like(full), np.zeros((b, chunks, size))

    def scaled(p: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        top = np.maximum(p.max((-1, -2)), 1e-300)
        return p / top[..., None, None], np.log(top)

    out[:, :, 0], log[:, :, 0] = scaled(full[:, :, 0])
    for j in range(1, size):
        out[:, :, j], more = scaled(out[:, :, j - 1] @ full[:, :, j])
        log[:, :, j] = log[:, :, j - 1] + more
    for c in range(1, chunks):
        joined, more = scaled(out[:, c - 1, -1:] @ out[:, c])
        out[:, c], log[:, c] = joined, log[:, c] + more + log[:, c - 1, -1:]
    return out.reshape(b, -1, k, k)[:, :t], log.reshape(b, -1)[:, :t]


def densities(x: np.ndarray, means: np.ndarray, covs: np.ndarray) -> np.ndarray:
    """Log densities [series, time, state] of x[series, time, dimension] under means[series, state, dimension] and covs[series, state, dimension, dimension]."""
    off = x[:, :, None] - means[:, None]
    inverse, (_, log_det) = np.linalg.inv(covs), np.linalg.slogdet(covs)
    return -0.5 * (np.einsum("btki,bkij,btkj->btk", off, inverse, off, optimize=True) + log_det[:, None] + x.shape[2] * math.log(2 * math.pi))


def forward(start: np.ndarray, trans: np.ndarray, log_b: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(filtered probabilities [series, time, state], log-likelihoods) of chains, given log densities; only the first `size` times of a series count."""
    top = log_b.max(2)
    b = np.exp(log_b - top[..., None])
    live = np.arange(b.shape[1]) < size[:, None]
    m = trans[:, None] * b[:, :, None, :]
    m[:, 0] = np.eye(trans.shape[1]) * b[:, 0, None, :]
    m = np.where(live[..., None, None], m, np.eye(trans.shape[1]))
    p, log = _products(m)
    a = np.einsum("bk,btkj->btj", start, p)
    total = np.maximum(a.sum(2), 1e-300)
    last = (np.arange(len(size)), size - 1)
    return a / total[..., None], np.log(total[last]) + log[last] + np.where(live, top, 0).sum(1)


def backward(trans: np.ndarray, log_b: np.ndarray, size: np.ndarray) -> np.ndarray:
    """What follows: [series, time, state], each time's scaled to a greatest value of 1."""
    b = np.exp(log_b - log_b.max(2)[..., None])
    n, t, k = b.shape
    after = np.arange(t) < size[:, None] - 1
    m = np.broadcast_to(np.eye(k), (n, t, k, k)).copy()
    m[:, :-1] = np.where(after[:, :-1, None, None], trans[:, None] * b[:, 1:, None, :], np.eye(k))
    # products from time t to the end: those of the reversed, transposed chain
    p, _ = _products(m[:, ::-1].transpose(0, 1, 3, 2))
    out = p.sum(2)[:, ::-1]
    return out / np.maximum(out.max(2, keepdims=True), 1e-300)


def posteriors(start: np.ndarray, trans: np.ndarray, log_b: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(probabilities of states given the whole series, expected transitions [series, state, state], log-likelihoods)."""
    a, loglik = forward(start, trans, log_b, size)
    b = backward(trans, log_b, size)
    both = a * b
    both /= np.maximum(both.sum(2, keepdims=True), 1e-300)
    emitted = np.exp(log_b - log_b.max(2)[..., None]) * b
    pair = a[:, :-1, :, None] * trans[:, None] * emitted[:, 1:, None, :]
    pair /= np.maximum(pair.sum((2, 3), keepdims=True), 1e-300)
    inside = np.arange(1, a.shape[1]) < size[:, None]
    return both, (pair * inside[..., None, None]).sum(1), loglik


def best_path(start: np.ndarray, trans: np.ndarray, log_b: np.ndarray) -> np.ndarray:
    """The likeliest states of one series [time, state] (Viterbi); ties go to the lower state."""
    with np.errstate(divide="ignore"):
        steps, score = np.log(trans), np.log(start) + log_b[0]
    back = np.zeros(log_b.shape, int)
    for t in range(1, len(log_b)):
        ways = score[:, None] + steps
        back[t] = ways.argmax(0)
        score = ways.max(0) + log_b[t]
    path = np.empty(len(log_b), int)
    path[-1] = score.argmax()
    for t in range(len(log_b) - 1, 0, -1):
        path[t - 1] = back[t, path[t]]
    return path


def _grown(x: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Means and covariances of x[series, time, dimension] by weight[series, time, state]; directions of no variance get a little."""
    total = np.maximum(weight.sum(1), 1e-9)
    means = np.einsum("btk,bti->bki", weight, x, optimize=True) / total[..., None]
    off = x[:, :, None] - means[:, None]
    covs = np.einsum("btk,btki,btkj->bkij", weight, off, off, optimize=True) / total[..., None, None]
    value, vector = np.linalg.eigh(covs)
    thin = (value < 1e-6).any(-1)
    if thin.any():
        mended = np.einsum("bkij,bkj,bklj->bkil", vector, np.maximum(value, 1e-6), vector)
        covs = np.where(thin[..., None, None], mended, covs)
    return means, covs


def em(x: np.ndarray, size: np.ndarray, k: int, chain: bool, rounds: int = ROUNDS, near: float = NEAR) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, list[np.ndarray]]:
    """(start, trans, means, covs, log-likelihoods round by round) of a hidden Markov model (chain) or a mixture for every series x[series, time, dimension]. It starts from parts of
    equal size by the last dimension. A series whose likelihood no longer rises keeps its parameters, so it ends alike whatever is fitted beside it."""
    b, t, _ = x.shape
    live = np.arange(t) < size[:, None]
    rank = np.argsort(np.argsort(np.where(live, x[..., -1], np.inf), axis=1, kind="stable"), axis=1, kind="stable")
    part = np.minimum(rank * k // np.maximum(size[:, None], 1), k - 1)
    weight = (part[..., None] == np.arange(k)) * live[..., None].astype(float)
    means, covs = _grown(x, weight)
    start = np.full((b, k), 1 / k)
    trans = np.full((b, k, k), 0.1 / max(1, k - 1)) + np.eye(k) * (0.9 - 0.1 / max(1, k - 1)) if k > 1 else np.ones((b, 1, 1))
    going, before, told = np.arange(b), np.full(b, -np.inf), []
    final = [start.copy(), trans.copy(), means.copy(), covs.copy()]
    for _ in range(rounds):
        own, n = x[going], size[going]
        log_b = densities(own, means, covs)
        if chain:
            weight, pairs, loglik = posteriors(start, trans, log_b, n)
        else:
            with np.errstate(divide="ignore"):
                joint = np.log(start)[:, None] + log_b
            top = joint.max(2, keepdims=True)
            weight = np.exp(joint - top)
            loglik = np.where(live[going], np.log(weight.sum(2)) + top[..., 0], 0).sum(1)
            weight /= weight.sum(2, keepdims=True)
        for kept, now in zip(final, (start, trans, means, covs), strict=True):
            kept[going] = now
        gain = loglik - before[going]
        told.append(np.where(np.isin(np.arange(b), going), 0.0, np.nan))
        told[-1][going] = loglik
        before[going] = loglik
        more = gain > near
        if not more.any():
            break
        going, weight = going[more], weight[more] * live[going[more]][..., None]
        if chain:
            start, pairs = weight[:, 0], pairs[more]
            trans = pairs / np.maximum(pairs.sum(2, keepdims=True), 1e-300)
            trans = np.where(pairs.sum(2, keepdims=True) > 1e-12, trans, 1 / k)
        else:
            start = weight.sum(1) / size[going][:, None]
            trans = np.repeat(start[:, None], k, axis=1)
        means, covs = _grown(x[going], weight)
    return *final, told


def fit_many(series: list[np.ndarray], k: int = 2, method: str = "hmm") -> list[tuple[float, np.ndarray, np.ndarray, np.ndarray, np.ndarray] | None]:
    """(log-likelihood, start, trans, means, covs) of every series [time, dimension], states in order of the last dimension's variance; none for one of under LEAST rows or without variance in a
    dimension."""
    out: list = [None] * len(series)
    series = [np.asarray(s, float).reshape(len(s), -1) for s in series]
    good = [i for i, s in enumerate(series) if len(s) >= LEAST and np.isfinite(s).all() and (s.std(0) > 1e-12 * (1 + np.abs(s).max(0))).all()]
    good.sort(key=lambda i: len(series[i]))
    for lo in range(0, len(good), 64):
        some = good[lo : lo + 64]
        size = np.array([len(series[i]) for i in some])
        centre, width = np.stack([series[i].mean(0) for i in some]), np.stack([series[i].std(0) for i in some])
        x = np.zeros((len(some), size.max(), centre.shape[1]))
        for j, i in enumerate(some):
            x[j, : size[j]] = (series[i] - centre[j]) / width[j]
        start, trans, means, covs, told = em(x, size, k, method == "hmm")
        loglik = np.nanmax(np.stack(told), axis=0) - size * np.log(width).sum(1)
        for j, i in enumerate(some):
            by = np.argsort(covs[j, :, -1, -1], kind="stable")
            out[i] = (float(loglik[j]), start[j, by], trans[j][np.ix_(by, by)], means[j, by] * width[j] + centre[j], covs[j, by] * np.outer(width[j], width[j]))
    return out


def _points(x) -> np.ndarray:
    return np.array([(r["ret"], r["vol"]) for r in x], float).reshape(-1, 2)


def _unpacked(r) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    k = len(r.start)
    return np.asarray(r.start, float)[None], np.reshape(r.trans, (1, k, k)).astype(float), np.reshape(r.means, (1, k, -1)).astype(float), np.reshape(r.covs, (1, k, len(r.means) // k, -1)).astype(float)


def _fits(series: DataFrame, keys: list[str], k: int, method: str) -> DataFrame:
    """keys, n, loglik, start, trans, means and covs (row by row) of every row's array x."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            got = fit_many([_points(x) for x in batch["x"]], k, method)
            out = batch[keys].reset_index(drop=True)
            out["n"] = [len(x) for x in batch["x"]]
            out["loglik"] = pd.Series([g and g[0] for g in got], dtype=object)
            for c, part in enumerate(_PARTS, 1):
                out[part] = pd.Series([g and g[c].ravel().tolist() for g in got], dtype=object)
            yield out

    kinds = [f"{c} {series.schema[c].dataType.simpleString()}" for c in keys]
    return series.repartition(*keys).mapInPandas(run, ", ".join([*kinds, _MODEL]))


def _series(rows: DataFrame) -> DataFrame:
    ok = rows.where("ret IS NOT NULL AND vol IS NOT NULL AND NOT isnan(ret) AND NOT isnan(vol)")
    return ok.groupBy("symbol").agg(F.array_sort(F.collect_list(F.struct("ts", "ret", "vol"))).alias("x"))


def fit(rows: DataFrame, k: int = 2, method: str = "hmm") -> DataFrame:
    """symbol, n, loglik, start, trans, means, covs of a model of k states ('hmm' or 'gmm') over inputs() rows; null figures for symbols of under 60 rows. A task holds whole
    series, some dozen bytes a bar and state."""
    return _fits(_series(rows), ["symbol"], k, method)


def decode(rows: DataFrame, models: DataFrame, *, smooth: bool = True) -> DataFrame:
    """symbol, ts, label and probs of inputs() rows by the model of their symbol: given the whole series, with the likeliest path as labels, or (smooth off) given the rows up to each, with the
    likeliest state."""
    joined = _series(rows).join(models.where("start IS NOT NULL").select("symbol", *_PARTS), "symbol")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for r in batch.itertuples():
                start, trans, means, covs = _unpacked(r)
                log_b, size = densities(_points(r.x)[None], means, covs), np.array([len(r.x)])
                if smooth:
                    probs, label = posteriors(start, trans, log_b, size)[0][0], best_path(start[0], trans[0], log_b[0])
                else:
                    probs = forward(start, trans, log_b, size)[0][0]
                    label = probs.argmax(1)
                yield pd.DataFrame({"symbol": r.symbol, "ts": [s["ts"] for s in r.x], "label": label.astype("int32"), "probs": list(probs)})

    kinds = {f.name: f.dataType.simpleString() for f in rows.schema.fields}
    return joined.mapInPandas(run, f"symbol {kinds['symbol']}, ts {kinds['ts']}, label int, probs array<double>")


def rolling(bars: DataFrame, *, window: int = 252, every: int = 20, k: int = 2, method: str = "hmm", vol_window: int = 20, alone: bool = False) -> DataFrame:
    """symbol, ts, regime_label, regime_probs and regime_entropy of every bar, from models that are refitted every `every` bars on the `window` bars before.

    A row's probabilities are filtered ones: of the model fitted before its block, over that window and the block up to the row. alone: of the row without those before it. Nothing looks
    ahead. Where a refit fails, the model before it goes on; rows without a model or inputs are null."""
    if window < 60:
        raise ValueError("a window needs 60 bars")
    rows = inputs(bars, vol_window)
    value = F.struct("ret", "vol")
    windows = refit_windows(rows, value, window, every, skip=vol_window).withColumn("x", F.filter("x", lambda v: v["ret"].isNotNull() & v["vol"].isNotNull() & ~F.isnan(v["ret"]) & ~F.isnan(v["vol"])))
    fits = _fits(windows, ["symbol", "refit"], k, method)
    by = Window.partitionBy("symbol").orderBy("refit").rowsBetween(Window.unboundedPreceding, 0)
    model = F.when(C("start").isNotNull(), F.struct(*_PARTS))
    used = fits.select("symbol", "refit", F.last(model, ignorenulls=True).over(by).alias("m")).where("m IS NOT NULL")
    block = (window + F.floor((C("nth") - window) / every) * every).cast("int").alias("refit")
    blocks = rows.where((C("nth") >= window) & C("ret").isNotNull() & C("vol").isNotNull()).groupBy("symbol", block).agg(F.array_sort(F.collect_list(F.struct("ts", "ret", "vol"))).alias("rows"))
    todo = blocks.join(windows, ["symbol", "refit"]).join(used, ["symbol", "refit"]).select("symbol", "rows", "x", "m.*")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for r in batch.itertuples():
                start, trans, means, covs = _unpacked(r)
                own, seen = _points(r.rows), _points(r.x)
                if alone or method == "gmm":
                    joint = np.log(np.maximum(start[0], 1e-300)) + densities(own[None], means, covs)[0]
                    probs = np.exp(joint - joint.max(1, keepdims=True))
                    probs /= probs.sum(1, keepdims=True)
                else:
                    x = np.concatenate([seen, own])
                    probs = forward(start, trans, densities(x[None], means, covs), np.array([len(x)]))[0][0, len(seen) :]
                yield pd.DataFrame({"symbol": r.symbol, "ts": [v["ts"] for v in r.rows], "regime_label": probs.argmax(1).astype("int32"), "regime_probs": list(probs)})

    kinds = {f.name: f.dataType.simpleString() for f in bars.schema.fields}
    told = todo.mapInPandas(run, f"symbol {kinds['symbol']}, ts {kinds['ts']}, regime_label int, regime_probs array<double>")
    entropy = F.aggregate("regime_probs", F.lit(0.0), lambda a, p: a - F.when(p > 0, p * F.log(p)).otherwise(0.0))
    return bars.select("symbol", "ts").join(told, ["symbol", "ts"], "left").withColumn("regime_entropy", F.when(C("regime_probs").isNotNull(), entropy))


def regime_features(bars: DataFrame, **options) -> DataFrame:
    """symbol, ts, regime_label, regime_prob_0, .. and regime_entropy, by rolling()."""
    k = options.get("k", 2)
    return rolling(bars, **options).select("symbol", "ts", "regime_label", *(C("regime_probs")[i].alias(f"regime_prob_{i}") for i in range(k)), "regime_entropy")
