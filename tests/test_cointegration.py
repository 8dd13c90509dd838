import datetime as dt
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from barloom.operators import cointegration as co

AT = dt.datetime(2024, 1, 1)


def plain_adf(x, constant, lags=None):
    """Least squares for every number of lags."""
    x, n = np.asarray(x, float), len(x)
    d = np.diff(x)

    def fit(p, skip):
        y = d[skip:]
        cols = ([np.ones(len(y))] if constant else []) + [x[skip:-1]] + [d[skip - k : len(d) - k] for k in range(1, p + 1)]
        m = np.stack(cols, 1)
        b, *_ = np.linalg.lstsq(m, y, rcond=None)
        ssr = ((y - m @ b) ** 2).sum()
        se = np.sqrt(np.diag(np.linalg.inv(m.T @ m)) * ssr / (len(y) - m.shape[1]))
        return b[int(constant)] / se[int(constant)], len(y) * math.log(ssr / len(y)) + 2 * m.shape[1]

    if lags is None:
        most = min(n // 2 - constant - 1, math.ceil(12 * (n / 100) ** 0.25))
        lags = min(range(most + 1), key=lambda p: (fit(p, most)[1], p))
    return fit(lags, lags)[0], lags


def walk(n, seed, rho=1.0, start=50.0):
    rng, v, out = np.random.default_rng(seed), 0.0, []
    for _ in range(n):
        v = rho * v + rng.normal()
        out.append(start + v)
    return np.array(out)


@pytest.mark.parametrize("constant", [True, False])
@pytest.mark.parametrize("n,rho", [(40, 1.0), (300, 0.9), (720, 0.99)])
def test_dickey_fuller_equals_least_squares(constant, n, rho):
    for seed in range(5):
        x = walk(n, seed, rho, 50.0 if constant else 0.0)
        for lags in (None, 0, 3):
            got, want = co.dickey_fuller(x, constant=constant, lags=lags), plain_adf(x, constant, lags)
            assert got[1] == want[1] and abs(got[0] - want[0]) < 1e-6 * (1 + abs(want[0]))


def test_p_values():
    # published 5 % points of large samples have a p-value of about 5 %
    assert abs(co.p_value(-2.86154) - 0.05) < 0.001 and abs(co.p_value(-3.33613, 2) - 0.05) < 0.001 and abs(co.p_value(-3.43035) - 0.01) < 0.0005 and abs(co.p_value(-3.89644, 2) - 0.01) < 0.0005
    for series in (1, 2):
        p = [co.p_value(s, series) for s in np.linspace(-20, 4, 500)]
        assert p[0] == 0 and p[-1] == 1 and (np.diff(p) > -0.003).all()


def test_kpss_lags_follow_the_autocovariances():
    x = walk(500, 3)
    stat, lags = co.kpss(x)
    e = x - x.mean()
    assert lags > 10 and stat > 0.739 and co.kpss(np.random.default_rng(2).normal(size=500))[0] < 0.463
    long_run = sum((1 if k == 0 else 2 * (1 - k / (lags + 1))) * (e[k:] @ e[: 500 - k]) for k in range(lags + 1)) / 500
    assert abs(stat - (np.cumsum(e) ** 2).sum() / 500**2 / long_run) < 1e-9


def dense_johansen(y, lags):
    """Residuals of regressions and a general eigenproblem."""
    y = y - y.mean(0)
    d = np.diff(y, axis=0)
    now, level = d[lags:], y[: len(y) - lags][1:]
    z = np.concatenate([d[lags - j : len(d) - j] for j in range(1, lags + 1)], 1)
    off = lambda m: m - m.mean(0)
    now, level, z = off(now), off(level), off(z)
    left = lambda m: m - z @ np.linalg.lstsq(z, m, rcond=None)[0]
    r0, rk = left(now), left(level)
    t = len(r0)
    s00, skk, sk0 = r0.T @ r0 / t, rk.T @ rk / t, rk.T @ r0 / t
    g = np.sort(np.linalg.eigvals(np.linalg.inv(skk) @ sk0 @ np.linalg.inv(s00) @ sk0.T).real)[::-1]
    return -t * np.cumsum(np.log(1 - g)[::-1])[::-1], -t * np.log(1 - g)


def frame(spark, series):
    return spark.createDataFrame([(s, AT + dt.timedelta(hours=k), None if v is None else float(v)) for s, vs in series.items() for k, v in enumerate(vs)], "symbol string, ts timestamp_ntz, close double")


@pytest.mark.parametrize("lags", [1, 2])
def test_johansen_equals_the_dense_version(spark, lags):
    a = walk(200, 1)
    data = {"linked": np.stack([a, 2 * a + walk(200, 2, 0.5)], 1), "apart": np.stack([walk(200, 3), walk(200, 4)], 1), "short": np.stack([a, walk(200, 2)], 1)[:20], "same": np.stack([a, 2 * a], 1)}
    rows = spark.createDataFrame([(k, AT + dt.timedelta(hours=i), float(u), float(v)) for k, m in data.items() for i, (u, v) in enumerate(m)], "k string, ts timestamp_ntz, x double, y double")
    got = {r["k"]: r for r in co.johansen(rows, ["k"], ["x", "y"], lags).collect()}
    for k in ("linked", "apart"):
        trace, largest = dense_johansen(data[k], lags)
        assert np.allclose(got[k]["trace"], trace, rtol=1e-6) and np.allclose(got[k]["largest"], largest, rtol=1e-6)
    assert got["linked"]["cointegrated"] and not got["apart"]["cointegrated"] and got["short"]["trace"] is None and got["short"]["n"] == 20
    assert got["same"]["trace"] is None and got["same"]["n"] == 200


def test_three_series(spark):
    a = walk(300, 7)
    m = np.stack([a, a + walk(300, 8, 0.3), walk(300, 9)], 1)
    rows = spark.createDataFrame([("k", AT + dt.timedelta(hours=i), *map(float, r)) for i, r in enumerate(m)], "k string, ts timestamp_ntz, p double, q double, r double")
    got = co.johansen(rows, ["k"], ["p", "q", "r"]).first()
    trace, largest = dense_johansen(m, 1)
    assert np.allclose(got["trace"], trace) and np.allclose(got["largest"], largest) and got["cointegrated"]


@pytest.mark.parametrize("block", [32, 2])
def test_screening(spark, block):
    a = walk(300, 11)
    series = {"a": a, "b": 0.5 * a + 3 + walk(300, 12, 0.6), "c": walk(300, 13), "d": [5.0] * 300, "e": [*a[:40], *[None] * 260], "f": a[:29]}
    got = {(r["y"], r["x"]): r for r in co.screen_pairs(frame(spark, series), block=block).collect()}
    assert set(got) == {(p, q) for p in "abcde" for q in "abcde" if p < q}
    y, x = series["a"], np.asarray(series["b"])
    beta = np.cov(y, x)[0, 1] / np.var(x, ddof=1)
    e = y - beta * x - (y.mean() - beta * x.mean())
    stat, lags = plain_adf(e, False)
    slope = np.polyfit(e[:-1], np.diff(e), 1)[0]
    r = got["a", "b"]
    assert r["n"] == 300 and abs(r["hedge_ratio"] - beta) < 1e-9 and abs(r["statistic"] - stat) < 1e-6 and r["lags"] == lags and abs(r["half_life"] - math.log(2) / -math.log(1 + slope)) < 1e-9
    assert r["cointegrated"] and r["p_value"] < 0.01 and not got["a", "c"]["cointegrated"] and got["a", "d"]["p_value"] == 1.0
    assert abs(r["crit_5"] - (-3.33613 - 6.1101 / 299 - 6.823 / 299**2)) < 1e-12
    assert got["a", "e"]["n"] == 40 and got["a", "e"]["statistic"] == -math.inf
    trace, largest = dense_johansen(np.stack([y, x], 1), 1)
    assert np.isclose(r["trace"], trace[0]) and np.isclose(r["largest"], largest[0])
    by = {(r["y"], r["x"]): r["cointegrated"] for r in co.screen_pairs(frame(spark, series), method="johansen", block=block).collect()}
    assert by["a", "b"] and not by["a", "c"]
    with pytest.raises(ValueError):
        co.screen_pairs(frame(spark, series), method="other")


def test_screening_joins_no_times(spark):
    plan = co.screen_pairs(frame(spark, {"a": [1.0] * 40}))._jdf.queryExecution().executedPlan().toString()
    joined = [line for line in plan.splitlines() if "Join" in line]
    assert joined and all("ts" not in line.split("Join", 1)[1] for line in joined)
    assert co.screen_pairs(frame(spark, {"a": [1.0] * 40})).collect() == [] and co.screen_pairs(frame(spark, {"a": [1.0]}).limit(0)).collect() == []


def test_unit_roots(spark):
    series = {"walk": walk(400, 21), "noise": walk(400, 22, 0.2), "flat": [3.0] * 50, "few": [1.0, 2.0, 1.5] * 3, "gaps": [*walk(100, 23), None, float("nan")]}
    got = {r["symbol"]: r for r in co.unit_roots(frame(spark, series)).collect()}
    assert set(got) == {"walk", "noise", "flat", "gaps"}
    assert got["walk"]["verdict"] == "non-stationary" and got["noise"]["verdict"] == "stationary" and got["gaps"]["n"] == 100 and got["flat"]["adf"] is None
    stat, lags = plain_adf(series["walk"], True)
    assert abs(got["walk"]["adf"] - stat) < 1e-6 and got["walk"]["adf_lags"] == lags and got["walk"]["kpss_p"] == 0.01
    assert co.unit_roots(frame(spark, series).where(F.lit(False))).count() == 0
