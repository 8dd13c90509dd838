import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from barloom.operators import volatility as vo


def simulate(n, seed, alpha=0.1, beta=0.85, gamma=0.0, omega=0.05):
    rng, v, out = np.random.default_rng(seed), omega / (1 - alpha - beta - gamma / 2), []
    for _ in range(n):
        e = rng.normal() * np.sqrt(v)
        out.append(e / 100)
        v = omega + (alpha + gamma * (e < 0)) * e * e + beta * v
    return out


def frame(spark, series):
    at = dt.datetime(2024, 1, 1)
    return spark.createDataFrame([(s, at + dt.timedelta(hours=k), float(r)) for s, rs in series.items() for k, r in enumerate(rs)], "symbol string, ts timestamp_ntz, ret double")


def plain(model, p, x):
    """Log-likelihood by a plain loop."""
    mu, omega, alpha, gamma, beta = p
    e = [100 * r - mu for r in x]
    w = [0.94**k for k in range(min(75, len(e)))]
    v = b = sum(a * c * c for a, c in zip(w, e)) / sum(w)
    total = 0.0
    for t, c in enumerate(e):
        if model == "egarch":
            log = omega + beta * np.log(b if t == 0 else v)
            if t:
                z = e[t - 1] / v**0.5
                log += alpha * (abs(z) - (2 / np.pi) ** 0.5) + gamma * z
            v = float(np.exp(log))
        else:
            v = omega + (alpha + gamma / 2 + beta) * b if t == 0 else omega + (alpha + gamma * (e[t - 1] < 0)) * e[t - 1] ** 2 + beta * v
        total -= 0.5 * (np.log(2 * np.pi * v) + c * c / v)
    return total


@pytest.mark.parametrize("model", vo.MODELS)
def test_fit_beats_a_grid_and_its_likelihood_is_the_plain_one(model):
    series = [simulate(700, 1), simulate(700, 2, 0.03, 0.85, 0.15), simulate(90, 3), [0.01] * 50, [0.01, -0.01], simulate(400, 4, 0.25, 0.3)]
    got = vo.fit_many(model, series)
    assert np.isnan(got[3]).all() and np.isnan(got[4]).all()
    for k in (0, 1, 2, 5):
        own = plain(model, got[k, 1:6], series[k])
        assert abs(own - got[k, 0]) < 1e-6
        sd = np.std(series[k]) * 100
        for keeps in (0.2, 0.5, 0.8, 0.9, 0.95, 0.99):
            for share in (0.02, 0.05, 0.1, 0.2, 0.4):
                for lean in (-0.5, 0.0, 0.5):
                    if model == "egarch":
                        p = (np.mean(series[k]) * 100, np.log(sd**2) * (1 - keeps), share, lean * 0.2, keeps)
                    else:
                        a = keeps * share
                        g = lean * a if model == "gjr" else 0.0
                        p = (np.mean(series[k]) * 100, sd**2 * (1 - keeps), a, g, keeps - a - g / 2)
                    assert plain(model, p, series[k]) <= own + 1e-3
        _, _, alpha, gamma, beta = got[k, 1:6]
        assert abs(beta) < 1 if model == "egarch" else alpha >= 0 and alpha + gamma >= -1e-12 and beta >= 0 and alpha + gamma / 2 + beta < 1


def test_many_series_give_what_one_gives():
    series = [simulate(n, n) for n in (60, 300, 120)]
    together = vo.fit_many("garch", series)
    for k, s in enumerate(series):
        assert np.allclose(together[k, 0], vo.fit_many("garch", [s])[0, 0], atol=1e-5)


def test_selection_finds_the_leverage(spark):
    ret = frame(spark, {"flat": simulate(1500, 5), "lean": simulate(1500, 6, 0.02, 0.8, 0.25)})
    fits = vo.fit(ret)
    rows = {(r["symbol"], r["model"]): r for r in fits.collect()}
    assert rows["lean", "gjr"]["gamma"] > 0.1 and rows["lean", "gjr"]["aic"] < rows["lean", "garch"]["aic"] - 10
    assert {r["symbol"]: r["model"] for r in vo.select(fits.where("model <> 'egarch'")).collect()}["lean"] == "gjr"
    for r in rows.values():
        k = vo.FREE[r["model"]]
        assert r["stationary"] and abs(r["aic"] - (2 * k - 2 * r["loglik"])) < 1e-9 and abs(r["bic"] - (k * np.log(1500) - 2 * r["loglik"])) < 1e-9
    raw = vo.filtered(ret, fits.where("model = 'garch'"))
    assert raw.count() == 3000
    left = {r["symbol"]: r["p_value"] for r in vo.leftover_effects(raw).collect()}
    assert left["flat"] > 0.01


def test_forecasts_by_simulation(spark):
    params = [("g", "garch", 0.0, 0.05, 0.1, 0.0, 0.85, 2.0), ("j", "gjr", 0.0, 0.05, 0.05, 0.1, 0.8, 2.0), ("e", "egarch", 0.0, 0.02, 0.3, -0.15, 0.9, 2.0)]
    fits = spark.createDataFrame(params, "symbol string, model string, mu double, omega double, alpha double, gamma double, beta double, next_variance double")
    got = {(r["symbol"], r["h"]): r["vol"] for r in vo.forecast(fits, 6).collect()}
    rng = np.random.default_rng(8)
    for s, model, _, omega, alpha, gamma, beta, v0 in params:
        v = np.full(400_000, v0)
        for h in range(1, 7):
            assert abs(got[s, h] * 100 / np.sqrt(v.mean()) - 1) < 0.01
            z = rng.normal(size=len(v))
            e = z * np.sqrt(v)
            v = np.exp(omega + alpha * (abs(z) - np.sqrt(2 / np.pi)) + gamma * z + beta * np.log(v)) if model == "egarch" else omega + (alpha + gamma * (e < 0)) * e * e + beta * v


def test_rolling_looks_at_the_past_alone_and_holds_between_refits(spark):
    a, b = simulate(230, 11), simulate(230, 12)
    cut = {"a": a[:180] + [9.0] * 50, "b": b[:170], "short": b[:50]}
    whole = {(r["symbol"], r["ts"]): r for r in vo.rolling(frame(spark, {"a": a, "b": b, "short": b[:50]}), window=100, every=30).collect()}
    early = {(r["symbol"], r["ts"]): r for r in vo.rolling(frame(spark, cut), window=100, every=30).collect()}
    at = dt.datetime(2024, 1, 1)
    for s, n in (("a", 180), ("b", 170), ("short", 50)):
        for k in range(n):
            x, y = whole[s, at + dt.timedelta(hours=k)]["garch_vol"], early[s, at + dt.timedelta(hours=k)]["garch_vol"]
            assert (x is None) == (y is None) == (k < 100) and (x is None or abs(x - y) < 1e-9)
    own = vo.fit_many("garch", [a[30:130]])[0]
    assert all(abs(whole["a", at + dt.timedelta(hours=k)]["garch_vol"] - own[6] ** 0.5 / 100) < 1e-7 for k in range(130, 160))
    assert len({round(whole["a", at + dt.timedelta(hours=k)]["garch_vol"], 9) for k in range(100, 230)}) == 5
    r = whole["a", at + dt.timedelta(hours=140)]
    assert abs(r["garch_vol_annualized"] - r["garch_vol"] * 252**0.5) < 1e-12
    with pytest.raises(ValueError):
        vo.rolling(frame(spark, {"a": a}), window=59)


def test_failed_refits(spark):
    flat = [0.01] * 130 + simulate(100, 3)
    rows = {r["ts"]: r for r in vo.rolling(frame(spark, {"x": flat}), window=100, every=20).collect()}
    at = dt.datetime(2024, 1, 1)
    value = lambda k: rows[at + dt.timedelta(hours=k)]["garch_vol"]
    assert value(99) is None and value(100) == 0 and abs(value(135) - np.std(flat[115:135], ddof=1)) < 1e-12
    assert value(141) == value(159) > 0
    back = {r["ts"]: r["garch_vol"] for r in vo.rolling(frame(spark, {"x": simulate(120, 3) + [0.01] * 160}), window=100, every=20).collect()}
    assert back[at + dt.timedelta(hours=225)] == back[at + dt.timedelta(hours=279)] > 0  # windows without variance keep the forecast before


def test_windows_are_dealt_right(spark):
    ret = frame(spark, {"a": range(47), "b": range(10), "c": range(9)}).withColumn("nth", F.col("ret").cast("int"))
    got = {(r["symbol"], r["refit"]): list(r["x"]) for r in vo.refit_windows(ret, F.col("ret"), 10, 7).collect()}
    assert got == {("a", i): [float(j) for j in range(i - 10, i)] for i in range(10, 47, 7)}


def test_odd_values(spark):
    rows = frame(spark, {"a": [0.01, float("nan"), float("inf"), -0.02] * 20, "b": []})
    assert vo.fit(rows, ("garch",)).select("n").first()[0] == 40
    assert vo.fit(rows.limit(0)).count() == 0 and vo.rolling(rows.limit(0)).count() == 0
