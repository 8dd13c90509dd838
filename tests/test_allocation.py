import datetime as dt
import itertools

import numpy as np
import pytest

from barloom.operators import allocation as al


def matrix(n, seed):
    a = np.random.default_rng(seed).normal(size=(n + 3, n))
    return a.T @ a / n


def frame(spark, x, start=dt.datetime(2024, 1, 1), hours=24):
    names = "abcdefgh"[: len(x[0])]
    return spark.createDataFrame([(s, start + dt.timedelta(hours=hours * k), float(v)) for k, row in enumerate(x) for s, v in zip(names, row) if v is not None], "symbol string, ts timestamp_ntz, ret double")


def test_equal_risk_shares_are_equal():
    covs = np.stack([matrix(5, s) for s in range(20)])
    w = al.equal_risk(covs, 1e-4, 1.0)
    share = w * np.einsum("cij,cj->ci", covs, w) / np.einsum("ci,cij,cj->c", w, covs, w)[:, None]
    assert np.allclose(share, 0.2, atol=1e-6) and np.allclose(w.sum(1), 1)
    b = np.array([0.4, 0.3, 0.1, 0.1, 0.1])
    w = al.equal_risk(covs, 1e-4, 1.0, b)
    assert np.allclose(w * np.einsum("cij,cj->ci", covs, w) / np.einsum("ci,cij,cj->c", w, covs, w)[:, None], b, atol=1e-6)
    assert np.allclose(al.equal_risk(np.diag([4.0, 1.0, 0.25])[None], 0, 1)[0], np.array([0.5, 1, 2]) / 3.5)


def test_bounds_hold():
    cov = np.diag([1.0, 100.0, 100.0, 400.0])[None]
    w = al.equal_risk(cov, 1e-4, 0.4)[0]
    assert np.isclose(w[0], 0.4) and np.isclose(w[1], w[2]) and np.isclose(w[1] / w[3], 2) and np.isclose(w.sum(), 1)
    assert np.allclose(al.equal_risk(np.eye(2)[None], 0, 0.3), 0.5)
    for objective in (lambda c: al.least_variance(c, 0.05, 0.5), lambda c: al.greatest_sharpe(c, np.array([[0.1, 0.2, -0.1, 0.3]]), 0.05, 0.5)):
        w = objective(matrix(4, 1)[None])[0]
        assert w.min() > 0.05 - 1e-9 and w.max() < 0.5 + 1e-9 and np.isclose(w.sum(), 1)


def test_optima_beat_a_grid():
    steps = np.arange(0, 1.0001, 0.05)
    grid = np.array([(a, b, 1 - a - b) for a, b in itertools.product(steps, steps) if -1e-9 <= 1 - a - b <= 0.6 + 1e-9 and a <= 0.6 and b <= 0.6])
    for seed in range(8):
        cov, mean = matrix(3, seed), np.random.default_rng(seed + 50).normal(0.1, 0.2, 3)
        var = lambda w: np.einsum("...i,ij,...j->...", w, cov, w)  # noqa: E731, B023
        assert var(al.least_variance(cov[None], 0, 0.6)[0]) <= var(grid).min() + 1e-7
        sharpe = lambda w: w @ mean / np.sqrt(var(w))  # noqa: E731, B023
        assert sharpe(al.greatest_sharpe(cov[None], mean[None], 0, 0.6)[0]) >= sharpe(grid).max() - 1e-4


def plain_shrinkage(x):
    """The estimator by its definition, observation by observation."""
    x = x - x.mean(0)
    n, p = x.shape
    s = x.T @ x / n
    m = np.trace(s) / p
    d2 = ((s - m * np.eye(p)) ** 2).sum() / p
    b2 = min(d2, sum(((np.outer(r, r) - s) ** 2).sum() for r in x) / p / n**2)
    return b2 / d2


def test_shrinkage():
    for seed in range(5):
        x = np.random.default_rng(seed).normal(size=(40, 6)) @ matrix(6, seed)
        cov, s = al.shrunk(x)
        assert np.isclose(s, plain_shrinkage(x)) and 0 < s <= 1 and np.isclose(np.trace(cov), np.trace(np.cov(x, rowvar=False, bias=True)))
    assert al.covariance(np.ones((5, 2)))[1] == 0.0
    with pytest.raises(ValueError):
        al.covariance(np.ones((5, 2)), "other")


def test_weights_are_set_on_the_right_days(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(0, 0.01, (130, 3)).tolist()
    days = [dt.datetime(2024, 1, 1) + dt.timedelta(days=k) for k in range(130)]
    got = {r["ts"]: r for r in al.rebalanced(frame(spark, x), lookback=30).collect()}
    assert sorted(got) == days[30:]
    assert [t for t in sorted(got) if got[t]["set"]] == [dt.datetime(2024, 1, 31), dt.datetime(2024, 2, 29), dt.datetime(2024, 3, 31), dt.datetime(2024, 4, 30)]
    # without rows on the last day, the next row counts
    gone = {dt.datetime(2024, 2, 29), dt.datetime(2024, 3, 1), dt.datetime(2024, 4, 30)}
    less = {r["ts"]: r for r in al.rebalanced(frame(spark, [row if t not in gone else [None] * 3 for t, row in zip(days, x)]), lookback=30).collect()}
    assert [t for t in sorted(less) if less[t]["set"]] == [dt.datetime(2024, 1, 31), dt.datetime(2024, 3, 2), dt.datetime(2024, 3, 31), dt.datetime(2024, 5, 1)]


@pytest.mark.parametrize("objective", ["equal_risk", "least_variance", "greatest_sharpe"])
def test_rebalancing_rests_on_the_past_alone(spark, objective):
    rng = np.random.default_rng(4)
    x = rng.normal(0.001, [0.01, 0.02, 0.015], (100, 3))
    got = {r["nth"]: r for r in al.rebalanced(frame(spark, x.tolist()), objective, lookback=20, period="week", high=0.6).collect()}
    cut = x.copy()
    cut[60:] = 5.0
    early = {r["nth"]: r for r in al.rebalanced(frame(spark, cut.tolist()), objective, lookback=20, period="week", high=0.6).collect()}
    now = None
    for k in range(20, 100):
        r = got[k]
        if r["set"]:
            cov, s = al.covariance(x[k - 20 : k])
            now = {"equal_risk": lambda: al.equal_risk(cov[None], 1e-4, 0.6), "least_variance": lambda: al.least_variance(cov[None], 0, 0.6), "greatest_sharpe": lambda: al.greatest_sharpe(cov[None], x[k - 20 : k].mean(0)[None] * 252, 0, 0.6)}[objective]()[0], s
        assert r["set"] == (k == 20 or (dt.datetime(2024, 1, 1) + dt.timedelta(days=k)).weekday() == 6)
        assert np.allclose(r["weights"], now[0]) and np.isclose(r["shrinkage"], now[1]) and np.isclose(r["ret"], now[0] @ x[k])
        if k < 60:
            assert np.allclose(early[k]["weights"], r["weights"])


def test_incomplete_times_keys_and_empty_tables(spark):
    x = np.random.default_rng(5).normal(0, 0.01, (60, 2)).tolist()
    x[10] = [0.1, None]
    x[11] = [float("nan"), 0.1]
    one = frame(spark, x)
    assert al.rebalanced(one, lookback=20).count() == 38
    from pyspark.sql import functions as F

    two = one.withColumn("book", F.lit("p")).unionByName(one.withColumn("book", F.lit("q")).withColumn("ret", F.col("ret") * 2))
    got = al.rebalanced(two, keys=["book"], lookback=20).groupBy("book").count().collect()
    assert {r["book"]: r["count"] for r in got} == {"p": 38, "q": 38}
    assert al.rebalanced(one.limit(0)).count() == 0 and al.compared(one.limit(0)).count() == 0
    with pytest.raises(ValueError):
        al.rebalanced(one, "other")


@pytest.mark.parametrize("method", ["sample", "ledoit_wolf"])
def test_compared(spark, method):
    x = np.random.default_rng(6).normal(0.001, [0.01, 0.02, 0.03, 0.01], (200, 4))
    rows = al.compared(frame(spark, x.tolist()).repartition(5), method=method).collect()
    cov, _ = al.covariance(x, method)
    by = {s: np.array([r["weight"] for r in sorted(rows, key=lambda r: r["symbol"]) if r["strategy"] == s]) for s in ("equal", "least_variance", "greatest_sharpe", "equal_risk")}
    assert len(rows) == 16 and np.allclose(by["equal"], 0.25) and np.allclose(by["equal_risk"], al.equal_risk(cov[None], 1e-4, 0.5)[0], atol=1e-8) and np.allclose(by["least_variance"], al.least_variance(cov[None], 0, 0.5)[0], atol=1e-6)
    for r in rows:
        w = by[r["strategy"]]
        assert np.isclose(r["expected"], w @ x.mean(0) * 252) and np.isclose(r["deviation"], np.sqrt(w @ cov @ w)) and np.isclose(r["sharpe"], r["expected"] / r["deviation"])
    assert all(np.isclose(r["share"], 0.25, atol=1e-6) for r in rows if r["strategy"] == "equal_risk")
