import datetime as dt
import itertools

import numpy as np
import pytest

from barloom.operators import regimes as rg

AT = dt.datetime(2024, 1, 1)


def chain(n, seed, k=2):
    rng, s, out, states = np.random.default_rng(seed), 0, [], []
    for _ in range(n):
        s = s if rng.random() < 0.95 else int(rng.integers(0, k))
        states.append(s)
        out.append((rng.normal(0.001 * (1 - 2 * s), 0.01 * (1 + 2 * s)), rng.normal(0.15 + 0.3 * s, 0.02 * (1 + s))))
    return np.array(out), np.array(states)


def bars(spark, series):
    return spark.createDataFrame([(s, AT + dt.timedelta(hours=i), float(c)) for s, cs in series.items() for i, c in enumerate(cs)], "symbol string, ts timestamp_ntz, close double")


def prices(n, seed):
    rng, p, out, s = np.random.default_rng(seed), 100.0, [], 0
    for _ in range(n):
        s = s if rng.random() < 0.97 else 1 - s
        p *= np.exp(rng.normal(0, 0.003 * (1 + 4 * s)))
        out.append(p)
    return out


def plain(start, trans, log_b):
    """Filtered and smoothed probabilities, transitions and log-likelihood by plain loops."""
    b, n = np.exp(log_b), len(log_b)
    a = [start * b[0]]
    for t in range(1, n):
        a.append(a[-1] @ trans * b[t])
    back = [np.ones(len(start))]
    for t in range(n - 1, 0, -1):
        back.insert(0, trans @ (b[t] * back[0]))
    total = a[-1].sum()
    pairs = sum(a[t - 1][:, None] * trans * b[t] * back[t] for t in range(1, n)) / total
    return np.array([x / x.sum() for x in a]), np.array([x * y / total for x, y in zip(a, back)]), pairs, np.log(total)


@pytest.mark.parametrize("k", [1, 2, 3])
def test_messages_equal_plain_loops(k):
    rng = np.random.default_rng(k)
    start, trans = rng.dirichlet(np.ones(k), 3), rng.dirichlet(np.ones(k), (3, k))
    size = np.array([1, 17, 40])
    log_b = rng.normal(size=(3, 40, k)) * 2
    a, loglik = rg.forward(start, trans, log_b, size)
    both, pairs, again = rg.posteriors(start, trans, log_b, size)
    for j, n in enumerate(size):
        want = plain(start[j], trans[j], log_b[j, :n])
        assert np.allclose(a[j, :n], want[0]) and np.allclose(both[j, :n], want[1]) and np.allclose(pairs[j], want[2]) and np.allclose([loglik[j], again[j]], want[3])


def test_path_is_the_likeliest():
    rng = np.random.default_rng(1)
    for _ in range(30):
        start, trans, log_b = rng.dirichlet(np.ones(2)), rng.dirichlet(np.ones(2), 2), rng.normal(size=(7, 2))
        score = lambda p: np.log(start[p[0]]) + log_b[0, p[0]] + sum(np.log(trans[x, y]) + log_b[t, y] for t, (x, y) in enumerate(itertools.pairwise(p), 1))  # noqa: E731, B023
        assert np.isclose(score(rg.best_path(start, trans, log_b)), max(map(score, itertools.product(range(2), repeat=7))))


@pytest.mark.parametrize("chain_", [True, False])
def test_likelihood_never_falls_and_states_are_found(chain_):
    x, states = chain(900, 4)
    z = ((x - x.mean(0)) / x.std(0))[None]
    *_, told = rg.em(z, np.array([900]), 2, chain_)
    steps = np.array([t[0] for t in told])
    assert len(steps) > 3 and (np.diff(steps) > -1e-7).all()
    loglik, start, trans, means, covs = rg.fit_many([x], 2, "hmm" if chain_ else "gmm")[0]
    assert covs[0, 1, 1] < covs[1, 1, 1] and abs(means[0, 1] - 0.15) < 0.01 and abs(means[1, 1] - 0.45) < 0.02
    if chain_:
        assert trans[0, 0] > 0.93 and trans[1, 1] > 0.93
        found = rg.best_path(start, trans, rg.densities(x[None], means[None], covs[None])[0])
        assert (found == states).mean() > 0.98
        assert np.isclose(loglik, rg.forward(start[None], trans[None], rg.densities(x[None], means[None], covs[None]), np.array([900]))[1][0])


def test_fits_do_not_depend_on_their_neighbours():
    series = [chain(n, n)[0] for n in (60, 200, 330)] + [np.zeros((100, 2)), chain(59, 1)[0]]
    together = rg.fit_many(series, 2)
    assert together[3] is None and together[4] is None
    for s, got in zip(series[:3], together):
        for a, b in zip(rg.fit_many([s], 2)[0], got):
            assert np.allclose(a, b, rtol=1e-6, atol=1e-9)


def test_inputs_and_decoding(spark):
    rows = rg.inputs(bars(spark, {"a": prices(400, 1), "b": prices(50, 2), "c": [5.0]}))
    got = {(r["symbol"], r["nth"]): r for r in rows.collect()}
    own = np.diff(np.log(prices(400, 1)))
    assert got["a", 19]["vol"] is None and np.isclose(got["a", 20]["vol"], own[:20].std(ddof=1) * 252**0.5) and got["c", 0]["ret"] is None
    models = rg.fit(rows, 2)
    found = {r["symbol"]: r["start"] for r in models.collect()}
    assert found["a"] is not None and found["b"] is None and "c" not in found
    states = rg.decode(rows, models).collect()
    assert len(states) == 380 and all(abs(sum(r["probs"]) - 1) < 1e-9 for r in states)
    early = rg.decode(rows.where("nth < 200"), models, smooth=False).collect()
    late = {r["ts"]: r["probs"] for r in rg.decode(rows, models, smooth=False).collect()}
    assert all(np.allclose(r["probs"], late[r["ts"]]) for r in early)  # filtered: what follows changes nothing


@pytest.mark.parametrize("options", [{}, {"alone": True}, {"method": "gmm"}, {"k": 3}])
def test_rolling_looks_at_the_past_alone(spark, options):
    a, b = prices(240, 7), prices(100, 8)
    whole = {(r["symbol"], r["ts"]): r for r in rg.rolling(bars(spark, {"a": a, "b": b}), window=120, every=25, **options).collect()}
    cut = {(r["symbol"], r["ts"]): r for r in rg.rolling(bars(spark, {"a": a[:180] + [1e6, 3.0] * 10, "b": b}), window=120, every=25, **options).collect()}
    assert len(whole) == 340
    for i in range(240):
        r = whole["a", AT + dt.timedelta(hours=i)]
        assert (r["regime_label"] is None) == (i < 120)
        if i >= 120:
            assert np.isclose(sum(r["regime_probs"]), 1) and r["regime_label"] == int(np.argmax(r["regime_probs"])) and np.isclose(r["regime_entropy"], -sum(p * np.log(p) for p in r["regime_probs"] if p > 0))
            if i < 180:
                assert np.allclose(cut["a", AT + dt.timedelta(hours=i)]["regime_probs"], r["regime_probs"], atol=1e-9)
    assert all(r["regime_label"] is None for (s, _), r in whole.items() if s == "b")


def test_a_failed_refit_keeps_the_model_before(spark):
    flat = prices(125, 9) + [50.0] * 130
    rows = {r["ts"]: r for r in rg.rolling(bars(spark, {"a": flat}), window=100, every=20).collect()}
    assert rows[AT + dt.timedelta(hours=250)]["regime_label"] == 0
    with pytest.raises(ValueError):
        rg.rolling(bars(spark, {"a": flat}), window=50)
    assert rg.regime_features(bars(spark, {"a": flat}).limit(0)).count() == 0
