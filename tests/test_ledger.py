import datetime as dt

import numpy as np
import pytest

from barloom.operators import ledger, portfolio

AT = dt.datetime(2024, 1, 1)
KINDS = "strategy string, symbol string, ts timestamp_ntz, close double, volume double, weight double, vol double"


def frame(spark, rows):
    return spark.createDataFrame([(s, a, AT + dt.timedelta(hours=8 * k), *v) for s, a, k, *v in rows], KINDS)


def market(seed, n=60, gaps=False):
    rng = np.random.default_rng(seed)
    rows, p = [], np.full(3, 100.0)
    for k in range(n):
        p = p * np.exp(rng.normal(0, 0.02, 3))
        for j, a in enumerate("ABC"):
            if gaps and (k + j) % 17 == 5:
                continue
            rows.append(("s", a, k, float(p[j]), float(rng.integers(50, 5000)), float(rng.choice([-0.3, -0.1, 0.0, 0.2, 0.4])), float(rng.choice([0.1, 0.2, 0.5]))))
    return rows


def plain(rows, gate=None, capital=100_000.0, commission=5e-4, slippage=5e-4):
    """The books by loops over times and orders, each order judged by itself."""
    times = sorted({r[2] for r in rows})
    at = {(r[1], r[2]): r for r in rows}
    weight, cash, shares, books, fills = {}, capital, {}, [], []
    peak = start = before = capital
    for n, k in enumerate(times):
        here = sorted(a for a, t in at if t == k)
        price = {a: at[a, k][3] for a in here}
        equity = cash + sum(shares.get(a, 0.0) * price[a] for a in here)
        peak = max(peak, equity)
        if n and (AT + dt.timedelta(hours=8 * k)).date() != (AT + dt.timedelta(hours=8 * times[n - 1])).date():
            start = equity
        state, turnover, fees, slips = dict(shares), 0.0, 0.0, 0.0
        for a in here:
            step = weight.get(a, 0.0) * equity / price[a] - state.get(a, 0.0)
            if abs(step) < 1e-4:
                continue
            size = abs(step)
            if gate and not state.get(a, 0.0) * step < 0:
                if (peak - equity) / peak >= 0.15 or (start - equity) / start >= 0.03:
                    continue
                vol = at[a, k][6]
                if vol > 1.5 * 0.15:
                    size *= round(max(0.2, min(1, 0.15 / vol)), 4)
                worth = {b: state.get(b, 0.0) * price[b] for b in here}
                stop = False
                for room in (0.25 * equity - abs(worth[a]), equity - sum(map(abs, worth.values()))):
                    room = max(0.0, room) / price[a]
                    stop = stop or (room <= 0 and size > room)
                    size = min(size, room)
                if stop or abs(sum(worth.values()) + (size if step > 0 else -size) * price[a]) > equity:
                    continue
            step = size if step > 0 else -size
            value = size * price[a]
            slip = value * slippage * max(1.0, (size / at[a, k][4] / 0.01) ** 0.5)
            cash -= step * price[a] + slip + value * commission
            shares[a] = shares.get(a, 0.0) + step
            turnover, fees, slips = turnover + value, fees + value * commission, slips + slip
            if size:
                fills.append((a, k, step))
        after = cash + sum(shares.get(a, 0.0) * price[a] for a in here)
        books.append((after, cash, after / before - 1, turnover, fees, slips))
        before = after
        weight |= {a: at[a, k][5] for a in here}
    return books, fills


@pytest.mark.parametrize("gate", [None, ledger.Gate()])
@pytest.mark.parametrize("gaps", [False, True])
def test_books_equal_plain_loops(spark, gate, gaps):
    rows = market(1, gaps=gaps)
    got = ledger.run(frame(spark, rows), gate=gate).orderBy("ts").collect()
    books, fills = plain(rows, gate)
    assert np.allclose([[r[c] for c in ("equity", "cash", "ret", "turnover", "commission", "slippage")] for r in got], books)
    have = [(f["symbol"], f["step"]) for r in got for f in r["fills"]]
    assert [a for a, _ in have] == [a for a, _, _ in fills] and np.allclose([s for _, s in have], [s for _, _, s in fills])
    if gate:
        assert sum(r["blocked"] for r in got) > 0 and sum(r["resized"] for r in got) > 0


def test_state_is_carried_over_batches(spark):
    rows = market(2, 120) + [("t", *r[1:]) for r in market(3, 40)]
    whole = {(r["strategy"], r["ts"]): r["equity"] for r in ledger.run(frame(spark, rows)).collect()}
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        small = {(r["strategy"], r["ts"]): r["equity"] for r in ledger.run(frame(spark, rows)).collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert small == whole and len(whole) == 160


def test_trades_are_episodes_of_one_sign(spark):
    steps = [(0, 10, 100.0), (1, 5, 110.0), (2, -5, 120.0), (3, -20, 130.0), (4, 4, 100.0), (5, 6, 90.0), (6, 3, 80.0)]
    fill = spark.createDataFrame([("s", AT + dt.timedelta(hours=k), k, "A", float(q), p, 1.0, 0.5) for k, q, p in steps], "strategy string, ts timestamp_ntz, nth int, symbol string, step double, price double, commission double, slippage double")
    got = [(r["side"], r["quantity"], r["entry_price"], r["exit_price"], r["pnl"], r["bars"]) for r in ledger.trades(fill).orderBy("exit_ts").collect()]
    assert got == [
        ("LONG", 5, 100, 120, 5 * 20 - 1.5, 2), ("LONG", 10, 100, 130, 10 * 30 - 1.5, 3),  # the rest of the fourth fill opens a short trade at 130
        ("SHORT", 4, 130, 100, 4 * 30 - 1.5, 1), ("SHORT", 6, 130, 90, 6 * 40 - 1.5, 2),
    ]
    assert ledger.trades(fill.limit(0)).count() == 0 and ledger.run(frame(spark, [])).count() == 0


def test_rebalance_days(spark):
    days = [AT + dt.timedelta(days=k) for k in range(120) if k not in (59, 60, 61)]
    ret = spark.createDataFrame([(d,) for d in days], "ts timestamp_ntz")
    got = {str(r["period_end"]): r["ts"].strftime("%m-%d") for r in portfolio.rebalance_days(ret, "month", 10).collect()}
    assert got == {"2024-01-31": "01-31", "2024-02-29": "03-03", "2024-03-31": "03-31"}
