import datetime as dt
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from barloom.operators import diagnostics, features, metrics, models, recurrences
from barloom.sources import records

AT = dt.datetime(2024, 1, 1)


def test_student_p_values():
    # against numerical integration of the density
    assert all(abs(models.student_two_sided(t, 1) - (1 - 2 / math.pi * math.atan(t))) < 1e-12 for t in (0.1, 1.0, 7.0))
    for freedom in (4, 30, 700):
        x = np.linspace(-60, 0, 4_000_001)
        density = np.exp(math.lgamma((freedom + 1) / 2) - math.lgamma(freedom / 2)) / math.sqrt(freedom * math.pi) * (1 + x**2 / freedom) ** (-(freedom + 1) / 2)
        area = np.concatenate([[0], np.cumsum((density[1:] + density[:-1]) / 2 * np.diff(x))])
        for t in (0.3, 1.0, 2.5, 5.0):
            assert abs(models.student_two_sided(t, freedom) - 2 * np.interp(-t, x, area)) < 2e-4
    assert models.student_two_sided(0.0, 5) == 1.0 and abs(models.student_two_sided(1.959964, 1e7) - 0.05) < 1e-6


def test_losses_and_p_values(spark):
    rng = np.random.default_rng(2)
    y = rng.integers(0, 2, 80)
    p, q = np.clip(0.5 + 0.2 * (y - 0.5) + 0.2 * rng.normal(size=80), 0.01, 0.99), rng.random(80)
    df = spark.createDataFrame([("a", AT + dt.timedelta(hours=k), int(y[k]), float(p[k]), float(q[k])) for k in range(80)], "symbol string, ts timestamp_ntz, y int, p double, q double")
    loss = {"brier": lambda s: (s - y) ** 2, "logloss": lambda s: -(y * np.log(s) + (1 - y) * np.log(1 - s)), "directional": lambda s: ((s >= 0.5) != y).astype(float)}
    for name, f in loss.items():
        d = f(p) - f(q)
        want = d.mean() / np.sqrt(d.var() / 80) * np.sqrt(79 / 80)
        got = models.diebold_mariano(df, loss=name).withColumn("p_value", models.student_p("statistic", F.col("n") - 1)).first()
        assert got["statistic"] == pytest.approx(want) and got["p_value"] == pytest.approx(models.student_two_sided(want, 79)) and got["p_value"] < 0.05


def test_rules_of_lags(spark):
    rng = np.random.default_rng(3)
    noise, trend = rng.normal(size=300), np.cumsum(rng.normal(size=300))
    df = spark.createDataFrame([(s, AT + dt.timedelta(hours=k), float(v)) for s, vs in (("noise", noise), ("trend", trend), ("few", trend[:15])) for k, v in enumerate(vs)], "symbol string, ts timestamp_ntz, ret double")
    got = {r["symbol"]: (r["any_lag"], r["all_lags"], len(r["p_values"])) for r in diagnostics.dependence(diagnostics.correlogram(df, "ret", 20)).collect()}
    assert got == {"noise": (False, False, 2), "trend": (True, True, 2)}


def test_two_regimes_by_the_median(spark):
    rng = np.random.default_rng(4)
    r = rng.normal(0, 0.01, 100)
    df = spark.createDataFrame([("a", AT + dt.timedelta(hours=k), float(v)) for k, v in enumerate(r)], "symbol string, ts timestamp_ntz, ret double")
    rows = metrics.median_regime(df).orderBy("ts").collect()
    vol = [None] * 20 + [r[k - 20 : k + 1].std(ddof=1) * 252**0.5 * 100 for k in range(20, 100)]
    assert rows[19]["volatility"] is None and all(math.isclose(a["volatility"], b) for a, b in zip(rows[20:], vol[20:])) and sum(a["wild"] for a in rows[20:]) == 40


def test_turns_and_stretches(spark):
    rng = np.random.default_rng(5)
    close = 100 + np.cumsum(rng.normal(size=90))
    df = spark.createDataFrame([("a", AT + dt.timedelta(hours=k), float(c), float(c + 1), float(c - 1), float(c), 1.0) for k, c in enumerate(close)], "symbol string, ts timestamp_ntz, open double, high double, low double, close double, volume double")
    base = {r["ts"]: r for r in recurrences.recurrences(df).collect()}
    rows = recurrences.derived(df).orderBy("ts").collect()
    before = None
    for k, r in enumerate(rows):
        b = base[r["ts"]]
        ready = b["macd_signal"] is not None
        assert (r["macd_bullish"] is None) == (not ready)
        turn = 0.0 if not ready or before is None else float(b["macd_line"] > b["macd_signal"]) - before
        assert r["macd_cross"] == turn
        before = float(b["macd_line"] > b["macd_signal"]) if ready else None
        if b["rsi_wilder_14"] is None:
            assert r["rsi_reversion_signal"] is None and r["rsi_stretch"] is None
        else:
            assert r["rsi_reversion_signal"] == (1 if b["rsi_wilder_14"] < 30 else -1 if b["rsi_wilder_14"] > 70 else 0) and math.isclose(r["rsi_stretch"], (b["rsi_wilder_14"] - 50) / 50)
        assert r["ma_dist_atr_20"] is None if k < 19 else math.isclose(r["ma_dist_atr_20"], (close[k] - close[k - 19 : k + 1].mean()) / b["atr_14"])


def test_pages_and_summaries_of_the_log(spark):
    rows = [(f"2024-01-0{k + 1}", "RISK_DECISION" if k % 2 else "ORDER_SUBMITTED", "info", f"m{k}", '{"ticker": "%s", "status": "approved", "rule": "NONE"}' % ("aapl" if k < 4 else "MSFT")) for k in range(7)] + [("2024-01-09", "SYSTEM_EVENT", "info", "up", None)]
    log = spark.createDataFrame(rows, "timestamp string, kind string, severity string, message string, data string")
    page, total = records.event_page(log, "risk_decision", "aapl", limit=1, offset=1)
    assert total == 2 and [r["message"] for r in page.collect()] == ["m3"]
    page, total = records.event_page(log, limit=500)
    assert total == 8 and page.count() == 8
    with pytest.raises(ValueError):
        records.event_page(log, limit=501)
    got = [tuple(r) for r in records.decision_summary(log).collect()]
    assert ("RISK_DECISION", None, None, None, None, 3) in got and (None, None, None, "AAPL", None, 4) in got and (None, "APPROVED", None, None, None, 7) in got and ("SYSTEM_EVENT", "none", "none", "none", "none", 1) in got


def test_chart_rows_begin_with_what_there_is(spark):
    df = spark.createDataFrame([("a", AT + dt.timedelta(hours=k), 1.0, 1.0, 1.0, float(k * k), 5.0) for k in range(40)], "symbol string, ts timestamp_ntz, open double, high double, low double, close double, volume double")
    rows = features.chart_rows(df, 25).orderBy("ts").collect()
    c = np.array([k * k for k in range(15, 40)], float)
    assert len(rows) == 25 and rows[0]["sma20"] == 225 == rows[0]["bb_upper"] and rows[1]["bb_upper"] == round(c[:2].mean() + 2 * c[:2].std(ddof=1), 2)
    assert rows[24]["sma20"] == round(c[5:].mean(), 2) and rows[24]["sma60"] == round(c.mean(), 2)
