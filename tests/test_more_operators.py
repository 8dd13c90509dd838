import datetime as dt
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from barloom.operators import cleaning, diagnostics, metrics, models, nlp, policy, portfolio, production, scaling, universe
from barloom.sources import bars as store
from barloom.sources import records
from barloom.streaming import bars as streams

DAY = dt.datetime(2024, 1, 1)


def returns(spark, values, symbol="A"):
    return spark.createDataFrame([(symbol, DAY + dt.timedelta(days=k), float(v)) for k, v in enumerate(values)], "symbol string, ts timestamp_ntz, ret double")


def bars(spark, closes, symbol="A"):
    return spark.createDataFrame([(symbol, DAY + dt.timedelta(days=k), float(c), float(c) + 1, float(c) - 1, float(c), 1000.0 + k) for k, c in enumerate(closes)], store.BARS)


def test_probabilities(spark):
    one = spark.range(1).select(*(diagnostics.two_sided(F.lit(z)).alias(f"z{k}") for k, z in enumerate((0.0, 1.0, -1.96, 4.0))), *(diagnostics.chi_square_above(F.lit(x), n).alias(f"c{n}") for x, n in ((3.841, 1), (5.991, 2), (7.815, 3), (18.307, 10)))).first()
    assert [round(one[f"z{k}"], 5) for k in range(4)] == [round(math.erfc(abs(z) / math.sqrt(2)), 5) for z in (0, 1, 1.96, 4)]
    assert all(abs(one[f"c{n}"] - 0.05) < 1e-4 for n in (1, 2, 3, 10))


def test_regressions_equal_least_squares(spark):
    rng = np.random.default_rng(4)
    e = rng.normal(size=400)
    r = e * (0.5 + np.abs(np.concatenate([[0], e[:-1]])))
    got = diagnostics.arch_lm(returns(spark, r), 3).first()
    s = (r - r.mean()) ** 2
    x = np.column_stack([np.ones(397), s[2:-1], s[1:-2], s[:-3]])
    y = s[3:]
    res = y - x @ np.linalg.lstsq(x, y, rcond=None)[0]
    assert got["n"] == 397 and got["lm"] == pytest.approx(397 * (1 - (res @ res) / ((y - y.mean()) @ (y - y.mean())))) and got["p_value"] < 0.05
    p = np.cumsum(r) + 50
    got = diagnostics.dickey_fuller(bars(spark, p), "close", 2).first()
    d = np.diff(p)
    x = np.column_stack([np.ones(397), p[2:-1], d[1:-1], d[:-2]])
    b, y = np.linalg.lstsq(x, d[2:], rcond=None)[0], d[2:]
    se = math.sqrt(((y - x @ b) @ (y - x @ b)) / (397 - 4) * np.linalg.inv(x.T @ x)[1, 1])
    assert got["n"] == 397 and got["statistic"] == pytest.approx(b[1] / se, rel=1e-6) and not got["stationary"]
    assert diagnostics.stationarity(bars(spark, r)).first()["verdict"] == "stationary" and not diagnostics.kpss(bars(spark, p + np.arange(400))).first()["stationary"]
    assert diagnostics.clustering(returns(spark, r), 4).first()["verdict"] == "confirmed"


def test_partial_autocorrelation_solves_yule_walker(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=90)
    x[1:] += 0.6 * x[:-1]
    d = x - x.mean()
    cov = [d[k:] @ d[: len(d) - k] / (len(d) - k) for k in range(6)]
    want = [np.linalg.solve([[cov[abs(i - j)] for j in range(k)] for i in range(k)], cov[1 : k + 1])[-1] for k in range(1, 6)]
    got = [r["pacf"] for r in diagnostics.correlogram(returns(spark, x), "ret", 5).orderBy("lag").collect()]
    assert got == pytest.approx(want)


def test_scaling(spark):
    b = bars(spark, [1, 2, 3, 4, 100]).select("symbol", "ts", "close")
    stats = scaling.fit(b.where("close < 50"), ["close"])
    assert stats.first()["close_centre"] == 2.5 and stats.first()["close_scale"] == 1.5
    assert [r["close"] for r in scaling.transform(b, stats, ["close"]).orderBy("ts").collect()] == [-1, pytest.approx(-1 / 3), pytest.approx(1 / 3), 1, 5]
    assert [r["close"] for r in scaling.transform_rolling(b, ["close"], "minmax", 2).orderBy("ts").collect()] == [None, 1, 1, 1, 1]
    gaps = spark.createDataFrame([("A", k, v) for k, v in enumerate([None, 1.0, None, None, 4.0])], "symbol string, ts int, x double")
    assert [r["x"] for r in scaling.clean(gaps, ["x"], 1).orderBy("ts").collect()] == [1, 1, 4] and scaling.clean(gaps, ["x"], 5).count() == 4
    across = spark.createDataFrame([("A", 1, 1.0), ("B", 1, 3.0), ("C", 1, 3.0), ("D", 1, None), ("A", 2, 7.0)], "symbol string, ts int, x double")
    assert [r["x"] for r in scaling.transform_across(across, ["x"], "rank").orderBy("ts", "symbol").collect()] == [pytest.approx(-1 / 3), pytest.approx(2 / 3), pytest.approx(2 / 3), None, 7]
    with pytest.raises(ValueError):
        scaling.fit(b, ["close"], "other")


def test_production_features_look_at_nothing_later(spark):
    rng = np.random.default_rng(1)
    closes = 100 * np.exp(np.cumsum(rng.normal(0, 0.02, 80)))
    news = spark.createDataFrame([("A", (DAY + dt.timedelta(days=50)).date(), 3, 0.5)], "symbol string, date date, n long, dev double")
    whole, cut = (production.dataset(bars(spark, c), news).orderBy("ts").collect() for c in (closes, closes[:60]))
    assert len(cut) == 39 and len(whole) == 59
    for a, b in zip(whole, cut):
        assert all(a[c] == pytest.approx(b[c]) for c in production.FEATURES) and a["y"] == b["y"]
    told = next(r for r in cut if r["ts"] == DAY + dt.timedelta(days=50))
    assert told["news_headline_volume"] == pytest.approx(math.log(4)) and told["news_sentiment_volatility"] == 0.5 and cut[0]["news_headline_volume"] == 0


def test_split_ensemble_and_sharpe_difference(spark):
    df = returns(spark, range(10))
    assert {(r["ret"] < 8, r["part"]) for r in models.temporal_split(df).collect()} == {(True, "train"), (False, "test")}
    p = {"a": F.lit(0.9), "b": F.lit(0.5)}
    one = spark.range(1).select(models.ensemble(p).alias("m"), models.ensemble(p, by="conviction").alias("c"), models.ensemble(p, {"a": 0.4, "b": 0.5}, by="accuracy").alias("w")).first()
    assert one["m"] == pytest.approx(0.7) and one["c"] == pytest.approx((0.9 * 0.4001 + 0.5 * 1e-4) / 0.4002) and one["w"] == pytest.approx((0.9 * 0.01 + 0.5 * 0.05) / 0.06)
    rng = np.random.default_rng(2)
    x = rng.normal(0.2, 1, 300)
    rows = [("A", DAY + dt.timedelta(days=k), float(v), float(w)) for k, (v, w) in enumerate(zip(x, x - 0.3 + rng.normal(0, 0.1, 300)))]
    two = spark.createDataFrame(rows, "symbol string, ts timestamp_ntz, x double, y double")
    got = models.sharpe_difference(two, "x", "y", paths=200).first()
    assert got["low"] <= got["difference"] <= got["high"] and got["low"] > 0 and got["p_value"] < 0.05
    same = models.sharpe_difference(two, "x", "x", paths=50).first()
    assert same["difference"] == same["low"] == same["high"] == 0 and same["p_value"] == 1


def test_sizes_and_trades(spark):
    r = [0.01, -0.02] * 40
    df = returns(spark, r).withColumn("p", F.lit(0.9))
    got = portfolio.rolling_kelly(df.withColumn("ret", -F.col("ret"))).orderBy("ts").collect()
    assert all(g["size"] is None for g in got[:60]) and got[60]["win_rate"] == 0.5 and got[60]["payoff"] == pytest.approx(2) and got[60]["size"] == pytest.approx(0.25 * 0.5 * 2)
    trades = spark.createDataFrame([("s", 10.0, 2), ("s", -5.0, 4), ("s", 20.0, 6), ("t", 3.0, 1)], "strategy string, pnl double, bars int")
    got = {g["strategy"]: g for g in portfolio.trade_statistics(trades).collect()}
    assert got["s"]["profit_factor"] == 6 and got["s"]["payoff"] == 3 and got["s"]["longest_bars"] == 6 and got["t"]["profit_factor"] == 3 and got["t"]["payoff"] == 3
    books = spark.createDataFrame([("a", "b", k, p, e) for k, (p, e) in enumerate([(0, 1.0), (1, 1.1), (-1, 1.2), (0, 1.5), (1, 1.4)])], "a string, b string, ts int, position int, equity double")
    assert [(g["entry_ts"], g["exit_ts"], round(g["pnl"], 9)) for g in portfolio.pair_trades(books).collect()] == [(1, 3, 0.4)]


def test_orders(spark):
    rows = [("x", 0, "A", "BUY", 200.0, 100.0, 0.0, 1e5), ("x", 1, "A", "BUY", 200.0, 100.0, 0.0, 1e5), ("x", 2, "A", "SELL", 50.0, 100.0, 0.0, 1e5), ("x", 3, "B", "BUY", 900.0, 100.0, 0.0, 1e5)]
    df = spark.createDataFrame(rows, "book string, nth int, ticker string, action string, quantity double, price double, held double, equity double")
    assert [r["approved"] for r in portfolio.gate_in_order(df).orderBy("nth").collect()] == [200, 50, 50, 250]
    state = spark.createDataFrame([("filled", 5.0, 5.0), ("NEW", 5.0, None), ("open", 5.0, 7.0)], "status string, quantity double, filled double")
    assert [(r["is_terminal"], r["remaining"]) for r in portfolio.order_state(state).collect()] == [(True, 0), (False, 5), (False, 0)]
    ids = spark.range(1).select(*(portfolio.order_id(F.lit("c1"), F.lit(t), F.lit("buy"), F.lit(q)).alias(n) for n, t, q in (("a", "aapl", 1.0), ("b", "AAPL", 1.00001), ("c", "AAPL", 2.0)))).first()
    assert ids["a"] == ids["b"] != ids["c"] and len(ids["a"]) == 24
    cost = spark.range(1).select(portfolio.trade_cost(F.lit(-40.0), F.lit(10.0), F.lit(1000.0)).alias("c"), portfolio.trade_cost(F.lit(4.0), F.lit(10.0), F.lit(0.0)).alias("d"), portfolio.expected_return(F.lit(0.6), F.lit(0.3)).alias("e")).first()
    assert cost["c"] == pytest.approx(400 * (5e-4 + 5e-4 * 2)) and cost["d"] == pytest.approx(40 * 1e-3) and cost["e"] == pytest.approx(0.06)
    ret = spark.createDataFrame([(DAY + dt.timedelta(days=k),) for k in range(0, 100) if k != 30], "ts timestamp_ntz")
    # the last of January is missing: the first day after it counts
    assert [r["ts"].strftime("%m-%d") for r in portfolio.rebalance_days(ret, "month", 5).orderBy("ts").collect()] == ["02-01", "02-29", "03-31"]


def test_stress_and_audit(spark):
    order = {"ticker": "A", "action": "buy", "quantity": 10.0, "price": 100.0, "is_closing": False, "equity": 1e5, "peak": 1e5, "day_start": 1e5, "pnl_today": 0.0, "held": 0.0, "gross": 0.0, "net": 0.0, "sector": None, "sector_held": 0.0, "forecast_vol": None, "baseline_vol": None}
    schema = "ticker string, action string, quantity double, price double, is_closing boolean, equity double, peak double, day_start double, pnl_today double, held double, gross double, net double, sector string, sector_held double, forecast_vol double, baseline_vol double"
    rows = [tuple((order | change).values()) for change in portfolio.stress_orders().values()]
    got = portfolio.audit(portfolio.risk_gate(spark.createDataFrame(rows, schema)))
    assert sorted((r["status"], r["rule"], r["approved_value"]) for r in got.collect()) == [("BLOCKED", "DAILY_LOSS_LIMIT", 0), ("BLOCKED", "DRAWDOWN_KILL_SWITCH", 0), ("RESIZED", "VOLATILITY_DERISKING", 500)]
    assert len(got.columns) == 10


def test_policies(spark):
    good, bad = bars(spark, [5, 6, 7]), bars(spark, [5, -6, 7])
    now = "2024-01-04"
    assert policy.checked(good, now) is good
    with pytest.raises(policy.DataBlocked, match="range") as e:
        policy.checked(bad, now)
    assert e.value.report.count() == 4
    assert policy.checked(bad, now, {"range": "warn"}) is bad
    told = policy.apply(cleaning.validate(bad, now), {"range": "warn", "order": "ignore"})
    assert {(r["rule"], r["severity"], r["policy"]) for r in told.collect()} == {("schema", "critical", "block"), ("range", "warning", "warn"), ("freshness", "warning", "warn")}
    history = told.withColumns({"ts": F.lit(DAY), "symbol": F.lit("A")})
    reports, rules = policy.trends(history)
    assert reports.first()["is_valid"] and reports.first()["n_warning"] == 1 and [(r["rule"], r["n"]) for r in rules.collect()] == [("range", 1)]
    s = policy.summary(bad.union(bad.limit(1))).first()
    assert s["duplicates"] == 1 and s["negatives"] == 1 and s["issues"] == "1 duplicates; 1 negatives" and policy.summary(good).first()["issues"] == "none"


def test_stores(spark, tmp_path):
    b = store.BarStore(spark, str(tmp_path / "bars"))
    b.save(bars(spark, [1, 2, 3]).union(bars(spark, [4, 5], "B/x")))
    assert [r["close"] for r in b.latest(2, 1).where("symbol = 'A'").orderBy("ts").collect()] == [1, 2]
    with pytest.raises(KeyError):
        b.read("Q")
    assert b.delete("B/x") and not b.delete("B/x") and [r["symbol"] for r in b.symbols().collect()] == ["A"]
    n = records.NewsStore(spark, str(tmp_path / "news"))
    row = lambda t, h, k: (t, h, DAY + dt.timedelta(hours=k))
    make = lambda *rows: spark.createDataFrame(rows, "ticker string, headline string, published_at timestamp")
    n.save(make(row("a", "one", 5), row("A", "one", 3), row("B", "two", 1)))
    n.save(make(row("A", "three", 9), row("A", "one", 1)))
    assert [(r["ticker"], r["headline"], r["published_at"].hour) for r in n.query().collect()] == [("A", "one", 1), ("B", "two", 1), ("A", "three", 9)]
    assert [r["headline"] for r in n.query("a", "2024-01-01 02:00:00", "2024-01-01 09:00:00", ["headline"]).collect()] == ["three"]
    path = tmp_path / "list.csv"
    path.write_text("ticker,delisting_date,reason\n abc ,2020-05-01, merged \nABC,2019-01-01,old\nxyz,none,\n,2020-01-01,x\n")
    got = records.delisted(spark, str(path))
    assert [(r["ticker"], str(r["delisting_date"]), r["reason"]) for r in got.collect()] == [("ABC", "2020-05-01", "merged"), ("XYZ", "None", None)]
    new = spark.createDataFrame([("xyz ", dt.date(2021, 1, 1), "gone")], "ticker string, delisting_date date, reason string")
    assert [(r["ticker"], r["reason"]) for r in records.add_delistings(got, new).collect()] == [("ABC", "merged"), ("XYZ", "gone")]
    splits = spark.createDataFrame([("A", DAY, f) for f in (4.0, 1.5, 0.1, 1.0, -2.0, 0.4)], "symbol string, ts timestamp_ntz, factor double")
    assert [r["ratio"] for r in records.known_splits(splits).collect()] == ["4:1", "1.50:1", "1:10", "1:2.50"]
    log = str(tmp_path / "log")
    events = spark.createDataFrame([("2024-01-01T10:00:00", "order", "info", "a", "{}"), ("2024-01-02T10:00:00", "risk", "warning", "b", None)], records.EVENT)
    records.log_events(events, log)
    (tmp_path / "log" / "date=2024-01-01" / "more.json").write_text('\n{"timestamp": "2024-01-01T11:00:00", "kind": "order", "severity": "info"}\nnot json\n')
    assert records.read_events(spark, log, "2024-01-01").where("kind is not null").count() == 2
    assert {(str(r["date"]), r["kind"], r["n"]) for r in records.event_summary(records.read_events(spark, log).where("kind is not null")).collect()} == {("2024-01-01", "order", 2), ("2024-01-02", "risk", 1)}


def test_news_features(spark):
    news = spark.createDataFrame([("A", DAY + dt.timedelta(hours=h), s) for h, s in ((1, 0.5), (2, -0.5), (30, 0.0))], "ticker string, published_at timestamp, score double")
    got = nlp.daily_sentiment(news).orderBy("date").collect()
    assert (got[0]["n"], got[0]["n_positive"], got[0]["n_negative"], got[1]["dev"]) == (2, 1, 1, 0) and got[0]["dev"] == pytest.approx(math.sqrt(0.5))
    assert nlp.known_by(news, F.lit("2024-01-01 02:00:00").cast("timestamp")).count() == 2
    joined = spark.createDataFrame([("A", DAY, DAY - dt.timedelta(hours=1)), ("A", DAY, DAY + dt.timedelta(hours=1))], "symbol string, ts timestamp_ntz, published_at timestamp")
    assert nlp.leaks(joined, bars(spark, [1])).count() == 1
    assert spark.range(1).select(nlp.hedge_density(F.lit("We may, or may not. x"), ["may"]).alias("d")).first()["d"] == pytest.approx(1000 * 2 / 5)
    calls = spark.createDataFrame([("A", "2024-01-01", "record growth\nmay rise\nQuestions and answers\nlosses fell"), ("B", "2024-01-01", "plain words"), ("C", "2024-01-01", "")], "ticker string, call_date string, text string")
    got = {r["ticker"]: r for r in nlp.call_features(calls, ["may"], 2).collect()}
    assert got["A"]["prepared"] > 0 > got["A"]["answers"] and got["A"]["answer_share"] == pytest.approx(5 / 9, abs=1e-4) and got["A"]["delta"] == pytest.approx(got["A"]["answers"] - got["A"]["prepared"], abs=2e-4)
    assert got["B"]["answers"] == got["B"]["prepared"] == 0 and got["B"]["answer_share"] == 0 and got["C"]["overall"] == 0 and got["C"]["word_count"] == 0


def test_small_functions(spark):
    adj = spark.createDataFrame([("A", DAY + dt.timedelta(days=k), 100.0, a) for k, a in enumerate((98.0, 98.0, 100.0))], "symbol string, ts timestamp_ntz, close double, adj_close double")
    assert [(r["ts"].day, r["dividend"]) for r in cleaning.dividends(adj).collect()] == [(3, 2.0)]
    open_ = lambda t: spark.range(1).select(cleaning.market_open(F.lit(t).cast("timestamp"), ["2024-01-15"]).alias("o")).first()["o"]
    assert [open_(t) for t in ("2024-01-16 14:30:00", "2024-01-16 14:29:00", "2024-01-16 21:00:00", "2024-01-15 15:00:00", "2024-01-13 15:00:00", "2024-07-16 13:30:00")] == [True, False, False, False, False, True]
    got = cleaning.cross_source(bars(spark, [100, 100, 100]), bars(spark, [100, 110, 104])).first()
    assert (got["n"], got["n_apart"]) == (3, 1)
    member = spark.createDataFrame([("A", None, dt.date(2024, 1, 5)), ("B", dt.date(2024, 1, 3), None)], "symbol string, valid_from date, valid_to date")
    dates = spark.createDataFrame([(dt.date(2024, 1, 2),), (dt.date(2024, 1, 4),)], "date date")
    gone = spark.createDataFrame([("A", dt.date(2024, 1, 4), "merged")], "symbol string, delisting_date date, reason string")
    assert sorted((str(r["date"]), r["symbol"], r["is_delisted"]) for r in universe.detail(member, dates, gone).collect()) == [("2024-01-02", "A", False), ("2024-01-04", "A", True), ("2024-01-04", "B", False)]
    m = returns(spark, [0.01, -0.02, 0.03, 0.01]).select("ts", F.col("ret").alias("m"))
    got = metrics.against(returns(spark, [0.02, -0.04, 0.06, 0.02]), m).first()
    assert got["beta"] == pytest.approx(2) and got["alpha"] == pytest.approx(0) and got["corr"] == pytest.approx(1)
    windows = spark.createDataFrame([("w", DAY, DAY + dt.timedelta(days=4)), ("short", DAY, DAY)], "name string, start timestamp_ntz, stop timestamp_ntz")
    assert [(r["name"], r["n"], round(r["total"], 6)) for r in metrics.crisis_windows(returns(spark, [0.1] * 9), windows).collect()] == [("w", 5, round(1.1**5 - 1, 6))]
    rows = spark.createDataFrame([("A", k, float(k), int(k >= 50)) for k in range(100)] + [("B", k, float(k), k % 2) for k in range(100)], "symbol string, ts int, x double, y int")
    got = {r["symbol"]: r["information"] for r in models.information(rows, "x", "y").collect()}
    assert got["A"] == pytest.approx(math.log(2)) and got["B"] == pytest.approx(0)
    head = lambda *r: spark.createDataFrame(r, "ticker string, headline string, published_at timestamp")
    merged = store.merge_news(head(("A", "x", DAY)), head(("A", "x", DAY - dt.timedelta(days=1)), ("A", "y", DAY)))
    assert sorted((r["headline"], r["published_at"].day) for r in merged.collect()) == [("x", 31), ("y", 1)]
    got = store.manifest(spark.createDataFrame([("2024-01-02", 1), ("bad", 2), ("2024-01-01", 3)], "date string, v int"), "date").first()
    assert got["rows"] == 3 and got["first"].day == 1 and got["last"].day == 2 and got["columns"] == "date,v"


def test_window_bars(spark, tmp_path):
    src = str(tmp_path / "ticks")
    spark.createDataFrame([("A", DAY + dt.timedelta(minutes=m), v) for m, v in ((1, 1.0), (2, 3.0), (7, 2.0))], streams.TICK).write.parquet(src)
    out = streams.window_bars(spark.readStream.schema(streams.TICK).parquet(src))
    assert out.isStreaming and {"symbol", "open", "high", "low", "close"} <= set(out.columns)


def test_regimes(spark):
    rng = np.random.default_rng(3)
    r = np.concatenate([rng.normal(0, 0.01, 100), rng.normal(0, 0.05, 100)])
    got = {x["regime"]: x for x in metrics.by_regime(metrics.volatility_regime(returns(spark, r))).collect()}
    assert set(got) == {0, 1, 2} and sum(x["share"] for x in got.values()) == pytest.approx(1) and got[0]["volatility"] < got[2]["volatility"]
