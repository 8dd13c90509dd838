import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from barloom.operators import cleaning, features, joins, nlp, portfolio, recurrences, universe
from barloom.sources import bars as store
from barloom.streaming import bars as streams

DAY = dt.datetime(2024, 1, 1)


def series(spark, closes, symbol="A", **more):
    rows = [(symbol, DAY + dt.timedelta(days=k), float(c), float(c), float(c), float(c), 1000.0) for k, c in enumerate(closes)]
    return spark.createDataFrame(rows, store.BARS)


def column(df, name):
    return [r[name] for r in df.orderBy("symbol", "ts").collect()]


def test_hand_computed_momentum(spark):
    assert column(features.compute(series(spark, [80, 82, 79, 84, 90, 88, 41]), ["mom_5d"]), "mom_5d") == [None] * 5 + [pytest.approx(0.1), pytest.approx(-0.5)]
    with pytest.raises(ValueError):
        features.momentum_skip(F.col("close"), 10, 10)
    with pytest.raises(ValueError, match="lack"):
        features.compute(series(spark, [1]).drop("high"), ["true_range"])


def test_wilder_rsi_vector():
    got = recurrences.rsi(np.array([50, 53, 52, 55, 54, 57], float), 3)
    assert np.isnan(got[:3]).all() and got[3:] == pytest.approx([100 - 100 / 7, 100 - 100 / 3.4, 100 - 100 / 6.1])
    assert recurrences.rsi(np.arange(20.0))[-1] == 100 and recurrences.rsi(-np.arange(20.0))[-1] == 0 and recurrences.rsi(np.ones(20))[-1] == 50


def test_no_look_ahead(spark):
    rng = np.random.default_rng(1)
    closes = 100 * np.exp(np.cumsum(rng.normal(0.0005, 0.015, 150)))
    names = [f.name for f in features.registered() if f.lookback < 100]
    whole, cut = (features.compute(series(spark, c), names).orderBy("ts").collect() for c in (closes, closes[:120]))
    for a, b in zip(whole, cut):
        for n in names:
            assert (a[n] is None) == (b[n] is None) and (a[n] is None or a[n] == pytest.approx(b[n], rel=1e-9, abs=1e-9)), n


def test_spikes_and_filling(spark):
    one = cleaning.flags(series(spark, [100, 100, 130, 101, 100]))
    assert column(one, "is_spike") == [False, False, True, False, False]
    assert column(cleaning.fill_forward(one), "close") == [100, 100, 100, 101, 100]
    assert cleaning.drop_bad(one).count() == 4
    assert column(cleaning.two_bar_spikes(series(spark, [100, 130, 131, 101, 100])), "is_spike") == [False, True, True, False, False]
    both = series(spark, [100, 101]).union(series(spark, [100]))
    assert sum(column(cleaning.flags(both), "is_duplicate")) == 1


def test_splits(spark):
    b = series(spark, [100, 102, 51, 52])
    found = cleaning.splits(b)
    assert [(r["factor"], round(r["ratio"], 2)) for r in found.collect()] == [(2.0, 0.5)]
    assert column(cleaning.adjust_splits(b, found.select("symbol", "ts", "factor")), "close") == [50, 51, 51, 52]
    two = spark.createDataFrame([("A", DAY + dt.timedelta(days=k), f) for k, f in ((2, 2.0), (3, 4.0), (1, 1.0), (9, 3.0))], "symbol string, ts timestamp_ntz, factor double")
    # the split of day 3 is in the prices already, that of day 9 lies after them
    assert sorted(r["volume"] for r in cleaning.adjust_splits(b.union(b.where("close = 52")), two).collect()) == [3000, 3000, 3000, 6000, 6000]
    known = spark.createDataFrame([("A", DAY + dt.timedelta(days=3), 4.0), ("B", DAY, 3.0)], "symbol string, ts timestamp_ntz, factor double")
    assert sorted((r["symbol"], r["factor"], r["origin"]) for r in cleaning.with_authority(found, known).collect()) == [("A", 4.0, "authoritative"), ("B", 3.0, "authoritative")]
    assert [r["factor"] for r in cleaning.splits(series(spark, [10, 100])).collect()] == [0.1]


def test_validation_rules(spark):
    state = lambda b: {r["rule"]: r["passed"] for r in cleaning.validate(b, "2024-01-05").collect()}
    assert all(state(series(spark, [100, 101, 102])).values())
    assert not state(series(spark, [100, -1]))["range"] and not state(series(spark, [100]).drop("volume"))["schema"]
    assert not {r["rule"]: r["passed"] for r in cleaning.validate(series(spark, [1]), "2024-03-01").collect()}["freshness"]


def test_membership(spark):
    d = dt.date
    now = spark.createDataFrame([("A",), ("B",)], "symbol string")
    moves = spark.createDataFrame([(d(2017, 6, 1), "A", "C"), (d(2020, 1, 1), "B", None), (d(2018, 1, 1), None, "B")], "date date, added string, removed string")
    m = universe.intervals(now, moves)
    days = spark.createDataFrame([(d(2016, 1, 1),), (d(2017, 6, 1),), (d(2019, 1, 1),), (d(2021, 1, 1),)], "date date")
    got = {}
    for r in universe.members(m, days).collect():
        got.setdefault(r["date"].year, set()).add(r["symbol"])
    assert got == {2016: {"B", "C"}, 2017: {"A", "B"}, 2019: {"A"}, 2021: {"A", "B"}}


def test_as_of_expires(spark):
    t = lambda n: DAY + dt.timedelta(days=n)
    left = spark.createDataFrame([("A", t(k)) for k in (0, 1, 2, 40, 95)] + [("B", t(1))], "ticker string, ts timestamp")
    calls = spark.createDataFrame([("A", t(0) + dt.timedelta(hours=21), 1.0), ("A", t(30), 2.0)], "ticker string, call_date timestamp, score double")
    got = {(r["ticker"], (r["ts"] - DAY).days): (r["score"], r["has_active"]) for r in nlp.align_calls(left, calls, ["score"], 60).collect()}
    assert got == {("A", 0): (None, 0), ("A", 1): (1.0, 1), ("A", 2): (1.0, 1), ("A", 40): (2.0, 1), ("A", 95): (None, 0), ("B", 1): (None, 0)}


def test_reconcile(spark):
    own, other = (spark.createDataFrame(r, "symbol string, qty double") for r in ([("A", 1.0), ("B", 2.0), ("C", 3.0)], [("B", 2.0), ("C", 4.0), ("D", 5.0)]))
    assert sorted((r["symbol"], r["kind"]) for r in joins.reconcile(own, other).collect()) == [("A", "ghost"), ("C", "mismatch"), ("D", "missing")]


def test_pair_states(spark):
    z = [1.9, -4.0, -3.6, -2.4, None, 2.7, 0.1, 3.9, 3.4, 0.3, -2.1, 0.5]
    want = [0, 1, 0, 1, 0, -1, 0, -1, -1, -1, 0, 0]
    df = spark.createDataFrame([("p", k, v) for k, v in enumerate(z)], "pair string, ts int, z double")
    got = [r["signal"] for r in portfolio.pair_signals(df, ["pair"], leave=0.2).orderBy("ts").collect()]
    assert got == want


def test_sizes(spark):
    one = spark.range(1).select(portfolio.kelly(F.lit(0.6), F.lit(1.0)).alias("k"), portfolio.kelly(F.lit(0.4), F.lit(1.0)).alias("none"), portfolio.position_size(F.lit(0.9), F.lit(2.0)).alias("cap")).first()
    assert one["k"] == pytest.approx(0.2) and one["none"] == 0 and one["cap"] == 0.25


def test_risk_gate(spark):
    order = {"action": "BUY", "quantity": 10.0, "price": 100.0, "is_closing": False, "equity": 1e5, "peak": 1e5, "day_start": 1e5, "pnl_today": 0.0, "held": 0.0, "gross": 0.0, "net": 0.0, "sector": None, "sector_held": 0.0, "forecast_vol": None, "baseline_vol": None}
    cases = {
        "plain": ({}, ("APPROVED", "NONE", 10)),
        "position": ({"quantity": 500.5}, ("RESIZED", "POSITION_LIMIT", 250)),
        "position full": ({"held": 25_000.0}, ("BLOCKED", "POSITION_LIMIT", 0)),
        "fallen": ({"equity": 8e4}, ("BLOCKED", "DRAWDOWN_KILL_SWITCH", 0)),
        "loss": ({"pnl_today": -3_000.0}, ("BLOCKED", "DAILY_LOSS_LIMIT", 0)),
        "reducing": ({"equity": 8e4, "held": 900.0, "action": "sell", "quantity": 12.0}, ("APPROVED", "NONE", 12)),
        "closing": ({"pnl_today": -9_000.0, "is_closing": True}, ("APPROVED", "NONE", 10)),
        "wild": ({"forecast_vol": 0.4, "baseline_vol": 0.1}, ("RESIZED", "VOLATILITY_DERISKING", 2.5)),
        "wildest": ({"forecast_vol": 2.0, "baseline_vol": 0.1}, ("RESIZED", "VOLATILITY_DERISKING", 2)),
        "calm": ({"forecast_vol": 0.15, "baseline_vol": 0.1}, ("APPROVED", "NONE", 10)),
        "sector": ({"sector": "x", "sector_held": 39_500.0}, ("RESIZED", "SECTOR_CONCENTRATION_LIMIT", 5)),
        "sector full": ({"sector": "x", "sector_held": 41_000.0}, ("BLOCKED", "SECTOR_CONCENTRATION_LIMIT", 0)),
        "gross": ({"gross": 99_200.0}, ("RESIZED", "GROSS_EXPOSURE_LIMIT", 8)),
        "gross full": ({"gross": 1e5}, ("BLOCKED", "GROSS_EXPOSURE_LIMIT", 0)),
        "net": ({"net": 99_500.0}, ("BLOCKED", "NET_EXPOSURE_LIMIT", 0)),
        "net of a sale": ({"net": 99_500.0, "action": "SELL"}, ("APPROVED", "NONE", 10)),
    }
    schema = "ticker string, action string, quantity double, price double, is_closing boolean, equity double, peak double, day_start double, pnl_today double, held double, gross double, net double, sector string, sector_held double, forecast_vol double, baseline_vol double"
    df = spark.createDataFrame([(name, *(order | change).values()) for name, (change, _) in cases.items()], schema)
    got = {r["ticker"]: (r["status"], r["rule"], pytest.approx(r["approved"])) for r in portfolio.risk_gate(df).collect()}
    assert got == {name: want for name, (_, want) in cases.items()}


def test_backtest_books(spark):
    rows = [("s", "A", k, p, 1e9, w) for k, (p, w) in enumerate([(10.0, 0.5), (10.0, 0.5), (12.0, 0.0), (12.0, 0.0)])]
    df = spark.createDataFrame([(s, a, DAY + dt.timedelta(days=k), p, v, w) for s, a, k, p, v, w in rows], "strategy string, symbol string, ts timestamp_ntz, close double, volume double, weight double")
    got = portfolio.backtest(df, capital=1000.0, commission=0.001, slippage=0.0).orderBy("ts").collect()
    books = [r for r in got if r["symbol"] is None]
    # 50 shares at 10; at 12 the equity 1099.5 asks for 45.8125 shares; then all go
    left = 1099.5 / 24
    assert [r["turnover"] for r in books] == [0, 500, pytest.approx((50 - left) * 12), pytest.approx(left * 12)]
    assert [r["equity"] for r in books] == [1000, 999.5, pytest.approx(1099.5 - (50 - left) * 0.012), pytest.approx(1099.5 - 50 * 0.012)]
    assert books[-1]["cash"] == pytest.approx(books[-1]["equity"]) and books[1]["ret"] == pytest.approx(-0.0005)
    trades = [r for r in got if r["symbol"]]
    assert [(r["side"], r["bars"], r["entry_price"], r["exit_price"]) for r in trades] == [("LONG", 1, 10, 12), ("LONG", 2, 10, 12)]
    assert sum(r["pnl"] for r in trades) == pytest.approx(100 - 50 * 0.012)
    flat = portfolio.vector_backtest(df.select("symbol", "ts", "close"), df.select("symbol", "ts", "weight"), cost=0.0).orderBy("ts").collect()
    assert [r["gross"] for r in flat] == [0, 0, pytest.approx(0.1), 0] and [r["turnover"] for r in flat] == [0, 0.5, 0, 0.5]


def test_headlines(spark):
    names = {"AAPL": ["apple"], "MSFT": ["microsoft"]}
    news = spark.createDataFrame([("AAPL", "Apple  rises https://x.y/z", DAY), ("AAPL", "apple rises!", DAY + dt.timedelta(hours=1)), ("AAPL", "tiny", DAY)], "ticker string, headline string, published_at timestamp")
    got = nlp.deduplicate(news).collect()
    assert [r["headline"] for r in got] == ["Apple rises"]
    ask = lambda text, *a: news.select(nlp.map_ticker(F.lit(text), *a).alias("t")).first()["t"]
    assert ask("buy microsoft, says AAPL", names) == "AAPL" and ask("aapl jumps") == "AAPL" and ask("Fed waits") == "SPY" and ask("éAAPL") is None and ask("nothing") is None
    text = spark.createDataFrame([("a b c\n\nd e\n\nf g h i j. k l", )], "t string")
    assert text.select(nlp.chunks(F.col("t"), 5).alias("c")).first()["c"] == ["a b c\nd e", "f g h i j.", "k l"]
    assert text.select(nlp.sections(F.lit("we grew. Questions and Answers: none")).alias("s")).first()["s"]["prepared"] == "we grew. "


def test_headlines_of_any_script(spark):
    texts = ["株価が上昇しました", "株価が下落しました", "株価が、上昇しました!", "Ärzte_1 gewinnen", "ärzte_1 gewinnen?", "ärzte1 gewinnen"]
    news = spark.createDataFrame([("A", t, DAY + dt.timedelta(hours=k)) for k, t in enumerate(texts)], "ticker string, headline string, published_at timestamp")
    assert [r["headline"] for r in nlp.deduplicate(news).orderBy("published_at").collect()] == [texts[0], texts[1], texts[3], texts[5]]


def test_lexicon(spark):
    df = spark.createDataFrame([(0, "Profit surges, a record gain"), (1, "weak_down weak losses"), (2, None), (3, "beat and miss"), (4, "no word")], "id int, text string")
    out = nlp.lexicon_scores(df)
    got = {r["id"]: (r["label"], round(r["score"], 4), round(r["neutral"], 4)) for r in out.collect()}
    part = lambda p, n: (p + 0.1) / (p + n + 0.3)
    whole = part(4, 0) + part(0, 4) + 0.05
    assert got[0] == ("positive", round((part(4, 0) - part(0, 4)) / whole, 4), round(0.05 / whole, 4))
    assert got[1][0] == "negative" and got[2] == got[4] == ("neutral", 0.0, 0.85) and got[3][:2] == ("neutral", 0.0)
    assert out._jdf.queryExecution().optimizedPlan().toString().count("regexp_extract_all") == 1


def test_profit_factor(spark):
    from barloom.operators import metrics

    df = spark.createDataFrame([("up", 0.1), ("up", 0.2), ("both", 0.3), ("both", -0.1), ("down", -0.1), ("none", 0.0)], "symbol string, ret double")
    got = {r["symbol"]: r["x"] for r in df.groupBy("symbol").agg(metrics.profit_factor(F.col("ret")).alias("x")).collect()}
    assert got == {"up": float("inf"), "both": pytest.approx(3), "down": 0, "none": 0}


def test_performance(spark):
    from barloom.operators import metrics

    rows = [("A", k, r) for k, r in enumerate([0.1, -0.5, 0.2, 0.2, 0.6])] + [("B", 0, 0.1)]
    df = spark.createDataFrame(rows, "symbol string, ts int, ret double")
    got = {r["symbol"]: r for r in metrics.performance(df).collect()}
    total = 1.1 * 0.5 * 1.2 * 1.2 * 1.6 - 1
    assert got["A"]["total_return"] == pytest.approx(total) and got["A"]["max_drawdown"] == pytest.approx(-0.5) and got["A"]["longest_drawdown"] == 3
    assert got["A"]["calmar"] == pytest.approx(((1 + total) ** (252 / 5) - 1) / 0.5) and got["B"]["calmar"] == got["B"]["sharpe"] == got["B"]["total_return"] == 0
    told = spark.createDataFrame([("A", 0, 1, 0.5), ("A", 1, 0, 0.5), ("A", 2, None, 0.5), ("A", 3, 1, None)], "symbol string, ts int, p int, next double")
    assert [r["ret"] for r in metrics.strategy_returns(told).orderBy("ts").collect()] == [0.5, -0.5] and [r["ret"] for r in metrics.strategy_returns(told, long_only=True).orderBy("ts").collect()] == [0.5, 0]


def test_store(spark, tmp_path):
    s = store.BarStore(spark, str(tmp_path / "bars"))
    s.save(series(spark, [1, 2, 3]).union(series(spark, [9], "B")))
    s.save(series(spark, [7, 7, 7, 4]), overwrite=False)
    assert [r["close"] for r in s.query("A").collect()] == [1, 2, 3, 4]
    part = s.query("A", "2024-01-02", "2024-01-03", ["ts", "close"])
    assert [r["close"] for r in part.collect()] == [2, 3] and [r["symbol"] for r in s.symbols("B").collect()] == ["B"]
    plan = part._jdf.queryExecution().toString()
    assert "PartitionFilters: [isnotnull(symbol" in plan and "PushedFilters: [IsNotNull(ts)" in plan


def test_stream_cuts_each_symbol_by_itself(spark, tmp_path):
    t = lambda m: DAY + dt.timedelta(minutes=m)
    src, out, log = (str(tmp_path / n) for n in ("src", "out", "log"))
    batches = [[("A", t(5), 1.0), ("A", t(3), 2.0), ("A", t(5), 9.0)], [("A", t(5), 3.0), ("A", t(4), 4.0), ("A", t(6), 5.0), ("B", t(1), 6.0)]]
    for rows in batches:
        spark.createDataFrame(rows, streams.TICK).coalesce(1).write.mode("append").parquet(src)
        got = streams.run_once(streams.timely(spark.readStream.schema(streams.TICK).parquet(src)), out, log)
    assert sorted((r["symbol"], (r["ts"] - DAY).seconds // 60, r["value"]) for r in got.collect()) == [("A", 3, 2.0), ("A", 5, 1.0), ("A", 6, 5.0), ("B", 1, 6.0)]
    expected = spark.createDataFrame([("A",), ("B",), ("C",)], "symbol string")
    newest = got.groupBy("symbol").agg(F.max("ts").alias("ts"))
    state = {r["symbol"]: r["status"] for r in streams.staleness(newest, expected, "2024-01-01 00:07:00").collect()}
    assert state == {"A": "LIVE", "B": "STALE", "C": "WAITING"}


def test_a_symbol_is_cut_by_many_tasks(spark, tmp_path):
    src, out, log = (str(tmp_path / n) for n in ("src", "out", "log"))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # the rows are few
    for lo in (0, 3000):
        day = F.timestamp_seconds(F.lit(1704067200) + F.expr(f"id * 2 + {lo}"))
        spark.range(4000).select(F.when(F.col("id") < 3990, "A").alias("symbol"), day.alias("ts"), F.col("id").cast("double").alias("value")).write.mode("append").parquet(src)
        ticks = spark.readStream.schema(streams.TICK).parquet(src)
        got = streams.run_once(streams.timely(ticks), out, log)
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    # the second part of A ends 3000 s after the first; the rows without a symbol have a cutoff of their own
    n = {r["symbol"]: r["count"] for r in got.groupBy("symbol").count().collect()}
    assert n == {"A": 3990 + 1500, None: 20}
    files = [f for f in (tmp_path / "out" / "rows-0").iterdir() if f.suffix == ".parquet" and spark.read.parquet(str(f)).where("symbol = 'A'").count()]
    assert len(files) > 1
    # a micro-batch that is replayed replaces itself
    streams.timely(ticks).write(spark.read.schema(streams.TICK).parquet(src).where("value > 3995"), 1, out)
    assert spark.read.parquet(f"{out}/rows-*").count() == 4000 + 4


def test_stream_bars_counts_events_of_one_time(spark, tmp_path):
    import __spark_entry__ as entry

    rows = [(k, DAY + dt.timedelta(minutes=k // 2), k, "view", 1.0 * (k // 2), "{}") for k in range(10)] + [(99, None, 1, "view", 5.0, "{}")]
    spark.createDataFrame(rows, "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string").coalesce(1).write.parquet(str(tmp_path / "all"))
    (part,) = (tmp_path / "all").glob("*.parquet")
    part.rename(tmp_path / "events.parquet")
    got = {r["ts"]: (r["open"], r["close"], r["volume"]) for r in entry.queries()["stream_bars"](spark, str(tmp_path)).collect()}
    assert got[DAY] == (0.0, 4.0, 10.0) and got[None][2] == 1


def test_folds(spark):
    from barloom.operators import models

    counts = spark.createDataFrame([("a", 230), ("b", 125), ("c", 128)], "symbol string, n int")
    got = sorted(tuple(r) for r in models.fold_bounds(counts).collect())
    # 230 - 100 - 5 * 5 leaves 21 for each test; the tests end with the sample and follow each other
    assert [r for r in got if r[0] == "a"] == [("a", k + 1, 0, 120 + 21 * k, 125 + 21 * k, 146 + 21 * k) for k in range(5)]
    assert not [r for r in got if r[0] == "b"] and [r[4:] for r in got if r[0] == "c"] == [(123 + k, 124 + k) for k in range(5)]
    roll = sorted(tuple(r) for r in models.fold_bounds(counts.where("symbol = 'a'").drop("symbol"), folds=2, rolling=True, train=150, embargo=0).collect())
    assert roll == [(1, 0, 150, 150, 190), (2, 40, 190, 190, 230)]


def test_persistence(spark):
    from barloom.operators import models

    rows = [("A", k, 1, "train" if k < 3 else "test", y) for k, y in ((0, 0), (1, 1), (2, 1), (5, 0), (6, 0))]
    df = spark.createDataFrame(rows, "symbol string, ts int, fold int, part string, y int")
    assert [(r["ts"], r["p"]) for r in models.persistence(df).orderBy("ts").collect()] == [(5, 1.0), (6, 0.0)]


def test_bootstrap_and_walk_forward(spark):
    from barloom.operators import metrics, models

    rng = np.random.default_rng(0)
    ret = metrics.returns(series(spark, 100 * np.exp(np.cumsum(rng.normal(0, 0.01, 300)))))
    a, b = (sorted(tuple(r) for r in models.bootstrap(ret, paths=8).collect()) for _ in range(2))
    assert a == b and len(a) == 8 and len({r[2] for r in a}) == 8
    x = rng.normal(size=(400, 2))
    rows = [("A", DAY + dt.timedelta(days=k), float(u), float(v), int(u + v / 2 > 0)) for k, (u, v) in enumerate(x)]
    df = spark.createDataFrame(rows, "symbol string, ts timestamp, u double, v double, y int")
    out = models.walk_forward(df, ["u", "v"], "y", models.symbol_folds(df, folds=2))
    assert models.classification(out, ["symbol"]).first()["accuracy"] > 0.85


def test_folds_of_each_symbol_reach_its_last_row(spark):
    from barloom.operators import models

    rows = [(s, f"2024-01-01 {k // 3600:02}:{k // 60 % 60:02}:{k % 60:02}") for s, n in (("a", 719), ("b", 166), ("c", 110)) for k in range(n)]
    df = spark.createDataFrame(rows, "symbol string, ts string")
    bounds = models.symbol_folds(df)
    got = {tuple(r) for r in bounds.where("symbol = 'a'").drop("symbol").collect()}
    assert got == {tuple(r) for r in models.fold_bounds(spark.createDataFrame([(719,)], "n int")).collect()}
    last = {r["symbol"]: (r["last"], r["n"]) for r in models.with_folds(df, bounds).where("part = 'test'").groupBy("symbol").agg(F.max("nth").alias("last"), F.countDistinct("fold").alias("n")).collect()}
    assert last == {"a": (718, 5), "b": (165, 5)}


def test_whole_sequences_and_bootstrap(spark):
    from barloom.operators import models

    rows = [("A", k, None if k == 3 else float("nan") if k == 9 else float(k), 1.0, float(10 * k)) for k in range(12)]
    df = spark.createDataFrame(rows, "symbol string, ts int, u double, v double, y double")
    assert [(r["ts"], r["target"]) for r in models.sequences(df, ["u", "v"], 3, target="y").orderBy("ts").collect()] == [(k, 10.0 * k) for k in (2, 6, 7, 8)]
    some = models.sequences(df, ["u", "v"], 3, target="y", most_missing=0.2).orderBy("ts").collect()
    assert [r["ts"] for r in some] == list(range(2, 12)) and some[1]["x"] == [[1.0, 1.0], [2.0, 1.0], [0.0, 1.0]] and some[1]["mask"] == [True, True, False]
    ret = spark.createDataFrame([("A", k, 0.01) for k in range(300)], "symbol string, ts int, ret double")
    got = models.bootstrap(ret).collect()
    assert len(got) == 1000 and all(np.isclose(r["total"], 1.01**300 - 1) for r in got)
