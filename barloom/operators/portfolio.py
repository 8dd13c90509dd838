"""Position sizes, pairs, costs and risk rules as expressions and ordered scans."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barloom.functions.lineage import settled
from barloom.functions.windows import div, last, ordered
from barloom.operators import ledger

C = F.col


def kelly(p: Column, odds: Column) -> Column:
    """(p * odds - (1 - p)) / odds, 0 without an edge or with senseless input."""
    edge = p * odds - (1 - p)
    return F.when((p <= 0) | (p >= 1) | (odds <= 0) | (edge <= 0), 0.0).otherwise(div(edge, odds))


def kelly_parameters(r: Column) -> tuple[Column, Column]:
    """(win rate, payoff ratio) of returns; (0.5, 1) for fewer than five, (0, 1) without gains, (1, 2) without losses."""
    n, wins, losses = F.count_if(r != 0), F.count_if(r > 0), F.count_if(r < 0)
    payoff = F.avg(F.when(r > 0, r)) / (F.avg(F.when(r < 0, -r)) + 1e-9)
    rate = F.when(n < 5, 0.5).when(wins == 0, 0.0).when(losses == 0, 1.0).otherwise(F.round(wins / n, 4))
    ratio = F.when((n < 5) | (wins == 0), 1.0).when(losses == 0, 2.0).otherwise(F.round(payoff, 4))
    return rate, ratio


def position_size(p: Column, odds: Column, *, fraction: float = 0.5, least: float = 0.52, cap: float = 0.25) -> Column:
    """Fractional Kelly, scaled by how far p exceeds `least` (twofold at most), capped; 0 below `least`."""
    size = kelly(p, odds) * min(1.0, fraction) * F.least(F.lit(2.0), 1 + 4 * (p - least))
    return F.when(p < least, 0.0).otherwise(F.round(F.least(F.lit(cap), size), 4))


def covariances(ret: DataFrame, yearly: int = 252) -> DataFrame:
    """a, b, cov (yearly) of the returns of each pair of symbols, a <= b, over the times that both have."""
    one = ret.select("symbol", "ts", "ret")
    both = one.select(C("symbol").alias("a"), "ts", C("ret").alias("x")).join(one.select(C("symbol").alias("b"), "ts", C("ret").alias("y")), "ts").where("a <= b")
    return both.groupBy("a", "b").agg((yearly * F.covar_samp("x", "y")).alias("cov"))


def hedge(pair: DataFrame, n: int = 60, least: int = 30, z: int = 30) -> DataFrame:
    """pair(a, b, ts, x, y) with the rolling hedge ratio beta of y on x, the spread and its z-score; null in the warm-up, so nothing looks ahead."""
    w = lambda k: Window.partitionBy("a", "b").orderBy("ts").rowsBetween(-(k - 1), 0)
    seen = F.count("*").over(w(n))
    beta = F.when(seen >= least, div(F.covar_samp("x", "y").over(w(n)), F.var_samp("x").over(w(n))))
    alpha = F.when(seen >= least, F.avg("y").over(w(n)) - C("beta") * F.avg("x").over(w(n)))
    out = pair.withColumn("beta", beta).withColumn("spread", C("y") - C("beta") * C("x") - alpha)
    return out.withColumn("z", F.when(F.count("spread").over(w(z)) >= 10, div(C("spread") - F.avg("spread").over(w(z)), F.stddev_samp("spread").over(w(z)))))


def pair_signals(z: DataFrame, keys: list[str], *, enter: float = 2.0, leave: float = 0.0, stop: float = 3.5) -> DataFrame:
    """keys, ts, signal: 1 from z <= -enter, -1 from z >= enter, 0 after z comes back to `leave` or passes `stop`, and where z is null; an entry may
    lie beyond the stop. Each bar depends on the one before, so each key is read in order."""

    def scan(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf, state, out = pdf.sort_values("ts", kind="stable"), 0, []
        for v in pdf["z"]:
            if pd.isna(v):
                state = 0
            elif state == 0:
                state = 1 if v <= -enter else -1 if v >= enter else 0
            elif (state == 1 and (v <= -stop or v >= -leave)) or (state == -1 and (v >= stop or v <= leave)):
                state = 0
            out.append(state)
        return pdf[[*keys, "ts"]].assign(signal=out)

    schema = ", ".join(f"{k} {t}" for k, t in z.dtypes if k in (*keys, "ts")) + ", signal int"
    return z.select(*keys, "ts", "z").groupBy(*keys).applyInPandas(scan, schema)


def rolling_kelly(df: DataFrame, p: str = "p", ret: str = "ret", *, n: int = 60, fraction: float = 0.5, cap: float = 0.25) -> DataFrame:
    """df with win_rate, payoff, kelly and size from the n returns before each row, the row's own left out; null in the warm-up, so nothing looks
    ahead. size: fractional Kelly scaled by how far the confidence p exceeds 0.52, capped."""
    w = Window.partitionBy("symbol").orderBy("ts").rowsBetween(-n, -1)
    r = C(ret)
    counts = {"_n": F.count_if(r != 0).over(w), "_up": F.count_if(r > 0).over(w), "_down": F.count_if(r < 0).over(w), "_pay": F.avg(F.when(r > 0, r)).over(w) / (F.avg(F.when(r < 0, -r)).over(w) + 1e-9), "_all": F.count(r).over(w)}
    out = df.withColumns(counts)
    warm = C("_all") < n
    rate = F.when(warm, None).when(C("_n") < 5, 0.5).when(C("_up") == 0, 0.0).when(C("_down") == 0, 1.0).otherwise(F.round(C("_up") / C("_n"), 4))
    pay = F.when(warm, None).when((C("_n") < 5) | (C("_up") == 0), 1.0).when(C("_down") == 0, 2.0).otherwise(F.round("_pay", 4))
    out = out.withColumns({"win_rate": rate, "payoff": pay}).withColumn("kelly", F.when(~warm, kelly(C("win_rate"), C("payoff"))))
    size = F.round(F.least(F.lit(cap), C("kelly") * min(1.0, fraction) * F.least(F.lit(2.0), 1 + 4 * (C(p) - 0.52))), 4)
    return out.withColumn("size", F.when(C("kelly").isNull(), None).when(C(p) < 0.52, 0.0).otherwise(size)).drop(*counts)


def pairs_backtest(df: DataFrame, *, keys: tuple[str, ...] = ("a", "b"), cost: float = 5e-4) -> DataFrame:
    """keys, ts, w_x, w_y, ret (after costs), equity (of 1) and drawdown of df(keys, ts, x, y, beta, signal): the signal of a bar is held from the next
    one on, in y against beta of x, as shares of 1 + |beta|; a null beta counts as 1."""
    w = Window.partitionBy(*keys).orderBy("ts")
    before = lambda c: F.lag(c).over(w)
    held = df.withColumns({"beta": F.coalesce("beta", F.lit(1.0)), "_p": F.coalesce(before("signal"), F.lit(0)), "_y": F.coalesce(div(C("y"), before("y")) - 1, F.lit(0.0)), "_x": F.coalesce(div(C("x"), before("x")) - 1, F.lit(0.0))})
    held = held.withColumns({"w_y": C("_p") / (1 + F.abs("beta")), "w_x": -C("_p") * C("beta") / (1 + F.abs("beta"))})
    moved = F.abs(C("w_y") - F.coalesce(before("w_y"), F.lit(0.0))) + F.abs(C("w_x") - F.coalesce(before("w_x"), F.lit(0.0)))
    held = held.withColumn("ret", C("w_y") * C("_y") + C("w_x") * C("_x") - cost * moved)
    so_far = w.rowsBetween(Window.unboundedPreceding, 0)
    held = held.withColumn("equity", F.product(1 + C("ret")).over(so_far))
    return held.select(*keys, "ts", "w_x", "w_y", "ret", "equity", (C("equity") / F.max("equity").over(so_far) - 1).alias("drawdown"), C("_p").alias("position"))


def pair_trades(books: DataFrame, *, keys: tuple[str, ...] = ("a", "b")) -> DataFrame:
    """keys, entry_ts, exit_ts, pnl of the times in a position, from the equity at the first bar in it to that at the first bar out of it, a change of side
    included; a position still open at the end is no trade."""
    w = Window.partitionBy(*keys).orderBy("ts")
    on = C("position") != 0
    change = F.coalesce((on != F.lag(on).over(w)), on).cast("int")
    marks = books.withColumn("_c", change).where("_c = 1")
    nxt = marks.withColumns({"exit_ts": F.lead("ts").over(w), "_e": F.lead("equity").over(w)}).where((C("position") != 0) & C("exit_ts").isNotNull())
    return nxt.select(*keys, C("ts").alias("entry_ts"), "exit_ts", (C("_e") - C("equity")).alias("pnl"))


def trade_statistics(trades: DataFrame, key: str = "strategy") -> DataFrame:
    """Counts, win rate, profit factor, payoff, means, extremes and holding times of closed trades(key, pnl, bars)."""
    p = C("pnl")
    win, loss = F.when(p > 0, p), F.when(p < 0, p)
    gain, lost = F.coalesce(F.sum(win), F.lit(0.0)), -F.coalesce(F.sum(loss), F.lit(0.0))
    mean_win, mean_loss = F.coalesce(F.avg(win), F.lit(0.0)), F.coalesce(F.avg(loss), F.lit(0.0))
    return trades.groupBy(key).agg(
        F.count("*").alias("n_trades"), F.count(win).alias("n_wins"), F.count(loss).alias("n_losses"), (100 * F.count(win) / F.count("*")).alias("win_rate_pct"),
        F.when(lost > 0, gain / lost).when(gain > 0, gain).otherwise(1.0).alias("profit_factor"), F.avg(p).alias("mean_pnl"), mean_win.alias("mean_win"), mean_loss.alias("mean_loss"),
        F.when(mean_loss != 0, F.abs(mean_win / mean_loss)).otherwise(mean_win).alias("payoff"), F.max(p).alias("best"), F.min(p).alias("worst"), F.avg("bars").alias("mean_bars"), F.max("bars").alias("longest_bars"),
    )


def trade_cost(qty: Column, price: Column, volume: Column, *, commission: float = 5e-4, slippage: float = 5e-4) -> Column:
    """Commission and slippage; slippage grows with the square root of the share of the volume above a hundredth."""
    share = F.coalesce(div(F.abs(qty), F.when(volume > 0, volume)), F.lit(0.0))
    return F.abs(qty) * price * (commission + slippage * F.greatest(F.lit(1.0), F.sqrt(share / 0.01)))


def vector_backtest(prices: DataFrame, weights: DataFrame, *, cost: float = 5e-4) -> DataFrame:
    """ts, gross, turnover and net return of target weights(symbol, ts, weight) held from the next bar on prices(symbol, ts, close)."""
    w = ordered()
    held = prices.join(weights, ["symbol", "ts"], "left").withColumn("weight", F.coalesce("weight", F.lit(0.0)))
    held = held.withColumns({"ret": F.coalesce(div(C("close"), F.lag("close").over(w)) - 1, F.lit(0.0)), "own": F.coalesce(F.lag("weight").over(w), F.lit(0.0))})
    held = held.withColumn("moved", F.abs(C("own") - F.coalesce(F.lag("own").over(w), F.lit(0.0))))
    day = held.groupBy("ts").agg(F.sum(C("own") * C("ret")).alias("gross"), F.sum("moved").alias("turnover"))
    return day.withColumn("net", C("gross") - cost * C("turnover"))


def backtest(bars: DataFrame, *, key: str = "strategy", capital: float = 100_000.0, commission: float = 5e-4, slippage: float = 5e-4, impact: float = 0.5, gate: ledger.Gate | None = None) -> DataFrame:
    """The books of each strategy over bars(key, symbol, ts, close, volume, weight): a row for each time (symbol null) with equity, cash, ret,
    turnover, commission and slippage, and one for each closed part of a trade, by ledger.run() and ledger.trades()."""
    books = settled(ledger.run(bars, key=key, capital=capital, commission=commission, slippage=slippage, impact=impact, gate=gate))
    return books.drop("fills", "nth", "blocked", "resized").unionByName(ledger.trades(ledger.fills(books, key), key), allowMissingColumns=True)


def derisked(forecast: Column, baseline: Column, *, spike: float = 1.5, least: float = 0.2) -> Column:
    """The share of an order that stays when the volatility forecast exceeds `spike` times its baseline."""
    calm = forecast.isNull() | baseline.isNull() | (forecast <= 0) | (baseline <= 0) | (forecast <= spike * baseline)
    return F.when(calm, 1.0).otherwise(F.round(F.greatest(F.lit(least), F.least(F.lit(1.0), div(baseline, forecast))), 4))


def risk_gate(intents: DataFrame, *, most_drawdown: float = 0.15, most_daily_loss: float = 0.03, most_position: float = 0.25, most_sector: float = 0.4, most_gross: float = 1.0, most_net: float = 1.0) -> DataFrame:
    """intents with status (APPROVED, RESIZED, BLOCKED), rule and approved quantity.

    Columns: ticker, action, quantity, price, is_closing; of the book at that moment, in money: equity, peak, day_start, pnl_today, held (of the
    ticker, signed), gross, net; sector (null: none) and sector_held; forecast_vol and baseline_vol (null: not known). Rules in order:
    drawdown, daily loss, reducing orders pass, volatility scales, position, sector and gross caps resize, the net cap blocks. The rule is the last that
    changed the order.
    """
    c = lambda x: F.coalesce(C(x), F.lit(0.0))
    drawdown = F.when(C("peak") <= 0, 0.0).otherwise(F.greatest(F.lit(0.0), (C("peak") - C("equity")) / C("peak")))
    loss = F.when((C("day_start") <= 0) | (c("pnl_today") >= 0), 0.0).otherwise(-c("pnl_today") / C("day_start"))
    buys = F.upper("action") == "BUY"
    equity, price = F.greatest(F.lit(1.0), C("equity")), F.greatest(F.lit(1e-6), C("price"))
    out = intents.withColumns(
        {
            "_reducing": C("is_closing") | ((c("held") > 0) & ~buys) | ((c("held") < 0) & buys),
            "_scaled": C("quantity") * derisked(C("forecast_vol"), C("baseline_vol")),
            "_room_position": F.greatest(F.lit(0.0), most_position * equity - F.abs(c("held"))) / price,
            "_room_sector": F.when(C("sector").isNotNull(), F.greatest(F.lit(0.0), most_sector * equity - c("sector_held")) / price),
            "_room_gross": F.greatest(F.lit(0.0), most_gross * equity - c("gross")) / price,
        }
    )
    allowed = {"position": C("_scaled"), "sector": C("_by_position"), "gross": C("_by_sector")}
    for name, before in allowed.items():
        out = out.withColumn(f"_by_{name}", F.least(before, C(f"_room_{name}")))
    net = F.abs(c("net") + F.when(buys, C("_by_gross")).otherwise(-C("_by_gross")) * price)
    # the first cap without room blocks; a cap is looked at only if the order exceeds it
    full_at = lambda name, before: (C(f"_room_{name}") <= 0) & (before > C(f"_room_{name}"))
    none = F.when(~C("_reducing") & (drawdown >= most_drawdown), "DRAWDOWN_KILL_SWITCH").when(~C("_reducing") & (loss >= most_daily_loss), "DAILY_LOSS_LIMIT").when(C("_reducing"), None)
    none = none.when(full_at("position", C("_scaled")), "POSITION_LIMIT").when(full_at("sector", C("_by_position")), "SECTOR_CONCENTRATION_LIMIT").when(full_at("gross", C("_by_sector")), "GROSS_EXPOSURE_LIMIT").when(net > most_net * equity, "NET_EXPOSURE_LIMIT")
    cut = F.when(C("_by_gross") < C("_by_sector"), "GROSS_EXPOSURE_LIMIT").when(C("_by_sector") < C("_by_position"), "SECTOR_CONCENTRATION_LIMIT").when(C("_by_position") < C("_scaled"), "POSITION_LIMIT").when(C("_scaled") < C("quantity"), "VOLATILITY_DERISKING").otherwise("NONE")
    out = out.withColumn("_blocked", none)
    status = F.when(C("_blocked").isNotNull(), "BLOCKED").when(C("_reducing") | (C("_by_gross") >= C("quantity")), "APPROVED").otherwise("RESIZED")
    rule = F.coalesce("_blocked", F.when(C("_reducing"), "NONE").otherwise(cut))
    approved = F.when(status == "BLOCKED", 0.0).when(C("_reducing"), C("quantity")).otherwise(C("_by_gross"))
    return out.select(*intents.columns, status.alias("status"), rule.alias("rule"), approved.cast("double").alias("approved"))


def gate_in_order(orders: DataFrame, *, key: str = "book", most_position: float = 0.25, most_gross: float = 1.0, most_net: float = 1.0) -> DataFrame:
    """orders(key, nth, ticker, action, quantity, price, held, equity) with approved: each book's orders in turn, against what those before it have changed.

    held (money in the ticker before the first order) and equity stand on every row. What an order may do depends on all before it, so a book is read in order,
    in a task of its own. Orders against a holding pass; others are cut to the position and gross caps, and blocked by the net cap.
    """

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("nth", kind="stable")
        book = dict(zip(pdf["ticker"], pdf["held"], strict=True))
        out = []
        for ticker, action, quantity, price, equity in zip(pdf["ticker"], pdf["action"], pdf["quantity"], pdf["price"], pdf["equity"], strict=True):
            side, now = 1 if action.upper() == "BUY" else -1, book[ticker]
            price, equity = max(price, 1e-6), max(equity, 1.0)
            size = quantity
            if now * side >= 0:
                gross = sum(map(abs, book.values()))
                size = max(0.0, min(quantity, (most_position * equity - abs(now)) / price, (most_gross * equity - gross) / price))
                if abs(sum(book.values()) + side * size * price) > most_net * equity:
                    size = 0.0
            book[ticker] = now + side * size * price
            out.append(float(size))
        return pdf.assign(approved=out)

    schema = ", ".join(f"{c} {t}" for c, t in orders.dtypes) + ", approved double"
    return orders.groupBy(key).applyInPandas(run, schema)


def expected_return(p: Column, volatility: Column, scale: float = 1.0) -> Column:
    """(2 p - 1) times the yearly volatility."""
    return (2 * p - 1) * volatility * scale


def rebalance_days(ret: DataFrame, unit: str = "month", skip: int = 126) -> DataFrame:
    """period_end and ts: the first time at or after the last day of each month, quarter or year, after the first `skip` times; if none is, the period has none."""
    days = ret.select("ts").distinct()
    begun = days.orderBy("ts").offset(skip).limit(1).select(C("ts").alias("_from"))
    late = days.join(F.broadcast(begun), C("ts") >= C("_from")).select("ts")
    end = F.last_day(F.date_trunc(unit, "ts").cast("date") + F.make_ym_interval(F.lit(0), F.lit({"month": 0, "quarter": 2, "year": 11}[unit])))
    each = late.withColumn("period_end", end).groupBy("period_end").agg(F.min("ts").alias("_first"), F.min(F.when(C("ts") >= C("period_end").cast("timestamp_ntz"), C("ts"))).alias("_at"))
    # where a period has no time from its last day on, the next period's first is the one; a row for each period stands in that window
    return each.withColumn("ts", F.coalesce("_at", F.lead("_first").over(Window.orderBy("period_end")))).where("ts is not null").select("period_end", "ts")


ENDED = ("FILLED", "CANCELLED", "EXPIRED", "REJECTED")


def order_state(orders: DataFrame) -> DataFrame:
    """orders(status, quantity, filled) with is_terminal and remaining."""
    return orders.withColumns({"is_terminal": F.upper("status").isin(*ENDED), "remaining": F.greatest(F.lit(0.0), C("quantity") - F.coalesce("filled", F.lit(0.0)))})


def stress_orders(equity: float = 100_000.0) -> dict[str, dict]:
    """What changes in an order's book under three scenarios for `risk_gate`: twice the volatility, a gap of -10 % in a day, a drawdown of 18 %."""
    return {"volatility doubles": {"forecast_vol": 0.4, "baseline_vol": 0.2}, "gap of -10 %": {"pnl_today": -0.1 * equity, "equity": 0.9 * equity}, "drawdown of 18 %": {"peak": equity / 0.82}}


def audit(decisions: DataFrame) -> DataFrame:
    """What `risk_gate` gave, as ten columns for the log: quantities to four places, money to two."""
    money = lambda q: F.round(F.abs(q * C("price")), 2)
    ts = C("ts").cast("string") if "ts" in decisions.columns else F.lit(None).cast("string")
    why = F.when(C("rule") == "NONE", "Within risk parameters").otherwise(F.lower(F.regexp_replace("rule", "_", " ")))
    return decisions.select(ts.alias("timestamp"), "ticker", F.upper("action").alias("action"), "status", "rule", F.round("quantity", 4).alias("requested_quantity"), F.round("approved", 4).alias("approved_quantity"), money(C("quantity")).alias("requested_value"), money(C("approved")).alias("approved_value"), why.alias("reasons"))


def order_id(cycle: Column, ticker: Column, action: Column, quantity: Column) -> Column:
    """The same id for the same order of one cycle."""
    return F.substring(F.sha2(F.concat_ws(":", cycle, F.upper(ticker), F.upper(action), F.format_string("%.4f", quantity)).cast("binary"), 256), 1, 24)
