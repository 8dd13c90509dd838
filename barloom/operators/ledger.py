"""Backtests of target weights: books and fills read in order of time, trades as episodes of one sign over the fills.

What a bar trades depends on the equity of all bars before it, so a strategy's bars are taken in order; but what the scan keeps is cash, two equities and a number of shares for each symbol,
and it streams: rows of one time arrive as one row with arrays, and a task holds a batch of times, whatever the length of the history. The fills that it gives are rows, and
all else (trades, statistics, performance) is windows and aggregates over them.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

C = F.col
#: Shares that count as none.
NONE = 1e-4
BOOK = "nth int, equity double, cash double, ret double, turnover double, commission double, slippage double, blocked int, resized int"
FILL = "array<struct<symbol:string,step:double,price:double,commission:double,slippage:double>>"


@dataclass(frozen=True)
class Gate:
    """Limits of an order's risk, as shares of equity: those of portfolio.risk_gate that need no sectors. An order is judged by the book as it stands before the bar's orders."""

    drawdown: float = 0.15
    daily_loss: float = 0.03
    position: float = 0.25
    gross: float = 1.0
    net: float = 1.0
    spike: float = 1.5
    least: float = 0.2
    baseline: float = 0.15

    def allowed(self, step: np.ndarray, shares: np.ndarray, price: np.ndarray, equity: float, peak: float, day_start: float, volatility: np.ndarray | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(steps that may be traded, which orders are blocked, which are cut)."""
        size, up = np.abs(step), step > 0
        asked = size > 0
        closing = (shares * step) < 0
        worth, floor = np.where(price > 0, shares * price, 0.0), max(1.0, equity)
        safe = np.where(price > 0, np.maximum(price, 1e-6), 1.0)
        cut = size.copy()
        if volatility is not None:
            calm = ~(volatility > self.spike * self.baseline)
            cut = np.where(calm, cut, cut * np.round(np.clip(self.baseline / np.where(calm, 1.0, volatility), self.least, 1.0), 4))
        room = np.maximum(0.0, self.position * floor - np.abs(worth)) / safe
        full = (room <= 0) & (cut > room)
        cut = np.minimum(cut, room)
        room = max(0.0, self.gross * floor - float(np.abs(worth).sum())) / safe
        full |= (room <= 0) & (cut > room)
        cut = np.minimum(cut, room)
        full |= np.abs(worth.sum() + np.where(up, cut, -cut) * safe) > self.net * floor
        down = max(0.0, (peak - equity) / peak) if peak > 0 else 0.0
        lost = (day_start - equity) / day_start if day_start > 0 else 0.0
        if down >= self.drawdown or lost >= self.daily_loss:
            full = np.ones_like(full)
        full &= asked & ~closing
        size = np.where(closing, size, np.where(full, 0.0, cut))
        return np.sign(step) * size, full, asked & ~closing & ~full & (size < np.abs(step))


def scan(rows: list, state: dict, *, capital: float, commission: float, slippage: float, impact: float, gate: Gate | None) -> list[tuple]:
    """(ts, nth, .. of BOOK, fills) of rows (ts, symbols, close, volume, weight, vol) in order of time, each with the weights to trade at it; state is carried from call to call."""
    out = []
    for ts, symbols, close, volume, weight, vol in rows:
        if not state:
            state |= {"cash": capital, "shares": {}, "equity": capital, "peak": capital, "day": None, "start": capital, "nth": 0}
        p = np.array([np.nan if x is None else x for x in close], float)
        v = np.array([np.nan if x is None else x for x in volume], float)
        w = np.nan_to_num(np.array([0.0 if x is None else x for x in weight], float))
        held = np.array([state["shares"].get(s, 0.0) for s in symbols])
        known = p > 0
        at = np.where(known, p, 0.0)
        equity = state["cash"] + float((held * at).sum())
        state["peak"] = max(state["peak"], equity)
        if state["day"] is not None and ts.date() != state["day"]:
            state["start"] = equity
        state["day"] = ts.date()
        step = np.where(known, w * equity / np.where(known, p, 1.0) - held, 0.0)
        step[np.abs(step) < NONE] = 0.0
        blocked = cut = np.zeros(len(p), bool)
        if gate is not None:
            forecast = np.array([np.nan if x is None else x for x in vol], float)
            step, blocked, cut = gate.allowed(step, held, p, equity, state["peak"], state["start"], forecast)
        size = np.abs(step)
        value = size * at
        share = np.divide(size, v, out=np.zeros_like(size), where=v > 0)
        fee, slip = value * commission, value * slippage * np.maximum(1.0, (share / 0.01) ** impact)
        done = at + np.sign(step) * np.divide(slip, size, out=np.zeros_like(slip), where=size > 0)
        state["cash"] -= float((step * done + fee).sum())
        now = held + step
        for s, x in zip(symbols, now.tolist(), strict=True):
            state["shares"][s] = x
        after = state["cash"] + float((now * at).sum())
        fills = [(symbols[j], float(step[j]), float(done[j]), float(fee[j]), float(slip[j])) for j in np.flatnonzero(step)]
        out.append((ts, state["nth"], after, state["cash"], after / state["equity"] - 1 if state["equity"] > 0 else 0.0, float(value.sum()), float(fee.sum()), float(slip.sum()), int(blocked.sum()), int(cut.sum()), fills))
        state["equity"], state["nth"] = after, state["nth"] + 1
    return out


def run(bars: DataFrame, *, key: str = "strategy", capital: float = 100_000.0, commission: float = 5e-4, slippage: float = 5e-4, impact: float = 0.5, gate: Gate | None = None) -> DataFrame:
    """key, ts, the columns of BOOK and fills (symbol, signed step, price paid, commission, slippage) of each time of each strategy, over bars(key, symbol, ts, close, volume, weight, and vol, the
    yearly volatility forecast, if the gate is to look at it).

    The weight of a bar is traded at its symbol's next one, in shares for the equity before the bar's trades; a part of the volume above a hundredth slips more. Symbols without a price at a time are
    not traded and count nothing then. With a gate its limits block or cut the orders that add to a position."""
    own = Window.partitionBy(key, "symbol").orderBy("ts")
    vol = C("vol").cast("double") if "vol" in bars.columns else F.lit(None).cast("double")
    rows = bars.select(key, "ts", "symbol", C("close").cast("double").alias("close"), C("volume").cast("double").alias("volume"), F.lag("weight").over(own).cast("double").alias("weight"), vol.alias("vol"))
    times = rows.groupBy(key, "ts").agg(F.array_sort(F.collect_list(F.struct("symbol", "close", "volume", "weight", "vol"))).alias("s"))
    times = times.select(key, "ts", *(C(f"s.{c}").alias(c) for c in ("symbol", "close", "volume", "weight", "vol")))
    kinds = {f.name: f.dataType.simpleString() for f in bars.schema.fields}
    names = ["nth", "equity", "cash", "ret", "turnover", "commission", "slippage", "blocked", "resized", "fills"]

    def walk(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        name, state = None, {}
        for batch in batches:
            for k, group in batch.groupby(key, sort=False):
                if k != name:
                    name, state = k, {}
                made = scan(list(zip(*(group[c] for c in ("ts", "symbol", "close", "volume", "weight", "vol")), strict=True)), state, capital=capital, commission=commission, slippage=slippage, impact=impact, gate=gate)
                yield pd.DataFrame(made, columns=["ts", *names]).assign(**{key: k})[[key, "ts", *names]]

    # one strategy after the other, each in order of time
    return times.repartition(key).sortWithinPartitions(key, "ts").mapInPandas(walk, f"{key} {kinds[key]}, ts {kinds['ts']}, {BOOK}, fills {FILL}")


def fills(books: DataFrame, key: str = "strategy") -> DataFrame:
    """key, ts, nth, symbol, step, price, commission and slippage of every fill of run()'s books."""
    return books.select(key, "ts", "nth", F.explode("fills").alias("f")).select(key, "ts", "nth", "f.*")


def trades(fill: DataFrame, key: str = "strategy") -> DataFrame:
    """key, symbol, side, entry_ts, exit_ts, quantity, entry_price, exit_price, pnl, pnl_pct and bars of each closed part of a trade over fills().

    A trade is an episode in which the position has one sign; its entry is the first fill of the episode. A fill against the position closes a part of it, and its costs are the part's; a fill beyond
    nothing closes the whole and opens a trade of the other side. Positions still open are no trades."""
    w = Window.partitionBy(key, "symbol").orderBy("ts")
    near = lambda x: F.when(F.abs(x) < NONE, 0.0).otherwise(x)
    after = near(F.sum("step").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    rows = fill.withColumn("_after", after).withColumn("_held", F.coalesce(F.lag("_after").over(w), F.lit(0.0)))
    opens = (F.signum("_after") != F.signum("_held")) & (C("_after") != 0)
    start = F.when(opens, F.struct(C("ts").alias("ts"), C("nth").alias("nth"), C("price").alias("price")))
    rows = rows.withColumn("_start", start).withColumn("_entry", F.last("_start", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1)))
    closed = rows.where((C("_held") * C("step") < 0) & C("_entry").isNotNull())
    side, part = F.signum("_held"), F.least(F.abs("step"), F.abs("_held"))
    pnl = part * (C("price") - C("_entry.price")) * side - C("commission") - C("slippage")
    out = closed.select(key, "symbol", F.when(side > 0, "LONG").otherwise("SHORT").alias("side"), C("_entry.ts").alias("entry_ts"), C("ts").alias("exit_ts"), part.alias("quantity"), C("_entry.price").alias("entry_price"), C("price").alias("exit_price"), pnl.alias("pnl"), F.greatest(F.lit(1), C("nth") - C("_entry.nth")).cast("long").alias("bars"))
    return out.withColumn("pnl_pct", F.when(C("entry_price") > 0, C("pnl") / (C("quantity") * C("entry_price"))).otherwise(0.0)).select(key, "symbol", "side", "entry_ts", "exit_ts", "quantity", "entry_price", "exit_price", "pnl", "pnl_pct", "bars")
