"""Recurrences over ordered bars: exponential averages, Wilder's smoothing, MACD.

Each value depends on the one before, which no window expresses; every symbol is one group, read in order in one call for all of them.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

C = F.col


def ema(x: np.ndarray, span: int) -> np.ndarray:
    """e = e * (1 - a) + x * a from the first value, a = 2 / (span + 1); leading nulls stay."""
    out, a, e = np.full(len(x), np.nan), 2 / (span + 1), np.nan
    for i, v in enumerate(x):
        if not np.isnan(v):
            e = v if np.isnan(e) else e * (1 - a) + v * a
            out[i] = e
    return out


def wilder(x: np.ndarray, n: int) -> np.ndarray:
    """The mean of the first n values, then (before * (n - 1) + x) / n."""
    out = np.full(len(x), np.nan)
    if len(x) >= n:
        out[n - 1] = x[:n].mean()
        for i in range(n, len(x)):
            out[i] = (out[i - 1] * (n - 1) + x[i]) / n
    return out


def rsi(close: np.ndarray, n: int = 14) -> np.ndarray:
    """Null for the first n rows; 50 where nothing moved, 100 where nothing fell."""
    out = np.full(len(close), np.nan)
    if len(close) > n:
        d = np.diff(close)
        up, down = wilder(np.maximum(d, 0), n), wilder(np.maximum(-d, 0), n)
        with np.errstate(divide="ignore", invalid="ignore"):
            r = np.where(down == 0, np.where(up == 0, 50.0, 100.0), 100 - 100 / (1 + up / down))
        out[1:] = np.where(np.isnan(up), np.nan, r)
    return out


def _kernel(pdf: pd.DataFrame) -> pd.DataFrame:
    pdf = pdf.sort_values("ts", kind="stable")
    close, high, low = (pdf[c].to_numpy(float) for c in ("close", "high", "low"))
    fast, slow = ema(close, 12), ema(close, 26)
    line = fast - slow
    line[:25] = np.nan
    signal = ema(line, 9)
    signal[: 25 + 8] = np.nan
    before = np.concatenate([[np.nan], close[:-1]])
    tr = np.fmax(high - low, np.fmax(np.abs(high - before), np.abs(low - before)))
    out = pd.DataFrame({"symbol": pdf["symbol"].to_numpy(), "ts": pdf["ts"].to_numpy(), "ema_20": ema(close, 20), "rsi_wilder_14": rsi(close), "atr_14": wilder(tr, 14), "macd_line": line, "macd_signal": signal})
    return out.astype(object).where(out.notna(), None)


def recurrences(bars: DataFrame) -> DataFrame:
    """symbol, ts, ema_20, rsi_wilder_14, atr_14, macd_line, macd_signal. Close, high and low must not be null."""
    return bars.select("symbol", "ts", "close", "high", "low").groupBy("symbol").applyInPandas(_kernel, "symbol string, ts timestamp_ntz, ema_20 double, rsi_wilder_14 double, atr_14 double, macd_line double, macd_signal double")


def derived(bars: DataFrame, *, low: float = 30.0, high: float = 70.0, windows: tuple[int, ...] = (20, 50)) -> DataFrame:
    """symbol, ts and what follows from recurrences(): of MACD the histogram, its share of the price, whether it is bullish (line above signal) and where that turns; of RSI the reversion signal (1
    below `low`, -1 above `high`, else 0) and the stretch from the middle; and the price's distance from its means in true ranges. Null in the warm-up, but for the turns, which are 0."""
    w = Window.partitionBy("symbol").orderBy("ts")
    both = recurrences(bars).join(bars.select("symbol", "ts", "close"), ["symbol", "ts"])
    line, signal, rsi_ = C("macd_line"), C("macd_signal"), C("rsi_wilder_14")
    both = both.withColumn("macd_bullish", F.when(line.isNotNull() & signal.isNotNull(), (line > signal).cast("double")))
    out = both.withColumns(
        {
            "macd_hist": line - signal, "macd_norm": F.try_divide(line, C("close")), "macd_cross": F.coalesce(C("macd_bullish") - F.lag("macd_bullish").over(w), F.lit(0.0)),
            "rsi_reversion_signal": F.when(rsi_ < low, 1.0).when(rsi_ > high, -1.0).when(rsi_.isNotNull(), 0.0), "rsi_stretch": (rsi_ - 50) / 50,
        }
    )
    for n in windows:
        near = w.rowsBetween(-(n - 1), 0)
        mean = F.when(F.count("close").over(near) == n, F.avg("close").over(near))
        out = out.withColumn(f"ma_dist_atr_{n}", F.when((C("atr_14") == 0) & (C("close") == mean), 0.0).otherwise(F.try_divide(C("close") - mean, C("atr_14"))))
    return out.select("symbol", "ts", "macd_hist", "macd_norm", "macd_bullish", "macd_cross", "rsi_reversion_signal", "rsi_stretch", *(f"ma_dist_atr_{n}" for n in windows))
