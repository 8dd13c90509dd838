"""Cleaning of bars, corporate actions, and checks of a table's quality."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barloom.functions.windows import div, lag, last, ordered

C = F.col
PRICES = ("open", "high", "low", "close")


def _lead(x: Column, n: int = 1) -> Column:
    return F.lead(x, n).over(ordered())


def one_bar_spike(p: Column, jump: float = 0.15, back: float = 0.05) -> Column:
    """A jump that the next bar takes back. Looks one bar ahead: not for causal use."""
    r, nxt = div(p - lag(p), lag(p)), div(_lead(p) - p, p)
    positive = (p > 0) & (lag(p) > 0) & (_lead(p) > 0)
    return F.coalesce(positive & (F.abs(r) >= jump) & (r * nxt < 0) & (F.abs(div(_lead(p) - lag(p), lag(p))) <= back), F.lit(False))


def flags(bars: DataFrame, jump: float = 0.15, back: float = 0.05) -> DataFrame:
    """is_duplicate (a later row of one symbol and ts, in the order of all columns), is_bad_price, is_zero_volume and is_spike (of one bar)."""
    same = Window.partitionBy("symbol", "ts").orderBy(*bars.columns)
    return bars.withColumns(
        {
            "is_duplicate": F.row_number().over(same) > 1,
            "is_bad_price": F.coalesce(F.least(*PRICES) <= 0, F.lit(False)),
            "is_zero_volume": F.coalesce(C("volume") <= 0, F.lit(False)),
            "is_spike": one_bar_spike(C("close"), jump, back),
        }
    )


def two_bar_spikes(bars: DataFrame, jump: float = 0.15, back: float = 0.05) -> DataFrame:
    """symbol, ts, is_spike: jumps taken back after one or two bars. A bar already flagged starts no further spike, so each symbol is read in order."""

    def scan(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("ts", kind="stable")
        p, n = pdf["close"].tolist(), len(pdf)
        hit = [False] * n
        for i in range(1, n - 1):
            if hit[i] or min(p[i - 1], p[i], p[i + 1]) <= 0:
                continue
            base = p[i - 1]
            r, after = (p[i] - base) / base, (p[i + 1] - base) / base
            if abs(r) >= jump and r * (p[i + 1] - p[i]) < 0 and abs(after) <= back:
                hit[i] = True
            elif i + 2 < n and abs(r) >= jump and abs(after) >= jump and r * (p[i + 2] - p[i + 1]) < 0 and abs(p[i + 2] - base) / base <= back:
                hit[i] = hit[i + 1] = True
        return pd.DataFrame({"symbol": pdf["symbol"], "ts": pdf["ts"], "is_spike": hit})

    return bars.select("symbol", "ts", "close").groupBy("symbol").applyInPandas(scan, "symbol string, ts timestamp_ntz, is_spike boolean")


def drop_bad(flagged: DataFrame) -> DataFrame:
    """Without duplicates, bad prices and spikes; zero volume stays."""
    return flagged.where(~(C("is_duplicate") | C("is_bad_price") | C("is_spike"))).drop("is_duplicate", "is_bad_price", "is_zero_volume", "is_spike")


def fill_forward(flagged: DataFrame) -> DataFrame:
    """Prices of bad or spiked bars and volumes of empty ones from the last good bar, else from the next. The latter looks ahead."""
    rows = flagged.where(~C("is_duplicate"))
    bad = C("is_bad_price") | C("is_spike")
    # frames that grow from one end: those that shrink are worked out anew for every row
    before, after = (w.rowsBetween(Window.unboundedPreceding, 0) for w in (ordered(), Window.partitionBy("symbol").orderBy(C("ts").desc())))
    held = rows.withColumns({c: F.when(~bad, C(c)) for c in PRICES} | {"volume": F.when(~C("is_zero_volume"), C("volume"))})
    filled = {c: F.coalesce(F.last(c, ignorenulls=True).over(before), F.last(c, ignorenulls=True).over(after)) for c in (*PRICES, "volume")}
    return held.withColumns(filled).drop("is_duplicate", "is_bad_price", "is_zero_volume", "is_spike")


def quality_report(flagged: DataFrame) -> DataFrame:
    """Per symbol: rows, counts of each flag, all issues and the share of affected rows in percent."""
    names = ("is_duplicate", "is_bad_price", "is_zero_volume", "is_spike")
    counts = [F.count_if(C(c)).alias("n_" + c.removeprefix("is_")) for c in names]
    any_of = C(names[0]) | C(names[1]) | C(names[2]) | C(names[3])
    total = sum((F.count_if(C(c)) for c in names[1:]), F.count_if(C(names[0])))
    return flagged.groupBy("symbol").agg(F.count("*").alias("n_rows"), *counts, total.alias("n_issues"), (100 * F.count_if(any_of) / F.count("*")).alias("affected_pct"))


def sessions(first: str, last_day: str, spark, holidays: DataFrame | None = None) -> DataFrame:
    """Weekdays from first to last_day without holidays(date)."""
    days = spark.sql("SELECT explode(sequence(to_date(:a), to_date(:b))) AS date", {"a": first, "b": last_day}).where(F.weekday("date") < 5)
    return days if holidays is None else days.join(holidays.select("date"), "date", "left_anti")


def missing_sessions(bars: DataFrame, holidays: DataFrame | None = None) -> DataFrame:
    """symbol, date: weekdays between a symbol's first and last bar on which it has none, but for holidays(date). Each symbol's days come from its
    own span, so no calendar is sent."""
    own = bars.select("symbol", F.to_date("ts").alias("date"))
    span = own.groupBy("symbol").agg(F.min("date").alias("lo"), F.max("date").alias("hi"))
    due = span.select("symbol", F.explode(F.sequence("lo", "hi")).alias("date")).where(F.weekday("date") < 5)
    due = due if holidays is None else due.join(holidays.select("date"), "date", "left_anti").select("symbol", "date")
    return due.join(own.distinct(), ["symbol", "date"], "left_anti")


def market_open(ts: Column, holidays: list[str] = ()) -> Column:
    """Of a UTC time: a New York weekday, no holiday, from 09:30 up to 16:00."""
    at = F.from_utc_timestamp(ts, "America/New_York")
    minute = 60 * F.hour(at) + F.minute(at)
    return (F.weekday(at) < 5) & ~F.date_format(at, "yyyy-MM-dd").isin(list(holidays) or [""]) & (minute >= 570) & (minute < 960)


def splits(bars: DataFrame, low: float = 0.60, high: float = 1.5, near: float = 0.15) -> DataFrame:
    """symbol, ts, ratio, factor, confidence of bars that look like a split (price falls to 1/k) or a reverse split (rises to k)."""
    p, v = C("close"), C("volume")
    prev = lag(p)
    moved = bars.withColumns({"_q": F.when((p > 0) & (prev > 0), p / prev), "_v": div(v, lag(v))}).where(C("_q").isNotNull())
    times = F.when(C("_q") <= low, 1 / C("_q")).when(C("_q") >= high, C("_q"))
    k = F.bround(times, 0)
    found = moved.withColumns({"_f": times, "_k": k}).where((C("_k") >= 2) & (F.abs(C("_f") - C("_k")) / C("_k") <= near))
    sure = F.greatest(F.lit(0.0), 1 - F.abs(C("_f") - C("_k")))
    sure = F.when((C("_q") <= low) & (C("_v") >= 1.2), F.least(F.lit(1.0), sure + 0.1)).otherwise(sure)
    return found.select("symbol", "ts", C("_q").alias("ratio"), F.when(C("_q") <= low, C("_k")).otherwise(1 / C("_k")).alias("factor"), sure.alias("confidence"))


def with_authority(found: DataFrame, known: DataFrame) -> DataFrame:
    """Splits found, with the factor of a known one (symbol, ts, factor) within a day of it; known ones that match nothing are added."""
    f, k = found.alias("f"), known.alias("k")
    near = (C("f.symbol") == C("k.symbol")) & (F.abs(F.datediff("f.ts", "k.ts")) <= 1)
    best = f.join(k, near, "left").groupBy("f.symbol", "f.ts").agg(F.min_by("k.factor", F.struct(F.abs(F.datediff("f.ts", "k.ts")), "k.ts")).alias("told"), F.first("f.factor").alias("factor"))
    out = best.select("symbol", "ts", F.coalesce("told", "factor").alias("factor"), F.when(C("told").isNotNull(), "authoritative").otherwise("detected").alias("origin"))
    alone = k.join(f, near, "left_anti").select("symbol", "ts", "factor", F.lit("authoritative").alias("origin"))
    return out.unionByName(alone)


def adjust_splits(bars: DataFrame, events: DataFrame, *, near: float = 0.25) -> DataFrame:
    """Prices divided and volumes multiplied by the product of all split factors of later days; events(symbol, ts, factor). A split across which closes
    stay within `near` of each other is in the prices already and counts nothing, nor does a factor of 1 or of 0 and less. Bars and events are
    stacked, so one shuffle and sort by symbol does it, and equal bars stay apart."""
    names = [c for c in bars.columns if c not in ("symbol", "ts")]
    own = bars.select("symbol", "ts", F.struct(*names).alias("_bar"), F.lit(1.0).alias("_factor"))
    split = events.where("factor > 0 and factor <> 1").select("symbol", C("ts").cast(dict(bars.dtypes)["ts"]).alias("ts"), F.lit(None).cast(dict(own.dtypes)["_bar"]).alias("_bar"), C("factor").cast("double").alias("_factor"))
    # from the latest day back; of one day the bars come first, as a split's day is not adjusted
    back = Window.partitionBy("symbol").orderBy(F.to_date("ts").desc(), C("_bar").isNull(), C("ts").desc())
    after = F.last("_bar.close", ignorenulls=True).over(back.rowsBetween(Window.unboundedPreceding, 0))
    forth = Window.partitionBy("symbol").orderBy(F.to_date("ts"), C("_bar").isNotNull(), "ts")
    before = F.last("_bar.close", ignorenulls=True).over(forth.rowsBetween(Window.unboundedPreceding, 0))
    both = own.unionByName(split).withColumns({"_after": after, "_before": before})
    known = C("_bar").isNull() & (C("_before") > 0) & (C("_after") > 0) & (F.abs(C("_before") / C("_after") - 1) < near)
    both = both.withColumn("_f", F.product(F.when(F.coalesce(known, F.lit(False)), 1.0).otherwise(C("_factor"))).over(back.rowsBetween(Window.unboundedPreceding, 0))).where("_bar is not null")
    new = {c: C(f"_bar.{c}") / C("_f") if c in (*PRICES, "adj_close") else C(f"_bar.{c}") * C("_f") if c == "volume" else C(f"_bar.{c}") for c in names}
    return both.select(*(new.get(c, C(c)).alias(c) for c in bars.columns))


def dividends(bars: DataFrame, least: float = 0.001) -> DataFrame:
    """symbol, ts, factor and dividend where adj_close / close steps up."""
    f = F.coalesce(div(C("adj_close"), C("close")), F.lit(1.0))
    steps = bars.withColumn("_f", f).withColumn("_b", lag(C("_f")))
    return steps.where(div(C("_f") - C("_b"), C("_f")) > least).select("symbol", "ts", C("_f").alias("factor"), F.round((1 - C("_b") / C("_f")) * C("close"), 4).alias("dividend"))


def validate(bars: DataFrame, now: str, *, most_age_days: int = 5) -> DataFrame:
    """rule, passed, severity, affected: schema, range, order and freshness, one row each. `now` is given, so runs repeat."""
    wide = {"volume"} | set(PRICES)
    missing = sorted(wide - set(bars.columns))
    spark = bars.sparkSession
    if missing or bars.isEmpty():
        return spark.createDataFrame([("schema", False, "critical", len(missing))], "rule string, passed boolean, severity string, affected long")
    wrong = (F.least(*PRICES) <= 0) | (C("volume") < 0) | (C("high") < C("low")) | (C("high") < F.greatest("open", "close")) | (C("low") > F.least("open", "close"))
    rows = bars.withColumn("_back", F.coalesce(C("ts") <= lag(C("ts")), F.lit(False)))
    sums = rows.agg(
        F.count_if(wrong).alias("range"),
        F.count_if("_back").alias("order"),
        sum((F.when(F.count(c) == 0, 1).otherwise(0) for c in sorted(wide)), F.lit(0)).cast("long").alias("schema"),
        F.when(F.datediff(F.lit(now).cast("date"), F.max(F.to_date("ts"))) > most_age_days, 1).otherwise(0).cast("long").alias("freshness"),
    )
    grade = F.create_map(*[F.lit(x) for x in ("schema", "critical", "range", "critical", "order", "critical", "freshness", "warning")])
    long = sums.unpivot([], ["schema", "range", "order", "freshness"], "rule", "affected")
    return long.select("rule", (C("affected") == 0).alias("passed"), grade[C("rule")].alias("severity"), "affected")


def cross_source(a: DataFrame, b: DataFrame, near: float = 0.05) -> DataFrame:
    """symbol, n, n_apart: rows of both sources at the same time, and those whose closes differ by more than `near` of the second."""
    both = a.select("symbol", "ts", C("close").alias("p")).join(b.select("symbol", "ts", C("close").alias("q")), ["symbol", "ts"]).dropna(subset=["p", "q"])
    apart = F.abs(C("p") - C("q")) / F.when(C("q") > 0, C("q")).otherwise(1.0) > near
    return both.groupBy("symbol").agg(F.count("*").alias("n"), F.count_if(apart).alias("n_apart"))
