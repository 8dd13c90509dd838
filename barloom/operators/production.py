"""The production features of a symbol's bars and news, and their walk-forward evaluation."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from barloom.functions.windows import change, full, lag, last
from barloom.operators import metrics, models
from barloom.operators.recurrences import ema

C = F.col
# The names of the production features, and what keeps ratios from dividing by 0.
FEATURES = ["ret_1d", "ret_5d", "ret_20d", "vol_20d", "rsi_14", "macd_line", "macd_signal", "natr_14", "volume_ratio_20", "news_headline_volume", "news_sentiment_volatility"]
EPS = 1e-9
# Features that were tried and left out of production.
EXCLUDED = {
    "news_mean_sentiment": "no gain out of fold",
    "earnings_overall_sentiment": "too few values a year",
    "earnings_prepared_sentiment": "scripted text, no relation with what follows",
    "earnings_qa_sentiment": "varies much, and volatility tells the same",
    "earnings_qa_vs_prepared_delta": "does not carry over to other symbols",
    "earnings_linguistic_uncertainty": "collinear with volatility",
}


def status(spark: SparkSession) -> DataFrame:
    """feature, status (production or excluded) and reason (of the excluded ones)."""
    rows = [(f, "production", None) for f in FEATURES] + [(f, "excluded", why) for f, why in EXCLUDED.items()]
    return spark.createDataFrame(rows, "feature string, status string, reason string")


def with_macd(bars: DataFrame) -> DataFrame:
    """bars with macd_line and macd_signal from the first bar on; each value depends on the one before, so a symbol is read in order."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("ts", kind="stable")
        close = pdf["close"].to_numpy(float)
        line = ema(close, 12) - ema(close, 26)
        return pdf.assign(macd_line=line, macd_signal=ema(line, 9))

    schema = ", ".join(f"{c} {t}" for c, t in bars.dtypes) + ", macd_line double, macd_signal double"
    return bars.groupBy("symbol").applyInPandas(run, schema)


def dataset(bars: DataFrame, news: DataFrame | None = None) -> DataFrame:
    """symbol, ts, close, the production features, and y (1 if the next close is higher, else 0) of every bar that has them all.

    news(symbol, date, n, dev): headlines of a day and the deviation of their scores; days without any count as 0. They join bars of the same
    date, so they are known only when it ends.
    """
    b = with_macd(bars.select("symbol", "ts", *(C(c).cast("double").alias(c) for c in ("high", "low", "close", "volume"))))
    step, before = C("close") - lag(C("close")), lag(C("close"))
    b = b.withColumns(
        {
            "ret_1d": change(C("close"), 1), "ret_5d": change(C("close"), 5), "ret_20d": change(C("close"), 20),
            "_up": F.when(step.isNotNull(), F.greatest(step, F.lit(0.0))), "_down": F.when(step.isNotNull(), F.greatest(-step, F.lit(0.0))),
            "_tr": F.greatest(C("high") - C("low"), F.abs(C("high") - before), F.abs(C("low") - before)),
            "_next": F.lead("close").over(Window.partitionBy("symbol").orderBy("ts")),
        }
    )
    strength = full(F.avg("_up"), C("_up"), 14) / (full(F.avg("_down"), C("_down"), 14) + EPS)
    b = b.withColumns(
        {
            "vol_20d": full(F.stddev_samp("ret_1d"), C("ret_1d"), 20), "rsi_14": 100 - 100 / (1 + strength),
            "natr_14": 100 * full(F.avg("_tr"), C("_tr"), 14) / C("close"), "volume_ratio_20": C("volume") / (full(F.avg("volume"), C("volume"), 20) + EPS),
        }
    )
    if news is None:
        b = b.withColumns({c: F.lit(0.0) for c in FEATURES[-2:]})
    else:
        told = news.select("symbol", C("date").alias("_date"), F.log1p(C("n").cast("double")).alias(FEATURES[-2]), C("dev").alias(FEATURES[-1]))
        b = b.withColumn("_date", F.to_date("ts")).join(told, ["symbol", "_date"], "left").withColumns({c: F.coalesce(c, F.lit(0.0)) for c in FEATURES[-2:]})
    out = b.where("_next is not null").select("symbol", "ts", "close", *FEATURES, (C("_next") > C("close")).cast("int").alias("y"))
    return out.dropna()


def evaluate(data: DataFrame, columns: list[str] = FEATURES, *, folds: int = 5, embargo: int = 5, estimator=None) -> DataFrame:
    """Of each symbol: bars tested, accuracy, Brier score and the performance of being long or short by the out-of-fold probability, five expanding
    folds, 40 % of the rows or 100 in the first training part. data as `dataset` gives it; trees are trained by pyspark.ml on the rows of all symbols in a fold's training part."""
    counts = data.groupBy("symbol").agg(F.count("*").cast("int").alias("n")).withColumn("least", F.greatest(F.lit(100), F.floor(0.4 * C("n"))).cast("int"))
    bounds = models.fold_bounds(counts, folds=folds, embargo=embargo, least_train=C("least")).drop("least")
    out = models.walk_forward(data, columns, "y", bounds, estimator)
    tested = out.join(data.select("symbol", "ts", "close"), ["symbol", "ts"])
    scores = tested.groupBy("symbol").agg(F.count("*").alias("evaluated"), F.avg(((C("p") >= 0.5) == (C("y") == 1)).cast("double")).alias("accuracy"), F.avg(F.pow(C("p") - C("y"), 2)).alias("brier"))
    nxt = F.lead("close").over(Window.partitionBy("symbol").orderBy("ts")) / C("close") - 1
    traded = tested.withColumn("ret", F.when(C("p") >= 0.5, 1.0).otherwise(-1.0) * nxt).where("ret is not null")
    return scores.join(metrics.performance(traded).drop("n"), "symbol")
