"""Evaluation of models over time: folds, metrics, comparison, bootstrap, and walk-forward training with pyspark.ml."""

from __future__ import annotations

import math

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

C = F.col


def fold_bounds(counts: DataFrame, *, folds: int = 5, least_train: int | Column = 100, embargo: int = 5, train: int | None = None, rolling: bool = False) -> DataFrame:
    """fold (from 1), train_start, train_stop, test_start, test_stop (row numbers from 0, stops exclusive) for each row of counts(n, ..), after its
    other columns.

    Tests follow each other up to the end of the sample; training rows end `embargo` rows before their test, from the start on, or rolling with
    `train` rows (least_train if not given). Folds with less than that are left out and the others numbered anew; samples too short
    for any have none.
    """
    least_train = F.lit(least_train) if isinstance(least_train, int) else least_train
    need = F.lit(train) if rolling and train else least_train
    keep = [c for c in counts.columns if c != "n"]
    room = C("n") - need - folds * embargo
    size = F.greatest(F.lit(1), F.floor(room / folds)).cast("int")
    each = counts.where((C("n") > least_train + embargo) & (room > 0)).withColumn("_size", size).withColumn("_k", F.explode(F.sequence(F.lit(0), F.lit(folds - 1))))
    each = each.withColumn("test_start", F.greatest(C("n") - folds * C("_size"), need + embargo) + C("_k") * C("_size"))
    each = each.withColumns({"test_stop": F.least(C("test_start") + C("_size"), C("n")), "train_stop": C("test_start") - embargo})
    each = each.withColumn("train_start", F.greatest(F.lit(0), C("train_stop") - (train if train else least_train)) if rolling else F.lit(0))
    each = each.where((C("train_stop") - C("train_start") >= need) & (C("test_stop") > C("test_start")))
    fold = F.row_number().over(Window.partitionBy(*keep, "n").orderBy("_k")) if keep else F.row_number().over(Window.partitionBy("n").orderBy("_k"))
    return each.select(*keep, fold.alias("fold"), *(C(c).cast("int").alias(c) for c in ("train_start", "train_stop", "test_start", "test_stop")))


def symbol_folds(df: DataFrame, *, key: str = "symbol", **how) -> DataFrame:
    """key and the columns of fold_bounds, from the number of rows of each key."""
    return fold_bounds(df.groupBy(key).agg(F.count("*").cast("int").alias("n")), **how)


def with_folds(df: DataFrame, bounds: DataFrame, order: str = "ts", key: str = "symbol") -> DataFrame:
    """df with nth (row number by key), and a row for each fold and part (train or test) that it belongs to. bounds has one row
    a fold, or one a key and fold."""
    n = F.row_number().over(Window.partitionBy(key).orderBy(order)) - 1
    on = ((C("nth") >= C("train_start")) & (C("nth") < C("train_stop"))) | ((C("nth") >= C("test_start")) & (C("nth") < C("test_stop")))
    part = F.when(C("nth") < C("train_stop"), "train").otherwise("test")
    if key in bounds.columns:
        bounds = bounds.withColumnRenamed(key, "_key")
        return df.withColumn("nth", n).join(bounds, (C(key) == C("_key")) & on).select(*df.columns, "nth", "fold", part.alias("part"))
    # without a key, bounds has a row for each fold
    return df.withColumn("nth", n).join(F.broadcast(bounds), on).select(*df.columns, "nth", "fold", part.alias("part"))


def temporal_split(df: DataFrame, *, test: float = 0.2, key: str = "symbol", order: str = "ts") -> DataFrame:
    """df with part: the last rows of each key are `test`, from row floor(n * (1 - test)) on, the others `train`."""
    nth, n = F.row_number().over(Window.partitionBy(key).orderBy(order)) - 1, F.count("*").over(Window.partitionBy(key))
    return df.withColumn("part", F.when(nth < F.floor(n * (1 - test)), "train").otherwise("test"))


def ensemble(probabilities: dict[str, Column], accuracy: dict[str, float] | None = None, *, by: str = "mean") -> Column:
    """One probability of several models: their mean, or weighted by conviction (how far each is from one half), or by accuracy (above 0.45)."""
    names = list(probabilities)
    if by == "mean":
        weight = {n: F.lit(1.0) for n in names}
    elif by == "conviction":
        weight = {n: F.abs(probabilities[n] - 0.5) + 1e-4 for n in names}
    elif by == "accuracy":
        weight = {n: F.lit(max(accuracy[n] - 0.45, 0.01)) for n in names}
    else:
        raise ValueError(f"no such ensemble: {by}")
    return sum(weight[n] * probabilities[n] for n in names) / sum(weight.values())


def sharpe_difference(ret: DataFrame, a: str, b: str, *, paths: int = 1000, block: int = 10, seed: int = 42) -> DataFrame:
    """symbol, difference of the yearly Sharpe ratios of two return columns, its 95 % interval and two-sided p, by blocks that don't wrap round.

    The draws are rows: each path's block starts come from a hash, their places are joined to the numbered returns, and a path is an aggregate; so
    no series is held whole.
    """
    own = ret.dropna(subset=[a, b]).withColumn("nth", (F.row_number().over(Window.partitionBy("symbol").orderBy("ts")) - 1).cast("long")).select("symbol", "nth", C(a).cast("double").alias("x"), C(b).cast("double").alias("y"))
    n = own.groupBy("symbol").agg(F.count("*").alias("n"), _sharpe("x").alias("sx"), _sharpe("y").alias("sy")).where(C("n") >= block)
    draws = n.withColumn("path", F.explode(F.sequence(F.lit(0), F.lit(paths - 1)))).withColumn("part", F.explode(F.sequence(F.lit(0), (F.ceil(C("n") / block) - 1).cast("int"))))
    draws = draws.withColumn("start", F.pmod(F.xxhash64("symbol", "path", "part", F.lit(seed)), C("n") - block + 1))
    places = draws.select("symbol", "n", "path", "part", (F.explode(F.sequence(F.lit(0), F.lit(block - 1)))).alias("k"), "start").where(C("part") * block + C("k") < C("n")).select("symbol", "path", (C("start") + C("k")).alias("nth"))
    each = places.join(own, ["symbol", "nth"]).groupBy("symbol", "path").agg((_sharpe("x") - _sharpe("y")).alias("d"))
    out = each.groupBy("symbol").agg(F.percentile("d", 0.025).alias("low"), F.percentile("d", 0.975).alias("high"), F.avg((C("d") <= 0).cast("double")).alias("down"), F.avg((C("d") >= 0).cast("double")).alias("up"))
    return out.join(n, "symbol").select("symbol", (C("sx") - C("sy")).alias("difference"), "low", "high", F.least(F.lit(1.0), 2 * F.least("down", "up")).alias("p_value"))


def _sharpe(c: str) -> Column:
    dev = F.stddev_samp(c)
    return F.when((F.count(c) < 2) | (dev <= 1e-12), 0.0).otherwise(F.sqrt(F.lit(252.0)) * F.avg(c) / dev)


def auc(df: DataFrame, keys: list[str], label: str = "y", score: str = "p") -> DataFrame:
    """Area under the curve by rank sums; equal scores share their mean rank. One row for each keys."""
    counts = df.groupBy(*keys, score).agg(F.sum(label).alias("up"), F.count("*").alias("n"))  # first by score: few rows where scores repeat
    w = Window.partitionBy(*keys).orderBy(score).rowsBetween(Window.unboundedPreceding, -1)
    ranked = counts.withColumn("rank", F.coalesce(F.sum("n").over(w), F.lit(0)) + (C("n") + 1) / 2)
    sums = ranked.groupBy(*keys).agg(F.sum(C("rank") * C("up")).alias("r"), F.sum("up").alias("p"), F.sum("n").alias("n"))
    return sums.select(*keys, F.try_divide(C("r") - C("p") * (C("p") + 1) / 2, C("p") * (C("n") - C("p"))).alias("auc"))


def classification(df: DataFrame, keys: list[str], label: str = "y", score: str = "p") -> DataFrame:
    """accuracy, balanced accuracy, precision, recall, f1, brier and auc by keys; 0 where a ratio has no base."""
    y, hit = C(label) == 1, C(score) >= 0.5
    tp, fp, fn, tn = (F.count_if(c) for c in (y & hit, ~y & hit, y & ~hit, ~y & ~hit))
    ratio = lambda a, b: F.coalesce(F.try_divide(a, b), F.lit(0.0))
    base = df.groupBy(*keys).agg(ratio(tp + tn, F.count("*")).alias("accuracy"), ((ratio(tp, tp + fn) + ratio(tn, tn + fp)) / 2).alias("balanced"), ratio(tp, tp + fp).alias("precision"), ratio(tp, tp + fn).alias("recall"), ratio(2 * tp, 2 * tp + fp + fn).alias("f1"), F.avg(F.pow(C(score) - C(label), 2)).alias("brier"))
    return base.join(auc(df, keys, label, score), keys)


def persistence(folded: DataFrame, label: str = "y") -> DataFrame:
    """Test rows of folded(symbol, ts, fold, part, label, ..) with p: the label of the row before; of the first test row, the last training label."""
    before = F.lag(label).over(Window.partitionBy("symbol", "fold").orderBy("ts"))
    return folded.withColumn("p", before.cast("double")).where("part = 'test'")


LOSSES = {
    "brier": lambda y, p: F.pow(p - y, 2),
    "logloss": lambda y, p: -(y * F.log(F.greatest(F.lit(1e-7), F.least(F.lit(1 - 1e-7), p))) + (1 - y) * F.log(1 - F.greatest(F.lit(1e-7), F.least(F.lit(1 - 1e-7), p)))),
    "directional": lambda y, p: ((p >= 0.5).cast("double") != y.cast("double")).cast("double"),
}


def student_two_sided(t: float, freedom: float) -> float:
    """The probability of a Student-t value at least as far from 0, by the continued fraction of the incomplete beta function."""
    x = freedom / (freedom + t * t)
    a, b = freedom / 2, 0.5
    if x >= 1:
        return 1.0
    turned = x > (a + 1) / (a + b + 2)
    if turned:
        a, b, x = b, a, 1 - x
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)) / a
    c, d = 1.0, 1 / (1 - (a + b) * x / (a + 1))
    out = d
    for m in range(1, 300):
        for num in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 / (1 + num * d)
            c = 1 + num / c
            out *= c * d
        if abs(c * d - 1) < 1e-14:
            break
    return 1 - front * out if turned else front * out


def student_p(t: Column | str, freedom: Column) -> Column:
    """Two-sided p-values of a statistic."""

    @F.pandas_udf("double")
    def p(t: pd.Series, freedom: pd.Series) -> pd.Series:
        return pd.Series([None if pd.isna(v) else student_two_sided(float(v), float(f)) for v, f in zip(t, freedom, strict=True)], dtype="float64")

    return p(t, freedom)


def diebold_mariano(df: DataFrame, *, lags: int = 0, loss: str = "brier") -> DataFrame:
    """symbol, n, mean loss difference and statistic of two forecasts (y, p, q) by squared error (or logloss, or directional: whether the side is wrong), with Bartlett weights up to `lags` and
    the small-sample factor. student_p(statistic, n - 1) is the p-value."""
    w = Window.partitionBy("symbol").orderBy("ts")
    d = df.select("symbol", "ts", (LOSSES[loss](C("y"), C("p")) - LOSSES[loss](C("y"), C("q"))).alias("d"))
    off = d.withColumn("e", C("d") - F.avg("d").over(Window.partitionBy("symbol")))
    off = off.withColumns({f"e{k}": F.lag("e", k).over(w) for k in range(1, lags + 1)})
    gamma = [F.sum(C("e") * C("e")) / F.count("e"), *(F.sum(C("e") * C(f"e{k}")) / F.count("e") for k in range(1, lags + 1))]
    var = sum((2 * (1 - k / (lags + 1)) * g for k, g in enumerate(gamma[1:], 1)), gamma[0])
    n, h = F.count("d"), lags + 1
    factor = F.sqrt((n + 1 - 2 * h + h * (h - 1) / n) / n)
    return off.groupBy("symbol").agg(n.alias("n"), F.avg("d").alias("mean"), (factor * F.try_divide(F.avg("d"), F.sqrt(F.greatest(var, F.lit(0.0)) / n))).alias("statistic"))


def bootstrap(ret: DataFrame, *, paths: int = 1000, block: int = 10, length: int | None = None, seed: int = 1) -> DataFrame:
    """symbol, path, total return and worst drawdown of paths drawn in circular blocks, each as long as the symbol's
    series unless length is given. Every (symbol, path) is a task of its own seed; a
    symbol's returns reach the groups as one array."""
    arrays = ret.groupBy("symbol").agg(F.transform(F.array_sort(F.collect_list(F.struct("ts", "ret"))), lambda x: x["ret"]).alias("r"))
    grid = arrays.withColumn("path", F.explode(F.sequence(F.lit(0), F.lit(paths - 1))))

    def draw(parts):
        for pdf in parts:
            out = []
            for symbol, r, path in zip(pdf["symbol"], pdf["r"], pdf["path"], strict=True):
                r = np.asarray(r, float)
                rng = np.random.default_rng([seed, int(path)])
                n = length or len(r)
                starts = rng.integers(0, len(r), -(-n // block))
                x = r[(starts[:, None] + np.arange(block)).ravel()[:n] % len(r)]
                wealth = np.cumprod(1 + x)
                out.append((symbol, int(path), wealth[-1] - 1, (wealth / np.maximum.accumulate(wealth) - 1).min()))
            yield pd.DataFrame(out, columns=["symbol", "path", "total", "drawdown"])

    return grid.repartition("symbol", "path").mapInPandas(draw, "symbol string, path int, total double, drawdown double")


def fan(paths: DataFrame) -> DataFrame:
    """symbol and the 5, 25, 50, 75 and 95 % points of the paths' totals and drawdowns."""
    at = [0.05, 0.25, 0.5, 0.75, 0.95]
    return paths.groupBy("symbol").agg(*(F.percentile(c, q).alias(f"{c}_{round(100 * q)}") for c in ("total", "drawdown") for q in at))


def walk_forward(df: DataFrame, features: list[str], label: str, bounds: DataFrame, estimator: Callable | None = None) -> DataFrame:
    """symbol, ts, fold, y, p out of fold; trained on each fold's training rows by pyspark.ml. df(symbol, ts, features, label) without nulls."""
    from pyspark.ml.classification import GBTClassifier
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.functions import vector_to_array

    rows = with_folds(VectorAssembler(inputCols=features, outputCol="_x").transform(df).select("symbol", "ts", "_x", C(label).cast("double").alias("y")), bounds)
    out = None
    for k in [r["fold"] for r in bounds.select("fold").distinct().orderBy("fold").collect()]:
        own = rows.where(C("fold") == k)
        make = estimator or (lambda: GBTClassifier(maxIter=10, maxDepth=3, seed=1))
        model = make().setFeaturesCol("_x").setLabelCol("y").fit(own.where("part = 'train'"))
        got = model.transform(own.where("part = 'test'")).select("symbol", "ts", "fold", "y", vector_to_array("probability")[1].alias("p"))
        out = got if out is None else out.unionByName(got)
    return out


def sequences(df: DataFrame, columns: list[str], length: int = 20, stride: int = 1, *, target: str | None = None, most_missing: float = 0.0) -> DataFrame:
    """symbol, ts, x, mask and target: the last `length` rows of columns as array<array<double>>, full ones only, every stride-th row. Windows
    whose share of null or NaN values is above most_missing are left out; in the others these are 0, and mask is false for their rows. target
    is that column's value at the last row."""
    order = Window.partitionBy("symbol").orderBy("ts")
    x = F.collect_list(F.array(*(F.nanvl(C(c).cast("double"), F.lit(None).cast("double")) for c in columns))).over(order.rowsBetween(-(length - 1), 0))
    y = [C(target).alias("target")] if target else []
    out = df.select("symbol", "ts", x.alias("x"), *y, F.row_number().over(order).alias("_n"))
    out = out.where((F.size("x") == length) & ((C("_n") - length) % stride == 0)).drop("_n")
    missing = F.size(F.filter(F.flatten("x"), lambda v: v.isNull()))
    out = out.where(missing <= most_missing * length * len(columns)).withColumn("mask", F.transform("x", lambda r: F.forall(r, lambda v: v.isNotNull())))
    return out.withColumn("x", F.transform("x", lambda r: F.transform(r, lambda v: F.coalesce(v, F.lit(0.0)))))


def information(df: DataFrame, feature: str, label: str, bins: int = 10) -> DataFrame:
    """symbol, mutual information in nats of the feature's deciles and the label."""
    b = df.dropna(subset=[feature, label]).withColumn("b", F.ntile(bins).over(Window.partitionBy("symbol").orderBy(feature, "ts")))
    joint = b.groupBy("symbol", "b", label).agg(F.count("*").alias("n"))
    w = Window.partitionBy
    p = C("n") / F.sum("n").over(w("symbol"))
    px, py = F.sum("n").over(w("symbol", "b")) / F.sum("n").over(w("symbol")), F.sum("n").over(w("symbol", label)) / F.sum("n").over(w("symbol"))
    return joint.select("symbol", (p * F.log(p / (px * py))).alias("i")).groupBy("symbol").agg(F.sum("i").alias("information"))


def spearman(df: DataFrame, a: str, b: str) -> DataFrame:
    """symbol, rank correlation of two columns; ties share their mean rank."""

    def rank(c: str) -> Column:
        return F.rank().over(Window.partitionBy("symbol").orderBy(c)) + (F.count("*").over(Window.partitionBy("symbol", c)) - 1) / 2

    r = df.dropna(subset=[a, b]).select("symbol", rank(a).alias("x"), rank(b).alias("y"))
    return r.groupBy("symbol").agg(F.corr("x", "y").alias("rho"))
