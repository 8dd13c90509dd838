"""Learning out of fold with several models: folds trained side by side, stacking, and what a group of columns adds.

A fold's training is a Spark job of its own; some of them are submitted at a time, so the cluster is not idle while the driver waits for one.
"""

from __future__ import annotations

from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barloom.functions.lineage import settled
from barloom.operators import models, scaling

C = F.col
Learner = Callable[[], object]
KEY = ["symbol", "ts"]


def logistic(c: float = 1.0) -> Learner:
    """Logistic regression with the inverse regularisation c; its strength falls with the rows, as a sum over rows has it."""
    from pyspark.ml.classification import LogisticRegression

    return lambda: LogisticRegression(regParam=1e-3 / c, maxIter=50)


def tree(depth: int = 3, least: int = 20) -> Learner:
    from pyspark.ml.classification import DecisionTreeClassifier

    return lambda: DecisionTreeClassifier(maxDepth=depth, minInstancesPerNode=least, seed=42)


def _assembled(df: DataFrame, features: list[str], label: str, keep: list[str] | None = None) -> DataFrame:
    from pyspark.ml.feature import VectorAssembler

    rows = df.dropna(subset=[*features, label])
    return VectorAssembler(inputCols=features, outputCol="_x").transform(rows).select(*KEY, *(keep or []), "_x", C(label).cast("double").alias("y"))


def _scored(learner: Learner, train: DataFrame, test: DataFrame) -> DataFrame:
    """test with p, the probability of 1 by a model of train; the base rate where train has one label alone, nothing where it has no rows."""
    from pyspark.ml.functions import vector_to_array

    labels = [r["y"] for r in train.select("y").distinct().limit(2).collect()]
    if len(labels) < 2:
        return test.limit(0).withColumn("p", F.lit(0.5)) if not labels else test.withColumn("p", F.lit(float(labels[0])))
    fitted = learner().setFeaturesCol("_x").setLabelCol("y").fit(train)
    return fitted.transform(test).select(*test.columns, vector_to_array("probability")[1].alias("p"))


def _side_by_side(jobs: list[Callable[[], DataFrame]], workers: int) -> list[DataFrame]:
    with ThreadPoolExecutor(max(1, workers)) as pool:
        return list(pool.map(lambda job: job(), jobs))


def _together(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for more in parts[1:]:
        out = out.unionByName(more)
    return out


def _folds(bounds: DataFrame) -> list[int]:
    return [r["fold"] for r in bounds.select("fold").distinct().orderBy("fold").collect()]


def out_of_fold(df: DataFrame, features: list[str], label: str, bounds: DataFrame, learner: Learner, *, workers: int = 4) -> DataFrame:
    """symbol, ts, fold, y and p of the test rows of every fold, by models of its training rows."""
    rows = settled(models.with_folds(_assembled(df, features, label), bounds))
    folds = _folds(bounds)
    if not folds:
        return rows.select(*KEY, "fold", "y", F.lit(0.5).alias("p")).limit(0)
    each = [lambda k=k: _scored(learner, rows.where((C("fold") == k) & (C("part") == "train")).select("_x", "y"), rows.where((C("fold") == k) & (C("part") == "test")).select(*KEY, "fold", "_x", "y")).drop("_x") for k in folds]
    return _together(_side_by_side(each, workers))


def stacked(df: DataFrame, features: list[str], label: str, bounds: DataFrame, learners: dict[str, Learner], *, inner: int = 3, meta: Learner | None = None, workers: int = 4) -> DataFrame:
    """symbol, ts, fold, y, p_<learner> of every base model and p of the model stacked on them, of the test rows of every fold.

    The stacked model learns from predictions made inside the fold's training rows: these are cut into `inner` folds of their own, and each base model predicts the test rows of an inner fold from
    that fold's training rows alone. For the outer test rows the base models are trained on all training rows. So no input of the stacked model comes from a model that has seen its row. Folds whose
    training rows are too few for inner folds are left out."""
    from pyspark.ml.feature import VectorAssembler

    meta = meta or logistic()
    names = list(learners)
    rows = settled(models.with_folds(_assembled(df, features, label), bounds))
    columns = [f"p_{n}" for n in names]

    def one(k: int) -> DataFrame | None:
        train = rows.where((C("fold") == k) & (C("part") == "train")).drop("fold", "part")
        test = rows.where((C("fold") == k) & (C("part") == "test")).select(*KEY, "_x", "y")
        own = models.symbol_folds(train, folds=inner, least_train=F.floor(C("n") / 2).cast("int"))
        cut = settled(models.with_folds(train, own))
        folds = _folds(own)
        if not folds:
            return None
        seen = [_together([_scored(learners[n], cut.where((C("fold") == j) & (C("part") == "train")).select("_x", "y"), cut.where((C("fold") == j) & (C("part") == "test")).select(*KEY, "_x", "y")) for j in folds]).select(*KEY, "y", C("p").alias(f"p_{n}")) for n in names]
        base = [_scored(learners[n], train.select("_x", "y"), test).select(*KEY, "y", C("p").alias(f"p_{n}")) for n in names]
        level = VectorAssembler(inputCols=columns, outputCol="_x")
        return _scored(meta, level.transform(_joined(seen)).select("_x", "y"), level.transform(_joined(base))).select(*KEY, F.lit(k).alias("fold"), "y", *columns, "p")

    made = [d for d in _side_by_side([lambda k=k: one(k) for k in _folds(bounds)], workers) if d is not None]
    if not made:
        return rows.select(*KEY, "fold", "y", *(F.lit(0.5).alias(c) for c in [*columns, "p"])).limit(0)
    return _together(made)


def _joined(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for more in parts[1:]:
        out = out.join(more.drop("y"), KEY)
    return out


def incremental_value(df: DataFrame, base: list[str], more: list[str], label: str, ret: str, bounds: DataFrame, learner: Learner, *, paths: int = 1000, workers: int = 4) -> DataFrame:
    """Of every symbol: n, accuracy, Brier score and yearly Sharpe ratio without (base) and with (more) a group of columns, out of fold on the same rows, the differences, the statistic and p-value of
    the losses' comparison, the 95 % interval of the Sharpe ratios' difference, and a decision.

    A model is long from a probability of one half on, else short; ret is the return that follows a row. ACCEPTED: the Sharpe ratio rises, and the losses differ at 5 % or the interval lies above 0; PARTIAL: it
    rises; else REJECTED."""
    ok = settled(df.dropna(subset=[*base, *more, label, ret]).select(*KEY, *base, *more, label, ret))
    without, with_more = _side_by_side([lambda f=f: out_of_fold(ok, f, label, bounds, learner, workers=max(1, workers // 2)) for f in (base, [*base, *more])], 2)
    rows = without.select(*KEY, "fold", "y", C("p").alias("p")).join(with_more.select(*KEY, "fold", C("p").alias("q")), [*KEY, "fold"]).join(ok.select(*KEY, C(ret).alias("ret")), KEY)
    side: Callable[[str], Column] = lambda p: F.when(C(p) >= 0.5, C("ret")).otherwise(-C("ret"))
    rows = rows.withColumns({"held": side("p"), "held_more": side("q")})
    hit = lambda p: F.avg(((C(p) >= 0.5).cast("int") == C("y")).cast("double"))
    sums = rows.groupBy("symbol").agg(F.count("*").alias("n"), hit("p").alias("accuracy_base"), hit("q").alias("accuracy_more"), F.avg(F.pow(C("p") - C("y"), 2)).alias("brier_base"), F.avg(F.pow(C("q") - C("y"), 2)).alias("brier_more"), models._sharpe("held").alias("sharpe_base"), models._sharpe("held_more").alias("sharpe_more"))
    loss = models.diebold_mariano(rows).select("symbol", "statistic", models.student_p(C("statistic"), C("n") - 1).alias("p_value"))
    apart = models.sharpe_difference(rows, "held_more", "held", paths=paths).select("symbol", "low", "high")
    out = sums.join(loss, "symbol").join(apart, "symbol", "left").withColumn("sharpe_delta", C("sharpe_more") - C("sharpe_base"))
    sure = (F.coalesce(C("p_value"), F.lit(1.0)) < 0.05) | (F.coalesce(C("low"), F.lit(-1.0)) > 0)
    return out.withColumn("decision", F.when((C("sharpe_delta") > 0) & sure, "ACCEPTED").when(C("sharpe_delta") > 0, "PARTIAL").otherwise("REJECTED"))


def fold_sequences(df: DataFrame, columns: list[str], bounds: DataFrame, length: int = 20, stride: int = 1, *, target: str | None = None, kind: str = "standard", clip: float | None = None) -> DataFrame:
    """symbol, ts, fold, part, x, mask and target: windows of `length` rows as models.sequences() gives them, within one part of a fold, so that none reaches from training into test rows; the columns are
    scaled by what the fold's training rows of the symbol tell."""
    rows = models.with_folds(df.select(*KEY, *columns, *([target] if target else [])), bounds).withColumn("symbol", F.struct("symbol", "fold"))
    scaled = scaling.transform(rows, scaling.fit(rows.where(C("part") == "train"), columns, kind), columns, kind, clip)
    apart = scaled.withColumn("symbol", F.struct(C("symbol.symbol").alias("symbol"), C("symbol.fold").alias("fold"), "part"))
    out = models.sequences(apart, columns, length, stride, target=target)
    return out.select("symbol.symbol", "ts", "symbol.fold", "symbol.part", *(c for c in out.columns if c not in KEY))
