"""What a tree ensemble's prediction is made of: Shapley values by paths, their ranks, and ranks by single features.

A leaf's path asks for a few features. A feature that is known answers with 1 or 0, one that is not with the share of training rows that go the path's way there. The value of a set of
known features is the product of these answers, so the Shapley values of a leaf are sums over the coefficients of a small polynomial, one factor for each feature of the path; all rows of a
batch are valued together. The trees' arrays go to the workers with the function; they have a row for each node, whatever the number of rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

C = F.col


@dataclass(frozen=True)
class Leaf:
    """A leaf's value, and of each feature on its path: the values (low, high] that lead to it and the share of training rows that went that way."""

    value: float
    features: tuple[int, ...]
    low: np.ndarray
    high: np.ndarray
    share: np.ndarray


def leaves(model) -> list[Leaf]:
    """The leaves of all trees of a fitted pyspark.ml tree or ensemble with continuous splits, valued with the trees' weights. The sum of their values is the ensemble's margin: of
    a gradient-boosted classifier the raw prediction of class 1, of a forest or single tree for two classes the mean share of class 1."""
    trees = getattr(model, "trees", None) or [model]
    weights = list(getattr(model, "treeWeights", [1.0]))
    if type(model).__name__.startswith("RandomForest"):
        weights = [1 / len(trees)] * len(trees)
    out: list[Leaf] = []

    def value(node) -> float:
        stats = list(node.impurityStats().stats())
        return stats[1] / sum(stats) if "Classification" in type(trees[0]).__name__ else float(node.prediction())

    def walk(node, weight: float, path: dict[int, tuple[float, float, float]]) -> None:
        if node.getClass().getSimpleName() == "LeafNode":
            at = sorted(path)
            out.append(Leaf(weight * value(node), tuple(at), *(np.array([path[f][k] for f in at]) for k in range(3))))
            return
        split, count = node.split(), float(node.impurityStats().count())
        if split.getClass().getSimpleName() != "ContinuousSplit":
            raise ValueError("splits by categories have no attributions here")
        f, at = split.featureIndex(), float(split.threshold())
        low, high, share = path.get(f, (-math.inf, math.inf, 1.0))
        for child, lo, hi in ((node.leftChild(), low, min(high, at)), (node.rightChild(), max(low, at), high)):
            walk(child, weight, path | {f: (lo, hi, share * float(child.impurityStats().count()) / count)})

    for tree, weight in zip(trees, weights, strict=True):
        walk(tree._java_obj.rootNode() if hasattr(tree, "_java_obj") else tree, float(weight), {})
    return out


def _products(known: np.ndarray, unknown: np.ndarray) -> np.ndarray:
    """[size, row]: of all sets of the features, summed by size, the product of what the known and the unknown answer. known[row, feature], unknown[feature]."""
    out = np.zeros((known.shape[1] + 1, len(known)))
    out[0] = 1
    for k in range(known.shape[1]):
        out[1 : k + 2] = out[1 : k + 2] * unknown[k] + out[: k + 1] * known[:, k]
        out[0] = out[0] * unknown[k]
    return out


def base_value(found: list[Leaf]) -> float:
    """The expected margin without any feature known."""
    return sum(leaf.value * float(np.prod(leaf.share)) for leaf in found)


def margins(found: list[Leaf], x: np.ndarray) -> np.ndarray:
    """The sum of the values of the leaves that rows x[row, feature] reach."""
    return sum((leaf.value * ((x[:, leaf.features] > leaf.low) & (x[:, leaf.features] <= leaf.high)).all(1) for leaf in found), np.zeros(len(x)))


def shapley(found: list[Leaf], x: np.ndarray) -> np.ndarray:
    """[row, feature]: with the base value they add up to the margin."""
    out = np.zeros(x.shape)
    for leaf in found:
        d = len(leaf.features)
        own = ((x[:, leaf.features] > leaf.low) & (x[:, leaf.features] <= leaf.high)).astype(float)
        weight = np.array([math.factorial(s) * math.factorial(d - s - 1) / math.factorial(d) for s in range(d)])
        for k, f in enumerate(leaf.features):
            rest = np.arange(d) != k
            out[:, f] += leaf.value * (own[:, k] - leaf.share[k]) * (weight @ _products(own[:, rest], leaf.share[rest]))
    return out


def interactions(found: list[Leaf], x: np.ndarray) -> np.ndarray:
    """[row, feature, feature]: half of what two features do together off the diagonal, on it what is left of a feature's Shapley value; rows add up to these values."""
    out = np.zeros((len(x), x.shape[1], x.shape[1]))
    for leaf in found:
        d = len(leaf.features)
        own = ((x[:, leaf.features] > leaf.low) & (x[:, leaf.features] <= leaf.high)).astype(float)
        weight = np.array([math.factorial(s) * math.factorial(d - s - 2) / (2 * math.factorial(d - 1)) for s in range(d - 1)])
        for k in range(d):
            for j in range(k):
                rest = (np.arange(d) != k) & (np.arange(d) != j)
                both = leaf.value * (own[:, k] - leaf.share[k]) * (own[:, j] - leaf.share[j]) * (weight @ _products(own[:, rest], leaf.share[rest]))
                out[:, leaf.features[k], leaf.features[j]] += both
                out[:, leaf.features[j], leaf.features[k]] += both
    at = np.arange(x.shape[1])
    out[:, at, at] = shapley(found, x) - out.sum(2)
    return out


def attributions(df: DataFrame, model, features: list[str]) -> DataFrame:
    """df with base, margin and shap (array, in order of the features) of every row; rows with a null feature have nulls."""
    found = leaves(model)
    base = base_value(found)

    @F.pandas_udf("struct<margin:double, shap:array<double>>")
    def explain(values: pd.Series) -> pd.DataFrame:
        ok = values.notna().to_numpy() & np.array([v is not None and all(a is not None and a == a for a in v) for v in values], bool)
        x = np.array([list(v) for v in values[ok]], float).reshape(-1, len(features))
        out = pd.DataFrame({"margin": [None] * len(values), "shap": [None] * len(values)}, dtype=object)
        at = np.flatnonzero(ok)
        for i, m, s in zip(at, margins(found, x), shapley(found, x), strict=True):
            out.iat[i, 0], out.iat[i, 1] = float(m), s.tolist()
        return out

    values = F.array(*(C(f).cast("double") for f in features))
    return df.withColumn("_e", explain(values)).withColumns({"base": F.lit(base), "margin": C("_e.margin"), "shap": C("_e.shap")}).drop("_e")


def ranking(explained: DataFrame, features: list[str]) -> DataFrame:
    """feature, mean_abs_shap, importance_share and shap_rank (from 1; equal values share a rank) over attributions()' rows."""
    names = F.array(*map(F.lit, features))
    rows = explained.where("shap IS NOT NULL").select(F.explode(F.arrays_zip(names.alias("feature"), "shap")).alias("p")).select("p.*")
    means = rows.groupBy("feature").agg(F.avg(F.abs("shap")).alias("mean_abs_shap"))
    total = F.sum("mean_abs_shap").over(Window.partitionBy(F.lit(0)))  # a row for each feature
    share = F.when(total > 0, C("mean_abs_shap") / total).otherwise(0.0)
    return means.withColumn("importance_share", share).withColumn("shap_rank", F.dense_rank().over(Window.orderBy(F.desc("mean_abs_shap"))))


def cross_reference(ranks: DataFrame, df: DataFrame, features: list[str], label: str, bins: int = 10) -> DataFrame:
    """ranks with corr (absolute, with the label), information (nats, of the feature's deciles with the label), their dense ranks, and lift (corr_rank - shap_rank): high where a
    feature counts in combination only."""
    rows = df.dropna(subset=[*features, label]).select(C(label).cast("double").alias("_y"), F.posexplode(F.array(*(C(f).cast("double") for f in features))).alias("_i", "_v"))
    names = F.array(*map(F.lit, features))
    corr = rows.groupBy("_i").agg(F.abs(F.corr("_v", "_y")).alias("corr"))
    edges = rows.groupBy("_i").agg(F.percentile_approx("_v", [k / bins for k in range(1, bins)], 10_000).alias("_e"))
    joint = rows.join(F.broadcast(edges), "_i").groupBy("_i", F.aggregate("_e", F.lit(0), lambda a, e: a + F.when(C("_v") > e, 1).otherwise(0)).alias("_b"), "_y").agg(F.count("*").alias("n"))
    w = Window.partitionBy
    p, px, py = C("n") / F.sum("n").over(w("_i")), F.sum("n").over(w("_i", "_b")) / F.sum("n").over(w("_i")), F.sum("n").over(w("_i", "_y")) / F.sum("n").over(w("_i"))
    info = joint.select("_i", (p * F.log(p / (px * py))).alias("i")).groupBy("_i").agg(F.sum("i").alias("information"))
    both = corr.join(info, "_i").select(F.get(names, C("_i")).alias("feature"), "corr", "information")
    out = ranks.join(both, "feature")
    out = out.withColumns({f"{c}_rank": F.dense_rank().over(Window.orderBy(F.desc_nulls_last(n))) for c, n in (("corr", "corr"), ("information", "information"))})
    return out.withColumn("lift", C("corr_rank") - C("shap_rank"))


def rules(model, features: list[str]) -> list[tuple[str, float, float]]:
    """(conditions, value, share of the training rows) of every leaf of a fitted tree or ensemble, in words."""
    out = []
    for leaf in leaves(model):
        parts = [f"{features[f]} > {lo:g}" for f, lo in zip(leaf.features, leaf.low, strict=True) if lo > -math.inf] + [f"{features[f]} <= {hi:g}" for f, hi in zip(leaf.features, leaf.high, strict=True) if hi < math.inf]
        out.append((" and ".join(sorted(parts)) or "always", leaf.value, float(np.prod(leaf.share))))
    return out


def tree_importance(df: DataFrame, features: list[str], label: str, *, depth: int = 5, regression: bool = False, seed: int = 42) -> DataFrame:
    """feature and importance (shares of impurity removed, which add up to 1) in one decision tree over rows without nulls."""
    from pyspark.ml.classification import DecisionTreeClassifier
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.regression import DecisionTreeRegressor

    rows = VectorAssembler(inputCols=features, outputCol="_x").transform(df.dropna(subset=[*features, label])).select("_x", C(label).cast("double").alias("_y"))
    model = (DecisionTreeRegressor if regression else DecisionTreeClassifier)(featuresCol="_x", labelCol="_y", maxDepth=depth, seed=seed).fit(rows)
    return df.sparkSession.createDataFrame(list(zip(features, model.featureImportances.toArray().tolist(), strict=True)), "feature string, importance double")


def correlations(df: DataFrame, features: list[str]) -> DataFrame:
    """a, b, n and r of all pairs of features (both orders, each with itself) over rows without nulls or NaN; features without variance are left out. Every task adds up the products of its
    rows as one matrix, so only features by features numbers of each task are shuffled."""
    ok = df.select(*(C(f).cast("double").alias(f) for f in features)).dropna()
    first = ok.agg(*(F.avg(f) for f in features)).first()
    means = np.array([m if m is not None else 0.0 for m in first])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        n, total, sums = 0, np.zeros((len(features), len(features))), np.zeros(len(features))
        for batch in batches:
            x = batch.to_numpy(float) - means
            n, total, sums = n + len(x), total + x.T @ x, sums + x.sum(0)
        i, j = (k.ravel() for k in np.indices(total.shape))
        yield pd.DataFrame({"i": i, "j": j, "n": n, "p": total.ravel(), "s": sums[i], "t": sums[j]})

    parts = ok.mapInPandas(run, "i int, j int, n long, p double, s double, t double").groupBy("i", "j").agg(*(F.sum(c).alias(c) for c in ("n", "p", "s", "t")))
    cov = parts.where("n > 0").withColumn("c", (C("p") - C("s") * C("t") / C("n")) / C("n"))
    own = cov.where("i = j AND sqrt(greatest(c, 0)) > 1e-8").select("i", F.sqrt("c").alias("d"))
    names = F.array(*map(F.lit, features))
    out = cov.join(own.withColumnRenamed("d", "di"), "i").join(own.select(C("i").alias("j"), C("d").alias("dj")), "j")
    return out.select(F.get(names, C("i")).alias("a"), F.get(names, C("j")).alias("b"), "n", F.when(C("i") == C("j"), 1.0).otherwise(C("c") / (C("di") * C("dj"))).alias("r"))


def collinear(corr: DataFrame, least: float = 0.85) -> DataFrame:
    """a, b and r of the pairs a < b of correlations() with an absolute correlation of `least` or more."""
    return corr.where((C("a") < C("b")) & (F.abs("r") >= least)).select("a", "b", F.abs("r").alias("r"))


def variance_inflation(corr: DataFrame) -> DataFrame:
    """feature and vif, the diagonal of the inverse of correlations(); infinite for features that depend on others."""

    def run(group: pd.DataFrame) -> pd.DataFrame:
        m = group.pivot(index="a", columns="b", values="r")
        m = m.loc[sorted(m.index), sorted(m.index)]
        r, out = m.to_numpy(float), []
        for k, name in enumerate(m.index):
            rest = np.arange(len(r)) != k
            left = 1 - (r[k, rest] @ np.linalg.pinv(r[np.ix_(rest, rest)], rcond=1e-10, hermitian=True) @ r[rest, k] if rest.any() else 0.0)
            out.append((name, 1 / left if left > 1e-9 else math.inf))
        return pd.DataFrame(out, columns=["feature", "vif"])

    return corr.withColumn("_g", F.lit(0)).groupBy("_g").applyInPandas(run, "feature string, vif double")
