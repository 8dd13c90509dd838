import datetime as dt
import itertools
import math

import numpy as np
import pytest
from pyspark.ml.classification import DecisionTreeClassifier, GBTClassifier, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from barloom.operators import attributions as at
from barloom.operators import learning, models

AT = dt.datetime(2024, 1, 1)


@pytest.fixture(scope="module")
def rows(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(600, 3))
    y = (x[:, 0] * x[:, 1] + 0.5 * x[:, 2] + 0.3 * rng.normal(size=600) > 0).astype(int)
    return spark.createDataFrame([("ab"[k % 2], AT + dt.timedelta(hours=k // 2), *map(float, v), int(c)) for k, (v, c) in enumerate(zip(x, y))], "symbol string, ts timestamp_ntz, u double, v double, w double, y int").cache()


def assembled(rows):
    return VectorAssembler(inputCols=["u", "v", "w"], outputCol="x").transform(rows)


def expected(found, x, known):
    """The margin when only some features are known, leaf by leaf."""
    total = 0.0
    for leaf in found:
        value = leaf.value
        for k, f in enumerate(leaf.features):
            value *= float(leaf.low[k] < x[f] <= leaf.high[k]) if f in known else leaf.share[k]
        total += value
    return total


def enumerated(found, x, n):
    """Shapley values over all subsets."""
    out = np.zeros(n)
    for i in range(n):
        rest = [j for j in range(n) if j != i]
        for size in range(n):
            for s in itertools.combinations(rest, size):
                weight = math.factorial(size) * math.factorial(n - size - 1) / math.factorial(n)
                out[i] += weight * (expected(found, x, {*s, i}) - expected(found, x, set(s)))
    return out


@pytest.mark.parametrize("kind", ["boosted", "forest", "tree"])
def test_values_add_up_and_equal_enumeration(rows, kind):
    est = {"boosted": GBTClassifier(maxIter=4, maxDepth=4, seed=1), "forest": RandomForestClassifier(numTrees=3, maxDepth=4, seed=1), "tree": DecisionTreeClassifier(maxDepth=5)}[kind]
    model = est.setFeaturesCol("x").setLabelCol("y").fit(assembled(rows))
    found = at.leaves(model)
    some = model.transform(assembled(rows)).limit(40).collect()
    x = np.array([r["x"].toArray() for r in some])
    got, base = at.shapley(found, x), at.base_value(found)
    margin = at.margins(found, x)
    assert np.allclose(base + got.sum(1), margin)
    want = [r["rawPrediction"][1] if kind == "boosted" else r["probability"][1] for r in some]
    assert np.allclose(margin, want, atol=1e-9)
    for k in range(10):
        assert np.allclose(got[k], enumerated(found, x[k], 3))
    both = at.interactions(found, x)
    assert np.allclose(both.sum(2), got) and np.allclose(both, both.transpose(0, 2, 1)) and np.abs(both[:, 0, 1]).mean() > 0


def test_ranks_in_spark(spark, rows):
    model = GBTClassifier(maxIter=5, maxDepth=3, seed=1, featuresCol="x", labelCol="y").fit(assembled(rows))
    names = ["u", "v", "w"]
    extra = rows.unionByName(spark.createDataFrame([("a", AT, None, 1.0, float("nan"), 1)], rows.schema))
    explained = at.attributions(extra, model, names)
    assert explained.where("shap IS NULL").count() == 1
    values = np.array([r["shap"] for r in explained.where("shap IS NOT NULL").collect()])
    ranks = {r["feature"]: r for r in at.ranking(explained, names).collect()}
    assert np.allclose([ranks[n]["mean_abs_shap"] for n in names], np.abs(values).mean(0)) and np.isclose(sum(r["importance_share"] for r in ranks.values()), 1)
    crossed = {r["feature"]: r for r in at.cross_reference(at.ranking(explained, names), rows, names, "y").collect()}
    assert crossed["w"]["corr_rank"] == 1 and {r["information_rank"] for r in crossed.values()} == {1, 2, 3} and all(r["lift"] == r["corr_rank"] - r["shap_rank"] for r in crossed.values())
    shares = at.tree_importance(rows, names, "y").collect()
    assert np.isclose(sum(r["importance"] for r in shares), 1) and [r["feature"] for r in shares] == names


def test_collinearity(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(300, 3)) * 1000 + 5
    data = [(*map(float, r), float(r[0] + 0.1 * r[1]), 7.0, float(r[0] + r[2])) for r in x] + [(None, 1.0, 1.0, 1.0, 7.0, 1.0)]
    frame = spark.createDataFrame(data, "a double, b double, c double, d double, e double, f double").repartition(3)
    corr = at.correlations(frame, ["a", "b", "c", "d", "e"])
    m = np.array([r[:4] for r in data[:-1]])
    want = np.corrcoef(m.T)
    got = {(r["a"], r["b"]): r["r"] for r in corr.collect()}
    assert len(got) == 16 and all(np.isclose(got["abcd"[i], "abcd"[j]], want[i, j]) for i in range(4) for j in range(4))
    vif = {r["feature"]: r["vif"] for r in at.variance_inflation(at.correlations(frame, ["a", "b", "c"])).collect()}
    assert np.allclose([vif[k] for k in "abc"], np.diag(np.linalg.inv(want[:3, :3])))
    full = {r["feature"]: r["vif"] for r in at.variance_inflation(at.correlations(frame, ["a", "c", "f", "b"])).collect()}
    assert all(full[k] == math.inf for k in "acf") and full["b"] < 1.1
    assert [(r["a"], r["b"]) for r in at.collinear(corr).collect()] == [("a", "d")]
    assert at.variance_inflation(at.correlations(frame.limit(0), ["a", "b"])).count() == 0


class Memory:
    """A learner that gives 1 to the rows it has seen."""

    def setFeaturesCol(self, _):
        return self

    def setLabelCol(self, _):
        return self

    def fit(self, train):
        self.seen = train.select(F.hash("_x").alias("h")).distinct()
        return self

    def transform(self, test):
        got = test.withColumn("h", F.hash("_x")).join(self.seen.withColumn("s", F.lit(1.0)), "h", "left").withColumn("s", F.coalesce("s", F.lit(0.0)))
        return got.withColumn("probability", array_to_vector(F.array(1 - F.col("s"), F.col("s"))))


def test_no_input_of_the_stacked_model_saw_its_row(rows):
    inputs = []

    class Meta(Memory):
        def fit(self, train):
            inputs.append(train.agg(F.max(F.col("_x").cast("string")), F.count("*")).first())
            return super().fit(train)

    bounds = models.symbol_folds(rows, folds=2)
    got = learning.stacked(rows, ["u", "v", "w"], "y", bounds, {"m": Memory}, inner=2, meta=Meta, workers=1)
    assert got.count() > 50 and got.agg(F.max("p_m")).first()[0] == 0.0
    assert len(inputs) == 2 and all(m == "[0.0]" and n > 20 for m, n in inputs)


def test_stacking_and_folds_side_by_side(rows):
    bounds = models.symbol_folds(rows, folds=2)
    got = learning.stacked(rows, ["u", "v", "w"], "y", bounds, {"a": learning.logistic(), "b": learning.tree(4, 5)}, inner=2)
    out = got.collect()
    assert {r["fold"] for r in out} == {1, 2} and all(0 <= r["p"] <= 1 for r in out)
    one = {(r["symbol"], r["ts"]): r["p"] for r in learning.out_of_fold(rows, ["u", "v", "w"], "y", bounds, learning.logistic()).collect()}
    assert len(one) == len(out) and all(abs(one[r["symbol"], r["ts"]] - r["p_a"]) < 1e-6 for r in out)
    score = lambda c: np.mean([(r[c] >= 0.5) == r["y"] for r in out])
    assert score("p") > 0.55
    assert learning.stacked(rows.limit(0), ["u"], "y", bounds.limit(0), {"a": learning.logistic()}).count() == 0


def test_incremental_value(spark, rows):
    good = rows.withColumn("next", (F.col("y") * 2 - 1) * 0.01 + 0.001 * F.col("v")).withColumn("told", F.col("y") + 0.1 * F.col("u"))
    bounds = models.symbol_folds(rows, folds=3)
    got = learning.incremental_value(good, ["v"], ["told"], "y", "next", bounds, learning.logistic(), paths=100).collect()
    assert len(got) == 2 and all(r["decision"] == "ACCEPTED" and r["accuracy_more"] > 0.95 and r["p_value"] < 0.05 and r["low"] > 0 and r["sharpe_delta"] > 0 for r in got)
    same = learning.incremental_value(good.withColumn("again", F.lit(1.0)), ["told"], ["again"], "y", "next", bounds, learning.logistic(), paths=50).collect()
    assert all(r["decision"] == "REJECTED" and r["n"] > 50 for r in same)


def test_rules_in_words(rows):
    model = DecisionTreeClassifier(maxDepth=2, featuresCol="x", labelCol="y").fit(assembled(rows))
    found = at.rules(model, ["u", "v", "w"])
    assert 2 <= len(found) <= 4 and np.isclose(sum(s for _, _, s in found), 1) and all(0 <= v <= 1 and (">" in r or "<=" in r) for r, v, _ in found)


def test_sequences_stay_within_a_part(spark, rows):
    bounds = models.symbol_folds(rows, folds=2)
    got = learning.fold_sequences(rows, ["u", "v"], bounds, 10, target="y").collect()
    parts = {}
    for r in models.with_folds(rows, bounds).collect():
        parts.setdefault((r["symbol"], r["fold"], r["part"]), []).append((r["ts"], r["u"], r["y"]))
    assert len(got) == sum(max(0, len(p) - 9) for p in parts.values())
    for r in got[:200]:
        own = sorted(parts[r["symbol"], r["fold"], r["part"]])
        k = [t for t, _, _ in own].index(r["ts"])
        train = np.array([u for _, u, _ in parts[r["symbol"], r["fold"], "train"]])
        assert np.allclose([x[0] for x in r["x"]], (np.array([u for _, u, _ in own[k - 9 : k + 1]]) - train.mean()) / train.std(ddof=1)) and r["target"] == own[k][2]
