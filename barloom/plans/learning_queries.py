"""Queries on attributions, collinearity and learning out of fold, with SQL where no model is trained."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barloom.operators import attributions, features, learning, models
from barloom.plans.bars_sql import W, full, lag
from barloom.plans.model_queries import _XY, _folds_sql, _labelled
from barloom.plans.registry import query, rounded
from barloom.plans.volatility_queries import PRICES, price_bars

C = F.col
BASE, MORE = ["mom_5d", "zscore_20d"], ["volume_roc_10", "volume_z_20"]
_X = f"""{PRICES}, f AS (SELECT symbol, ts, close / nullif({lag('close', 5)}, 0) - 1 AS mom_5d, close / nullif({lag('close', 10)}, 0) - 1 AS mom_10d, close, {full('avg(close)', 'close', 20)} AS m, {full('stddev_samp(close)', 'close', 20)} AS d,
  (volume - {lag('volume', 10)}) / nullif({lag('volume', 10)}, 0) AS volume_roc_10, lead(close) OVER {W} AS nxt FROM bars),
x AS (SELECT mom_5d, mom_10d, CASE WHEN d = 0 AND close = m THEN 0 ELSE (close - m) / nullif(d, 0) END AS zscore_20d, volume_roc_10 FROM f WHERE nxt IS NOT NULL AND m IS NOT NULL AND mom_10d IS NOT NULL AND volume_roc_10 IS NOT NULL)"""
_COLUMNS = ["mom_10d", "mom_5d", "volume_roc_10", "zscore_20d"]


def _rows(spark: SparkSession, sf_dir: str, names: list[str]) -> DataFrame:
    """symbol, ts, the features, next (return of the next bar) and y (it is up), without nulls."""
    b = features.compute(price_bars(spark, sf_dir), names)
    after = features.target(C("close"))
    return b.select("symbol", "ts", *names, after.alias("next"), (after > 0).cast("int").alias("y")).dropna()


@query("collinear_features", f"WITH {_X} " + " UNION ALL ".join(f"SELECT '{a}' AS a, '{b}' AS b, count(*) AS n, round(corr({a}, {b}), 6) AS r FROM x" for a in _COLUMNS for b in _COLUMNS if a < b))
def collinear_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Correlations of four features over all symbols' bars."""
    corr = attributions.correlations(_rows(spark, sf_dir, _COLUMNS), _COLUMNS)
    return rounded(corr.where("a < b"))


def _minor(rows: list[str], columns: list[str]) -> str:
    """Determinant of correlations by expansion."""
    if len(rows) == 1:
        return f"c({rows[0]},{columns[0]})"
    return "(" + " + ".join(f"{'-' if k % 2 else ''}{_cell(rows[0], c)} * {_minor(rows[1:], columns[:k] + columns[k + 1:])}" for k, c in enumerate(columns)) + ")"


def _cell(a: str, b: str) -> str:
    return f"c({a},{b})"


def _spelled(text: str) -> str:
    for i, a in enumerate(_COLUMNS):
        for j, b in enumerate(_COLUMNS):
            text = text.replace(f"c({a},{b})", "1.0" if i == j else f"r{min(i, j)}{max(i, j)}")
    return text


@query(
    "variance_inflation",
    f"WITH {_X}, c AS (SELECT {', '.join(f'corr({_COLUMNS[i]}, {_COLUMNS[j]}) AS r{i}{j}' for i in range(4) for j in range(i + 1, 4))} FROM x) "
    + " UNION ALL ".join(f"SELECT '{f}' AS feature, round({_spelled(_minor([c for c in _COLUMNS if c != f], [c for c in _COLUMNS if c != f]))} / {_spelled(_minor(_COLUMNS, _COLUMNS))}, 4) AS vif FROM c" for f in _COLUMNS),
)
def variance_inflation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(attributions.variance_inflation(attributions.correlations(_rows(spark, sf_dir, _COLUMNS), _COLUMNS)), 4)


@query("tree_attributions")
def tree_attributions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shapley ranks of four features in boosted trees of the next bar's direction, beside their ranks one by one."""
    from pyspark.ml.classification import GBTClassifier
    from pyspark.ml.feature import VectorAssembler

    names = [*BASE, *MORE]
    rows = _rows(spark, sf_dir, names)
    fitted = GBTClassifier(featuresCol="_x", labelCol="y", maxIter=10, maxDepth=3, seed=1).fit(VectorAssembler(inputCols=names, outputCol="_x").transform(rows))
    ranks = attributions.ranking(attributions.attributions(rows, fitted, names), names)
    return rounded(attributions.cross_reference(ranks, rows, names, "y"), 4)


@query("stacked_models")
def stacked_models(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores by symbol of a logistic model and a tree, and of the model stacked on them, over five folds."""
    rows = _rows(spark, sf_dir, [*BASE, *MORE])
    found = learning.stacked(rows, [*BASE, *MORE], "y", models.symbol_folds(rows), {"logistic": learning.logistic(), "tree": learning.tree()})
    each = found.select("symbol", "y", F.explode(F.array(*(F.struct(F.lit(n).alias("model"), C(c).alias("p")) for n, c in (("logistic", "p_logistic"), ("tree", "p_tree"), ("stacked", "p"))))).alias("m")).select("symbol", "y", "m.*")
    return rounded(models.classification(each, ["symbol", "model"]), 4)


@query("incremental_value")
def incremental_value(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What two volume features add to two price features, over five folds."""
    rows = _rows(spark, sf_dir, [*BASE, *MORE])
    return rounded(learning.incremental_value(rows, BASE, MORE, "y", "next", models.symbol_folds(rows), learning.logistic()), 4)


@query("stored_model")
def stored_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The production model trained, saved, promoted and read back: its manifest, and how many of its predictions differ from the stored one's."""
    from barloom.functions.lineage import shared_folder
    from barloom.operators import artifacts, production

    data = production.dataset(price_bars(spark, sf_dir))
    root = shared_folder(spark, "models")
    artifacts.train(data, root, "v1")
    model, manifest = artifacts.load(spark, root)
    again, _ = artifacts.load(spark, root, "v1")
    both = model.transform(data).select("symbol", "ts", C("prediction").alias("p")).join(again.transform(data).select("symbol", "ts", C("prediction").alias("q")), ["symbol", "ts"])
    seen = both.agg(F.count("*").alias("predicted"), F.count_if(C("p") != C("q")).alias("apart"))
    told = artifacts.versions(spark, root).select("name", "version", F.size("features").alias("n_features"), "rows", "first", "last", F.round(C("metrics")["accuracy"], 4).alias("accuracy"), F.round(C("metrics")["brier"], 4).alias("brier"))
    return told.where(C("version") == manifest["version"]).join(seen, F.lit(True))


@query(
    "fold_sequences",
    f"""WITH {_XY}, {_folds_sql('xy', False)}, t AS (SELECT symbol, fold, avg(mom) AS c, stddev_samp(mom) AS s FROM parts WHERE part = 'train' GROUP BY 1, 2),
w AS (SELECT symbol, fold, part, (mom - c) / s AS z, row_number() OVER (PARTITION BY symbol, fold, part ORDER BY ts) AS k FROM parts JOIN t USING (symbol, fold))
SELECT symbol, fold, part, count(*) AS n, round(avg(z), 6) AS mean_last FROM w WHERE k >= 20 GROUP BY 1, 2, 3""",
)
def fold_sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many windows of 20 rows each part of five folds has, and the mean of their last values, scaled by the fold's training rows."""
    rows = _labelled(spark, sf_dir)
    found = learning.fold_sequences(rows.select("symbol", "ts", "mom_5d"), ["mom_5d"], models.symbol_folds(rows))
    return rounded(found.groupBy("symbol", "fold", "part").agg(F.count("*").alias("n"), F.avg(F.element_at("x", -1)[0]).alias("mean_last")))
