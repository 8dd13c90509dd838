"""Trained models as artifacts: saved with a manifest, promoted by one rename, read back."""

from __future__ import annotations

import json
import uuid

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barloom.operators import production

C = F.col
MANIFEST = "name string, version string, features array<string>, label string, rows long, first timestamp_ntz, last timestamp_ntz, params map<string,string>, metrics map<string,double>"


def _files(spark: SparkSession, path: str):
    jvm = spark._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    return at, jvm.org.apache.hadoop.fs.FileContext.getFileContext(at.toUri(), spark._jsc.hadoopConfiguration())


def save(model: PipelineModel, manifest: DataFrame, root: str) -> str:
    """Writes the model and its manifest (one MANIFEST row) below root and returns their version's folder. Nothing is visible under the version's name before both are whole: they are written under
    another name, then renamed once. A version that is there already is an error."""
    spark = manifest.sparkSession
    version = manifest.first()["version"]
    part, target = f"{root}/.{uuid.uuid4().hex}", f"{root}/{version}"
    model.write().overwrite().save(f"{part}/model")
    manifest.coalesce(1).write.json(f"{part}/manifest")
    (src, files), (dst, _) = _files(spark, part), _files(spark, target)
    files.rename(src, dst, spark.sparkContext._gateway.new_array(spark._jvm.org.apache.hadoop.fs.Options.Rename, 0))
    return target


def promote(spark: SparkSession, root: str, version: str) -> None:
    """Makes a version the current one: a small file with its name replaces the one before by a single rename, so readers see the old version or the new one."""
    if version not in [r["version"] for r in versions(spark, root).select("version").collect()]:
        raise KeyError(version)
    part = f"{root}/.{uuid.uuid4().hex}"
    (src, files), (dst, _) = _files(spark, part), _files(spark, f"{root}/_current")
    jvm = spark._jvm
    flags = jvm.java.util.EnumSet.of(jvm.org.apache.hadoop.fs.CreateFlag.CREATE)
    out = files.create(src, flags, spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.CreateOpts, 0))
    out.write(bytearray(json.dumps({"version": version}).encode()))
    out.close()
    how = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
    how[0] = jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
    files.rename(src, dst, how)


def versions(spark: SparkSession, root: str) -> DataFrame:
    """The manifests of all versions."""
    return spark.read.schema(MANIFEST).option("pathGlobFilter", "*.json").json(f"{root}/*/manifest")


def current(spark: SparkSession, root: str) -> str:
    """The version that was promoted last."""
    files = _files(spark, f"{root}/_current")
    if not files[1].util().exists(files[0]):
        raise KeyError(f"no version of {root} is promoted")
    return _read(spark, f"{root}/_current")["version"]


def _read(spark: SparkSession, path: str) -> dict:
    at, files = _files(spark, path)
    stream = files.open(at)
    text = spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    stream.close()
    return json.loads(text)


def load(spark: SparkSession, root: str, version: str | None = None) -> tuple[PipelineModel, dict]:
    """(model, manifest) of a version, or of the current one."""
    version = version or current(spark, root)
    found = versions(spark, root).where(C("version") == version).collect()
    if not found:
        raise KeyError(version)
    return PipelineModel.load(f"{root}/{version}/model"), found[0].asDict(recursive=True)


def train(data: DataFrame, root: str, version: str, *, columns: list[str] | None = None, estimator=None, folds: int = 5) -> DataFrame:
    """Evaluates data(symbol, ts, close, features, y) out of fold, trains on all rows, saves and promotes the model, and returns its manifest. The metrics are the means over
    symbols of production.evaluate()'s."""
    from pyspark.ml import Pipeline
    from pyspark.ml.classification import GBTClassifier
    from pyspark.ml.feature import VectorAssembler

    columns = columns or production.FEATURES
    make = estimator or (lambda: GBTClassifier(maxIter=10, maxDepth=3, seed=1))
    scores = production.evaluate(data, columns, folds=folds, estimator=make)
    numbers = [c for c, t in scores.dtypes if t in ("double", "bigint", "int") and c != "symbol"]
    metrics = scores.agg(*(F.avg(c).alias(c) for c in numbers)).first().asDict()
    last = make().setFeaturesCol("_x").setLabelCol("_y")
    model = Pipeline(stages=[VectorAssembler(inputCols=columns, outputCol="_x"), last]).fit(data.dropna(subset=[*columns, "y"]).withColumn("_y", C("y").cast("double")))
    span = data.agg(F.count("*").alias("n"), F.min("ts").cast("timestamp_ntz").alias("a"), F.max("ts").cast("timestamp_ntz").alias("b")).first()
    params = {p.name: str(v) for p, v in last.extractParamMap().items()}
    row = (type(last).__name__, version, columns, "y", span["n"], span["a"], span["b"], params, {k: float(v) for k, v in metrics.items() if v is not None})
    manifest = data.sparkSession.createDataFrame([row], MANIFEST)
    save(model, manifest, root)
    promote(data.sparkSession, root, version)
    return manifest
