import datetime as dt

import numpy as np
import pytest
from pyspark.ml.classification import LogisticRegression

from barloom.operators import artifacts as ar
from barloom.sources import reports
from barloom.sources.bars import BarStore
from barloom.streaming import sinks

AT = dt.datetime(2024, 1, 1)
BARS = "symbol string, ts timestamp_ntz, open double, high double, low double, close double, volume double"


def bars(spark, rows):
    return spark.createDataFrame([(s, AT + dt.timedelta(hours=k), *map(float, v)) for s, k, *v in rows], BARS)


def test_reports_and_trends(spark, tmp_path):
    good = [("a", k, 2, 3, 1, 2, 5) for k in range(5)]
    bad = [("b", 0, 2, 3, 1, 2, 5), ("b", 0, 2, 1, 3, 2, 5), ("b", 2, -1, 3, 1, 2, 5)]
    out = {r["symbol"]: r for r in reports.validation_reports(bars(spark, good + bad), "2024-01-02").collect()}
    assert out["a"]["is_valid"] and out["a"]["total_rows"] == 5 and not out["b"]["is_valid"] and out["b"]["critical"] == 2
    assert {r["rule"]: r["affected"] for r in out["b"]["results"]} == {"schema": 0, "range": 2, "order": 1, "freshness": 0}
    root = str(tmp_path / "r")
    for _ in range(2):  # a run written again replaces itself
        reports.save_reports(reports.validation_reports(bars(spark, good + bad), "2024-01-02"), root, "one")
    reports.save_reports(reports.validation_reports(bars(spark, good), "2024-03-02"), root, "two")
    got = reports.read_reports(spark, root)
    assert got.count() == 3 and {r["run"] for r in got.collect()} == {"one", "two"}
    days, rules = reports.report_trends(got)
    assert {str(r["date"]): (r["reports"], r["valid"], r["critical"], r["warnings"]) for r in days.collect()} == {"2024-01-02": (2, 1, 2, 0), "2024-03-02": (1, 1, 0, 1)}
    assert {r["rule"]: (r["failures"], r["symbols"], r["affected"]) for r in rules.collect()} == {"range": (1, 1, 2), "order": (1, 1, 1), "freshness": (1, 1, 1)}
    assert reports.validation_reports(bars(spark, good).limit(0), "2024-01-02").count() == 0


def test_migration_counts(spark, tmp_path):
    store = BarStore(spark, str(tmp_path / "s"))
    raw = bars(spark, [("a", k, 2, 3, 1, 2, 5) for k in range(4)] + [("b", 0, 2, 3, 1, 2, 5)] * 2)
    got = {r["symbol"]: (r["raw_rows"], r["stored_rows"], r["same"]) for r in reports.migrate(raw, store).collect()}
    assert got == {"a": (4, 4, True), "b": (2, 1, False)}


def test_a_replayed_batch_writes_nothing_twice(spark, tmp_path):
    table, told = str(tmp_path / "t"), str(tmp_path / "r")
    one, two = bars(spark, [("a", k, 2, 3, 1, 2, 5) for k in range(3)]), bars(spark, [("a", 9, 2, 3, 1, 2, 5)])
    for batch, number in ((one, 0), (two, 1), (one, 0), (two, 1)):
        sinks.write_batch(batch, number, table, told, at="2024-01-02")
    assert sorted(r["batch"] for r in sinks.stored(spark, table, BARS).collect()) == [0, 0, 0, 1]
    assert sorted((r["run"], r["total_rows"]) for r in reports.read_reports(spark, told).collect()) == [("0", 3), ("1", 1)]


def test_micro_batches_are_bounded_and_a_restart_goes_on(spark, tmp_path):
    source, table, told, log = (str(tmp_path / n) for n in "strl")
    for k in range(5):
        bars(spark, [("a", k, 2, 3, 1, 2, 5)]).coalesce(1).write.mode("append").parquet(source)
    stream = sinks.limited(spark, source, BARS, files=2, pattern="*.parquet")
    sinks.start(stream, table, log, told, at="2024-01-02").awaitTermination()
    got = sinks.stored(spark, table, BARS)
    assert got.count() == 5 and max(r["count"] for r in got.groupBy("batch").count().collect()) <= 2
    bars(spark, [("a", 7, 2, 3, 1, 2, 5)]).coalesce(1).write.mode("append").parquet(source)
    sinks.start(sinks.limited(spark, source, BARS, files=2, pattern="*.parquet"), table, log, told, at="2024-01-02").awaitTermination()
    assert sinks.stored(spark, table, BARS).count() == 6 and reports.read_reports(spark, told).count() == 4


@pytest.fixture(scope="module")
def data(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(400, 2))
    return spark.createDataFrame([("ab"[k % 2], AT + dt.timedelta(hours=k // 2), 100 + float(rng.normal()), float(u), float(v), int(u + 0.5 * rng.normal() > 0)) for k, (u, v) in enumerate(x)], "symbol string, ts timestamp_ntz, close double, u double, v double, y int").cache()


def test_models_are_saved_promoted_and_read_back(spark, data, tmp_path):
    root = f"file://{tmp_path}/m"
    with pytest.raises(KeyError):
        ar.current(spark, root)
    made = ar.train(data, root, "v1", columns=["u", "v"], estimator=lambda: LogisticRegression(regParam=0.01), folds=2).first()
    model, manifest = ar.load(spark, root)
    assert manifest["version"] == "v1" == ar.current(spark, root) and manifest["features"] == ["u", "v"] and manifest["rows"] == 400 and manifest["first"] == AT and manifest["metrics"]["accuracy"] > 0.6
    assert made["metrics"] == manifest["metrics"] and manifest["params"]["regParam"] == "0.01" and manifest["name"] == "LogisticRegression"
    p = {(r["symbol"], r["ts"]): r["prediction"] for r in model.transform(data).collect()}
    assert np.mean([p[r["symbol"], r["ts"]] == r["y"] for r in data.collect()]) > 0.7
    with pytest.raises(Exception, match="exist"):  # a version is written once
        ar.train(data, root, "v1", columns=["u", "v"], estimator=lambda: LogisticRegression(regParam=0.02), folds=2)
    ar.train(data, root, "v2", columns=["u"], estimator=lambda: LogisticRegression(regParam=0.02), folds=2)
    assert ar.current(spark, root) == "v2" and {r["version"] for r in ar.versions(spark, root).collect()} == {"v1", "v2"}
    ar.promote(spark, root, "v1")
    again = {(r["symbol"], r["ts"]): r["prediction"] for r in ar.load(spark, root)[0].transform(data).collect()}
    assert again == p and ar.load(spark, root, "v2")[1]["features"] == ["u"]
    for bad in (lambda: ar.promote(spark, root, "v9"), lambda: ar.load(spark, root, "v9")):
        with pytest.raises(KeyError):
            bad()


def test_types_and_continuity(spark):
    texts = spark.createDataFrame([("a", AT + dt.timedelta(days=k), "2", "3", "1", "x" if k else "2", 5.0) for k in (0, 1, 8)], "symbol string, ts timestamp_ntz, open string, high string, low string, close string, volume double")
    got = {r["rule"]: (r["passed"], r["severity"], r["affected"]) for r in reports.validation_reports(texts, "2024-01-10", most_missing=2).first()["results"]}
    assert got["schema"] == (False, "critical", 4) and got["continuity"] == (False, "warning", 4)
    holidays = spark.createDataFrame([(dt.date(2024, 1, 3),), (dt.date(2024, 1, 4),)], "date date")
    out = reports.validation_reports(texts, "2024-01-10", most_missing=2, holidays=holidays).first()
    assert {r["rule"]: r["affected"] for r in out["results"]}["continuity"] == 0 and out["warnings"] == 0


def test_production_status(spark):
    from barloom.operators import production

    got = {r["feature"]: (r["status"], r["reason"]) for r in production.status(spark).collect()}
    assert sum(s == "production" for s, _ in got.values()) == 11 and sum(s == "excluded" and bool(why) for s, why in got.values()) == 6
