"""Validation reports as nested JSON, a folder for each run, and the trends over them; raw bars moved into the bar store with a check of counts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barloom.operators.cleaning import missing_sessions
from barloom.sources.bars import BarStore

C = F.col
RESULT = "struct<rule:string,passed:boolean,severity:string,affected:bigint>"
REPORT = f"timestamp timestamp, symbol string, total_rows long, is_valid boolean, critical long, warnings long, results array<{RESULT}>"
PRICES = ["open", "high", "low", "close"]
#: Rules and what a failure counts as.
SEVERITY = {"schema": "critical", "range": "critical", "order": "critical", "freshness": "warning"}


def validation_reports(bars: DataFrame, at: str, *, now: str | None = None, most_age_days: int = 5, most_missing: int | None = None, holidays: DataFrame | None = None) -> DataFrame:
    """REPORT rows, one for each symbol of bars(symbol, ts, open, high, low, close, volume): columns without any value or that hold no numbers, values out of range, times that stand twice, and a last time more than
    most_age_days before `now` (at, if not given). The given times make runs repeat.

    With most_missing there is the rule continuity too: more weekdays than that, but for holidays(date), without a bar between a symbol's first and last."""
    texts = sum(t not in ("double", "float", "bigint", "int", "smallint", "tinyint") and not t.startswith("decimal") for c, t in bars.dtypes if c in (*PRICES, "volume"))
    bars = bars.withColumns({c: C(c).try_cast("double") for c in (*PRICES, "volume")})
    wrong = (F.least(*PRICES) <= 0) | (C("volume") < 0) | (C("high") < C("low")) | (C("high") < F.greatest("open", "close")) | (C("low") > F.least("open", "close"))
    sums = bars.groupBy("symbol").agg(
        F.count("*").alias("total_rows"),
        sum((F.when(F.count(c) == 0, 1).otherwise(0) for c in [*PRICES, "volume"]), F.lit(texts)).cast("long").alias("schema"),
        F.count_if(wrong).alias("range"),
        (F.count("ts") - F.count_distinct("ts")).alias("order"),
        F.when(F.datediff(F.lit(now or at).cast("date"), F.max(F.to_date("ts"))) > most_age_days, 1).otherwise(0).cast("long").alias("freshness"),
    )
    rules = dict(SEVERITY)
    if most_missing is not None:
        rules["continuity"] = "warning"
        gaps = missing_sessions(bars, holidays).groupBy("symbol").agg(F.count("*").alias("_gaps"))
        sums = sums.join(gaps, "symbol", "left").withColumn("continuity", F.when(C("_gaps") > most_missing, C("_gaps")).otherwise(0).cast("long"))
    results = F.array(*(F.struct(F.lit(r).alias("rule"), (C(r) == 0).alias("passed"), F.lit(s).alias("severity"), C(r).alias("affected")) for r, s in rules.items()))
    out = sums.withColumn("results", results)
    failed = lambda s: F.size(F.filter("results", lambda x: ~x["passed"] & (x["severity"] == s))).cast("long")
    out = out.withColumns({"critical": failed("critical"), "warnings": failed("warning")})
    return out.select(F.lit(at).cast("timestamp").alias("timestamp"), "symbol", "total_rows", (C("critical") == 0).alias("is_valid"), "critical", "warnings", "results")


def save_reports(reports: DataFrame, root: str, run: str) -> None:
    """Writes reports below root, in the folder of `run`; the same run written again replaces itself."""
    reports.write.mode("overwrite").json(f"{root}/run={run}")


def read_reports(spark: SparkSession, root: str) -> DataFrame:
    """REPORT rows of all runs, with run; lines that are no reports are left out."""
    return spark.read.schema(f"{REPORT}, run string").option("mode", "DROPMALFORMED").option("recursiveFileLookup", False).json(root).where("timestamp IS NOT NULL")


def report_trends(reports: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(by day: reports, valid ones, critical failures and warnings; by rule: reports that failed it, symbols, and rows affected)."""
    days = reports.groupBy(F.to_date("timestamp").alias("date")).agg(F.count("*").alias("reports"), F.count_if("is_valid").alias("valid"), F.sum("critical").alias("critical"), F.sum("warnings").alias("warnings"))
    each = reports.select("symbol", F.explode("results").alias("r")).where(~C("r.passed"))
    return days, each.groupBy(C("r.rule").alias("rule")).agg(F.count("*").alias("failures"), F.count_distinct("symbol").alias("symbols"), F.sum("r.affected").alias("affected"))


def migrate(raw: DataFrame, store: BarStore) -> DataFrame:
    """Writes raw(symbol, ts, ..) into the store and returns symbol, raw_rows, stored_rows and same, counted in the store itself. Of rows of one symbol and time one stays, so a count that differs
    tells of them."""
    store.save(raw, overwrite=False)
    before = raw.groupBy("symbol").agg(F.count("*").alias("raw_rows"))
    after = store.scan().groupBy("symbol").agg(F.count("*").alias("stored_rows"))
    out = before.join(after, "symbol", "left").withColumn("stored_rows", F.coalesce("stored_rows", F.lit(0).cast("long")))
    return out.withColumn("same", C("raw_rows") == C("stored_rows"))
