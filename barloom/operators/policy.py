"""Policies over the results of checks, their counts and history, and short summaries of tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barloom.operators.cleaning import PRICES, validate

C = F.col
BLOCK, WARN, IGNORE = "block", "warn", "ignore"
_DEFAULT = {"critical": BLOCK, "warning": WARN, "info": IGNORE}


class DataBlocked(ValueError):
    """A check failed under the policy BLOCK; `report` has the results."""

    def __init__(self, message: str, report: DataFrame):
        super().__init__(message)
        self.report = report


def apply(results: DataFrame, policies: dict[str, str] | None = None) -> DataFrame:
    """results(rule, passed, severity, affected) with policy: the one given for a rule sets its severity (block: critical, warn: warning; ignored rules are
    left out), else the severity tells it."""
    given = F.lit(None).cast("string")
    for rule, policy in (policies or {}).items():
        if policy not in (BLOCK, WARN, IGNORE):
            raise ValueError(f"no such policy: {policy}")
        given = F.when(C("rule") == rule, policy).otherwise(given)
    out = results.withColumn("policy", given).where(f"policy is null or policy <> '{IGNORE}'")
    severity = F.when(C("policy") == BLOCK, "critical").when(C("policy") == WARN, "warning").otherwise(C("severity"))
    out = out.withColumn("severity", severity)
    default = F.create_map(*[F.lit(x) for pair in _DEFAULT.items() for x in pair])
    return out.withColumn("policy", F.coalesce("policy", default[C("severity")]))


def checked(bars: DataFrame, now: str, policies: dict[str, str] | None = None) -> DataFrame:
    """bars, if no check fails under BLOCK; else raises DataBlocked with the report (a row for each rule)."""
    report = apply(validate(bars, now), policies)
    failed = [r["rule"] for r in report.where((~C("passed")) & (C("policy") == BLOCK)).select("rule").collect()]
    if failed:
        raise DataBlocked(f"checks failed: {', '.join(sorted(failed))}", report)
    return bars


def counts(results: DataFrame, keys: list[str]) -> DataFrame:
    """keys, n_passed, n_failed, n_critical, n_warning, n_info (failures by severity) and is_valid (no critical failure)."""
    bad = ~C("passed")
    by = [F.count_if(bad & (C("severity") == s)).alias(f"n_{s}") for s in ("critical", "warning", "info")]
    return results.groupBy(*keys).agg(F.count_if("passed").alias("n_passed"), F.count_if(bad).alias("n_failed"), *by).withColumn("is_valid", C("n_critical") == 0)


def trends(history: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(reports, failures) of history(ts, symbol, rule, passed, severity): the counts of each report, and how often each rule failed."""
    return counts(history, ["ts", "symbol"]), history.where(~C("passed")).groupBy("rule").agg(F.count("*").alias("n"), F.countDistinct("symbol").alias("n_symbols"))


def summary(bars: DataFrame) -> DataFrame:
    """symbol, n, first, last (dates), duplicates (rows beyond one of a time), negatives (prices and volumes) and issues in words, or none."""
    low = F.least(*PRICES)
    own = bars.groupBy("symbol").agg(
        F.count("*").alias("n"), F.to_date(F.min("ts")).alias("first"), F.to_date(F.max("ts")).alias("last"), (F.count("ts") - F.countDistinct("ts")).alias("duplicates"), F.count_if((low < 0) | (C("volume") < 0)).alias("negatives")
    )
    text = lambda c: F.when(C(c) > 0, F.concat(C(c).cast("string"), F.lit(f" {c}")))
    return own.withColumn("issues", F.coalesce(F.nullif(F.concat_ws("; ", text("duplicates"), text("negatives")), F.lit("")), F.lit("none")))
