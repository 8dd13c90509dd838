"""Queries on allocation, with SQL for what rests on given weights."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barloom.operators import allocation, metrics, portfolio
from barloom.plans.registry import query, rounded
from barloom.plans.volatility_queries import PRICES, price_bars

C = F.col


@query(
    "risk_contributions",
    f"""WITH {PRICES}, c AS (SELECT a.symbol AS a, b.symbol AS b, 252 * covar_samp(a.ret, b.ret) AS c FROM ret a JOIN ret b USING (ts) GROUP BY 1, 2), n AS (SELECT count(DISTINCT symbol) AS n FROM ret),
w AS (SELECT DISTINCT symbol, 'equal' AS book, 1.0 / n AS w FROM ret, n UNION ALL SELECT a, 'inverse', 1 / sqrt(c) / (SELECT sum(1 / sqrt(c)) FROM c WHERE a = b) FROM c WHERE a = b),
m AS (SELECT book, a AS symbol, sum(w * c) AS m FROM w JOIN c ON w.symbol = c.b GROUP BY 1, 2), v AS (SELECT book, sum(w * m) AS v FROM w JOIN m USING (book, symbol) GROUP BY book)
SELECT book, symbol, round(w, 6) AS weight, round(m / sqrt(v), 6) AS marginal, round(w * m / sqrt(v), 6) AS contribution, round(w * m / v, 6) AS share FROM w JOIN m USING (book, symbol) JOIN v USING (book)""",
)
def risk_contributions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of equal weights, and of weights by the inverse deviation."""
    from pyspark.sql import Window

    cov = portfolio.covariances(metrics.returns(price_bars(spark, sf_dir)))
    own = cov.where("a = b").select(C("a").alias("symbol"), (1 / F.sqrt("cov")).alias("i"))
    every = Window.partitionBy(F.lit(0))  # a row for each symbol
    books = own.select(F.lit("equal").alias("book"), "symbol", (1 / F.count("*").over(every)).alias("weight")).unionByName(own.select(F.lit("inverse").alias("book"), "symbol", (C("i") / F.sum("i").over(every)).alias("weight")))
    return rounded(allocation.risk_contributions(books, cov, ["book"]))


@query("rolling_equal_risk")
def rolling_equal_risk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weights of equal risk on the 126 bars before, set every week: the row at which they are set, weights and the whole's return."""
    out = allocation.rebalanced(metrics.returns(price_bars(spark, sf_dir)), period="week")
    return out.select("ts", "set", F.round("shrinkage", 4).alias("shrinkage"), F.transform("weights", lambda w: F.round(w, 5)).alias("weights"), F.round("ret", 6).alias("ret"))


@query("rolling_mean_variance")
def rolling_mean_variance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As rolling_equal_risk, of the greatest Sharpe ratio."""
    out = allocation.rebalanced(metrics.returns(price_bars(spark, sf_dir)), "greatest_sharpe", period="week")
    return out.select("ts", "set", F.round("shrinkage", 4).alias("shrinkage"), F.transform("weights", lambda w: F.round(w, 4)).alias("weights"), F.round("ret", 5).alias("ret"))


@query("allocations")
def allocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Four allocations of all symbols side by side."""
    return rounded(allocation.compared(metrics.returns(price_bars(spark, sf_dir))), 4)
