"""Queries on regimes, with SQL for filtering with given parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barloom.operators import regimes
from barloom.plans.bars_sql import W, frame, lag
from barloom.plans.registry import query, rounded
from barloom.plans.volatility_queries import PRICES, price_bars

C = F.col

_SPLIT = f"""{PRICES}, l AS (SELECT symbol, ts, ln(close / {lag('close')}) AS ret FROM bars), i AS (SELECT symbol, ts, ret, CASE WHEN count(ret) OVER {frame(20)} = 20 THEN stddev_samp(ret) OVER {frame(20)} * sqrt(252) END AS vol FROM l),
x AS (SELECT *, row_number() OVER {W} AS n, percent_rank() OVER (PARTITION BY symbol ORDER BY vol) >= 0.5 AS wild FROM i WHERE vol IS NOT NULL),
s AS (SELECT symbol, wild, avg(ret) AS a, avg(vol) AS b, var_pop(ret) AS p, var_pop(vol) AS q, covar_pop(ret, vol) AS c FROM x GROUP BY 1, 2),
d AS (SELECT symbol, ts, n, s.wild, exp(-((ret - a) ^ 2 * q - 2 * (ret - a) * (vol - b) * c + (vol - b) ^ 2 * p) / (2 * (p * q - c * c))) / sqrt(p * q - c * c) AS d FROM x JOIN s USING (symbol)),
e AS (SELECT symbol, ts, n, sum(d) FILTER (NOT wild) AS calm, sum(d) FILTER (wild) AS wild FROM d GROUP BY 1, 2, 3)"""


@query(
    "regime_filter",
    f"""WITH RECURSIVE {_SPLIT}, f AS (SELECT symbol, n, calm / (calm + wild) AS p FROM e WHERE n = 1
UNION ALL SELECT symbol, e.n, (0.95 * p + 0.1 * (1 - p)) * calm / ((0.95 * p + 0.1 * (1 - p)) * calm + (0.05 * p + 0.9 * (1 - p)) * wild) FROM f JOIN e USING (symbol) WHERE e.n = f.n + 1)
SELECT symbol, ts, CAST(CASE WHEN p >= 0.5 THEN 0 ELSE 1 END AS INTEGER) AS label, round(p, 6) AS calm FROM f JOIN e USING (symbol, n)""",
)
def regime_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Filtered probability of the calm of two states, whose means and covariances are those of the calmer and the wilder half of the rows."""
    from pyspark.sql import Window

    rows = regimes.inputs(price_bars(spark, sf_dir))
    half = rows.where("vol IS NOT NULL").withColumn("wild", F.percent_rank().over(Window.partitionBy("symbol").orderBy("vol")) >= 0.5)
    s = half.groupBy("symbol", "wild").agg(F.array(F.avg("ret"), F.avg("vol")).alias("m"), F.array(F.var_pop("ret"), F.covar_pop("ret", "vol"), F.covar_pop("ret", "vol"), F.var_pop("vol")).alias("v"))
    both = s.groupBy("symbol").agg(F.array_sort(F.collect_list(F.struct("wild", "m", "v"))).alias("s")).where("size(s) = 2")
    model = both.select("symbol", F.lit([0.5, 0.5]).alias("start"), F.lit([0.95, 0.05, 0.1, 0.9]).alias("trans"), F.flatten("s.m").alias("means"), F.flatten("s.v").alias("covs"))
    return rounded(regimes.decode(rows, model, smooth=False).select("symbol", "ts", "label", C("probs")[0].alias("calm")))


@query("regime_models")
def regime_models(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two-state models of both kinds for each symbol: log-likelihood, chance to stay, means, deviations and the share of bars in each state."""
    rows = regimes.inputs(price_bars(spark, sf_dir))
    out = []
    for method in ("hmm", "gmm"):
        models = regimes.fit(rows, 2, method)
        share = regimes.decode(rows, models).groupBy("symbol", C("label").alias("state")).agg(F.count("*").alias("bars"), F.avg(F.element_at("probs", C("label") + 1)).alias("sure"))
        states = models.where("start IS NOT NULL").select("symbol", "n", "loglik", F.explode(F.sequence(F.lit(0), F.lit(1))).alias("state"), "trans", "means", "covs")
        one = states.select(F.lit(method).alias("method"), "symbol", "n", "loglik", "state", C("trans")[C("state") * 3].alias("stays"), C("means")[C("state") * 2].alias("mean_ret"), C("means")[C("state") * 2 + 1].alias("mean_vol"), F.sqrt(C("covs")[C("state") * 4 + 3]).alias("dev_vol"))
        out.append(one.join(share, ["symbol", "state"], "left"))
    return rounded(out[0].unionByName(out[1]), 3)


@query("regime_features")
def regime_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Filtered regimes from refits every 20 bars on the 252 bars before."""
    return rounded(regimes.regime_features(price_bars(spark, sf_dir)), 4)
