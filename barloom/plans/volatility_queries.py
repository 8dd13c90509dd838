"""Queries on conditional variance models, with SQL for what does not rest on a search for the greatest likelihood."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barloom.operators import metrics, volatility
from barloom.plans.analytics import RET
from barloom.plans.bars_sql import W
from barloom.plans.registry import query, rounded
from barloom.sources.bars import event_bars

C = F.col


def price_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bars whose close moves with a hundredth of the events' values, as values of events are no prices."""
    return event_bars(spark, sf_dir).withColumn("close", 100 + C("close") / 100)


def _returns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.returns(price_bars(spark, sf_dir))


def _usual(ret: DataFrame) -> DataFrame:
    """Parameters in the usual range, with the sample's mean and variance."""
    s = ret.groupBy("symbol").agg((100 * F.avg("ret")).alias("mu"), (10000 * F.var_pop("ret")).alias("v"))
    per = F.array(*(F.struct(F.lit(m).alias("model"), o.alias("omega"), F.lit(a).alias("alpha"), F.lit(g).alias("gamma"), F.lit(b).alias("beta")) for m, o, a, g, b in (
        ("garch", 0.05 * C("v"), 0.08, 0.0, 0.87), ("gjr", 0.05 * C("v"), 0.04, 0.08, 0.87), ("egarch", 0.1 * F.log("v"), 0.15, -0.05, 0.9))))
    return s.withColumn("p", F.explode(per)).select("symbol", "mu", "p.*")


PRICES = RET.replace("arg_max(value, ts) AS close", "100 + arg_max(value, ts) / 100 AS close")
_PATHS = f"""{PRICES}, m AS (SELECT symbol, 100 * avg(ret) AS mu, 10000 * var_pop(ret) AS v FROM ret GROUP BY symbol),
e AS (SELECT symbol, ts, 100 * ret - mu AS e, row_number() OVER {W} AS n FROM ret JOIN m USING (symbol)),
b AS (SELECT symbol, sum(0.94 ^ (n - 1) * e * e) / sum(0.94 ^ (n - 1)) AS b FROM e WHERE n <= 75 GROUP BY symbol),
v AS (SELECT symbol, 'garch' AS model, 1 AS n, 0.05 * v + 0.95 * b AS v FROM m JOIN b USING (symbol) UNION ALL SELECT symbol, 'gjr', 1, 0.05 * v + 0.95 * b FROM m JOIN b USING (symbol)
  UNION ALL SELECT symbol, 'egarch', 1, exp(0.1 * ln(v) + 0.9 * ln(b)) FROM m JOIN b USING (symbol)
  UNION ALL SELECT symbol, model, n + 1, CASE model WHEN 'garch' THEN 0.05 * m.v + 0.08 * e * e + 0.87 * v.v WHEN 'gjr' THEN 0.05 * m.v + CASE WHEN e < 0 THEN 0.12 ELSE 0.04 END * e * e + 0.87 * v.v
    ELSE exp(0.1 * ln(m.v) + 0.15 * (abs(e / sqrt(v.v)) - sqrt(2 / pi())) - 0.05 * e / sqrt(v.v) + 0.9 * ln(v.v)) END FROM v JOIN e USING (symbol, n) JOIN m USING (symbol))"""


@query("conditional_volatility", f"WITH RECURSIVE {_PATHS} SELECT symbol, model, ts, round(sqrt(v) / 100, 6) AS vol, round(e / sqrt(v), 6) AS z FROM v JOIN e USING (symbol, n)")
def conditional_volatility(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The three recursions over all bars with parameters in the usual range."""
    ret = _returns(spark, sf_dir)
    return rounded(volatility.filtered(ret, _usual(ret)))


def _below(x: str) -> str:
    t = f"(1 / (1 + 0.3275911 * abs({x}) / sqrt(2)))"
    tail = f"(((((1.061405429 * {t} - 1.453152027) * {t} + 1.421413741) * {t} - 0.284496736) * {t} + 0.254829592) * {t} * exp(-({x}) * ({x}) / 2) / 2)"
    return f"CASE WHEN {x} < 0 THEN {tail} ELSE 1 - {tail} END"


def _moment(k: int) -> str:
    b, up, down = 0.9**k, 0.9**k * 0.1, 0.9**k * 0.2
    return f"ln(exp({up * up / 2!r}) * ({_below(repr(up))}) + exp({down * down / 2!r}) * ({_below(repr(down))})) - {b * 0.15!r} * sqrt(2 / pi()) + {b!r} * 0.1 * ln(m.v)"


@query(
    "volatility_forecasts",
    f"""WITH RECURSIVE {_PATHS}, last AS (SELECT symbol, model, arg_max(v, n) AS x FROM v GROUP BY 1, 2), h AS (SELECT CAST(unnest(range(1, 6)) AS INTEGER) AS h),
f AS (SELECT symbol, model, h, CASE WHEN model = 'egarch' THEN exp(0.9 ^ (h - 1) * ln(x) + {' + '.join(f'CASE WHEN h > {k + 1} THEN {_moment(k)} ELSE 0 END' for k in range(4))}) ELSE 0.95 ^ (h - 1) * x + m.v * (1 - 0.95 ^ (h - 1)) END AS f FROM last JOIN m USING (symbol), h)
SELECT symbol, model, h, round(sqrt(f) / 100, 6) AS vol FROM f""",
)
def volatility_forecasts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Deviations expected one to five bars after the last, with parameters in the usual range."""
    ret = _returns(spark, sf_dir)
    params = _usual(ret)
    ends = volatility.filtered(ret, params).groupBy("symbol", "model").agg(F.max_by(F.struct("vol", "z"), "ts").alias("s")).select("symbol", "model", (F.pow(C("s.vol") * 100, 2)).alias("v"), (C("s.z") * C("s.vol") * 100).alias("e"))
    state = params.join(ends, ["symbol", "model"]).withColumn("next_variance", volatility.next_variance(C("model"), C("v"), C("e"), C("omega"), C("alpha"), C("gamma"), C("beta")))
    return rounded(volatility.forecast(state))


@query("volatility_models")
def volatility_models(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fits of the three models to each symbol, the criteria, whether their standardised deviations still cluster, and which is chosen."""
    ret = _returns(spark, sf_dir)
    fits = volatility.fit(ret)
    left = volatility.leftover_effects(volatility.filtered(ret, fits)).select("symbol", "model", F.col("p_value").alias("leftover_p"), "remaining")
    best = volatility.select(fits).select("symbol", F.col("model").alias("best"))
    out = fits.join(left, ["symbol", "model"], "left").join(best, "symbol").withColumn("chosen", F.col("model") == F.col("best"))
    return rounded(out.drop("best"), 3)


@query("garch_features")
def garch_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Forecasts of refits every 20 bars on the 252 bars before."""
    return rounded(volatility.garch_features(price_bars(spark, sf_dir)), 4)
