"""Queries on unit roots and cointegration, with SQL for given numbers of lags."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barloom.operators import cointegration, joins
from barloom.plans.bars_sql import BARS
from barloom.plans.registry import query, rounded
from barloom.plans.volatility_queries import price_bars

C = F.col

_PAIRS = f"""{BARS.replace("arg_max(value, ts) AS close", "100 + arg_max(value, ts) / 100 AS close")}, p AS (SELECT a.symbol AS a, b.symbol AS b, ts, a.close AS u, b.close AS v, row_number() OVER (PARTITION BY a.symbol, b.symbol ORDER BY ts) AS n FROM bars a JOIN bars b USING (ts) WHERE a.symbol < b.symbol)"""
_V = "d1 d2 z1 z2 l1 l2".split()
_COV = ", ".join(f"covar_pop({x}, {y}) AS {x}{y}" for i, x in enumerate(_V) for y in _V[i:])


def _rest(x: str, y: str) -> str:
    """Covariance of two variables less what z1 and z2 explain."""
    c = lambda p, q: p + q if _V.index(p) <= _V.index(q) else q + p
    a1, a2, b1, b2 = c(x, "z1"), c(x, "z2"), c(y, "z1"), c(y, "z2")
    return f"{c(x, y)} - ({a1} * ({b1} * z2z2 - {b2} * z1z2) + {a2} * ({b2} * z1z1 - {b1} * z1z2)) / (z1z1 * z2z2 - z1z2 * z1z2)"


_RESTS = ", ".join(f"{_rest(x, y)} AS r{x}{y}" for x, y in (("d1", "d1"), ("d1", "d2"), ("d2", "d2"), ("l1", "l1"), ("l1", "l2"), ("l2", "l2"), ("d1", "l1"), ("d1", "l2"), ("d2", "l1"), ("d2", "l2")))


@query(
    "johansen_pairs",
    f"""WITH {_PAIRS}, d AS (SELECT *, u - lag(u) OVER w AS d1, v - lag(v) OVER w AS d2, lag(u) OVER w AS l1, lag(v) OVER w AS l2 FROM p WINDOW w AS (PARTITION BY a, b ORDER BY n)),
z AS (SELECT *, lag(d1) OVER w AS z1, lag(d2) OVER w AS z2 FROM d WINDOW w AS (PARTITION BY a, b ORDER BY n)), c AS (SELECT a, b, count(*) AS t, {_COV} FROM z WHERE z1 IS NOT NULL GROUP BY a, b), r AS (SELECT a, b, t, {_RESTS} FROM c),
m AS (SELECT a, b, t, rl1l1 * rl2l2 - rl1l2 ^ 2 AS dl, rd1d1 * rd2d2 - rd1d2 ^ 2 AS dd, rd1l1 * rd2l2 - rd1l2 * rd2l1 AS dx,
  rl2l2 * (rd2d2 * rd1l1 ^ 2 - 2 * rd1d2 * rd1l1 * rd2l1 + rd1d1 * rd2l1 ^ 2) - 2 * rl1l2 * (rd2d2 * rd1l1 * rd1l2 - rd1d2 * (rd1l1 * rd2l2 + rd2l1 * rd1l2) + rd1d1 * rd2l1 * rd2l2) + rl1l1 * (rd2d2 * rd1l2 ^ 2 - 2 * rd1d2 * rd1l2 * rd2l2 + rd1d1 * rd2l2 ^ 2) AS tr FROM r),
e AS (SELECT a, b, t, tr / (dl * dd) AS s, dx ^ 2 / (dl * dd) AS p FROM m), g AS (SELECT a, b, t, (s + sqrt(greatest(s * s - 4 * p, 0))) / 2 AS g1, (s - sqrt(greatest(s * s - 4 * p, 0))) / 2 AS g2 FROM e),
n AS (SELECT a, b, count(*) AS n FROM p GROUP BY a, b)
SELECT a, b, n, round(-t * (ln(1 - g1) + ln(1 - g2)), 4) AS trace_0, round(-t * ln(1 - g2), 4) AS trace_1, round(-t * ln(1 - g1), 4) AS largest_0, -t * (ln(1 - g1) + ln(1 - g2)) > 15.4943 AND -t * ln(1 - g1) > 14.2639 AS cointegrated FROM g JOIN n USING (a, b)""",
)
def johansen_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Johansen's statistics of every pair over the times that both have, with one lagged change."""
    rows = joins.pairs(price_bars(spark, sf_dir), "close")
    out = cointegration.johansen(rows, ["a", "b"], ["x", "y"])
    return rounded(out.select("a", "b", "n", C("trace")[0].alias("trace_0"), C("trace")[1].alias("trace_1"), C("largest")[0].alias("largest_0"), "cointegrated"), 4)


@query(
    "engle_granger",
    f"""WITH {_PAIRS}, o AS (SELECT a, b, regr_slope(u, v) AS beta, regr_intercept(u, v) AS alpha FROM p GROUP BY a, b), e AS (SELECT a, b, n, u - beta * v - alpha AS e FROM p JOIN o USING (a, b)),
d AS (SELECT *, lag(e) OVER w AS e1, e - lag(e) OVER w AS d FROM e WINDOW w AS (PARTITION BY a, b ORDER BY n)), l AS (SELECT *, lag(d) OVER (PARTITION BY a, b ORDER BY n) AS d1 FROM d),
h AS (SELECT a, b, count(*) AS n, regr_slope(d, e1) AS h FROM d GROUP BY a, b),
s AS (SELECT a, b, count(*) AS m, sum(e1 * e1) AS xx, sum(e1 * d1) AS xz, sum(d1 * d1) AS zz, sum(e1 * d) AS xy, sum(d1 * d) AS zy, sum(d * d) AS yy FROM l WHERE d1 IS NOT NULL GROUP BY a, b),
c AS (SELECT *, xx * zz - xz * xz AS det, (xy * zz - zy * xz) / (xx * zz - xz * xz) AS b1, (zy * xx - xy * xz) / (xx * zz - xz * xz) AS b2 FROM s)
SELECT a AS y, b AS x, h.n, round(beta, 4) AS hedge_ratio, round(alpha, 4) AS intercept, round(b1 / sqrt((yy - b1 * xy - b2 * zy) / (m - 2) * zz / det), 4) AS statistic, round(-3.33613 - 6.1101 / (h.n - 1) - 6.823 / (h.n - 1) ^ 2, 4) AS crit_5, round(CASE WHEN h < 0 AND h > -1 THEN ln(2) / -ln(1 + h) ELSE 'inf'::DOUBLE END, 4) AS half_life FROM c JOIN o USING (a, b) JOIN h USING (a, b)""",
)
def engle_granger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The residuals' unit-root test of every pair with one lag, and the half-life of the spread."""
    out = cointegration.screen_pairs(price_bars(spark, sf_dir), lags=1)
    return rounded(out.select("y", "x", "n", "hedge_ratio", "intercept", "statistic", "crit_5", "half_life"), 4)


@query("pair_screening")
def pair_screening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pairs with the lags that Akaike's criterion chooses, and the verdict."""
    return rounded(cointegration.screen_pairs(price_bars(spark, sf_dir)), 4)


@query("unit_roots")
def unit_roots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both unit-root tests of every symbol's prices, with their choice of lags, p-values and the verdict."""
    return rounded(cointegration.unit_roots(price_bars(spark, sf_dir)), 4)
