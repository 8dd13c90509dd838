"""SQL for the queries on bars: independent formulas over the same tables."""

BARS = "bars AS (SELECT event_type AS symbol, date_trunc('hour', ts) AS ts, arg_min(value, ts) AS open, max(value) AS high, min(value) AS low, arg_max(value, ts) AS close, CAST(count(*) AS DOUBLE) AS volume FROM events GROUP BY 1, 2)"


def frame(n: int) -> str:
    return f"(PARTITION BY symbol ORDER BY ts ROWS {n - 1} PRECEDING)"


W = "(PARTITION BY symbol ORDER BY ts)"


def full(f: str, x: str, n: int) -> str:
    return f"CASE WHEN count({x}) OVER {frame(n)} = {n} THEN {f} OVER {frame(n)} END"


def lag(x: str, n: int = 1) -> str:
    return f"lag({x}, {n}) OVER {W}"


MOMENTUM = f"""WITH {BARS}, a AS (SELECT *, {', '.join(f'{lag("close", n)} AS l{n}' for n in (5, 10, 20, 21, 60, 120, 252))},
  {full('avg(close)', 'close', 50)} AS f, {full('avg(close)', 'close', 200)} AS s FROM bars),
b AS (SELECT *, CASE WHEN f > s THEN 1.0 WHEN s IS NOT NULL THEN 0.0 END AS bull FROM a)
SELECT symbol, ts, {', '.join(f'round(close / nullif(l{n}, 0) - 1, 6) AS mom_{n}d' for n in (5, 10, 20, 60, 120, 252))},
  round((l21 - l252) / nullif(l252, 0), 6) AS mom_12_1m, round(100 * (close / nullif(l10, 0) - 1), 6) AS roc_10, round(100 * (close / nullif(l20, 0) - 1), 6) AS roc_20,
  round((f - s) / nullif(s, 0), 6) AS sma_50_200_spread, CAST(bull AS DOUBLE) AS sma_50_200_bullish, CAST(coalesce(bull - {lag('bull')}, 0.0) AS DOUBLE) AS sma_50_200_cross FROM b"""

REVERSION = f"""WITH {BARS}, a AS (SELECT *, {', '.join(f'{full("avg(close)", "close", n)} AS m{n}, {full("stddev_samp(close)", "close", n)} AS d{n}' for n in (10, 20, 50))},
  {lag('close')} AS before, {full('min(low)', 'low', 14)} AS ll, {full('max(high)', 'high', 14)} AS hh FROM bars),
b AS (SELECT *, CASE WHEN hh = ll AND close = ll THEN 50.0 ELSE 100 * (close - ll) / nullif(hh - ll, 0) END AS fk, close - m20 AS x FROM a),
c AS (SELECT *, {full('avg(fk)', 'fk', 3)} AS sk, {lag('x')} AS x1 FROM b),
d AS (SELECT *, {full('avg(sk)', 'sk', 3)} AS sd, CASE WHEN count(x) OVER {frame(120)} = 120 THEN regr_slope(x - x1, x1) OVER {frame(119)} END AS beta, count(x) OVER {frame(120)} AS nx FROM c),
e AS (SELECT *, coalesce({lag('sk')} > {lag('sd')}, false) AS above, coalesce({lag('sk')} < {lag('sd')}, false) AS below FROM d)
SELECT symbol, ts, {', '.join(f'round(CASE WHEN d{n} = 0 AND close = m{n} THEN 0 ELSE (close - m{n}) / nullif(d{n}, 0) END, 6) AS zscore_{n}d' for n in (10, 20, 50))},
  round(m20, 6) AS bb_middle, round(m20 + 2 * d20, 6) AS bb_upper, round(m20 - 2 * d20, 6) AS bb_lower,
  round(CASE WHEN d20 = 0 AND close = m20 THEN 0.5 ELSE (close - m20 + 2 * d20) / nullif(4 * d20, 0) END, 6) AS bb_pct_b, round(4 * d20 / nullif(m20, 0), 6) AS bb_bandwidth,
  round(greatest(high - low, abs(high - before), abs(low - before)), 6) AS true_range,
  {', '.join(f'round(CASE WHEN d{n} = 0 AND close = m{n} THEN 0 ELSE (close - m{n}) / nullif(d{n}, 0) END, 6) AS ma_dist_std_{n}' for n in (20, 50))},
  round(CASE WHEN nx = 120 THEN least(CASE WHEN beta < 0 AND 1 + beta > 0 THEN ln(2) / -ln(1 + beta) ELSE 120 END, 120) END, 4) AS half_life_120,
  round(fk, 6) AS stoch_fast_k, round(sk, 6) AS stoch_slow_k, round(sd, 6) AS stoch_slow_d,
  CAST(CASE WHEN sk > sd AND NOT above AND sk < 25 THEN 1.0 WHEN sk < sd AND NOT below AND sk > 75 THEN -1.0 ELSE 0.0 END AS DOUBLE) AS stoch_signal FROM e"""

VOLUME = f"""WITH {BARS}, a AS (SELECT *, {lag('close')} AS before, {lag('volume', 10)} AS v10, (high + low + close) / 3 * volume AS pv,
  CASE WHEN high = low THEN 0 ELSE (2 * close - high - low) / (high - low) END * volume AS mf FROM bars),
b AS (SELECT *, coalesce(sign(close - before), 1) * volume AS step, 1e6 * abs(close / nullif(before, 0) - 1) / nullif(close * volume, 0) AS illiquid FROM a)
SELECT symbol, ts, sum(step) OVER {W} AS obv, round({full('sum(pv)', 'pv', 20)} / nullif({full('sum(volume)', 'volume', 20)}, 0), 6) AS vwap_20,
  round(sum(pv) OVER (PARTITION BY symbol, CAST(ts AS DATE) ORDER BY ts) / nullif(sum(volume) OVER (PARTITION BY symbol, CAST(ts AS DATE) ORDER BY ts), 0), 6) AS vwap_session,
  round(sum(mf) OVER {W}, 6) AS adl, round({full('sum(mf)', 'mf', 20)} / nullif({full('sum(volume)', 'volume', 20)}, 0), 6) AS cmf_20,
  round((volume - v10) / nullif(v10, 0), 6) AS volume_roc_10, round((volume - {full('avg(volume)', 'volume', 20)}) / nullif({full('stddev_samp(volume)', 'volume', 20)}, 0), 6) AS volume_z_20,
  round(illiquid, 4) AS amihud, round({full('avg(illiquid)', 'illiquid', 20)}, 4) AS amihud_20 FROM b"""

MICRO = f"""WITH {BARS}, a AS (SELECT *, CASE WHEN high > 0 AND low > 0 THEN ln(high / low) ^ 2 END AS hl2, CASE WHEN close > 0 AND open > 0 THEN ln(close / open) ^ 2 END AS co2,
  close - {lag('close')} AS dp, {full('max(high)', 'high', 2)} AS h2, {full('min(low)', 'low', 2)} AS l2,
  abs(2 * CASE WHEN high = low THEN 0.5 ELSE (close - low) / (high - low) END - 1) * volume AS imb FROM bars),
b AS (SELECT *, hl2 + {lag('hl2')} AS beta, CASE WHEN h2 > 0 AND l2 > 0 THEN ln(h2 / l2) ^ 2 END AS gamma, {lag('dp')} AS dp1, CASE WHEN 0.5 * hl2 - (2 * ln(2) - 1) * co2 IS NOT NULL THEN greatest(0, 0.5 * hl2 - (2 * ln(2) - 1) * co2) END AS gk FROM a),
c AS (SELECT *, (sqrt(2) - 1) * sqrt(beta) / (3 - 2 * sqrt(2)) - sqrt(gamma / (3 - 2 * sqrt(2))) AS alpha FROM b),
d AS (SELECT *, CASE WHEN alpha IS NOT NULL THEN greatest(0, 2 * (exp(alpha) - 1) / (1 + exp(alpha))) END AS cs, CASE WHEN count(dp1) OVER {frame(20)} = 20 THEN covar_samp(dp, dp1) OVER {frame(20)} END AS cov FROM c)
SELECT symbol, ts, round({full('avg(cs)', 'cs', 20)}, 6) AS cs_spread_20, round(CASE WHEN cov < 0 THEN 2 * sqrt(-cov) WHEN cov IS NOT NULL THEN 0 END / nullif(close, 0), 6) AS roll_spread_20,
  round({full('sum(imb)', 'imb', 20)} / nullif({full('sum(volume)', 'volume', 20)}, 0), 6) AS vpin_20, round(sqrt({full('avg(gk)', 'gk', 20)}) * sqrt(252), 6) AS gk_vol_20,
  round(sqrt({full('avg(hl2)', 'hl2', 20)} / (4 * ln(2))) * sqrt(252), 6) AS parkinson_vol_20 FROM d"""

BAR_FEATURES = f"""WITH {BARS}, a AS (SELECT *, {lag('close', 5)} AS l5, {full('avg(close)', 'close', 20)} AS m, {full('stddev_samp(close)', 'close', 20)} AS d FROM bars)
SELECT symbol, ts, round(close, 6) AS close, volume, round(close / nullif(l5, 0) - 1, 6) AS mom_5d, round(m, 6) AS bb_middle,
  round(CASE WHEN d = 0 AND close = m THEN 0 ELSE (close - m) / nullif(d, 0) END, 6) AS zscore_20d, round(CASE WHEN d = 0 AND close = m THEN 0.5 ELSE (close - m + 2 * d) / nullif(4 * d, 0) END, 6) AS bb_pct_b FROM a"""

CROSS = f"""WITH {BARS}, a AS (SELECT symbol, ts, ({lag('close', 21)} - {lag('close', 252)}) / nullif({lag('close', 252)}, 0) AS m FROM bars),
b AS (SELECT *, count(m) OVER (PARTITION BY ts) AS n, count(*) OVER (PARTITION BY ts, m) AS ties, rank() OVER (PARTITION BY ts, m IS NULL ORDER BY m) AS r FROM a)
SELECT symbol, ts, round(CASE WHEN m IS NOT NULL THEN (r + (ties - 1) / 2.0) / n END, 6) AS xs_momentum FROM b"""
