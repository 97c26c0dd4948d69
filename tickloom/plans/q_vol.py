"""Queries: volatility and statistics features."""
from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import volatility as vol
from ..operators.layout import in_chunks
from .catalog import query
from .data import BARS, BARS_REC, bars
from .q_windows import ema_step, scan_sql

RET = """ret AS (SELECT *, coalesce(close / lag(close) OVER (PARTITION BY symbol ORDER BY bar_no) - 1, 0) AS ret FROM bars)"""


def win(n: int) -> str:
    return f"OVER (PARTITION BY symbol ORDER BY bar_no ROWS {n - 1} PRECEDING)"


def lagw(x: str, k: int = 1) -> str:
    return f"lag({x}, {k}) OVER (PARTITION BY symbol ORDER BY bar_no)"


def need(x: str, n: int, least: int, expr: str) -> str:
    return f"CASE WHEN count({x}) {win(n)} >= {least} THEN {expr} {win(n)} END"


REALISED = RET + f""", lg AS (
  SELECT *, coalesce(ln(high / low), 0) AS hl, coalesce(ln(close / open), 0) AS co FROM ret),
est AS (SELECT *, sqrt(hl * hl / (4 * ln(2))) AS pk, sqrt(greatest(0.5 * hl * hl - (2 * ln(2) - 1) * co * co, 0)) AS gk FROM lg),
rv AS (SELECT *, coalesce({need('ret', 10, 2, 'stddev_samp(ret)')}, 0) AS pa_rv_cc_10, coalesce({need('ret', 20, 2, 'stddev_samp(ret)')}, 0) AS pa_rv_cc_20,
  coalesce({need('pk', 20, 2, 'avg(pk)')}, 0) AS pa_rv_parkinson_20, coalesce({need('gk', 20, 2, 'avg(gk)')}, 0) AS pa_rv_gk_20 FROM est)"""


def realised_bars(T):
    return in_chunks(bars(T), vol.realised, history=vol.HISTORY["realised"])


@query("vol_realised", "symbol:s bar_no:i pa_rv_cc_10:d pa_rv_cc_20:d pa_rv_parkinson_20:d pa_rv_gk_20:d pa_vol_term_slope:d "
       "pa_vol_estimator_ratio:d pa_vol_of_vol_20:d pa_vol_momentum:d", BARS + ", " + REALISED + f"""
SELECT *, pa_rv_cc_10 - pa_rv_cc_20 AS pa_vol_term_slope, pa_rv_gk_20 / (pa_rv_cc_20 + 1e-8) AS pa_vol_estimator_ratio,
  coalesce(stddev_samp(pa_rv_cc_20) {win(20)}, 0) AS pa_vol_of_vol_20, coalesce(pa_rv_cc_20 - {lagw('pa_rv_cc_20', 5)}, 0) AS pa_vol_momentum FROM rv""")
def _(T):
    return realised_bars(T)


Z60 = "({0} - " + need("{0}", 60, 20, "avg({0})") + ") / (" + need("{0}", 60, 20, "stddev_samp({0})") + " + 1e-8)"


@query("vol_straddle", "symbol:s bar_no:i pa_iv_rv_spread:d rv_iv_spread_z_60:d pa_rv_zscore:d pa_rv_acceleration:d vol_momentum_diff_60:d "
       "rv_iv_ratio_change_60:d pa_bb_width_pctile:d pa_atr_ratio_5_20:d pa_rv_term_slope:d pa_vol_regime_duration:d "
       "pa_realized_vs_expected:d pa_volume_zscore:d pa_volume_price_corr:d", BARS + ", " + REALISED + f""", s1 AS (
  SELECT *, (high + low + close) / 3 AS tp, high - low AS rng, pa_rv_cc_20 / (pa_rv_parkinson_20 + 1e-8) AS ratio, pa_rv_cc_20 - {lagw('pa_rv_cc_20', 5)} AS d5,
    coalesce({need('ret', 60, 10, 'stddev_samp(ret)')}, 0) AS rv60,
    coalesce((pa_rv_cc_20 > CASE WHEN bar_no >= 9 THEN quantile_cont(pa_rv_cc_20, 0.5) {win(60)} END)::int, 0) AS hi,
    coalesce(CASE WHEN bar_no >= 4 AND stddev_pop(volume) {win(20)} > 0 AND stddev_pop(ret) {win(20)} > 0 THEN corr(ret, volume) {win(20)} END, 0) AS c20 FROM rv),
s2 AS (SELECT *, coalesce({need('tp', 20, 5, '4 * stddev_samp(tp)')} / ({need('tp', 20, 5, 'avg(tp)')} + 1e-8), 0) AS bb,
    coalesce((hi <> {lagw('hi')})::int, 1) AS chg,
    (pa_rv_cc_20 - {lagw('pa_rv_cc_20', 30)}) / nullif({lagw('pa_rv_cc_20', 30)}, 0) AS m1,
    (pa_rv_parkinson_20 - {lagw('pa_rv_parkinson_20', 30)}) / nullif({lagw('pa_rv_parkinson_20', 30)}, 0) AS m2 FROM s1),
s3 AS (SELECT *, list(bb) {win(120)} AS bbs, sum(chg) OVER (PARTITION BY symbol ORDER BY bar_no) AS isl FROM s2)
SELECT symbol, bar_no, least(greatest((pa_rv_parkinson_20 - pa_rv_cc_20) / (pa_rv_cc_20 + 1e-8), -5), 5) AS pa_iv_rv_spread,
  least(greatest(coalesce({Z60.format('pa_rv_cc_20')} - {Z60.format('pa_rv_parkinson_20')}, 0), -8), 8) AS rv_iv_spread_z_60,
  coalesce((pa_rv_cc_20 - {need('pa_rv_cc_20', 120, 20, 'avg(pa_rv_cc_20)')}) / (nullif({need('pa_rv_cc_20', 120, 20, 'stddev_samp(pa_rv_cc_20)')}, 0) + 1e-8), 0) AS pa_rv_zscore,
  coalesce(d5 - {lagw('d5', 5)}, 0) AS pa_rv_acceleration, least(greatest(coalesce(m1 - m2, 0), -5), 5) AS vol_momentum_diff_60,
  least(greatest(coalesce((ratio - {lagw('ratio', 15)}) / nullif({lagw('ratio', 15)}, 0), 0), -5), 5) AS rv_iv_ratio_change_60,
  CASE WHEN bar_no >= 19 THEN len(list_filter(bbs, lambda v: v <= bb)) / len(bbs) ELSE 0.5 END AS pa_bb_width_pctile,
  least(greatest(avg(rng) {win(5)} / (avg(rng) {win(20)} + 1e-8), 0), 5) AS pa_atr_ratio_5_20, pa_rv_cc_10 - rv60 AS pa_rv_term_slope,
  least(row_number() OVER (PARTITION BY symbol, isl ORDER BY bar_no) / 200.0, 1) AS pa_vol_regime_duration,
  least(greatest(sum(rng) {win(10)} / (10 * avg(rng) {win(10)} + 1e-8), 0), 10) AS pa_realized_vs_expected,
  least(greatest(coalesce((volume - {need('volume', 60, 10, 'avg(volume)')}) / (nullif({need('volume', 60, 10, 'stddev_samp(volume)')}, 0) + 1e-8), 0), -6), 6) AS pa_volume_zscore,
  least(greatest(coalesce(c20 - {lagw('c20', 5)}, 0), -2), 2) AS pa_volume_price_corr FROM s3""")
def _(T):
    d = in_chunks(bars(T), lambda x, f: vol.straddle(vol.realised(x, f), f), history=vol.HISTORY["straddle"])
    return vol.straddle_duration(d)


def _annual(name: str, x: str, n: int, least: int, expr: str) -> str:
    return f"coalesce({need(x, n, least, expr)}, 0) AS {name}"


ANNUAL_COLS = [f"rv_{n}" for n in (5, 15, 30, 60, 120, 390)] + [f"parkinson_vol_{n}" for n in (15, 30, 60, 390)] + \
    [f"gk_vol_{n}" for n in (30, 60, 390)] + [f"abs_return_{n}" for n in (5, 15, 30, 60)]
ANNUAL = f"""a0 AS (SELECT *, {lagw('close')} AS pc FROM bars),
a1 AS (SELECT *, ln(close / pc) AS lr, power(ln(high / low), 2) / (4 * ln(2)) AS hl2,
    0.5 * power(ln(high / open) - ln(low / open), 2) - (2 * ln(2) - 1) * power(ln(close / open), 2) AS gkv, abs(close - pc) AS am FROM a0),
a2 AS (SELECT *, {', '.join(need('lr', n, max(3, n // 3), 'sqrt(252.0 * 390) * stddev_samp(lr)') + f' AS r{n}' for n in (5, 15, 30, 60, 120, 390))},
  {', '.join('sqrt(' + need('hl2', n, max(5, n // 3), 'avg(hl2)') + f') * sqrt(252.0 * 390) AS p{n}' for n in (15, 30, 60, 390))},
  {', '.join('CASE WHEN bar_no >= ' + str(max(5, n // 3) - 1) + ' THEN sqrt(greatest(avg(gkv) ' + win(n) + f', 0)) * sqrt(252.0 * 390) END AS g{n}' for n in (30, 60, 390))},
  CASE WHEN count(volume) {win(390)} >= 20 THEN (volume - avg(volume) {win(390)}) / nullif(stddev_samp(volume) {win(390)}, 0) END AS vz,
  CASE WHEN bar_no >= 29 THEN max(high) {win(390)} - min(low) {win(390)} END AS spread FROM a1),
annual AS (SELECT *, {', '.join(f'coalesce(r{n}, 0) AS rv_{n}' for n in (5, 15, 30, 60, 120, 390))}, {', '.join(f'coalesce(p{n}, 0) AS parkinson_vol_{n}' for n in (15, 30, 60, 390))},
  {', '.join(f'coalesce(g{n}, 0) AS gk_vol_{n}' for n in (30, 60, 390))},
  {', '.join(f'coalesce(abs(close / {lagw("close", n)} - 1), 0) AS abs_return_{n}' for n in (5, 15, 30, 60))},
  coalesce(r30 - {lagw('r30', 30)}, 0) AS rv_acceleration, coalesce({need('r30', 60, 10, 'stddev_samp(r30)')}, 0) AS vol_of_vol,
  coalesce(spread, 0) AS intraday_range, coalesce(spread / close, 0) AS range_vs_close, coalesce(vz, 0) AS volume_zscore, coalesce((vz > 2)::int, 0) AS volume_spike,
  coalesce(abs(close - {lagw('close', 30)}) / nullif({need('am', 30, 5, 'sum(am)')}, 0), 0) AS efficiency_ratio,
  (hour(t) = 9 AND minute(t) = 30)::int AS is_open, CASE WHEN hour(t) = 9 AND minute(t) = 30 THEN coalesce((open - pc) / pc, 0) ELSE 0 END AS gap,
  hour(t) * 60 + minute(t) AS minute_of_day, isodow(t) - 1 AS day_of_week FROM a2)"""


@query("vol_annualised", "symbol:s bar_no:i " + " ".join(f"{n}:d" for n in ANNUAL_COLS) + " rv_acceleration:d vol_of_vol:d intraday_range:d "
       "range_vs_close:d volume_zscore:d volume_spike:i efficiency_ratio:d is_open:i gap:d minute_of_day:i day_of_week:i",
       BARS + ", " + ANNUAL + " SELECT * FROM annual")
def _(T):
    return in_chunks(bars(T), vol.annualised, history=vol.HISTORY["annualised"])


@query("vol_moments", "symbol:s bar_no:i pa_realized_skew_20:d pa_realized_kurt_20:d pa_skew_change_10:d", BARS + ", " + RET + f""", m AS (
  SELECT *, coalesce(CASE WHEN bar_no >= 4 THEN skewness(ret) {win(20)} END, 0) AS sk, coalesce(CASE WHEN bar_no >= 4 THEN kurtosis(ret) {win(20)} END, 0) AS ku FROM ret)
SELECT symbol, bar_no, sk AS pa_realized_skew_20, ku AS pa_realized_kurt_20, coalesce(sk - {lagw('sk', 10)}, 0) AS pa_skew_change_10 FROM m""")
def _(T):
    return in_chunks(bars(T), vol.moments, history=vol.HISTORY["moments"])


@query("vol_volume_price", "symbol:s bar_no:i pa_vwap_deviation:d pa_vol_price_diverge:d pa_volume_acceleration:d pa_amihud_illiq_20:d pa_obv_slope_10:d",
       BARS + ", " + RET + f""", v AS (
  SELECT *, (high + low + close) / 3 AS tp, abs(ret) / (volume + 1e-8) AS ill, sum(volume * sign(ret)) OVER (PARTITION BY symbol ORDER BY bar_no) AS obv FROM ret),
w AS (SELECT *, sum(tp * volume) OVER d / (sum(volume) OVER d + 1e-8) AS vwap FROM v WINDOW d AS (PARTITION BY symbol, cast(t AS date) ORDER BY bar_no))
SELECT symbol, bar_no, (close - vwap) / (vwap + 1e-8) AS pa_vwap_deviation,
  coalesce(CASE WHEN bar_no >= 4 AND stddev_pop(volume) {win(20)} > 0 AND stddev_pop(ret) {win(20)} > 0 THEN corr(ret, volume) {win(20)} END, 0) AS pa_vol_price_diverge,
  coalesce((volume - {lagw('volume')}) / (avg(volume) {win(10)} + 1e-8), 0) AS pa_volume_acceleration,
  coalesce({need('ill', 20, 2, 'avg(ill)')}, 0) AS pa_amihud_illiq_20, coalesce(obv - {lagw('obv', 10)}, 0) AS pa_obv_slope_10 FROM w""")
def _(T):
    return vol.vwap_deviation(in_chunks(bars(T), vol.volume_price, history=vol.HISTORY["volume_price"]))


@query("vol_day_clock", "symbol:s bar_no:i pa_time_session_progress:d pa_time_from_open_return:d pa_time_vol_time_deviation:d", BARS + """
SELECT symbol, bar_no, least(greatest((epoch(t) - epoch(date_trunc('day', t)) - 570 * 60) / 60.0 / 390, 0), 1) AS pa_time_session_progress,
  (close - first(open) OVER d) / (first(open) OVER d + 1e-8) AS pa_time_from_open_return, volume - avg(volume) OVER d AS pa_time_vol_time_deviation
FROM bars WINDOW d AS (PARTITION BY symbol, cast(t AS date) ORDER BY bar_no ROWS UNBOUNDED PRECEDING)""")
def _(T):
    return vol.day_clock(bars(T))


@query("vol_trend_noise", "symbol:s bar_no:i pa_trend_ratio:d pa_noise_ratio:d pa_trend_slope:d", scan_sql(
    BARS_REC + ", src AS MATERIALIZED (SELECT * FROM bars)", {"e": "r.close", "x": "r.close"},
    {"e": ema_step("e", "r.close", "(2.0::double / 21)"), "x": "r.close"}) + f""", v AS (SELECT *, abs(e - {lagw('e')}) AS tv0, abs(x - e) AS nv0 FROM scan),
w AS (SELECT *, {need('tv0', 20, 2, 'avg(tv0)')} AS tv, {need('nv0', 20, 2, 'avg(nv0)')} AS nv FROM v)
SELECT symbol, bar_no, coalesce(tv / (nv + 1e-8), 0) AS pa_trend_ratio, coalesce(nv / (tv + nv + 1e-8), 0) AS pa_noise_ratio,
  coalesce(e - {lagw('e', 5)}, 0) AS pa_trend_slope FROM w""")
def _(T):
    return in_chunks(bars(T), vol.trend_noise, history=vol.HISTORY["trend_noise"])


@query("vol_jumps", "symbol:s bar_no:i pa_hawkes_intensity:d pa_hawkes_clustering_20:i", scan_sql(
    BARS_REC + ", " + RET + f""", j AS (SELECT *, greatest(coalesce({need('ret', 20, 2, 'stddev_samp(abs(ret))')}, 0.001), 1e-5) AS sd FROM ret),
  src AS MATERIALIZED (SELECT *, CASE WHEN abs(ret) > 3 * sd THEN abs(ret) ELSE 0 END AS jump FROM j)""",
    {"e": "r.jump", "x": "r.jump"}, {"e": ema_step("e", "r.jump", "0.1::double"), "x": "r.jump"}) + f"""
SELECT symbol, bar_no, e AS pa_hawkes_intensity, sum((x > 0)::int) {win(20)} AS pa_hawkes_clustering_20 FROM scan""")
def _(T):
    return in_chunks(bars(T), vol.jumps, history=vol.HISTORY["jumps"])


@query("vol_jump_tail", "symbol:s bar_no:i pa_jump_tail_risk:d pa_jump_z_score:d", scan_sql(
    BARS_REC + ", " + RET + f""", j AS (SELECT *, greatest(coalesce(stddev_samp(ret) {win(100)}, 0), 1e-8) AS sd, avg(ret) {win(100)} AS m,
    quantile_cont(abs(ret), 0.99) {win(500)} AS q FROM ret),
  src AS MATERIALIZED (SELECT *, greatest(q, 3 * sd) AS thr, (ret - m) / sd AS z, CASE WHEN abs(ret) > greatest(q, 3 * sd) THEN (abs(ret) - greatest(q, 3 * sd)) / greatest(q, 3 * sd) ELSE 0 END AS jump FROM j)""",
    {"e": "r.jump", "z": "r.z"}, {"e": ema_step("e", "r.jump", "(2.0::double / 11)"), "z": "r.z"}) + """
SELECT symbol, bar_no, e AS pa_jump_tail_risk, z AS pa_jump_z_score FROM scan""")
def _(T):
    return in_chunks(bars(T), vol.jump_tail, history=vol.HISTORY["jump_tail"])


@query("vol_entropy", "symbol:s bar_no:i pa_entropy_75:d", BARS + ", " + RET + f""", v AS (
  SELECT *, greatest(coalesce(stddev_samp(ret) {win(300)}, 1e-5), 1e-5) AS vol FROM ret),
c AS (SELECT *, CASE WHEN ret < -1.5 * vol THEN 0 WHEN ret < -0.25 * vol THEN 1 WHEN ret <= 0.25 * vol THEN 2 WHEN ret <= 1.5 * vol THEN 3 ELSE 4 END AS cls FROM v),
p AS (SELECT symbol, bar_no, {', '.join(f'greatest(avg((cls = {i})::int) {win(75)}, 1e-8) AS p{i}' for i in range(5))} FROM c)
SELECT symbol, bar_no, -({' + '.join(f'p{i} * log2(p{i})' for i in range(5))}) / log2(5) AS pa_entropy_75 FROM p""")
def _(T):
    return in_chunks(bars(T), vol.entropy, history=vol.HISTORY["entropy"])


HURST = "least(greatest(0.5 * ln(greatest(coalesce(var_samp(r2) {w}, 1e-8), 1e-8) / greatest(coalesce(var_samp(r1) {w}, 1e-8) * 2, 1e-8)) / ln(2) + 0.5, 0), 1)"


@query("vol_hurst", "symbol:s bar_no:i pa_hurst_20:d pa_hurst_60:d", scan_sql(
    BARS_REC + f""", l1 AS (SELECT *, CASE WHEN close > 0 AND coalesce({lagw('close')}, close) > 0 THEN ln(close / coalesce({lagw('close')}, close)) END AS r1 FROM bars), l2 AS (SELECT *, r1 + coalesce({lagw('r1')}, 0) AS r2 FROM l1),
  src AS MATERIALIZED (SELECT *, {HURST.format(w=win(20))} AS h20, {HURST.format(w=win(60))} AS h60 FROM l2)""",
    {"a": "r.h20", "b": "r.h60"}, {"a": ema_step("a", "r.h20", "(2.0::double / 6)"), "b": ema_step("b", "r.h60", "(2.0::double / 11)")}) + """
SELECT symbol, bar_no, a AS pa_hurst_20, b AS pa_hurst_60 FROM scan""")
def _(T):
    return in_chunks(bars(T), vol.hurst, history=vol.HISTORY["hurst"])


INDEX_COLS = ("vixy_level_ma60_ratio vixy_level_ma390_ratio vixy_level_ma1950_ratio vixy_zscore_390 vixy_term_structure_slope vixy_ret_30 vixy_ret_60 "
              "vixy_zscore_60 vixy_proxy_momentum_30 vixy_abs_ret_5 vixy_abs_ret_15 vixy_abs_ret_30 vixy_abs_ret_60 vixy_accel_5 vixy_accel_15 "
              "vixy_accel_5_over_15 vixy_accel_burst_minus_drift vixy_acceleration_2nd vixy_rvol_60 vixy_rvol_390 vixy_rvol_ratio "
              "vixy_realized_vs_implied_gap vixy_intraday_range vixy_intraday_rank vixy_intraday_range_ratio vixy_vol_surge vixy_vol_surge_5 "
              "vixy_pct_rank_5d vixy_regime_duration").split()
INDEX = f"""i0 AS (SELECT *, close / {lagw('close')} - 1 AS ret, close / (CASE WHEN bar_no >= 19 THEN avg(close) {win(60)} END + 1e-8) AS vixy_level_ma60_ratio,
  close / (CASE WHEN bar_no >= 11 THEN avg(close) {win(78)} END + 1e-8) AS vixy_level_ma390_ratio, close / (CASE WHEN bar_no >= 77 THEN avg(close) {win(390)} END + 1e-8) AS vixy_level_ma1950_ratio,
  CASE WHEN bar_no >= 11 THEN (close - avg(close) {win(78)}) / (stddev_samp(close) {win(78)} + 1e-8) END AS vixy_zscore_390,
  CASE WHEN bar_no >= 19 THEN (close - avg(close) {win(60)}) / (stddev_samp(close) {win(60)} + 1e-8) END AS vixy_zscore_60,
  close / {lagw('close', 30)} - 1 AS vixy_ret_30, close / {lagw('close', 60)} - 1 AS vixy_ret_60,
  {', '.join(f'abs(close / {lagw("close", n)} - 1) AS vixy_abs_ret_{n}' for n in (5, 15, 30, 60))},
  CASE WHEN bar_no >= 11 THEN max(high) {win(78)} END AS rh, CASE WHEN bar_no >= 11 THEN min(low) {win(78)} END AS rl, CASE WHEN bar_no >= 11 THEN avg(volume) {win(78)} END AS vm,
  list(close) {win(390)} AS vs FROM bars),
i1 AS (SELECT *, vixy_level_ma60_ratio - vixy_level_ma390_ratio AS vixy_term_structure_slope, vixy_zscore_60 - {lagw('vixy_zscore_60', 30)} AS vixy_proxy_momentum_30,
  vixy_abs_ret_5 - {lagw('vixy_abs_ret_5', 5)} AS vixy_accel_5, vixy_abs_ret_15 - {lagw('vixy_abs_ret_15', 15)} AS vixy_accel_15,
  {need('ret', 60, 20, 'sqrt(390) * stddev_samp(ret)')} AS vixy_rvol_60, {need('ret', 78, 12, 'sqrt(390) * stddev_samp(ret)')} AS vixy_rvol_390,
  (rh - rl) / (close + 1e-8) AS vixy_intraday_range, (close - rl) / (rh - rl + 1e-8) AS vixy_intraday_rank, volume / (vm + 1) AS vixy_vol_surge,
  CASE WHEN bar_no >= 4 THEN avg(volume) {win(5)} END / (vm + 1) AS vixy_vol_surge_5,
  CASE WHEN bar_no >= 77 THEN (len(list_filter(vs, lambda v: v < close)) + (len(list_filter(vs, lambda v: v = close)) + 1) / 2.0) / len(vs) END AS vixy_pct_rank_5d,
  CASE WHEN coalesce(vixy_zscore_390, 0) > 1 THEN 2 WHEN coalesce(vixy_zscore_390, 0) < -1 THEN 0 ELSE 1 END AS vixy_regime FROM i0),
i2 AS (SELECT *, vixy_accel_5 / (abs(vixy_accel_15) + 1e-8) AS vixy_accel_5_over_15, vixy_accel_5 - vixy_accel_15 AS vixy_accel_burst_minus_drift,
  vixy_accel_5 - {lagw('vixy_accel_5', 5)} AS vixy_acceleration_2nd, vixy_rvol_60 / (vixy_rvol_390 + 1e-8) AS vixy_rvol_ratio,
  vixy_rvol_60 - vixy_abs_ret_30 * sqrt(13.0) AS vixy_realized_vs_implied_gap,
  vixy_intraday_range / (CASE WHEN count(vixy_intraday_range) {win(78)} >= 12 THEN quantile_cont(vixy_intraday_range, 0.5) {win(78)} END + 1e-8) AS vixy_intraday_range_ratio,
  coalesce((vixy_regime <> {lagw('vixy_regime')})::int, 1) AS chg FROM i1),
i3 AS (SELECT *, sum(chg) OVER (PARTITION BY symbol ORDER BY bar_no) AS isl FROM i2),
idx AS (SELECT *, row_number() OVER (PARTITION BY symbol, isl ORDER BY bar_no) AS vixy_regime_duration FROM i3)"""


def index_bars(T):
    d = in_chunks(bars(T), lambda x, f: vol.index_features(x, f, 78), history=vol.index_history(78))
    return vol.index_duration(d)


@query("vol_index", "symbol:s bar_no:i " + " ".join(f"{n}:d" for n in INDEX_COLS), BARS + ", " + INDEX + " SELECT * FROM idx")
def _(T):
    return index_bars(T)


@query("vol_index_attached", "symbol:s t:t z:d rank:d", BARS + ", " + INDEX + """, ix AS (SELECT t, vixy_zscore_390 AS z, vixy_intraday_rank AS rank FROM idx WHERE symbol = 'error'),
j AS (SELECT b.symbol, b.t, b.bar_no, ix.z, ix.rank FROM bars b LEFT JOIN ix ON ix.t = b.t)
SELECT symbol, t, last_value(z IGNORE NULLS) OVER (PARTITION BY symbol ORDER BY bar_no ROWS 5 PRECEDING) AS z,
  last_value(rank IGNORE NULLS) OVER (PARTITION BY symbol ORDER BY bar_no ROWS 5 PRECEDING) AS rank FROM j""")
def _(T):
    ix = index_bars(T).where("symbol = 'error'").select("t", F.col("vixy_zscore_390").alias("z"), F.col("vixy_intraday_rank").alias("rank"))
    return vol.attach_index(bars(T), ix, ["z", "rank"])


@query("vol_base_iv", "symbol:s bar_no:i l3_base_iv:d", scan_sql(
    BARS_REC + ", " + ANNUAL + ", src AS MATERIALIZED (SELECT *, coalesce(lr, 0) AS x FROM annual)",
    {"m": "r.x", "v": "0::double", "w": "1::double", "g": "r.gk_vol_390", "rv": "r.rv_390"},
    {"m": ema_step("m", "r.x", "(2.0::double / 1951)"),
     "v": "(1 - 2.0::double / 1951) * (p.v + (2.0::double / 1951) * (r.x - p.m) * (r.x - p.m))",
     "w": "(1 - 2.0::double / 1951) * (1 - 2.0::double / 1951) * p.w + (2.0::double / 1951) * (2.0::double / 1951)", "g": "r.gk_vol_390", "rv": "r.rv_390"}) + """
SELECT symbol, bar_no, least(greatest(0.55 * coalesce(CASE WHEN bar_no > 0 THEN sqrt(v / (1 - w)) END, 0) * sqrt(252.0 * 390) + 0.25 * g + 0.20 * rv + 0.02, 0.05), 5) AS l3_base_iv FROM scan""")
def _(T):
    return vol.base_iv(in_chunks(bars(T), vol.annualised, history=482))


@query("cluster_inputs", "symbol:s bar_no:i ma_slope_smooth:d atr_percentile:d bb_width:d vol_ratio_smooth:d", BARS + f""", a AS (SELECT *, avg(close) {win(20)} AS ma, avg(CASE WHEN high = low THEN 1e-10 ELSE high - low END) {win(20)} AS atr,
  stddev_samp(close) {win(20)} AS sd, volume / (avg(volume) {win(20)} + 1e-8) AS vr FROM bars), b AS (SELECT *, (ma - {lagw('ma', 5)}) / nullif(close, 0) * 1000 AS sl FROM a)
SELECT symbol, bar_no, avg(sl) {win(3)} AS ma_slope_smooth, atr / (avg(atr) {win(100)} + 1e-8) AS atr_percentile, sd * 2 / (ma + 1e-8) AS bb_width, avg(vr) {win(5)} AS vol_ratio_smooth FROM b""")
def _(T):
    return in_chunks(bars(T), vol.cluster_inputs, history=125)
