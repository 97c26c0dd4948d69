"""Queries: price-action rules."""
from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import price_action as pa
from ..operators.layout import in_chunks
from .catalog import query
from .data import BARS_REC, bars, bars_cte
from .q_vol import lagw, win
from .q_windows import ema_step, scan_sql

RAW = BARS_REC + ", src AS MATERIALIZED (SELECT * FROM bars)"


def ema_bars(source: str = RAW) -> str:
    """CTE `b`: bars with seeded averages e8, e20, e50 and the weighted range average atr_pa."""
    steps = {f"x{n}": ema_step(f"x{n}", "r.close", f"(2.0::double / {n + 1})") for n in (8, 20, 50)}
    return scan_sql(source, {**{k: "r.close" for k in steps}, "num": "r.high - r.low", "den": "1::double"},
                    {**steps, "num": "(1 - 2.0::double / 15) * p.num + r.high - r.low", "den": "(1 - 2.0::double / 15) * p.den + 1"}) + """,
b AS MATERIALIZED (SELECT src.*, CASE WHEN bar_no >= 7 THEN x8 END AS e8, CASE WHEN bar_no >= 19 THEN x20 END AS e20,
  CASE WHEN bar_no >= 49 THEN x50 END AS e50, CASE WHEN bar_no >= 4 THEN num / den END AS atr_pa,
  coalesce(sign(close - CASE WHEN bar_no >= 19 THEN x20 END), 0)::int AS dir FROM src JOIN scan USING (symbol, bar_no))"""


EMA = ema_bars()


def since_extreme(src: str, d: str, out: str, name: str) -> str:
    """Step-by-step counter as a recursive CTE `name`(symbol, bar_no, out)."""
    return f"""{name}_s AS MATERIALIZED (SELECT symbol, bar_no, high, low, {d} AS d FROM {src}),
{name} AS (
  SELECT symbol, bar_no, d, CASE WHEN d = 0 THEN 1 ELSE 0 END AS {out}, CASE WHEN d = 1 THEN high WHEN d = -1 THEN low END AS ext FROM {name}_s WHERE bar_no = 0
  UNION ALL
  SELECT r.symbol, r.bar_no, r.d,
    CASE WHEN r.d = 0 THEN p.{out} + 1 WHEN p.d <> r.d THEN 0 WHEN r.d = 1 AND r.high >= p.ext THEN 0 WHEN r.d = -1 AND r.low <= p.ext THEN 0 ELSE p.{out} + 1 END,
    CASE WHEN r.d = 0 THEN NULL WHEN p.d <> r.d THEN CASE WHEN r.d = 1 THEN r.high ELSE r.low END
         WHEN r.d = 1 THEN greatest(r.high, p.ext) ELSE least(r.low, p.ext) END
  FROM {name} p JOIN {name}_s r ON r.symbol = p.symbol AND r.bar_no = p.bar_no + 1)"""


def with_dir(T):
    return in_chunks(bars(T), pa.direction, history=pa.EMA20)


@query("pa_direction", "symbol:s bar_no:i dir:i", EMA + " SELECT * FROM b")
def _(T):
    return with_dir(T)


@query("pa_twenty_bar_rule", "symbol:s bar_no:i pa_bars_since_trend_change:i pa_trend_weakened:b",
       EMA + ", " + since_extreme("b", "dir", "pa_bars_since_trend_change", "tw") + """
SELECT *, pa_bars_since_trend_change >= 20 AS pa_trend_weakened FROM tw""")
def _(T):
    return pa.twenty_bar_rule(with_dir(T))


PULL_A = """pull_s AS MATERIALIZED (SELECT symbol, bar_no, dir, coalesce(high > lag(high) OVER w, false) AS nh, coalesce(low < lag(low) OVER w, false) AS ll
  FROM b WINDOW w AS (PARTITION BY symbol ORDER BY bar_no)),
pull AS (SELECT symbol, bar_no, 0 AS h, 0 AS l, false AS inu, false AS ind FROM pull_s WHERE bar_no = 0
  UNION ALL
  SELECT r.symbol, r.bar_no, CASE WHEN r.dir <> 1 THEN 0 WHEN r.ll THEN r.nh::int WHEN p.inu AND r.nh THEN p.h + 1 ELSE p.h END,
    CASE WHEN r.dir <> -1 THEN 0 WHEN r.nh THEN r.ll::int WHEN p.ind AND r.ll THEN p.l + 1 ELSE p.l END,
    CASE WHEN r.dir <> 1 THEN false ELSE r.ll OR p.inu END, CASE WHEN r.dir <> -1 THEN false ELSE r.nh OR p.ind END
  FROM pull p JOIN pull_s r ON r.symbol = p.symbol AND r.bar_no = p.bar_no + 1)"""


@query("pa_pullback_counts", "symbol:s bar_no:i pa_h_count:i pa_l_count:i pa_is_h1_setup:b pa_is_h2_setup:b pa_is_h3_setup:b pa_is_h4_setup:b "
       "pa_is_l1_setup:b pa_is_l2_setup:b pa_is_l3_setup:b pa_is_l4_setup:b pa_r09_short_setup:b pa_r09_long_setup:b", EMA + ", " + PULL_A + """
SELECT symbol, bar_no, h AS pa_h_count, l AS pa_l_count, h = 1 AS pa_is_h1_setup, h = 2 AS pa_is_h2_setup, h = 3 AS pa_is_h3_setup, h >= 4 AS pa_is_h4_setup,
  l = 1 AS pa_is_l1_setup, l = 2 AS pa_is_l2_setup, l = 3 AS pa_is_l3_setup, l >= 4 AS pa_is_l4_setup, dir = -1 AND h >= 4 AS pa_r09_short_setup,
  dir = 1 AND l >= 4 AS pa_r09_long_setup FROM pull JOIN pull_s USING (symbol, bar_no)""")
def _(T):
    return pa.pullback_counts(with_dir(T))


STATE = "cast(floor(avg_close) AS int) % 6"
STATES = f"""st AS MATERIALIZED (SELECT symbol, bar_no, t, open, high, low, close, volume, cast(floor(avg(close) OVER (PARTITION BY symbol ORDER BY bar_no ROWS 3 PRECEDING) / 8) AS int) % 6 AS market_state FROM bars)"""


def with_state(T):
    return in_chunks(bars(T), lambda d, f: d.withColumn("market_state", F.floor(f.mean("close", 4) / 8).cast("int") % 6), history=4)


PULL_B = """pb_s AS MATERIALIZED (SELECT *, CASE WHEN market_state IN (0, 1) THEN 1 WHEN market_state IN (2, 3) THEN -1 ELSE 0 END AS side,
  coalesce(high > lag(high) OVER w, false) AS nh, coalesce(low < lag(low) OVER w, false) AS ll,
  coalesce(CASE WHEN market_state IN (0, 1) THEN close < lag(close) OVER w WHEN market_state IN (2, 3) THEN close > lag(close) OVER w END, false) AS against
  FROM st WINDOW w AS (PARTITION BY symbol ORDER BY bar_no)),
pb AS (SELECT symbol, bar_no, 0 AS h, 0 AS l, false AS inu, false AS ind, 0 AS pbars FROM pb_s WHERE bar_no = 0
  UNION ALL
  SELECT r.symbol, r.bar_no, CASE WHEN r.side <> 1 THEN 0 WHEN (p.inu OR r.ll) AND r.nh THEN p.h + 1 ELSE p.h END,
    CASE WHEN r.side <> -1 THEN 0 WHEN (p.ind OR r.nh) AND r.ll THEN p.l + 1 ELSE p.l END,
    CASE WHEN r.side <> 1 THEN false ELSE (p.inu OR r.ll) AND NOT r.nh END, CASE WHEN r.side <> -1 THEN false ELSE (p.ind OR r.nh) AND NOT r.ll END,
    CASE WHEN r.against THEN p.pbars + 1 ELSE 0 END
  FROM pb p JOIN pb_s r ON r.symbol = p.symbol AND r.bar_no = p.bar_no + 1)"""


@query("pa_pullback_counts_rearm", "symbol:s bar_no:i h_count:i l_count:i pullback_bars:i endless_pullback:i",
       BARS_REC + ", " + STATES + ", " + PULL_B + """
SELECT symbol, bar_no, h AS h_count, l AS l_count, pbars AS pullback_bars, (pbars >= 20)::int AS endless_pullback FROM pb""")
def _(T):
    return pa.pullback_bars(pa.pullback_counts_rearm(with_state(T)))


def _least(x: str, n: int, least: int) -> str:
    return f"CASE WHEN bar_no >= {least - 1} THEN {x} {win(n)} END"


REGIME = f"""r1 AS (SELECT *, coalesce(abs(close - open) / nullif(high - low, 0), 0) AS brat, abs(close - open) AS body, high - greatest(open, close) AS uw, least(open, close) - low AS lw,
  coalesce(((high - greatest(open, close)) + (least(open, close) - low)) / nullif(high - low, 0), 1) AS wrat, sign(close - open) AS sgn, e20 - {lagw('e20')} AS slope,
  coalesce(sign(close - e20), 0) AS side, {lagw('open')} AS po, {lagw('high')} AS ph, {lagw('low')} AS pl, {lagw('close')} AS pc FROM b),
r2 AS (SELECT *, coalesce((high > ph AND low > pl)::int, 0) AS up, coalesce((high < ph AND low < pl)::int, 0) AS dn, (side > 0)::int AS above, (side < 0)::int AS below,
  CASE WHEN bar_no = 0 THEN 0 ELSE greatest(0, least(greatest(po, pc), greatest(open, close)) - greatest(least(po, pc), least(open, close))) / greatest(abs(po - pc), body, 1e-12) END AS overlap,
  coalesce((sgn <> 0 AND sgn = {lagw('sgn')})::int, 0) AS same, ({lagw('side')} <> 0 AND side <> 0 AND {lagw('side')} <> side)::int AS crossed,
  coalesce((sgn <> {lagw('sgn')})::int, 0) AS alt, {_least('max(high)', 10, 3)} AS hi10, {_least('min(low)', 10, 3)} AS lo10,
  (brat >= 0.6 AND body > 1.5 * {_least('avg(body)', 20, 5)}) AS big FROM r1),
r3 AS (SELECT *, sum(1 - same) OVER (PARTITION BY symbol ORDER BY bar_no) AS g1, sum((NOT (close < open AND bar_no > 0))::int) OVER (PARTITION BY symbol ORDER BY bar_no) AS g2,
  coalesce((big AND close > ph AND close >= high - 0.25 * (high - low))::int, 0) AS bull, coalesce((big AND close < pl AND close <= low + 0.25 * (high - low))::int, 0) AS bear,
  (hi10 - close) / nullif(hi10 - lo10, 0) AS pu, (close - lo10) / nullif(hi10 - lo10, 0) AS pd, nullif(hi10 - lo10, 0) AS span10 FROM r2),
r4 AS (SELECT *, row_number() OVER (PARTITION BY symbol, g1 ORDER BY bar_no) AS color, sum((close < open AND bar_no > 0)::int) OVER (PARTITION BY symbol, g2 ORDER BY bar_no) AS counter FROM r3),
r5 AS (SELECT *, bar_no >= 4 AND sum(above) {win(5)} = 5 AS above5, bar_no >= 4 AND sum(below) {win(5)} = 5 AS below5 FROM r4),
r6 AS (SELECT *, coalesce((slope > 0 AND {_least('avg(above)', 20, 5)} >= 0.6)::int, 0) + above5::int + (color >= 3 AND close > open AND brat >= 0.6)::int + coalesce((pu < 0.5)::int, 0)
    + (counter <= 5)::int + coalesce(({_least('sum(up)', 5, 2)} >= 3)::int, 0) + coalesce(({_least('max(bull)', 20, 5)} = 1)::int, 0) AS lc,
  coalesce((slope < 0 AND {_least('avg(below)', 20, 5)} >= 0.6)::int, 0) + below5::int + (color >= 3 AND close < open AND brat >= 0.6)::int + coalesce((pd < 0.5)::int, 0)
    + (counter <= 5)::int + coalesce(({_least('sum(dn)', 5, 2)} >= 3)::int, 0) + coalesce(({_least('max(bear)', 20, 5)} = 1)::int, 0) AS sc FROM r5),
r7 AS MATERIALIZED (SELECT *, sign(lc - sc)::int AS td FROM r6),
{since_extreme('r7', 'td', 'since', 'ext')},
r8 AS (SELECT r7.*, since, {_least('max(high)', 20, 5)} AS h20, {_least('min(low)', 20, 5)} AS l20, {_least('max(high)', 40, 10)} - {_least('min(low)', 40, 10)} AS r40,
  CASE WHEN count(slope) {win(40)} >= 10 THEN avg(abs(slope)) {win(40)} END AS slow, coalesce(CASE WHEN td = 1 THEN close >= low + 2.0::double / 3 * (high - low) WHEN td = -1 THEN close <= low + 1.0::double / 3 * (high - low) END, false)::int AS extreme
  FROM r7 JOIN (SELECT symbol, bar_no, since FROM ext) USING (symbol, bar_no)),
r9 AS (SELECT *, (coalesce(high >= {lagw('h20')} AND close < {lagw('h20')}, false) OR coalesce(low <= {lagw('l20')} AND close > {lagw('l20')}, false))::int AS failed FROM r8),
r10 AS (SELECT *, (coalesce((h20 - l20 < 0.5 * nullif({lagw('r40', 20)}, 0))::int, 0) + coalesce((abs(slope) < nullif(slow, 0) / 3)::int, 0) + coalesce(({_least('sum(coalesce(crossed, 0))', 10, 5)} >= 3)::int, 0)
   + coalesce(({_least('sum(failed)', 5, 3)} >= 4)::int, 0) + coalesce(({_least('avg(alt)', 10, 5)} >= 0.6 AND color < 3)::int, 0)
   + coalesce(({_least('avg((uw > body / 3 AND lw > body / 3)::int)', 10, 5)} >= 0.6)::int, 0)) / 6.0::double AS range_ratio FROM r9),
r11 AS (SELECT *, counter BETWEEN 1 AND 3 AND (coalesce(span10 * coalesce(pu, 0) < 2 * (high - low), false) OR coalesce(span10 * coalesce(pd, 0) < 2 * (high - low), false))
    AND coalesce(CASE WHEN td = 1 THEN low > po WHEN td = -1 THEN high < po END, false) AND overlap < 0.3 AND coalesce({_least('avg(extreme)', 10, 5)} >= 0.7, false) AS tight,
  coalesce(pu > 0.5 OR pd > 0.5, false)::int + coalesce({_least('avg(color)', 10, 5)} >= 5, false)::int + coalesce({_least('sum(up)', 10, 5)} >= 2 AND {_least('sum(dn)', 10, 5)} >= 2, false)::int
    + coalesce({_least('avg(coalesce(low <= e20 OR high >= e20, false)::int)', 10, 5)} >= 0.6, false)::int >= 2 AS broad,
  coalesce(h20 - l20 < 3 * {_least('avg(high - low)', 20, 5)} AND {_least('avg(overlap)', 10, 5)} > 0.5 AND {_least('avg((uw > 0 AND lw > 0)::int)', 10, 5)} >= 0.6 AND color <= 2
    AND {_least('avg(range_ratio)', 5, 3)} >= 0.6, false) AS ttr,
  coalesce(sign(slope), 0) AS s1, CASE WHEN above5 THEN 1 WHEN below5 THEN -1 ELSE 0 END AS s2,
  CASE WHEN {_least('sum(up)', 4, 2)} >= 3 THEN 1 WHEN {_least('sum(dn)', 4, 2)} >= 3 THEN -1 ELSE 0 END AS s3, CASE WHEN bull = 1 THEN 1 WHEN bear = 1 THEN -1 ELSE 0 END AS s4,
  CASE WHEN td = 1 AND pu < 0.38 THEN 1 WHEN td = -1 AND pd < 0.38 THEN -1 ELSE 0 END AS s5, CASE WHEN td <> 0 AND counter <= 3 THEN td ELSE 0 END AS s6,
  CASE WHEN since < 10 THEN td ELSE 0 END AS s7, CASE WHEN brat >= 0.6 AND wrat < 0.4 THEN sgn ELSE 0 END AS s8 FROM r10),
r12 AS (SELECT *, s1 + s2 + s3 + s4 + s5 + s6 + s7 + s8 AS total FROM r11),
regime AS MATERIALIZED (SELECT *, CASE WHEN since >= 20 AND abs(total) <= 2 THEN 'neutral_50_50' WHEN total >= 6 AND tight THEN 'tight_bull_channel' WHEN total >= 3 THEN 'wide_bull_channel'
  WHEN total <= -6 AND tight THEN 'tight_bear_channel' WHEN total <= -3 THEN 'wide_bear_channel' WHEN ttr THEN 'ttr' ELSE 'wide_tr' END AS state, greatest(lc, sc) / 7.0::double AS trend_ratio,
  CASE WHEN since <= 5 THEN 0.9 WHEN since <= 10 THEN 0.75 WHEN since <= 15 THEN 0.6 WHEN since <= 19 THEN 0.55 ELSE 0.5 END AS inertia FROM r12)"""


@query("pa_market_regime", "symbol:s bar_no:i pa_env_trend_dir:i pa_env_bars_since_extreme:i pa_env_trend_inertia:d pa_env_inertia_bucket:s pa_env_trend_score_ratio:d "
       "pa_env_range_score_ratio:d pa_env_score_ema_dir:i pa_env_score_price_vs_ema:i pa_env_score_hh_hl:i pa_env_score_breakout_bar:i pa_env_score_pullback_depth:i "
       "pa_env_score_pullback_duration:i pa_env_score_twenty_bar:i pa_env_score_bar_quality:i pa_env_score_total:i pa_env_state:s pa_env_order_type:s pa_env_entry_style:s "
       "pa_env_stop_style:s pa_env_take_profit_style:s pa_env_position_size:s pa_regime_trend:b pa_regime_range:b pa_reversal_likely_fail:b "
       "pa_breakout_likely_fail:b pa_is_tight_channel:b pa_is_broad_channel:b pa_is_ttr:b", EMA + ", " + REGIME + """
SELECT symbol, bar_no, td AS pa_env_trend_dir, since AS pa_env_bars_since_extreme, inertia AS pa_env_trend_inertia,
  CASE WHEN since <= 5 THEN 'bars_0_5' WHEN since <= 10 THEN 'bars_6_10' WHEN since <= 15 THEN 'bars_11_15' WHEN since <= 19 THEN 'bars_16_19' ELSE 'bars_ge_20' END AS pa_env_inertia_bucket,
  trend_ratio AS pa_env_trend_score_ratio, range_ratio AS pa_env_range_score_ratio, s1 AS pa_env_score_ema_dir, s2 AS pa_env_score_price_vs_ema, s3 AS pa_env_score_hh_hl,
  s4 AS pa_env_score_breakout_bar, s5 AS pa_env_score_pullback_depth, s6 AS pa_env_score_pullback_duration, s7 AS pa_env_score_twenty_bar, s8 AS pa_env_score_bar_quality,
  total AS pa_env_score_total, state AS pa_env_state,
  CASE WHEN state LIKE 'tight%' THEN 'stop' WHEN state LIKE 'wide_b%' THEN 'stop_plus_limit' WHEN state = 'ttr' THEN 'none' WHEN state = 'neutral_50_50' THEN 'wait' ELSE 'limit' END AS pa_env_order_type,
  CASE WHEN state LIKE 'tight%' THEN 'h1_h2_or_l1_l2_breakout' WHEN state LIKE 'wide_b%' THEN 'trend_pullback_or_boundary_reversal' WHEN state = 'ttr' THEN 'no_trade_wait_breakout_confirm'
    WHEN state = 'neutral_50_50' THEN 'strong_breakout_plus_follow_through' ELSE 'range_thirds' END AS pa_env_entry_style,
  CASE WHEN state LIKE 'tight%' THEN 'leg_extreme_or_ema_other_side' WHEN state LIKE 'wide_b%' THEN 'outside_recent_swing' WHEN state = 'ttr' THEN 'n_a'
    WHEN state = 'neutral_50_50' THEN 'below_breakout_midpoint' ELSE 'range_plus_1atr' END AS pa_env_stop_style,
  CASE WHEN state LIKE 'tight%' THEN 'hold_until_trend_exhaustion' WHEN state LIKE 'wide_b%' THEN 'channel_opposite_or_mm_target' WHEN state = 'ttr' THEN 'n_a'
    WHEN state = 'neutral_50_50' THEN 'conservative_1r' ELSE 'to_opposite_or_midline' END AS pa_env_take_profit_style,
  CASE WHEN state LIKE 'tight%' OR state LIKE 'wide_b%' THEN '1.00x' WHEN state = 'ttr' THEN 'n_a' WHEN state = 'neutral_50_50' THEN '0.50x' ELSE '0.50_to_0.75x' END AS pa_env_position_size,
  state LIKE '%channel' AS pa_regime_trend, state NOT LIKE '%channel' AS pa_regime_range, state LIKE '%channel' AS pa_reversal_likely_fail, state IN ('wide_tr', 'ttr') AS pa_breakout_likely_fail,
  tight AS pa_is_tight_channel, broad AS pa_is_broad_channel, ttr AS pa_is_ttr FROM regime""")
def _(T):
    return pa.market_regime(bars(T))


@query("pa_volume_climax", "symbol:s bar_no:i pa_vol_zscore_20:d pa_vol_exhaustion_climax:b", EMA + ", " + REGIME + f""", z AS (
  SELECT *, coalesce((volume - {_least('avg(volume)', 20, 5)}) / ({_least('stddev_samp(volume)', 20, 5)} + 1e-8), 0) AS z FROM regime)
SELECT symbol, bar_no, z AS pa_vol_zscore_20, state LIKE '%channel' AND since >= 20 AND z > 3 AS pa_vol_exhaustion_climax FROM z""")
def _(T):
    return in_chunks(pa.market_regime(bars(T)), pa.volume_climax, history=20)


PRESSURE = """p1 AS (SELECT *, CASE WHEN bar_no > 0 AND close > open AND low >= lag(low) OVER w THEN 1 WHEN bar_no > 0 AND close < open AND high <= lag(high) OVER w THEN -1 ELSE 0 END AS v
  FROM {src} WINDOW w AS (PARTITION BY symbol ORDER BY bar_no)),
p2 AS (SELECT *, sum((v = 0)::int) OVER (PARTITION BY symbol ORDER BY bar_no) AS g FROM p1),
p3 AS (SELECT *, sum(v) OVER (PARTITION BY symbol, g ORDER BY bar_no) AS consec, sum((close > open)::int - (close < open)::int) {w10} / 10.0::double * 20
  + coalesce((avg(greatest(close - open, 0)) {w10} - avg(greatest(open - close, 0)) {w10}) / nullif(avg(greatest(close - open, 0)) {w10} + avg(greatest(open - close, 0)) {w10}, 0), 0) * 20
  + (avg(coalesce((close - low) / nullif(high - low, 0), 0.5)) {w10} - 0.5) * 40 AS raw FROM p2),
p4 AS (SELECT *, CASE WHEN abs(consec) >= 3 THEN sign(consec) * 20 ELSE 0 END AS micro FROM p3),
p5 AS (SELECT *, least(greatest(least(greatest(raw, 0), 100) + least(greatest(micro, 0), 20), 0), 100) AS bp, least(greatest(least(greatest(-raw, 0), 100) + least(greatest(-micro, 0), 20), 0), 100) AS ep FROM p4)""".replace("{w10}", win(10))


@query("pa_pressure_score", "symbol:s bar_no:i pa_bull_pressure:d pa_bear_pressure:d pa_net_pressure:d", "WITH " + bars_cte() + ", " + PRESSURE.format(src="bars") + """
SELECT symbol, bar_no, bp AS pa_bull_pressure, ep AS pa_bear_pressure, bp - ep AS pa_net_pressure FROM p5""")
def _(T):
    return pa.pressure_score(bars(T))


@query("pa_opening_range", "symbol:s bar_no:i or_breakout_up:i or_breakout_down:i or_volume_breakout:i or_vs_atr_ratio:d", EMA + f""", o AS (
  SELECT *, max(CASE WHEN hour(t) * 60 + minute(t) BETWEEN 570 AND 659 THEN high END) OVER d AS oh, min(CASE WHEN hour(t) * 60 + minute(t) BETWEEN 570 AND 659 THEN low END) OVER d AS ol,
    avg(volume) {win(20)} AS vm, hour(t) >= 11 AS late FROM b WINDOW d AS (PARTITION BY symbol, cast(t AS date) ORDER BY bar_no ROWS UNBOUNDED PRECEDING))
SELECT symbol, bar_no, coalesce(late AND close > oh, false)::int AS or_breakout_up, coalesce(late AND close < ol, false)::int AS or_breakout_down,
  coalesce(late AND (close > oh OR close < ol) AND volume > vm, false)::int AS or_volume_breakout, CASE WHEN atr_pa > 0 THEN (oh - ol) / atr_pa END AS or_vs_atr_ratio FROM o""")
def _(T):
    return pa.opening_range(in_chunks(bars(T), pa.pa_atr, history=300), "atr_pa")


SWINGS = """sw AS MATERIALIZED (SELECT *, CASE WHEN bar_no >= 10 AND lag(high, 5) OVER w > max(high) OVER lft AND lag(high, 5) OVER w > max(high) OVER rgt THEN lag(high, 5) OVER w END AS sh,
  CASE WHEN bar_no >= 10 AND lag(low, 5) OVER w < min(low) OVER lft AND lag(low, 5) OVER w < min(low) OVER rgt THEN lag(low, 5) OVER w END AS sl
  FROM b WINDOW w AS (PARTITION BY symbol ORDER BY bar_no), lft AS (PARTITION BY symbol ORDER BY bar_no ROWS BETWEEN 10 PRECEDING AND 6 PRECEDING), rgt AS (PARTITION BY symbol ORDER BY bar_no ROWS BETWEEN 4 PRECEDING AND CURRENT ROW))"""


@query("pa_swings", "symbol:s bar_no:i swing_high:d swing_low:d", EMA + ", " + SWINGS + " SELECT symbol, bar_no, sh AS swing_high, sl AS swing_low FROM sw")
def _(T):
    return in_chunks(bars(T), pa.swings, history=10)


STRUCT = SWINGS + f""", sg AS (SELECT *, list(sh) FILTER (sh IS NOT NULL) OVER u AS hs0, list(sl) FILTER (sl IS NOT NULL) OVER u AS ls0,
  count(sh) {win(36)} + count(sl) {win(36)} AS legs FROM sw WINDOW u AS (PARTITION BY symbol ORDER BY bar_no ROWS UNBOUNDED PRECEDING)),
sa AS (SELECT *, list_slice(hs0, greatest(len(hs0) - 4, 1), len(hs0)) AS hs, list_slice(ls0, greatest(len(ls0) - 4, 1), len(ls0)) AS ls FROM sg),
sb AS (SELECT *, coalesce(len([i FOR i IN range(2, len(hs) + 1) IF hs[i] > hs[i - 1]]), 0) AS hh, coalesce(greatest(len(hs) - 1, 0), 0) AS nh2,
  coalesce(len([i FOR i IN range(2, len(ls) + 1) IF ls[i] > ls[i - 1]]), 0) AS hl, coalesce(greatest(len(ls) - 1, 0), 0) AS nl2 FROM sa),
struct_rows AS MATERIALIZED (SELECT *, nh2 - hh AS lh, nl2 - hl AS ll, hh + hl - (nh2 - hh) - (nl2 - hl) AS score, abs(hs[-1] - ls[-1]) / CASE WHEN atr_pa > 0 THEN atr_pa ELSE 1e-6 END AS srange,
  coalesce(close > hs[-1] AND len(hs) >= 2 AND hs[-1] < hs[-2], false) AS bup, coalesce(close < ls[-1] AND len(ls) >= 2 AND ls[-1] > ls[-2], false) AS bdn FROM sb)"""


@query("pa_structure", "symbol:s bar_no:i pa_struct_hh_count:i pa_struct_hl_count:i pa_struct_lh_count:i pa_struct_ll_count:i pa_struct_score:i "
       "pa_struct_swing_range_atr:d pa_struct_break_up:b pa_struct_break_down:b pa_struct_leg_count:i", EMA + ", " + STRUCT + """
SELECT symbol, bar_no, hh AS pa_struct_hh_count, hl AS pa_struct_hl_count, lh AS pa_struct_lh_count, ll AS pa_struct_ll_count, score AS pa_struct_score,
  srange AS pa_struct_swing_range_atr, bup AS pa_struct_break_up, bdn AS pa_struct_break_down, legs AS pa_struct_leg_count FROM struct_rows""")
def _(T):
    return pa.structure(in_chunks(bars(T), pa.pa_atr, history=300), "atr_pa")


@query("pa_swing_types", "symbol:s bar_no:i last_swing_high:d last_swing_low:d swing_high_type:s swing_low_type:s", "WITH " + bars_cte() + f""", c AS (
  SELECT *, CASE WHEN count(*) OVER x = 11 AND high = max(high) OVER x THEN high END AS sh, CASE WHEN count(*) OVER x = 11 AND low = min(low) OVER x THEN low END AS sl
  FROM bars WINDOW x AS (PARTITION BY symbol ORDER BY bar_no ROWS BETWEEN 5 PRECEDING AND 5 FOLLOWING)),
f AS (SELECT *, last_value(sh IGNORE NULLS) OVER u AS fh, last_value(sl IGNORE NULLS) OVER u AS fl FROM c WINDOW u AS (PARTITION BY symbol ORDER BY bar_no ROWS UNBOUNDED PRECEDING)),
g AS (SELECT *, CASE WHEN sh IS NOT NULL THEN CASE WHEN {lagw('fh')} IS NULL THEN 'NA' WHEN sh > {lagw('fh')} THEN 'HH' ELSE 'LH' END END AS th,
  CASE WHEN sl IS NOT NULL THEN CASE WHEN {lagw('fl')} IS NULL THEN 'NA' WHEN sl > {lagw('fl')} THEN 'HL' ELSE 'LL' END END AS tl FROM f)
SELECT symbol, bar_no, {lagw('fh', 3)} AS last_swing_high, {lagw('fl', 3)} AS last_swing_low, coalesce(last_value(th IGNORE NULLS) OVER u, 'NA') AS swing_high_type,
  coalesce(last_value(tl IGNORE NULLS) OVER u, 'NA') AS swing_low_type FROM g WINDOW u AS (PARTITION BY symbol ORDER BY bar_no ROWS UNBOUNDED PRECEDING)""")
def _(T):
    return pa.swing_types(bars(T))


AVG3 = "CASE WHEN e50 IS NOT NULL THEN sqrt((power(e8 - (e8 + e20 + e50) / 3, 2) + power(e20 - (e8 + e20 + e50) / 3, 2) + power(e50 - (e8 + e20 + e50) / 3, 2)) / 3) / greatest(atr_pa, 1e-12) ELSE 0 END"
RVOL = f"""vr AS (SELECT *, volume / coalesce({_least('avg(volume)', 20, 5)}, 1) AS rvol, {_least('avg(volume)', 5, 2)} / coalesce({_least('avg(volume)', 20, 5)}, 1) AS vtrend,
  abs(close - open) / greatest(high - low, 1e-12) AS br, {AVG3} AS compress FROM {{src}}),
vq AS MATERIALIZED (SELECT *, rvol > 3 AND br > 0.5 AS climax, (rvol > 1.5 AND br < 0.4 AND least(open, close) - low > 1.5 * abs(close - open))::int
  - (rvol > 1.5 AND br < 0.4 AND high - greatest(open, close) > 1.5 * abs(close - open))::int AS absorb FROM vr)"""


@query("pa_averages_volume", "symbol:s bar_no:i pa_ma_compress:d pa_vol_rvol:d pa_vol_trend:d pa_vol_climax:b pa_vol_net_absorption:i", EMA + ", " + RVOL.format(src="b") + """
SELECT symbol, bar_no, compress AS pa_ma_compress, rvol AS pa_vol_rvol, vtrend AS pa_vol_trend, climax AS pa_vol_climax, absorb AS pa_vol_net_absorption FROM vq""")
def _(T):
    return in_chunks(bars(T), lambda d, f: pa.relative_volume(pa.ma_compression(pa.pa_atr(d, f), f, "atr_pa"), f), history=pa.EMA50 + 20)


STACK = REGIME + ", " + PULL_A + ", " + PRESSURE.format(src="b") + ", " + STRUCT + ", " + RVOL.format(src="b") + """, stack AS (
  SELECT b.symbol, b.bar_no, b.t, least(greatest(tanh((bp - ep) / 50) * 0.6 + (bup::int - bdn::int) * 0.4, -1), 1) AS pa_reversal_composite,
    CASE WHEN td > 0 THEN inertia * greatest(0, 1 - 0.25 * pull.h) WHEN td < 0 THEN -inertia * greatest(0, 1 - 0.25 * pull.l) ELSE 0 END AS pa_continuation_composite,
    greatest(least(1 - legs / 8.0::double, 1), 0.1) * least(abs(score) / 10.0::double, 1) AS pa_structure_clarity, least(greatest((bp - ep) / 100, -1), 1) AS pa_pressure_score,
    least(greatest(pull.h - pull.l, -4), 4) AS pa_pullback_stage, compress AS pa_ma_compress, rvol AS pa_vol_rvol, vtrend AS pa_vol_trend, climax AS pa_vol_climax, absorb AS pa_vol_net_absorption,
    regime.state, regime.trend_ratio
  FROM b JOIN regime USING (symbol, bar_no) JOIN pull USING (symbol, bar_no) JOIN p5 USING (symbol, bar_no) JOIN struct_rows USING (symbol, bar_no) JOIN vq USING (symbol, bar_no))"""


@query("pa_composites", "symbol:s bar_no:i pa_reversal_composite:d pa_continuation_composite:d pa_structure_clarity:d pa_pressure_score:d pa_pullback_stage:d "
       "pa_ma_compress:d pa_vol_rvol:d pa_vol_trend:d pa_vol_climax:b pa_vol_net_absorption:i", EMA + ", " + STACK + " SELECT * FROM stack")
def _(T):
    return pa.full_stack(bars(T))


@query("pa_micro_1m", "symbol:s bar_no:i pa_1m_wick_ratio:d pa_1m_body_ratio:d pa_1m_consec_dir_run:i pa_1m_ret_1:d pa_1m_vol_rel:d pa_1m_dir_entropy_10:d", "WITH " + bars_cte() + f""", m AS (
  SELECT *, sign(close - open) AS sg, coalesce((close > {lagw('close')})::int, 0) AS up, coalesce({lagw('close')}, close) AS pc FROM bars),
n AS (SELECT *, coalesce((sg <> 0 AND sg = {lagw('sg')})::int, 0) AS go, least(greatest(coalesce({_least('avg(up)', 10, 2)}, 0.5), 1e-10), 1 - 1e-10) AS p FROM m),
g AS (SELECT *, sum(1 - go) OVER (PARTITION BY symbol ORDER BY bar_no) AS isl FROM n)
SELECT symbol, bar_no, least(greatest(((high - greatest(open, close)) + (least(open, close) - low)) / greatest(high - low, 1e-12), 0), 5) AS pa_1m_wick_ratio,
  least(abs(close - open) / greatest(high - low, 1e-12), 1) AS pa_1m_body_ratio, row_number() OVER (PARTITION BY symbol, isl ORDER BY bar_no) - 1 AS pa_1m_consec_dir_run,
  (close - pc) / greatest(pc, 1e-12) AS pa_1m_ret_1, volume / avg(volume) {win(20)} AS pa_1m_vol_rel, least(greatest(-(p * log2(p) + (1 - p) * log2(1 - p)), 0), 1) AS pa_1m_dir_entropy_10 FROM g""")
def _(T):
    return pa.micro_1m(bars(T))


def coarse_cte(width: str) -> str:
    """CTE `src`: closed coarse bars of the hourly bars."""
    return BARS_REC + f""", src AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY t) - 1 AS bar_no FROM (
  SELECT symbol, t4 AS t, first(open ORDER BY t) AS open, max(high) AS high, min(low) AS low, last(close ORDER BY t) AS close, sum(volume) AS volume
  FROM (SELECT *, time_bucket(INTERVAL {width}, t) + INTERVAL {width} AS t4, max(t) OVER (PARTITION BY symbol) AS newest FROM bars) WHERE t4 <= newest GROUP BY symbol, t4))"""


@query("pa_htf_regime", "symbol:s t:t pa_htf_4h_state:s pa_htf_4h_trend_score:d pa_htf_8h_state:s pa_htf_8h_trend_score:d pa_htf_trend_alignment:d", f"""
SELECT x.symbol, x.t, x.state AS pa_htf_4h_state, x.score AS pa_htf_4h_trend_score, y.state AS pa_htf_8h_state, y.score AS pa_htf_8h_trend_score,
  sign(coalesce(x.score, 0)) + sign(coalesce(y.score, 0)) AS pa_htf_trend_alignment FROM
  (WITH RECURSIVE {ema_bars(coarse_cte('4 HOUR'))[len('WITH RECURSIVE '):]}, {REGIME} SELECT q.symbol, q.t, regime.state, regime.trend_ratio AS score FROM bars q ASOF LEFT JOIN regime ON q.symbol = regime.symbol AND q.t >= regime.t) x
JOIN (WITH RECURSIVE {ema_bars(coarse_cte('8 HOUR'))[len('WITH RECURSIVE '):]}, {REGIME} SELECT q.symbol, q.t, regime.state, regime.trend_ratio AS score FROM bars q ASOF LEFT JOIN regime ON q.symbol = regime.symbol AND q.t >= regime.t) y
  ON x.symbol = y.symbol AND x.t = y.t""")
def _(T):
    return pa.htf_regime(bars(T), (("4 hours", "4h"), ("8 hours", "8h")))


@query("pa_multi_timeframe", "symbol:s t:t " + " ".join(f"pa_4h_{n[3:]}:{'b' if n == 'pa_vol_climax' else 'd'}" for n in pa.STACK_COLS),
       ema_bars(coarse_cte("4 HOUR")) + ", " + STACK + " SELECT q.symbol, q.t, " + ", ".join(f"stack.{n} AS pa_4h_{n[3:]}" for n in pa.STACK_COLS) + """
FROM bars q ASOF LEFT JOIN stack ON q.symbol = stack.symbol AND q.t >= stack.t""")
def _(T):
    return pa.multi_timeframe(bars(T), (("4 hours", "4h", False),))
