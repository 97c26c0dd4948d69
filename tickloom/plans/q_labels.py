"""Queries: labels, horizons and the flagship summary."""
from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.exprs import div
from ..operators import labels as lab, price_action as pa, shapes, states, volatility as vol
from ..operators.layout import in_chunks
from ..operators.ranks import exact_quantiles
from ..operators.sessions import mark_sessions
from .catalog import query
from .data import BARS, BARS_REC, bars, bars_cte
from .q_bars import ANATOMY
from .q_price_action import PULL_B
from .q_vol import REALISED, lagw, need, win

A20 = f"atr20 AS (SELECT *, CASE WHEN bar_no >= 4 THEN avg(high - low) {win(20)} END AS atr FROM bars)"


def with_atr(d, f):
    return d.withColumn("_w", F.col("high") - F.col("low")).withColumn("atr", f.mean("_w", 20, 5)).drop("_w")


AHEAD = "OVER (PARTITION BY symbol ORDER BY bar_no ROWS BETWEEN 1 FOLLOWING AND {} FOLLOWING)"


@query("label_straddle_edge", "symbol:s bar_no:i straddle_edge:d", BARS + ", " + A20 + f"""
SELECT symbol, bar_no, coalesce(least(greatest(CASE WHEN count(*) {AHEAD.format(10)} = 10 THEN (max(high) {AHEAD.format(10)} - min(low) {AHEAD.format(10)}) / close END - 2 * atr / close, -0.1), 0.1) / 0.1, 0)
  * (CASE WHEN atr IS NULL OR count(*) {AHEAD.format(10)} < 10 THEN 0 ELSE 1 END) AS straddle_edge FROM atr20""")
def _(T):
    return in_chunks(bars(T), lab.straddle_edge, history=20, lookahead=10)


VOLCLS = REALISED + f""", v1 AS (SELECT *, coalesce((pa_rv_gk_20 - {need('pa_rv_gk_20', 60, 10, 'avg(pa_rv_gk_20)')}) / (nullif({need('pa_rv_gk_20', 60, 10, 'stddev_samp(pa_rv_gk_20)')}, 0) + 1e-8), 0) AS z,
  coalesce((pa_rv_gk_20 - {lagw('pa_rv_gk_20', 20)}) / (20 * (abs({lagw('pa_rv_gk_20', 20)}) + 1e-8)), 0) AS slope,
  CASE WHEN bar_no >= 4 THEN (max(high) {win(20)} - min(low) {win(20)}) / close END AS bb,
  least(greatest(coalesce((volume - {need('volume', 60, 10, 'avg(volume)')}) / (nullif({need('volume', 60, 10, 'stddev_samp(volume)')}, 0) + 1e-8), 0), -6), 6) AS vz FROM rv),
v2 AS (SELECT *, coalesce(slope - {lagw('slope', 5)}, 0) AS acc, {lagw('z', 20)} AS zl, coalesce((bb - {lagw('bb', 20)}) / (abs({lagw('bb', 20)}) + 1e-8), 0) AS bbc FROM v1),
volcls AS (SELECT *, CASE WHEN slope > 0.02 AND acc > 0 AND zl < 0 THEN 1 WHEN z > 0 AND slope < 0 AND acc < 0 THEN 3 WHEN z > 0.5 AND slope >= 0 THEN 2
  WHEN z < -0.3 AND slope < 0 AND bbc < -0.05 AND (vz < 0.35 OR abs(vz - 0.35) <= 0.05) THEN 0 ELSE 4 END AS vol_class FROM v2)"""


def vol_class_build(d, f):
    d = vol.realised(d, f)
    v = F.col("volume")
    z = (v - f.mean("volume", 60, 10)) / (F.nullif(f.std("volume", 60, 10), F.lit(0.0)) + 1e-8)
    d = d.withColumn("vz", F.least(F.greatest(F.coalesce(z, F.lit(0.0)), F.lit(-6.0)), F.lit(6.0)))
    return lab.vol_class(d, f, "pa_rv_gk_20", "vz")


def vol_classes(T):
    return in_chunks(bars(T), vol_class_build, history=46 + lab.VOL_CLASS_HISTORY)


@query("label_vol_class", "symbol:s bar_no:i vol_class:i", BARS + ", " + VOLCLS + " SELECT * FROM volcls")
def _(T):
    return vol_classes(T)


@query("vol_class_summary", "symbol:s vol_class:i n:i mean_range:d mean_rv:d sessions:i", BARS + ", " + VOLCLS + f""",
g AS (SELECT *, sum(brk) OVER (PARTITION BY symbol ORDER BY bar_no) AS sid FROM (SELECT *, coalesce((t - lag(t) OVER (PARTITION BY symbol ORDER BY bar_no) > INTERVAL 4 HOUR)::int, 0) AS brk FROM volcls)),
f AS (SELECT *, CASE WHEN bar_no >= 4 AND count(*) {AHEAD.format(20)} >= 20 THEN (max(high) {AHEAD.format(20)} - min(low) {AHEAD.format(20)}) / nullif(avg(high - low) {win(20)}, 0) END AS fr FROM g)
SELECT symbol, vol_class, count(*) AS n, avg(fr) AS mean_range, avg(pa_rv_gk_20) AS mean_rv, count(DISTINCT sid) AS sessions FROM f GROUP BY 1, 2""")
def _(T):
    """Flagship: events -> closed bars -> sessions -> realised volatility -> class -> forward range per class."""
    d = mark_sessions(bars(T))

    def build(x, f):
        x = with_atr(vol_class_build(x, f), f)
        w = f.rows(1, 20)
        full = F.count(F.lit(1)).over(w) >= 20
        return x.withColumn("fr", F.when(full & (F.col("atr") > 0), (F.max("high").over(w) - F.min("low").over(w)) / F.col("atr")))
    d = in_chunks(d, build, history=46 + lab.VOL_CLASS_HISTORY, lookahead=20)
    return d.groupBy("symbol", "vol_class").agg(
        F.count(F.lit(1)).alias("n"), F.avg("fr").alias("mean_range"), F.avg("pa_rv_gk_20").alias("mean_rv"),
        F.count_distinct("session_id").alias("sessions"))


@query("label_triple_barrier", "user_id:i bar_no:i barrier:i", """
WITH e AS (SELECT user_id, ts, value, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS bar_no FROM events),
g AS (SELECT *, coalesce(ts - lag(ts) OVER w > INTERVAL 8 HOUR, false) AS brk FROM e WINDOW w AS (PARTITION BY user_id ORDER BY bar_no)),
s AS (SELECT *, sum(brk::int) OVER (PARTITION BY user_id ORDER BY bar_no) AS sid FROM g),
j AS (SELECT a.user_id, a.bar_no, b.bar_no AS b, b.value * 1.1 >= a.value * 1.5 AS up, b.value * 0.9 <= a.value * 0.6 AS dn FROM s a JOIN s b ON a.user_id = b.user_id AND b.sid = a.sid AND b.bar_no BETWEEN a.bar_no + 1 AND a.bar_no + 15),
h AS (SELECT user_id, bar_no, first(CASE WHEN up AND dn THEN 2 WHEN up THEN 0 ELSE 1 END ORDER BY b) AS y FROM j WHERE up OR dn GROUP BY 1, 2)
SELECT s.user_id, s.bar_no, coalesce(y, 2) AS barrier FROM s LEFT JOIN h USING (user_id, bar_no)""")
def _(T):
    from ..operators.layout import number_rows
    e = number_rows(T("events"), ("user_id",), ("ts", "event_id")).withColumns({"high": F.col("value") * 1.1, "low": F.col("value") * 0.9})
    return in_chunks(e, lambda d, f: lab.triple_barrier(d, f, F.col("value") * 1.5, F.col("value") * 0.6, 15, 8.0, "ts"),
                     history=1, lookahead=15, keys=("user_id",))


OUT_COLS = ("outcome:i exit_bar:i max_favorable:d max_adverse:d reward_risk:d decision_mfe_atr:d decision_mae_atr:d decision_peak_bar:i decision_theta_decay:d "
            "decision_net_edge_atr:d optimal_tp_atr:d optimal_sl_atr:d optimal_exit_bar:i optimal_net_edge_atr:d")
OUTCOME = """ent AS (SELECT symbol, bar_no, signal AS s, atr AS a, lead(open) OVER (PARTITION BY symbol ORDER BY bar_no) AS e FROM {src}),
pth AS (SELECT x.symbol, x.bar_no, x.s, x.a, b.bar_no - x.bar_no AS k, CASE WHEN s = 1 THEN b.high - e ELSE e - b.low END AS fav, CASE WHEN s = 1 THEN e - b.low ELSE b.high - e END AS adv
  FROM ent x JOIN {src} b ON x.symbol = b.symbol AND b.bar_no BETWEEN x.bar_no + 1 AND x.bar_no + 30 WHERE s <> 0 AND a > 0),
ex AS (SELECT symbol, bar_no, coalesce(min(k) FILTER (adv >= a OR fav >= 2 * a), max(k)) AS last_k FROM pth GROUP BY 1, 2),
cut AS (SELECT *, fav / a AS fa, adv / a AS aa, fav / a * exp(-greatest(k - 15, 0) / 5.0) - adv / a AS net FROM pth JOIN ex USING (symbol, bar_no) WHERE k <= last_k),
o AS (SELECT symbol, bar_no, max(CASE WHEN k = last_k THEN CASE WHEN adv >= a THEN -1 WHEN fav >= 2 * a THEN 1 ELSE 0 END ELSE -9 END) AS outcome, max(last_k) AS exit_bar,
  greatest(max(fav), 0) AS max_favorable, greatest(max(adv), 0) AS max_adverse, greatest(max(fav), 0) / min(a) AS reward_risk,
  greatest(coalesce(max(fa) FILTER (k <= 20), 0), 0) AS mfe, greatest(coalesce(max(aa) FILTER (k <= 20), 0), 0) AS mae,
  CASE WHEN max(fa) FILTER (k <= 20) > 1e-12 THEN arg_max(k, fa) FILTER (k <= 20) ELSE 0 END AS pk, max(net) AS ne, arg_max(k, net) AS nb, arg_max(fa, net) AS tp, arg_max(aa, net) AS sl FROM cut GROUP BY 1, 2),
outcomes AS (SELECT z.symbol, z.bar_no, coalesce(outcome, 0) AS outcome, coalesce(exit_bar, 0) AS exit_bar, coalesce(max_favorable, 0) AS max_favorable, coalesce(max_adverse, 0) AS max_adverse,
  coalesce(reward_risk, 0) AS reward_risk, coalesce(mfe, 0) AS decision_mfe_atr, coalesce(mae, 0) AS decision_mae_atr, coalesce(pk, 0) AS decision_peak_bar,
  CASE WHEN pk > 0 THEN exp(-greatest(pk - 15, 0) / 5.0) ELSE 1 END AS decision_theta_decay, coalesce(mfe * CASE WHEN pk > 0 THEN exp(-greatest(pk - 15, 0) / 5.0) ELSE 1 END - mae, 0) AS decision_net_edge_atr,
  coalesce(tp, 0) AS optimal_tp_atr, coalesce(sl, 0) AS optimal_sl_atr, coalesce(nb, 0) AS optimal_exit_bar, coalesce(ne, 0) AS optimal_net_edge_atr FROM {src} z LEFT JOIN o USING (symbol, bar_no))"""


@query("label_signal_outcome", "symbol:s bar_no:i " + OUT_COLS, BARS + ", " + A20 + ", sg AS (SELECT *, CASE WHEN close > open THEN 1 WHEN close < open THEN -1 ELSE 0 END AS signal FROM atr20), "
       + OUTCOME.format(src="sg") + " SELECT * FROM outcomes")
def _(T):
    def build(d, f):
        d = with_atr(d, f).withColumn("signal", F.signum(F.col("close") - F.col("open")).cast("int"))
        return lab.signal_outcome(d, f)
    return in_chunks(bars(T), build, history=20, lookahead=30)


RNG = "(max(high) {w} - min(low) {w}) / nullif(atr, 0)"


@query("label_forward_ranges", "symbol:s bar_no:i decision_forward_range_atr:d decision_forward_range_10_atr:d decision_forward_range_15_atr:d decision_forward_range_20_atr:d "
       "decision_forward_range_30_atr:d decision_range_ttp90_norm_30:d", BARS + ", " + A20 + f""", m AS (SELECT *, max(bar_no) OVER (PARTITION BY symbol) AS last_no FROM atr20),
r AS (SELECT *, CASE WHEN bar_no + 20 <= last_no THEN {RNG.format(w=AHEAD.format(20))} END AS r0, {', '.join(f"CASE WHEN bar_no + 30 <= last_no THEN {RNG.format(w=AHEAD.format(n))} END AS r{n}" for n in range(1, 31))} FROM m),
q AS (SELECT *, [{', '.join(f'r{n}' for n in range(1, 31))}] AS rs FROM r)
SELECT symbol, bar_no, r0 AS decision_forward_range_atr, r10 AS decision_forward_range_10_atr, r15 AS decision_forward_range_15_atr, r20 AS decision_forward_range_20_atr, r30 AS decision_forward_range_30_atr,
  CASE WHEN r30 > 1e-12 THEN list_position(list_transform(rs, lambda x: x >= 0.9 * r30 - 1e-12), true) / 30.0 END AS decision_range_ttp90_norm_30 FROM q""")
def _(T):
    return in_chunks(bars(T), lambda d, f: lab.forward_ranges(with_atr(d, f), f), history=20, lookahead=30)


QUAL = f"""qual AS (SELECT *, (volume > 1.5 * avg(volume) OVER p20)::int AS vc, (avg(bar_range) {win(10)} < 0.7 * avg(bar_range) OVER (PARTITION BY symbol ORDER BY bar_no ROWS BETWEEN 29 PRECEDING AND 10 PRECEDING))::int AS cp,
  (is_strong_bull_trend = 1 AND {lagw('is_strong_bull_trend')} = 1)::int AS s1, (is_strong_bear_trend = 1 AND {lagw('is_strong_bear_trend')} = 1)::int AS s2,
  (close > max(high) OVER p20)::int AS b1, (close < min(low) OVER p20)::int AS b2 FROM {{src}} WINDOW p20 AS (PARTITION BY symbol ORDER BY bar_no ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING)),
quality AS (SELECT *, (coalesce(s1, 0) + coalesce(b1, 0) + coalesce(vc, 0) + coalesce(cp, 0) >= 3)::int AS quality_bull_breakout, (coalesce(s2, 0) + coalesce(b2, 0) + coalesce(vc, 0) + coalesce(cp, 0) >= 3)::int AS quality_bear_breakout FROM qual)"""


@query("label_quality_breakouts", "symbol:s bar_no:i quality_bull_breakout:i quality_bear_breakout:i", BARS + ", " + ANATOMY + ", " + QUAL.format(src="anatomy") + " SELECT * FROM quality")
def _(T):
    return in_chunks(shapes.bar_anatomy(bars(T)), lab.quality_breakouts, history=30)


CHG = " + ".join(f"coalesce((is_bull <> {lagw('is_bull', i)})::int, 1)" for i in range(1, 11))


@query("label_range_position", "symbol:s bar_no:i rolling_high:d rolling_low:d tr_position:d direction_changes:i", BARS + ", " + ANATOMY + f"""
SELECT symbol, bar_no, max(high) {win(40)} AS rolling_high, min(low) {win(40)} AS rolling_low, (close - min(low) {win(40)}) / (max(high) {win(40)} - min(low) {win(40)} + 1e-10) AS tr_position,
  {CHG} AS direction_changes FROM anatomy""")
def _(T):
    return in_chunks(shapes.bar_anatomy(bars(T)), lab.range_position, history=40)


PRESS_LABEL = f"""prs AS (SELECT *, avg(close) {win(20)} AS ma, avg(bar_range) {win(20)} AS atr, (close - min(low) {win(40)}) / (max(high) {win(40)} - min(low) {win(40)} + 1e-10) AS tr_position,
  avg(is_bull) {win(10)} * 25 + least(greatest(avg(CASE WHEN is_bull = 1 THEN body_abs ELSE 0 END) {win(10)} / (avg(CASE WHEN is_bear = 1 THEN body_abs ELSE 0 END) {win(10)} + 1e-10), 0), 3) / 3 * 25 + avg(close_position) {win(10)} * 25 + avg(lower_wick_ratio) {win(10)} * 25 AS buy_pressure,
  avg(is_bear) {win(10)} * 25 + least(greatest(1 / (least(greatest(avg(CASE WHEN is_bull = 1 THEN body_abs ELSE 0 END) {win(10)} / (avg(CASE WHEN is_bear = 1 THEN body_abs ELSE 0 END) {win(10)} + 1e-10), 0.33), 3) + 1e-10), 0), 1) * 25 + (1 - avg(close_position) {win(10)}) * 25 + avg(upper_wick_ratio) {win(10)} * 25 AS sell_pressure FROM quality),
lbl AS (SELECT prs.*, pb.h AS h_count, pb.l AS l_count, (pb.pbars >= 20)::int AS endless, CASE WHEN prs.bar_no < 2 THEN 0
  WHEN quality_bull_breakout = 1 THEN 1 WHEN st_ IN (0, 1) AND pb.h = 2 AND close > open AND close > ma THEN 2 WHEN st_ IN (4, 5) AND tr_position < 0.3 AND is_bull = 1 AND buy_pressure > 50 THEN 3
  WHEN st_ IN (0, 1) AND pb.h = 1 AND close > open AND buy_pressure > 60 THEN 4 WHEN quality_bear_breakout = 1 THEN 5 WHEN st_ IN (2, 3) AND pb.l = 2 AND close < open AND close < ma THEN 6
  WHEN st_ IN (4, 5) AND tr_position > 0.7 AND is_bear = 1 AND sell_pressure > 50 THEN 7 ELSE 0 END AS rule FROM (SELECT *, market_state AS st_ FROM prs) prs JOIN pb USING (symbol, bar_no)),
sg AS (SELECT *, CASE WHEN endless = 1 OR rule = 0 THEN 0 WHEN rule <= 4 THEN 1 ELSE -1 END AS signal,
  CASE WHEN endless = 1 THEN 0 WHEN rule IN (1, 5) THEN 90 WHEN rule IN (2, 6) THEN 70 WHEN rule IN (3, 4, 7) THEN 50 ELSE 0 END AS signal_strength,
  CASE WHEN bar_no < 2 THEN '' WHEN endless = 1 THEN 'E22_endless_pullback_skip' ELSE ['', 'E01_quality_bull_breakout', 'E03_H2_bull_pullback', 'E13_TR_bottom_buy', 'H1_bull_pullback', 'E01_quality_bear_breakout', 'L2_bear_pullback', 'E13_TR_top_sell'][rule + 1] END AS signal_reason FROM lbl)"""
STATES_A = f"st AS MATERIALIZED (SELECT *, cast(floor(avg(close) {win(4)} / 8) AS int) % 6 AS market_state FROM anatomy)"


def label_chain(T, warm_up: int = 0):
    """Anatomy, pressure, states, range, pullbacks, breakouts, signals, outcomes; optional warm-up cut."""
    def first(d, f):
        d = shapes.pressure_label(d, f)
        d = d.withColumns({"ma": f.mean("close", 20), "atr": f.mean("bar_range", 20), "market_state": F.floor(f.mean("close", 4) / 8).cast("int") % 6})
        return lab.quality_breakouts(lab.range_position(d, f), f)
    d = in_chunks(shapes.bar_anatomy(bars(T)), first, history=40)
    d = pa.pullback_bars(pa.pullback_counts_rearm(d))
    d = in_chunks(lab.rule_signals(d), lab.signal_outcome, history=0, lookahead=30)
    return d.where(F.col("bar_no") >= warm_up) if warm_up else d


@query("label_chain", "symbol:s bar_no:i market_state:i signal:i signal_strength:i signal_reason:s " + OUT_COLS, BARS_REC + ", " + ANATOMY + ", " + STATES_A + ", " + QUAL.format(src="st") + ", "
       + PULL_B + ", " + PRESS_LABEL + ", " + OUTCOME.format(src="sg") + " SELECT outcomes.*, market_state, signal, signal_strength, signal_reason FROM outcomes JOIN sg USING (symbol, bar_no) WHERE bar_no >= 50")
def _(T):
    return label_chain(T, 50)


@query("label_next_change", "symbol:s bar_no:i changes10:i dist:i", BARS + f""", s AS (SELECT symbol, bar_no, least(cast(floor(close / 20) AS int), 4) AS st FROM bars),
n AS (SELECT a.symbol, a.bar_no, min(b.bar_no) AS nx FROM s a JOIN s b ON a.symbol = b.symbol AND b.bar_no > a.bar_no AND b.st <> a.st GROUP BY 1, 2)
SELECT s.symbol, s.bar_no, coalesce((nx - s.bar_no <= 10)::int, 0) AS changes10, nx - s.bar_no AS dist FROM s LEFT JOIN n USING (symbol, bar_no)""")
def _(T):
    d = bars(T).withColumn("st", F.least(F.floor(F.col("close") / 20), F.lit(4)).cast("int"))
    d = in_chunks(d, lambda x, f: x.withColumn("changes10", lab.changes_within(f, "st", 10)), history=0, lookahead=10)
    return states.bars_to_change(d, "st", "dist")


CHANGE_RATES = """s AS (SELECT symbol, bar_no, (close > 120)::int AS st FROM bars),
c AS (SELECT *, CASE WHEN st <> lag(st) OVER (PARTITION BY symbol ORDER BY bar_no) THEN bar_no END AS chg_at FROM s),
n AS (SELECT *, min(chg_at) OVER (PARTITION BY symbol ORDER BY bar_no ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) - bar_no AS dist FROM c),
rates AS (SELECT h AS horizon, avg(coalesce((dist <= h)::int, 0)) AS rate FROM n, (SELECT unnest(range(1, 121)) AS h) GROUP BY h)"""


def change_rates(T):
    d = states.bars_to_change(bars(T).withColumn("st", (F.col("close") > 120).cast("int")), "st", "dist")
    return states.horizon_rates(d, "dist")


@query("horizon_rates", "horizon:i rate:d", BARS + ", " + CHANGE_RATES + " SELECT * FROM rates")
def _(T):
    return change_rates(T)


@query("horizon_choice", "horizon:i rate:d", BARS + ", " + CHANGE_RATES + " SELECT horizon, rate FROM rates WHERE rate BETWEEN 0.3 AND 0.5 ORDER BY abs(horizon - 2), horizon LIMIT 1")
def _(T):
    return states.choose_horizon(change_rates(T), 0.3, 0.5, 2)


@query("label_future_mean", "symbol:s bar_no:i fm:d dv:d", BARS + f"""
SELECT symbol, bar_no, avg(close) {AHEAD.format(10)} AS fm, least(greatest(close - {lagw('close', 5)}, -50), 50) * CASE WHEN bar_no >= 5 THEN 1 END AS dv FROM bars""")
def _(T):
    return in_chunks(bars(T), lambda d, f: d.withColumns({"fm": lab.future_mean(f, "close", 10), "dv": F.when(f.lag("close", 5).isNotNull(),
                     F.least(F.greatest(f.diff("close", 5), F.lit(-50.0)), F.lit(50.0)))}), history=5, lookahead=10)


@query("label_forward_z", "symbol:s bar_no:i forward_return:d forward_z:d", BARS + f""", r AS (SELECT *, close / nullif({lagw('close')}, 0) - 1 AS r1,
  sum(brk) OVER (PARTITION BY symbol ORDER BY bar_no) AS sid FROM (SELECT *, coalesce((t - {lagw('t')} > INTERVAL 4 HOUR)::int, 0) AS brk FROM bars)),
md AS (SELECT symbol, quantile_cont(abs(r1), 0.5) + 1e-6 AS typ FROM r GROUP BY symbol), s AS (SELECT r.*, typ, {need('r1', 60, 8, 'stddev_samp(r1)')} AS sd FROM r JOIN md USING (symbol)),
f AS (SELECT *, greatest(coalesce({lagw('sd')}, typ), 1e-6) AS vol, CASE WHEN lead(sid, 10) OVER w = sid THEN lead(close, 10) OVER w / nullif(close, 0) - 1 END AS fr FROM s WINDOW w AS (PARTITION BY symbol ORDER BY bar_no))
SELECT symbol, bar_no, fr AS forward_return, CASE WHEN fr IS NOT NULL THEN least(greatest(fr / vol, -5), 5) END AS forward_z FROM f""")
def _(T):
    d = mark_sessions(bars(T))
    moves = in_chunks(d, lambda x, f: x.select("symbol", "bar_no", F.col("_chunk"), F.abs(f.pct("close")).alias("_move")), history=1)
    d = d.join(exact_quantiles(moves, "_move", {"typical": 0.5}, ("symbol",)), "symbol")
    return in_chunks(d, lambda x, f: lab.forward_z(x, f, typical="typical"), history=62, lookahead=10)


@query("label_forward_binary", "symbol:s bar_no:i y:i", BARS + """, f AS (SELECT symbol, bar_no, lead(close, 5) OVER (PARTITION BY symbol ORDER BY bar_no) / nullif(close, 0) - 1 AS fr FROM bars),
b AS (SELECT quantile_cont(abs(fr), 0.2) AS band FROM f WHERE fr IS NOT NULL)
SELECT symbol, bar_no, CASE WHEN fr > band THEN 1 WHEN fr < -band THEN 0 END AS y FROM f, b""")
def _(T):
    d = in_chunks(bars(T), lambda x, f: x.withColumn("fr", div(f.lead("close", 5), "close") - 1.0), history=0, lookahead=5)
    band = exact_quantiles(d.withColumn("m", F.abs("fr")), "m", {"band": 0.2}).scalar()
    d = d.withColumn("band", band)
    return d.withColumn("y", F.when(F.col("fr") > F.col("band"), 1).when(F.col("fr") < -F.col("band"), 0))


@query("label_decision_edge", "symbol:s bar_no:i stored:d by_theta:d by_peak:d", BARS + ", " + A20 + ", sg AS (SELECT *, CASE WHEN close > open THEN 1 WHEN close < open THEN -1 ELSE 0 END AS signal FROM atr20), "
       + OUTCOME.format(src="sg") + """ SELECT symbol, bar_no, decision_net_edge_atr AS stored, least(decision_mfe_atr, 5) * decision_theta_decay - least(decision_mae_atr, 4) AS by_theta,
  least(decision_mfe_atr, 5) * exp(-greatest(decision_peak_bar - 15, 0) / 5.0) - least(decision_mae_atr, 4) AS by_peak FROM outcomes""")
def _(T):
    def build(d, f):
        d = with_atr(d, f).withColumn("signal", F.signum(F.col("close") - F.col("open")).cast("int"))
        return lab.signal_outcome(d, f)
    d = in_chunks(bars(T), build, history=20, lookahead=30)
    stored = lab.decision_edge(d)
    a = d.withColumn("stored", stored).drop("decision_net_edge_atr")
    a = a.withColumn("by_theta", lab.decision_edge(a)).drop("decision_theta_decay")
    return a.withColumn("by_peak", lab.decision_edge(a))


@query("label_forward_up", "symbol:s bar_no:i forward_return:d band:d forward_up:i", BARS + f""", g AS (SELECT *, sum(brk) OVER (PARTITION BY symbol ORDER BY bar_no) AS sid FROM (SELECT *, coalesce((t - {lagw('t')} > INTERVAL 4 HOUR)::int, 0) AS brk FROM bars)),
f AS (SELECT symbol, bar_no, CASE WHEN lead(sid, 5) OVER w = sid THEN (lead(close, 5) OVER w - close) / (abs(close) + 1e-9) END AS fr FROM g WINDOW w AS (PARTITION BY symbol ORDER BY bar_no)),
m AS (SELECT symbol, quantile_cont(fr, 0.5) AS med FROM f WHERE fr IS NOT NULL GROUP BY symbol), k AS (SELECT f.symbol, (1.959963984540054 + 0.8416212335729143) * quantile_cont(abs(fr - med), 0.5) / 0.67448975 AS band FROM f JOIN m USING (symbol) WHERE fr IS NOT NULL GROUP BY f.symbol)
SELECT f.symbol, bar_no, fr AS forward_return, band, CASE WHEN fr IS NOT NULL THEN (fr > band)::int END AS forward_up FROM f JOIN k USING (symbol)""")
def _(T):
    return lab.forward_up(mark_sessions(bars(T)), 5)
