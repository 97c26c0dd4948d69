"""Queries: trade paths, exits, options."""
from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import normal, options as opt
from ..operators import paths as pt
from ..operators.layout import in_chunks
from ..operators.ranks import exact_quantiles
from ..operators.rangejoin import forward_path
from .catalog import query
from .data import BARS, bars
from .q_labels import A20, with_atr

TR = ("symbol", "eb")


def entries(T):
    b = in_chunks(bars(T), with_atr, history=20)
    e = b.where("volume >= 4 and atr > 0").select(
        "symbol", F.col("bar_no").alias("eb"), "bar_no", F.col("t").alias("et"), F.col("close").alias("entry"), "atr",
        F.when(F.col("close") > F.col("open"), 1).otherwise(-1).alias("side"), (F.col("bar_no") % 5).cast("int").alias("regime"))
    return b, e


def path(T):
    b, e = entries(T)
    p = forward_path(e, b, 30, ["t", "open", "high", "low", "close", "volume"]).drop("bar_no")
    p = p.withColumns({"mtm": F.col("side") * (F.col("close") - F.col("entry")) / F.col("entry"),
                       "exit_prob": F.col("volume") / (F.col("volume") + 8.0)})
    return p.withColumns(pt.live_state("side", "entry", "atr"))


PATH = BARS + ", " + A20 + """, ent AS (SELECT symbol, bar_no AS eb, t AS et, close AS entry, atr, CASE WHEN close > open THEN 1 ELSE -1 END AS side, bar_no % 5 AS regime FROM atr20 WHERE volume >= 4 AND atr > 0),
path0 AS (SELECT e.*, b.bar_no - eb AS step, b.t, b.open, b.high, b.low, b.close, b.volume FROM ent e JOIN bars b ON b.symbol = e.symbol AND b.bar_no BETWEEN eb + 1 AND eb + 30),
path AS MATERIALIZED (SELECT *, side * (close - entry) / entry AS mtm, volume / (volume + 8.0) AS exit_prob,
  greatest(0, CASE WHEN side > 0 THEN high - entry ELSE entry - low END / greatest(atr, 1e-6)) AS fav, greatest(0, CASE WHEN side > 0 THEN entry - low ELSE high - entry END / greatest(atr, 1e-6)) AS adv,
  side * (close - entry) / greatest(atr, 1e-6) AS unreal FROM path0)"""
WT = "(PARTITION BY symbol, eb ORDER BY step)"
WP = "(PARTITION BY symbol, eb ORDER BY step ROWS UNBOUNDED PRECEDING)"
WF = "(PARTITION BY symbol, eb ORDER BY step ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)"


@query("path_expansion", "symbol:s eb:i step:i close:d mtm:d fav:d adv:d unreal:d", PATH + " SELECT * FROM path")
def _(T):
    return path(T)


RUN = f"""run AS MATERIALIZED (SELECT *, max(fav) OVER {WP} AS live_mfe, max(adv) OVER {WP} AS live_mae, max(unreal) OVER {WP} AS peak, max(unreal) OVER {WF} AS future_best, min(unreal) OVER {WF} AS future_worst,
  last(unreal) OVER {WF} AS terminal, count(*) OVER (PARTITION BY symbol, eb) AS steps, max(unreal) OVER {WP} - unreal AS drawdown FROM path)"""


def marked(T):
    return pt.running_marks(path(T), TR)


@query("path_running_marks", "symbol:s eb:i step:i live_mfe:d live_mae:d peak:d drawdown:d future_best:d future_worst:d gain_left:d terminal:d remaining:i urgency:d cont:d",
       PATH + ", " + RUN + " SELECT *, future_best - unreal AS gain_left, steps - step AS remaining, CASE WHEN steps = step THEN 1 ELSE (exit_prob > 0.38)::int END AS urgency, "
       "future_best - unreal + 0.2 * greatest(live_mfe - live_mae, 0) AS cont FROM run")
def _(T):
    return marked(T).withColumns({"urgency": F.when(F.col("remaining") == 0, 1).otherwise((F.col("exit_prob") > 0.38).cast("int")),
                                  "cont": pt.continuation("gain_left", F.col("live_mfe") - F.col("live_mae"))})


def lagt(x: str, k: int = 1) -> str:
    return f"lag({x}, {k}) OVER {WT}"


def b3(x: str) -> str:
    return f"({x} - coalesce({lagt(x, 3)}, first({x}) OVER {WP})) / 3.0"


VEL = RUN + f""", v1 AS (SELECT *, volume / 5.0 AS vs, 1.5::double AS pm, {b3('unreal')} AS uv, {b3('drawdown')} AS dv, {b3('live_mae')} AS mv,
  CASE WHEN live_mfe >= coalesce({lagt('live_mfe')}, live_mfe) - 1e-9 THEN step END AS nw, coalesce((unreal < {lagt('unreal')} - 1e-9)::int, 0) AS worse FROM run),
v2 AS (SELECT *, vs - {lagt('vs')} AS d0, step - max(nw) OVER {WP} AS bsm, step - coalesce(max(CASE WHEN worse = 0 THEN step END) OVER {WP}, 1) AS advr FROM v1)"""


@query("path_velocity", "symbol:s eb:i step:i unreal_vel:d unreal_accel:d dd_vel:d mae_vel:d bars_since_mfe:i mfe_stale:i pnl_vs_mfe:d vol_ratio_acc:d edge_cons:d time_cons:d edge_per_rem:d path_smooth:d adverse_run:i mfe_die:i",
       PATH + ", " + VEL + f""" SELECT *, uv AS unreal_vel, CASE WHEN step >= 7 THEN uv - {lagt('uv', 3)} ELSE 0 END AS unreal_accel, dv AS dd_vel, mv AS mae_vel, bsm AS bars_since_mfe, (bsm > 10)::int AS mfe_stale,
  unreal / (live_mfe + 1e-6) AS pnl_vs_mfe, CASE WHEN step >= 3 THEN d0 / (abs({lagt('d0')}) + 1e-6) WHEN step = 2 THEN d0 ELSE 0 END AS vol_ratio_acc, unreal / (1.5 + 1e-6) AS edge_cons, step / 30.0 AS time_cons,
  (1.5 - greatest(unreal, 0)) / greatest(1, 30 - step) AS edge_per_rem, CASE WHEN step > 1 THEN stddev_pop(mtm) OVER {WP} / (abs(avg(mtm) OVER {WP}) + 1e-8) ELSE 0 END AS path_smooth, advr AS adverse_run,
  (live_mfe - coalesce({lagt('live_mfe', 5)}, first(live_mfe) OVER {WP}) < 0)::int AS mfe_die FROM v2""")
def _(T):
    d = marked(T).withColumns({"vol_surprise": F.col("volume") / 5.0, "pred_mfe": F.lit(1.5)})
    return pt.velocity_block(d, TR)


@query("path_trend", "symbol:s eb:i step:i ret_last_3:d ret_last_5:d vol_in_trade:d slope:d", PATH + f""", d AS (SELECT *, mtm - coalesce({lagt('mtm')}, 0) AS dm FROM path)
SELECT symbol, eb, step, mtm - coalesce({lagt('mtm', 3)}, first(mtm) OVER {WP}) AS ret_last_3, mtm - coalesce({lagt('mtm', 5)}, first(mtm) OVER {WP}) AS ret_last_5,
  stddev_pop(dm) OVER {WP} AS vol_in_trade, CASE WHEN step > 1 THEN regr_slope(mtm, step) OVER {WP} ELSE 0 END AS slope FROM d""")
def _(T):
    return pt.trend_block(path(T), TR)


DECAY_SQL = RUN + f""", c0 AS (SELECT *, round(close / (close + 20), 4) AS conf, CASE WHEN close > open THEN 0 WHEN close < open THEN 2 ELSE 1 END AS cls, volume / 10 AS size, round(volume / (volume + 4), 4) AS gate, (eb + step) % 5 AS rn,
  round(entry / (entry + 20), 4) AS conf0, 0.5::double AS gate0, CASE WHEN side > 0 THEN 1 ELSE -1 END AS sg FROM run),
c1 AS (SELECT *, (rn <> regime)::int AS rc, CASE WHEN unreal >= coalesce({lagt('peak')}, unreal) - 1e-9 THEN step END AS top, unreal - coalesce({lagt('unreal')}, 0) AS du FROM c0),
c2 AS (SELECT *, step - max(top) OVER {WP} AS bsp, CASE WHEN sg * du > 0 THEN 0.28 ELSE -0.35 END + CASE WHEN rc = 1 THEN -0.45 ELSE 0 END + CASE WHEN gate - gate0 < -0.12 THEN -0.18 ELSE 0 END AS llr FROM c1)"""


@query("path_decay", "symbol:s eb:i step:i conf_decay:d direction_agree:i regime_changed:i gate_decay:d would_enter:i regret_ratio:d bars_since_peak:i at_new_high:i regret_velocity:d quality:d",
       PATH + ", " + DECAY_SQL + f""" SELECT symbol, eb, step, conf - conf0 AS conf_decay, (CASE cls WHEN 0 THEN 1 WHEN 2 THEN -1 ELSE 0 END = sg)::int AS direction_agree, rc AS regime_changed, gate - gate0 AS gate_decay,
  (conf >= 0.2 AND size >= 0.05 AND cls <> 1)::int AS would_enter, CASE WHEN peak > 1e-6 THEN greatest(0, (peak - unreal) / peak) ELSE 0 END AS regret_ratio, bsp AS bars_since_peak, (top IS NOT NULL)::int AS at_new_high,
  CASE WHEN bsp > 0 THEN drawdown / bsp ELSE 0 END AS regret_velocity,
  1 / (1 + exp(-(ln(least(greatest(conf0, 0.05), 0.95) / (1 - least(greatest(conf0, 0.05), 0.95))) + sum(llr) OVER {WP}))) AS quality FROM c2""")
def _(T):
    k, v = F.col("close"), F.col("volume")
    d = marked(T).withColumns({
        "conf": F.round(k / (k + 20), 4), "cls": F.when(k > F.col("open"), 0).when(k < F.col("open"), 2).otherwise(1), "size": v / 10,
        "gate": F.round(v / (v + 4), 4), "regime_now": ((F.col("eb") + F.col("step")) % 5).cast("int"),
        "conf0": F.round(F.col("entry") / (F.col("entry") + 20), 4), "gate0": F.lit(0.5)})
    return pt.decay_block(d, TR, min_conf=0.2)


@query("path_step_vector", "symbol:s eb:i step:i s0:d s1:d s2:d s3:d s4:d s5:d s6:d s7:d s8:d s9:d s10:d s11:d psum:d", PATH + ", " + RUN + f""", v AS (SELECT *, unreal AS s0, unreal - coalesce({lagt('unreal')}, 0) AS s1, (peak - unreal) / greatest(abs(peak), 1e-6) AS s2,
  least(step, 32) / 32.0 AS s3, sin(2 * pi() * (hour(t) * 60 + minute(t)) / 1440) AS s4, cos(2 * pi() * (hour(t) * 60 + minute(t)) / 1440) AS s5, (close - coalesce({lagt('close')}, entry)) / atr AS s6, (high - low) / atr AS s7,
  volume / 5.0 AS s8, (eb + step) % 5 AS s9, least(live_mfe / 5, 1) AS s10, least(live_mae / 5, 1) AS s11 FROM run)
SELECT *, mtm + side AS psum FROM v""")
def _(T):
    d = marked(T).withColumns({"vol_surprise": F.col("volume") / 5.0, "regime_div": (F.col("eb") + F.col("step")) % 5})
    d = pt.step_vector(d, TR)
    d = pt.position_matrix(d.withColumns({"l3_unreal_pnl_frac": F.col("mtm"), "l3_side": F.col("side")}), 12)
    return d.withColumns({**{f"s{i}": F.col("vec")[i] for i in range(12)}, "psum": F.aggregate("position_x", F.lit(0.0), lambda a, b: a + b)})


@query("exit_labels", "symbol:s eb:i step:i exit_fwd_max:i exit_fwd_return:i exit_vol_side:i remaining_value:i remaining_value_atr:d peak_upside:i peak_upside_both:i", PATH + f""", a AS (
  SELECT *, max(mtm) OVER f5 AS nx, max(abs(mtm)) OVER f5 AS nr, last(unreal) OVER {WF} AS term, count(*) OVER (PARTITION BY symbol, eb) AS n, list(close) OVER r1 AS rest, max(high) OVER r1 AS rh, min(low) OVER r1 AS rl FROM path
  WINDOW f5 AS (PARTITION BY symbol, eb ORDER BY step ROWS BETWEEN 1 FOLLOWING AND 5 FOLLOWING), r1 AS (PARTITION BY symbol, eb ORDER BY step ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING)),
h AS (SELECT *, least(n - step, greatest(5, (n - step) // 2)) AS hh FROM a),
g AS (SELECT *, side * (rest[hh] - close) / atr AS fwd, CASE WHEN side > 0 THEN close - list_min(rest[1:hh]) ELSE list_max(rest[1:hh]) - close END / atr AS worst, atr / entry AS implied FROM h)
SELECT symbol, eb, step, (NOT coalesce(nx - mtm >= 0.0003, false))::int AS exit_fwd_max, CASE WHEN n = step THEN 1 ELSE (fwd < -0.15 OR (fwd < 0.075 AND worst > 2))::int END AS exit_fwd_return,
  CASE WHEN nr IS NULL THEN 1 WHEN side >= 0 THEN (greatest(nr - abs(mtm), 0) < 0.08 * implied * sqrt(step / n))::int ELSE (nr >= implied * 1.5)::int END AS exit_vol_side,
  (term - unreal >= 0)::int AS remaining_value, (term - unreal) / atr AS remaining_value_atr, coalesce((CASE WHEN side > 0 THEN rh - close ELSE close - rl END / atr >= 0.5)::int, 0) AS peak_upside,
  coalesce((greatest(rh - close, close - rl) / atr >= 0.5)::int, 0) AS peak_upside_both FROM g""")
def _(T):
    d = path(T).withColumns({"rng": F.abs("mtm"), "implied": F.col("atr") / F.col("entry")})
    d = pt.label_forward_max(d, TR, "mtm")
    d = pt.label_forward_return(d, TR)
    d = pt.label_vol_side(d, TR, "rng", "implied", "side")
    return pt.value_labels(d, TR)


@query("value_targets", "symbol:s eb:i step:i outcome:i sharpe:d theta:d is_gain:i ternary:i slog:d back:d", PATH + ", " + RUN + """, e AS (SELECT symbol, eb, min(et) AS et, last(unreal ORDER BY step) AS lst FROM run GROUP BY 1, 2),
m AS (SELECT quantile_cont(lst, 0.5) AS med FROM e WHERE et < TIMESTAMP '2024-01-14'), q AS (SELECT quantile_cont(terminal - unreal, 0.01) AS lo, quantile_cont(terminal - unreal, 0.99) AS hi FROM run WHERE et < TIMESTAMP '2024-01-14'),
g AS (SELECT run.*, future_best - unreal AS gl, (lst >= med)::int AS outcome, least(greatest(terminal - unreal, lo), hi) AS y FROM run JOIN (SELECT symbol, eb, lst FROM e) e USING (symbol, eb), m, q)
SELECT symbol, eb, step, outcome, least(greatest(gl / greatest(atr / entry, 1e-4), -50), 50) AS sharpe, gl - atr / entry AS theta, (gl > 0.02)::int AS is_gain, CASE WHEN gl < 0.015 THEN 0 WHEN gl < 0.045 THEN 1 ELSE 2 END AS ternary,
  sign(y) * ln(1 + abs(y)) AS slog, y AS back FROM g""")
def _(T):
    fit = F.col("et") < F.lit("2024-01-14").cast("timestamp_ntz")
    d = pt.trade_outcome_label(marked(T), TR, fit, out="outcome")
    d = d.withColumns({"y0": F.col("terminal") - F.col("unreal"), "rv": F.col("atr") / F.col("entry")})
    lim = exact_quantiles(d.where(fit), "y0", {"lo": 0.01, "hi": 0.99}).select(F.struct("lo", "hi")).scalar()
    d = d.withColumn("lim", lim).withColumn("y", F.least(F.greatest(F.col("y0"), F.col("lim.lo")), F.col("lim.hi")))
    g = "gain_left"
    return d.withColumns({"sharpe": pt.value_target(g, "rv", mode="sharpe"), "theta": pt.value_target(g, theta="rv", mode="theta"),
                          "is_gain": pt.value_target(g, mode="binary"), "ternary": pt.value_target(g, mode="ternary"),
                          "slog": pt.signed_log("y"), "back": pt.signed_exp(pt.signed_log("y"))})


VOTE = f"""w1 AS (SELECT *, max(mtm) OVER {WP} AS pk, avg(exit_prob) OVER bf AS hm, coalesce(stddev_samp(exit_prob) OVER bf, 0) AS hs,
   max(CASE WHEN mtm >= -0.02 THEN step END) OVER {WP} AS dry, max(CASE WHEN mtm >= -0.1 THEN step END) OVER {WP} AS shal,
   (mtm - {lagt('mtm', 2)}) / 2 AS f0, (mtm - {lagt('mtm', 5)}) / 5 AS s0, ({lagt('mtm', 1)} - {lagt('mtm', 3)}) / 2 AS f1, coalesce(({lagt('mtm', 1)} - {lagt('mtm', 6)}) / 5, (mtm - {lagt('mtm', 5)}) / 5) AS s1,
   {lagt('exit_prob', 1)} AS p1, {lagt('exit_prob', 2)} AS p2, [18.0, 19.0, 17.0, 15.0, 15.0][regime + 1] AS mb, [0.04, 0.03, 0.03, 0.05, 0.05][regime + 1] AS dr, least([35, 40, 45, 30, 30][regime + 1], 28) AS cap
   FROM path WINDOW bf AS (PARTITION BY symbol, eb ORDER BY step ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
w2 AS (SELECT *, CASE WHEN step - 1 >= 5 AND hs >= 1e-8 THEN (exit_prob - hm) / hs ELSE 0 END AS z, greatest(pk - mtm, 0) AS fall FROM w1),
w3 AS (SELECT *, step >= 6 AND ((f1 >= s1 AND f0 < s0) OR (f0 < 0 AND s0 < 0)) AS mom,
   step >= 3 AND ((pk > 0.01 AND fall / greatest(pk, 1e-9) > 0.35) OR fall > CASE WHEN pk > 0 THEN least(0.2 + pk * 0.5, 0.4) ELSE 0.15 END OR (mtm < -0.15 AND pk <= 0.02)) AS ddn,
   step > mb AND least(1.0, (step - mb) * dr + 0.5) > 0.6 AS late, exit_prob > 0.38 OR (step >= 2 AND (z > 1 OR (step >= 3 AND p1 > p2 AND exit_prob > p1 AND hs >= 1e-8 AND z > 0.7))) AS model,
   step >= 3 AND (step - coalesce(dry, 0) >= CASE regime WHEN 2 THEN 6 WHEN 3 THEN 5 ELSE 8 END OR step - coalesce(shal, 0) >= 5) AS water, step > cap AS safe FROM w2),
w4 AS (SELECT *, mom::int + ddn::int + late::int + model::int + water::int AS votes FROM w3),
vote AS (SELECT *, CASE WHEN step < greatest(CASE WHEN regime IN (0, 4) THEN 8 ELSE 6 END, 6) THEN 'hold_min' WHEN mom AND ddn AND mtm > 0.01 THEN 'profit_decay' WHEN water THEN 'underwater_bleed' WHEN safe THEN 'regime_safety'
   WHEN late AND model AND NOT mom AND NOT ddn AND mtm <= 0 THEN 'time_model_underwater' WHEN votes >= CASE WHEN mtm > 0.01 THEN 2 ELSE 1 END THEN 'vote_' || votes ELSE 'hold' END AS code FROM w4)"""


def voted(T):
    return pt.exit_vote(path(T).withColumns({"hold_ref": F.lit(6), "max_hold": F.lit(28)}), TR)


@query("exit_vote", "symbol:s eb:i step:i exit_code:s exit_now:b sig_momentum:b sig_drawdown:b sig_time:b sig_model:b sig_underwater:b", PATH + ", " + VOTE + """
SELECT symbol, eb, step, code AS exit_code, code NOT IN ('hold_min', 'hold', 'time_model_underwater') AS exit_now, mom AS sig_momentum, ddn AS sig_drawdown, late AS sig_time, model AS sig_model, water AS sig_underwater FROM vote""")
def _(T):
    return voted(T)


EXITS = VOTE + """, ex AS (SELECT symbol, eb, min(step) FILTER (code NOT IN ('hold_min', 'hold', 'time_model_underwater')) AS es, max(step) AS ls FROM vote GROUP BY 1, 2),
fx AS (SELECT ex.symbol, ex.eb, coalesce(es, ls) AS exit_step, a.unreal AS exit_value, b.unreal AS end_value, a.unreal - b.unreal AS uplift, ls::double AS weight FROM ex
  JOIN path a ON a.symbol = ex.symbol AND a.eb = ex.eb AND a.step = coalesce(es, ls) JOIN path b ON b.symbol = ex.symbol AND b.eb = ex.eb AND b.step = ls)"""


@query("first_exit_uplift", "symbol:s eb:i exit_step:i exit_value:d end_value:d uplift:d weight:d", PATH + ", " + EXITS + " SELECT * FROM fx")
def _(T):
    return pt.first_exits(voted(T), TR, "exit_now")


@query("uplift_score", "n_trades:i mean_uplift:d p10_uplift:d score:d", PATH + ", " + EXITS + """, c AS (SELECT uplift, sum(sum(weight)) OVER (ORDER BY uplift) / sum(sum(weight)) OVER () AS cw FROM fx GROUP BY uplift),
r AS (SELECT count(*) AS n_trades, sum(uplift * weight) / sum(weight) AS mean_uplift, (SELECT min(uplift) FROM c WHERE cw >= 0.1) AS p10_uplift FROM fx) SELECT *, mean_uplift + 0.25 * p10_uplift AS score FROM r""")
def _(T):
    return pt.uplift_score(pt.first_exits(voted(T), TR, "exit_now"))


@query("bar_after_entry", "step:i mean_ret:d median_ret:d win_rate:d is_best:d n_valid:i", PATH + """, b AS (SELECT symbol, eb, first(step ORDER BY mtm DESC, step) AS best FROM path GROUP BY 1, 2)
SELECT step, avg(mtm) AS mean_ret, quantile_cont(mtm, 0.5) AS median_ret, avg((mtm > 0)::int) AS win_rate, avg((best = step)::int) AS is_best, count(*) AS n_valid FROM path JOIN b USING (symbol, eb)
WHERE step IN (1, 2, 3, 5, 10, 15, 20, 30) GROUP BY step""")
def _(T):
    return pt.bar_after_entry(path(T), TR, (1, 2, 3, 5, 10, 15, 20, 30))


BEST = """bb AS (SELECT symbol, eb, regime, first(step ORDER BY mtm DESC, step) AS best_bar, first(step ORDER BY mtm, step) AS worst_bar, max(mtm) AS peak_ret, last(mtm ORDER BY step) FILTER (step <= 10) AS actual_ret FROM path GROUP BY 1, 2, 3)"""


def best(T):
    return pt.best_bars(path(T), TR, F.lit(10), extra=("regime",))


@query("best_bar_regret", "regime:i n:i mean_actual:d mean_peak:d mean_regret:d median_best:d p90_regret:d after2:d", PATH + ", " + BEST + """
SELECT regime, count(*) AS n, avg(actual_ret) AS mean_actual, avg(peak_ret) AS mean_peak, avg(peak_ret - actual_ret) AS mean_regret, quantile_cont(best_bar, 0.5) AS median_best, quantile_cont(peak_ret - actual_ret, 0.9) AS p90_regret, avg((best_bar > 2)::int) AS after2 FROM bb GROUP BY regime""")
def _(T):
    b = best(T)
    g = b.groupBy("regime").agg(F.count(F.lit(1)).alias("n"), F.avg("actual_ret").alias("mean_actual"), F.avg("peak_ret").alias("mean_peak"),
                                F.avg("regret").alias("mean_regret"), F.avg((F.col("best_bar") > 2).cast("int")).alias("after2"))
    return g.join(exact_quantiles(b, "best_bar", {"median_best": 0.5}, ("regime",)), "regime").join(exact_quantiles(b, "regret", {"p90_regret": 0.9}, ("regime",)), "regime")


@query("best_bar_cdf", "bar_cap:i cdf:d", PATH + ", " + BEST + " SELECT cap AS bar_cap, avg((best_bar <= cap)::int) AS cdf FROM bb, (SELECT unnest([1, 2, 3, 5, 10, 15, 20, 30]) AS cap) GROUP BY cap")
def _(T):
    caps = F.explode(F.array(*[F.lit(x) for x in (1, 2, 3, 5, 10, 15, 20, 30)])).alias("bar_cap")
    hist = best(T).groupBy("best_bar").agg(F.count(F.lit(1)).alias("n"))
    return hist.select("best_bar", "n", caps).groupBy("bar_cap").agg((F.sum(F.when(F.col("best_bar") <= F.col("bar_cap"), F.col("n")).otherwise(0)) / F.sum("n")).alias("cdf"))


@query("deadline_value", "symbol:s eb:i at_step:i value:d", PATH + " SELECT symbol, eb, max(step) AS at_step, last(unreal ORDER BY step) AS value FROM path WHERE step <= 12 GROUP BY 1, 2")
def _(T):
    return path(T).where("step <= 12").groupBy(*TR).agg(F.max("step").alias("at_step"), F.max_by("unreal", "step").alias("value"))


@query("bracket_levels", "symbol:s bar_no:i buy:d sell:d tp:d sl:d", BARS + ", " + A20 + " SELECT symbol, bar_no, close + 0.3 * atr AS buy, close - 0.3 * atr AS sell, 2 * atr AS tp, atr AS sl FROM atr20")
def _(T):
    a = F.col("atr")
    return in_chunks(bars(T), with_atr, history=20).withColumns({"buy": F.col("close") + 0.3 * a, "sell": F.col("close") - 0.3 * a, "tp": 2.0 * a, "sl": 1.0 * a})


def phi(x: str) -> str:
    """The same published approximation of the normal distribution function in SQL."""
    def poly(cs, z):
        s = repr(cs[0])
        for k in cs[1:]:
            s = f"({s} * {z} + {k!r})"
        return s
    z = f"abs({x})"
    near = f"exp(-0.5 * {z} * {z}) * {poly([f'{v}::double' for v in normal.HART_P], z)} / {poly([f'{v}::double' for v in normal.HART_Q], z)}".replace("'", "")
    far = f"exp(-0.5 * {z} * {z}) / (({z} + 1 / ({z} + 2 / ({z} + 3 / ({z} + 4 / ({z} + 0.65))))) * 2.506628274631)"
    up = f"CASE WHEN {z} > 37 THEN 0 WHEN {z} < 7.07106781186547 THEN {near} ELSE {far} END"
    return f"CASE WHEN {x} > 0 THEN 1 - ({up}) ELSE {up} END"


OPT = f"""iv AS (SELECT path.*, dte, least(greatest(0.65 * 0.3 + 0.35 * (0.2 + volume / 50), 0.05), 5) AS iv, greatest(dte, 1) / 252.0::double - step / 98280.0::double AS tr, coalesce({lagt('close').replace('symbol, eb', 'symbol, eb, dte')}, entry) AS pcl
  FROM path, (SELECT unnest([7, 14]) AS dte)),
o1 AS (SELECT *, (ln(close / entry) + (0.04 + 0.5 * iv * iv) * tr) / (iv * sqrt(tr)) AS d1, ((0.04 + 0.5 * 0.09) * dte / 252.0::double) / (0.3 * sqrt(dte / 252.0::double)) AS d10 FROM iv),
o2 AS (SELECT *, d1 - iv * sqrt(tr) AS d2, d10 - 0.3 * sqrt(dte / 252.0::double) AS d20 FROM o1),
o3 AS (SELECT *, {phi('d1')} AS n1, {phi('d2')} AS n2, {phi('d10')} AS m1, {phi('d20')} AS m2, exp(-0.5 * d1 * d1) / sqrt(2 * pi()) AS dens FROM o2),
o4 AS (SELECT *, close * (2 * n1 - 1) - entry * exp(-0.04 * tr) * (2 * n2 - 1) AS sv, entry * (2 * m1 - 1) - entry * exp(-0.04 * dte / 252.0::double) * (2 * m2 - 1) AS ev FROM o3)"""


def option_path(T):
    from pyspark.sql import Window
    grid = F.explode(F.array(F.lit(7), F.lit(14)))
    d = path(T).withColumns({"entry_iv": F.lit(0.3), "base_iv": 0.2 + F.col("volume") / 50, "prev_close": F.coalesce(F.lag("close").over(Window.partitionBy(*TR).orderBy("step")), F.col("entry"))})
    return pt.option_marks(d.withColumn("dte", grid))


@query("option_path", "symbol:s eb:i dte:i step:i straddle_value:d entry_value:d pnl:d pnl_pct:d iv:d delta:d gamma:d theta:d vega:d abs_move:d gap_abs:d t_remaining:d", PATH + ", " + OPT + """
SELECT symbol, eb, dte, step, sv AS straddle_value, ev AS entry_value, sv - ev AS pnl, (sv - ev) / ev AS pnl_pct, iv, 2 * n1 - 1 AS delta, 2 * dens / (close * iv * sqrt(tr)) AS gamma,
  (-(close * dens * iv) / sqrt(tr) - 0.04 * entry * exp(-0.04 * tr) * (2 * n2 - 1)) / 252 AS theta, 2 * close * dens * sqrt(tr) / 100 AS vega, abs(close / entry - 1) AS abs_move, abs(open / pcl - 1) AS gap_abs, tr AS t_remaining FROM o4""")
def _(T):
    return option_path(T)


@query("option_spreads", "event_id:i short_put:d long_put:d short_call:d long_call:d credit:d max_loss:d delta:d theta:d vega:d bf_credit:d bf_max_loss:d")
def _(T):
    e = T("events").withColumns({"iv": 0.1 + F.col("user_id") % 30 / 100.0, "tt": (F.col("event_id") % 20 + 1) / 252.0})
    d = opt.short_spread(e, "value", F.col("tt"), F.col("iv"))
    bf = opt.short_spread(d.select("event_id", "value", "tt", "iv"), "value", F.col("tt"), F.col("iv"), condor_delta=None, wing_pct=0.02, prefix="bf_")
    return d.join(bf.select("event_id", "bf_credit", "bf_max_loss"), "event_id")


SCEN = f"""sn AS (SELECT event_type AS scenario, day(ts) AS step, 0.1 + round(avg(value), 4) / 200 AS iv_s FROM events WHERE day(ts) <= 30 GROUP BY 1, 2),
iv AS (SELECT path.*, dte, scenario, least(greatest(iv_s, 0.05), 5) AS iv, dte / 252.0::double - path.step / 98280.0::double AS tr FROM path JOIN sn ON sn.step = path.step, (SELECT unnest([7, 14]) AS dte) WHERE path.step <= least(dte * 390, 20)),
o1 AS (SELECT *, (ln(close / entry) + (0.04 + 0.5 * iv * iv) * tr) / (iv * sqrt(tr)) AS d1, ((0.04 + 0.5 * 0.09) * dte / 252.0::double) / (0.3 * sqrt(dte / 252.0::double)) AS d10 FROM iv),
o2 AS (SELECT *, d1 - iv * sqrt(tr) AS d2, d10 - 0.3 * sqrt(dte / 252.0::double) AS d20 FROM o1), o3 AS (SELECT *, {phi('d1')} AS n1, {phi('d2')} AS n2, {phi('d10')} AS m1, {phi('d20')} AS m2 FROM o2),
o4 AS (SELECT *, close * (2 * n1 - 1) - entry * exp(-0.04 * tr) * (2 * n2 - 1) AS sv, entry * (2 * m1 - 1) - entry * exp(-0.04 * dte / 252.0::double) * (2 * m2 - 1) AS ev FROM o3)"""


@query("option_scenarios", "symbol:s dte:i scenario:s n:i mean_pnl:d worst:d", PATH + ", " + SCEN + """
SELECT symbol, dte, scenario, count(*) AS n, avg(sv - ev) AS mean_pnl, min((sv - ev) / greatest(ev, 1e-9)) AS worst FROM o4 GROUP BY 1, 2, 3""")
def _(T):
    e = T("events").where(F.dayofmonth("ts") <= 30)
    scen = e.groupBy(F.col("event_type").alias("scenario"), F.dayofmonth("ts").alias("step")).agg((0.1 + F.round(F.avg("value"), 4) / 200).alias("iv_s"))
    d = pt.scenario_paths(path(T).withColumns({"entry_iv": F.lit(0.3), "prev_close": F.col("entry")}), scen, (7, 14), most=20)
    d = pt.option_marks(d, iv="iv_s")
    return d.groupBy("symbol", "dte", "scenario").agg(F.count(F.lit(1)).alias("n"), F.avg("pnl").alias("mean_pnl"), F.min("pnl_pct").alias("worst"))
