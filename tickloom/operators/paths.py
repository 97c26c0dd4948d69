"""Operators on trade paths: rows (trade, step), at most `horizon` steps per trade.

All windows are partitioned by trade, so their size is bounded by the horizon.
"""
from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.exprs import c, clip, div, fill, first_of, flag, logistic, yes
from ..functions import options as opt
from .gates import entry_side, lookup

BACK, AHEAD = Window.unboundedPreceding, Window.unboundedFollowing

# Profile per entry regime for the exit vote.
MEDIAN_BEST = {0: 18.0, 1: 19.0, 2: 17.0, 3: 15.0, 4: 15.0}
DECAY_RATE = {0: 0.04, 1: 0.03, 2: 0.03, 3: 0.05, 4: 0.05}
P90_HOLD = {0: 35, 1: 40, 2: 45, 3: 30, 4: 30}
MIN_HOLD_OF_REGIME = {0: 8, 4: 8}
STREAK_OF_REGIME = {2: 6, 3: 5}
VOTES_LOSS_OF_REGIME = {2: 1, 3: 1}
POSITION_COLS = ("l3_unreal_pnl_frac", "l3_drawdown_from_peak_frac", "l3_regime_divergence", "l3_vol_surprise", "l3_log_hold_bars",
                 "l3_hold_bars_sq", "l3_side", "l3_bars_since_peak", "l3_at_new_high", "l3_would_enter_now")
BAYES = {"fav": 0.28, "adv": -0.35, "regime": -0.45, "gate": -0.18, "gate_thr": -0.12}


def of(trade: Sequence[str], step: str = "step"):
    return Window.partitionBy(*trade).orderBy(step)


def live_state(side, entry, atr) -> dict[str, Column]:
    """Favourable and adverse excursion of the bar and unrealised result, in ATR."""
    a = F.greatest(c(atr), F.lit(1e-6))
    s, e = c(side), c(entry)
    up, dn = F.col("high") - e, e - F.col("low")
    return {"fav": F.greatest(F.lit(0.0), F.when(s > 0, up).otherwise(dn) / a), "adv": F.greatest(F.lit(0.0), F.when(s > 0, dn).otherwise(up) / a),
            "unreal": F.when(s > 0, F.col("close") - e).otherwise(e - F.col("close")) / a}


def running_marks(df: DataFrame, trade: Sequence[str], u: str = "unreal", fav: str = "fav", adv: str = "adv") -> DataFrame:
    """Live MFE and MAE, peak, drawdown, best and worst still to come, rows to the end."""
    w = of(trade)
    past, rest = w.rowsBetween(BACK, 0), w.rowsBetween(0, AHEAD)
    whole = Window.partitionBy(*trade)
    d = df.withColumns({
        "live_mfe": F.max(fav).over(past), "live_mae": F.max(adv).over(past), "peak": F.max(u).over(past),
        "future_best": F.max(u).over(rest), "future_worst": F.min(u).over(rest), "terminal": F.last(u).over(w.rowsBetween(0, AHEAD)),
        "steps": F.count(F.lit(1)).over(whole)})
    return d.withColumns({
        "drawdown": F.col("peak") - F.col(u), "gain_left": F.col("future_best") - F.col(u),
        "remaining": F.col("steps") - F.row_number().over(w)})


def velocity_block(df: DataFrame, trade: Sequence[str], *, u="unreal", dd="drawdown", mfe="live_mfe", mae="live_mae", vs="vol_surprise",
                   br="mtm", horizon: int = 30, pred_mfe: str = "pred_mfe", step: str = "step") -> DataFrame:
    """Velocities, staleness, consumption, smoothness and adverse run of a path."""
    w = of(trade, step)
    past = w.rowsBetween(BACK, 0)
    j = F.row_number().over(w) - 1

    def back3(x):
        return F.coalesce(F.lag(x, 3).over(w), F.first(x).over(past))
    th = float(max(1, horizon))
    pm, h = F.col(pred_mfe), F.col(step).cast("double")
    d = df.withColumns({"_j": j, "unreal_vel": (F.col(u) - back3(u)) / 3.0, "dd_vel": (F.col(dd) - back3(dd)) / 3.0,
                        "mae_vel": (F.col(mae) - back3(mae)) / 3.0, "_mx": F.max(mfe).over(past)})
    d = d.withColumns({
        "unreal_accel": F.when(F.col("_j") >= 6, F.col("unreal_vel") - F.lag("unreal_vel", 3).over(w)).otherwise(0.0),
        "_new": F.when(F.col(mfe) >= F.coalesce(F.max(mfe).over(w.rowsBetween(BACK, -1)), F.col(mfe)) - 1e-9, F.col("_j")),
        "_d0": F.col(vs) - F.lag(vs).over(w), "_worse": flag(F.col(u) < F.lag(u).over(w) - 1e-9)})
    d = d.withColumns({"bars_since_mfe": (F.col("_j") - F.max("_new").over(past)).cast("double"), "_d1": F.lag("_d0").over(w),
                       "_ok": F.max(F.when(F.col("_worse") == 0, F.col("_j"))).over(past)})
    rem_e = F.greatest(pm, F.lit(0.0)) - F.greatest(F.col(u), F.lit(0.0))
    mean, sd = F.avg(br).over(past), F.stddev_pop(br).over(past)
    return d.withColumns({
        "mfe_stale": flag(F.col("bars_since_mfe") > max(1.0, th / 3.0)),
        "pnl_vs_mfe": F.col(u) / (F.greatest(F.col(mfe), F.lit(0.0)) + 1e-6),
        "vol_ratio_acc": F.when(F.col("_j") >= 2, F.col("_d0") / (F.abs("_d1") + 1e-6)).when(F.col("_j") == 1, F.col("_d0")).otherwise(0.0),
        "edge_cons": F.col(u) / (F.abs(pm) + 1e-6), "time_cons": h / th,
        "edge_per_rem": rem_e / F.greatest(F.lit(1.0), th - h),
        "path_smooth": F.when(F.col("_j") >= 1, sd / (F.abs(mean) + 1e-8)).otherwise(0.0),
        "adverse_run": F.when(F.col("_j") == 0, 0).otherwise(F.col("_j") - F.coalesce(F.col("_ok"), F.lit(0))),
        "mfe_die": flag(F.col(mfe) - F.coalesce(F.lag(mfe, 5).over(w), F.first(mfe).over(past)) < 0),
    }).drop("_j", "_mx", "_new", "_d0", "_d1", "_worse", "_ok")


def trend_block(df: DataFrame, trade: Sequence[str], br: str = "mtm", step: str = "step") -> DataFrame:
    """3- and 5-step change, running deviation of the steps and running slope of the mark."""
    w = of(trade, step)
    past = w.rowsBetween(BACK, 0)
    first = F.first(br).over(past)
    d = df.withColumn("_d", F.col(br) - F.coalesce(F.lag(br).over(w), F.lit(0.0)))
    n = F.count(F.lit(1)).over(past)
    return d.withColumns({
        "ret_last_3": F.col(br) - F.coalesce(F.lag(br, 3).over(w), first), "ret_last_5": F.col(br) - F.coalesce(F.lag(br, 5).over(w), first),
        "vol_in_trade": F.when(n > 1, F.stddev_pop("_d").over(past)).otherwise(0.0),
        "slope": F.when(n > 1, F.regr_slope(F.col(br), F.col(step).cast("double")).over(past)).otherwise(0.0),
    }).drop("_d")


def decay_block(df: DataFrame, trade: Sequence[str], *, u="unreal", dd="drawdown", side="side", conf="conf", cls="cls", size="size", gate="gate",
                regime="regime_now", conf0="conf0", gate0="gate0", regime0="regime", min_conf: float = 0.0, min_size: float = 0.05) -> DataFrame:
    """Confidence and gate against entry, agreement, would-enter, regret, and a cumulative log-odds quality."""
    w = of(trade)
    past = w.rowsBetween(BACK, 0)
    s = F.when(F.col(side) > 0, 1.0).otherwise(-1.0)
    now = F.when(F.col(cls) == 0, 1.0).when(F.col(cls) == 2, -1.0).otherwise(0.0)
    pk = F.max(u).over(past)
    j = F.row_number().over(w) - 1
    prev_best = F.max(u).over(w.rowsBetween(BACK, -1))
    d = df.withColumns({
        "conf_decay": F.col(conf) - F.col(conf0), "direction_agree": flag(now == s), "regime_changed": flag(F.col(regime) != F.col(regime0)),
        "gate_decay": F.col(gate) - F.col(gate0),
        "would_enter": flag(entry_side(cls, conf, size, min_conf, min_size) != 0),
        "regret_ratio": F.when(pk > 1e-6, F.greatest(F.lit(0.0), (pk - F.col(u)) / pk)).otherwise(0.0),
        "_j": j, "_top": F.when(F.col(u) >= F.coalesce(prev_best, F.col(u)) - 1e-9, j), "_pk": pk,
        "_du": F.col(u) - F.coalesce(F.lag(u).over(w), F.lit(0.0)), "_s": s})
    d = d.withColumns({"bars_since_peak": F.col("_j") - F.max("_top").over(past), "at_new_high": flag(F.col("_top").isNotNull())})
    llr = (F.when(F.col("_s") * F.col("_du") > 0, BAYES["fav"]).otherwise(BAYES["adv"])
           + F.when(F.col("regime_changed") == 1, BAYES["regime"]).otherwise(0.0)
           + F.when(F.col("gate_decay") < BAYES["gate_thr"], BAYES["gate"]).otherwise(0.0))
    p0 = clip(F.col(conf0), 0.05, 0.95)
    d = d.withColumn("_llr", llr)
    return d.withColumns({
        "regret_velocity": F.when(F.col("bars_since_peak") > 0, F.col(dd) / F.col("bars_since_peak")).otherwise(0.0),
        "quality": logistic(F.ln(p0 / (1.0 - p0)) + F.sum("_llr").over(past)),
    }).drop("_j", "_top", "_pk", "_du", "_s", "_llr")


def step_vector(df: DataFrame, trade: Sequence[str], *, u="unreal", atr="atr", vs="vol_surprise", div_="regime_div", mfe="live_mfe", mae="live_mae",
                t="t", most: int = 32, scale: float = 5.0, out: str = "vec") -> DataFrame:
    """Twelve numbers per step: result, change, distance from the peak, hold, clock, bar return and range, surprise, excursions."""
    w = of(trade)
    pk = F.max(u).over(w.rowsBetween(BACK, 0))
    a = F.greatest(F.col(atr), F.lit(1e-6))
    prev_close = F.coalesce(F.lag("close").over(w), F.col("entry"))
    ang = 2.0 * F.pi() * (F.hour(t) * 60 + F.minute(t)) / 1440.0
    return df.withColumn(out, F.array(
        F.col(u), F.col(u) - F.coalesce(F.lag(u).over(w), F.lit(0.0)), (pk - F.col(u)) / F.greatest(F.abs(pk), F.lit(1e-6)),
        F.least(F.col("step"), F.lit(most)) / float(most), F.sin(ang), F.cos(ang), (F.col("close") - prev_close) / a,
        (F.col("high") - F.col("low")) / a, F.col(vs), F.col(div_).cast("double"),
        clip(F.col(mfe) / scale, 0.0, 1.0), clip(F.col(mae) / scale, 0.0, 1.0)))


def position_matrix(df: DataFrame, width: int, out: str = "position_x") -> DataFrame:
    """Position features in fixed order; unknown columns and padding are 0."""
    names = [*POSITION_COLS[:width], *["_pad"] * (width - len(POSITION_COLS))]
    return df.withColumn(out, F.array(*[fill(first_of(df, (n,), 0.0).cast("double"), 0.0) for n in names]))


def label_forward_max(df: DataFrame, trade, x: str, k: int = 5, eps: float = 0.0003, out: str = "exit_fwd_max") -> DataFrame:
    """1 = exit, unless the best of the next k marks beats the present one by eps."""
    best = F.max(x).over(of(trade).rowsBetween(1, k))
    return df.withColumn(out, flag(~yes(best - F.col(x) >= eps)))


def label_forward_return(df: DataFrame, trade, *, side="side", atr="atr", cost: float = 0.15, bad: float = 2.0, weak: float = 0.5,
                         out: str = "exit_fwd_return") -> DataFrame:
    """1 if the return over min(rest, max(5, rest/2)) steps falls below -cost, or is weak after a deep fall; 1 on the last step.

    The horizon differs per row, so the rest of the path is taken as an array and sliced.
    """
    rest = F.collect_list("close").over(of(trade).rowsBetween(1, AHEAD))
    d = df.withColumn("_rest", rest)
    n = F.size("_rest")
    h = F.least(n, F.greatest(F.lit(5), F.floor(n / 2).cast("int")))
    s = F.when(F.col(side) > 0, 1.0).otherwise(-1.0)
    a = F.greatest(F.col(atr), F.lit(1e-9))
    part = F.slice("_rest", F.lit(1), h)
    fwd = s * (F.try_element_at("_rest", h) - F.col("close")) / a
    worst = F.when(s > 0, F.col("close") - F.array_min(part)).otherwise(F.array_max(part) - F.col("close")) / a
    y = (fwd < -cost) | ((fwd < weak * cost) & (worst > bad))
    return d.withColumn(out, F.when(n == 0, 1).otherwise(flag(y))).drop("_rest")


def label_vol_side(df: DataFrame, trade, x: str, implied: str, vol_side: str, k: int = 5, theta: float = 0.08, explode: float = 1.5,
                   out: str = "exit_vol_side") -> DataFrame:
    """Long: exit when the range to come adds less than the theta proxy; short: exit when it explodes past the implied range."""
    w = of(trade)
    best = F.max(x).over(w.rowsBetween(1, k))
    imp = F.greatest(F.col(implied), F.lit(1e-6))
    j = F.row_number().over(w)
    n = F.count(F.lit(1)).over(Window.partitionBy(*trade))
    proxy = theta * imp * F.sqrt(j / n)
    y = F.when(F.col(vol_side) >= 0, F.greatest(best - F.col(x), F.lit(0.0)) < proxy).otherwise(best >= imp * explode)
    return df.withColumn(out, F.when(best.isNull(), 1).otherwise(flag(y)))


def value_labels(df: DataFrame, trade, *, u="unreal", atr="atr", side="side", least: float = 0.5) -> DataFrame:
    """Remaining value (0/1 and in ATR) and peak upside from the next step on."""
    w = of(trade)
    rest = w.rowsBetween(1, AHEAD)
    last = F.last(u).over(w.rowsBetween(0, AHEAD))
    a = F.greatest(F.col(atr), F.lit(1e-9))
    up, dn = (F.max("high").over(rest) - F.col("close")) / a, (F.col("close") - F.min("low").over(rest)) / a
    return df.withColumns({
        "remaining_value": flag(last - F.col(u) >= 0), "remaining_value_atr": (last - F.col(u)) / a,
        "peak_upside": flag(F.when(F.col(side) > 0, up).otherwise(dn) >= least),
        "peak_upside_both": flag(F.greatest(up, dn) >= least)})


def trade_outcome_label(df: DataFrame, trade: Sequence[str], fit: Column, u: str = "unreal", out: str = "trade_outcome") -> DataFrame:
    """1 if the trade's last mark reaches the median of last marks of the trades that have fit rows."""
    from .ranks import exact_quantiles
    last = df.groupBy(*trade).agg(F.max_by(u, "step").alias("_last"), F.max(flag(fit)).alias("_fit"))
    med = exact_quantiles(last.where("_fit = 1"), "_last", {"m": 0.5}).scalar()
    y = last.withColumn("_med", med).select(*trade, flag(F.col("_last") >= F.col("_med")).alias(out))
    return df.join(y, list(trade))


def value_target(gain, rv=None, theta=None, mode: str = "future_gain") -> Column:
    g = c(gain)
    if mode == "sharpe":
        return clip(g / F.greatest(c(rv), F.lit(1e-4)), -50.0, 50.0)
    if mode == "theta":
        return g - F.abs(c(theta))
    if mode == "binary":
        return flag(g > 0.02)
    if mode == "ternary":
        return F.when(g < 0.015, 0).when(g < 0.045, 1).otherwise(2)
    return g


def signed_log(x) -> Column:
    return F.signum(c(x)) * F.log1p(F.abs(c(x)))


def signed_exp(x) -> Column:
    return F.signum(c(x)) * F.expm1(F.abs(c(x)))


def continuation(gain_left, live_edge) -> Column:
    return c(gain_left) + 0.20 * F.greatest(c(live_edge), F.lit(0.0))


def scenario_paths(path: DataFrame, scenarios: DataFrame, dtes: Sequence[int], step: str = "step", most: int | None = None) -> DataFrame:
    """Every path under every (scenario, step, iv) row and days to expiry, up to min(most, 390 x days) steps.

    The scenario table has one row per scenario and step, and the days are a
    short list, so this is an equi join on the step and an explode.
    """
    d = path.join(scenarios, step).withColumn("dte", F.explode(F.array(*[F.lit(int(x)) for x in dtes])))
    limit = F.col("dte") * 390 if most is None else F.least(F.col("dte") * 390, F.lit(most))
    return d.where(F.col(step) <= limit)


def option_marks(path: DataFrame, *, entry="entry", iv0="entry_iv", base_iv="base_iv", dte="dte", step="step", prev_close="prev_close",
                 iv: str | None = None) -> DataFrame:
    """Straddle mark, result and Greeks of every step before expiry.

    The volatility is mixed from entry and present, or given by the column `iv`.
    """
    total = F.greatest(F.col(dte).cast("double"), F.lit(1.0)) / opt.DAYS
    left = total - F.col(step) / (opt.MINUTES * opt.DAYS)
    level = F.col(iv) if iv is not None else 0.65 * F.col(iv0) + 0.35 * F.col(base_iv)
    d = path.withColumns({"t_remaining": left, "iv": clip(level, 0.05, 5.0), "_total": total})
    d = d.where(F.col("t_remaining") > 0)
    d = opt.add_straddle(d, F.col(entry), F.col(entry), F.col("_total"), F.col(iv0), "_e_").withColumn("entry_value", F.col("_e_price"))
    d = d.drop("_total", *[f"_e_{n}" for n in ("price", "delta", "gamma", "theta", "vega")])
    d = opt.add_straddle(d, F.col("close"), F.col(entry), F.col("t_remaining"), F.col("iv")).withColumnRenamed("price", "straddle_value")
    return d.withColumns({
        "pnl": F.col("straddle_value") - F.col("entry_value"),
        "pnl_pct": (F.col("straddle_value") - F.col("entry_value")) / F.greatest(F.col("entry_value"), F.lit(1e-9)),
        "abs_move": F.abs(F.col("close") / F.greatest(F.col(entry), F.lit(1e-9)) - 1.0),
        "gap_abs": F.abs(F.col("open") / F.greatest(F.col(prev_close), F.lit(1e-9)) - 1.0)})


def exit_vote(path: DataFrame, trade: Sequence[str], *, mtm="mtm", prob="exit_prob", regime="regime", held="step", hold_ref="hold_ref",
              max_hold="max_hold", min_hold: int = 6, fast: int = 2, slow: int = 5, z_hi: float = 1.0, z_trend: float = 0.7, min_history: int = 5,
              level: float = 0.38, votes_profit: int = 2, votes_loss: int = 1) -> DataFrame:
    """Per step: the five signals, whether to exit and why, by ordered overrides and votes."""
    w = of(trade, held)
    past, before = w.rowsBetween(BACK, 0), w.rowsBetween(BACK, -1)
    n = F.row_number().over(w)
    rid = F.least(F.greatest(F.col(regime).cast("int"), F.lit(0)), F.lit(4))
    x = F.col(mtm)

    def ma(k, at=0):
        a = x if at == 0 else F.lag(mtm, at).over(w)
        return (a - F.lag(mtm, at + k).over(w)) / float(k)
    f0, s0 = ma(fast), ma(slow)
    f1, s1 = ma(fast, 1), F.coalesce(ma(slow, 1), s0)
    mom = (n >= slow + 1) & (((f1 >= s1) & (f0 < s0)) | ((f0 < 0) & (s0 < 0)))
    peak = F.max(mtm).over(past)
    fall = F.greatest(peak - x, F.lit(0.0))
    tol = F.when(peak > 0, F.least(0.20 + peak * 0.5, F.lit(0.40))).otherwise(0.15)
    dd = (n >= 3) & (((peak > 0.01) & (fall / F.greatest(peak, F.lit(1e-9)) > 0.35)) | (fall > tol) | ((x < -0.15) & (peak <= 0.02)))
    best, decay = lookup(MEDIAN_BEST, rid, 17.0), lookup(DECAY_RATE, rid, 0.04)
    bars = F.col(held)
    late = (bars > best) & (F.least(F.lit(1.0), (bars - best) * decay + 0.5) > 0.6)
    cap = F.when(F.col(max_hold) > 0, F.least(lookup(P90_HOLD, rid, 40), F.col(max_hold))).otherwise(lookup(P90_HOLD, rid, 40))
    safety = (bars > cap) & (cap > 0)
    p = clip(F.col(prob), 0.0, 1.0)
    mean, sd = F.avg(prob).over(before), F.coalesce(F.stddev_samp(prob).over(before), F.lit(0.0))
    z = F.when((n - 1 >= min_history) & (sd >= 1e-8), (p - mean) / sd).otherwise(0.0)
    p1, p2 = F.lag(prob).over(w), F.lag(prob, 2).over(w)
    rising = (n >= 3) & (p1 > p2) & (F.col(prob) > p1)
    model = (p > level) | ((n >= 2) & ((z > z_hi) | (rising & (sd >= 1e-8) & (z > z_trend))))
    dry = F.coalesce(F.max(F.when(x >= -0.02, n)).over(past), F.lit(0))
    shallow = F.coalesce(F.max(F.when(x >= -0.10, n)).over(past), F.lit(0))
    d = path.withColumns({"_n": n, "_mom": yes(mom), "_dd": yes(dd), "_late": yes(late), "_model": yes(model), "_safe": yes(safety)})
    d = d.withColumn("_dry", F.max(F.when(x >= -0.02, F.col("_n"))).over(past)).withColumn("_shal", F.max(F.when(x >= -0.10, F.col("_n"))).over(past))
    streak = F.col("_n") - F.coalesce(F.col("_dry"), F.lit(0))
    deep = F.col("_n") - F.coalesce(F.col("_shal"), F.lit(0))
    water = (F.col("_n") >= 3) & ((streak >= lookup(STREAK_OF_REGIME, rid, 8)) | (deep >= 5))
    d = d.withColumn("_water", yes(water))
    sig = [F.col(s) for s in ("_mom", "_dd", "_late", "_model", "_water")]
    votes = sum((s.cast("int") for s in sig), F.lit(0))
    gain = x > 0.01
    need = F.when(gain, votes_profit).otherwise(lookup(VOTES_LOSS_OF_REGIME, rid, votes_loss))
    floor = F.greatest(lookup(MIN_HOLD_OF_REGIME, rid, min_hold), F.col(hold_ref), F.lit(0))
    code = (F.when(bars < floor, "hold_min")
            .when(F.col("_mom") & F.col("_dd") & gain, "profit_decay")
            .when(F.col("_water"), "underwater_bleed")
            .when(F.col("_safe"), "regime_safety")
            .when(F.col("_late") & F.col("_model") & ~F.col("_mom") & ~F.col("_dd") & (x <= 0.0), "time_model_underwater")
            .when(votes >= need, F.concat(F.lit("vote_"), votes.cast("string"))).otherwise("hold"))
    d = d.withColumn("exit_code", code)
    keep = {"sig_momentum": "_mom", "sig_drawdown": "_dd", "sig_time": "_late", "sig_model": "_model", "sig_underwater": "_water"}
    d = d.withColumns({k: F.col(v) for k, v in keep.items()})
    out = ~F.col("exit_code").isin("hold_min", "time_model_underwater", "hold")
    return d.withColumn("exit_now", out).drop("_n", "_mom", "_dd", "_late", "_model", "_safe", "_dry", "_shal", "_water")


def first_exits(path: DataFrame, trade: Sequence[str], exit_col: str, u: str = "unreal", step: str = "step", weight: str | None = None) -> DataFrame:
    """Per trade: value at the first predicted exit (else the end) less the value at the end, and the trade's weight."""
    x = c(exit_col)
    at = F.when(x, F.col(step))
    g = path.groupBy(*trade).agg(
        F.min(at).alias("exit_step"), F.min_by(u, at).alias("_v"), F.max_by(u, step).alias("end_value"), F.max(step).alias("last_step"),
        (F.sum(weight) if weight else F.count(F.lit(1)).cast("double")).alias("weight"))
    return g.withColumns({"exit_value": F.coalesce("_v", "end_value"), "exit_step": F.coalesce("exit_step", "last_step")}).withColumn(
        "uplift", F.col("exit_value") - F.col("end_value")).drop("_v")


def uplift_score(exits: DataFrame, tail_weight: float = 0.25, keys: Sequence[str] = ()) -> DataFrame:
    """Weighted mean uplift, weighted 10% quantile and their sum with the tail weight."""
    from .metrics import weighted_quantiles
    k = list(keys) or ["_k"]
    d = exits if keys else exits.withColumn("_k", F.lit(1))
    m = d.groupBy(*k).agg((F.sum(F.col("uplift") * F.greatest(F.col("weight"), F.lit(0.0))) / F.sum(F.greatest(F.col("weight"), F.lit(0.0)))).alias("mean_uplift"),
                          F.count(F.lit(1)).alias("n_trades"))
    q = weighted_quantiles(d, "uplift", "weight", {"p10_uplift": 0.1}, k)
    r = m.join(q, k).withColumn("score", F.col("mean_uplift") + tail_weight * F.col("p10_uplift"))
    return r if keys else r.drop("_k")


def bar_after_entry(path: DataFrame, trade: Sequence[str], bars: Sequence[int], ret: str = "mtm") -> DataFrame:
    """Mean, median, win rate and share of trades whose best step is this one, per listed step."""
    from .ranks import exact_quantiles
    best = path.groupBy(*trade).agg(F.max_by("step", F.struct(F.col(ret), -F.col("step"))).alias("_best"))
    d = path.where(F.col("step").isin(list(bars))).join(best, list(trade))
    g = d.groupBy("step").agg(F.avg(ret).alias("mean_ret"), F.avg(flag(F.col(ret) > 0)).alias("win_rate"),
                              F.avg(flag(F.col("_best") == F.col("step"))).alias("is_best"), F.count(F.lit(1)).alias("n_valid"))
    return g.join(exact_quantiles(d, ret, {"median_ret": 0.5}, ("step",)), "step")


def best_bars(path: DataFrame, trade: Sequence[str], actual_step: Column, ret: str = "mtm", extra: Sequence[str] = ()) -> DataFrame:
    """Per trade: best and worst step (first on ties), peak, value at the actual exit, regret."""
    r, s = F.col(ret), F.col("step")
    g = path.groupBy(*trade, *extra).agg(
        F.max_by(s, F.struct(r, -s)).alias("best_bar"), F.min_by(s, F.struct(r, s)).alias("worst_bar"), F.max(r).alias("peak_ret"),
        F.max(s).alias("n_bars"), F.max_by(r, F.when(s <= actual_step, s)).alias("actual_ret"))
    return g.withColumn("regret", F.col("peak_ret") - F.col("actual_ret"))
