"""Breakout columns, weighted structure scores, price-action state, modulation, tags, stacked features."""
from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.exprs import c, clip, fill, first_of, minute_of_day, yes
from .layout import Frames

# Weights of the structure scores over the 0..1 inputs made by `context_inputs`.
ENTRY_BONUS = {"trend_strength": 0.08, "followthrough_quality": 0.04, "range_risk": -0.10, "breakout_failure_risk": -0.08}
SETUP = {
    "pa_ctx_setup_trend_{s}": {"trend_{s}": 0.26, "trend_score": 0.20, "pressure_{s}": 0.18, "consec_{s}": 0.12, "body_push": 0.10, "range_push": 0.08,
                               "close_{s}": 0.08, "gap_{s}": 0.06, "range_score": -0.24, "breakout_fail": -0.20},
    "pa_ctx_setup_pullback_{s}": {"trend_{s}": 0.30, "second_{s}": 0.24, "pullback_{s}": 0.18, "resume": 0.16, "or_{s}": 0.08, "pressure_{s}": 0.08,
                                  "range_score": -0.20, "weakened": -0.12},
    "pa_ctx_setup_range_{s}": {"range_score": 0.38, "tight": 0.18, "bb_tight": 0.14, "inside": 0.12, "or_{s}": 0.10, "close_{o}": 0.08, "open_ctx": 0.06,
                               "trend_score": -0.12},
    "pa_ctx_setup_failed_breakout_{s}": {"breakout_fail": 0.34, "range_score": 0.18, "pressure_{s}": 0.16, "close_{s}": 0.12, "inside": 0.10, "open_ctx": 0.10,
                                         "trend_{o}": -0.12},
    "pa_ctx_follow_through_{s}": {"pressure_{s}": 0.28, "consec_{s}": 0.18, "close_{s}": 0.16, "body_push": 0.14, "range_push": 0.10, "gap_{s}": 0.10,
                                  "inside": -0.20, "breakout_fail": -0.20},
}
SIDES = (("long", "short"), ("short", "long"))

# Modulation weights over the state columns and their clips.
STATE_COLS = ("trend_strength", "followthrough_quality", "range_risk", "pullback_exhaustion", "breakout_failure_risk", "always_in_bias")
MODULATION = {
    "horizon": ({"trend_strength": 0.18, "followthrough_quality": 0.10, "range_risk": -0.22, "breakout_failure_risk": -0.18, "pullback_exhaustion": -0.10}, (0.55, 1.30)),
    "value_target": ({"trend_strength": 0.16, "followthrough_quality": 0.08, "range_risk": -0.18, "breakout_failure_risk": -0.16, "pullback_exhaustion": -0.08}, (0.75, 1.20)),
    "exit_weight": ({"range_risk": 0.24, "breakout_failure_risk": 0.18, "pullback_exhaustion": 0.10, "trend_strength": -0.10}, (0.70, 1.80)),
    "exit_eps": ({"range_risk": 0.25, "breakout_failure_risk": 0.20, "pullback_exhaustion": 0.10, "trend_strength": -0.12, "followthrough_quality": -0.08}, (0.70, 1.60)),
    "loss_buffer": ({"range_risk": -0.18, "breakout_failure_risk": -0.14, "pullback_exhaustion": -0.08, "trend_strength": 0.10}, (0.55, 1.20)),
    "live_edge_floor": ({"range_risk": 0.20, "breakout_failure_risk": 0.18, "trend_strength": -0.12}, (0.60, 1.50)),
    "late_hold": ({"trend_strength": 0.20, "followthrough_quality": 0.10, "range_risk": -0.24, "breakout_failure_risk": -0.20, "pullback_exhaustion": -0.10}, (0.55, 1.25)),
}


def unit(x: Column) -> Column:
    return clip(x, 0.0, 1.0)


def breakout_features(df: DataFrame, f: Frames, atr: str | None = None) -> DataFrame:
    """Fourteen `bo_` columns; run, inside-bar, pressure, opening-range and gap columns are used if there are any. History: 500."""
    o, h, l, k, v = (F.col(x) for x in ("open", "high", "low", "close", "volume"))
    a = F.lit(0.25) if atr is None else F.col(atr)
    d = df.withColumns({"_a": F.when(a > 0.001, a).otherwise(0.001), "_b": F.abs(k - o), "_r": h - l, "_tp": (h + l + k) / 3.0})
    safe = F.when(F.col("_r") > 1e-6, F.col("_r")).otherwise(1e-6)
    have = set(df.columns)
    run = (F.when(k >= o, fill(F.col("consec_bull"), 0.0)).otherwise(-fill(F.col("consec_bear"), 0.0)) if "consec_bull" in have else F.lit(0.0))
    inside = F.coalesce(f.lag("is_inside_bar"), F.lit(0)).cast("double") if "is_inside_bar" in have else F.lit(0.0)
    press = (fill(F.col("pa_bull_pressure"), 0.0) - fill(F.col("pa_bear_pressure"), 0.0)) if "pa_bull_pressure" in have else F.lit(0.0)
    gap = (fill(F.col("gap_up").cast("double"), 0.0) - fill(F.col("gap_down").cast("double"), 0.0)) if "gap_up" in have else F.lit(0.0)
    vm, a20, b5, tm = f.mean("volume", 20), f.mean("_r", 20), f.mean("_b", 5), f.mean("_tp", 20)
    floor = F.lit(1e-6)
    return d.withColumns({
        "bo_body_atr": F.col("_b") / F.col("_a"), "bo_range_atr": F.col("_r") / F.col("_a"),
        "bo_vol_spike": v / F.when(vm > 0, vm).otherwise(1.0),
        "bo_close_extremity": F.when(k >= o, k - l).otherwise(h - k) / safe, "bo_wick_imbalance": ((k - l) - (h - k)) / safe,
        "bo_range_compress": f.mean("_r", 5) / F.greatest(a20, floor), "bo_body_growth": F.col("_b") / F.greatest(b5, floor),
        "bo_gap_signal": gap, "bo_consec_dir": run, "bo_inside_prior": inside, "bo_pressure_diff": press,
        "bo_or_dist": fill((k - F.col("or_mid")) / F.col("_a"), 0.0) if "or_mid" in have else F.lit(0.0),
        "bo_bb_width": F.when(tm > 1e-6, 4.0 * fill(f.std("_tp", 20), 0.0) / tm).otherwise(0.0),
        "bo_atr_zscore": (F.col("_a") - f.mean("_a", 500)) / F.greatest(fill(f.std("_a", 500), 1e-6), floor),
    }).drop("_a", "_b", "_r", "_tp")


def context_inputs(df: DataFrame) -> dict[str, Column]:
    """0..1 inputs of the structure scores from whichever columns are there."""
    def first(names, default=0.0):
        return fill(first_of(df, names, default).cast("double"), default)

    def both(name, x, scale):
        t = 0.5 * F.tanh(x / scale)
        return {f"{name}_long": unit(0.5 + t), f"{name}_short": unit(0.5 - t)}
    td = first(("pa_env_trend_dir",))
    stage = first(("pa_pullback_stage",))
    ext = first(("bo_close_extremity",), 0.5)
    rs = unit(first(("pa_env_range_score_ratio", "pa_regime_range")))
    orx = 0.5 * F.tanh(first(("bo_or_dist",)))
    return {
        **both("pressure", first(("bo_pressure_diff",)), 2.0), **both("consec", first(("bo_consec_dir",)), 3.0), **both("gap", first(("bo_gap_signal",)), 1.0),
        "or_long": unit(0.5 - orx), "or_short": unit(0.5 + orx), "close_long": unit(ext), "close_short": unit(1.0 - ext),
        "body_push": unit(first(("bo_body_growth",)) / 2.5), "range_push": unit(first(("bo_range_atr",)) / 3.0),
        "tight": unit(1.0 - unit(first(("bo_range_compress",), 1.0) / 1.5)), "bb_tight": unit(1.0 - F.tanh(F.greatest(first(("bo_bb_width",)), F.lit(0.0)) * 2.0)),
        "trend_long": unit(td), "trend_short": unit(-td), "trend_score": unit(first(("pa_env_trend_score_ratio", "pa_trend_ratio"))), "range_score": rs,
        "breakout_fail": unit(F.greatest(first(("pa_breakout_likely_fail",)), rs * 0.75)), "weakened": unit(first(("pa_trend_weakened",))),
        "resume": unit((first(("pa_trend_resume_prob",), 0.75) - 0.5) / 0.45), "second_long": unit(first(("pa_is_h2_setup",))),
        "second_short": unit(first(("pa_is_l2_setup",))), "pullback_long": unit(clip(stage, 0.0, 4.0) / 4.0), "pullback_short": unit(clip(-stage, 0.0, 4.0) / 4.0),
        "open_ctx": unit(0.6 * first(("pa_opening_reversal",)) + 0.4 * first(("pa_gap_open_flag",))), "inside": first(("bo_inside_prior", "pa_is_inside_bar")),
    }


def _sum(weights: Mapping[str, float], pick) -> Column:
    total = F.lit(0.0)
    for n, w in weights.items():
        total = total + w * pick(n)
    return total


def structure_context(df: DataFrame) -> DataFrame:
    """Sixteen `pa_ctx_` scores, 0..1."""
    d = df.withColumns({f"_i_{n}": x for n, x in context_inputs(df).items()})
    g = lambda n: F.col(f"_i_{n}")
    d = d.withColumns({name.format(s=s): unit(_sum({n.format(s=s, o=o): w for n, w in weights.items()}, g))
                       for name, weights in SETUP.items() for s, o in SIDES})
    press = first_of(df, ("bo_pressure_diff",), 0.0)
    calm = 1.0 - F.abs(fill(press, 0.0)) / (F.abs(fill(press, 0.0)) + 1.0)
    setups = ("trend", "pullback", "range", "failed_breakout")
    d = d.withColumns({
        **{f"pa_ctx_setup_{s}": F.greatest(*[F.col(f"pa_ctx_setup_{x}_{s}") for x in setups]) for s, _ in SIDES},
        "pa_ctx_range_pressure": unit(0.50 * g("range_score") + 0.18 * g("tight") + 0.12 * g("bb_tight") + 0.10 * g("inside") + 0.10 * calm)})
    fl, fs = F.col("pa_ctx_follow_through_long"), F.col("pa_ctx_follow_through_short")
    d = d.withColumn("pa_ctx_structure_veto", unit(0.42 * F.col("pa_ctx_range_pressure") + 0.28 * g("breakout_fail") + 0.18 * g("weakened") + 0.12 * (1.0 - F.greatest(fl, fs))))
    veto, rp = F.col("pa_ctx_structure_veto"), F.col("pa_ctx_range_pressure")
    d = d.withColumns({
        "pa_ctx_premise_break_long": unit(0.42 * veto + 0.22 * F.col("pa_ctx_setup_short") + 0.20 * F.greatest(fs - fl, F.lit(0.0)) + 0.16 * rp),
        "pa_ctx_premise_break_short": unit(0.42 * veto + 0.22 * F.col("pa_ctx_setup_long") + 0.20 * F.greatest(fl - fs, F.lit(0.0)) + 0.16 * rp)})
    return d.drop(*[n for n in d.columns if n.startswith("_i_")])


def state_scores(df: DataFrame) -> DataFrame:
    """Six `pa_state_` scores from the structure scores."""
    def get(n, default=0.0):
        return unit(fill(first_of(df, (n,), default).cast("double"), default))

    def top(n):
        return F.greatest(get(f"pa_ctx_{n}_long"), get(f"pa_ctx_{n}_short"))

    def first(names):
        return unit(fill(first_of(df, names, 0.0).cast("double"), 0.0))
    stage = unit(F.abs(fill(first_of(df, ("pa_pullback_stage",), 0.0).cast("double"), 0.0)) / 4.0)
    d = df.withColumns({
        "_trend": top("setup_trend"), "_pull": top("setup_pullback"), "_rng": top("setup_range"), "_fb": top("setup_failed_breakout"), "_set": top("setup"),
        "_fol": top("follow_through"), "_pb": top("premise_break"), "_rp": get("pa_ctx_range_pressure"), "_veto": get("pa_ctx_structure_veto"),
        "_ts": first(("pa_env_trend_score_ratio", "pa_trend_ratio")), "_rs": first(("pa_env_range_score_ratio", "pa_regime_range")),
        "_bf": get("pa_breakout_likely_fail"), "_tw": get("pa_trend_weakened"), "_stg": stage})

    def bias(s):
        return 0.58 * get(f"pa_ctx_setup_trend_{s}") + 0.42 * get(f"pa_ctx_follow_through_{s}") + 0.18 * get(f"pa_ctx_setup_{s}")
    d = d.withColumn("pa_state_always_in_bias", clip(F.tanh(2.4 * (bias("long") - bias("short"))), -1.0, 1.0))
    g = lambda n: F.col(f"_{n}")
    lean = F.abs("pa_state_always_in_bias")
    d = d.withColumn("pa_state_trend_strength", unit(0.30 * g("trend") + 0.20 * g("fol") + 0.14 * g("set") + 0.12 * g("ts") + 0.10 * lean
                                                     + 0.08 * (1.0 - g("rp")) + 0.06 * (1.0 - g("veto"))))
    return d.withColumns({
        "pa_state_followthrough_quality": unit(0.46 * g("fol") + 0.14 * F.col("pa_state_trend_strength") + 0.10 * lean + 0.08 * (1.0 - g("bf"))
                                               - 0.14 * g("rp") - 0.08 * g("veto") - 0.06 * g("fb")),
        "pa_state_range_risk": unit(0.38 * g("rp") + 0.20 * g("rng") + 0.14 * g("veto") + 0.10 * g("fb") + 0.10 * (1.0 - g("fol")) + 0.08 * g("rs")),
        "pa_state_pullback_exhaustion": unit(0.34 * g("stg") + 0.24 * g("pull") + 0.16 * g("tw") + 0.12 * g("rp") + 0.08 * g("pb") + 0.06 * g("fb")),
        "pa_state_breakout_failure_risk": unit(0.40 * g("fb") + 0.18 * g("bf") + 0.14 * g("veto") + 0.12 * g("rp") + 0.08 * (1.0 - g("fol")) + 0.08 * g("rs")),
    }).drop(*[n for n in d.columns if n.startswith("_")])


def state_bucket() -> Column:
    """First of breakout, pullback, range, trend that holds, else neutral."""
    s = {n: F.col(f"pa_state_{n}") for n in STATE_COLS}
    return (F.when(s["breakout_failure_risk"] >= 0.60, "breakout_risky")
            .when((s["pullback_exhaustion"] >= 0.58) & (s["trend_strength"] <= 0.72), "pullback_late")
            .when(s["range_risk"] >= 0.57, "range_or_uncertain")
            .when((s["trend_strength"] >= 0.56) & (s["followthrough_quality"] >= 0.52) & (F.abs(s["always_in_bias"]) >= 0.12), "trend_confirmed")
            .otherwise("neutral"))


def modulation(kind: str) -> Column:
    """1 plus the weighted state, clipped."""
    weights, (lo, hi) = MODULATION[kind]
    return clip(1.0 + _sum(weights, lambda n: F.col(f"pa_state_{n}")), lo, hi)


def entry_bonus(entered: Column) -> Column:
    """Aggregate: weighted means of the state over the entered rows, a bonus for entry searches."""
    return _sum(ENTRY_BONUS, lambda n: F.coalesce(F.avg(F.when(entered, F.col(f"pa_state_{n}"))), F.lit(0.0)))


def structure_tags(conditions: Mapping[str, Column]) -> Column:
    """Names of the true conditions joined by a comma, 'None' without any."""
    s = F.concat_ws(", ", *[F.when(yes(x), n) for n, x in conditions.items()])
    return F.when(s == "", "None").otherwise(s)


def normalised(probs) -> Column:
    p = F.transform(c(probs), lambda x: F.greatest(F.coalesce(x, F.lit(0.0)), F.lit(0.0)))
    return F.transform(p, lambda x: x / F.greatest(F.aggregate(p, F.lit(0.0), lambda a, b: a + b), F.lit(1e-12)))


def entropy(probs) -> Column:
    return -F.aggregate(F.transform(c(probs), lambda x: F.greatest(x, F.lit(1e-12)) * F.ln(F.greatest(x, F.lit(1e-12)))), F.lit(0.0), lambda a, b: a + b)


def top2_gap(probs) -> Column:
    s = F.sort_array(c(probs), asc=False)
    return F.get(s, F.lit(0)) - F.coalesce(F.get(s, F.lit(1)), F.lit(0.0))


def kl(p, q) -> Column:
    """Divergence of two probability arrays after clipping at 1e-6 and renormalising."""
    def safe(a):
        x = F.transform(c(a), lambda v: F.least(F.greatest(v, F.lit(1e-6)), F.lit(1.0)))
        return F.transform(x, lambda v: v / F.aggregate(x, F.lit(0.0), lambda s, t: s + t))
    return F.aggregate(F.zip_with(safe(p), safe(q), lambda a, b: a * (F.ln(a) - F.ln(b))), F.lit(0.0), lambda a, b: a + b)


def l2_distance(a, b) -> Column:
    return F.sqrt(F.aggregate(F.zip_with(c(a), c(b), lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, t: s + t))


def change_score(f: Frames, probs) -> Column:
    """Half the summed change of the probabilities from the row before; 0 on the first row."""
    prev = f.lag(probs)
    d = F.aggregate(F.zip_with(c(probs), prev, lambda a, b: F.abs(a - b)), F.lit(0.0), lambda s, t: s + t)
    return fill(0.5 * d, 0.0)


def softmax(scores) -> Column:
    e = F.transform(c(scores), lambda x: F.exp(x - F.array_max(c(scores))))
    return F.transform(e, lambda x: x / F.aggregate(e, F.lit(0.0), lambda a, b: a + b))


def breakout_composite(df: DataFrame, cols) -> Column:
    """Mean of tanh-squashed columns."""
    return clip(_sum({n: 1.0 for n in cols}, lambda n: F.tanh(clip(fill(F.col(n).cast("double"), 0.0), -5.0, 5.0))) / float(len(cols)), -3.0, 3.0)


def interaction(a, b, limit: float = 1e4) -> Column:
    return clip(fill(c(a).cast("double"), 0.0) * fill(c(b).cast("double"), 0.0), -limit, limit)


def _mass(df: DataFrame, names) -> tuple[list[Column], Column]:
    """Values of the columns, missing as 0, and their sum."""
    xs = [fill(F.col(n).cast("double"), 0.0) for n in names]
    total = xs[0]
    for x in xs[1:]:
        total = total + x
    return xs, total


def stacked_features(df: DataFrame, f: Frames, regimes, clusters, *, range_like=(0, 4), tau: float = 0.05, signed_skew: bool = False, lag: int = 5) -> DataFrame:
    """Features of the deciding stage from the stages below it: spread of regimes and clusters, novelty, edge against volatility, breakout
    and threshold, masses of range-like and other regimes, momentum. Missing columns and values count as 0.

    `regimes` and `clusters` name the probability columns; `range_like` are the positions of the regimes that stand for a range.
    """
    num = lambda n: fill(F.col(n).cast("double"), 0.0) if n in df.columns else F.lit(0.0)
    ps, total = _mass(df, regimes)
    probs = F.array(*[p / F.greatest(total, F.lit(1e-12)) for p in ps])
    ordered = F.sort_array(F.array(*_mass(df, clusters)[0]), asc=False)
    d = df.withColumns({"_pr": probs, "_cl": ordered, "_edge": num("l1b_edge_pred"), "_brk": num("l1b_breakout_quality"), "_vol": num("l1a_vol_forecast"),
                        "_trend": num("l1a_vol_trend"), "_nov": num("l1b_novelty_score"), "_mom": fill(F.abs(f.pct("close", lag)), 0.0)})
    edge, brk, vol, trend = (F.col(n) for n in ("_edge", "_brk", "_vol", "_trend"))
    size, ent = F.abs(edge), entropy("_pr")
    ranged = sum((F.col("_pr")[i] for i in range_like), F.lit(0.0))
    other = sum((F.col("_pr")[i] for i in range(len(regimes)) if i not in range_like), F.lit(0.0))
    have = [f"pa_state_{n}" for n in STATE_COLS if f"pa_state_{n}" in df.columns]
    state = _mass(df, have)[1] / float(len(have)) if have else F.lit(0.0)
    mid = (edge + brk) / 2.0
    out = {
        "l1a_regime_entropy": ent, "l1a_regime_top2_gap": top2_gap("_pr"), "l1b_cluster_top1": F.col("_cl")[0], "l1b_cluster_top2_gap": F.col("_cl")[0] - F.get("_cl", F.lit(1)),
        "l1b_novelty_x_vol": F.col("_nov") * vol, "l1b_regime_change_x_entropy": num("l1b_regime_change_score") * ent, "l1b_unsup_pressure": F.col("_cl")[0] - F.get("_cl", F.lit(1)) - F.col("_nov"),
        "l2_l1b_edge_over_tau": edge / max(tau, 1e-3), "l2_vol_adjusted_l1b_edge": edge / F.greatest(vol, F.lit(1e-4)), "l2_edge_x_breakout": edge * brk, "l2_breakout_x_abs_edge": brk * size,
        "l2_signal_strength_mean_abs": size, "l2_signal_spread_var": ((edge - mid) * (edge - mid) + (brk - mid) * (brk - mid)) / 2.0,
        "l2_bull_mass_x_abs_edge": other * size, "l2_range_mass_x_abs_edge": ranged * size, "volatility_regime_adjusted": edge / (F.greatest(vol, F.lit(1e-4)) * (1.0 + F.abs(trend))),
        "l2_directional_pressure": size, "l2_skew_imbalance": trend if signed_skew else F.abs(trend), "l2_order_flow_asymmetry": F.abs(num("pa_state_always_in_bias")),
        "l2_direction_vol_pressure": size * (1.0 + F.least(F.abs(trend), F.lit(3.0))), "l2_recent_momentum_abs": F.col("_mom"), "pa_l1a_regime_interaction": state * ent,
    }
    return d.withColumns(out).drop("_pr", "_cl", "_edge", "_brk", "_vol", "_trend", "_nov", "_mom")


#: Products of two columns under their names.
PRODUCTS = {"l1b_bo_range_x_garch_vol": ("bo_range_atr", "pa_garch_vol"), "l1b_bo_pressure_x_ctx_long": ("bo_pressure_diff", "pa_ctx_setup_long"),
            "l1b_hmm_state_x_garch_vol": ("pa_hmm_state", "pa_garch_vol"), "l1b_session_x_bo_range": ("l1b_session_progress", "bo_range_atr")}


def handcrafted(df: DataFrame, cols, t: str = "t", eps: float = 0.02) -> DataFrame:
    """Breakout mix and activity, share of the day gone, and the products whose columns are there."""
    d = df.withColumns({"l1b_bo_composite": breakout_composite(df, cols), "l1b_bo_active": F.when(F.abs(fill(F.col("bo_range_atr"), 0.0)) > eps, 1.0).otherwise(0.0),
                        "l1b_session_progress": minute_of_day(t) / 1440.0})
    return d.withColumns({n: interaction(*pair) for n, pair in PRODUCTS.items() if set(pair) <= set(d.columns)})
