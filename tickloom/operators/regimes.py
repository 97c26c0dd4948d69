"""Soft states, variance recursions and duration-aware smoothing."""
from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame, functions as F

from ..functions.exprs import clip, fill
from .durable import durable
from .ewm import alpha_of, ewm_mean, ewm_std, reach
from .fold import ordered_fold
from .layout import in_chunks
from .scan import affine_scan
from .sequences import run_of

EPS = 1e-10
# Usual bars per state, and recursion parameters of low and high volatility states.
USUAL_BARS = (24.0, 14.0, 24.0, 14.0, 18.0, 10.0)
GARCH = {"low": (0.05, 0.94), "high": (0.15, 0.80)}
EGARCH = {"low": (-0.30, 0.10, 0.92, -0.06), "high": (-0.18, 0.16, 0.88, -0.10)}
HISTORY = 3 + 2 * reach(alpha_of(30)) + reach(alpha_of(120))


def soft_states(df: DataFrame, keys=("symbol",)) -> DataFrame:
    """log_ret, six scores, state, confidence and its persistence (capped at 40 bars).

    States 0/1 bull, 2/3 bear, 4/5 range with low/high volatility.
    """
    def build(d, f):
        prev = clip(f.lag("close"), EPS)
        d = d.withColumn("log_ret", fill(F.ln(F.greatest(F.col("close"), F.lit(EPS)) / prev), 0.0))
        d = ewm_mean(d, f, "log_ret", "_mu", span=20, least=5)
        d = ewm_std(d, f, "log_ret", "_sd", span=20, least=5)
        d = ewm_std(d, f, "log_ret", "_v", span=30, least=5)
        floor = lambda x: F.when(fill(F.col(x), 0.0) > EPS, F.col(x)).otherwise(EPS)
        d = d.withColumns({"_t": fill(F.col("_mu"), 0.0) / floor("_sd"), "_v": floor("_v")})
        d = ewm_mean(d, f, "_v", "_b", span=120, least=20)
        base = F.greatest(F.coalesce("_b", "_v"), F.lit(EPS))
        d = d.withColumn("_z", clip(F.col("_v") / base - 1.0, -4.0, 4.0))
        t, h = F.col("_t"), 0.5 * F.col("_z")
        flat = -0.90 * F.abs(t) + 0.85 * F.greatest(0.65 - F.abs(t), F.lit(0.0))
        raw = [1.25 * t - h, 1.25 * t + h, -1.25 * t - h, -1.25 * t + h, flat - h, flat + h]
        d = d.withColumn("scores", F.array(*[clip(x, -12.0, 12.0) for x in raw]))
        d = d.withColumn("_top", F.array_max("scores")).withColumn("scores", F.transform("scores", lambda x: x - F.col("_top")))
        d = d.withColumn("_sum", F.aggregate(F.transform("scores", F.exp), F.lit(0.0), lambda a, b: a + b))
        d = d.withColumns({"pa_hmm_state": F.array_position("scores", F.array_max("scores")).cast("int") - 1, "hmm_conf": 1.0 / F.col("_sum")})
        return d.withColumns({"pa_hmm_transition_pressure": 1.0 - F.col("hmm_conf"), "_chg": F.col("pa_hmm_state") != f.lag("pa_hmm_state")})
    d = in_chunks(df, build, history=HISTORY, keys=keys)
    d = run_of(d, {"_run": F.col("_chg")}, keys=keys)
    return d.withColumn("hmm_persist", F.least(F.col("_run"), F.lit(40)) / 40.0).drop("_mu", "_sd", "_v", "_b", "_t", "_z", "_top", "_sum", "_chg", "_run")


def _seeded(df: DataFrame, keys) -> DataFrame:
    """Attach the seed variance of each key: the squared return of its second bar, at least 1e-6."""
    s = df.groupBy(*keys).agg(F.greatest(F.coalesce(F.max(F.when(F.col("bar_no") == 1, F.col("log_ret") * F.col("log_ret"))), F.lit(1e-6)), F.lit(1e-6)).alias("_seed"))
    return df.join(s, list(keys))


def garch(df: DataFrame, keys=("symbol",)) -> DataFrame:
    """Variance with parameters by the state of the bar before; volatility, shock and vol of vol. Needs `soft_states`."""
    d = in_chunks(_seeded(df, keys), lambda x, f: x.withColumns({"_r0": f.lag("log_ret"), "_hv": f.lag("pa_hmm_state").isin(1, 3, 5)}), history=1, keys=keys)
    (al, bl), (ah, bh) = GARCH["low"], GARCH["high"]
    first, hv = F.col("bar_no") == 0, F.col("_hv")
    a = F.when(hv, ah).otherwise(al)
    b = F.when(hv, bh).otherwise(bl)
    omega = F.greatest(F.col("_seed") * (1.0 - a - b), F.lit(1e-10))
    d = affine_scan(d, {"_var": (F.when(first, 0.0).otherwise(b), F.when(first, F.col("_seed")).otherwise(omega + a * F.col("_r0") * F.col("_r0")))}, keys=keys)
    v = F.greatest(F.col("_var"), F.lit(EPS))
    r2 = F.col("log_ret") * F.col("log_ret")

    def build(x, f):
        x = x.withColumns({"pa_garch_vol": F.sqrt(v), "pa_garch_shock": clip(r2 / v - 1.0, -3.0, 6.0)})
        x = ewm_mean(x, f, "pa_garch_vol", "_ma", span=120, least=20)
        base = F.greatest(F.coalesce("_ma", "pa_garch_vol"), F.lit(EPS))
        x = x.withColumns({"pa_garch_vol_of_vol": fill(F.abs(f.diff("pa_garch_vol")) / base, 0.0),
                           "_neg": F.pow(F.least(F.col("log_ret"), F.lit(0.0)), F.lit(2)), "_pos": F.pow(F.greatest(F.col("log_ret"), F.lit(0.0)), F.lit(2))})
        x = ewm_mean(x, f, "_neg", "_dn", span=30, least=5)
        x = ewm_mean(x, f, "_pos", "_up", span=30, least=5)
        dn, up = F.sqrt(fill(F.col("_dn"), 0.0) + EPS), F.sqrt(fill(F.col("_up"), 0.0) + EPS)
        return x.withColumn("pa_egarch_downside_vol_ratio", clip(dn / F.greatest(up, F.lit(EPS)), 0.0, 6.0))
    d = in_chunks(d, build, history=reach(alpha_of(120)) + 1, keys=keys)
    return d.drop("_r0", "_hv", "_var", "_ma", "_neg", "_pos", "_dn", "_up", "_seed")


def smoothed_states(df: DataFrame, keys=("symbol",), warm: int = 256, **kw) -> DataFrame:
    """Re-decide the state with a bonus for staying and a penalty for overstaying; duration and switch columns. Needs `soft_states`."""
    usual = np.asarray(USUAL_BARS)

    def step(pdf, state):
        prev, run = state
        rows = np.vstack(pdf["scores"].to_numpy())
        start = pdf["bar_no"].to_numpy() == 0
        st, du, hz = [], [], []
        for i in range(len(rows)):
            s = rows[i].copy()
            if start[i]:
                prev, run = -1.0, 0.0
            else:
                p = int(prev) if prev >= 0 else int(np.argmax(s))
                share = min((run + 1) / usual[p], 2.0)
                s[p] += 0.45 * max(1.0 - share, 0.0) - 0.35 * max(share - 1.0, 0.0)
            s = np.clip(s, -12.0, 12.0)
            e = np.exp(s - s.max())
            prob = e / e.sum()
            now = int(np.argmax(prob))
            run = run + 1.0 if now == prev else 0.0
            prev = float(now)
            st.append(now)
            du.append(run + 1.0)
            hz.append(float(prob[now]))
        return {"hsmm_state": st, "hsmm_bars": du, "_p": hz}, [prev, run]
    d = ordered_fold(df, step, {"hsmm_state": "int", "hsmm_bars": "double", "_p": "double"}, [-1.0, 0.0], warm=warm, keys=keys, **kw)
    target = F.element_at(F.array(*[F.lit(x) for x in USUAL_BARS]), F.col("hsmm_state") + 1)
    b = F.col("hsmm_bars")
    norm = F.least(b / target, F.lit(2.0))
    return d.withColumns({
        "pa_hsmm_duration_norm": norm, "pa_hsmm_remaining_duration": F.greatest(target - b, F.lit(0.0)) / target,
        "pa_hsmm_duration_percentile": clip(1.0 - F.exp(-b / target), 0.0, 1.0),
        "pa_hsmm_switch_hazard": clip((1.0 - F.col("_p")) + 0.55 * F.greatest(norm - 1.0, F.lit(0.0)), 0.0, 1.0)}).drop("_p")


def egarch(df: DataFrame, keys=("symbol",), warm: int = 512, **kw) -> DataFrame:
    """Asymmetric log-variance recursion driven by the smoothed state; needs `smoothed_states`."""
    d = in_chunks(_seeded(df, keys), lambda x, f: x.withColumns({"_r0": fill(f.lag("log_ret"), 0.0), "_s0": F.coalesce(f.lag("hsmm_state"), F.lit(0))}), history=1, keys=keys)
    mean_abs = math.sqrt(2.0 / math.pi)
    lo, hi = math.log(1e-10), math.log(5e-2)

    def step(pdf, state):
        lv = state[0]
        out, lev = [], []
        for n, r, s, seed in zip(pdf["bar_no"], pdf["_r0"], pdf["_s0"], pdf["_seed"]):
            if n == 0 or math.isnan(lv):
                lv = math.log(max(seed, EPS))
                a = 0.0
            else:
                w, al, be, ga = EGARCH["high" if s in (1, 3, 5) else "low"]
                z = r / max(math.sqrt(max(math.exp(lv), EPS)), EPS)
                a = ga * z
                lv = min(max(w + be * lv + al * (abs(z) - mean_abs) + a, lo), hi)
            out.append(lv)
            lev.append(a)
        return {"_lv": out, "_lev": lev}, [lv]
    d = ordered_fold(d, step, {"_lv": "double", "_lev": "double"}, [float("nan")], warm=warm, keys=keys, **{"tolerance": 1e-12, **kw})
    vol = F.sqrt(F.greatest(F.exp("_lv"), F.lit(EPS)))
    d = d.withColumn("pa_egarch_std_residual", clip(F.col("log_ret") / F.greatest(vol, F.lit(EPS)), -6.0, 6.0))
    return d.withColumns({"pa_egarch_leverage_effect": clip(F.col("_lev"), -2.0, 2.0),
                          "pa_egarch_vol_asymmetry": clip(F.col("pa_egarch_std_residual") * F.col("_lev"), -6.0, 6.0)}).drop("_r0", "_s0", "_seed", "_lv", "_lev")


def volatility_states(df: DataFrame, keys=("symbol",)) -> DataFrame:
    """All blocks together."""
    d = durable(soft_states(df, keys))
    d = durable(garch(d, keys))
    return egarch(smoothed_states(d, keys), keys)
