"""Volatility and volume features on numbered bars.

Every function takes (DataFrame, Frames) and adds columns, so several of them
can share one `in_chunks` pass. HISTORY tells how many rows each reaches back.
"""
from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.exprs import clip, div, fill, flag, minute_of_day, sign
from . import rolling
from .ewm import alpha_of, ewm_mean, ewm_std, reach
from .indicators import day_window
from .layout import Frames, in_chunks
from .order_stats import Order, order_stats
from .scan import long_ewm_std

EPS = 1e-8
MINUTES_PER_YEAR = 252.0 * 390.0
HISTORY = {
    "realised": 46, "straddle": 241, "annualised": 482, "moments": 31, "volume_price": 27,
    "trend_noise": 25 + reach(alpha_of(20)), "jumps": 41 + reach(0.1), "jump_tail": 502 + reach(alpha_of(10)),
    "entropy": 376, "hurst": 63 + reach(alpha_of(10)),
}


def simple_return(f: Frames, x: str = "close") -> Column:
    return fill(f.pct(x), 0.0)


def log_ratio(a, b) -> Column:
    """ln(a / b), 0 where it is not defined."""
    q = div(a, b)
    return fill(F.when(q > 0, F.ln(q)), 0.0)


def realised(df: DataFrame, f: Frames) -> DataFrame:
    """Close-to-close 10 and 20, range-based estimators, slope, ratio, vol of vol, momentum."""
    o, h, l, k = (F.col(x) for x in ("open", "high", "low", "close"))
    d = df.withColumns({"_ret": simple_return(f), "_hl": log_ratio(h, l), "_co": log_ratio(k, o)})
    gk = F.greatest(0.5 * F.col("_hl") * F.col("_hl") - (2.0 * math.log(2.0) - 1.0) * F.col("_co") * F.col("_co"), F.lit(0.0))
    d = d.withColumns({"_pk": F.sqrt(F.col("_hl") * F.col("_hl") / (4.0 * math.log(2.0))), "_gk": F.sqrt(gk)})
    d = d.withColumns({
        "pa_rv_cc_10": fill(f.std("_ret", 10, 2), 0.0), "pa_rv_cc_20": fill(f.std("_ret", 20, 2), 0.0),
        "pa_rv_parkinson_20": fill(f.mean("_pk", 20, 2), 0.0), "pa_rv_gk_20": fill(f.mean("_gk", 20, 2), 0.0)})
    cc20 = F.col("pa_rv_cc_20")
    return d.withColumns({
        "pa_vol_term_slope": F.col("pa_rv_cc_10") - cc20,
        "pa_vol_estimator_ratio": F.col("pa_rv_gk_20") / (cc20 + EPS),
        "pa_vol_of_vol_20": fill(f.std("pa_rv_cc_20", 20, 2), 0.0),
        "pa_vol_momentum": fill(f.diff("pa_rv_cc_20", 5), 0.0),
    }).drop("_hl", "_co", "_pk", "_gk", "_ret")


def straddle(df: DataFrame, f: Frames, expected_bars: int = 10) -> DataFrame:
    """Range-versus-close volatility spreads, regimes and volume pressure; needs `realised`.

    The run length of the volatility regime needs no look-back limit and is
    added by `straddle_duration`.
    """
    rv, pk, h, l, k, v = (F.col(x) for x in ("pa_rv_cc_20", "pa_rv_parkinson_20", "high", "low", "close", "volume"))
    d = df.withColumns({
        "_ret": simple_return(f), "_tp": (h + l + k) / 3.0, "_rng": h - l,
        "_ratio": rv / (pk + EPS), "_d5": f.diff("pa_rv_cc_20", 5)})

    def z(x, n):
        return (F.col(x) - f.mean(x, n, 20)) / (f.std(x, n, 20) + EPS)

    def pct(x, n):
        return F.coalesce(f.pct(x, n), F.lit(0.0))
    d = d.withColumns({
        "_bb": fill(4.0 * f.std("_tp", 20, 5) / (F.nullif(f.mean("_tp", 20, 5), F.lit(0.0)) + EPS), 0.0),
        "_corr": fill(rolling.corr(f, "_ret", "volume", 20, 5), 0.0),
        "_rv60": fill(f.std("_ret", 60, 10), 0.0),
        "_a5": f.mean("_rng", 5), "_a20": f.mean("_rng", 20),
    })
    d = order_stats(d, f, {"_bbr": Order("_bb", 120, "share", 20), "_rvm": Order("pa_rv_cc_20", 60, "quantile", 10)})
    sd120 = F.nullif(f.std("pa_rv_cc_20", 120, 20), F.lit(0.0))
    past = f.sum("_rng", expected_bars)
    expected = f.mean("_rng", expected_bars) * float(expected_bars)
    return d.withColumns({
        "pa_iv_rv_spread": clip((pk - rv) / (rv + EPS), -5.0, 5.0),
        "rv_iv_spread_z_60": clip(fill(z("pa_rv_cc_20", 60) - z("pa_rv_parkinson_20", 60), 0.0), -8.0, 8.0),
        "pa_rv_zscore": fill((rv - f.mean("pa_rv_cc_20", 120, 20)) / (sd120 + EPS), 0.0),
        "pa_rv_acceleration": fill(f.diff("_d5", 5), 0.0),
        "vol_momentum_diff_60": clip(F.when(f.pct("pa_rv_cc_20", 30).isNotNull() & f.pct("pa_rv_parkinson_20", 30).isNotNull(),
                                            f.pct("pa_rv_cc_20", 30) - f.pct("pa_rv_parkinson_20", 30)).otherwise(0.0), -5.0, 5.0),
        "rv_iv_ratio_change_60": clip(pct("_ratio", 15), -5.0, 5.0),
        "pa_bb_width_pctile": clip(fill(F.col("_bbr"), 0.5), 0.0, 1.0),
        "pa_atr_ratio_5_20": clip(fill(F.col("_a5") / (F.col("_a20") + EPS), 1.0), 0.0, 5.0),
        "pa_rv_term_slope": F.col("pa_rv_cc_10") - F.col("_rv60"),
        "pa_vol_high": flag(rv > F.col("_rvm")),
        "pa_realized_vs_expected": clip(fill(past / (expected + EPS), 0.0), 0.0, 10.0),
        "pa_volume_zscore": clip(fill((v - f.mean("volume", 60, 10)) / (F.nullif(f.std("volume", 60, 10), F.lit(0.0)) + EPS), 0.0), -6.0, 6.0),
        "pa_volume_price_corr": clip(fill(f.diff("_corr", 5), 0.0), -2.0, 2.0),
    }).drop("_ret", "_tp", "_rng", "_ratio", "_d5", "_bb", "_corr", "_rv60", "_a5", "_a20", "_bbr", "_rvm")


def straddle_duration(df: DataFrame, **kw) -> DataFrame:
    """Bars in the current high or low volatility regime over 200, at most 1."""
    from .sequences import run_of
    d = in_chunks(df, lambda x, f: x.withColumn("_chg", F.col("pa_vol_high") != f.lag("pa_vol_high")), history=1, **kw)
    d = run_of(d, {"_run": F.col("_chg")}, **kw)
    return d.withColumn("pa_vol_regime_duration", F.least((F.col("_run") + 1) / 200.0, F.lit(1.0))).drop("_chg", "_run")


def annualised(df: DataFrame, f: Frames, t: str = "t") -> DataFrame:
    """Annualised close, range and open-high-low-close volatilities and their companions; missing becomes 0."""
    o, h, l, k, v = (F.col(x) for x in ("open", "high", "low", "close", "volume"))
    year = math.sqrt(MINUTES_PER_YEAR)
    floor = F.lit(1e-12)
    prev = f.lag("close")
    u, dn, cc = F.ln(h / F.greatest(o, floor)), F.ln(F.greatest(l, floor) / F.greatest(o, floor)), F.ln(k / F.greatest(o, floor))
    d = df.withColumns({
        "_lr": F.when((k > 0) & (prev > 0), F.ln(k / prev)),
        "_hl2": F.pow(F.ln(h / F.greatest(l, floor)), F.lit(2)) / (4.0 * math.log(2.0)),
        "_gk": 0.5 * F.pow(u - dn, F.lit(2)) - (2.0 * math.log(2.0) - 1.0) * F.pow(cc, F.lit(2)),
        "_am": F.abs(k - prev),
    })
    cols = {}
    for n in (5, 15, 30, 60, 120, 390):
        cols[f"rv_{n}"] = f.std("_lr", n, max(3, n // 3)) * year
    for n in (15, 30, 60, 390):
        cols[f"parkinson_vol_{n}"] = F.sqrt(F.greatest(f.mean("_hl2", n, max(5, n // 3)), F.lit(0.0))) * year
    for n in (30, 60, 390):
        m = f.mean("_gk", n, max(5, n // 3))
        cols[f"gk_vol_{n}"] = F.when(m.isNotNull(), F.sqrt(F.greatest(m, F.lit(0.0))) * year)
    for n in (15, 30, 60, 390):
        cols[f"parkinson_vol_{n}"] = F.when(f.mean("_hl2", n, max(5, n // 3)).isNotNull(), cols[f"parkinson_vol_{n}"])
    for n in (5, 15, 30, 60):
        cols[f"abs_return_{n}"] = F.abs(f.pct("close", n))
    d = d.withColumns(cols)
    opening = minute_of_day(t) == 570
    spread = f.max("high", 390, 30) - f.min("low", 390, 30)
    sd = F.nullif(f.std("volume", 390, 20), F.lit(0.0))
    more = {
        "rv_acceleration": f.diff("rv_30", 30),
        "vol_of_vol": f.std("rv_30", 60, 10),
        "intraday_range": spread,
        "range_vs_close": F.try_divide(spread, k),
        "volume_zscore": (v - f.mean("volume", 390, 20)) / sd,
        "efficiency_ratio": F.try_divide(F.abs(f.diff("close", 30)), f.sum("_am", 30, 5)),
        "is_open": flag(opening),
        "gap": F.when(opening, F.try_divide(o - prev, prev)).otherwise(0.0),
        "minute_of_day": minute_of_day(t), "day_of_week": F.weekday(t),
    }
    d = d.withColumns(more)
    d = d.withColumn("volume_spike", flag(F.col("volume_zscore") > 2.0))
    names = [*cols, *[n for n in more if n not in ("is_open", "minute_of_day", "day_of_week")]]
    return d.withColumns({n: fill(F.col(n), 0.0) for n in names}).drop("_lr", "_hl2", "_gk", "_am")


def moments(df: DataFrame, f: Frames) -> DataFrame:
    d = df.withColumn("_ret", simple_return(f))
    d = d.withColumns({"pa_realized_skew_20": fill(rolling.skew(f, "_ret", 20, 5), 0.0),
                       "pa_realized_kurt_20": fill(rolling.kurt(f, "_ret", 20, 5), 0.0)})
    return d.withColumn("pa_skew_change_10", fill(f.diff("pa_realized_skew_20", 10), 0.0)).drop("_ret")


def volume_price(df: DataFrame, f: Frames) -> DataFrame:
    """Volume-price correlation, acceleration, illiquidity and the change of signed volume over 10 bars."""
    v = F.col("volume")
    d = df.withColumn("_ret", simple_return(f))
    d = d.withColumns({"_ill": F.abs("_ret") / (v + EPS), "_sv": v * sign(F.col("_ret"))})
    return d.withColumns({
        "pa_vol_price_diverge": fill(rolling.corr(f, "_ret", "volume", 20, 5), 0.0),
        "pa_volume_acceleration": fill(f.diff("volume") / (f.mean("volume", 10, 2) + EPS), 0.0),
        "pa_amihud_illiq_20": fill(f.mean("_ill", 20, 2), 0.0),
        "pa_obv_slope_10": F.when(F.col(f.pos) >= 10, f.sum("_sv", 10)).otherwise(0.0),
    }).drop("_ret", "_ill", "_sv")


def vwap_deviation(df: DataFrame, t: str = "t") -> DataFrame:
    """Close against the day's volume-weighted average price."""
    w = day_window(t).rowsBetween(Window.unboundedPreceding, 0)
    tp = (F.col("high") + F.col("low") + F.col("close")) / 3.0
    vwap = F.sum(tp * F.col("volume")).over(w) / (F.sum("volume").over(w) + EPS)
    return df.withColumn("pa_vwap_deviation", fill((F.col("close") - vwap) / (vwap + EPS), 0.0))


def day_clock(df: DataFrame, t: str = "t") -> DataFrame:
    """Session progress over 390 minutes, return from the day's open, volume against the day's mean so far."""
    w = day_window(t)
    upto = w.rowsBetween(Window.unboundedPreceding, 0)
    first = F.first("open").over(upto)
    minutes = (F.hour(t) * 3600 + F.minute(t) * 60 + F.second(t) - 570 * 60) / 60.0
    return df.withColumns({
        "pa_time_session_progress": clip(minutes / 390.0, 0.0, 1.0),
        "pa_time_from_open_return": fill((F.col("close") - first) / (first + EPS), 0.0),
        "pa_time_vol_time_deviation": fill(F.col("volume") - F.avg("volume").over(upto), 0.0),
    })


def trend_noise(df: DataFrame, f: Frames) -> DataFrame:
    """Exponential trend against the rest."""
    d = ewm_mean(df, f, "close", "_tr", span=20)
    d = d.withColumns({"_tv": F.abs(f.diff("_tr")), "_nv": F.abs(F.col("close") - F.col("_tr"))})
    tv, nv = f.mean("_tv", 20, 2), f.mean("_nv", 20, 2)
    return d.withColumns({
        "pa_trend_ratio": fill(tv / (nv + EPS), 0.0),
        "pa_noise_ratio": fill(nv / (tv + nv + EPS), 0.0),
        "pa_trend_slope": fill(f.diff("_tr", 5), 0.0),
    }).drop("_tr", "_tv", "_nv")


def jumps(df: DataFrame, f: Frames) -> DataFrame:
    """Moves beyond three deviations: decaying intensity and count over 20 bars."""
    d = df.withColumn("_abs", F.abs(simple_return(f)))
    sd = F.greatest(fill(f.std("_abs", 20, 2), 0.001), F.lit(1e-5))
    d = d.withColumn("_jump", F.when(F.col("_abs") > 3 * sd, F.col("_abs")).otherwise(0.0))
    d = ewm_mean(d, f, "_jump", "pa_hawkes_intensity", alpha=0.1)
    return d.withColumn("pa_hawkes_clustering_20", f.sum(flag(F.col("_jump") > 0), 20)).drop("_abs", "_jump")


def jump_tail(df: DataFrame, f: Frames, window: int = 100, tail: int = 500) -> DataFrame:
    """Excess of a move over max(99th percentile, 3 deviations), smoothed; and its z-score."""
    d = df.withColumn("_ret", simple_return(f)).withColumn("_abs", F.abs("_ret"))
    d = order_stats(d, f, {"_q": Order("_abs", tail, "quantile", q=0.99)})
    sd = F.greatest(fill(f.std("_ret", window), 0.0), F.lit(1e-8))
    d = d.withColumns({"_sd": sd, "_thr": F.greatest(fill(F.col("_q"), 1e-8), 3.0 * sd)})
    d = d.withColumn("_j", F.when(F.col("_abs") > F.col("_thr"), F.try_divide(F.col("_abs") - F.col("_thr"), F.col("_thr"))).otherwise(0.0))
    d = ewm_mean(d, f, "_j", "pa_jump_tail_risk", span=10)
    return d.withColumn("pa_jump_z_score", fill((F.col("_ret") - f.mean("_ret", window)) / F.col("_sd"), 0.0)).drop(
        "_ret", "_abs", "_sd", "_thr", "_j", "_q")


def entropy(df: DataFrame, f: Frames, window: int = 75) -> DataFrame:
    """Entropy of five return classes over the window, 1 = evenly spread."""
    d = df.withColumn("_ret", simple_return(f))
    d = d.withColumn("_vol", F.greatest(fill(f.std("_ret", 4 * window), 1e-5), F.lit(1e-5)))
    r, v = F.col("_ret"), F.col("_vol")
    d = d.withColumn("_cls", F.when(r < -1.5 * v, 0).when(r < -0.25 * v, 1).when(r <= 0.25 * v, 2).when(r <= 1.5 * v, 3).otherwise(4))
    total = F.lit(0.0)
    for i in range(5):
        p = clip(f.mean(flag(F.col("_cls") == i), window), 1e-8, 1.0)
        total = total - p * F.log2(p)
    return d.withColumn(f"pa_entropy_{window}", total / math.log2(5)).drop("_ret", "_vol", "_cls")


def hurst(df: DataFrame, f: Frames) -> DataFrame:
    """Smoothed variance-ratio exponent over 20 and 60 bars."""
    prev = F.coalesce(f.lag("close"), F.col("close"))
    d = df.withColumn("_r1", F.when((F.col("close") > 0) & (prev > 0), F.ln(div("close", prev))))
    d = d.withColumn("_r2", F.col("_r1") + fill(f.lag("_r1"), 0.0))
    for n, span in ((20, 5), (60, 10)):
        v1 = fill(f.agg(F.var_samp, "_r1", n, 2), 1e-8)
        v2 = fill(f.agg(F.var_samp, "_r2", n, 2), 1e-8)
        raw = 0.5 * F.ln(F.greatest(v2, F.lit(1e-8)) / F.greatest(v1 * 2, F.lit(1e-8))) / math.log(2) + 0.5
        d = d.withColumn(f"_h{n}", clip(raw, 0.0, 1.0))
        d = ewm_mean(d, f, f"_h{n}", f"pa_hurst_{n}", span=span).drop(f"_h{n}")
    return d.drop("_r1", "_r2")


def index_features(df: DataFrame, f: Frames, scale: int = 390) -> DataFrame:
    """Level, range, rank and acceleration features of a volatility index.

    `scale` is the number of bars in a day; the published windows are 390 and
    five times 390 one-minute bars.
    """
    day, week, least, long_least = scale, 5 * scale, max(2, scale * 60 // 390), scale
    k = F.col("close")
    ratio = lambda n, m: k / (f.mean("close", n, m) + EPS)
    d = df.withColumns({
        "_ret": f.pct("close"),
        "vixy_level_ma60_ratio": ratio(60, 20), "vixy_level_ma390_ratio": ratio(day, least),
        "vixy_level_ma1950_ratio": ratio(week, long_least),
        "vixy_zscore_390": (k - f.mean("close", day, least)) / (f.std("close", day, least) + EPS),
        "vixy_zscore_60": (k - f.mean("close", 60, 20)) / (f.std("close", 60, 20) + EPS),
        "vixy_ret_30": f.pct("close", 30), "vixy_ret_60": f.pct("close", 60),
        **{f"vixy_abs_ret_{n}": F.abs(f.pct("close", n)) for n in (5, 15, 30, 60)},
        "_rh": f.max("high", day, least), "_rl": f.min("low", day, least), "_vm": f.mean("volume", day, least),
    })
    d = order_stats(d, f, {"vixy_pct_rank_5d": Order("close", week, "rank", long_least)})
    d = d.withColumns({
        "vixy_term_structure_slope": F.col("vixy_level_ma60_ratio") - F.col("vixy_level_ma390_ratio"),
        "vixy_proxy_momentum_30": f.diff("vixy_zscore_60", 30),
        "vixy_accel_5": f.diff("vixy_abs_ret_5", 5), "vixy_accel_15": f.diff("vixy_abs_ret_15", 15),
        "vixy_rvol_60": f.std("_ret", 60, 20) * math.sqrt(390.0), "vixy_rvol_390": f.std("_ret", day, least) * math.sqrt(390.0),
        "vixy_intraday_range": (F.col("_rh") - F.col("_rl")) / (k + EPS),
        "vixy_intraday_rank": (k - F.col("_rl")) / (F.col("_rh") - F.col("_rl") + EPS),
        "vixy_vol_surge": F.col("volume") / (F.col("_vm") + 1), "vixy_vol_surge_5": f.mean("volume", 5, 5) / (F.col("_vm") + 1),
    })
    d = order_stats(d, f, {"_mid": Order("vixy_intraday_range", day, "quantile", least)})
    a5, a15 = F.col("vixy_accel_5"), F.col("vixy_accel_15")
    z = fill(F.col("vixy_zscore_390"), 0.0)
    return d.withColumns({
        "vixy_accel_5_over_15": a5 / (F.abs(a15) + EPS), "vixy_accel_burst_minus_drift": a5 - a15,
        "vixy_acceleration_2nd": f.diff("vixy_accel_5", 5),
        "vixy_rvol_ratio": F.col("vixy_rvol_60") / (F.col("vixy_rvol_390") + EPS),
        "vixy_realized_vs_implied_gap": F.col("vixy_rvol_60") - F.col("vixy_abs_ret_30") * math.sqrt(390.0 / 30.0),
        "vixy_intraday_range_ratio": F.col("vixy_intraday_range") / (F.col("_mid") + EPS),
        "vixy_regime": F.when(z > 1.0, 2).when(z < -1.0, 0).otherwise(1),
    }).drop("_ret", "_rh", "_rl", "_vm", "_mid")


def index_history(scale: int = 390) -> int:
    return 5 * scale + 2 * scale + 62


def index_duration(df: DataFrame, **kw) -> DataFrame:
    """Bars in the current index regime, starting at 1."""
    from .sequences import run_of
    d = in_chunks(df, lambda x, f: x.withColumn("_chg", F.col("vixy_regime") != f.lag("vixy_regime")), history=1, **kw)
    return run_of(d, {"_run": F.col("_chg")}, **kw).withColumn("vixy_regime_duration", F.col("_run") + 1.0).drop("_chg", "_run")


def attach_index(bars: DataFrame, index: DataFrame, cols, *, limit: int = 5, keys=("symbol",), t: str = "t") -> DataFrame:
    """Index columns at the same time, else carried over at most `limit` rows of the bar table."""
    j = bars.join(index.select(t, F.struct(*cols).alias("_ix")), t, "left")

    def build(d, f):
        return d.withColumns({n: F.last(F.col(f"_ix.{n}"), ignorenulls=True).over(f.rows(-limit, 0)) for n in cols})
    return in_chunks(j, build, history=limit, keys=keys).drop("_ix")


def base_iv(df: DataFrame, span: int = 1950, premium: float = 0.02, keys=("symbol",)) -> DataFrame:
    """Blend of exponential, 390-bar and open-high-low-close volatility plus a premium; needs `annualised`.

    `annualised` turns missing values into 0, and 0 volatility is kept as it is. The span reaches far behind a chunk, so its
    recursion is an exact scan instead of a frame.
    """
    def move(x, f):
        prev = f.lag("close")
        return x.withColumn("_lr", fill(F.when((F.col("close") > 0) & (prev > 0), F.ln(F.col("close") / prev)), 0.0))
    d = long_ewm_std(in_chunks(df, move, history=1, keys=keys), "_lr", "_ew", span=max(10, span), keys=keys)
    ew = fill(F.col("_ew"), 0.0) * math.sqrt(MINUTES_PER_YEAR)
    blend = 0.55 * ew + 0.25 * F.coalesce(F.col("gk_vol_390"), ew) + 0.20 * F.coalesce(F.col("rv_390"), ew)
    return d.withColumn("l3_base_iv", clip(blend + premium, 0.05, 5.0)).drop("_lr", "_ew")


def ewm_z_spread(df: DataFrame, f: Frames, a: str, b: str, span: int = 180) -> DataFrame:
    """Difference of two exponential z-scores, and of the 30- and 15-bar changes of their logs."""
    d, least = df, max(20, span // 6)
    for n, x in (("_za", a), ("_zb", b)):
        d = ewm_mean(d, f, x, n + "m", span=span, least=least)
        d = ewm_std(d, f, x, n + "s", span=span, least=least)
        z = (F.col(x) - F.col(n + "m")) / F.greatest(F.col(n + "s"), F.lit(1e-8))
        d = d.withColumn(n, clip(fill(F.when(F.col(n + "s").isNotNull(), z), 0.0), -5.0, 5.0)).drop(n + "m", n + "s")
    d = d.withColumns({"_la": F.ln(F.greatest(F.col(a), F.lit(1e-8))), "_lb": F.ln(F.greatest(F.col(b), F.lit(1e-8)))})
    d = d.withColumn("_lr", F.col("_la") - F.col("_lb"))
    return d.withColumns({
        "z_spread": clip(F.col("_za") - F.col("_zb"), -5.0, 5.0),
        "momentum_diff": clip(fill(f.diff("_la", 30) - f.diff("_lb", 30), 0.0), -3.0, 3.0),
        "ratio_change": clip(fill(f.diff("_lr", 15), 0.0), -3.0, 3.0)}).drop("_za", "_zb", "_la", "_lb", "_lr")


Z_SPREAD_HISTORY = 2 * reach(alpha_of(180)) + 31


def cluster_inputs(df: DataFrame, f: Frames, ma: int = 20, atr: int = 20) -> DataFrame:
    """Smoothed slope of the mean, range ratio, band width and smoothed volume ratio: inputs of state clustering. History: 125."""
    d = df.withColumns({"ma": f.mean("close", ma), "_r": F.when(F.col("high") == F.col("low"), 1e-10).otherwise(F.col("high") - F.col("low")),
                        "_sd": f.std("close", ma), "_vm": f.mean("volume", ma)})
    d = d.withColumns({"ma_slope": div(F.col("ma") - f.lag("ma", 5), "close") * 1000, "_a": f.mean("_r", atr),
                       "bb_width": F.col("_sd") * 2 / (F.col("ma") + EPS), "vol_ratio": F.col("volume") / (F.col("_vm") + EPS)})
    return d.withColumns({"ma_slope_smooth": f.mean("ma_slope", 3), "atr_percentile": F.col("_a") / (f.mean("_a", 100) + EPS),
                          "vol_ratio_smooth": f.mean("vol_ratio", 5)}).drop("_r", "_sd", "_vm", "_a")
