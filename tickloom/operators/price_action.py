"""Price-action rules on numbered bars: regime scorecard, counters, pressure, structure."""
from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.exprs import clip, div, fill, flag, minute_of_day, sign, yes
from .asof import asof_backward
from .ewm import alpha_of, ewm_mean, reach
from .indicators import day_window
from .durable import durable
from .layout import Frames, chunk_rows, in_chunks, number_rows, running
from .resample import resample
from .sequences import counts_since_reset, micro_channel, run_of

EMA20 = reach(alpha_of(20))
EMA50 = reach(alpha_of(50))
TREND_STATES = ("tight_bull_channel", "wide_bull_channel", "tight_bear_channel", "wide_bear_channel")

# Execution tags per state group (order, entry, stop, target, size).
EXECUTION = {
    "tight": ("stop", "h1_h2_or_l1_l2_breakout", "leg_extreme_or_ema_other_side", "hold_until_trend_exhaustion", "1.00x"),
    "wide": ("stop_plus_limit", "trend_pullback_or_boundary_reversal", "outside_recent_swing", "channel_opposite_or_mm_target", "1.00x"),
    "ttr": ("none", "no_trade_wait_breakout_confirm", "n_a", "n_a", "n_a"),
    "neutral": ("wait", "strong_breakout_plus_follow_through", "below_breakout_midpoint", "conservative_1r", "0.50x"),
    "range": ("limit", "range_thirds", "range_plus_1atr", "to_opposite_or_midline", "0.50_to_0.75x"),
}
EXECUTION_COLS = ("pa_env_order_type", "pa_env_entry_style", "pa_env_stop_style", "pa_env_take_profit_style", "pa_env_position_size")


def direction(df: DataFrame, f: Frames, out: str = "dir") -> DataFrame:
    """+1 above the 20-bar exponential average, -1 below, 0 without one."""
    d = ewm_mean(df, f, "close", "_e20", span=20, least=20)
    return d.withColumn(out, fill(sign(F.col("close") - F.col("_e20")), 0.0).cast("int")).drop("_e20")


def bars_since_extreme(df: DataFrame, dir_col: str, out: str, keys=("symbol",)) -> DataFrame:
    """Bars since the direction's run started or made a new extreme; neutral bars go on counting."""
    s = F.col(dir_col)
    price = F.when(s == 1, F.col("high")).when(s == -1, -F.col("low"))
    d = in_chunks(df, lambda x, f: x.withColumns({
        "_new": yes(s != f.lag(s)) | (F.col("bar_no") == 0), "_price": price}), history=1, keys=keys)
    d = running(d, {"_top": ("max", F.col("_price"), "run")}, resets={"run": F.col("_new")}, keys=keys)
    d = in_chunks(d, lambda x, f: x.withColumn(
        "_reset", (s != 0) & (F.col("_new") | yes(F.col("_price") >= f.lag("_top")))), history=1, keys=keys)
    d = running(d, {"_at": ("max", F.when(F.col("_reset"), F.col("bar_no")))}, keys=keys)
    return d.withColumn(out, F.coalesce(F.col("bar_no") - F.col("_at"), F.col("bar_no") + 1)).drop(
        "_new", "_price", "_top", "_reset", "_at")


def twenty_bar_rule(df: DataFrame, dir_col: str = "dir") -> DataFrame:
    d = bars_since_extreme(df, dir_col, "pa_bars_since_trend_change")
    return d.withColumn("pa_trend_weakened", F.col("pa_bars_since_trend_change") >= 20)


def pullback_counts(df: DataFrame, dir_col: str = "dir", keys=("symbol",)) -> DataFrame:
    """New highs since the latest lower low of an up run (and mirrored); a new pullback restarts the count."""
    s = F.col(dir_col)
    up, down = s == 1, s == -1
    d = in_chunks(df, lambda x, f: x.withColumns({
        "_nh": yes(F.col("high") > f.lag("high")), "_ll": yes(F.col("low") < f.lag("low")),
        "_new": yes(s != f.lag(s)) | (F.col("bar_no") == 0)}), history=1, keys=keys)
    nh, ll = F.col("_nh"), F.col("_ll")
    d = running(d, {
        "_seen_h": ("max", (up & ll).cast("int"), "run"), "_seen_l": ("max", (down & nh).cast("int"), "run"),
        "_h": ("sum", (up & nh).cast("bigint"), "low"), "_l": ("sum", (down & ll).cast("bigint"), "high"),
    }, resets={"run": F.col("_new"), "low": F.col("_new") | (up & ll), "high": F.col("_new") | (down & nh)}, keys=keys)
    d = d.withColumns({"pa_h_count": F.when(up & (F.col("_seen_h") == 1), F.col("_h")).otherwise(0),
                       "pa_l_count": F.when(down & (F.col("_seen_l") == 1), F.col("_l")).otherwise(0)})
    out = {}
    for n in (1, 2, 3):
        out[f"pa_is_h{n}_setup"] = F.col("pa_h_count") == n
        out[f"pa_is_l{n}_setup"] = F.col("pa_l_count") == n
    out["pa_is_h4_setup"], out["pa_is_l4_setup"] = F.col("pa_h_count") >= 4, F.col("pa_l_count") >= 4
    out["pa_r09_short_setup"] = (s == -1) & (F.col("pa_h_count") >= 4)
    out["pa_r09_long_setup"] = (s == 1) & (F.col("pa_l_count") >= 4)
    return d.withColumns(out).drop("_nh", "_ll", "_new", "_seen_h", "_seen_l", "_h", "_l")


def pullback_counts_rearm(df: DataFrame, state: str = "market_state", keys=("symbol",)) -> DataFrame:
    """One count per pullback inside a run of bull (0, 1) or bear (2, 3) states.

    A new high counts if its own bar makes a lower low or if the run's latest
    mark before it is a lower low without a new high.
    """
    side = F.when(F.col(state).isin(0, 1), 1).when(F.col(state).isin(2, 3), -1).otherwise(0)
    d = df.withColumn("_side", side)
    s = F.col("_side")
    d = in_chunks(d, lambda x, f: x.withColumns({
        "_nh": yes(F.col("high") > f.lag("high")), "_ll": yes(F.col("low") < f.lag("low")),
        "_new": yes(s != f.lag(s)) | (F.col("bar_no") == 0)}), history=1, keys=keys)
    d = d.withColumns({"_arm": F.when(s == 1, F.col("_ll")).when(s == -1, F.col("_nh")).otherwise(False),
                       "_hit": F.when(s == 1, F.col("_nh")).when(s == -1, F.col("_ll")).otherwise(False)})
    d = running(d, {"_tok": ("last", F.when(F.col("_arm") | F.col("_hit"), ~F.col("_hit")), "run")},
                resets={"run": F.col("_new")}, keys=keys)
    d = in_chunks(d, lambda x, f: x.withColumn(
        "_count", F.col("_hit") & (F.col("_arm") | (~F.col("_new") & yes(f.lag("_tok"))))), history=1, keys=keys)
    d = running(d, {"_n": ("sum", F.col("_count").cast("bigint"), "run")}, resets={"run": F.col("_new")}, keys=keys)
    return d.withColumns({"h_count": F.when(s == 1, F.col("_n")).otherwise(0), "l_count": F.when(s == -1, F.col("_n")).otherwise(0)}).drop(
        "_side", "_nh", "_ll", "_new", "_arm", "_hit", "_tok", "_count", "_n")


def pullback_bars(df: DataFrame, state: str = "market_state", endless: int = 20, keys=("symbol",)) -> DataFrame:
    """Bars in a row that close against the state's side."""
    k = F.col("close")

    def mark(x, f):
        against = F.when(F.col(state).isin(0, 1), k < f.lag("close")).when(F.col(state).isin(2, 3), k > f.lag("close"))
        return x.withColumn("_against", yes(against))
    d = in_chunks(df, mark, history=1, keys=keys)
    d = counts_since_reset(d, {"pullback_bars": (F.col("_against"), ~F.col("_against"))}, keys=keys)
    return d.withColumn("endless_pullback", flag(F.col("pullback_bars") >= endless)).drop("_against")


def market_regime(df: DataFrame, keys=("symbol",)) -> DataFrame:
    """Trend and range conditions, an eight-part score and the market state."""
    o, h, l, k = (F.col(x) for x in ("open", "high", "low", "close"))

    def first(d: DataFrame, f: Frames) -> DataFrame:
        d = ewm_mean(d, f, "close", "_ema", span=20, least=20)
        rng = F.nullif(h - l, F.lit(0.0))
        pk, po = f.lag("close"), f.lag("open")
        body_lo, body_hi = F.least(o, k), F.greatest(o, k)
        prev_lo, prev_hi = F.least(po, pk), F.greatest(po, pk)
        common = F.greatest(F.lit(0.0), F.least(prev_hi, body_hi) - F.greatest(prev_lo, body_lo))
        widest = F.greatest(prev_hi - prev_lo, body_hi - body_lo, F.lit(1e-12))
        d = d.withColumns({
            "_body": F.abs(k - o), "_uw": h - body_hi, "_lw": body_lo - l, "_sgn": sign(k - o),
            "_slope": F.col("_ema") - f.lag("_ema"), "_side": F.coalesce(sign(k - F.col("_ema")), F.lit(0.0)),
            "_overlap": F.when(pk.isNotNull(), common / widest).otherwise(0.0),
            "_brat": fill(div(F.abs(k - o), rng), 0.0), "_wrat": fill(div((h - body_hi) + (body_lo - l), rng), 1.0),
            "_up": flag((h > f.lag("high")) & (l > f.lag("low"))), "_dn": flag((h < f.lag("high")) & (l < f.lag("low"))),
        })
        return d.withColumn("_same", (F.col("_sgn") != 0) & (F.col("_sgn") == f.lag("_sgn")))
    d = in_chunks(df, first, history=EMA20 + 2, keys=keys)
    bear = (k < o) & (F.col("bar_no") > 0)
    d = counts_since_reset(d, {"_color": (F.lit(True), ~yes(F.col("_same"))), "_counter": (bear, ~bear)}, keys=keys)

    def second(d: DataFrame, f: Frames) -> DataFrame:
        avg_body = f.mean("_body", 20, 5)
        hi10, lo10 = f.max("high", 10, 3), f.min("low", 10, 3)
        big = (F.col("_brat") >= 0.6) & (F.col("_body") > 1.5 * avg_body)
        d = d.withColumns({
            "_above": flag(F.col("_side") > 0), "_below": flag(F.col("_side") < 0),
            "_bull_bo": flag(big & (k > f.lag("high")) & (k >= h - 0.25 * (h - l))),
            "_bear_bo": flag(big & (k < f.lag("low")) & (k <= l + 0.25 * (h - l))),
            "_span10": F.nullif(hi10 - lo10, F.lit(0.0)), "_hi10": hi10, "_lo10": lo10,
        })
        d = d.withColumns({"_pu": div(F.col("_hi10") - k, F.col("_span10")), "_pd": div(k - F.col("_lo10"), F.col("_span10"))})
        d = d.withColumns({
            "_above5": (f.sum("_above", 5) == 5) & (F.col("bar_no") >= 4), "_below5": (f.sum("_below", 5) == 5) & (F.col("bar_no") >= 4)})

        def score(side: int) -> Column:
            slope = F.col("_slope") > 0 if side > 0 else F.col("_slope") < 0
            where, five = ("_above", "_above5") if side > 0 else ("_below", "_below5")
            color = k > o if side > 0 else k < o
            pull = "_pu" if side > 0 else "_pd"
            legs, burst = ("_up", "_bull_bo") if side > 0 else ("_dn", "_bear_bo")
            return (flag(slope & (f.mean(where, 20, 5) >= 0.6)) + flag(F.col(five))
                    + flag((F.col("_color") >= 3) & color & (F.col("_brat") >= 0.6)) + flag(F.col(pull) < 0.5)
                    + flag(F.col("_counter") <= 5) + flag(f.sum(legs, 5, 2) >= 3) + flag(f.max(burst, 20, 5) == 1))
        d = d.withColumns({"_long": score(1), "_short": score(-1)})
        return d.withColumn("pa_env_trend_dir", sign(F.col("_long") - F.col("_short")).cast("int"))
    d = in_chunks(d, second, history=20, keys=keys)
    d = bars_since_extreme(durable(d), "pa_env_trend_dir", "pa_env_bars_since_extreme", keys)

    def third(d: DataFrame, f: Frames) -> DataFrame:
        td, since = F.col("pa_env_trend_dir"), F.col("pa_env_bars_since_extreme")
        d = d.withColumns({
            "_h20": f.max("high", 20, 5), "_l20": f.min("low", 20, 5), "_r40": f.max("high", 40, 10) - f.min("low", 40, 10),
            "_abs_slope": F.abs("_slope"), "_rng": h - l,
            "_cross": flag((f.lag("_side") != 0) & (F.col("_side") != 0) & (f.lag("_side") != F.col("_side"))),
            "_alt": flag(F.col("_sgn") != f.lag("_sgn")),
            "_wicks": flag((F.col("_uw") > F.col("_body") / 3.0) & (F.col("_lw") > F.col("_body") / 3.0)),
            "_tails": flag((F.col("_uw") > 0) & (F.col("_lw") > 0)),
            "_touch": flag((l <= F.col("_ema")) | (h >= F.col("_ema"))),
            "_ext": flag(F.when(td == 1, k >= l + (2.0 / 3.0) * (h - l)).when(td == -1, k <= l + (1.0 / 3.0) * (h - l)).otherwise(False)),
        })
        ph, pl = f.lag("_h20"), f.lag("_l20")
        d = d.withColumn("_failed", flag(yes((h >= ph) & (k < ph)) | yes((l <= pl) & (k > pl))))
        slow = F.nullif(f.mean("_abs_slope", 40, 10), F.lit(0.0))
        color = F.col("_color")
        rc = (flag(F.col("_h20") - F.col("_l20") < 0.5 * F.nullif(f.lag("_r40", 20), F.lit(0.0)))
              + flag(F.col("_abs_slope") < slow / 3.0) + flag(f.sum("_cross", 10, 5) >= 3) + flag(f.sum("_failed", 5, 3) >= 4)
              + flag((f.mean("_alt", 10, 5) >= 0.6) & (color < 3)) + flag(f.mean("_wicks", 10, 5) >= 0.6))
        d = d.withColumn("pa_env_range_score_ratio", rc / 6.0)
        gap = F.when(td == 1, l > f.lag("open")).when(td == -1, h < f.lag("open")).otherwise(False)
        small = yes(F.col("_span10") * fill(F.col("_pu"), 0.0) < 2.0 * F.col("_rng")) | yes(F.col("_span10") * fill(F.col("_pd"), 0.0) < 2.0 * F.col("_rng"))
        broad = (flag((F.col("_pu") > 0.5) | (F.col("_pd") > 0.5)) + flag(f.mean("_color", 10, 5) >= 5)
                 + flag((f.sum("_up", 10, 5) >= 2) & (f.sum("_dn", 10, 5) >= 2)) + flag(f.mean("_touch", 10, 5) >= 0.6))
        d = d.withColumns({
            "pa_is_tight_channel": F.col("_counter").between(1, 3) & small & yes(gap) & (F.col("_overlap") < 0.3) & yes(f.mean("_ext", 10, 5) >= 0.7),
            "pa_is_broad_channel": broad >= 2,
            "pa_is_ttr": yes(F.col("_h20") - F.col("_l20") < 3.0 * f.mean("_rng", 20, 5)) & yes(f.mean("_overlap", 10, 5) > 0.5)
            & yes(f.mean("_tails", 10, 5) >= 0.6) & (color <= 2) & yes(f.mean("pa_env_range_score_ratio", 5, 3) >= 0.6),
        })

        def vote(plus, minus):
            return F.when(yes(plus), 1).when(yes(minus), -1).otherwise(0)
        solid = (F.col("_brat") >= 0.6) & (F.col("_wrat") < 0.4)
        d = d.withColumns({
            "pa_env_score_ema_dir": vote(F.col("_slope") > 0, F.col("_slope") < 0),
            "pa_env_score_price_vs_ema": vote(F.col("_above5"), F.col("_below5")),
            "pa_env_score_hh_hl": vote(f.sum("_up", 4, 2) >= 3, f.sum("_dn", 4, 2) >= 3),
            "pa_env_score_breakout_bar": vote(F.col("_bull_bo") == 1, F.col("_bear_bo") == 1),
            "pa_env_score_pullback_depth": vote((td == 1) & (F.col("_pu") < 0.38), (td == -1) & (F.col("_pd") < 0.38)),
            "pa_env_score_pullback_duration": vote((td == 1) & (F.col("_counter") <= 3), (td == -1) & (F.col("_counter") <= 3)),
            "pa_env_score_twenty_bar": F.when(since < 10, td).otherwise(0),
            "pa_env_score_bar_quality": vote(solid & (k > o), solid & (k < o)),
            "pa_env_trend_score_ratio": F.greatest("_long", "_short") / 7.0,
            "pa_env_trend_inertia": F.when(since <= 5, 0.90).when(since <= 10, 0.75).when(since <= 15, 0.60).when(since <= 19, 0.55).otherwise(0.50),
            "pa_env_inertia_bucket": F.when(since <= 5, "bars_0_5").when(since <= 10, "bars_6_10").when(since <= 15, "bars_11_15")
            .when(since <= 19, "bars_16_19").otherwise("bars_ge_20"),
        })
        parts = [F.col(n) for n in d.columns if n.startswith("pa_env_score_")]
        total = parts[0]
        for p in parts[1:]:
            total = total + p
        return d.withColumn("pa_env_score_total", total)
    d = in_chunks(d, third, history=66, keys=keys)
    total, tight = F.col("pa_env_score_total"), F.col("pa_is_tight_channel")
    state = (F.when((F.col("pa_env_bars_since_extreme") >= 20) & (F.abs(total) <= 2), "neutral_50_50")
             .when((total >= 6) & tight, "tight_bull_channel").when(total >= 3, "wide_bull_channel")
             .when((total <= -6) & tight, "tight_bear_channel").when(total <= -3, "wide_bear_channel")
             .when(F.col("pa_is_ttr"), "ttr").otherwise("wide_tr"))
    d = d.withColumn("pa_env_state", state)
    s = F.col("pa_env_state")
    group = (F.when(s.startswith("tight_"), "tight").when(s.isin("wide_bull_channel", "wide_bear_channel"), "wide")
             .when(s == "ttr", "ttr").when(s == "neutral_50_50", "neutral").otherwise("range"))
    tags = {}
    for i, n in enumerate(EXECUTION_COLS):
        x = F.lit(EXECUTION["range"][i])
        for g in ("tight", "wide", "ttr", "neutral"):
            x = F.when(group == g, EXECUTION[g][i]).otherwise(x)
        tags[n] = x
    trend = s.isin(*TREND_STATES)
    d = d.withColumns({**tags, "pa_regime_trend": trend, "pa_regime_range": ~trend, "pa_reversal_likely_fail": trend,
                       "pa_breakout_likely_fail": s.isin("wide_tr", "ttr")})
    return d.drop(*[n for n in d.columns if n.startswith("_")])


def pressure_score(df: DataFrame, window: int = 10) -> DataFrame:
    """Bull and bear pressure 0..100 from counts, bodies, close positions and the micro channel."""
    o, h, l, k = (F.col(x) for x in ("open", "high", "low", "close"))
    d = micro_channel(df)

    def build(d, f):
        body = F.abs(k - o)
        d = d.withColumns({"_b": flag(k > o), "_e": flag(k < o), "_bb": F.when(k > o, body).otherwise(0.0),
                           "_eb": F.when(k < o, body).otherwise(0.0), "_cp": fill(div(k - l, h - l), 0.5)})
        bars = (f.sum("_b", window) - f.sum("_e", window)) / window * 20
        bb, eb = f.mean("_bb", window), f.mean("_eb", window)
        bodies = fill(div(bb - eb, bb + eb), 0.0) * 20
        closes = (f.mean("_cp", window) - 0.5) * 40
        return d.withColumn("_raw", bars + bodies + closes)
    d = in_chunks(d, build, history=window)
    raw, micro = F.col("_raw"), F.col("micro")
    d = d.withColumns({
        "pa_bull_pressure": clip(clip(raw, 0, 100) + clip(micro, 0, 20), 0, 100),
        "pa_bear_pressure": clip(clip(-raw, 0, 100) + clip(-micro, 0, 20), 0, 100)})
    return d.withColumn("pa_net_pressure", F.col("pa_bull_pressure") - F.col("pa_bear_pressure")).drop("_b", "_e", "_bb", "_eb", "_cp", "_raw")


def volume_climax(df: DataFrame, f: Frames) -> DataFrame:
    """Volume z-score and the climax flag: z > 3 in a trend of at least 20 bars; needs the scorecard."""
    v = F.col("volume")
    d = df.withColumn("pa_vol_zscore_20", fill((v - f.mean("volume", 20, 5)) / (f.std("volume", 20, 5) + 1e-8), 0.0))
    return d.withColumn("pa_vol_exhaustion_climax", F.col("pa_regime_trend") & (F.col("pa_env_bars_since_extreme") >= 20)
                        & (F.col("pa_vol_zscore_20") > 3.0))


def opening_range(df: DataFrame, atr: str, t: str = "t", start: int = 570, end: int = 660, last_of_day: bool = False,
                  volume_mean: str | None = None) -> DataFrame:
    """Breakouts of the running 09:30-11:00 range and its size in ATR.

    The ratio uses the bar's own ATR; `last_of_day=True` gives the form that
    uses the day's last ATR on all bars of the day, which looks ahead.
    """
    w = day_window(t)
    upto = w.rowsBetween(Window.unboundedPreceding, 0)
    m = minute_of_day(t)
    inside = (m >= start) & (m < end)
    d = df.withColumns({"_hi": F.max(F.when(inside, F.col("high"))).over(upto), "_lo": F.min(F.when(inside, F.col("low"))).over(upto),
                        "_atr": F.max_by(atr, "bar_no").over(Window.partitionBy("symbol", F.to_date(t))) if last_of_day else F.col(atr)})
    up, dn = yes((m >= end) & (F.col("close") > F.col("_hi"))), yes((m >= end) & (F.col("close") < F.col("_lo")))
    if volume_mean is None:
        d = in_chunks(d, lambda x, f: x.withColumn("_vm", f.mean("volume", 20)), history=20)
        volume_mean = "_vm"
    return d.withColumns({
        "or_breakout_up": up.cast("int"), "or_breakout_down": dn.cast("int"),
        "or_volume_breakout": flag((up | dn) & (F.col("volume") > F.col(volume_mean))),
        "or_vs_atr_ratio": F.when(F.col("_atr") > 0, (F.col("_hi") - F.col("_lo")) / F.col("_atr")),
    }).drop("_hi", "_lo", "_atr", "_vm")


def swings(df: DataFrame, f: Frames, arm: int = 5) -> DataFrame:
    """Swing prices on the bar that confirms them: strict extreme of `arm` bars on either side, known `arm` bars later."""
    left, right = f.rows(-2 * arm, -arm - 1), f.rows(-arm + 1, 0)
    ph, pl = f.lag("high", arm), f.lag("low", arm)
    full = F.col(f.pos) >= 2 * arm
    return df.withColumns({
        "swing_high": F.when(full & (ph > F.max("high").over(left)) & (ph > F.max("high").over(right)), ph),
        "swing_low": F.when(full & (pl < F.min("low").over(left)) & (pl < F.min("low").over(right)), pl),
    })


def structure(df: DataFrame, atr: str, arm: int = 5, keys=("symbol",)) -> DataFrame:
    """Higher/lower highs and lows among the last five swings, swing range, structure breaks, legs.

    Swing events are few; each gathers the last five prices of its kind, and
    bars carry the latest such array.
    """
    d = durable(in_chunks(df, lambda x, f: swings(x, f, arm), history=2 * arm, keys=keys))
    both = d.select(*keys, "bar_no", F.explode(F.array(
        F.struct(F.lit("h").alias("kind"), F.col("swing_high").alias("p")),
        F.struct(F.lit("l").alias("kind"), F.col("swing_low").alias("p")))).alias("e"))
    ev = both.where("e.p is not null").select(*keys, "e.kind", F.col("bar_no").alias("_at"), F.col("e.p").alias("_p"))
    ev = number_rows(ev, [*keys, "kind"], ("_at",), piece=F.floor(F.col("_at") / chunk_rows(df)))
    ev = in_chunks(ev, lambda x, f: x.withColumn("_last5", F.collect_list("_p").over(f.last(5))), history=5, keys=[*keys, "kind"])
    at = ev.groupBy(*keys, F.col("_at").alias("bar_no")).agg(
        F.max(F.when(F.col("kind") == "h", F.col("_last5"))).alias("_highs"), F.max(F.when(F.col("kind") == "l", F.col("_last5"))).alias("_lows"))
    d = d.join(at, [*keys, "bar_no"], "left")
    d = running(d, {"_hs": ("last", F.col("_highs")), "_ls": ("last", F.col("_lows"))}, keys=keys)

    def rises(a: str) -> Column:
        x = F.col(a)
        pairs = F.when(F.size(x) >= 2, F.zip_with(F.slice(x, F.lit(1), F.size(x) - 1), F.slice(x, F.lit(2), F.size(x) - 1), lambda p, q: (q > p)))
        return F.coalesce(F.size(F.filter(pairs, lambda up: up)), F.lit(0)), F.coalesce(F.size(F.filter(pairs, lambda up: ~up)), F.lit(0))
    hh, lh = rises("_hs")
    hl, ll = rises("_ls")
    last = lambda a, i: F.try_element_at(F.col(a), F.lit(-i))
    k = F.col("close")
    safe = F.when(F.col(atr) > 0, F.col(atr)).otherwise(1e-6)
    legs = 40 - arm + 1
    d = in_chunks(d, lambda x, f: x.withColumn("pa_struct_leg_count", F.count("swing_high").over(f.last(legs)) + F.count("swing_low").over(f.last(legs))),
                  history=legs, keys=keys)
    return d.withColumns({
        "pa_struct_hh_count": hh, "pa_struct_hl_count": hl, "pa_struct_lh_count": lh, "pa_struct_ll_count": ll,
        "pa_struct_score": (hh + hl) - (lh + ll),
        "pa_struct_swing_range_atr": F.abs(last("_hs", 1) - last("_ls", 1)) / safe,
        "pa_struct_break_up": yes((k > last("_hs", 1)) & (last("_hs", 1) < last("_hs", 2))),
        "pa_struct_break_down": yes((k < last("_ls", 1)) & (last("_ls", 1) > last("_ls", 2))),
    }).drop("_highs", "_lows", "_hs", "_ls")


def swing_types(df: DataFrame, arm: int = 5, shift: int = 3, keys=("symbol",)) -> DataFrame:
    """Centred swings (ties count): last confirmed prices and HH/LH, HL/LL tags carried forward."""
    def mark(x, f):
        w = f.rows(-arm, arm)
        full = F.count(F.lit(1)).over(w) == 2 * arm + 1
        return x.withColumns({"_sh": F.when(full & (F.col("high") == F.max("high").over(w)), F.col("high")),
                              "_sl": F.when(full & (F.col("low") == F.min("low").over(w)), F.col("low"))})
    d = in_chunks(df, mark, history=arm, lookahead=arm, keys=keys)
    d = running(d, {"_ph": ("last", F.col("_sh")), "_pl": ("last", F.col("_sl"))}, keys=keys)
    d = in_chunks(d, lambda x, f: x.withColumns({
        "last_swing_high": f.lag("_ph", shift), "last_swing_low": f.lag("_pl", shift),
        "_th": F.when(F.col("_sh").isNotNull(), F.when(f.lag("_ph").isNull(), "NA").when(F.col("_sh") > f.lag("_ph"), "HH").otherwise("LH")),
        "_tl": F.when(F.col("_sl").isNotNull(), F.when(f.lag("_pl").isNull(), "NA").when(F.col("_sl") > f.lag("_pl"), "HL").otherwise("LL"))}),
        history=shift, keys=keys)
    d = running(d, {"swing_high_type": ("last", F.col("_th")), "swing_low_type": ("last", F.col("_tl"))}, keys=keys)
    return d.withColumns({n: F.coalesce(F.col(n), F.lit("NA")) for n in ("swing_high_type", "swing_low_type")}).drop(
        "_sh", "_sl", "_ph", "_pl", "_th", "_tl")


def ma_compression(df: DataFrame, f: Frames, atr: str) -> DataFrame:
    """Population deviation of three exponential averages in ATR; 0 until all exist."""
    d = df
    for n in (8, 20, 50):
        d = ewm_mean(d, f, "close", f"_m{n}", span=n, least=n)
    m = (F.col("_m8") + F.col("_m20") + F.col("_m50")) / 3.0
    var = sum((F.pow(F.col(f"_m{n}") - m, F.lit(2)) for n in (8, 20, 50)), F.lit(0.0)) / 3.0
    safe = F.when(F.col(atr) > 1e-12, F.col(atr)).otherwise(1e-12)
    return d.withColumn("pa_ma_compress", fill(F.sqrt(var) / safe, 0.0)).drop("_m8", "_m20", "_m50")


def relative_volume(df: DataFrame, f: Frames) -> DataFrame:
    """Volume against its averages, climax and absorption flags."""
    o, h, l, k, v = (F.col(x) for x in ("open", "high", "low", "close", "volume"))
    slow = f.mean("volume", 20, 5)
    safe = F.when(slow > 0, slow).otherwise(1.0)
    body = F.abs(k - o)
    ratio = body / F.greatest(h - l, F.lit(1e-12))
    d = df.withColumn("pa_vol_rvol", v / safe)
    rv = F.col("pa_vol_rvol")
    quiet = (rv > 1.5) & (ratio < 0.4)
    return d.withColumns({
        "pa_vol_trend": f.mean("volume", 5, 2) / safe,
        "pa_vol_climax": (rv > 3.0) & (ratio > 0.5),
        "pa_vol_net_absorption": flag(quiet & (F.least(o, k) - l > body * 1.5)) - flag(quiet & (h - F.greatest(o, k) > body * 1.5)),
    })


def composites(df: DataFrame) -> DataFrame:
    """Five condensed scores from pressure, structure, scorecard and pullback columns."""
    net = fill(F.col("pa_net_pressure"), 0.0)
    up, dn = flag(F.col("pa_struct_break_up")), flag(F.col("pa_struct_break_down"))
    td, inertia = F.col("pa_env_trend_dir"), F.col("pa_env_trend_inertia")
    room = lambda n: F.greatest(F.lit(0.0), 1.0 - 0.25 * F.col(n))
    return df.withColumns({
        "pa_reversal_composite": clip(F.tanh(net / 50.0) * 0.6 + (up - dn) * 0.4, -1.0, 1.0),
        "pa_continuation_composite": F.when(td > 0, inertia * room("pa_h_count")).when(td < 0, -inertia * room("pa_l_count")).otherwise(0.0),
        "pa_structure_clarity": clip(1.0 - F.col("pa_struct_leg_count") / 8.0, 0.1, 1.0) * clip(F.abs(F.col("pa_struct_score")) / 10.0, 0.0, 1.0),
        "pa_pressure_score": clip(net / 100.0, -1.0, 1.0),
        "pa_pullback_stage": clip((F.col("pa_h_count") - F.col("pa_l_count")).cast("double"), -4.0, 4.0),
    })


def micro_1m(df: DataFrame) -> DataFrame:
    """Wick and body shares, direction run, one-bar return, relative volume and direction entropy."""
    o, h, l, k = (F.col(x) for x in ("open", "high", "low", "close"))

    def build(d, f):
        rng = F.greatest(h - l, F.lit(1e-12))
        wicks = (h - F.greatest(o, k)) + (F.least(o, k) - l)
        prev = F.coalesce(f.lag("close"), k)
        d = d.withColumns({"_up": flag(k > f.lag("close")), "_sg": sign(k - o)})
        p = clip(fill(f.mean("_up", 10, 2), 0.5), 1e-10, 1.0 - 1e-10)
        return d.withColumns({
            "pa_1m_wick_ratio": clip(wicks / rng, 0.0, 5.0), "pa_1m_body_ratio": clip(F.abs(k - o) / rng, 0.0, 1.0),
            "pa_1m_ret_1": (k - prev) / F.greatest(prev, F.lit(1e-12)),
            "pa_1m_vol_rel": F.col("volume") / F.greatest(f.mean("volume", 20), F.lit(1e-9)),
            "pa_1m_dir_entropy_10": clip(-(p * F.log2(p) + (1.0 - p) * F.log2(1.0 - p)), 0.0, 1.0),
            "_go": (F.col("_sg") != 0) & (F.col("_sg") == f.lag("_sg")),
        })
    d = in_chunks(df, build, history=21)
    return run_of(d, {"pa_1m_consec_dir_run": ~yes(F.col("_go"))}).drop("_up", "_sg", "_go")


def pa_atr(df: DataFrame, f: Frames, out: str = "atr_pa") -> DataFrame:
    """Normalised-weight exponential mean of the bar range, span 14."""
    return ewm_mean(df, f, F.col("high") - F.col("low"), out, span=14, least=5, adjust=True)


def htf_regime(bars: DataFrame, widths=(("15 minutes", "15min"), ("60 minutes", "60min"))) -> DataFrame:
    """State and trend score of the last closed coarse bar per width, and the sign sum of the first two."""
    tags = []
    d = bars = durable(bars)
    for width, tag in widths:
        coarse = number_rows(resample(bars.select("symbol", "t", "open", "high", "low", "close", "volume"), width))
        reg = market_regime(coarse).select("symbol", "t", F.col("pa_env_state").alias(f"pa_htf_{tag}_state"),
                                           F.col("pa_env_trend_score_ratio").alias(f"pa_htf_{tag}_trend_score"))
        d = asof_backward(d, durable(reg), [f"pa_htf_{tag}_state", f"pa_htf_{tag}_trend_score"])
        tags.append(tag)
    a, b = (F.signum(fill(F.col(f"pa_htf_{t}_trend_score"), 0.0)) for t in tags[:2])
    return d.withColumn("pa_htf_trend_alignment", a + b)


def full_stack(bars: DataFrame) -> DataFrame:
    """Scorecard, counters, pressure, structure, averages, volume and composites of one timeframe."""
    def first(x, f):
        return relative_volume(ma_compression(pa_atr(direction(x, f), f), f, "atr_pa"), f)
    d = in_chunks(bars, first, history=EMA50 + 21)
    d = durable(pullback_counts(d))
    d = durable(twenty_bar_rule(d))
    d = durable(market_regime(d))
    d = pressure_score(d)
    d = structure(d, "atr_pa")
    return composites(d)


STACK_COLS = ("pa_reversal_composite", "pa_continuation_composite", "pa_structure_clarity", "pa_pressure_score", "pa_pullback_stage",
              "pa_ma_compress", "pa_vol_rvol", "pa_vol_trend", "pa_vol_climax", "pa_vol_net_absorption")


STATE_COLS = ("pa_hmm_state", "pa_hsmm_switch_hazard", "pa_garch_vol", "pa_egarch_std_residual")


def multi_timeframe(bars: DataFrame, widths=(("5 minutes", "5m", True), ("15 minutes", "15m", False)), micro: bool = False) -> DataFrame:
    """One stack per coarse width (width, tag, full), prefixed, each bar taking the last closed coarse bar.

    A full width also has the volatility states; the others leave them out. `micro` adds the bars' own micro features.
    """
    from .regimes import volatility_states
    bars = durable(bars)
    d = micro_1m(bars) if micro else bars
    for width, tag, *full in widths:
        coarse = durable(number_rows(resample(bars.select("symbol", "t", "open", "high", "low", "close", "volume"), width)))
        cols = [*STACK_COLS, *(STATE_COLS if full and full[0] else ())]
        stack = full_stack(coarse)
        if len(cols) > len(STACK_COLS):
            stack = durable(stack).join(durable(volatility_states(coarse)).select("symbol", "bar_no", *STATE_COLS), ["symbol", "bar_no"])
        named = {n: f"pa_{tag}_{n[3:]}" for n in cols}
        d = asof_backward(d, durable(stack.select("symbol", "t", *[F.col(x).alias(y) for x, y in named.items()])), list(named.values()))
    return d
