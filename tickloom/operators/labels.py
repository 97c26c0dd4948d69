"""Forward-looking labels on numbered bars.

Every label looks at most a fixed number of bars ahead, so it is a frame or a
frame array inside a chunk with look-ahead rows.
"""
from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T

from ..functions.exprs import c, clip, div, fill, flag, micros, yes
from .layout import Frames, in_chunks
from .sparse_table import Ahead

RANGE_HORIZONS = (10, 15, 20, 30)


def straddle_edge(df: DataFrame, f: Frames, hold: int = 10, limit: float = 0.1) -> DataFrame:
    """Forward range over `hold` bars less twice the ATR, over the close, clipped to +-limit and scaled; no full window gives 0.

    The reference window ends `hold` bars ahead, so rows without that many later bars get 0.
    """
    k = F.greatest(F.col("close"), F.lit(1e-9))
    d = df.withColumn("_rng", F.col("high") - F.col("low"))
    ahead = f.rows(1, hold)
    atr = f.mean("_rng", 20, 5)
    move = F.when(F.count(F.lit(1)).over(ahead) == hold, (F.max("high").over(ahead) - F.min("low").over(ahead)) / k)
    edge = move - 2.0 * atr / k
    return d.withColumn("straddle_edge", fill(clip(edge, -limit, limit) / limit, 0.0)).drop("_rng")


def vol_class(df: DataFrame, f: Frames, rv: str, vol_z: str | None = None, lookback: int = 20, window: int = 60) -> DataFrame:
    """Volatility life-cycle: 0 compress, 1 breakout, 2 trending, 3 exhaust, 4 mean revert. Causal.

    The first rows have no history and fall to the default class; `rv` must not be missing.
    """
    least = max(10, window // 6)
    x = F.col(rv)
    z0 = (x - f.mean(rv, window, least)) / (F.nullif(f.std(rv, window, least), F.lit(0.0)) + 1e-8)
    old = f.lag(rv, lookback)
    k = F.greatest(F.col("close"), F.lit(1e-9))
    d = df.withColumns({
        "_z": fill(z0, 0.0), "_slope": fill((x - old) / (float(lookback) * (F.abs(old) + 1e-8)), 0.0),
        "_bb": (f.max("high", 20, 5) - f.min("low", 20, 5)) / k})
    old_bb = f.lag("_bb", lookback)
    d = d.withColumns({"_acc": fill(f.diff("_slope", 5), 0.0), "_zl": f.lag("_z", lookback),
                       "_bbc": fill((F.col("_bb") - old_bb) / (F.abs(old_bb) + 1e-8), 0.0)})
    z, s, a, zl = (F.col(n) for n in ("_z", "_slope", "_acc", "_zl"))
    vz = F.lit(0.0) if vol_z is None else fill(F.col(vol_z), 0.0)
    calm = (vz < 0.35) | (F.abs(vz - 0.35) <= 0.05)
    cls = (F.when((s > 0.02) & (a > 0.0) & yes(zl < 0.0), 1)
           .when((z > 0.0) & (s < 0.0) & (a < 0.0), 3)
           .when((z > 0.5) & (s >= 0.0), 2)
           .when((z < -0.3) & (s < 0.0) & (F.col("_bbc") < -0.05) & calm, 0)
           .otherwise(4))
    return d.withColumn("vol_class", cls).drop("_z", "_slope", "_bb", "_acc", "_zl", "_bbc")


VOL_CLASS_HISTORY = 110


def _ahead(f: Frames, cols: Sequence[str], n: int) -> Column:
    """Array of structs of the next n bars, in order."""
    return F.collect_list(F.struct(*cols)).over(f.rows(1, n))


def triple_barrier(df: DataFrame, f: Frames, upper: Column, lower: Column, horizon: int = 15, gap_hours: float = 4.0, t: str = "t") -> DataFrame:
    """0 upper first, 1 lower first, 2 neither or both on one bar; a session gap ends the path."""
    gap = int(gap_hours * 3600 * 1_000_000)
    d = df.withColumns({"_up": upper, "_dn": lower, "_us": micros(t)})
    d = d.withColumn("_brk", yes(F.col("_us") - f.lag("_us") > gap))
    d = d.withColumn("_path", _ahead(f, ["high", "low", "_brk"], horizon))
    start = F.struct(F.lit(2).alias("y"), F.lit(False).alias("done"))

    def walk(s, b):
        up, dn = b["high"] >= F.col("_up"), b["low"] <= F.col("_dn")
        stop = s["done"] | b["_brk"]
        y = F.when(stop, s["y"]).when(up & dn, 2).when(up, 0).when(dn, 1).otherwise(s["y"])
        return F.struct(y.alias("y"), (stop | yes(up) | yes(dn)).alias("done"))
    return d.withColumn("barrier", F.aggregate("_path", start, walk)["y"]).drop("_up", "_dn", "_us", "_brk", "_path")


def signal_outcome(df: DataFrame, f: Frames, signal: str = "signal", atr: str = "atr", *, hold: int = 30, horizon: int = 20, theta_start: int = 15,
                   theta_decay: float = 5.0, penalty: float = 1.0, tp_mult: float = 2.0, sl_mult: float = 1.0) -> DataFrame:
    """Outcome of a signal entered at the next open: stop before target, excursions until the exit, decision-window and best-exit values."""
    d = df.withColumn("_path", F.transform(_ahead(f, ["open", "high", "low"], hold), lambda b, i: b.withField("k", i + 1)))
    s, a = F.col(signal), F.col(atr)
    ok = yes((s != 0) & (a > 0) & (F.size("_path") > 0))
    d = d.withColumn("_e", F.get("_path", F.lit(0))["open"])
    e = F.col("_e")
    zero = {"out": F.lit(0), "bar": F.lit(0), "fav": F.lit(0.0), "adv": F.lit(0.0), "df": F.lit(0.0), "da": F.lit(0.0), "pk": F.lit(0),
            "ne": F.lit(float("-inf")), "tp": F.lit(0.0), "sl": F.lit(0.0), "nb": F.lit(0)}
    start = F.struct(*[v.alias(n) for n, v in zero.items()])

    def fade(k):
        return F.exp(-F.greatest(k - theta_start, F.lit(0)) / theta_decay)

    def walk(st, b):
        fav = F.when(s == 1, b["high"] - e).otherwise(e - b["low"])
        adv = F.when(s == 1, e - b["low"]).otherwise(b["high"] - e)
        fa, aa = fav / a, adv / a
        k = b["k"]
        inside = k <= horizon
        better = inside & (fa > st["df"] + 1e-12)
        net = fa * fade(k) - penalty * aa
        top = net > st["ne"] + 1e-12
        hit_stop = F.when(s == 1, b["low"] <= e - a * sl_mult).otherwise(b["high"] >= e + a * sl_mult)
        hit_goal = F.when(s == 1, b["high"] >= e + a * tp_mult).otherwise(b["low"] <= e - a * tp_mult)
        new = {
            "out": F.when(hit_stop, -1).when(hit_goal, 1).otherwise(0), "bar": k,
            "fav": F.greatest(st["fav"], fav), "adv": F.greatest(st["adv"], adv),
            "df": F.when(better, fa).otherwise(st["df"]), "da": F.when(inside, F.greatest(st["da"], aa)).otherwise(st["da"]),
            "pk": F.when(better, k).otherwise(st["pk"]), "ne": F.when(top, net).otherwise(st["ne"]),
            "tp": F.when(top, fa).otherwise(st["tp"]), "sl": F.when(top, aa).otherwise(st["sl"]), "nb": F.when(top, k).otherwise(st["nb"]),
        }
        over = st["out"] != 0
        return F.struct(*[F.when(over, st[n]).otherwise(v).alias(n) for n, v in new.items()])
    d = d.withColumn("_r", F.when(ok, F.aggregate("_path", start, walk)))
    r = F.col("_r")

    def val(x, none=0.0):
        return F.when(r.isNotNull(), x).otherwise(none)
    theta = F.when(r["pk"] > 0, fade(r["pk"])).otherwise(1.0)
    return d.withColumns({
        "outcome": val(r["out"], 0), "exit_bar": val(r["bar"], 0), "max_favorable": val(r["fav"]), "max_adverse": val(r["adv"]),
        "reward_risk": val(r["fav"] / (a * sl_mult)), "decision_mfe_atr": val(r["df"]), "decision_mae_atr": val(r["da"]),
        "decision_peak_bar": val(r["pk"], 0), "decision_theta_decay": val(theta, 1.0),
        "decision_net_edge_atr": val(r["df"] * theta - penalty * r["da"]),
        "optimal_tp_atr": val(r["tp"]), "optimal_sl_atr": val(r["sl"]), "optimal_exit_bar": val(r["nb"], 0),
        "optimal_net_edge_atr": val(F.when(r["nb"] > 0, r["ne"]).otherwise(0.0)),
    }).drop("_path", "_e", "_r")


def forward_ranges(df: DataFrame, f: Frames, atr: str = "atr", horizon: int = 20, share: float = 0.9) -> DataFrame:
    """Forward range over ATR for several horizons and the share of 30 bars in which 90% of the range is reached."""
    most, share_name = max(RANGE_HORIZONS), "decision_range_ttp90_norm_30"
    names = ["decision_forward_range_atr", *[f"decision_forward_range_{n}_atr" for n in RANGE_HORIZONS], share_name]
    schema = T.StructType([*df.schema.fields, *[T.StructField(n, T.DoubleType()) for n in names]])

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by(f.pos)
        high, low, a = (table[n].cast(pa.float64()).to_numpy(zero_copy_only=False) for n in ("high", "low", atr))
        a = np.where(a > 0, a, np.nan)
        ahead, left = Ahead(high, low, max(most, horizon)), len(a) - 1 - np.arange(len(a))
        # the H-bar range needs H later bars; the multi-horizon set needs all 30
        rng = lambda n, least: np.where(left >= least, ahead.span(n) / a, np.nan)
        out = [rng(horizon, horizon), *[rng(n, most) for n in RANGE_HORIZONS]]
        widest = rng(most, most)
        first = ahead.first(lambda span: span / a >= share * widest - 1e-12)
        out.append(np.where((widest > 1e-12) & (first <= most), first / float(most), np.nan))
        for n, v in zip(names, out):
            table = table.append_column(n, pa.array(v, mask=np.isnan(v)))
        return table

    return df.groupBy(*f.keys).applyInArrow(run, schema)


def quality_breakouts(df: DataFrame, f: Frames, lookback: int = 20) -> DataFrame:
    """At least three of: two strong bars, level break, volume, compression; needs the anatomy columns."""
    past = f.rows(-lookback, -1)
    k = F.col("close")
    volume = flag(F.col("volume") > 1.5 * F.avg("volume").over(past))
    tight = flag(f.mean("bar_range", 10) < 0.7 * F.avg("bar_range").over(f.rows(-29, -10)))
    bull = flag((F.col("is_strong_bull_trend") == 1) & (f.lag("is_strong_bull_trend") == 1)) + flag(k > F.max("high").over(past))
    bear = flag((F.col("is_strong_bear_trend") == 1) & (f.lag("is_strong_bear_trend") == 1)) + flag(k < F.min("low").over(past))
    return df.withColumns({"quality_bull_breakout": flag(bull + volume + tight >= 3), "quality_bear_breakout": flag(bear + volume + tight >= 3)})


def range_position(df: DataFrame, f: Frames, lookback: int = 40) -> DataFrame:
    """Place of the close in the last range, and direction changes over ten bars."""
    hi, lo = f.max("high", lookback), f.min("low", lookback)
    bull = F.col("is_bull")
    changes = F.lit(0)
    for i in range(1, 11):
        changes = changes + F.coalesce((bull != f.lag("is_bull", i)).cast("int"), F.lit(1))
    return df.withColumns({"rolling_high": hi, "rolling_low": lo, "tr_position": (F.col("close") - lo) / (hi - lo + 1e-10),
                           "direction_changes": changes})


def rule_signals(df: DataFrame) -> DataFrame:
    """First matching pattern with its strength and reason; an endless pullback skips. The first two bars have none."""
    g = F.col
    bull, bear, side = g("market_state").isin(0, 1), g("market_state").isin(2, 3), g("market_state").isin(4, 5)
    up, down = g("close") > g("open"), g("close") < g("open")
    rules = (
        (g("quality_bull_breakout") == 1, 1, 90, "E01_quality_bull_breakout"),
        (bull & (g("h_count") == 2) & up & (g("close") > g("ma")), 1, 70, "E03_H2_bull_pullback"),
        (side & (g("tr_position") < 0.3) & (g("is_bull") == 1) & (g("buy_pressure") > 50), 1, 50, "E13_TR_bottom_buy"),
        (bull & (g("h_count") == 1) & up & (g("buy_pressure") > 60), 1, 50, "H1_bull_pullback"),
        (g("quality_bear_breakout") == 1, -1, 90, "E01_quality_bear_breakout"),
        (bear & (g("l_count") == 2) & down & (g("close") < g("ma")), -1, 70, "L2_bear_pullback"),
        (side & (g("tr_position") > 0.7) & (g("is_bear") == 1) & (g("sell_pressure") > 50), -1, 50, "E13_TR_top_sell"),
    )
    early, skip = g("bar_no") < 2, g("endless_pullback") == 1
    sig, power, why = (F.when(early | skip, 0), F.when(early | skip, 0), F.when(early, "").when(skip, "E22_endless_pullback_skip"))
    for cond, s, p, name in rules:
        cond = yes(cond)
        sig, power, why = sig.when(cond, s), power.when(cond, p), why.when(cond, name)
    return df.withColumns({"signal": sig.otherwise(0), "signal_strength": power.otherwise(0), "signal_reason": why.otherwise("")})


def forward_z(df: DataFrame, f: Frames, horizon: int = 10, window: int = 60, limit: float = 5.0, session: str = "session_id", typical: str | None = None) -> DataFrame:
    """h-bar return over the volatility known one bar earlier, clipped; only inside one session.

    Eight returns are enough: before the window is full, its deviation is the one of all returns so far. `typical` names a
    column that stands in before that, such as the key's median absolute return.
    """
    d = df.withColumn("_r1", f.pct("close"))
    d = d.withColumns({"_sd": f.std("_r1", window, min(8, window)), "_fw": div(f.lead("close", horizon), "close") - 1.0,
                       "_same": f.lead(session, horizon) == F.col(session)})
    vol = f.lag("_sd") if typical is None else F.coalesce(f.lag("_sd"), F.col(typical) + 1e-6)
    z = F.when(F.col("_same"), F.col("_fw") / F.greatest(vol, F.lit(1e-6)))
    return d.withColumns({"forward_return": F.when(F.col("_same"), F.col("_fw")), "forward_z": clip(z, -limit, limit)}).drop("_r1", "_sd", "_fw", "_same")


def future_mean(f: Frames, x, n: int) -> Column:
    """Mean of the next n values."""
    return F.avg(c(x)).over(f.rows(1, n))


def changes_within(f: Frames, state, n: int) -> Column:
    """1 if any of the next n states differs from the present one; 0 without later rows."""
    s, w = c(state), f.rows(1, n)
    return flag((F.min(s).over(w) != s) | (F.max(s).over(w) != s))


def decision_edge(df: DataFrame, theta_start: int = 15, theta_decay: float = 5.0, penalty: float = 1.0) -> Column:
    """Stored net edge, else favourable times fading less adverse with clips, by the columns at hand."""
    have = set(df.columns)
    if "decision_net_edge_atr" in have:
        return fill(F.col("decision_net_edge_atr"), 0.0)
    mfe = clip(fill(F.col("decision_mfe_atr"), 0.0), 0.0, 5.0)
    mae = clip(fill(F.col("decision_mae_atr"), 0.0), 0.0, 4.0)
    if "decision_theta_decay" in have:
        theta = clip(fill(F.col("decision_theta_decay"), 1.0), 0.0, 1.0)
    elif "decision_peak_bar" in have:
        theta = F.exp(-F.greatest(fill(F.col("decision_peak_bar").cast("double"), 0.0) - theta_start, F.lit(0.0)) / theta_decay)
    else:
        raise ValueError("needs decision_theta_decay or decision_peak_bar")
    return mfe * theta - penalty * mae


def target_set(df: DataFrame, f: Frames, rv: str = "pa_rv_gk_20", horizon: int = 10) -> DataFrame:
    """Class, change within the horizon, volatility to come and its change, straddle edge. Needs `vol_class`."""
    d = df.withColumns({"y_transition": changes_within(f, "vol_class", horizon), "y_forecast": future_mean(f, rv, horizon)})
    d = d.withColumn("y_trend", F.col("y_forecast") - F.col(rv))
    return straddle_edge(d, f, horizon)


def parameter_grid(entries: DataFrame, bars: DataFrame, grid: Sequence[tuple[float, float]], horizon: int, *, keys: Sequence[str] = ("symbol",)) -> DataFrame:
    """One summary row per (tp, sl) multiple of the entry's ATR: first touch within the horizon, the stop first on one bar.

    `entries` has keys, bar_no, entry, atr and side. The settings are a short
    literal list exploded on the path, so all of them share one join.
    """
    from .rangejoin import forward_path
    p = forward_path(entries, bars, horizon, ["high", "low", "close"], keys=keys)
    lits = F.array(*[F.struct(F.lit(float(a)).alias("tp"), F.lit(float(b)).alias("sl")) for a, b in grid])
    s, e, a = F.col("side"), F.col("entry"), F.col("atr")
    best = F.when(s > 0, F.col("high") - e).otherwise(e - F.col("low"))
    worst = F.when(s > 0, e - F.col("low")).otherwise(F.col("high") - e)
    d = p.withColumns({"_b": best / a, "_w": worst / a, "_c": s * (F.col("close") - e) / a}).withColumn("g", F.explode(lits))
    d = d.select(*keys, "bar_no", "step", "_b", "_w", "_c", "g.tp", "g.sl")
    stop, goal = F.when(F.col("_w") >= F.col("sl"), F.col("step")), F.when(F.col("_b") >= F.col("tp"), F.col("step"))
    t = d.groupBy(*keys, "bar_no", "tp", "sl").agg(F.min(stop).alias("_s"), F.min(goal).alias("_g"), F.max_by("_c", "step").alias("_end"))
    lost = F.col("_s").isNotNull() & (F.col("_g").isNull() | (F.col("_s") <= F.col("_g")))
    r = F.when(lost, -F.col("sl")).when(F.col("_g").isNotNull(), F.col("tp")).otherwise(F.col("_end"))
    return t.withColumns({"_r": r, "_k": F.when(lost, "stop").when(F.col("_g").isNotNull(), "target").otherwise("time")}).groupBy("tp", "sl").agg(
        F.count(F.lit(1)).alias("n"), F.avg("_r").alias("mean_r"), F.avg(flag(F.col("_r") > 0)).alias("win_rate"),
        F.avg(flag(F.col("_k") == "stop")).alias("stop_rate"), F.avg(flag(F.col("_k") == "target")).alias("target_rate"))


def forward_up(df: DataFrame, horizon: int = 10, *, mode: str = "mde", alpha: float = 0.05, power: float = 0.80, q: float = 0.20,
               keys: Sequence[str] = ("symbol",), session: str = "session_id", left: str = "bars_remaining") -> DataFrame:
    """1 if the h-bar return inside one session beats the key's flat band, else 0; missing where the session ends before.

    The band is (z_alpha + z_beta) robust deviations, or the q quantile of the
    absolute return. Needs the session marks.
    """
    from statistics import NormalDist

    from .durable import durable
    from .ranks import exact_quantiles

    def build(x, f):
        same = (f.lead(session, horizon) == F.col(session)) & (F.col(left) >= horizon)
        return x.withColumn("forward_return", F.when(same, (f.lead("close", horizon) - F.col("close")) / (F.abs("close") + 1e-9)))
    d = durable(in_chunks(df, build, history=0, lookahead=horizon, keys=keys))
    known = d.where(F.col("forward_return").isNotNull())
    if mode == "quantile":
        band = exact_quantiles(known.withColumn("_m", F.abs("forward_return")), "_m", {"band": q}, keys)
    else:
        med = exact_quantiles(known, "forward_return", {"_med": 0.5}, keys)
        dev = known.join(med, list(keys)).withColumn("_dev", F.abs(F.col("forward_return") - F.col("_med")))
        z = NormalDist().inv_cdf(1.0 - alpha / 2.0) + NormalDist().inv_cdf(power)
        mad = exact_quantiles(dev, "_dev", {"_mad": 0.5}, keys)
        band = mad.select(*keys, (z * F.greatest(F.col("_mad") / 0.67448975, F.lit(1e-8))).alias("band"))
    d = d.join(band, list(keys), "left")
    return d.withColumn("forward_up", F.when(F.col("forward_return").isNotNull(), flag(F.col("forward_return") > F.col("band"))))
