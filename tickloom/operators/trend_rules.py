"""Chandelier stops, rule entry signals, signal combinations."""
from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.exprs import c, fill, price_source, yes
from . import indicators as ind, rolling
from .durable import durable
from .ewm import reach
from .fold import ordered_fold
from .layout import in_chunks
from .order_stats import Order, order_stats
from .sequences import latch


def chandelier(df: DataFrame, length: int = 22, mult: float = 3.0, use_close: bool = True, prefix: str = "ce", keys=("symbol",),
               warm: int = 256, **kw) -> DataFrame:
    """Ratchet stops that reset when the previous close crosses them, direction, and flips as signals."""
    hi, lo = ("close", "close") if use_close else ("high", "low")

    def raw(d, f):
        d = ind.atr(d, f, length, "_atr")
        return d.withColumns({"_atr": F.col("_atr") * mult, "_up": f.max(hi, length, length) - F.col("_atr") * mult,
                              "_dn": f.min(lo, length, length) + F.col("_atr") * mult, "_pc": f.lag("close")})
    d = in_chunks(df, raw, history=reach(1.0 / length) + length + 1, keys=keys)

    def step(pdf, state):
        ls, ss, side = state
        a, b, s = [], [], []
        for up, dn, k, pc in zip(pdf["_up"].to_numpy(dtype=float), pdf["_dn"].to_numpy(dtype=float),
                                 pdf["close"].to_numpy(dtype=float), pdf["_pc"].to_numpy(dtype=float)):
            new_l = max(up, ls) if not math.isnan(ls) and not math.isnan(up) and pc > ls else up
            new_s = min(dn, ss) if not math.isnan(ss) and not math.isnan(dn) and pc < ss else dn
            if not math.isnan(ss) and k > ss:
                side = 1.0
            elif not math.isnan(ls) and k < ls:
                side = -1.0
            ls, ss = new_l, new_s
            a.append(ls)
            b.append(ss)
            s.append(int(side))
        return {f"{prefix}_long_stop": a, f"{prefix}_short_stop": b, f"{prefix}_dir": s}, [ls, ss, side]
    nan = float("nan")
    d = ordered_fold(d, step, {f"{prefix}_long_stop": "double", f"{prefix}_short_stop": "double", f"{prefix}_dir": "int"}, [nan, nan, 1.0],
                     warm=warm, keys=keys, **kw)
    no = lambda n: F.when(~F.isnan(n), F.col(n))
    side = F.col(f"{prefix}_dir")
    d = d.withColumns({f"{prefix}_long_stop": no(f"{prefix}_long_stop"), f"{prefix}_short_stop": no(f"{prefix}_short_stop")})
    d = in_chunks(d, lambda x, f: x.withColumns({
        f"{prefix}_buy_signal": yes((side == 1) & (f.lag(side) == -1)), f"{prefix}_sell_signal": yes((side == -1) & (f.lag(side) == 1))}), history=1, keys=keys)
    return d.withColumns({f"{prefix}_atr": F.col("_atr"), f"{prefix}_state_long": side == 1, f"{prefix}_state_short": side == -1}).drop("_atr", "_up", "_dn", "_pc")


def rule_base(df: DataFrame, zlsma: int = 50, er: int = 9, fast: int = 2, slow: int = 30, atr_length: int = 14, rank: int = 120,
              cvd_lookback: int = 20, cvd_slope: int = 3) -> DataFrame:
    """Trend averages with slopes, ATR with its rank, volume delta with divergence flags."""
    d = ind.kama(df, er, fast, slow, source="hlc3")

    def build(x, f):
        x = rolling.zlsma(x.withColumn("_p", price_source("hlc3")), f, "_p", zlsma, "zlsma").drop("_p")
        x = ind.atr(x, f, atr_length, "atr_raw")
        x = x.withColumns({"kama_slope": f.pct("kama"), "zlsma_slope": f.pct("zlsma")})
        return order_stats(x, f, {"atr_percentile": Order("atr_raw", rank, "share", rank)})
    d = in_chunks(d, build, history=2 * zlsma + reach(1.0 / atr_length) + rank)
    return ind.cvd_divergence(ind.pseudo_cvd(d), cvd_lookback, cvd_slope)


#: States in which the higher frame counts as trending.
BULL_CHANNELS, BEAR_CHANNELS = ("tight_bull_channel", "wide_bull_channel"), ("tight_bear_channel", "wide_bear_channel")
#: Columns that each gate reads; a gate whose columns are missing lets everything pass.
GATE_COLUMNS = {
    "opening_range": ("or_period",), "signal_bar": ("pa_strong_bull_signal", "pa_strong_bear_signal"), "second_entry": ("pa_is_h2_setup", "pa_is_l2_setup"),
    "pressure": ("pa_net_pressure",), "regime": ("pa_regime_trend",), "twenty_bar": ("pa_trend_weakened",), "inside_inside": ("pa_is_ii_pattern",),
    "higher_frame": ("pa_env_state", "pa_env_trend_dir"), "triggers": (),
}
TRIGGERS = (("pa_is_h2_setup", "pa_mag20_bull", "pa_breakout_success_up"), ("pa_is_l2_setup", "pa_mag20_bear", "pa_breakout_success_down"))


def gated(a: Column, b: Column, gates, columns, pressure: float = 0.0) -> tuple[Column, Column]:
    """Raw long and short signals behind the named gates, in the order of GATE_COLUMNS.

    All gates take signals away but `inside_inside`, which adds one in the direction of the bar."""
    def any_of(names):
        out = F.lit(False)
        for n in names:
            out = out | yes(F.col(n)) if n in columns else out
        return out

    rise, drop = F.col("close") > F.col("open"), F.col("close") < F.col("open")
    for g, needed in GATE_COLUMNS.items():
        if g not in gates or not set(needed) <= set(columns):
            continue
        x = [F.col(n) for n in needed]
        if g == "opening_range":
            keep = (~F.coalesce(x[0], F.lit(True)),) * 2
        elif g in ("signal_bar", "second_entry"):
            keep = yes(x[0]), yes(x[1])
        elif g == "pressure":
            keep = yes(x[0] >= pressure), yes(x[0] <= -pressure)
        elif g == "regime":
            keep = (~((yes(F.col("ce_buy_signal")) | yes(F.col("ce_sell_signal"))) & yes(x[0])),) * 2
        elif g == "twenty_bar":
            keep = (~yes(x[0]),) * 2
        elif g == "higher_frame":
            keep = yes(x[0].isin(*BULL_CHANNELS) & (x[1] == 1)), yes(x[0].isin(*BEAR_CHANNELS) & (x[1] == -1))
        elif g == "triggers":
            keep = any_of(TRIGGERS[0]), any_of(TRIGGERS[1])
        else:
            a, b = a | (yes(x[0]) & yes(rise)), b | (yes(x[0]) & yes(drop))
            continue
        a, b = a & keep[0], b & keep[1]
    return a, b


def raw_signals(*, trend_mode: str = "price", slope: float = 0.0, atr_rank: float = 0.0, ce_only: bool = False, relaxed: bool = False) -> tuple[Column, Column]:
    """Long and short signals from chandelier flips, trend conditions and the flips' latches `_la`, `_sa`.

    `relaxed`: outside of trending states (`pa_env_state`) a flip only needs the price beyond the ZLSMA."""
    k, z, m = F.col("close"), F.col("zlsma"), F.col("kama")
    buy, sell = yes(F.col("ce_buy_signal")), yes(F.col("ce_sell_signal"))
    rank = yes(F.col("atr_percentile") >= atr_rank) if atr_rank > 0 else F.lit(True)
    if ce_only:
        return buy & rank, sell & rank
    up, dn = (k > z) & (k > m), (k < z) & (k < m)
    if trend_mode == "stacked_trend":
        up, dn = up & (z > m), dn & (z < m)
    zs, ks = fill(F.col("zlsma_slope"), 0.0), fill(F.col("kama_slope"), 0.0)
    flat = (zs >= -slope, zs <= slope) if slope > 0 else (F.lit(True), F.lit(True))
    steep = (ks >= slope, ks <= -slope) if slope > 0 else (ks > 0, ks < 0)
    up, dn = yes(up) & flat[0], yes(dn) & flat[1]
    if relaxed:
        trending = yes(F.col("pa_env_state").isin(*BULL_CHANNELS, *BEAR_CHANNELS))
        up, dn = F.when(trending, up).otherwise(yes(k > z)), F.when(trending, dn).otherwise(yes(k < z))
    return (buy & up & rank) | (F.col("_la") & yes(m > z) & steep[0] & rank), (sell & dn & rank) | (F.col("_sa") & yes(m < z) & steep[1] & rank)


def entry_signals(df: DataFrame, *, trend_mode: str = "price", slope: float = 0.0, atr_rank: float = 0.0, classic: bool = False,
                  slope_div: bool = False, ce_only: bool = False, relaxed: bool = False, gates=(), pressure: float = 0.0,
                  confirmation: str = "none", t: str = "t") -> DataFrame:
    """long_entry and short_entry from chandelier flips, trend conditions and gates; needs `rule_base` and `chandelier`."""
    k = F.col("close")
    d = latch(df, "ce_buy_signal", "ce_sell_signal", "_la", "_sa")
    a, b = raw_signals(trend_mode=trend_mode, slope=slope, atr_rank=atr_rank, ce_only=ce_only, relaxed=relaxed and "pa_env_state" in df.columns)
    for on, kind in ((classic, "classic"), (slope_div, "slope")):
        if on:
            a, b = a & F.coalesce(f"cvd_{kind}_long_ok", F.lit(True)), b & F.coalesce(f"cvd_{kind}_short_ok", F.lit(True))
    a, b = gated(a, b, gates, df.columns, pressure)
    d = d.withColumns({"_a": a, "_b": b})
    if confirmation == "none":
        return d.withColumns({"long_entry": F.col("_a"), "short_entry": F.col("_b")}).drop("_la", "_sa", "_a", "_b")
    day = F.to_date(t)
    ups, downs = {"next_bar_body": (k > F.col("open"), k < F.col("open")),
                  "next_bar_no_reverse_close": (k >= F.col("open"), k <= F.col("open"))}[confirmation]

    def shift(x, f):
        same = yes(f.lag(day) == day)
        return x.withColumns({"long_entry": yes(f.lag("_a")) & same & yes(ups), "short_entry": yes(f.lag("_b")) & same & yes(downs)})
    return in_chunks(d, shift, history=1).drop("_la", "_sa", "_a", "_b")


def signal_from_sides(long: Column, short: Column) -> Column:
    """+1, -1 or 0, also 0 if both hold."""
    return yes(long).cast("int") - yes(short).cast("int")


def combinations(df: DataFrame, parts: dict[str, tuple[Column, Column]], combos: dict[str, list[str]], keep=("symbol", "t", "bar_no")) -> DataFrame:
    """Long table (bar, strategy, signal): a combination is long when all its parts are long."""
    def both(names):
        a, b = F.lit(True), F.lit(True)
        for n in names:
            a, b = a & yes(parts[n][0]), b & yes(parts[n][1])
        return signal_from_sides(a, b)
    rows = F.array(*[F.struct(F.lit(n).alias("strategy"), both(p).alias("signal")) for n, p in combos.items()])
    return df.select(*keep, F.explode(rows).alias("_s")).select(*keep, "_s.*")


#: The named strategies as conjunctions of parts; `_recent` is the part within the last RECENT bars.
STRATEGIES = {
    "ce_reversal": ("flip",), "zlsma_kama_cross": ("cross",), "smc_structure": ("structure",), "smc_fvg": ("gap",), "smc_order_block": ("block",), "smc_any_event": ("any",),
    "ce_plus_trend": ("flip", "trend"), "ce_plus_structure": ("flip", "structure_recent"), "ce_plus_fvg": ("flip", "gap_recent"), "ce_plus_ob": ("flip", "block_recent"),
    "ce_plus_smc_any": ("flip", "any_recent"), "trend_plus_structure": ("cross", "structure_recent"), "trend_plus_fvg": ("cross", "gap_recent"),
    "trend_plus_ob": ("cross", "block_recent"), "trend_plus_smc_any": ("cross", "any_recent"), "ce_trend_structure": ("flip", "trend", "structure_recent"),
    "ce_trend_fvg": ("flip", "trend", "gap_recent"), "ce_trend_ob": ("flip", "trend", "block_recent"), "ce_trend_smc_any": ("flip", "trend", "any_recent"),
}
RECENT = 10


def strategy_signals(df: DataFrame, recent: int = RECENT, keep=("symbol", "t", "bar_no")) -> DataFrame:
    """Long table (bar, strategy, signal) of STRATEGIES; needs chandelier flips, both averages, structure events, order blocks and gaps."""
    z, m = F.col("zlsma"), F.col("kama")
    broke = lambda side: F.greatest(*[yes(F.col(f"{w}_{side}_{e}")) for w in ("swing", "internal") for e in ("bos", "choch")])
    d = df.withColumns({"_trend_l": yes(z > m), "_trend_s": yes(z < m), "_flip_l": yes(F.col("ce_buy_signal")), "_flip_s": yes(F.col("ce_sell_signal"))})
    for side, word in (("l", "bullish"), ("s", "bearish")):
        d = d.withColumns({f"_structure_{side}": broke(word), f"_gap_{side}": yes(F.col(f"{word}_fvg")), f"_block_{side}": F.col(f"{word}_order_block_top").isNotNull()})
        d = d.withColumn(f"_any_{side}", F.col(f"_structure_{side}") | F.col(f"_gap_{side}") | F.col(f"_block_{side}"))

    def build(x, f):
        out = {}
        for side in "ls":
            out[f"_cross_{side}"] = F.col(f"_trend_{side}") & ~yes(f.lag(f"_trend_{side}"))
            out |= {f"_{p}_recent_{side}": F.max(f"_{p}_{side}").over(f.last(recent)) for p in ("structure", "gap", "block", "any")}
        return x.withColumns(out)
    d = in_chunks(d, build, history=recent)
    parts = {p: (F.col(f"_{p}_l"), F.col(f"_{p}_s")) for p in {p for ps in STRATEGIES.values() for p in ps}}
    return combinations(d, parts, {n: list(ps) for n, ps in STRATEGIES.items()}, keep)
