"""Row decisions: sessions, regimes, signals, drivers, fills."""
from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.exprs import c, clip, fill, first_of, minute_of_day

# Inclusive session windows in minutes of the day.
SESSIONS = {
    "all_day": (),
    "first_hour": ((575, 630),),
    "morning": ((575, 660),),
    "before_1230": ((570, 750),),
    "trend_windows": ((575, 660), (840, 930)),
}

# Strategy per volatility class, and its entry start, entry cutoff, forced exit and expiry.
STRATEGY_OF_REGIME = {
    0: "SHORT_STRADDLE_R0",
    1: "LONG_STRADDLE_R1",
    2: "GAMMA_SCALP_R2",
    3: "SHORT_STRADDLE_R3",
    4: "IRON_CONDOR_R4",
}
STRATEGY_WINDOWS = {
    "SHORT_STRADDLE_R0": ("10:45", "15:00", "15:30", "16:00"),
    "IRON_BUTTERFLY_R0": ("10:45", "15:00", "15:30", "16:00"),
    "LONG_STRADDLE_R1": ("09:35", "15:30", "15:55", "16:00"),
    "GAMMA_SCALP_R2": ("09:35", "15:30", "15:55", "16:00"),
    "SHORT_STRADDLE_R3": ("10:30", "11:00", "15:30", "16:00"),
    "IRON_CONDOR_R4": ("10:45", "15:00", "15:30", "16:00"),
}
SYNTHETIC_PREFIXES = ("SHORT_STRADDLE_", "LONG_STRADDLE_", "GAMMA_SCALP_", "IRON_CONDOR_", "IRON_BUTTERFLY_")
DRIVERS = ("synthetic_rules", "l3_learned", "l3_mtm_adaptive", "l3_value_rule", "atr_trailing", "deadline",
           "signal_flip", "short_vol_explosion", "unknown", "legacy_unlabeled")
SIZE_OF_REGIME = {0: 0.7, 1: 1.0, 2: 1.0, 3: 0.8, 4: 0.6}


def lookup(table: Mapping, key: Column, default) -> Column:
    """Value of a small map, else the default."""
    pairs = [x for k, v in table.items() for x in (F.lit(k), F.lit(v))]
    return F.coalesce(F.try_element_at(F.create_map(*pairs), key), F.lit(default))


def hhmm(text: Column) -> Column:
    """Minutes of the day of an HH:MM text."""
    part = F.split(text, ":")
    return part[0].cast("int") * 60 + part[1].cast("int")


def session_allowed(t, name: str) -> Column:
    """Inclusive time-of-day windows, to the microsecond."""
    windows = SESSIONS[name]
    if not windows:
        return F.lit(True)
    at = F.date_format(c(t), "HH:mm:ss.SSSSSS")
    cond = F.lit(False)
    for lo, hi in windows:
        cond = cond | at.between(f"{lo // 60:02d}:{lo % 60:02d}:00.000000", f"{hi // 60:02d}:{hi % 60:02d}:00.000000")
    return cond


def entry_window(df: DataFrame, strategy: str = "strategy", t: str = "t") -> DataFrame:
    """Add the strategy's window in minutes and whether start <= minute < cutoff."""
    names = ("entry_start", "entry_cutoff", "force_exit", "expiry")
    default = STRATEGY_WINDOWS["LONG_STRADDLE_R1"]
    cols = {n: hhmm(lookup({k: v[i] for k, v in STRATEGY_WINDOWS.items()}, F.col(strategy), default[i]))
            for i, n in enumerate(names)}
    m = minute_of_day(t)
    return df.withColumns(cols).withColumn(
        "entry_ok", (m >= F.col("entry_start")) & (m < F.col("entry_cutoff")))


def regime_allowed(regime, allow: Sequence[int] = (), block: Sequence[int] = ()) -> Column:
    """An allow list wins over a block list."""
    if allow:
        return c(regime).isin(list(allow))
    return ~c(regime).isin(list(block)) if block else F.lit(True)


def strategy_of(regime, butterfly: bool = False) -> Column:
    table = dict(STRATEGY_OF_REGIME)
    if butterfly:
        table[0] = "IRON_BUTTERFLY_R0"
    return lookup(table, c(regime).cast("int"), STRATEGY_OF_REGIME[1])


def class_of_signal(signal) -> Column:
    """0 long volatility, 1 no trade, 2 short volatility."""
    s = c(signal)
    return F.when(s > 0.5, 0).when(s < -0.5, 2).otherwise(1)


def decision_class(df: DataFrame) -> Column:
    """The stored class if there is such a column, else the class of the first signal column."""
    if "l2_decision_class" in df.columns:
        return clip(fill(F.col("l2_decision_class").try_cast("double"), 1.0), 0, 2).cast("int")
    s = first_of(df, ("l2_vol_signal", "l2_straddle_on"), 0.0)
    return class_of_signal(fill(s.try_cast("double"), 0.0))


def entry_side(decision, confidence, size, min_confidence, min_size) -> Column:
    """+1 long, -1 short, 0 when the class, the confidence or the size does not allow a trade."""
    ok = (c(confidence) >= min_confidence) & (c(size) >= min_size)
    return F.when(F.coalesce(ok, F.lit(False)) & (c(decision) == 0), 1).when(
        F.coalesce(ok, F.lit(False)) & (c(decision) == 2), -1).otherwise(0)


def two_stage(gate, p, gate_threshold: float, margin: float) -> Column:
    """0 long, 1 abstain, 2 short: trade past the gate unless the direction is unsure."""
    return (F.when(c(gate) < gate_threshold, 1)
            .when(F.abs(2 * c(p) - 1) <= margin, 1)
            .when(c(p) >= 0.5, 0).otherwise(2))


def structure_veto(gate, setup, range_pressure, premise_break, veto) -> Column:
    allow = 0.20 + 0.95 * c(setup) - 0.40 * c(range_pressure) - 0.35 * c(premise_break) - 0.20 * c(veto)
    return c(gate) * clip(allow, 0.0, 1.0)


def exit_driver(df: DataFrame, strategy: str = "strategy") -> Column:
    """The stored driver, else one told by the strategy's name."""
    s = F.coalesce(F.col(strategy), F.lit(""))
    told = F.lit(False)
    for p in SYNTHETIC_PREFIXES:
        told = told | s.startswith(p)
    derived = F.when(told, "synthetic_rules").otherwise("legacy_unlabeled")
    return F.coalesce(F.col("primary_exit_driver"), derived) if "primary_exit_driver" in df.columns else derived


def driver_kept(driver, mode: str) -> Column:
    if mode == "l3_learned":
        return c(driver).isin("l3_learned", "l3_mtm_adaptive")
    if mode == "synthetic_rules":
        return c(driver) == "synthetic_rules"
    return F.lit(True)


def fill_price(price, is_buy, slip_bps: float = 0.0, fee_bps: float = 0.0) -> Column:
    adj = (slip_bps + fee_bps) * 1e-4
    return c(price) * F.when(c(is_buy), F.lit(1.0 + adj)).otherwise(F.lit(1.0 - adj))


def size_multiplier(regime, confidence, use_signal: bool = True) -> Column:
    base = lookup(SIZE_OF_REGIME, F.least(F.greatest(c(regime).cast("int"), F.lit(0)), F.lit(4)), 1.0)
    if not use_signal:
        return base
    step = F.when(c(confidence) > 0.6, 1.0).when(c(confidence) >= 0.5, 0.7).otherwise(0.5)
    return base * step


def exit_levels(entry, atr, side, model: str, tp_mult=2.0, sl_mult=1.0, tp_pct=0.01, sl_pct=0.005,
                rr_floor: float = 0.0) -> tuple[Column, Column]:
    """Stop and target price; models atr, pct, pct_tp_atr_sl, atr_tp_pct_sl."""
    tp_atr, sl_atr = c(atr) * tp_mult, c(atr) * sl_mult
    tp_rel, sl_rel = c(entry) * tp_pct, c(entry) * sl_pct
    tp, sl = {"atr": (tp_atr, sl_atr), "pct": (tp_rel, sl_rel),
              "pct_tp_atr_sl": (tp_rel, sl_atr), "atr_tp_pct_sl": (tp_atr, sl_rel)}[model]
    s = c(side)
    stop = F.when(sl > 0, c(entry) - s * sl)
    target = F.when(tp > 0, c(entry) + s * tp)
    if rr_floor > 0:
        risk = F.abs(c(entry) - stop)
        least = c(entry) + s * rr_floor * risk
        better = F.when(s > 0, F.greatest(target, least)).otherwise(F.least(target, least))
        target = F.when(risk > 0, better).otherwise(target)
    return stop, target
