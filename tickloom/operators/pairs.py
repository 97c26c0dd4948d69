"""Two-symbol statistics and rolling costs."""
from __future__ import annotations

import math

from pyspark.sql import DataFrame, functions as F

from ..functions.exprs import clip, fill
from . import rolling
from .asof import asof_backward
from .layout import Frames, in_chunks, number_rows, running
from .order_stats import Order, order_stats


def pair_features(bars: DataFrame, a: str, b: str, window: int = 60, least: int = 20) -> DataFrame:
    """Closes of two symbols side by side in time, and rolling correlation, volatility ratio and slope of their returns."""
    p = bars.where(F.col("symbol").isin(a, b)).groupBy("t").pivot("symbol", [a, b]).agg(F.max_by("close", "bar_no"))
    p = number_rows(p.select(F.lit("pair").alias("pair"), "t", F.col(a).alias("_a"), F.col(b).alias("_b")), ("pair",), ("t",))
    p = running(p, {"_fa": ("last", F.col("_a")), "_fb": ("last", F.col("_b"))}, keys=("pair",))

    def build(d: DataFrame, f: Frames) -> DataFrame:
        d = d.withColumns({"_ra": fill(f.pct("_fa"), 0.0), "_rb": fill(f.pct("_fb"), 0.0)})
        return d.withColumns({"pair_corr": fill(rolling.corr(f, "_ra", "_rb", window, least), 0.0),
                              "pair_vol_ratio": fill(f.std("_ra", window, least) / (f.std("_rb", window, least) + 1e-8), 1.0),
                              "pair_beta": fill(rolling.beta(f, "_ra", "_rb", window, least), 0.0)})
    d = in_chunks(p, build, history=window + 1, keys=("pair",))
    return d.select("t", "pair_corr", "pair_vol_ratio", "pair_beta")


def attach_pair(bars: DataFrame, pair: DataFrame, cols=("pair_corr", "pair_vol_ratio", "pair_beta")) -> DataFrame:
    """Latest pair values at or before each bar, for every symbol.

    The pair table is market-wide, with one row per time. Each bar time is
    matched once, and bars pick the result up by an equi join on time.
    """
    times = bars.select(F.lit("pair").alias("pair"), "t").distinct()
    at = asof_backward(times, pair.withColumn("pair", F.lit("pair")), list(cols), keys=("pair",)).drop("pair")
    return bars.join(at, "t")


def rolling_cost(df: DataFrame, f: Frames, x: str, lookback: int, q: float = 0.5, floor: float = 2.0, cap: float = 8.0, default: str | None = None,
                 out: str = "roll_cost") -> DataFrame:
    """Quantile of the past `lookback` values (not the present one), else the default column, clipped."""
    d = order_stats(df.withColumn("_past", f.lag(x)), f, {"_q": Order("_past", lookback, "quantile", max(50, lookback // 4), q)})
    v = F.coalesce("_q", F.col(default) if default else F.lit(3.0))
    return d.withColumn(out, F.least(F.greatest(v, F.lit(floor)), F.lit(cap))).drop("_past", "_q")


def dynamic_cost(df: DataFrame, atr: str, base: float, lookback: int = 390, q: float = 0.7, keys=("symbol",)) -> DataFrame:
    """Base cost times ATR over its rolling quantile, 0.5..3 times, 0.05..5 in all; a missing quantile is filled forward, then back."""
    least = max(10, lookback // 10)
    d = in_chunks(df, lambda x, f: order_stats(x, f, {"_ref": Order(atr, lookback, "quantile", least, q)}), history=lookback, keys=keys)
    r = F.when(F.col("_ref") > 1e-12, F.col("_ref"))
    d = running(d, {"_ff": ("last", r)}, keys=keys)
    first = d.where(F.col("_ff").isNotNull()).groupBy(*keys).agg(F.min_by("_ff", "bar_no").alias("_bf"))
    d = d.join(first, list(keys), "left")
    ref = F.coalesce("_ff", "_bf")
    return d.withColumn("dynamic_cost", clip(base * clip(F.col(atr) / ref, 0.5, 3.0), 0.05, 5.0)).drop("_ref", "_ff", "_bf")


def implied_range(df: DataFrame, f: Frames, atr: str, hold: int, lookback: int = 390, z: str | None = None, beta: float = 0.05,
                  mult: float = 1.0 / 0.85, out: str = "implied_range_atr") -> DataFrame:
    """Rolling return deviation scaled to the holding time and to ATR units, adjusted by the index z-score."""
    d = df.withColumn("_r", fill(f.pct("close"), 0.0))
    rv = f.std("_r", lookback, max(20, lookback // 5))
    adj = F.lit(1.0) if z is None else clip(1.0 + beta * fill(F.col(z), 0.0), 0.50, 1.50)
    rel = clip(clip(rv, 1e-7, 1.0) * mult * math.sqrt(max(hold, 1)) * adj, 1e-7, 2.5)
    a = F.greatest(F.col(atr), F.lit(1e-6))
    return d.withColumn(out, clip(rel * F.greatest(F.col("close"), F.lit(1e-6)) / a, 0.01, 50.0)).drop("_r")
