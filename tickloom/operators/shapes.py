"""Bar anatomy and bar-to-bar shape."""
from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions.exprs import flag
from .layout import Frames

TINY = 1e-10


def bar_anatomy(df: DataFrame) -> DataFrame:
    """Body, wicks, ratios and trend-bar flags of single bars."""
    o, h, l, k = (F.col(x) for x in ("open", "high", "low", "close"))
    d = df.withColumns({
        "body": k - o,
        "body_abs": F.abs(k - o),
        "bar_range": F.when(h == l, F.lit(TINY)).otherwise(h - l),
        "upper_wick": h - F.greatest(o, k),
        "lower_wick": F.least(o, k) - l,
    })
    d = d.withColumns({
        "body_ratio": F.col("body_abs") / F.col("bar_range"),
        "upper_wick_ratio": F.col("upper_wick") / F.col("bar_range"),
        "lower_wick_ratio": F.col("lower_wick") / F.col("bar_range"),
        "is_bull": flag(k > o),
        "is_bear": flag(k < o),
        "close_position": (k - l) / F.col("bar_range"),
    })
    big = F.col("body_ratio") > 0.6
    return d.withColumns({
        "is_trend_bar": flag(big),
        "is_doji": flag(F.col("body_ratio") < 0.3),
        "is_strong_bull_trend": flag((F.col("is_bull") == 1) & big & (F.col("upper_wick_ratio") < 0.2)),
        "is_strong_bear_trend": flag((F.col("is_bear") == 1) & big & (F.col("lower_wick_ratio") < 0.2)),
    })


def bar_shape(df: DataFrame, f: Frames) -> DataFrame:
    """Flags against the previous bar; needs `bar_range`. History: 1 row."""
    h, l, o, k = (F.col(x) for x in ("high", "low", "open", "close"))
    ph, pl, pk = f.lag("high"), f.lag("low"), f.lag("close")
    return df.withColumns({
        "is_inside_bar": flag((h <= ph) & (l >= pl)),
        "is_outside_bar": flag((h > ph) & (l < pl)),
        "gap_up": flag(l > ph),
        "gap_down": flag(h < pl),
        "body_gap_up": flag(o > pk),
        "body_gap_down": flag(o < pk),
        "higher_high": flag(h > ph),
        "lower_low": flag(l < pl),
        "higher_low": flag(l > pl),
        "lower_high": flag(h < ph),
        "overlap": F.when(ph.isNotNull(), F.greatest(F.lit(0.0), F.least(h, ph) - F.greatest(l, pl)) / F.col("bar_range")),
    })


def pressure_label(df: DataFrame, f: Frames, window: int = 10) -> DataFrame:
    """Buy and sell pressure in four parts of 25 points; needs the anatomy columns."""
    d = df.withColumns({
        "_bull_body": F.when(F.col("is_bull") == 1, F.col("body_abs")).otherwise(0.0),
        "_bear_body": F.when(F.col("is_bear") == 1, F.col("body_abs")).otherwise(0.0),
    })
    d = d.withColumns({
        "bull_ratio": f.mean("is_bull", window), "bear_ratio": f.mean("is_bear", window),
        "bull_body_avg": f.mean("_bull_body", window), "bear_body_avg": f.mean("_bear_body", window),
        "avg_close_pos": f.mean("close_position", window),
        "avg_lower_wick": f.mean("lower_wick_ratio", window), "avg_upper_wick": f.mean("upper_wick_ratio", window),
    })
    d = d.withColumn("body_dominance", F.col("bull_body_avg") / (F.col("bear_body_avg") + TINY))
    dom = F.col("body_dominance")
    inverse = 1.0 / (F.greatest(F.least(dom, F.lit(3.0)), F.lit(0.33)) + TINY)
    half = max(2, window // 2)
    early = f.rows(-(2 * half - 1), -half)
    return d.withColumns({
        "buy_pressure": 25 * F.col("bull_ratio") + 25 * (F.least(F.greatest(dom, F.lit(0.0)), F.lit(3.0)) / 3)
        + 25 * F.col("avg_close_pos") + 25 * F.col("avg_lower_wick"),
        "sell_pressure": 25 * F.col("bear_ratio") + 25 * F.least(F.greatest(inverse, F.lit(0.0)), F.lit(1.0))
        + 25 * (1 - F.col("avg_close_pos")) + 25 * F.col("avg_upper_wick"),
        "bull_body_growing": flag(f.mean("_bull_body", half) > F.avg("_bull_body").over(early)),
        "bear_body_growing": flag(f.mean("_bear_body", half) > F.avg("_bear_body").over(early)),
    }).drop("_bull_body", "_bear_body")
