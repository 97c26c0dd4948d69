"""Closed coarse bars."""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from .durable import durable
from .layout import number_rows


def resample(df: DataFrame, width: str, *, keys: Sequence[str] = ("symbol",), t: str = "t", tie: str | None = None,
             edge: str = "right", closed_only: bool = True) -> DataFrame:
    """OHLCV buckets [T - width, T), stamped at the right (or left) edge.

    Open and close follow (t, tie). With `closed_only` the last bucket of a key
    is dropped while its right edge is after the newest row of the key. All
    aggregates combine on the map side, so a hot key costs one row per bucket
    and input partition. The bars are written out once (`durable`): they are read
    several times from here on, the ticks only here.
    """
    at = F.struct(t, tie) if tie else F.col(t)  # a single time keeps the hash aggregate
    bars = df.groupBy(*keys, F.window(t, width).alias("_w")).agg(
        F.min_by("open", at).alias("open"), F.max("high").alias("high"), F.min("low").alias("low"),
        F.max_by("close", at).alias("close"), F.sum("volume").alias("volume"), F.max(t).alias("_newest"))
    bars = durable(bars)
    if closed_only:
        newest = bars.groupBy(*keys).agg(F.max("_newest").alias("_last"))
        bars = bars.join(newest, list(keys)).where(F.col("_w.end") <= F.col("_last")).drop("_last")
    stamp = F.col("_w.end") if edge == "right" else F.col("_w.start")
    return bars.select(*keys, stamp.cast("timestamp_ntz").alias("t"), "open", "high", "low", "close", "volume")


def tick_bars(ticks: DataFrame, width: str, *, symbol: str, t: str, price: str, tie: str,
              size=None, closed_only: bool = True) -> DataFrame:
    """Bars from single prices; without a size column the volume is the number of ticks."""
    p = F.col(price)
    one = ticks.select(F.col(symbol).cast("string").alias("symbol"), F.col(t).alias("t"), F.col(tie).alias("_tie"),
                       p.alias("open"), p.alias("high"), p.alias("low"), p.alias("close"),
                       (F.lit(1.0) if size is None else F.col(size).cast("double")).alias("volume"))
    return resample(one, width, tie="_tie", closed_only=closed_only)


def numbered_bars(*args, **kw) -> DataFrame:
    return number_rows(tick_bars(*args, **kw))
