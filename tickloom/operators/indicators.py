"""Indicator operators."""
from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.exprs import clip, div, fill, flag, price_source, yes
from .ewm import ewm_mean
from .layout import Frames, in_chunks
from .scan import affine_scan


def true_range(f: Frames) -> Column:
    prev = f.lag("close")
    h, l = F.col("high"), F.col("low")
    return F.greatest(h - l, F.abs(h - prev), F.abs(l - prev))


def atr(df: DataFrame, f: Frames, n: int, out: str = "atr") -> DataFrame:
    """Wilder average of the true range. History: reach(1/n) + 1."""
    d = df.withColumn(f"_tr_{n}", true_range(f))
    return ewm_mean(d, f, f"_tr_{n}", out, alpha=1.0 / n, least=n).drop(f"_tr_{n}")


def centered_pivots(df: DataFrame, f: Frames, arm: int, high: str = "pivot_high", low: str = "pivot_low") -> DataFrame:
    """Highest high (lowest low) of the full window of +-arm bars; ties count."""
    w = f.rows(-arm, arm)
    full = F.count(F.lit(1)).over(w) == 2 * arm + 1
    return df.withColumns({high: flag(full & (F.col("high") == F.max("high").over(w))),
                           low: flag(full & (F.col("low") == F.min("low").over(w)))})


def kama(df: DataFrame, er: int = 10, fast: int = 2, slow: int = 30, source: str = "close", out: str = "kama",
         keys: Sequence[str] = ("symbol",)) -> DataFrame:
    """Adaptive average, seeded with the price of bar er-1; exact scan with varying coefficients."""
    hi, lo = 2.0 / (fast + 1.0), 2.0 / (slow + 1.0)

    def build(d: DataFrame, f: Frames) -> DataFrame:
        d = d.withColumn("_p", price_source(source))
        d = d.withColumns({"_move": F.abs(f.diff("_p", er)), "_step": F.abs(f.diff("_p"))})
        ratio = F.coalesce(div(F.col("_move"), f.sum("_step", er, er)), F.lit(0.0))
        return d.withColumn("_sc", F.pow(ratio * (hi - lo) + lo, F.lit(2)))
    d = in_chunks(df, build, history=er + 1, keys=keys)
    seed = F.col("bar_no") <= er - 1
    a = F.when(seed, 0.0).otherwise(1.0 - F.col("_sc"))
    b = F.when(seed, F.col("_p")).otherwise(F.col("_sc") * F.col("_p"))
    d = affine_scan(d, {out: (a, b)}, keys=keys)
    return d.withColumn(out, F.when(F.col("bar_no") >= er - 1, F.col(out))).drop("_p", "_move", "_step", "_sc")


def kalman(df: DataFrame, q: float = 1e-4, r: float = 1e-2, keys: Sequence[str] = ("symbol",)) -> DataFrame:
    """Level filter: mean, residual and velocity.

    The gain depends on the row number only and settles, so it is a short list
    of numbers whose last entry holds for all later rows.
    """
    # With m = 1 / prior the map var -> var' is a ratio of linear functions; its two fixed points are low < 0 < settled, and
    # (var - settled) / (var - low) shrinks by one factor per row. So the gain has a closed form for every row.
    root = math.sqrt(q * q + 4.0 * q * r)
    settled, low = (root - q) / 2.0, (-root - q) / 2.0
    factor = ((r - settled) / (r - low)) if q > 0 else 1.0
    n = F.col("bar_no")
    if q > 0:
        w = F.lit((1.0 - settled) / (1.0 - low)) * F.pow(F.lit(factor), n.cast("double") - 1)
        var = (settled - low * w) / (1.0 - w)  # after n - 1 updates
    else:
        var = 1.0 / (1.0 + (n - 1) / r)
    prior = var + q
    k = F.when(n > 0, prior / (prior + r)).otherwise(1.0)
    d = affine_scan(df, {"kalman_mean": (1.0 - k, k * F.col("close"))}, keys=keys)
    d = in_chunks(d, lambda x, f: x.withColumn(
        "kalman_velocity", fill(F.col("kalman_mean") - f.lag("kalman_mean"), 0.0)), history=1, keys=keys)
    return d.withColumn("kalman_residual", F.col("close") - F.col("kalman_mean"))


def day_window(t: str = "t", keys: Sequence[str] = ("symbol",), pos: str = "bar_no"):
    """Rows of one key and calendar day; bars bound its size by the minutes of a day."""
    return Window.partitionBy(*keys, F.to_date(t)).orderBy(pos)


def pseudo_cvd(df: DataFrame, method: str = "clv_body_volume", t: str = "t") -> DataFrame:
    """Close-location pressure, volume delta and its running sum per day."""
    rng = F.col("high") - F.col("low")
    clv = fill(div((F.col("close") - F.col("low")) - (F.col("high") - F.col("close")), rng), 0.0)
    body = fill(div(F.col("close") - F.col("open"), rng), 0.0)
    p = {"clv_volume": clv, "clv_body_volume": 0.7 * clv + 0.3 * body}[method]
    d = df.withColumn("cvd_pressure", clip(p, -1.0, 1.0))
    d = d.withColumn("cvd_delta_proxy", fill(F.col("volume"), 0.0) * F.col("cvd_pressure"))
    return d.withColumn("cvd_session", F.sum("cvd_delta_proxy").over(
        day_window(t).rowsBetween(Window.unboundedPreceding, 0)))


def cvd_divergence(df: DataFrame, lookback: int = 20, slope: int = 3, cvd: str = "cvd_session", t: str = "t") -> DataFrame:
    """Price beyond the day's last `lookback` bars while the delta is not; missing counts as fine.

    The slope is rounded to 9 digits, so its sign does not hang on the order of a sum.
    """
    w = day_window(t)
    past = w.rowsBetween(-lookback, -1)
    full = F.count(F.lit(1)).over(past) >= lookback

    def prev(fn, x):
        return F.when(full, fn(x).over(past))
    d = df.withColumns({
        "cvd_price_prev_high": prev(F.max, "close"), "cvd_price_prev_low": prev(F.min, "close"),
        "cvd_prev_high": prev(F.max, cvd), "cvd_prev_low": prev(F.min, cvd),
        "cvd_slope": F.round(F.col(cvd) - F.lag(cvd, slope).over(w), 9),
    })
    bear = (F.col("close") > F.col("cvd_price_prev_high")) & (F.col(cvd) <= F.col("cvd_prev_high"))
    bull = (F.col("close") < F.col("cvd_price_prev_low")) & (F.col(cvd) >= F.col("cvd_prev_low"))
    return d.withColumns({
        "cvd_classic_long_ok": ~yes(bear), "cvd_classic_short_ok": ~yes(bull),
        "cvd_slope_long_ok": yes(F.col("cvd_slope") >= 0), "cvd_slope_short_ok": yes(F.col("cvd_slope") <= 0),
    })


def session_poc(df: DataFrame, atr: str, tick: float = 0.01, window: int = 20, band: float = 0.2, t: str = "t", keys: Sequence[str] = ("symbol",)) -> DataFrame:
    """Price bucket with the most volume of the day so far, the distance to it, its slope, acceptance and a factor.

    Ties go to the bucket nearest to the close. Only a bar's own bucket grows, so the highest volume is the running maximum of
    the buckets' running volumes, and the buckets that hold it are those that reached it since it last grew.
    """
    typical = (F.col("high") + F.col("low") + F.col("close")) / 3.0
    d = df.withColumns({"_bk": F.bround(typical / tick) * tick, "_day": F.to_date(t)})
    upto = lambda *by: Window.partitionBy(*keys, "_day", *by).orderBy("bar_no").rowsBetween(Window.unboundedPreceding, 0)
    traded = F.col("volume") > 0
    d = d.withColumn("_cum", F.sum(F.when(traded, F.col("volume"))).over(upto("_bk")))
    d = d.withColumn("_most", F.max(F.when(traded, F.col("_cum"))).over(upto()))
    d = d.withColumn("_tied", F.collect_list(F.when(traded & (F.col("_cum") == F.col("_most")), F.col("_bk"))).over(upto("_most")))
    best = F.array_max(F.transform("_tied", lambda b: F.struct((-F.abs(b - F.col("close"))).alias("near"), (-b).alias("bk"))))
    d = d.withColumn("session_poc", -best["bk"]).drop("_bk", "_day", "_cum", "_most", "_tied")

    def build(x, f):
        a = F.when(F.col(atr) > 0, F.col(atr))
        dist = F.col("close") - F.col("session_poc")
        x = x.withColumns({"poc_dist_atr": dist / a, "poc_slope": f.diff("session_poc"), "_near": flag(F.abs(dist) <= a * band)})
        x = x.withColumn("poc_acceptance", f.mean("_near", max(2, window)))
        return x.withColumn("poc_factor", 0.5 * -fill(F.least(F.abs("poc_dist_atr"), F.lit(3.0)) / 3.0, 0.0)
                            + 0.3 * (fill(F.col("poc_acceptance"), 0.0) * 2.0 - 1.0) + 0.2 * F.signum(fill(F.col("poc_slope"), 0.0))).drop("_near")
    return in_chunks(d, build, history=window + 1, keys=keys)
