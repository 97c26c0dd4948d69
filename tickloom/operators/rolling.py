"""Rolling statistics that Spark's frames do not have ready-made."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.exprs import c, pair_corr
from .layout import Frames


def skew(f: Frames, x, n: int, least: int = 3) -> Column:
    """Bias-corrected skewness; 0 when all values are equal."""
    x = c(x)
    w = f.last(n)
    k = F.count(x).over(w)
    g1 = F.skewness(x).over(w)
    flat = F.max(x).over(w) == F.min(x).over(w)
    fixed = g1 * F.sqrt(F.greatest(k * (k - 1), F.lit(0))) / F.nullif(k - 2, F.lit(0))
    return F.when((k >= max(least, 3)) & flat, 0.0).when(k >= max(least, 3), fixed)


def kurt(f: Frames, x, n: int, least: int = 4) -> Column:
    """Bias-corrected excess kurtosis; -3 when all values are equal."""
    x = c(x)
    w = f.last(n)
    k = F.count(x).over(w)
    g2 = F.kurtosis(x).over(w)
    flat = F.max(x).over(w) == F.min(x).over(w)
    fixed = (k - 1) / F.nullif((k - 2) * (k - 3), F.lit(0)) * ((k + 1) * g2 + 6)
    return F.when((k >= max(least, 4)) & flat, -3.0).when(k >= max(least, 4), fixed)


def corr(f: Frames, x, y, n: int, least: int = 2) -> Column:
    """Rolling correlation; missing for a constant side."""
    x, y = c(x), c(y)
    w = f.last(n)
    k = F.count(F.when(x.isNotNull() & y.isNotNull(), 1)).over(w)
    moving = (F.max(x).over(w) > F.min(x).over(w)) & (F.max(y).over(w) > F.min(y).over(w))
    return F.when((k >= max(least, 2)) & moving, pair_corr(x, y, w))


def beta(f: Frames, y, x, n: int, least: int = 2) -> Column:
    """Rolling slope of y on x: covariance over variance."""
    x, y = c(x), c(y)
    w = f.last(n)
    both = x.isNotNull() & y.isNotNull()
    k = F.count(F.when(both, 1)).over(w)
    return F.when(k >= max(least, 2), F.try_divide(
        F.covar_samp(x, y).over(w), F.var_samp(F.when(both, x)).over(w)))


def linreg(df: DataFrame, f: Frames, x, n: int, out: str, offset: int = 0) -> DataFrame:
    """Value at the end (minus offset) of the least-squares line through n points.

    Closed form of sum(y) and sum(i * y), with i counted from the row's own
    position so that the sums stay small.
    """
    x = c(x).cast("double")
    pos = F.col(f.pos)
    w = f.last(n)
    mean_i = (n - 1) / 2.0
    var_i = n * (n * n - 1) / 12.0
    sy = F.sum(x).over(w)
    spy = F.sum(x * (pos % (4 * n))).over(w)
    # i = pos_j - (pos_t - n + 1); positions are taken modulo 4n and unwrapped below
    wrapped = F.sum(F.when(pos % (4 * n) < n, x)).over(w)
    turn = F.when(pos % (4 * n) < n, F.coalesce(wrapped, F.lit(0.0)) * (4 * n)).otherwise(0.0)
    start = F.when(pos % (4 * n) < n, pos % (4 * n) + 4 * n).otherwise(pos % (4 * n)) - n + 1
    siy = spy + turn - start * sy
    slope = (siy - mean_i * sy) / var_i
    value = sy / n + slope * (n - 1 - offset - mean_i)
    return df.withColumn(out, F.when(F.count(x).over(w) >= n, value))


def zlsma(df: DataFrame, f: Frames, x, n: int, out: str = "zlsma", offset: int = 0) -> DataFrame:
    """Least-squares average plus its gap to its own least-squares average. History: 2n rows."""
    d = linreg(df, f, x, n, "_l1", offset)
    d = linreg(d, f, "_l1", n, "_l2", offset)
    return d.withColumn(out, F.col("_l1") + (F.col("_l1") - F.col("_l2"))).drop("_l1", "_l2")
