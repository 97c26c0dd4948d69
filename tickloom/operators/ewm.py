"""Exponentially weighted statistics as windows.

y[t] = (1-a) y[t-1] + a x[t] with y[0] = x[0]. Inside a block of rows this is
b^q * sum(x_j * a * b^-q_j), b = 1-a, one running sum. A block is so long that
weights older than one block are below 2^-60 of the newest and so short that
b^-q stays far from overflow; the block before it is added through its last
value. All blocks lie inside the chunks of `in_chunks`, so the scans of a
query share its one shuffle. `reach(a)` is the history a scan needs.
"""
from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.exprs import c
from .layout import Frames


def alpha_of(span: float) -> float:
    return 2.0 / (span + 1.0)


def _block(a: float) -> int:
    return max(2, math.ceil(60.0 / -math.log(1.0 - a)))


def reach(a: float) -> int:
    """Rows of history after which older weights vanish in double precision."""
    return 2 * _block(a)


def _decayed(df: DataFrame, f: Frames, x: Column, b: float, out: str) -> DataFrame:
    """out = sum over all rows j <= t of x_j * b^(t-j)."""
    n = _block(1.0 - b)
    blk = f"_blk_{n}"
    pos = F.col(f.pos)
    q = pos - F.col(blk) * n
    grow = F.pow(F.lit(1.0 / b), q)
    w = Window.partitionBy(*f.keys, blk).orderBy(f.pos).rowsBetween(Window.unboundedPreceding, 0)
    d = df.withColumn(blk, F.floor(pos / n)).withColumn(f"_x_{out}", x)
    d = d.withColumn(f"_s_{out}", F.pow(F.lit(b), q) * F.sum(F.coalesce(F.col(f"_x_{out}"), F.lit(0.0)) * grow).over(w))
    before = F.max(F.when(pos % n == n - 1, F.struct(f.pos, f"_s_{out}"))).over(f.rows(Window.unboundedPreceding, -1))
    d = d.withColumn(out, F.col(f"_s_{out}")
                     + F.coalesce(before[f"_s_{out}"], F.lit(0.0)) * F.pow(F.lit(b), q + 1))
    return d.drop(blk, f"_x_{out}", f"_s_{out}")


def ewm_mean(df: DataFrame, f: Frames, x, out: str, *, span: float | None = None, alpha: float | None = None,
             least: int = 1, adjust: bool = False) -> DataFrame:
    """Exponential mean of a column without missing values.

    adjust=False starts from the first value; adjust=True divides by the sum
    of the weights seen so far. Missing until `least` rows.
    """
    a = alpha_of(span) if alpha is None else alpha
    b = 1.0 - a
    x = c(x).cast("double")
    first = F.col(f.pos) == 0
    if adjust:
        d = _decayed(df, f, x, b, out)
        weight = (1.0 - F.pow(F.lit(b), F.col(f.pos) + 1)) / a
        y = F.col(out) / weight
    else:
        d = _decayed(df, f, F.when(first, x).otherwise(a * x), b, out)
        y = F.col(out)
    return d.withColumn(out, F.when(F.col(f.pos) + 1 >= least, y))


def ewm_std(df: DataFrame, f: Frames, x, out: str, *, span: float, least: int = 1) -> DataFrame:
    """Bias-corrected exponential standard deviation, first value as seed.

    Weights are b^t for the first row and a*b^(t-j) after it. The sums run on
    x minus the key's first value in the chunk, which keeps x^2 sums accurate.
    """
    a = alpha_of(span)
    b = 1.0 - a
    d = df.withColumn("_es_x", c(x).cast("double"))
    d = ewm_mean(d, f, "_es_x", "_es_m", alpha=a)
    d = d.withColumn("_es_d", F.col("_es_x") - F.coalesce(f.lag("_es_m"), F.col("_es_x")))
    # West's update: var[t] = b * (var[t-1] + a * d^2), d = x - mean[t-1]
    d = _decayed(d, f, F.when(F.col(f.pos) == 0, F.lit(0.0)).otherwise(a * b * F.col("_es_d") * F.col("_es_d")), b, "_es_b")
    t = F.col(f.pos)
    w2 = F.pow(F.lit(b), 2 * t) + a * a * (1.0 - F.pow(F.lit(b), 2 * t)) / (1.0 - b * b)
    fixed = F.try_divide(F.col("_es_b"), 1.0 - w2)
    d = d.withColumn(out, F.when((t + 1 >= max(least, 2)) & (fixed >= 0), F.sqrt(fixed)))
    return d.drop("_es_x", "_es_m", "_es_d", "_es_b")
