"""Null-safe column helpers.

Missing values are NULL everywhere, never NaN. Comparisons with a missing
value are false, divisions by zero are missing.
"""
from __future__ import annotations

from pyspark.sql import Column, functions as F


def c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def num(x) -> Column:
    """Literal or column to a column."""
    return x if isinstance(x, Column) else F.lit(x)


def yes(cond: Column) -> Column:
    """A condition that is false when missing."""
    return F.coalesce(cond, F.lit(False))


def flag(cond: Column) -> Column:
    return yes(cond).cast("int")


def div(a, b) -> Column:
    """a / b, missing where b is zero or missing; names are columns."""
    a, b = num(c(a)), num(c(b))
    return F.try_divide(a.cast("double"), b.cast("double"))


def clip(x: Column, lo=None, hi=None) -> Column:
    """Bound x; a missing x stays missing (greatest/least would skip it)."""
    y = x
    if lo is not None:
        y = F.greatest(y, num(lo).cast("double"))
    if hi is not None:
        y = F.least(y, num(hi).cast("double"))
    return F.when(x.isNotNull(), y)


def fill(x: Column, value) -> Column:
    return F.coalesce(x, num(value).cast("double"))


def sign(x: Column) -> Column:
    return F.signum(x)


def logistic(x: Column) -> Column:
    """1 / (1 + e^-x) written so that neither branch overflows."""
    e = F.exp(-F.abs(x))
    return F.when(x >= 0, 1.0 / (1.0 + e)).otherwise(e / (1.0 + e))


def finite(x: Column) -> Column:
    """Drop NaN and infinities to NULL."""
    return F.when(~F.isnan(x) & (F.abs(x) != F.lit(float("inf"))), x)


def first_of(df, names, default) -> Column:
    """First column of `names` that exists in df, else a constant; settled when the plan is built."""
    for n in names:
        if n in df.columns:
            return F.col(n)
    return num(default)


def micros(t) -> Column:
    """Zone-free microseconds since 1970 of a timestamp without zone."""
    return F.timestamp_diff("MICROSECOND", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"), c(t).cast("timestamp_ntz"))


def day_number(t) -> Column:
    return F.datediff(c(t), F.lit("1970-01-01").cast("date"))


def minute_of_day(t) -> Column:
    return F.hour(c(t)) * 60 + F.minute(c(t))


def price_source(name: str) -> Column:
    """open | high | low | close | hl2 | hlc3 | ohlc4."""
    o, h, l, k = (F.col(x) for x in ("open", "high", "low", "close"))
    table = {
        "open": o, "high": h, "low": l, "close": k,
        "hl2": (h + l) / 2.0,
        "hlc3": (h + l + k) / 3.0,
        "ohlc4": (o + h + l + k) / 4.0,
    }
    if name.lower() not in table:
        raise ValueError(f"unknown price source: {name}")
    return table[name.lower()]


def pair_corr(x, y, over=None) -> Column:
    """Correlation of the rows where both are there; missing where a side does not move.

    Spark's corr raises on a constant side under ANSI rules, even inside a `when`.
    """
    x, y = c(x).cast("double"), c(y).cast("double")
    both = x.isNotNull() & y.isNotNull()
    parts = [F.covar_pop(x, y), F.stddev_pop(F.when(both, x)), F.stddev_pop(F.when(both, y))]
    cov, sx, sy = parts if over is None else [p.over(over) for p in parts]
    return F.try_divide(cov, sx * sy)
