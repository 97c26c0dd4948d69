"""Exact ranks and quantiles over groups of any size.

Equal values are counted first, which folds hot values into one row on the map
side. The counts are cut into range pieces along (key, value), written out once
because they are read several times, and added up piece by piece, so no task
sorts a whole group.
"""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from .durable import stored
from .layout import number_rows, ranged, running


def running_over_values(freq: DataFrame, x: str, cols: dict[str, Column], keys: Sequence[str] = ()) -> DataFrame:
    """Running sums of columns along the distinct values x of each key."""
    cut = ranged(freq, [*keys, x], "_range")
    return running(cut, {n: ("sum", v) for n, v in cols.items()}, keys=keys, order=(x,), piece=F.col("_range")).drop("_range")


def value_counts_below(df: DataFrame, x: str, keys: Sequence[str] = ()) -> DataFrame:
    """Per key and distinct value: `_n` rows with it and `_upto` rows at or below it."""
    freq = df.where(F.col(x).isNotNull()).groupBy(*keys, x).agg(F.count(F.lit(1)).alias("_n"))
    return running_over_values(freq, x, {"_upto": F.col("_n")}, keys)


def exact_quantiles(df: DataFrame, x: str, qs: dict[str, float], keys: Sequence[str] = ()) -> DataFrame:
    """One row per key with linearly interpolated quantiles {name: q} of x."""
    cum = value_counts_below(df, x, keys)
    total = cum.groupBy(*keys).agg(F.max("_upto").alias("_all"))
    both = cum.join(total, list(keys)) if keys else cum.withColumn("_all", total.scalar())
    aggs = []
    for n, q in qs.items():
        at = (F.col("_all") - 1) * F.lit(float(q))
        aggs += [F.min(F.when(F.col("_upto") > F.floor(at), F.col(x))).alias(f"_lo_{n}"),
                 F.min(F.when(F.col("_upto") > F.ceil(at), F.col(x))).alias(f"_hi_{n}"),
                 F.max(at - F.floor(at)).alias(f"_w_{n}")]
    got = both.groupBy(*keys).agg(*aggs)
    return got.select(*keys, *[
        (F.col(f"_lo_{n}") + (F.col(f"_hi_{n}") - F.col(f"_lo_{n}")) * F.col(f"_w_{n}")).alias(n) for n in qs])


def average_rank(df: DataFrame, x: str, out: str, keys: Sequence[str] = ()) -> DataFrame:
    """Rank of x in its key, ties share their mean rank; also `<out>_of`, the number of values."""
    cum = value_counts_below(df, x, keys)
    total = cum.groupBy(*keys).agg(F.max("_upto").alias(f"{out}_of"))
    ranks = cum.select(*keys, x, (F.col("_upto") - (F.col("_n") - 1) / 2.0).alias(out))
    ranks = ranks.join(total, list(keys)) if keys else ranks.withColumn(f"{out}_of", total.scalar())
    ranks = stored(ranks)  # of known size: the rows aren't moved for a short list of values
    return df.join(ranks, [*keys, x], "left")


def order_position(df: DataFrame, x: str, tie: str, out: str = "pos") -> DataFrame:
    """Exact 0-based position of a row by (x, tie) over the whole table."""
    return number_rows(df, (), (x, tie), piece="range", out=out)


def fitted_buckets(df: DataFrame, x: str, n: int, out: str = "bucket", fit: Column | None = None) -> DataFrame:
    """Bucket 0..n-1 by the quantile edges of x on the fit rows; a value on an edge belongs below it."""
    rows = df if fit is None else df.where(fit)
    edges = exact_quantiles(rows, x, {f"e{i}": i / n for i in range(1, n)})
    pack = edges.select(F.array(*[f"e{i}" for i in range(1, n)])).scalar()
    d = df.withColumn("_edges", pack)
    return d.withColumn(out, F.when(F.col(x).isNotNull(), F.size(F.filter("_edges", lambda e: F.col(x) > e)))).drop("_edges")
