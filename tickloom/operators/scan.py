"""Exact scans y[t] = a[t] * y[t-1] + b[t] with any coefficients.

Every chunk turns its rows into prefix pairs (A, B) with y = A * y_in + B. The
pairs of the chunk ends are scanned the same way, twice, so the last level
holds rows / chunk^2 pairs of a key. A row with a = 0 starts afresh.
Inside a chunk the pairs come from pointer doubling on Arrow columns; nothing
is divided, so no coefficient can overflow.
"""
from __future__ import annotations

from collections.abc import Mapping, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T

from .ewm import alpha_of
from .layout import chunk_rows, in_chunks


def _prefix(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    a, b = a.copy(), b.copy()
    step = 1
    while step < len(a):
        b[step:] += a[step:] * b[:-step].copy()
        a[step:] *= a[:-step].copy()
        step *= 2
    return a, b


def affine_scan(df: DataFrame, terms: Mapping[str, tuple[Column, Column]], *, keys: Sequence[str] = ("symbol",),
                pos: str = "bar_no", rows: int | None = None, depth: int = 3) -> DataFrame:
    """Add one column per entry {out: (a, b)}; y before the first row counts as 0."""
    chunk, rows = f"_k{depth}", chunk_rows(df, rows)
    names = list(terms)
    d = df.withColumn(chunk, F.lit(0).cast("bigint") if depth == 1 else F.floor(F.col(pos) / rows).cast("bigint"))
    for o, (a, b) in terms.items():
        d = d.withColumns({f"_a_{o}": a.cast("double"), f"_b_{o}": b.cast("double")})

    def pairs(tab: pa.Table) -> pa.Table:
        tab = tab.sort_by(pos)
        for o in names:
            a, b = _prefix(tab[f"_a_{o}"].to_numpy(), tab[f"_b_{o}"].to_numpy())
            for n, v in ((f"_a_{o}", a), (f"_b_{o}", b)):
                tab = tab.set_column(tab.schema.get_field_index(n), n, pa.array(v))
        return tab

    done = d.groupBy(*keys, chunk).applyInArrow(pairs, T.StructType(d.schema.fields))
    if depth == 1:
        return done.withColumns({o: F.col(f"_b_{o}") for o in names}).drop(
            chunk, *[f"_{p}_{o}" for o in names for p in "ab"])
    ends = done.groupBy(*keys, chunk).agg(*[
        F.max_by(F.col(f"_{p}_{o}"), F.col(pos)).alias(f"{p}_{o}") for o in names for p in "ab"])
    at_end = affine_scan(ends, {f"y_{o}": (F.col(f"a_{o}"), F.col(f"b_{o}")) for o in names},
                         keys=keys, pos=chunk, rows=rows, depth=depth - 1)
    carry = at_end.select(*keys, (F.col(chunk) + 1).alias(chunk), *[F.col(f"y_{o}").alias(f"_in_{o}") for o in names])
    full = done.join(carry, [*keys, chunk], "left")
    return full.withColumns({
        o: F.col(f"_b_{o}") + F.col(f"_a_{o}") * F.coalesce(F.col(f"_in_{o}"), F.lit(0.0)) for o in names
    }).drop(chunk, *[f"_{p}_{o}" for o in names for p in ("a", "b", "in")])


def long_ewm_std(df: DataFrame, x: str, out: str, *, span: float, least: int = 2, keys: Sequence[str] = ("symbol",), pos: str = "bar_no") -> DataFrame:
    """`ewm.ewm_std` for spans that reach far behind a chunk: mean and variance are scans, so nothing is copied between chunks."""
    a = alpha_of(span)
    b = 1.0 - a
    t, v = F.col(pos), F.col(x).cast("double")
    first = t == 0
    d = affine_scan(df, {"_sm": (F.when(first, 0.0).otherwise(b), F.when(first, v).otherwise(a * v))}, keys=keys, pos=pos)
    d = in_chunks(d, lambda y, f: y.withColumn("_sd", v - F.coalesce(f.lag("_sm"), v)), history=1, keys=keys, pos=pos)
    d = affine_scan(d, {"_sv": (F.lit(b), F.when(first, 0.0).otherwise(a * b * F.col("_sd") * F.col("_sd")))}, keys=keys, pos=pos)
    w2 = F.pow(F.lit(b), 2 * t) + a * a * (1.0 - F.pow(F.lit(b), 2 * t)) / (1.0 - b * b)
    fixed = F.try_divide(F.col("_sv"), 1.0 - w2)
    return d.withColumn(out, F.when((t + 1 >= max(least, 2)) & (fixed >= 0), F.sqrt(fixed))).drop("_sm", "_sd", "_sv")
