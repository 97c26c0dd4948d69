"""Discrete states: transition matrices, imputation, next change, calibration of horizons."""
from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import DataFrame, Window, functions as F

from .fold import ordered_fold
from .layout import in_chunks, running


def transition_matrix(df: DataFrame, state: str, k: int, keys: Sequence[str] = ("symbol",)) -> DataFrame:
    """(key, a, b, p): rates of consecutive known states with one added to every count."""
    d = in_chunks(df, lambda x, f: x.withColumn("_a", f.lag(state)), history=1, keys=keys)
    n = d.where(F.col("_a").isNotNull() & F.col(state).isNotNull()).groupBy(*keys, F.col("_a").alias("a"), F.col(state).alias("b")).agg(F.count(F.lit(1)).alias("n"))
    cells = F.explode(F.sequence(F.lit(0), F.lit(k * k - 1))).alias("_c")
    grid = df.select(*keys).distinct().select(*keys, cells).select(*keys, F.floor(F.col("_c") / k).cast("int").alias("a"), (F.col("_c") % k).alias("b"))
    full = grid.join(n, [*keys, "a", "b"], "left").withColumn("_n", F.coalesce("n", F.lit(0)) + 1)
    rows = full.groupBy(*keys, "a").agg(F.sum("_n").alias("_t"))
    return full.join(rows, [*keys, "a"]).select(*keys, "a", "b", (F.col("_n") / F.col("_t")).alias("p"))


def impute_states(df: DataFrame, state: str, k: int, out: str, keys: Sequence[str] = ("symbol",), **kw) -> DataFrame:
    """Fill missing states in row order with argmax over s of P[prev, s] * P[s, next known].

    Without a previous (next) state that factor is left out, and the state
    frequencies (one added) stand in when both are missing. A fill counts as
    the previous state of the next row, so this is an ordered fold.
    """
    p = transition_matrix(df, state, k, keys)
    m = p.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("a", "b", "p"))).alias("_m")).withColumn("_m", F.transform("_m", lambda x: x["p"]))
    pri = df.where(F.col(state).isNotNull()).groupBy(*keys).agg(*[(F.sum((F.col(state) == s).cast("int")) + 1).cast("double").alias(f"_s{s}") for s in range(k)])
    pri = pri.select(*keys, F.array(*[f"_s{s}" for s in range(k)]).alias("_prior"))
    d = running(df, {"_next": ("first", F.col(state))}, keys=keys, forward=True)
    d = d.join(m, list(keys)).join(pri, list(keys), "left")
    d = d.withColumns({"_known": F.col(state).cast("double"), "_nx": F.col("_next").cast("double")})

    def step(pdf, st):
        prev = st[0]
        trans = np.asarray(pdf["_m"].iloc[0], dtype=float).reshape(k, k)
        prior = pdf["_prior"].iloc[0]
        prior = np.asarray(prior, dtype=float) if prior is not None else np.ones(k)
        got = []
        for s, n in zip(pdf["_known"].to_numpy(), pdf["_nx"].to_numpy()):
            if np.isnan(s):
                a = trans[int(prev)] if not np.isnan(prev) else (prior / prior.sum())
                b = trans[:, int(n)] if not np.isnan(n) else 1.0
                s = float(np.argmax(a * b))
            got.append(int(s))
            prev = s
        return {out: got}, [prev]
    return ordered_fold(d, step, {out: "int"}, [float("nan")], keys=keys, **{"warm": 64, **kw}).drop("_next", "_m", "_prior", "_known", "_nx")


def bars_to_change(df: DataFrame, state: str, out: str, keys: Sequence[str] = ("symbol",), pos: str = "bar_no") -> DataFrame:
    """Rows until the state first differs from the present one; missing if it never does."""
    s = F.col(state)
    d = in_chunks(df, lambda x, f: x.withColumn("_at", F.when(s != f.lag(s), F.col(pos))), history=1, keys=keys, pos=pos)
    d = in_chunks(d, lambda x, f: x.withColumn("_nx", f.lead("_at")), history=0, lookahead=1, keys=keys, pos=pos)
    d = running(d, {"_to": ("min", F.col("_nx"))}, keys=keys, order=(pos,), forward=True)
    return d.withColumn(out, F.col("_to") - F.col(pos)).drop("_at", "_nx", "_to")


def horizon_rates(df: DataFrame, dist: str, most: int = 120) -> DataFrame:
    """Share of rows whose state changes within H rows, for every H in 1..most, from one histogram."""
    hist = df.where(F.col(dist) <= most).groupBy(F.col(dist).cast("int").alias("horizon")).agg(F.count(F.lit(1)).alias("n"))
    total = df.agg(F.count(F.lit(1))).scalar()
    grid = df.sparkSession.range(1, most + 1).select(F.col("id").cast("int").alias("horizon"))
    upto = Window.orderBy("horizon").rowsBetween(Window.unboundedPreceding, 0)  # one row per horizon
    g = grid.join(hist, "horizon", "left").withColumn("_c", F.sum(F.coalesce("n", F.lit(0))).over(upto))
    return g.select("horizon", (F.col("_c") / total).alias("rate"))


def choose_horizon(rates: DataFrame, lo: float, hi: float, wanted: int) -> DataFrame:
    """The horizon in the rate band nearest to `wanted`, else the one whose rate is nearest to the band's middle."""
    inside = F.col("rate").between(lo, hi)
    gap = F.abs(F.col("horizon") - wanted)
    mid = F.round(F.abs(F.col("rate") - (lo + hi) / 2.0), 12)
    pick = F.when(inside, F.struct(F.lit(0).alias("g"), gap.cast("double").alias("x"), F.col("horizon").cast("double").alias("y"))).otherwise(
        F.struct(F.lit(1).alias("g"), mid.alias("x"), gap.cast("double").alias("y")))
    return rates.agg(F.min_by(F.struct("horizon", "rate"), pick).alias("r")).select("r.*")
