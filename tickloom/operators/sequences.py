"""Runs, counters, latches and sequences: loops over bars written as islands.

A counter that restarts at a reset row is a `running` sum with that reset.
Nothing here needs a window over a whole key.
"""
from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.exprs import flag, sign, yes
from .layout import Frames, in_chunks, running


def counts_since_reset(df: DataFrame, specs: Mapping[str, tuple[Column, Column]], *, keys: Sequence[str] = ("symbol",),
                       pos: str = "bar_no", rows: int | None = None) -> DataFrame:
    """{out: (condition, reset)}: rows with the condition from the latest reset row on, that row included."""
    cols = {o: ("sum", flag(v).cast("bigint"), f"r{i}") for i, (o, (v, _)) in enumerate(specs.items())}
    resets = {f"r{i}": r for i, (_, r) in enumerate(specs.values())}
    return running(df, cols, keys=keys, order=(pos,), resets=resets, rows=rows)


def run_of(df: DataFrame, changes: Mapping[str, Column], *, keys: Sequence[str] = ("symbol",), pos: str = "bar_no",
           rows: int | None = None) -> DataFrame:
    """Rows since the latest change, 0 on the change row; the first row counts as a change."""
    marks = {f"_m_{o}": ("max", F.when(yes(ch) | (F.col(pos) == 0), F.col(pos))) for o, ch in changes.items()}
    d = running(df, marks, keys=keys, order=(pos,), rows=rows)
    return d.withColumns({o: F.col(pos) - F.col(f"_m_{o}") for o in changes}).drop(*[f"_m_{o}" for o in changes])


def direction_runs(df: DataFrame, cap: int = 40) -> DataFrame:
    """Consecutive bull and bear bars, and the capped persistence of the bar direction."""
    d = in_chunks(df, lambda x, f: x.withColumns({
        "_dir": sign(F.col("close") - F.col("open")),
        "_chg": sign(F.col("close") - F.col("open")) != f.lag(sign(F.col("close") - F.col("open")))}), history=1)
    d = run_of(d, {"_run": F.col("_chg")})
    n = F.col("_run") + 1
    return d.withColumns({
        "consec_bull": F.when(F.col("_dir") == 1, n).otherwise(0),
        "consec_bear": F.when(F.col("_dir") == -1, n).otherwise(0),
        "same_state": F.least(F.col("_run"), F.lit(cap)),
    }).drop("_dir", "_chg", "_run")


def micro_channel(df: DataFrame) -> DataFrame:
    """Signed counter of bars that do not overlap backwards; a colour change goes on counting."""
    up = (F.col("close") > F.col("open"))
    down = (F.col("close") < F.col("open"))
    d = in_chunks(df, lambda x, f: x.withColumn("_v", F.when(yes(up & (F.col("low") >= f.lag("low"))), 1)
                                               .when(yes(down & (F.col("high") <= f.lag("high"))), -1).otherwise(0)), history=1)
    d = running(d, {"consec": ("sum", F.col("_v"), "flat")}, resets={"flat": F.col("_v") == 0})
    return d.withColumn("micro", F.when(F.abs("consec") >= 3, F.signum("consec") * 20).otherwise(0.0)).drop("_v")


def latch(df: DataFrame, on: str, off: str, long_out: str, short_out: str, **kw) -> DataFrame:
    """On from a set until the reverse; when both fire on one bar the own side wins."""
    a, b = yes(F.col(on)), yes(F.col(off))
    d = running(df, {long_out: ("last", F.when(a, True).when(b, False)),
                     short_out: ("last", F.when(b, True).when(a, False))}, **kw)
    return d.withColumns({o: yes(F.col(o)) for o in (long_out, short_out)})


def carry_same_day(df: DataFrame, sig: str, bars: int, out: str, *, keys: Sequence[str] = ("symbol",), t: str = "t",
                   pos: str = "bar_no") -> DataFrame:
    """Keep a true signal true for the next `bars` rows of its calendar day; bars <= 0 changes nothing."""
    if bars <= 0:
        return df.withColumn(out, yes(F.col(sig)))

    def build(d: DataFrame, f: Frames) -> DataFrame:
        day = F.to_date(t)
        hits = [yes(f.lag(sig, k)) & yes(f.lag(day, k) == day) for k in range(1, bars + 1)]
        cond = yes(F.col(sig))
        for h in hits:
            cond = cond | h
        return d.withColumn(out, cond)
    return in_chunks(df, build, history=bars, keys=keys, pos=pos)


def positions(df: DataFrame, sig: str, *, t: str = "t") -> DataFrame:
    """Last non-zero signal, effective one bar later; the intraday form is flat over day borders."""
    d = running(df, {"_held": ("last", F.nullif(F.col(sig), F.lit(0)))})
    day = Window.partitionBy("symbol", F.to_date(t)).orderBy("bar_no")
    d = d.withColumn("_day", F.coalesce(F.last(F.nullif(F.col(sig), F.lit(0)), ignorenulls=True).over(
        day.rowsBetween(Window.unboundedPreceding, 0)), F.lit(0)))
    d = d.withColumn("intraday", F.coalesce(F.lag("_day").over(day), F.lit(0)))
    return in_chunks(d, lambda x, f: x.withColumn("position", F.coalesce(f.lag("_held"), F.lit(0))), history=1).drop("_held", "_day")


def contiguous_runs(df: DataFrame, state: str, *, keys: Sequence[str] = ("symbol",), pos: str = "bar_no") -> DataFrame:
    """(i0, i1, state, n) of runs of one state; a missing state ends a run and gives none."""
    s = F.col(state)
    d = in_chunks(df, lambda x, f: x.withColumn("_chg", ~s.eqNullSafe(f.lag(s)) | (F.col(pos) == 0)), history=1, keys=keys, pos=pos)
    d = running(d, {"_i0": ("max", F.when(F.col("_chg"), F.col(pos)))}, keys=keys, order=(pos,))
    return (d.where(s.isNotNull()).groupBy(*keys, "_i0")
            .agg(F.max(pos).alias("i1"), F.min(state).alias(state), F.count(F.lit(1)).alias("n"))
            .withColumnRenamed("_i0", "i0"))


def expanding(df: DataFrame, x: str, *, mean: str, std: str, **kw) -> DataFrame:
    """Expanding mean and sample deviation from running sums, shifted by the key's first value."""
    d = running(df, {"_x0": ("first", F.col(x))}, **kw)
    v = F.col(x) - F.col("_x0")
    d = running(d, {"_n": ("sum", F.col(x).isNotNull().cast("bigint")), "_s": ("sum", v), "_q": ("sum", v * v)}, **kw)
    n = F.col("_n")
    var = (F.col("_q") - F.col("_s") * F.col("_s") / n) / F.nullif(n - 1, F.lit(0))
    return d.withColumns({mean: F.col("_x0") + F.col("_s") / n,
                          std: F.sqrt(F.greatest(var, F.lit(0.0)) + F.when(n > 1, 0.0))}).drop("_x0", "_n", "_s", "_q")


def sequences(df: DataFrame, f: Frames, cols: Sequence[str], length: int, out: str) -> DataFrame:
    """The last `length` feature vectors, oldest first; missing before there are that many."""
    vecs = F.collect_list(F.array(*[F.col(n).cast("double") for n in cols])).over(f.last(length))
    return df.withColumn(out, F.when(F.size(vecs) == length, vecs))


def padded_tail(df: DataFrame, f: Frames, cols: Sequence[str], length: int, out: str, steps: str) -> DataFrame:
    """Up to `length` vectors with zero vectors in front, and their number."""
    vecs = F.collect_list(F.array(*[F.coalesce(F.col(n).cast("double"), F.lit(0.0)) for n in cols])).over(f.last(length))
    zero = F.array(*[F.lit(0.0)] * len(cols))
    return df.withColumns({steps: F.size(vecs), out: F.concat(F.array_repeat(zero, F.lit(length) - F.size(vecs)), vecs)})
