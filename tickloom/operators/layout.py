"""Row numbers, chunks with a halo, and running aggregates for long keys.

A window partitioned by `symbol` puts the whole history of a symbol in one
task. Nothing here does that. A key is cut twice:

* `number_rows` gives every row its exact position in its key. It counts rows
  per (key, time piece), adds the counts up over the pieces of a key, and
  numbers inside the piece. Where many rows share one time, `ranged` pieces are
  used instead: Spark's range partitions over key and full order.
* `in_chunks` cuts a key into chunks of a fixed number of rows and copies the
  rows that a frame needs from the neighbours (the halo). All bounded frames
  of all blocks of a query then run in one shuffle on (key, chunk).
* `running` handles unbounded frames: a frame inside each piece plus one
  carried value per piece.

So no task ever holds more than one piece or one chunk with its halo.
"""
from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.exprs import c, micros
from .durable import durable

CHUNK_ROWS = 32768  # of `tickloom.chunkRows`, unless the session sets another number
PIECE_SECONDS = 900
LONG_FRAME = 128  # from this length on frames are put together from two blocks


def chunk_rows(df: DataFrame, rows: int | None = None) -> int:
    """Rows of a chunk: as given, else the session's setting."""
    return rows or int(df.sparkSession.conf.get("tickloom.chunkRows", str(CHUNK_ROWS)))


@dataclass(frozen=True)
class Frames:
    """Window specs inside one chunk."""

    keys: tuple[str, ...]
    pos: str = "bar_no"

    @property
    def base(self):
        return Window.partitionBy(*self.keys).orderBy(self.pos)

    def rows(self, lo: int, hi: int = 0):
        return self.base.rowsBetween(lo, hi)

    def last(self, n: int):
        """The current row and the n-1 rows before it."""
        return self.rows(-(n - 1), 0)

    def lag(self, x, k: int = 1) -> Column:
        return F.lag(c(x), k).over(self.base)

    def lead(self, x, k: int = 1) -> Column:
        return F.lead(c(x), k).over(self.base)

    def agg(self, fn: Callable[[Column], Column], x, n: int, least: int = 1) -> Column:
        """Rolling aggregate of n rows, missing until `least` values are there."""
        x = c(x)
        w = self.last(n)
        v = fn(x).over(w)
        return v if least <= 0 else F.when(F.count(x).over(w) >= least, v)

    def moving(self, x, n: int) -> Column:
        """Sum of the last n rows: the tail of the block of n rows before and the head of the present one.

        Nothing is subtracted, so a value that has left the frame leaves no trace in the sum.
        """
        v, pos = F.coalesce(c(x), F.lit(0)), F.col(self.pos)
        block = Window.partitionBy(*self.keys, F.floor(pos / n))
        head = F.sum(v).over(block.orderBy(pos).rowsBetween(Window.unboundedPreceding, 0))
        tail = F.sum(v).over(block.orderBy(pos.desc()).rowsBetween(Window.unboundedPreceding, 0))
        whole = pos % n == n - 1  # the frame is the block itself
        return head + F.when(whole, F.lit(0)).otherwise(F.coalesce(F.lag(tail, n - 1).over(self.base), F.lit(0)))

    def mean(self, x, n, least=1):
        if n < LONG_FRAME:
            return self.agg(F.avg, x, n, least)
        k = self.moving(c(x).isNotNull().cast("bigint"), n)
        return F.when(k >= max(least, 1), self.moving(c(x).cast("double"), n) / F.nullif(k, F.lit(0)))

    def sum(self, x, n, least=1):
        if n < LONG_FRAME:
            return self.agg(F.sum, x, n, least)
        return F.when(self.moving(c(x).isNotNull().cast("bigint"), n) >= max(least, 1), self.moving(x, n))

    def _extreme(self, fn, pick, x, n: int, least: int) -> Column:
        """Extreme of the last n rows. A long frame spans two blocks of n rows: the tail of the one and the head of the other."""
        if n < LONG_FRAME:
            return self.agg(fn, x, n, least)
        x, pos = c(x), F.col(self.pos)
        block = Window.partitionBy(*self.keys, F.floor(pos / n))
        head = fn(x).over(block.orderBy(pos).rowsBetween(Window.unboundedPreceding, 0))
        tail = fn(x).over(block.orderBy(pos.desc()).rowsBetween(Window.unboundedPreceding, 0))
        enough = self.moving(x.isNotNull().cast("bigint"), n) >= max(least, 1)
        return F.when(enough, pick(F.lag(tail, n - 1).over(self.base), head))

    def max(self, x, n, least=1):
        return self._extreme(F.max, F.greatest, x, n, least)

    def min(self, x, n, least=1):
        return self._extreme(F.min, F.least, x, n, least)

    def std(self, x, n, least=2):
        """Sample deviation. Long frames use running sums around the chunk's mean; a frame without a change is exactly 0."""
        if n < LONG_FRAME:
            return self.agg(F.stddev_samp, x, n, max(least, 2))
        x = c(x).cast("double")
        d = x - F.avg(x).over(Window.partitionBy(*self.keys))
        k, s, q = self.moving(x.isNotNull().cast("bigint"), n), self.moving(d, n), self.moving(d * d, n)
        var = F.greatest((q - s * s / F.nullif(k, F.lit(0))) / F.nullif(k - 1, F.lit(0)), F.lit(0.0))
        still = self.moving((~x.eqNullSafe(F.lag(x).over(self.base))).cast("bigint"), n - 1) == 0
        return F.when(k >= max(least, 2), F.when(still, 0.0).otherwise(F.sqrt(var)))

    def quantile(self, x, q, n, least=1):
        return self.agg(lambda v: F.percentile(v, F.lit(q)), x, n, least)

    def diff(self, x, k: int = 1) -> Column:
        return c(x) - self.lag(x, k)

    def pct(self, x, k: int = 1) -> Column:
        prev = self.lag(x, k)
        return F.try_divide(c(x) - prev, prev)


def time_piece(t, seconds: int = PIECE_SECONDS) -> Column:
    """Number of the fixed time cell of t."""
    return F.floor(micros(t) / (seconds * 1_000_000))


def ranged(df: DataFrame, order: Sequence[str], out: str = "_piece") -> DataFrame:
    """Even pieces along the full order, whatever the skew of its leading columns.

    Range bounds come from a sample, so the pieces are written out once and
    every later reader and every retry sees the same ones.
    """
    return durable(df.repartitionByRange(*order).withColumn(out, F.spark_partition_id()))


def number_rows(df: DataFrame, keys: Sequence[str] = ("symbol",), order: Sequence[str] = ("t",),
                piece: Column | str | None = None, out: str = "bar_no") -> DataFrame:
    """Exact 0-based position of each row in its key.

    `piece` must not decrease along `order`. The default is the 15-minute cell
    of the first order column; "range" cuts by `ranged`, for orders whose first
    column repeats a lot.
    """
    by = list(keys)
    if isinstance(piece, str):
        cut = ranged(df, [*by, *order])
    else:
        cut = df.withColumn("_piece", time_piece(order[0]) if piece is None else piece)
    sizes = cut.groupBy(*by, "_piece").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(*by).orderBy("_piece").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select(*by, "_piece", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    inside = Window.partitionBy(*by, "_piece").orderBy(*order)
    local = cut.withColumn("_rn", F.row_number().over(inside))
    return (local.join(starts, [*by, "_piece"])
            .withColumn(out, (F.col("_start") + F.col("_rn") - 1).cast("bigint"))
            .drop("_piece", "_start", "_rn"))


def in_chunks(df: DataFrame, build: Callable[[DataFrame, Frames], DataFrame], *, history: int,
              lookahead: int = 0, keys: Sequence[str] = ("symbol",), pos: str = "bar_no",
              rows: int | None = None) -> DataFrame:
    """Run `build` on chunks of `rows` rows plus the halo its frames reach into.

    `history` and `lookahead` are the rows a result may depend on, summed over
    stacked frames.
    """
    rows = chunk_rows(df, rows)
    first = F.greatest(F.floor((F.col(pos) - lookahead) / rows), F.lit(0))
    last = F.floor((F.col(pos) + history) / rows)
    spread = df.withColumn("_chunk", F.explode(F.sequence(first.cast("bigint"), last.cast("bigint"))))
    done = build(spread, Frames((*keys, "_chunk"), pos))
    return done.where(F.col("_chunk") == F.floor(F.col(pos) / rows).cast("bigint")).drop("_chunk")


def deepest_fall(df: DataFrame, x, *, keys: Sequence[str], pos: str, floor: float | None = 0.0, out: str = "fall", rows: int | None = None) -> DataFrame:
    """Per key, the lowest distance (0 or less) of the running sum of x from its running peak, in the order of `pos`.

    The peak is at least `floor`. A piece is summed up by its total, highest and lowest running sum and its own deepest fall;
    the summaries of a key are then put together in order, so the rows are read and moved once.
    """
    rows = chunk_rows(df, rows)
    d = df.select(*keys, F.floor(F.col(pos) / rows).alias("_piece"), F.col(pos).alias("_pos"), c(x).cast("double").alias("_v"))
    inside = Window.partitionBy(*keys, "_piece").orderBy("_pos").rowsBetween(Window.unboundedPreceding, 0)
    d = d.withColumn("_cum", F.sum("_v").over(inside)).withColumn("_pk", F.max("_cum").over(inside))
    s = d.groupBy(*keys, "_piece").agg(F.sum("_v").alias("_all"), F.max("_cum").alias("_top"), F.min("_cum").alias("_low"), F.min(F.col("_cum") - F.col("_pk")).alias("_own"))
    before = Window.partitionBy(*keys).orderBy("_piece").rowsBetween(Window.unboundedPreceding, -1)
    s = s.withColumn("_p", F.coalesce(F.sum("_all").over(before), F.lit(0.0)))
    peak = F.max(F.col("_p") + F.col("_top")).over(before)
    s = s.withColumn("_m", peak if floor is None else F.greatest(peak, F.lit(float(floor))))
    return s.groupBy(*keys).agg(F.min(F.least("_own", F.when(F.col("_m").isNotNull(), F.col("_p") + F.col("_low") - F.col("_m")))).alias(out))


_MERGE = {
    "sum": lambda a, b: F.coalesce(a, F.lit(0)) + F.coalesce(b, F.lit(0)),
    "max": lambda a, b: F.greatest(a, b),
    "min": lambda a, b: F.least(a, b),
    "last": lambda a, b: F.coalesce(b, a),
    "first": lambda a, b: F.coalesce(a, b),
}
_AGG = {
    "sum": F.sum,
    "max": F.max,
    "min": F.min,
    "last": lambda x: F.last(x, ignorenulls=True),
    "first": lambda x: F.first(x, ignorenulls=True),
}
_TURNED = {"first": "last", "last": "first"}


def running(df: DataFrame, cols: Mapping[str, tuple], *, keys: Sequence[str] = ("symbol",),
            order: Sequence = ("bar_no",), piece: Column | None = None, forward: bool = False,
            resets: Mapping[str, Column] | None = None, rows: int | None = None) -> DataFrame:
    """Unbounded running aggregates: {out: (sum|max|min|last|first, column[, reset])}.

    A frame inside each piece plus one carried value per piece. With
    `forward=True` the frame runs from the row to the end of the key. A third
    entry names one of `resets`: the frame then starts at the latest row where
    that condition holds.

    The plan reads df twice (rows and piece ends). Several aggregates belong in
    one call; long chains of calls should be cut with `durable`.
    """
    resets, rows = resets or {}, chunk_rows(df, rows)
    piece = F.floor(F.col(order[0]) / rows) if piece is None else piece
    cut = df.withColumns({"_piece": piece, **{f"_x_{o}": c[1] for o, c in cols.items()},
                          **{f"_q_{r}": F.coalesce(x, F.lit(False)).cast("int") for r, x in resets.items()}})
    by = [*keys, "_piece"]
    back = Window.unboundedPreceding
    # a frame up to the end of the key is a frame from the start of the reversed key;
    # Spark would evaluate the former anew for every row
    turn = (lambda x: F.col(x).desc()) if forward else F.col
    kind = {o: _TURNED.get(spec[0], spec[0]) if forward else spec[0] for o, spec in cols.items()}
    along = [turn(o) for o in order]
    whole = Window.partitionBy(*by).orderBy(*along)
    inside = whole.rowsBetween(back, 0)
    across = Window.partitionBy(*keys).orderBy(turn("_piece"))

    local = cut.withColumns({f"_g_{r}": F.sum(f"_q_{r}").over(inside) for r in resets})
    vals = {"_is_tail": F.lead(F.lit(1)).over(whole).isNull()}
    for o, spec in cols.items():
        w = inside
        if len(spec) > 2:
            w = Window.partitionBy(*by, f"_g_{spec[2]}").orderBy(*along).rowsBetween(back, 0)
        vals[f"_l_{o}"] = _AGG[kind[o]](f"_x_{o}").over(w)
    local = local.withColumns(vals)

    ends = local.where("_is_tail").select(*by, *[f"_l_{o}" for o in cols], *[f"_g_{r}" for r in resets])
    ends = ends.withColumns({f"_h_{r}": F.sum((F.col(f"_g_{r}") > 0).cast("int")).over(across.rowsBetween(back, 0)) for r in resets})
    carried = {}
    for o, spec in cols.items():
        if len(spec) > 2:
            seg = Window.partitionBy(*keys, f"_h_{spec[2]}").orderBy(turn("_piece")).rowsBetween(back, 0)
            carried[f"_in_{o}"] = _AGG[kind[o]](f"_l_{o}").over(seg)
        else:
            carried[f"_in_{o}"] = _AGG[kind[o]](f"_l_{o}").over(across.rowsBetween(back, -1))
    ends = ends.withColumns(carried)
    late = {f"_in_{o}": F.lag(f"_in_{o}").over(across) for o, spec in cols.items() if len(spec) > 2}
    ends = ends.withColumns(late).select(*by, *carried)

    both = local.join(ends, by)
    out = {}
    for o, spec in cols.items():
        merged = _MERGE[kind[o]](F.col(f"_in_{o}"), F.col(f"_l_{o}"))
        if len(spec) > 2:
            merged = F.when(F.col(f"_g_{spec[2]}") > 0, F.col(f"_l_{o}")).otherwise(merged)
        out[o] = merged
    drop = ["_piece", "_is_tail"] + [f"{p}{o}" for o in cols for p in ("_x_", "_l_", "_in_")] + [f"{p}{r}" for r in resets for p in ("_q_", "_g_")]
    return both.withColumns(out).drop(*drop)
