"""Backward as-of joins without a window over a whole key.

Both sides are put under one another, cut into pieces, and the last right-hand
row is carried inside a piece and from piece to piece. Bars are cut by time;
raw events by range pieces, whose size follows their number.
"""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from .layout import PIECE_SECONDS, ranged, running, time_piece


def asof_backward(left: DataFrame, right: DataFrame, cols: Sequence[str], *, keys: Sequence[str] = ("symbol",),
                  t: str = "t", tolerance: Column | None = None, strict: bool = False,
                  piece_seconds: int | None = PIECE_SECONDS, matched: str | None = None) -> DataFrame:
    """Each left row gets `cols` of the latest right row of its key with right.t <= left.t.

    The right side must have one row per (key, t). `tolerance` is an interval
    after which a match is too old; `strict` wants right.t < left.t; `matched`
    names a column for the matched time. Without `piece_seconds` the rows are
    cut by range pieces over key and time, written out once.
    """
    side = F.lit(1 if strict else 0)
    names = left.columns
    payload = F.struct(F.col(t).alias("_rt"), *cols)
    a = left.select(*names, F.lit(0 if strict else 1).alias("_side"), F.lit(None).cast(
        right.select(payload.alias("p")).schema["p"].dataType).alias("_r"))
    b = right.select(*keys, F.col(t), side.alias("_side"), payload.alias("_r"))
    both = a.unionByName(b, allowMissingColumns=True)
    if piece_seconds is None:
        both, piece = ranged(both, [*keys, t, "_side"], "_cut"), F.col("_cut")
    else:
        piece = time_piece(t, piece_seconds)
    got = running(both, {"_hit": ("last", F.col("_r"))}, keys=keys, order=(t, "_side"), piece=piece)
    rows = got.where(F.col("_side") == (0 if strict else 1))
    hit = F.col("_hit")
    if tolerance is not None:
        hit = F.when(F.col(t) <= hit["_rt"] + tolerance, hit)
    rows = rows.withColumn("_hit", hit)
    extra = [F.col("_hit._rt").alias(matched)] if matched else []
    return rows.select(*names, *[F.col(f"_hit.{n}").alias(n) for n in cols], *extra)
