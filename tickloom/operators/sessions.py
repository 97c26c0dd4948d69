"""Session marks from time gaps."""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from ..functions.exprs import micros
from .layout import in_chunks, running


def mark_sessions(df: DataFrame, *, keys: Sequence[str] = ("symbol",), t: str = "t", pos: str = "bar_no",
                  gap_hours: float = 4.0, open_skip: int = 0, close_cutoff: int = 0, rows: int | None = None) -> DataFrame:
    """session_id, bar_of_session, bars_remaining and validity per row.

    A session starts after a gap strictly longer than `gap_hours`. The session
    start is carried forward and the next session's start backward, so a
    session of any length costs two carried values.
    """
    limit = int(gap_hours * 3600 * 1_000_000)
    p = F.col(pos)

    def mark(x, f):
        us = micros(t)
        return x.withColumns({"_new": F.coalesce((us - f.lag(us) > limit).cast("int"), F.lit(0)),
                              "_last": F.when(F.coalesce(f.lead(us) - us > limit, F.lit(True)), p)})
    d = in_chunks(df, mark, history=1, lookahead=1, keys=keys, pos=pos, rows=rows)
    starts = F.when((F.col("_new") == 1) | (p == 0), p)
    d = running(d, {"session_id": ("sum", F.col("_new")), "_first": ("max", starts)}, keys=keys, order=(pos,), rows=rows)
    d = running(d, {"_end": ("min", F.col("_last"))}, keys=keys, order=(pos,), forward=True, rows=rows)
    d = d.withColumns({"bar_of_session": p - F.col("_first"), "bars_remaining": F.col("_end") - p})
    ok = (F.col("bar_of_session") >= open_skip) & (F.col("bars_remaining") >= close_cutoff)
    return d.withColumn("valid", ok).drop("_new", "_first", "_last", "_end")
