"""Bounded forward paths as an equi join.

Bars get a block number floor(bar_no / h). An entry at bar i needs the bars
i+1 .. i+h, which lie in at most two blocks, so it is copied to those blocks
and joined on (key, block). A task never sees more than the blocks it hashes.
"""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F


def forward_path(entries: DataFrame, bars: DataFrame, horizon: int, bar_cols: Sequence[str], *,
                 keys: Sequence[str] = ("symbol",), pos: str = "bar_no", step: str = "step",
                 prefix: str = "") -> DataFrame:
    """One row per (entry, step in 1..horizon) with the bar columns at that step.

    `entries` carries keys, pos and whatever else; `bar_cols` are renamed with `prefix`.
    """
    lo = F.floor((F.col(pos) + 1) / horizon)
    hi = F.floor((F.col(pos) + horizon) / horizon)
    e = entries.withColumn("_blk", F.explode(F.sequence(lo.cast("bigint"), hi.cast("bigint"))))
    b = bars.select(*keys, F.floor(F.col(pos) / horizon).cast("bigint").alias("_blk"), F.col(pos).alias("_at"),
                    *[F.col(n).alias(prefix + n) for n in bar_cols])
    return (e.join(b, [*keys, "_blk"])
            .where(F.col("_at").between(F.col(pos) + 1, F.col(pos) + horizon))
            .withColumn(step, (F.col("_at") - F.col(pos)).cast("int"))
            .drop("_blk", "_at"))


LEVELS = 40  # cells of a minute up to any time span


def containing(rows: DataFrame, segments: DataFrame, t: str, start: str, end: str, *, keys: Sequence[str] = ("symbol",), seconds: int = 60) -> DataFrame:
    """Rows with every segment of their key that contains their time, both ends included.

    Time is cut into cells of `seconds`, pairs of them, pairs of pairs and so on. A segment is put into the fewest cells that
    make it up, at most two of each width, and a row asks once for each width in use: a segment of minutes costs as little
    as one of years. The widths in use are a list of at most LEVELS numbers.
    """
    epoch = F.lit("1970-01-01 00:00:00").cast("timestamp_ntz")

    def cell(x):
        return F.floor(F.timestamp_diff("SECOND", epoch, F.col(x)) / seconds).cast("bigint")

    def of_width(k):
        """At width 2^k what is left of the segment are the cells lo..hi; an odd first and an even last one aren't part of a wider cell."""
        size = F.pow(F.lit(2.0), k)
        lo, hi = F.ceil(F.col("_lo") / size).cast("bigint"), (F.floor((F.col("_hi") + 1) / size) - 1).cast("bigint")
        one = F.when((lo <= hi) & (F.pmod(lo, F.lit(2)) == 1), F.struct(k.cast("int").alias("_width"), lo.alias("_cell")))
        two = F.when((lo <= hi) & (F.pmod(hi, F.lit(2)) == 0), F.struct(k.cast("int").alias("_width"), hi.alias("_cell")))
        return F.filter(F.array(one, two), lambda x: x.isNotNull())
    s = segments.withColumns({"_lo": cell(start), "_hi": cell(end)})
    s = s.withColumn("_at", F.explode(F.flatten(F.transform(F.sequence(F.lit(0), F.lit(LEVELS)), of_width)))).select("*", "_at.*").drop("_lo", "_hi", "_at")
    used = sorted(r["_width"] for r in s.select("_width").distinct().collect())
    asks = F.array(*[F.struct(F.lit(k).alias("_width"), F.shiftright(cell(t), k).alias("_cell")) for k in used]) if used else F.array().cast("array<struct<_width:int,_cell:bigint>>")
    r = rows.withColumn("_at", F.explode(asks)).select("*", "_at.*").drop("_at")
    return r.join(s, [*keys, "_width", "_cell"]).where(F.col(t).between(F.col(start), F.col(end))).drop("_width", "_cell")
