"""Rolling ranks and quantiles: sorted buckets that slide along a chunk, one Arrow pass for all of them.

A frame function would collect or sort the whole window anew on each row. Here a row adds one value and takes one away, in
sorted buckets of bounded size, so its cost follows the number of buckets and not the window.
"""
from __future__ import annotations

from bisect import bisect_left, bisect_right, insort
from collections.abc import Mapping
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, types as T

from .layout import Frames

SIZE = 512


class Sliding:
    """A multiset of numbers, sorted in buckets of at most `size`."""

    def __init__(self, size: int = SIZE):
        self.size, self.buckets = size, [[]]

    def _of(self, v: float) -> int:
        """The first bucket that doesn't end below v, or the last one."""
        lo, hi = 0, len(self.buckets) - 1
        while lo < hi:
            mid = (lo + hi) // 2
            if self.buckets[mid] and self.buckets[mid][-1] >= v:
                hi = mid
            else:
                lo = mid + 1
        return lo

    def add(self, v: float) -> None:
        k = self._of(v)
        b = self.buckets[k]
        insort(b, v)
        if len(b) > self.size:
            self.buckets[k:k + 1] = [b[:len(b) // 2], b[len(b) // 2:]]

    def remove(self, v: float) -> None:
        k = self._of(v)
        b = self.buckets[k]
        del b[bisect_left(b, v)]
        if not b and len(self.buckets) > 1:
            del self.buckets[k]

    def below(self, v: float) -> int:
        k = self._of(v)
        return sum(map(len, self.buckets[:k])) + bisect_left(self.buckets[k], v)

    def at_most(self, v: float) -> int:
        n = 0
        for b in self.buckets:
            if not b or b[-1] <= v:
                n += len(b)
            else:
                return n + bisect_right(b, v)
        return n

    def kth(self, i: int) -> float:
        for b in self.buckets:
            if i < len(b):
                return b[i]
            i -= len(b)
        raise IndexError(i)


@dataclass(frozen=True)
class Order:
    """A statistic of the last `n` rows of a column, missing until `least` values are there.

    kind: share (of values that are at most the present one), rank (of the present one as a share, ties at their mean rank), or
    quantile (`q`, with linear interpolation). Missing values and NaN don't count; share and rank of a missing one are missing."""
    column: str
    n: int
    kind: str
    least: int = 1
    q: float = 0.5


def slide(x: np.ndarray, specs: list[Order]) -> list[np.ndarray]:
    """The statistics of one column with one window length, row by row; NaN where missing."""
    n, held, k = specs[0].n, Sliding(), 0
    out = [np.full(len(x), np.nan) for _ in specs]
    values = x.tolist()
    for i, v in enumerate(values):
        if i >= n and (old := values[i - n]) == old:
            held.remove(old)
            k -= 1
        here = v == v
        if here:
            held.add(v)
            k += 1
        for s, o in zip(specs, out):
            if k < max(s.least, 1):
                continue
            if s.kind == "quantile":
                at = s.q * (k - 1)
                low = held.kth(int(at))
                o[i] = low if at == int(at) else low + (held.kth(int(at) + 1) - low) * (at - int(at))
            elif here and s.kind == "share":
                o[i] = held.at_most(v) / k
            elif here:
                b = held.below(v)
                o[i] = (b + (held.at_most(v) - b + 1) / 2.0) / k
    return out


def order_stats(df: DataFrame, f: Frames, specs: Mapping[str, Order]) -> DataFrame:
    """df of a chunked pass (`in_chunks`) with a column for each statistic. History: the longest n."""
    names, pos = list(specs), f.pos
    groups: dict[tuple[str, int], list[str]] = {}
    for name, s in specs.items():
        groups.setdefault((s.column, s.n), []).append(name)
    schema = T.StructType([*df.schema.fields, *[T.StructField(n, T.DoubleType()) for n in names]])

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by(pos)
        done: dict[str, np.ndarray] = {}
        for (column, _), wanted in groups.items():
            x = table[column].cast(pa.float64()).to_numpy(zero_copy_only=False)
            done |= dict(zip(wanted, slide(x, [specs[w] for w in wanted])))
        for n in names:
            table = table.append_column(n, pa.array(done[n], mask=np.isnan(done[n])))
        return table

    return df.groupBy(*f.keys).applyInArrow(run, schema)
