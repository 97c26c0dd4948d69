"""Extremes of the rows ahead by a sparse table: maxima and minima of 1, 2, 4, ... rows, made once per chunk.

Any frame is two entries of the table, and the first row by which a range is reached is found by going down its levels, so the
work per row is the logarithm of the horizon for all horizons together.
"""
from __future__ import annotations

import numpy as np


class Ahead:
    """Highest x and lowest y of the n rows after each row, for n up to `most`. Missing values are passed over; rows past the end are missing."""

    def __init__(self, x: np.ndarray, y: np.ndarray, most: int):
        self.rows, self.most = len(x), most
        pad = np.full(most + 1, np.nan)
        self.high, self.low = [np.r_[x, pad]], [np.r_[y, pad]]
        k = 1
        while 2 * k <= most:
            for table, pick in ((self.high, np.fmax), (self.low, np.fmin)):
                last = table[-1]
                table.append(pick(last, np.r_[last[k:], np.full(k, np.nan)]))
            k *= 2
        self.at = np.arange(self.rows)

    def span(self, n: int) -> np.ndarray:
        """Highest minus lowest over the next n rows."""
        k = n.bit_length() - 1
        i, j = self.at + 1, self.at + 1 + n - (1 << k)
        return np.fmax(self.high[k][i], self.high[k][j]) - np.fmin(self.low[k][i], self.low[k][j])

    def first(self, reached) -> np.ndarray:
        """How many rows ahead `reached(span)` first holds; most + 1 or more if it doesn't. It must not cease to hold as the span grows."""
        n, top, bottom = np.zeros(self.rows, dtype=np.int64), np.full(self.rows, np.nan), np.full(self.rows, np.nan)
        for k in reversed(range(len(self.high))):
            i = np.minimum(self.at + 1 + n, self.rows + self.most)
            h, l = np.fmax(top, self.high[k][i]), np.fmin(bottom, self.low[k][i])
            go = ~reached(h - l) & (n + (1 << k) <= self.most)
            n, top, bottom = np.where(go, n + (1 << k), n), np.where(go, h, top), np.where(go, l, bottom)
        return n + 1
