"""Exact medians and median absolute deviations over many rounds of hashed random signs, without a copy of the rows per round.

The signs of all rounds are kept beside each value. Counts per bin of |x| and round bound each wanted order statistic from both
sides; one pass then counts what lies below the bounds and puts out only the values between them, which are ranked exactly.
"""
from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from .durable import stored
from .ranks import running_over_values

BINS = 512


def signed_rows(df: DataFrame, x: str, rounds: int, positive) -> DataFrame:
    """`_a` (size of x) and `_plus`, for each round from 1 on whether the sign is positive, `positive(round)`."""
    plus: Column = F.transform(F.sequence(F.lit(1), F.lit(rounds)), positive)
    rows = df.where(F.col(x).isNotNull()).repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))  # hashing is the work, not reading
    return stored(rows.select(F.abs(x).alias("_a"), plus.alias("_plus")))


def _matrix(batch: pa.RecordBatch, rounds: int) -> tuple[np.ndarray, np.ndarray]:
    plus = batch.column("_plus").flatten().to_numpy(zero_copy_only=False)
    return batch.column("_a").to_numpy(zero_copy_only=False), plus.astype(bool).reshape(-1, rounds)


def _edges(rows: DataFrame) -> np.ndarray:
    """Ends of about BINS bins of even size, up to the largest value."""
    got = rows.agg(F.percentile_approx("_a", [i / BINS for i in range(1, BINS)], 10 * BINS).alias("e"), F.max("_a").alias("top")).first()
    return np.unique([*got["e"], got["top"]])


def _bin_counts(rows: DataFrame, edges: np.ndarray, rounds: int) -> np.ndarray:
    """Rows per round and signed bin, from the largest negative values to the largest positive ones."""
    k = len(edges)

    def run(batches):
        n = np.zeros((rounds, 2 * k), dtype=np.int64)
        for b in batches:
            a, plus = _matrix(b, rounds)
            at = np.searchsorted(edges, a)
            for r in range(rounds):
                n[r] += np.bincount(np.where(plus[:, r], k + at, k - 1 - at), minlength=2 * k)
        r, b = np.nonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(r), pa.array(b), pa.array(n[r, b])], names=["r", "b", "n"])
    out = np.zeros((rounds, 2 * k), dtype=np.int64)
    for row in rows.mapInArrow(run, "r long, b long, n long").groupBy("r", "b").agg(F.sum("n").alias("n")).collect():
        out[row["r"], row["b"]] = row["n"]
    return out


def _bound(counts: np.ndarray, ends: np.ndarray, rank: int) -> np.ndarray:
    """Per round, the value of that rank if each row had the value `ends` of its bin."""
    order = np.argsort(ends, axis=1, kind="stable")
    upto = np.take_along_axis(counts, order, 1).cumsum(axis=1)
    first = (upto > rank).argmax(axis=1)
    return np.take_along_axis(ends, np.take_along_axis(order, first[:, None], 1), 1)[:, 0]


def _medians(rows: DataFrame, counts: np.ndarray, low: np.ndarray, high: np.ndarray, centre: np.ndarray | None) -> np.ndarray:
    """Median per round of the signed values, or of their distance from `centre`; `low` and `high` bound the values of each bin."""
    rounds, n = len(counts), int(counts[0].sum())
    lo, hi = (n - 1) // 2, n // 2
    least, most = _bound(counts, low, lo), _bound(counts, high, hi)

    def run(batches):
        below = np.zeros(rounds, dtype=np.int64)
        for b in batches:
            a, plus = _matrix(b, rounds)
            parts = []
            for r in range(rounds):
                v = np.where(plus[:, r], a, -a)
                v = v if centre is None else np.abs(v - centre[r])
                below[r] += int((v < least[r]).sum())
                u, k = np.unique(v[(v >= least[r]) & (v <= most[r])] + 0.0, return_counts=True)
                parts.append((np.full(len(u), r), u, k))
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(p)) for p in zip(*parts)], names=["r", "v", "n"])
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(rounds)), pa.nulls(rounds, pa.float64()), pa.array(below)], names=["r", "v", "n"])
    got = stored(rows.mapInArrow(run, "r long, v double, n long").groupBy("r", "v").agg(F.sum("n").alias("n")))
    base = F.broadcast(got.where("v IS NULL").select("r", F.col("n").alias("_base")))
    cum = running_over_values(got.where("v IS NOT NULL"), "v", {"_upto": F.col("n")}, ("r",)).join(base, "r")
    at = F.col("_base") + F.col("_upto")
    two = cum.groupBy("r").agg(F.min(F.when(at > lo, F.col("v"))).alias("a"), F.min(F.when(at > hi, F.col("v"))).alias("b"))
    out = np.empty(rounds)
    for row in two.collect():
        out[row["r"]] = row["a"] + (row["b"] - row["a"]) * (0.5 if hi > lo else 0.0)
    return out


def median_deviations(rows: DataFrame, rounds: int) -> list[float]:
    """For each round the median absolute deviation of the rows of `signed_rows`, of which there must be one at least."""
    edges = _edges(rows)
    counts = _bin_counts(rows, edges, rounds)
    starts = np.r_[0.0, edges[:-1]]
    low, high = np.r_[-edges[::-1], starts], np.r_[-starts[::-1], edges]
    every = (rounds, len(low))
    centre = _medians(rows, counts, np.broadcast_to(low, every), np.broadcast_to(high, every), None)
    one, two = np.abs(low - centre[:, None]), np.abs(high - centre[:, None])
    inside = (low <= centre[:, None]) & (centre[:, None] <= high)
    return _medians(rows, counts, np.where(inside, 0.0, np.minimum(one, two)), np.maximum(one, two), centre).tolist()
