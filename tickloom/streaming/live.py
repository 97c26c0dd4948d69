"""Structured Streaming: ticks, closed bars, running delta, sessions, live statistics, exit votes.

Event times need a zone for watermarks, so sources cast them to `timestamp`
(the session zone is UTC). Stateful operators use RocksDB and keep bounded
state: numbers, or a list of fixed length.
"""
from __future__ import annotations

import math
import uuid
from collections.abc import Callable, Sequence

import numpy as np
import pandas as pd
from numpy.lib.stride_tricks import sliding_window_view
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from ..functions.exprs import c
from ..operators.durable import shared_dir
from ..operators.paths import DECAY_RATE, MEDIAN_BEST, MIN_HOLD_OF_REGIME, P90_HOLD, STREAK_OF_REGIME, VOTES_LOSS_OF_REGIME

ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


PIECE = 1 << 16  # rows that leave a state at once


def use_rocksdb(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)


def read_ticks(spark: SparkSession, path: str, schema, t: str = "ts", delay: str = "10 minutes") -> DataFrame:
    """File stream with a watermark on its event time."""
    raw = spark.readStream.schema(schema).parquet(path)
    return raw.withColumn(t, F.col(t).cast("timestamp")).withWatermark(t, delay)


def dedupe(ticks: DataFrame, keys: Sequence[str] = ("symbol", "sequence")) -> DataFrame:
    """One row per sequence number inside the watermark."""
    return ticks.dropDuplicatesWithinWatermark(list(keys))


def signed_volume(direction, volume) -> Column:
    d = F.upper(c(direction))
    return F.when(d.contains("BUY"), c(volume)).when(d.contains("SELL"), -c(volume)).otherwise(0.0)


def bars(ticks: DataFrame, width: str, *, keys: Sequence[str] = ("symbol",), t: str = "ts", price: str = "value", tie: str = "event_id",
         size: Column | None = None) -> DataFrame:
    """Closed right-edge bars; a bar appears once the watermark has passed its end."""
    at = F.struct(t, tie)
    g = ticks.groupBy(*keys, F.window(t, width).alias("w")).agg(
        F.min_by(price, at).alias("open"), F.max(price).alias("high"), F.min(price).alias("low"), F.max_by(price, at).alias("close"),
        F.sum(F.lit(1.0) if size is None else size).alias("volume"))
    return g.select(*keys, F.col("w.end").alias("t"), "w", "open", "high", "low", "close", "volume")


def delta_per_window(ticks: DataFrame, width: str, signed: Column, *, keys: Sequence[str] = ("symbol",), t: str = "ts") -> DataFrame:
    g = ticks.groupBy(*keys, F.window(t, width).alias("w")).agg(F.sum(signed).alias("delta"))
    return g.select(*keys, F.col("w.end").alias("t"), "w", "delta")


def sessions(ticks: DataFrame, gap: str = "4 hours", *, keys: Sequence[str] = ("symbol",), t: str = "ts") -> DataFrame:
    """Closed sessions: a gap of at least `gap` ends one."""
    g = ticks.groupBy(*keys, F.session_window(t, gap).alias("s")).agg(F.count(F.lit(1)).alias("n"), F.max(t).alias("last"))
    return g.select(*keys, F.col("s.start").alias("start"), "last", "n")


class RunningTotal(StatefulProcessor):
    """Adds a column up over the whole stream of a key; starts from the initial state if there is one."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.total = handle.getValueState("total", "total double")

    def handleInitialState(self, key, initialState, timerValues) -> None:
        self.total.update((float(initialState["total"].iloc[0]),))

    def handleInputRows(self, key, rows, timerValues):
        pdf = pd.concat(list(rows)).sort_values("t")
        start = float(self.total.get()[0]) if self.total.exists() else 0.0
        pdf["total"] = start + pdf["delta"].cumsum()
        self.total.update((float(pdf["total"].iloc[-1]),))
        yield pdf[["symbol", "t", "delta", "total"]]


def running_delta(deltas: DataFrame, start: DataFrame | None = None) -> DataFrame:
    """Cumulated signed volume per symbol; `start` holds (symbol, total) before the stream (the warm-up)."""
    kw = {"initialState": start.groupBy("symbol")} if start is not None else {}
    return deltas.select("symbol", "t", "delta").groupBy("symbol").transformWithStateInPandas(
        RunningTotal(), outputStructType="symbol string, t timestamp, delta double, total double",
        outputMode="append", timeMode="None", **kw)


class LastN(StatefulProcessor):
    """Win rate and mean of the last 50 results of a key."""

    size = 50

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.kept = handle.getValueState("kept", "xs array<double>")

    def handleInputRows(self, key, rows, timerValues):
        # three numbers a row are held to sort them; the results leave in pieces
        parts = [(p["t"].to_numpy("datetime64[us]"), p["id"].to_numpy(), p["x"].to_numpy(float)) for p in rows]
        t, ids, x = (np.concatenate(p) for p in zip(*parts))
        del parts
        order = np.lexsort((ids, t))
        del t
        xs = np.array(self.kept.get()[0] if self.kept.exists() else [], dtype=float)
        for i in range(0, len(order), PIECE):
            at = order[i:i + PIECE]
            before = len(xs)
            xs = np.r_[xs, x[at]]
            short = max(self.size - 1 - before, 0)
            frames = sliding_window_view(np.r_[np.zeros(short), xs], self.size)[-len(at):]
            n = np.minimum(np.arange(before + 1, before + len(at) + 1), self.size)
            yield pd.DataFrame({"key": key[0], "id": ids[at], "win_rate": (frames > 0).sum(axis=1) / n, "mean": frames.sum(axis=1) / n})
            xs = xs[-self.size:]
        self.kept.update((xs.tolist(),))


def live_statistics(results: DataFrame) -> DataFrame:
    """results: (key, id, t, x) -> rolling win rate and mean per row."""
    return results.groupBy("key").transformWithStateInPandas(
        LastN(), outputStructType="key string, id bigint, win_rate double, mean double", outputMode="append", timeMode="None")


class ExitVote(StatefulProcessor):
    """The exit vote of `operators.paths.exit_vote` on pushed marks.

    All that the vote needs of the past fits in a few numbers: the last seven
    marks, the peak, the last rows above two limits, and the moments and last
    two values of the exit probability.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("s", "n int, last array<double>, peak double, dry int, shallow int, k int, mean double, m2 double, p1 double, p2 double")

    def handleInputRows(self, key, rows, timerValues):
        pdf = pd.concat(list(rows)).sort_values("step")
        if self.state.exists():
            n, last, peak, dry, shallow, k, mean, m2, p1, p2 = self.state.get()
            last = list(last)
        else:
            n, last, peak, dry, shallow, k, mean, m2, p1, p2 = 0, [], -math.inf, 0, 0, 0, 0.0, 0.0, math.nan, math.nan
        codes = []
        for r in pdf.itertuples(index=False):
            n += 1
            x, p, bars, g = float(r.mtm), min(max(float(r.exit_prob), 0.0), 1.0), int(r.step), min(max(int(r.regime), 0), 4)
            last = (last + [x])[-7:]
            peak = max(peak, x)
            dry = n if x >= -0.02 else dry
            shallow = n if x >= -0.10 else shallow
            sd = math.sqrt(m2 / (k - 1)) if k > 1 else 0.0
            codes.append(self.decide(n, last, peak, n - dry, n - shallow, p, k, mean, sd, p1, p2, bars, g, int(r.hold_ref), int(r.max_hold)))
            k += 1
            d = float(r.exit_prob) - mean
            mean += d / k
            m2 += d * (float(r.exit_prob) - mean)
            p2, p1 = p1, float(r.exit_prob)
        self.state.update((n, last, peak, dry, shallow, k, mean, m2, p1, p2))
        pdf["exit_code"] = codes
        yield pdf[["trade_id", "step", "exit_code"]]

    @staticmethod
    def decide(n, last, peak, streak, deep, p, k, mean, sd, p1, p2, bars, g, ref, most) -> str:
        x = last[-1]
        mom = False
        if n >= 6:
            fast, slow = (x - last[-3]) / 2, (x - last[-6]) / 5
            fast1 = (last[-2] - last[-4]) / 2
            slow1 = (last[-2] - last[-7]) / 5 if len(last) >= 7 else slow
            mom = (fast1 >= slow1 and fast < slow) or (fast < 0 and slow < 0)
        fall = max(peak - x, 0.0)
        tol = min(0.20 + peak * 0.5, 0.40) if peak > 0 else 0.15
        dd = n >= 3 and ((peak > 0.01 and fall / max(peak, 1e-9) > 0.35) or fall > tol or (x < -0.15 and peak <= 0.02))
        over = bars - MEDIAN_BEST[g]
        late = over > 0 and min(1.0, over * DECAY_RATE[g] + 0.5) > 0.6
        cap = min(P90_HOLD[g], most) if most > 0 else P90_HOLD[g]
        z = (p - mean) / sd if k >= 5 and sd >= 1e-8 else 0.0
        rising = n >= 3 and p1 > p2 and p > p1
        model = p > 0.38 or (n >= 2 and (z > 1.0 or (rising and sd >= 1e-8 and z > 0.7)))
        water = n >= 3 and (streak >= STREAK_OF_REGIME.get(g, 8) or deep >= 5)
        if bars < max(MIN_HOLD_OF_REGIME.get(g, 6), ref, 0):
            return "hold_min"
        if mom and dd and x > 0.01:
            return "profit_decay"
        if water:
            return "underwater_bleed"
        if bars > cap > 0:
            return "regime_safety"
        if late and model and not mom and not dd and x <= 0.0:
            return "time_model_underwater"
        votes = mom + dd + late + model + water
        return f"vote_{votes}" if votes >= (2 if x > 0.01 else VOTES_LOSS_OF_REGIME.get(g, 1)) else "hold"


def exit_votes(marks: DataFrame) -> DataFrame:
    """marks: (trade_id, step, mtm, exit_prob, regime, hold_ref, max_hold) -> exit code per mark."""
    return marks.groupBy("trade_id").transformWithStateInPandas(
        ExitVote(), outputStructType="trade_id string, step int, exit_code string", outputMode="append", timeMode="None")


def bar_with_delta(bar_stream: DataFrame, delta_stream: DataFrame) -> DataFrame:
    """Bars with the delta of their own window; both sides close at the same watermark."""
    d = delta_stream.select(F.col("symbol").alias("_s"), F.col("w").alias("_w"), "delta")
    return bar_stream.join(d, (bar_stream.symbol == d._s) & (bar_stream.w == d._w), "leftOuter").drop("_s", "_w")


def _stored(spark: SparkSession, path: str) -> DataFrame | None:
    try:
        return spark.read.parquet(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return None


def signal_log(store: str, late_store: str | None = None, keys: Sequence[str] = ("symbol", "t")) -> Callable[[DataFrame, int], None]:
    """foreachBatch writer: one row per key, split by day; rows at or before the newest stored time of their symbol go to the side table.

    Every batch has folders of its own, which a repeated batch writes over, and leaves the newest time per symbol behind. A
    batch reads that small table of the batch before it, never the log, so a repeat finds what the first try found.
    """
    def write(batch: DataFrame, batch_id: int) -> None:
        spark, name = batch.sparkSession, keys[0]
        rows = batch.dropDuplicates(list(keys)).withColumn("day", F.to_date("t"))
        before = _stored(spark, f"{store}-newest/{batch_id - 1}") if batch_id else None
        rows = rows.withColumn("_seen", F.lit(None).cast("timestamp")) if before is None else rows.join(before.withColumnRenamed("newest", "_seen"), name, "left")
        late = F.coalesce(F.col("t") <= F.col("_seen"), F.lit(False))
        if late_store:
            rows.where(late).drop("_seen").write.mode("overwrite").partitionBy("day").parquet(f"{late_store}/batch={batch_id}")
        fresh = rows.where(~late)
        fresh.drop("_seen").write.mode("overwrite").partitionBy("day").parquet(f"{store}/batch={batch_id}")
        newest = fresh.select(name, F.col("t").alias("newest"))
        newest = newest if before is None else newest.unionByName(before)
        newest.groupBy(name).agg(F.max("newest").alias("newest")).write.mode("overwrite").parquet(f"{store}-newest/{batch_id}")
    return write


class CarriedTotal(StatefulProcessor):
    """Running total of the deltas of a key; windows without a delta read the total as it was."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.total = handle.getValueState("total", "total double")

    def handleInputRows(self, key, rows, timerValues):
        pdf = pd.concat(list(rows)).sort_values("t")
        start = float(self.total.get()[0]) if self.total.exists() else math.nan
        d = pdf["delta"].astype(float)
        known = d.notna().cummax() if math.isnan(start) else pd.Series(True, index=d.index)
        pdf["total"] = (d.fillna(0.0).cumsum() + (0.0 if math.isnan(start) else start)).where(known)
        last = pdf["total"].iloc[-1]
        if not math.isnan(last):
            self.total.update((float(last),))
        yield pdf.loc[pdf["close"].notna(), ["symbol", "t", "close", "delta", "total"]]


def bars_with_running_delta(prices: DataFrame, ticks: DataFrame, width: str, *, t: str = "ts") -> DataFrame:
    """Bars of `prices` (symbol, time, value) with the delta of `ticks` (symbol, time, signed) in their window and the running total, carried on.

    Both streams go through one window aggregate, so each window is complete when it closes and totals run in order.
    """
    both = prices.select("symbol", t, F.col("value").alias("_p"), F.lit(None).cast("double").alias("_d")).unionByName(
        ticks.select("symbol", t, F.lit(None).cast("double").alias("_p"), F.col("signed").alias("_d")))
    g = both.groupBy("symbol", F.window(t, width).alias("w")).agg(F.max_by("_p", F.when(F.col("_p").isNotNull(), F.struct(t, "_p"))).alias("close"), F.sum("_d").alias("delta"))
    return g.select("symbol", F.col("w.end").alias("t"), "close", "delta").groupBy("symbol").transformWithStateInPandas(
        CarriedTotal(), outputStructType="symbol string, t timestamp, close double, delta double, total double", outputMode="append", timeMode="None")


def drain(stream: DataFrame, spark: SparkSession) -> DataFrame:
    """Run a bounded stream to its end into Parquet in the shared folder and read the result."""
    home = f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}"
    q = (stream.writeStream.format("parquet").outputMode("append").option("path", f"{home}/out")
         .option("checkpointLocation", f"{home}/log").trigger(availableNow=True).start())
    q.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{home}/out")


def foreach_drain(stream: DataFrame, spark: SparkSession, write: Callable[[DataFrame, int], None]) -> None:
    home = f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}"
    stream.writeStream.foreachBatch(write).option("checkpointLocation", home).trigger(availableNow=True).start().awaitTermination()
