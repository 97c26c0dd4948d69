"""Summaries of closed trades and of strategy returns on bars."""
from __future__ import annotations

import heapq
import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.exprs import c, div
from .asof import asof_backward
from .durable import durable, stored
from .fold import ordered_fold, summary_fold
from .gates import DRIVERS
from .layout import deepest_fall, in_chunks, number_rows, running
from .ranks import exact_quantiles

COMBINED = "COMBINED"
MINUTES_PER_YEAR = 252 * 390


def with_total(df: DataFrame, symbol: str = "symbol", label: str = "label") -> DataFrame:
    """Every row twice: under its symbol and under COMBINED."""
    return df.withColumn(label, F.explode(F.array(F.col(symbol), F.lit(COMBINED))))


def in_order(trades: DataFrame, order: Sequence[str] = ("exit_time", "trade_id"), out: str = "pos") -> DataFrame:
    """Trades with their position in the whole log; every subset of them is ordered by it too."""
    return number_rows(trades, (), order, "range", out)


def drawdown_rows(trades: DataFrame, key: str, ret: str = "ret", pos: str = "pos") -> DataFrame:
    """Simple cumulative return, its peak (at least 0) and the drawdown, per key in the order of `pos`."""
    d = trades.select(key, pos, ret)
    d = running(d, {"cum": ("sum", F.col(ret))}, keys=(key,), order=(pos,))
    d = running(d, {"_peak": ("max", F.col("cum"))}, keys=(key,), order=(pos,))
    return d.withColumn("peak", F.greatest(F.col("_peak"), F.lit(0.0))).withColumn("dd", F.col("cum") - F.col("peak")).drop("_peak")


def profit_factor(ret: Column) -> Column:
    lost = F.sum(F.when(ret < 0, ret).otherwise(0.0))
    return F.when(lost < -1e-12, F.sum(F.when(ret > 0, ret).otherwise(0.0)) / -lost)


def summarise(trades: DataFrame, key: str = "label", exit_time: str = "exit_time", ret: str = "ret", hold: str = "hold",
              pos: str = "pos") -> DataFrame:
    """One metric row per key; ratios are annualised by trades per year between first and last exit. Needs `in_order`."""
    r = F.col(ret)
    depth = deepest_fall(trades, ret, keys=(key,), pos=pos, out="max_drawdown")
    m = trades.groupBy(key).agg(
        F.count(F.lit(1)).alias("n_trades"), F.min(exit_time).alias("first_exit"), F.max(exit_time).alias("last_exit"),
        F.sum(r).alias("total_return"), F.avg(r).alias("mean_return"), F.coalesce(F.stddev_samp(r), F.lit(0.0)).alias("std_return"),
        F.avg((r > 0).cast("int")).alias("win_rate"), F.stddev_samp(F.when(r < 0, r)).alias("_down"),
        profit_factor(r).alias("profit_factor"), F.avg(hold).alias("avg_hold"))
    days = F.greatest(F.timestamp_diff("SECOND", F.col("first_exit"), F.col("last_exit")) / 86400.0, F.lit(1e-6))
    per_year = F.col("n_trades") / F.greatest(F.col("span_days") / 365.25, F.lit(1e-6))
    m = m.withColumn("span_days", days)
    m = m.withColumns({
        "sharpe": F.when(F.col("std_return") > 1e-12, F.col("mean_return") / F.col("std_return") * F.sqrt(per_year)),
        "sortino": F.when(F.col("_down") > 1e-12, F.col("mean_return") / F.col("_down") * F.sqrt(per_year)),
    }).drop("_down")
    return m.join(depth, key)


def by_regime(trades: DataFrame, key: str = "label", regime: str = "regime", ret: str = "ret", hold: str = "hold") -> DataFrame:
    r = F.col(ret)
    g = trades.where(F.col(regime).isNotNull()).groupBy(key, regime).agg(
        F.count(F.lit(1)).alias("n"), F.avg(r).alias("mean_return"), F.avg((r > 0).cast("int")).alias("win_rate"), F.avg(hold).alias("avg_hold"),
        F.avg(F.when(r > 0, r)).alias("avg_win"), F.avg(F.when(r < 0, r)).alias("avg_loss"),
        F.when(F.sum(F.when(r < 0, r)) < 0, F.sum(F.when(r > 0, r).otherwise(0.0)) / -F.sum(F.when(r < 0, r))).alias("profit_factor"))
    share = F.col("n") / F.sum("n").over(Window.partitionBy(key))
    return g.withColumns({"share": share, "payoff": F.when(F.col("avg_loss") < 0, F.col("avg_win") / -F.col("avg_loss"))})


def by_strategy(trades: DataFrame, key: str = "strategy", ret: str = "ret", hold: str = "hold") -> DataFrame:
    """Trade statistics with exact 1% and 5% quantiles; hedge means where the log has hedge columns, else missing."""
    r = F.col(ret)
    hedge = {f"avg_{n}": F.avg(F.col(n).cast("double")) if n in trades.columns else F.max(F.lit(None).cast("double")) for n in ("hedge_pnl", "hedge_count")}
    g = trades.groupBy(key).agg(
        F.count(F.lit(1)).alias("n"), F.avg(r).alias("mean_return"), F.avg((r > 0).cast("int")).alias("win_rate"),
        F.when(F.sum(F.when(r < 0, r)) < 0, F.sum(F.when(r > 0, r).otherwise(0.0)) / -F.sum(F.when(r < 0, r))).alias("profit_factor"),
        F.min(r).alias("worst"), F.avg(hold).alias("avg_hold"), *[x.alias(n) for n, x in hedge.items()])
    q = exact_quantiles(trades, ret, {"p01": 0.01, "p05": 0.05}, (key,))
    total = trades.agg(F.count(F.lit(1))).scalar()
    return g.join(q, key).withColumn("share", F.col("n") / total)


def by_driver(trades: DataFrame, key: str = "label", driver: str = "driver", ret: str = "ret") -> DataFrame:
    r = F.col(ret)
    g = trades.groupBy(key, driver).agg(F.count(F.lit(1)).alias("n"), F.sum(r).alias("sum_return"), F.avg(r).alias("mean_return"),
                                        F.sum(F.abs(r)).alias("_abs"))
    w = Window.partitionBy(key)
    return g.withColumns({"share_n": F.col("n") / F.sum("n").over(w), "share_abs": div(F.col("_abs"), F.sum("_abs").over(w))}).drop("_abs")


def driver_shares(trades: DataFrame, driver: str = "driver") -> DataFrame:
    """Share of trades per known driver, zero for those that do not occur, plus all others found."""
    spark = trades.sparkSession
    known = spark.createDataFrame([(d,) for d in DRIVERS], f"{driver} string")
    found = trades.groupBy(driver).agg(F.count(F.lit(1)).alias("n"))
    total = trades.agg(F.count(F.lit(1))).scalar()
    return known.join(found, driver, "full").select(driver, (F.coalesce(F.col("n"), F.lit(0)) / total).alias("share"))


def by_reason(trades: DataFrame, key: str = "label", reason: str = "reason", hold: str = "hold") -> DataFrame:
    g = trades.groupBy(key, reason).agg(F.count(F.lit(1)).alias("n"), F.avg(hold).alias("avg_hold"))
    q = exact_quantiles(trades, hold, {"p50_hold": 0.5, "p90_hold": 0.9}, (key, reason))
    return g.join(q, [key, reason], "left").withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy(key)))


def reconcile_counts(raw: DataFrame, kept: DataFrame, key: str = "symbol") -> DataFrame:
    a = raw.groupBy(key).agg(F.count(F.lit(1)).alias("raw_n"))
    b = kept.groupBy(key).agg(F.count(F.lit(1)).alias("kept_n"))
    j = a.join(b, key, "full").withColumns({n: F.coalesce(F.col(n), F.lit(0)) for n in ("raw_n", "kept_n")})
    return j.withColumn("skipped_n", F.col("raw_n") - F.col("kept_n"))


def sum_counters(counters: DataFrame, key: str = "symbol", name: str = "counter", value: str = "value") -> DataFrame:
    """Counters per symbol and summed under COMBINED."""
    g = counters.groupBy(name, key).agg(F.sum(value).alias(value)).rollup(name, key).agg(F.sum(value).alias(value), F.grouping(key).alias("_g"))
    return g.where(F.col(name).isNotNull()).withColumn(key, F.when(F.col("_g") == 1, COMBINED).otherwise(F.col(key))).drop("_g")


def exit_engine(rules: Column, learned: Column, other: Column) -> Column:
    """Engine name from the exit counters."""
    return (F.when((rules > 0) & (learned == 0), "synthetic_rules")
            .when((rules > 0) & (learned > 0), "mixed_synthetic_rules_and_l3")
            .when(learned > 0, "learned_l3").when(other > 0, "non_synthetic_non_l3").otherwise("none"))


def regime_segments(trades: DataFrame, keys=("symbol",), entry="entry_time", exit_="exit_time", regime="regime", tie="trade_id",
                    ret="ret", **kw) -> DataFrame:
    """Runs of trades with one regime in which no trade starts before the run's latest exit so far (less a second).

    A trade that starts earlier opens a new run, so the check needs the running
    maximum of exits inside the run; an overlap with an older run's longer exit
    does not count. Chunks are summed up, so a run of any length costs two passes.
    """
    d = number_rows(trades, keys, (entry, tie), "range")
    secs = F.timestamp_diff("SECOND", F.lit("1970-01-01").cast("timestamp_ntz"), F.col(entry).cast("timestamp_ntz")).cast("double")
    out_secs = F.timestamp_diff("SECOND", F.lit("1970-01-01").cast("timestamp_ntz"), F.col(exit_).cast("timestamp_ntz")).cast("double")
    d = d.withColumns({"_in": secs, "_out": out_secs, "_rg": F.col(regime).cast("double")})

    def marks(pdf, reg, end):
        new = []
        for e, x, g in zip(pdf["_in"].to_numpy(float), pdf["_out"].to_numpy(float), pdf["_rg"].to_numpy(float)):
            same = reg == g and e >= end - 1
            reg, end = g, max(end, x) if same else x
            new.append(not same)
        return new, reg, end

    def summary(pdf):
        new, reg, end = marks(pdf, math.nan, math.nan)
        return [pdf["_rg"].iloc[0], pdf["_in"].iloc[0], float(any(new[1:])), reg, end]

    def combine(state, got):
        # Entries rise, so the exit before a chunk can only break the run at its first trade.
        (reg, end), (first, entry, broken, last, longest) = state, got
        goes_on = reg == first and entry >= end - 1
        return state, [last, longest if broken or not goes_on else max(end, longest)]

    def step(pdf, state):
        return {"_new": marks(pdf, *state)[0]}, []

    s = summary_fold(d, summary, combine, step, {"_new": "boolean"}, [math.nan, math.nan], cols=["_in", "_out", "_rg"], keys=keys, **kw)
    s = running(s, {"segment": ("last", F.when(F.col("_new"), F.col("bar_no")))}, keys=keys, rows=kw.get("rows"))
    return s.groupBy(*keys, "segment").agg(
        F.min(entry).alias("seg_start"), F.max(exit_).alias("seg_end"), F.min(regime).alias(regime),
        F.count(F.lit(1)).alias("n"), F.sum(ret).alias("sum_return"))


def position_cap(trades: DataFrame, limit: int, *, keys: Sequence[str] = (), entry="entry_time", exit_="exit_time",
                 order=("entry_time", "symbol", "trade_id"), **kw) -> DataFrame:
    """Keep a trade if fewer than `limit` kept trades are open when it starts; adds `kept`.

    Trades without both times are kept. `order` starts with the entry time. A trade that takes a place holds it for the rest of
    its moment, so of the trades of a moment that last only the first `limit` can be kept: no row but these is sorted or moved
    for the state, which is folded over moments and not over trades. The state is the exit times of the open kept trades, at
    most `limit` numbers. Each trade is then compared with the last one kept in its moment.
    """
    if order[0] != entry:
        raise ValueError("order must start with the entry time")
    by = list(keys) or ["_all"]
    d = trades if keys else trades.withColumn("_all", F.lit(0))
    epoch = F.lit("1970-01-01").cast("timestamp_ntz")
    d = d.withColumns({n: F.timestamp_diff("MICROSECOND", epoch, F.col(x).cast("timestamp_ntz"))
                       for n, x in (("_in", entry), ("_out", exit_))})
    for k in by:
        d = d.where(F.col(k).isNotNull())
    place = F.struct(*order[1:], "_out")
    timed = F.col("_in").isNotNull() & F.col("_out").isNotNull()
    lasts = F.col("_out") > F.col("_in")
    first = Window.partitionBy(*by, "_in").orderBy(F.col("_lasts").desc(), "_place")
    heads = (d.where(timed).select(*by, "_in", "_out", lasts.alias("_lasts"), place.alias("_place"))
             .withColumn("_rn", F.row_number().over(first)).where(F.col("_rn") <= limit + 1))
    mine = F.sort_array(F.collect_list(F.when(F.col("_lasts"), F.struct("_rn", "_place", "_out"))))
    heads = durable(heads.groupBy(*by, "_in").agg(mine.alias("_heads")))

    moments = heads.select(*by, "_in", F.timestamp_micros("_in").alias("_t"),
                           F.transform(F.slice("_heads", 1, limit), lambda h: h["_out"].cast("double")).alias("_ends"))
    moments = number_rows(moments, by, ("_t",)).drop("_t")

    def step(pdf, state):
        live = [x for x in state if not math.isnan(x)]
        heapq.heapify(live)
        free = []
        for e, ends in zip(pdf["_in"], pdf["_ends"]):
            while live and live[0] <= e:
                heapq.heappop(live)
            free.append(limit - len(live))
            for x in ends[:free[-1]]:
                heapq.heappush(live, x)
        return {"_free": free}, sorted(live) + [float("nan")] * (limit - len(live))
    folded = ordered_fold(moments, step, {"_free": "int"}, [float("nan")] * limit, keys=by, **{"warm": 20 * limit, **kw})

    free, full = F.col("_free"), F.size("_heads") >= F.col("_free")
    at = F.when(free == 0, None).otherwise(F.get("_heads", free - 1)["_place"])
    known = folded.select(*by, "_in", "_free").join(heads, [*by, "_in"])
    known = known.select(*by, "_in", free, full.alias("_full"), at.alias("_last"), F.size(
        F.filter(F.slice("_heads", F.lit(1), F.greatest(free, F.lit(1))), lambda h: h["_place"] == at)).alias("_same"),
        (F.get("_heads", free)["_place"] == at).alias("_more"))
    known = stored(known)
    got = d.withColumn("_place", place).join(known, [*by, "_in"], "left")
    before = F.when(lasts, F.col("_place") <= F.col("_last")).otherwise(F.col("_place") < F.col("_last"))
    kept = F.when(~timed | ~F.col("_full"), True).when(free == 0, False).otherwise(before)
    got = got.withColumn("kept", F.coalesce(kept, F.lit(True)))
    if not known.where("_more").isEmpty():
        # Equal rows of which only some find a place
        tied = F.coalesce(F.col("_more") & lasts & (F.col("_place") == F.col("_last")), F.lit(False))
        twins = got.where(tied).withColumn("_rn", F.row_number().over(Window.partitionBy(*by, "_in", "_place").orderBy(F.lit(0))))
        got = got.where(~tied).unionByName(twins.withColumn("kept", F.col("_rn") <= F.col("_same")).drop("_rn"))
    return got.drop("_in", "_out", "_all", "_place", "_free", "_full", "_last", "_same", "_more")


def daily_pnl(trades: DataFrame, key="label", exit_="exit_time", ret="ret") -> DataFrame:
    """Sum of returns per exit day with its running total; days are few per key."""
    d = trades.groupBy(key, F.to_date(exit_).alias("day")).agg(F.sum(ret).alias("pnl"), F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy(key).orderBy("day").rowsBetween(Window.unboundedPreceding, 0)
    return d.withColumn("cum_pnl", F.sum("pnl").over(w))


def worst_drawdown_window(trades: DataFrame, key="label", ret="ret", pos="pos") -> DataFrame:
    """Deepest fall of the cumulative return from its running peak, with the places of peak and trough (first on ties). Needs `in_order`."""
    d = trades.select(key, pos, ret)
    d = running(d, {"_cum": ("sum", F.col(ret)), "_no": ("sum", F.lit(1))}, keys=(key,), order=(pos,))
    d = d.withColumns({"_cum": F.round("_cum", 9), "_no": F.col("_no") - 1})
    at = F.struct(F.col("_cum").alias("v"), (-F.col("_no")).alias("p"))
    d = running(d, {"_pk": ("max", at)}, keys=(key,), order=(pos,))
    d = d.withColumn("_dd", F.round(F.col("_cum") - F.col("_pk.v"), 9))
    g = d.groupBy(key).agg(F.min(F.struct("_dd", "_no", F.col("_pk.p").alias("pk"))).alias("w"))
    flat = F.col("w._dd") >= 0
    return g.select(key, F.col("w._dd").alias("depth"), F.when(flat, 0).otherwise(-F.col("w.pk")).alias("peak_at"),
                    F.when(flat, 0).otherwise(F.col("w._no")).alias("trough_at"))


def cumulative_on_grid(bars: DataFrame, trades: DataFrame, t="t", exit_="exit_time", ret="ret", keys=("symbol",)) -> DataFrame:
    """Cumulative return of trades closed at or before each bar."""
    day = trades.groupBy(*keys, F.col(exit_).alias(t)).agg(F.sum(ret).alias("_r"))
    day = number_rows(day, keys, (t,))
    cum = running(day, {"cum_return": ("sum", F.col("_r"))}, keys=keys)
    return asof_backward(bars, cum, ["cum_return"], keys=keys, t=t).withColumn("cum_return", F.coalesce("cum_return", F.lit(0.0)))


def bar_returns(bars: DataFrame, position: str, out: str, intraday: bool = False, t: str = "t") -> DataFrame:
    """Position times open-to-open return; the last bar (of the day, if intraday) closes out at its close."""
    def build(d, f):
        nxt = f.lead("open")
        if intraday:
            nxt = F.when(f.lead(F.to_date(t)) == F.to_date(t), nxt)
        return d.withColumn(out, F.col(position) * (div(F.coalesce(nxt, F.col("close")), "open") - 1.0))
    return in_chunks(bars, build, history=0, lookahead=1)


def trades_from_positions(bars: DataFrame, position: str) -> DataFrame:
    """Trades of a position series: in and out at the open of the bar that changes it, the last one out at the final close."""
    p = F.col(position)
    d = in_chunks(bars, lambda x, f: x.withColumns({
        "_chg": (p != F.coalesce(f.lag(p), F.lit(0))), "_next": f.lead("open"), "_last": f.lead("open").isNull()}), history=1, lookahead=1)
    d = running(d, {"_start": ("max", F.when(F.col("_chg") | (F.col("bar_no") == 0), F.col("bar_no")))})
    g = d.where(p != 0).groupBy("symbol", "_start").agg(
        F.min(p).alias("side"), F.min_by("open", "bar_no").alias("entry_price"),
        F.max_by(F.coalesce("_next", "close"), F.col("bar_no")).alias("exit_price"), F.count(F.lit(1)).alias("bars_held"),
        F.min("t").alias("entry_time"))
    return g.withColumn("trade_return", F.col("side") * (div("exit_price", "entry_price") - 1.0)).withColumnRenamed("_start", "entry_bar")


def equity_metrics(returns: DataFrame, key: Sequence[str], ret: str, pos: str = "bar_no") -> DataFrame:
    """Compounded total and annual return, Sharpe with the population deviation, and maximum drawdown."""
    grow = F.col(ret)
    returns = durable(returns.select(*key, pos, ret))
    fall = deepest_fall(returns, F.ln(1.0 + grow), keys=key, pos=pos, floor=None)
    m = returns.groupBy(*key).agg(F.sum(F.ln(1.0 + grow)).alias("_tot"), F.count(F.lit(1)).alias("periods"), F.avg(ret).alias("_mu"),
                                  F.stddev_pop(ret).alias("_sd")).join(fall, list(key)).withColumn("max_drawdown", F.exp("fall") - 1.0)
    return m.select(*key, "periods", (F.exp("_tot") - 1.0).alias("total_return"), F.exp(F.col("_tot") * (MINUTES_PER_YEAR / F.col("periods"))).alias("annual_growth"),
                    F.when(F.col("_sd") > 0, math.sqrt(MINUTES_PER_YEAR) * F.col("_mu") / F.col("_sd")).alias("sharpe"), "max_drawdown")


def calendar_windows(df: DataFrame, t: str, days: int, start: Column) -> Column:
    """Index of the fixed window of `days` calendar days that t falls into, counted from the day of `start`."""
    return F.floor(F.datediff(c(t), start) / days)


def live_check(trades: DataFrame, bench: dict[str, float], n: int = 50, keys=("symbol",), order=("exit_time", "trade_id"),
               ret="ret", hold="hold") -> DataFrame:
    """Rolling win rate, drawdown and hold against a benchmark, with warning flags from the tenth trade on."""
    d = number_rows(trades, keys, order, "range")
    d = running(d, {"_lg": ("sum", F.ln(1.0 + F.col(ret)))}, keys=keys)
    d = running(d, {"_pk": ("max", F.greatest(F.col("_lg"), F.lit(0.0)))}, keys=keys)
    d = in_chunks(d.withColumn("_win", (F.col(ret) > 0).cast("int")), lambda x, f: x.withColumns({
        "win_rate": f.mean("_win", n), "avg_hold": f.mean(hold, n)}), history=n, keys=keys)
    d = d.withColumn("drawdown", F.exp(F.col("_lg") - F.col("_pk")) - 1.0)
    ready = F.col("bar_no") >= 9
    return d.withColumns({
        "warn_win": ready & (F.lit(bench["win_rate"]) > 0) & (F.col("win_rate") < bench["win_rate"] - 0.10),
        "warn_drawdown": ready & (F.lit(bench["max_drawdown"]) < 0) & (F.col("drawdown") < bench["max_drawdown"] * 1.5),
        "warn_hold": ready & (F.lit(bench["avg_hold"]) > 0) & (F.col("avg_hold") > bench["avg_hold"] * 2.0),
    }).drop("_lg", "_pk", "_win")
