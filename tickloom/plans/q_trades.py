"""Queries: trade logs and aggregates."""
from __future__ import annotations

from pyspark.sql import Window, functions as F

from ..functions.exprs import pair_corr
from ..operators import gates, sequences as seq, trade_log as tl
from ..operators.layout import in_chunks
from ..operators.ranks import exact_quantiles
from ..sources.bars import keep_one
from .catalog import query
from .data import BARS, TRADES, TRADES_CTE, bars, bars_cte, trades

LABELLED = TRADES + """, lab AS (SELECT *, symbol AS label FROM trades UNION ALL SELECT *, 'COMBINED' AS label FROM trades)"""
DD = """, dd AS (SELECT label, min(cum - greatest(pk, 0)) AS max_drawdown FROM (
  SELECT label, cum, max(cum) OVER (PARTITION BY label ORDER BY exit_time, trade_id) AS pk FROM (
    SELECT *, sum(ret) OVER (PARTITION BY label ORDER BY exit_time, trade_id) AS cum FROM lab)) GROUP BY label)"""


def labelled(T):
    return tl.with_total(trades(T))


def log_columns(T):
    return trades(T).select("symbol", "trade_id", "exit_time", "ret", "hold", "driver")


@query("trade_summary", "label:s n_trades:i first_exit:t last_exit:t span_days:d total_return:d mean_return:d std_return:d win_rate:d "
       "sharpe:d sortino:d profit_factor:d avg_hold:d max_drawdown:d", LABELLED + DD + """, m AS (
  SELECT label, count(*) AS n_trades, min(exit_time) AS first_exit, max(exit_time) AS last_exit, date_diff('second', min(exit_time), max(exit_time)) / 86400.0::double AS span_days,
    sum(ret) AS total_return, avg(ret) AS mean_return, stddev_samp(ret) AS std_return, avg((ret > 0)::int) AS win_rate, stddev_samp(CASE WHEN ret < 0 THEN ret END) AS down,
    sum(CASE WHEN ret > 0 THEN ret ELSE 0 END) / -sum(CASE WHEN ret < 0 THEN ret END) AS profit_factor, avg(hold) AS avg_hold FROM lab GROUP BY label)
SELECT m.*, max_drawdown, mean_return / std_return * sqrt(n_trades / (span_days / 365.25)) AS sharpe, mean_return / down * sqrt(n_trades / (span_days / 365.25)) AS sortino
FROM m JOIN dd USING (label)""")
def _(T):
    return tl.summarise(tl.with_total(tl.in_order(log_columns(T))))


@query("trades_by_regime", "label:s regime:i n:i share:d mean_return:d win_rate:d avg_hold:d avg_win:d avg_loss:d payoff:d profit_factor:d", LABELLED + """
SELECT *, n / sum(n) OVER (PARTITION BY label) AS share, avg_win / -avg_loss AS payoff FROM (
  SELECT label, regime, count(*) AS n, avg(ret) AS mean_return, avg((ret > 0)::int) AS win_rate, avg(hold) AS avg_hold, avg(CASE WHEN ret > 0 THEN ret END) AS avg_win,
    avg(CASE WHEN ret < 0 THEN ret END) AS avg_loss, sum(CASE WHEN ret > 0 THEN ret ELSE 0 END) / -sum(CASE WHEN ret < 0 THEN ret END) AS profit_factor FROM lab GROUP BY 1, 2)""")
def _(T):
    return tl.by_regime(labelled(T))


@query("trades_by_strategy", "strategy:s n:i share:d mean_return:d win_rate:d profit_factor:d p01:d p05:d worst:d avg_hold:d avg_hedge_pnl:d avg_hedge_count:d", TRADES + """, s AS (
  SELECT *, CASE WHEN regime = 2 THEN ret / 10 END AS hedge_pnl, CASE WHEN regime <> 1 THEN hold % 3 END AS hedge_count, CASE regime WHEN 1 THEN 'LONG_STRADDLE_R1' WHEN 2 THEN 'GAMMA_SCALP_R2' WHEN 3 THEN 'SHORT_STRADDLE_R3' WHEN 4 THEN 'IRON_CONDOR_R4' ELSE 'LONG_STRADDLE_R1' END AS strategy FROM trades)
SELECT strategy, count(*) AS n, count(*) / (SELECT count(*) FROM s) AS share, avg(ret) AS mean_return, avg((ret > 0)::int) AS win_rate,
  sum(CASE WHEN ret > 0 THEN ret ELSE 0 END) / -sum(CASE WHEN ret < 0 THEN ret END) AS profit_factor, quantile_cont(ret, 0.01) AS p01, quantile_cont(ret, 0.05) AS p05, min(ret) AS worst,
  avg(hold) AS avg_hold, avg(hedge_pnl) AS avg_hedge_pnl, avg(hedge_count) AS avg_hedge_count FROM s GROUP BY strategy""")
def _(T):
    rg = F.col("regime")
    t = trades(T).withColumns({"hedge_pnl": F.when(rg == 2, F.col("ret") / 10), "hedge_count": F.when(rg != 1, F.col("hold") % 3)})
    return tl.by_strategy(t.withColumn("strategy", gates.strategy_of("regime")))


@query("trades_by_driver", "label:s driver:s n:i share_n:d sum_return:d mean_return:d share_abs:d", LABELLED + """
SELECT label, driver, n, n / sum(n) OVER w AS share_n, sum_return, mean_return, a / sum(a) OVER w AS share_abs FROM (
  SELECT label, driver, count(*) AS n, sum(ret) AS sum_return, avg(ret) AS mean_return, sum(abs(ret)) AS a FROM lab GROUP BY 1, 2) WINDOW w AS (PARTITION BY label)""")
def _(T):
    return tl.by_driver(labelled(T))


DRIVER_SQL = "CASE driver WHEN 'A' THEN 'l3_learned' WHEN 'R' THEN 'deadline' ELSE 'house_rule' END"


def driver_named(T):
    d = F.col("driver")
    return trades(T).withColumn("driver", F.when(d == "A", "l3_learned").when(d == "R", "deadline").otherwise("house_rule"))


@query("driver_shares", "driver:s share:d", TRADES + f""", k AS (SELECT unnest([{', '.join(repr(d) for d in gates.DRIVERS)}]) AS driver),
f AS (SELECT {DRIVER_SQL} AS driver, count(*) AS n FROM trades GROUP BY 1)
SELECT coalesce(k.driver, f.driver) AS driver, coalesce(n, 0) / (SELECT count(*) FROM trades) AS share FROM k FULL JOIN f ON k.driver = f.driver""")
def _(T):
    return tl.driver_shares(driver_named(T))


@query("trades_by_reason", "label:s reason:s n:i share:d avg_hold:d p50_hold:d p90_hold:d", LABELLED + """
SELECT *, n / sum(n) OVER (PARTITION BY label) AS share FROM (
  SELECT label, reason, count(*) AS n, avg(hold) AS avg_hold, quantile_cont(hold, 0.5) AS p50_hold, quantile_cont(hold, 0.9) AS p90_hold FROM lab GROUP BY 1, 2)""")
def _(T):
    return tl.by_reason(labelled(T))


@query("holding_histogram", "hold:i n:i", TRADES + " SELECT hold, count(*) AS n FROM trades GROUP BY hold")
def _(T):
    return trades(T).groupBy("hold").agg(F.count(F.lit(1)).alias("n"))


@query("counts_reconciled", "symbol:s raw_n:i kept_n:i skipped_n:i", TRADES + """
SELECT symbol, count(*) AS raw_n, sum((ret > 0.09)::int) AS kept_n, count(*) - sum((ret > 0.09)::int) AS skipped_n FROM trades GROUP BY symbol""")
def _(T):
    t = trades(T)
    return tl.reconcile_counts(t, t.where("ret > 0.09"))


@query("counters_summed", "symbol:s counter:s value:i", TRADES + """, c AS (
  SELECT symbol, unnest(['entries', 'policy_exit_count', 'held_long']) AS counter, unnest([1, (driver = 'A')::int, (hold > 365)::int]) AS value FROM trades)
SELECT symbol, counter, sum(value) AS value FROM c GROUP BY 1, 2 UNION ALL SELECT 'COMBINED', counter, sum(value) FROM c GROUP BY 2""")
def _(T):
    t = trades(T)
    parts = F.array(F.struct(F.lit("entries").alias("counter"), F.lit(1).alias("value")),
                    F.struct(F.lit("policy_exit_count").alias("counter"), (F.col("driver") == "A").cast("int").alias("value")),
                    F.struct(F.lit("held_long").alias("counter"), (F.col("hold") > 365).cast("int").alias("value")))
    return tl.sum_counters(t.select("symbol", F.explode(parts).alias("c")).select("symbol", "c.*"))


@query("exit_engines", "symbol:s engine:s rules:i learned:i other:i", TRADES + """, c AS (
  SELECT symbol, sum((driver = 'A' AND ret > 0.09)::int) AS rules, sum((driver = 'R' AND hold > 2450)::int) AS learned, sum((driver = 'N')::int) AS other FROM trades GROUP BY symbol)
SELECT *, CASE WHEN rules > 0 AND learned = 0 THEN 'synthetic_rules' WHEN rules > 0 THEN 'mixed_synthetic_rules_and_l3' WHEN learned > 0 THEN 'learned_l3'
  WHEN other > 0 THEN 'non_synthetic_non_l3' ELSE 'none' END AS engine FROM c""")
def _(T):
    d = F.col("driver")
    c = trades(T).groupBy("symbol").agg(F.sum(((d == "A") & (F.col("ret") > 0.09)).cast("int")).alias("rules"),
                                        F.sum(((d == "R") & (F.col("hold") > 2450)).cast("int")).alias("learned"), F.sum((d == "N").cast("int")).alias("other"))
    return c.withColumn("engine", tl.exit_engine(F.col("rules"), F.col("learned"), F.col("other")))


@query("probability_summary", "event_type:s n:i mean:d p75:d p90:d p95:d top:d", """
SELECT event_type, count(*) AS n, avg(p) AS mean, quantile_cont(p, 0.75) AS p75, quantile_cont(p, 0.9) AS p90, quantile_cont(p, 0.95) AS p95, max(p) AS top
FROM (SELECT event_type, value / (value + 20) AS p FROM events) GROUP BY event_type""")
def _(T):
    e = T("events").withColumn("p", F.col("value") / (F.col("value") + 20))
    q = exact_quantiles(e, "p", {"p75": 0.75, "p90": 0.9, "p95": 0.95}, ("event_type",))
    return e.groupBy("event_type").agg(F.count("p").alias("n"), F.avg("p").alias("mean"), F.max("p").alias("top")).join(q, "event_type")


@query("daily_pnl", "label:s day:s pnl:d n:i cum_pnl:d", LABELLED + """
SELECT label, strftime(day, '%Y-%m-%d') AS day, pnl, n, sum(pnl) OVER (PARTITION BY label ORDER BY day) AS cum_pnl FROM (
  SELECT label, cast(exit_time AS date) AS day, sum(ret) AS pnl, count(*) AS n FROM lab GROUP BY 1, 2)""")
def _(T):
    return tl.daily_pnl(labelled(T))


@query("worst_days", "day:s pnl:d", TRADES + """
SELECT strftime(day, '%Y-%m-%d') AS day, pnl FROM (SELECT cast(exit_time AS date) AS day, round(sum(ret), 6) AS pnl FROM trades GROUP BY 1) ORDER BY pnl, day LIMIT 20""")
def _(T):
    d = trades(T).groupBy(F.to_date("exit_time").alias("day")).agg(F.round(F.sum("ret"), 6).alias("pnl"))
    return d.orderBy("pnl", "day").limit(20)


@query("monthly_stability", "month:s n:i active:d corr_all:d corr_active:d", TRADES + """
SELECT strftime(exit_time, '%Y-%m') AS month, count(*) AS n, avg((abs(ret) > 0.01)::int) AS active, CASE WHEN count(*) >= 10 AND stddev_pop(ret) > 1e-12 AND stddev_pop(hold) > 1e-12 THEN corr(ret, hold) END AS corr_all,
  CASE WHEN sum((regime <> 1)::int) >= 10 AND stddev_pop(ret) FILTER (regime <> 1) > 1e-12 AND stddev_pop(hold) FILTER (regime <> 1) > 1e-12 THEN corr(ret, hold) FILTER (regime <> 1) END AS corr_active
FROM trades GROUP BY 1""")
def _(T):
    act = F.col("regime") != 1

    def guarded(cond):
        r, h = F.when(cond, F.col("ret")), F.when(cond, F.col("hold").cast("double"))
        return F.when((F.count(r) >= 10) & (F.stddev_pop(r) > 1e-12) & (F.stddev_pop(h) > 1e-12), pair_corr(r, h))
    return trades(T).groupBy(F.date_format("exit_time", "yyyy-MM").alias("month")).agg(
        F.count(F.lit(1)).alias("n"), F.avg((F.abs("ret") > 0.01).cast("int")).alias("active"),
        guarded(F.lit(True)).alias("corr_all"), guarded(act).alias("corr_active"))


@query("cross_session_moves", "symbol:s total:i crossing:i cross_pct:d cross_mean:d intra_mean:d cross_std:d intra_std:d", BARS + """, g AS (
  SELECT *, sum(brk) OVER (PARTITION BY symbol ORDER BY bar_no) AS sid FROM (
    SELECT *, coalesce((t - lag(t) OVER (PARTITION BY symbol ORDER BY bar_no) > INTERVAL 1 HOUR)::int, 0) AS brk FROM bars)),
f AS (SELECT symbol, sid, lead(sid, 10) OVER w AS sid2, abs(lead(close, 10) OVER w / (abs(close) + 1e-9) - 1) * 10000 AS mv FROM g WINDOW w AS (PARTITION BY symbol ORDER BY bar_no))
SELECT symbol, count(*) AS total, sum((sid <> sid2)::int) AS crossing, 100.0 * sum((sid <> sid2)::int) / count(*) AS cross_pct, avg(mv) FILTER (sid <> sid2) AS cross_mean,
  avg(mv) FILTER (sid = sid2) AS intra_mean, stddev_pop(mv) FILTER (sid <> sid2) AS cross_std, stddev_pop(mv) FILTER (sid = sid2) AS intra_std FROM f WHERE sid2 IS NOT NULL GROUP BY symbol""")
def _(T):
    from ..operators.sessions import mark_sessions
    d = mark_sessions(bars(T), gap_hours=1.0)
    d = in_chunks(d, lambda x, f: x.withColumns({
        "sid2": f.lead("session_id", 10), "mv": F.abs(f.lead("close", 10) / (F.abs("close") + 1e-9) - 1.0) * 10000.0}), history=0, lookahead=10)
    x = F.col("session_id") != F.col("sid2")
    mv = F.col("mv")
    return d.where("sid2 is not null").groupBy("symbol").agg(
        F.count(F.lit(1)).alias("total"), F.sum(x.cast("int")).alias("crossing"), (100.0 * F.avg(x.cast("int"))).alias("cross_pct"),
        F.avg(F.when(x, mv)).alias("cross_mean"), F.avg(F.when(~x, mv)).alias("intra_mean"),
        F.stddev_pop(F.when(x, mv)).alias("cross_std"), F.stddev_pop(F.when(~x, mv)).alias("intra_std"))


@query("window_pnl", "symbol:s window_no:i n:i pnl_pct:d sharpe:d", TRADES + """
SELECT symbol, floor(date_diff('day', (SELECT min(cast(exit_time AS date)) FROM trades), cast(exit_time AS date)) / 5) AS window_no, count(*) AS n, 100 * sum(ret) AS pnl_pct,
  CASE WHEN count(*) >= 2 AND stddev_samp(ret) > 1e-12 THEN avg(ret) / stddev_samp(ret) * sqrt(count(*)) END AS sharpe FROM trades GROUP BY 1, 2""")
def _(T):
    t = trades(T)
    first = t.agg(F.min(F.to_date("exit_time"))).scalar()
    sd = F.stddev_samp("ret")
    return t.groupBy("symbol", tl.calendar_windows(t, "exit_time", 5, first).alias("window_no")).agg(
        F.count(F.lit(1)).alias("n"), (100 * F.sum("ret")).alias("pnl_pct"),
        F.when((F.count(F.lit(1)) >= 2) & (sd > 1e-12), F.avg("ret") / sd * F.sqrt(F.count(F.lit(1)))).alias("sharpe"))


@query("weighted_stats", "symbol:s w_mean:d w_q10:d w_q50:d", TRADES + """, w AS (
  SELECT symbol, ret, sum(greatest(hold - 30, 0)) AS w, sum(sum(greatest(hold - 30, 0))) OVER (PARTITION BY symbol ORDER BY ret) AS cw, sum(sum(greatest(hold - 30, 0))) OVER (PARTITION BY symbol) AS tw FROM trades GROUP BY 1, 2)
SELECT symbol, sum(ret * w) / sum(w) AS w_mean, min(ret) FILTER (cw / tw >= 0.1) AS w_q10, min(ret) FILTER (cw / tw >= 0.5) AS w_q50 FROM w GROUP BY symbol""")
def _(T):
    from ..operators.metrics import weighted_quantiles
    t = trades(T).withColumn("w", F.greatest(F.col("hold") - 30, F.lit(0)).cast("double"))
    m = t.groupBy("symbol").agg((F.sum(F.col("ret") * F.col("w")) / F.sum("w")).alias("w_mean"))
    return m.join(weighted_quantiles(t, "ret", "w", {"w_q10": 0.1, "w_q50": 0.5}, ("symbol",)), "symbol")


@query("class_distribution", "cls:i n:i share:d skewed:b", TRADES + """
SELECT regime AS cls, count(*) AS n, count(*) / (SELECT count(*) FROM trades) AS share, count(*) / (SELECT count(*) FROM trades) > 0.95 OR count(*) / (SELECT count(*) FROM trades) < 0.01 AS skewed FROM trades GROUP BY regime""")
def _(T):
    t = trades(T)
    share = F.count(F.lit(1)) / t.agg(F.count(F.lit(1))).scalar()
    return t.groupBy(F.col("regime").alias("cls")).agg(F.count(F.lit(1)).alias("n"), share.alias("share")).withColumn(
        "skewed", (F.col("share") > 0.95) | (F.col("share") < 0.01))


@query("value_summary", "n:i mean:d std:d lo:d hi:d p01:d p05:d p25:d p50:d p75:d p95:d p99:d distinct_n:i", """
SELECT count(value) AS n, avg(value) AS mean, stddev_pop(value) AS std, min(value) AS lo, max(value) AS hi, quantile_cont(value, 0.01) AS p01, quantile_cont(value, 0.05) AS p05, quantile_cont(value, 0.25) AS p25,
  quantile_cont(value, 0.5) AS p50, quantile_cont(value, 0.75) AS p75, quantile_cont(value, 0.95) AS p95, quantile_cont(value, 0.99) AS p99, count(DISTINCT round(value, 6)) AS distinct_n FROM events""")
def _(T):
    e = T("events")
    q = exact_quantiles(e.withColumn("k", F.lit(1)), "value", {f"p{int(p * 100):02d}": p for p in (.01, .05, .25, .5, .75, .95, .99)}, ("k",))
    m = e.agg(F.count("value").alias("n"), F.avg("value").alias("mean"), F.stddev_pop("value").alias("std"), F.min("value").alias("lo"),
              F.max("value").alias("hi"), F.count_distinct(F.round("value", 6)).alias("distinct_n")).withColumn("k", F.lit(1))
    return m.join(q, "k")


@query("transition_matrix", "symbol:s a:i b:i p:d", BARS + """, s AS (SELECT symbol, bar_no, CASE WHEN volume > 1 THEN least(cast(floor(close / 20) AS int), 5) END AS st FROM bars),
p AS (SELECT symbol, lag(st) OVER (PARTITION BY symbol ORDER BY bar_no) AS a, st AS b FROM s),
g AS (SELECT DISTINCT symbol, x.a, y.b FROM bars, (SELECT unnest(range(6)) AS a) x, (SELECT unnest(range(6)) AS b) y),
n AS (SELECT symbol, a, b, count(*) AS n FROM p WHERE a IS NOT NULL AND b IS NOT NULL GROUP BY 1, 2, 3)
SELECT g.symbol, g.a, g.b, (coalesce(n, 0) + 1) / sum(coalesce(n, 0) + 1) OVER (PARTITION BY g.symbol, g.a) AS p FROM g LEFT JOIN n ON g.symbol = n.symbol AND g.a = n.a AND g.b = n.b""")
def _(T):
    from ..operators.states import transition_matrix
    d = bars(T).withColumn("st", F.when(F.col("volume") > 1, F.least(F.floor(F.col("close") / 20), F.lit(5)).cast("int")))
    return transition_matrix(d, "st", 6)


SIG = """sig AS (SELECT *, CASE WHEN volume >= 5 THEN CASE WHEN close > open THEN 1 ELSE -1 END ELSE 0 END AS s FROM bars),
hold AS (SELECT *, coalesce(last_value(nullif(s, 0) IGNORE NULLS) OVER (PARTITION BY symbol ORDER BY bar_no ROWS UNBOUNDED PRECEDING), 0) AS h,
  coalesce(last_value(nullif(s, 0) IGNORE NULLS) OVER (PARTITION BY symbol, cast(t AS date) ORDER BY bar_no ROWS UNBOUNDED PRECEDING), 0) AS hd FROM sig),
pos AS (SELECT *, coalesce(lag(h) OVER (PARTITION BY symbol ORDER BY bar_no), 0) AS position, coalesce(lag(hd) OVER (PARTITION BY symbol, cast(t AS date) ORDER BY bar_no), 0) AS intraday,
  lead(open) OVER (PARTITION BY symbol ORDER BY bar_no) AS nx, lead(open) OVER (PARTITION BY symbol, cast(t AS date) ORDER BY bar_no) AS nxd FROM hold),
rets AS (SELECT *, position * (coalesce(nx, close) / nullif(open, 0) - 1) * 0.01 AS r, intraday * (coalesce(nxd, close) / nullif(open, 0) - 1) * 0.01 AS ri FROM pos)"""


def positioned(T):
    s = F.when(F.col("volume") >= 5, F.when(F.col("close") > F.col("open"), 1).otherwise(-1)).otherwise(0)
    return seq.positions(bars(T).withColumn("sig", s), "sig")


def strategy_returns(T):
    d = tl.bar_returns(positioned(T), "position", "r")
    d = tl.bar_returns(d, "intraday", "ri", intraday=True)
    return d.withColumns({"r": F.col("r") * 0.01, "ri": F.col("ri") * 0.01})


@query("strategy_bar_returns", "symbol:s bar_no:i position:i intraday:i r:d ri:d", BARS + ", " + SIG + " SELECT * FROM rets")
def _(T):
    return strategy_returns(T)


@query("trades_from_positions", "symbol:s entry_bar:i side:i entry_price:d exit_price:d bars_held:i trade_return:d", BARS + ", " + SIG + """,
c AS (SELECT *, (position <> coalesce(lag(position) OVER (PARTITION BY symbol ORDER BY bar_no), 0) OR bar_no = 0)::int AS chg FROM pos),
i AS (SELECT *, sum(chg) OVER (PARTITION BY symbol ORDER BY bar_no) AS isl FROM c)
SELECT symbol, min(bar_no) AS entry_bar, min(position) AS side, first(open ORDER BY bar_no) AS entry_price, last(coalesce(nx, close) ORDER BY bar_no) AS exit_price, count(*) AS bars_held,
  min(position) * (last(coalesce(nx, close) ORDER BY bar_no) / nullif(first(open ORDER BY bar_no), 0) - 1) AS trade_return FROM i WHERE position <> 0 GROUP BY symbol, isl""")
def _(T):
    return tl.trades_from_positions(positioned(T), "position")


EQUITY = """SELECT {k}, count(*) AS periods, exp(sum(ln(1 + {r}))) - 1 AS total_return, exp(sum(ln(1 + {r})) * 98280 / count(*)) AS annual_growth,
  sqrt(98280) * avg({r}) / nullif(stddev_pop({r}), 0) AS sharpe, min(exp(lg - pk) - 1) AS max_drawdown FROM (
  SELECT *, max(lg) OVER (PARTITION BY {k} ORDER BY {o}) AS pk FROM (SELECT *, sum(ln(1 + {r})) OVER (PARTITION BY {k} ORDER BY {o}) AS lg FROM {s})) GROUP BY {k}"""


@query("equity_metrics", "symbol:s periods:i total_return:d annual_growth:d sharpe:d max_drawdown:d",
       BARS + ", " + SIG + ", tiny AS (SELECT symbol, bar_no, r * 0.001 AS q FROM rets) " + EQUITY.format(k="symbol", r="q", o="bar_no", s="tiny"))
def _(T):
    d = strategy_returns(T).withColumn("q", F.col("r") * 0.001)
    return tl.equity_metrics(d, ["symbol"], "q")


@query("equal_weight_combined", "k:i periods:i total_return:d annual_growth:d sharpe:d max_drawdown:d",
       BARS + ", " + SIG + """, pf AS (SELECT 1 AS k, t, sum(r) * 0.01 / (SELECT count(DISTINCT symbol) FROM rets) AS q FROM rets GROUP BY t) """ + EQUITY.format(k="k", r="q", o="t", s="pf"))
def _(T):
    from ..operators.layout import number_rows
    d = strategy_returns(T)
    n = d.agg(F.count_distinct("symbol")).scalar()
    p = d.groupBy("t").agg((F.sum("r") * 0.01 / n).alias("q")).withColumn("k", F.lit(1))
    return tl.equity_metrics(number_rows(p, ("k",), ("t",)), ["k"], "q")


@query("ranking", "label:s rank_mean:i rank_win:i best:b", LABELLED + """, m AS (SELECT label, round(avg(ret), 9) AS mu, round(avg((ret > 0)::int), 9) AS wr FROM lab GROUP BY label)
SELECT label, row_number() OVER (ORDER BY mu DESC, label) AS rank_mean, row_number() OVER (ORDER BY wr DESC, label) AS rank_win, row_number() OVER (ORDER BY mu DESC, label) = 1 AS best FROM m""")
def _(T):
    m = labelled(T).groupBy("label").agg(F.round(F.avg("ret"), 9).alias("mu"), F.round(F.avg((F.col("ret") > 0).cast("int")), 9).alias("wr"))
    return m.withColumns({"rank_mean": F.row_number().over(Window.orderBy(F.desc("mu"), "label")),
                          "rank_win": F.row_number().over(Window.orderBy(F.desc("wr"), "label"))}).withColumn("best", F.col("rank_mean") == 1)


@query("rates_by_exit", "symbol:s take_profit:d stop:d time_exit:d long_hold:d", TRADES + """
SELECT symbol, avg((driver = 'A')::int) AS take_profit, avg((driver = 'R')::int) AS stop, avg((driver = 'N')::int) AS time_exit, avg((hold > 365)::int) AS long_hold FROM trades GROUP BY symbol""")
def _(T):
    d = F.col("driver")
    return trades(T).groupBy("symbol").agg(*[F.avg(x.cast("int")).alias(n) for n, x in (
        ("take_profit", d == "A"), ("stop", d == "R"), ("time_exit", d == "N"), ("long_hold", F.col("hold") > 365))])


@query("cumulative_on_grid", "symbol:s t:t cum_return:d", TRADES + """, g AS (SELECT DISTINCT symbol, entry_time AS t FROM trades),
c AS (SELECT symbol, exit_time, sum(sum(ret)) OVER (PARTITION BY symbol ORDER BY exit_time) AS cr FROM trades GROUP BY 1, 2)
SELECT g.symbol, g.t, coalesce(c.cr, 0) AS cum_return FROM g ASOF LEFT JOIN c ON g.symbol = c.symbol AND g.t >= c.exit_time""")
def _(T):
    t = trades(T)
    grid = t.select("symbol", F.col("entry_time").alias("t")).distinct()
    return tl.cumulative_on_grid(grid, t)


@query("worst_drawdown_window", "label:s depth:d peak_at:i trough_at:i", LABELLED + """, c AS (
  SELECT label, row_number() OVER w - 1 AS i, round(sum(ret) OVER w, 9) AS cum FROM lab WINDOW w AS (PARTITION BY label ORDER BY exit_time, trade_id)),
p AS (SELECT *, max(cum) OVER (PARTITION BY label ORDER BY i) AS pk FROM c),
q AS (SELECT p.*, first_value(CASE WHEN cum = pk THEN i END IGNORE NULLS) OVER (PARTITION BY label, pk ORDER BY i) AS pi, round(cum - pk, 9) AS dd FROM p)
SELECT label, min(dd) AS depth, first(pi ORDER BY dd, i) AS peak_at, first(i ORDER BY dd, i) AS trough_at FROM q GROUP BY label""")
def _(T):
    return tl.worst_drawdown_window(tl.with_total(tl.in_order(log_columns(T))))


@query("stitched_folds", "fold:i n:i total:d", TRADES + """
SELECT fold, count(*) AS n, sum(ret) AS total FROM (SELECT CASE WHEN exit_time < TIMESTAMP '1999-01-01' THEN 1 ELSE 2 END AS fold, ret FROM trades) GROUP BY fold""")
def _(T):
    t = trades(T)
    a = t.where(F.col("exit_time") < F.lit("1999-01-01").cast("timestamp_ntz")).withColumn("fold", F.lit(1))
    b = t.where(F.col("exit_time") >= F.lit("1999-01-01").cast("timestamp_ntz")).withColumn("fold", F.lit(2))
    return a.unionByName(b).groupBy("fold").agg(F.count(F.lit(1)).alias("n"), F.sum("ret").alias("total"))


@query("asymmetry_guard", "a:s b:s mean_gap:d sharpe_gap:d win_gap:d reasons:s flagged:b", LABELLED + """, m AS (
  SELECT label, avg(ret) AS mu, avg(ret) / stddev_samp(ret) * sqrt(count(*) / (date_diff('second', min(exit_time), max(exit_time)) / 86400.0 / 365.25)) AS sh, avg((ret > 0)::int) AS wr FROM trades JOIN (SELECT DISTINCT label FROM lab) l ON l.label = trades.symbol GROUP BY label),
g AS (SELECT x.label AS a, y.label AS b, x.mu - y.mu AS mean_gap, x.sh - y.sh AS sharpe_gap, x.wr - y.wr AS win_gap FROM m x, m y WHERE x.label = 'S1' AND y.label = 'S2'),
r AS (SELECT *, list_filter([CASE WHEN abs(mean_gap) > 0.00012 THEN 'mean_return_per_trade_gap_exceeds_threshold' END, CASE WHEN abs(sharpe_gap) > 0.8 THEN 'sharpe_gap_exceeds_threshold' END,
  CASE WHEN abs(win_gap) > 0.08 THEN 'win_rate_gap_exceeds_threshold' END], lambda x: x IS NOT NULL) AS rs FROM g)
SELECT *, array_to_string(rs, ',') AS reasons, len(rs) > 0 AS flagged FROM r""")
def _(T):
    m = tl.summarise(tl.in_order(log_columns(T)).withColumn("label", F.col("symbol"))).select("label", "mean_return", "sharpe", "win_rate")
    w = m.where(F.col("label").isin("S1", "S2")).groupBy().pivot("label", ["S1", "S2"]).agg(
        F.first("mean_return").alias("mu"), F.first("sharpe").alias("sh"), F.first("win_rate").alias("wr"))
    g = w.select(F.lit("S1").alias("a"), F.lit("S2").alias("b"), (F.col("S1_mu") - F.col("S2_mu")).alias("mean_gap"),
                 (F.col("S1_sh") - F.col("S2_sh")).alias("sharpe_gap"), (F.col("S1_wr") - F.col("S2_wr")).alias("win_gap"))
    rs = F.array_compact(F.array(
        F.when(F.abs("mean_gap") > 0.00012, "mean_return_per_trade_gap_exceeds_threshold"),
        F.when(F.abs("sharpe_gap") > 0.8, "sharpe_gap_exceeds_threshold"), F.when(F.abs("win_gap") > 0.08, "win_rate_gap_exceeds_threshold")))
    return g.withColumn("rs", rs).withColumns({"reasons": F.array_join("rs", ","), "flagged": F.size("rs") > 0})


@query("metric_gate", "label:s passed:i failed:s escalate:b", LABELLED + DD + """, m AS (
  SELECT label, avg(ret) / stddev_samp(ret) AS sh, sum(CASE WHEN ret > 0 THEN ret ELSE 0 END) / -sum(CASE WHEN ret < 0 THEN ret END) AS pf, avg(ret) AS mu, avg((driver = 'A')::int) AS ps, min(max_drawdown) AS dd FROM lab JOIN dd USING (label) GROUP BY label),
k AS (SELECT label, [CASE WHEN sh >= 0.25 THEN NULL ELSE 'sharpe' END, CASE WHEN pf >= 2.0 THEN NULL ELSE 'profit_factor' END, CASE WHEN mu >= 2e-5 THEN NULL ELSE 'mean_return' END,
  CASE WHEN ps >= 0.2 THEN NULL ELSE 'policy_share' END, CASE WHEN dd >= -1.5 THEN NULL ELSE 'drawdown' END] AS f FROM m)
SELECT label, 5 - len(list_filter(f, lambda x: x IS NOT NULL)) AS passed, array_to_string(list_filter(f, lambda x: x IS NOT NULL), ',') AS failed, 5 - len(list_filter(f, lambda x: x IS NOT NULL)) <= 3 AS escalate FROM k""")
def _(T):
    from ..operators.metrics import metric_gate
    t = tl.with_total(tl.in_order(log_columns(T)))
    m = tl.summarise(t).join(t.groupBy("label").agg(F.avg((F.col("driver") == "A").cast("int")).alias("policy_share")), "label")
    m = m.withColumn("plain_sharpe", F.col("mean_return") / F.col("std_return"))
    return metric_gate(m, {"sharpe": F.col("plain_sharpe") >= 0.25, "profit_factor": F.col("profit_factor") >= 2.0,
                           "mean_return": F.col("mean_return") >= 2e-5, "policy_share": F.col("policy_share") >= 0.2,
                           "drawdown": F.col("max_drawdown") >= -1.5})


@query("live_performance", "symbol:s bar_no:i win_rate:d avg_hold:d drawdown:d warn_win:b warn_drawdown:b warn_hold:b", TRADES + """, n AS (
  SELECT *, row_number() OVER w - 1 AS bar_no, avg((ret > 0)::int) OVER l AS win_rate, avg(hold) OVER l AS avg_hold, sum(ln(1 + ret)) OVER w AS lg FROM trades
  WINDOW w AS (PARTITION BY symbol ORDER BY exit_time, trade_id), l AS (PARTITION BY symbol ORDER BY exit_time, trade_id ROWS 49 PRECEDING)),
p AS (SELECT *, exp(lg - max(greatest(lg, 0)) OVER (PARTITION BY symbol ORDER BY bar_no)) - 1 AS drawdown FROM n)
SELECT *, bar_no >= 9 AND win_rate < 0.6 - 0.1 AS warn_win, bar_no >= 9 AND drawdown < -0.1 * 1.5 AS warn_drawdown, bar_no >= 9 AND avg_hold > 2.0 * 400 AS warn_hold FROM p""")
def _(T):
    return tl.live_check(trades(T), {"win_rate": 0.6, "max_drawdown": -0.1, "avg_hold": 400.0})


@query("dedupe_first_last", "user_id:i first_id:i last_id:i", """
SELECT user_id, first(event_id ORDER BY ts, event_id) AS first_id, last(event_id ORDER BY ts, event_id) AS last_id FROM events GROUP BY user_id""")
def _(T):
    e = T("events").select("user_id", "event_id", "ts")
    first = keep_one(e, ["user_id"], [F.col("ts"), F.col("event_id")]).select("user_id", F.col("event_id").alias("first_id"))
    from ..sources.bars import keep_last
    last = keep_last(e.withColumn("at", F.struct("ts", "event_id")), ["user_id"], "at").select("user_id", F.col("event_id").alias("last_id"))
    return first.join(last, "user_id")
