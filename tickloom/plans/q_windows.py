"""Queries: window functions, recurrences and islands on bars."""
from __future__ import annotations

from pyspark.sql import Window, functions as F

from ..functions.exprs import price_source
from ..operators import ewm, indicators as ind, ranks, rolling, sequences as seq, sessions
from ..operators.layout import in_chunks, number_rows, running
from ..operators.order_stats import Order, order_stats
from .catalog import query
from .data import BARS, BARS_REC, bars, bars_cte

W = "PARTITION BY symbol ORDER BY bar_no ROWS"


@query("rolling_basic", "symbol:s t:t mn:d mx:d sm:d av:d sd:d sdp:d", BARS + f"""
SELECT symbol, t, CASE WHEN count(close) OVER w >= 5 THEN min(low) OVER w END AS mn, CASE WHEN count(close) OVER w >= 5 THEN max(high) OVER w END AS mx,
  CASE WHEN count(close) OVER w >= 3 THEN sum(volume) OVER w END AS sm, CASE WHEN count(close) OVER w >= 20 THEN avg(close) OVER w END AS av,
  CASE WHEN count(close) OVER w >= 5 THEN stddev_samp(close) OVER w END AS sd, CASE WHEN count(close) OVER w >= 5 THEN stddev_pop(close) OVER w END AS sdp
FROM bars WINDOW w AS ({W} 19 PRECEDING)""")
def _(T):
    return in_chunks(bars(T), lambda d, f: d.withColumns({
        "mn": f.min("low", 20, 5), "mx": f.max("high", 20, 5), "sm": f.sum("volume", 20, 3), "av": f.mean("close", 20, 20),
        "sd": f.std("close", 20, 5), "sdp": f.agg(F.stddev_pop, "close", 20, 5)}), history=20)


@query("rolling_quantiles", "symbol:s t:t med:d q99:d q25:d", BARS + f"""
SELECT symbol, t, CASE WHEN count(close) OVER w >= 10 THEN quantile_cont(close, 0.5) OVER w END AS med, quantile_cont(close, 0.99) OVER w AS q99,
  quantile_cont(close, 0.25) OVER w AS q25 FROM bars WINDOW w AS ({W} 59 PRECEDING)""")
def _(T):
    specs = {"med": Order("close", 60, "quantile", 10, 0.5), "q99": Order("close", 60, "quantile", q=0.99), "q25": Order("close", 60, "quantile", q=0.25)}
    return in_chunks(bars(T), lambda d, f: order_stats(d, f, specs), history=60)


@query("rolling_moments", "symbol:s t:t sk:d ku:d", BARS + f"""
SELECT symbol, t, CASE WHEN bar_no >= 4 THEN skewness(close) OVER w END AS sk, CASE WHEN bar_no >= 4 THEN kurtosis(close) OVER w END AS ku
FROM bars WINDOW w AS ({W} 19 PRECEDING)""")
def _(T):
    return in_chunks(bars(T), lambda d, f: d.withColumns({
        "sk": rolling.skew(f, "close", 20, 5), "ku": rolling.kurt(f, "close", 20, 5)}), history=20)


@query("rolling_corr_beta", "symbol:s t:t co:d be:d", BARS + f"""
SELECT symbol, t, CASE WHEN bar_no >= 4 AND stddev_pop(volume) OVER w > 0 THEN corr(close, volume) OVER w END AS co,
  CASE WHEN bar_no >= 4 AND stddev_pop(high) OVER w > 0 THEN covar_samp(close, high) OVER w / var_samp(high) OVER w END AS be
FROM bars WINDOW w AS ({W} 19 PRECEDING)""")
def _(T):
    return in_chunks(bars(T), lambda d, f: d.withColumns({
        "co": rolling.corr(f, "close", "volume", 20, 5), "be": rolling.beta(f, "close", "high", 20, 5)}), history=20)


@query("rolling_rank", "symbol:s t:t share:d avg_rank:d", BARS + f""", w AS (
  SELECT *, list(close) OVER ({W} 39 PRECEDING) AS vs FROM bars)
SELECT symbol, t, CASE WHEN len(vs) >= 40 THEN len(list_filter(vs, lambda v: v <= close)) / len(vs) END AS share,
  CASE WHEN len(vs) >= 10 THEN (len(list_filter(vs, lambda v: v < close)) + (len(list_filter(vs, lambda v: v = close)) + 1) / 2.0) / len(vs) END AS avg_rank FROM w""")
def _(T):
    return in_chunks(bars(T), lambda d, f: order_stats(d, f, {"share": Order("close", 40, "share", 40), "avg_rank": Order("close", 40, "rank", 10)}), history=40)


@query("rolling_linreg", "symbol:s t:t lr:d lr3:d zl:d", BARS + f""", l AS (
  SELECT symbol, t, bar_no, CASE WHEN count(*) OVER w >= 32 THEN regr_intercept(p, bar_no) OVER w + regr_slope(p, bar_no) OVER w * bar_no END AS lr,
    CASE WHEN count(*) OVER w >= 32 THEN regr_intercept(p, bar_no) OVER w + regr_slope(p, bar_no) OVER w * (bar_no - 3) END AS lr3
  FROM (SELECT *, (high + low + close) / 3 AS p FROM bars) WINDOW w AS ({W} 31 PRECEDING))
SELECT symbol, t, lr, lr3, CASE WHEN count(lr) OVER w >= 32 THEN 2 * lr - (regr_intercept(lr, bar_no) OVER w + regr_slope(lr, bar_no) OVER w * bar_no) END AS zl
FROM l WINDOW w AS ({W} 31 PRECEDING)""")
def _(T):
    def build(d, f):
        d = d.withColumn("p", price_source("hlc3"))
        d = rolling.linreg(d, f, "p", 32, "lr")
        d = rolling.linreg(d, f, "p", 32, "lr3", offset=3)
        return rolling.zlsma(d, f, "p", 32, "zl")
    return in_chunks(bars(T), build, history=64)


@query("expanding_stats", "symbol:s t:t mean_all:d sd_all:d hi_all:d lo_all:d mean_day:d", BARS + """
SELECT symbol, t, avg(close) OVER w AS mean_all, stddev_samp(close) OVER w AS sd_all, max(high) OVER w AS hi_all, min(low) OVER w AS lo_all,
  avg(volume) OVER (PARTITION BY symbol, cast(t AS date) ORDER BY t) AS mean_day FROM bars WINDOW w AS (PARTITION BY symbol ORDER BY bar_no)""")
def _(T):
    d = seq.expanding(bars(T), "close", mean="mean_all", std="sd_all")
    d = running(d, {"hi_all": ("max", F.col("high")), "lo_all": ("min", F.col("low"))})
    day = Window.partitionBy("symbol", F.to_date("t")).orderBy("t").rowsBetween(Window.unboundedPreceding, 0)
    return d.withColumn("mean_day", F.avg("volume").over(day))


@query("shift_diff_pct", "symbol:s t:t prev:d next2:d diff5:d pct1:d pct30:d", BARS + """
SELECT symbol, t, lag(close) OVER w AS prev, lead(close, 2) OVER w AS next2, close - lag(close, 5) OVER w AS diff5,
  close / lag(close) OVER w - 1 AS pct1, (close - lag(close, 30) OVER w) / lag(close, 30) OVER w AS pct30
FROM bars WINDOW w AS (PARTITION BY symbol ORDER BY bar_no)""")
def _(T):
    return in_chunks(bars(T), lambda d, f: d.withColumns({
        "prev": f.lag("close"), "next2": f.lead("close", 2), "diff5": f.diff("close", 5), "pct1": f.pct("close"),
        "pct30": f.pct("close", 30)}), history=30, lookahead=2)


@query("cumulative_frames", "symbol:s t:t csum:d peak:d trough:d best_left:d worst_left:d", BARS + """
SELECT symbol, t, sum(volume) OVER w AS csum, max(close) OVER w AS peak, min(close) OVER w AS trough, max(close) OVER r AS best_left,
  min(close) OVER r AS worst_left FROM bars WINDOW w AS (PARTITION BY symbol ORDER BY bar_no), r AS (PARTITION BY symbol ORDER BY bar_no DESC)""")
def _(T):
    d = running(bars(T), {"csum": ("sum", F.col("volume")), "peak": ("max", F.col("close")), "trough": ("min", F.col("close"))})
    return running(d, {"best_left": ("max", F.col("close")), "worst_left": ("min", F.col("close"))}, forward=True)


@query("fills", "symbol:s t:t forward:d back:d limited:d", BARS + f""", g AS (SELECT *, CASE WHEN volume >= 5 THEN close END AS x FROM bars)
SELECT symbol, t, last_value(x IGNORE NULLS) OVER (PARTITION BY symbol ORDER BY bar_no ROWS UNBOUNDED PRECEDING) AS forward,
  first_value(x IGNORE NULLS) OVER (PARTITION BY symbol ORDER BY bar_no ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS back,
  last_value(x IGNORE NULLS) OVER ({W} 5 PRECEDING) AS limited FROM g""")
def _(T):
    x = F.when(F.col("volume") >= 5, F.col("close"))
    d = running(bars(T), {"forward": ("last", x)})
    d = running(d, {"back": ("first", x)}, forward=True)
    return in_chunks(d, lambda v, f: v.withColumn("limited", F.last(x, ignorenulls=True).over(f.rows(-5, 0))), history=6)


@query("day_first_last", "symbol:s t:t day_open:d day_last:d is_first:i is_last:i", BARS + """
SELECT symbol, t, first(open ORDER BY t) OVER d AS day_open, last(close ORDER BY t) OVER d AS day_last,
  (t = min(t) OVER d)::int AS is_first, (t = max(t) OVER d)::int AS is_last FROM bars WINDOW d AS (PARTITION BY symbol, cast(t AS date))""")
def _(T):
    day = Window.partitionBy("symbol", F.to_date("t"))
    return bars(T).withColumns({
        "day_open": F.min_by("open", "t").over(day), "day_last": F.max_by("close", "t").over(day),
        "is_first": (F.col("t") == F.min("t").over(day)).cast("int"), "is_last": (F.col("t") == F.max("t").over(day)).cast("int")})


@query("global_rank_pct", "event_id:i pct:d", """
SELECT event_id, (rank() OVER (ORDER BY v) + (count(*) OVER (PARTITION BY v) - 1) / 2.0) / count(*) OVER () AS pct
FROM (SELECT event_id, round(value, 1) AS v FROM events)""")
def _(T):
    e = T("events").select("event_id", F.round("value", 1).alias("v"))
    return ranks.average_rank(e, "v", "r").withColumn("pct", F.col("r") / F.col("r_of"))


@query("global_row_numbers", "event_id:i pos:i", "SELECT event_id, row_number() OVER (ORDER BY round(value, 0), event_id) - 1 AS pos FROM events")
def _(T):
    return ranks.order_position(T("events").select("event_id", F.round("value", 0).alias("v")), "v", "event_id")


@query("centered_pivots", "symbol:s t:t pivot_high:i pivot_low:i", BARS + f"""
SELECT symbol, t, (count(*) OVER w = 11 AND high = max(high) OVER w)::int AS pivot_high, (count(*) OVER w = 11 AND low = min(low) OVER w)::int AS pivot_low
FROM bars WINDOW w AS ({W} BETWEEN 5 PRECEDING AND 5 FOLLOWING)""")
def _(T):
    return in_chunks(bars(T), lambda d, f: ind.centered_pivots(d, f, 5), history=5, lookahead=5)


@query("quintile_report", "bucket:i n:i mean_x:d mean_y:d same_sign:d", """
WITH e AS (SELECT quantile_cont(value, 0.2) AS a, quantile_cont(value, 0.4) AS b, quantile_cont(value, 0.6) AS c, quantile_cont(value, 0.8) AS d FROM events)
SELECT (value > a)::int + (value > b)::int + (value > c)::int + (value > d)::int AS bucket, count(*) AS n, avg(value) AS mean_x,
  avg(user_id - 75) AS mean_y, avg((sign(value - 30) = sign(user_id - 75))::int) AS same_sign FROM events, e GROUP BY 1""")
def _(T):
    e = T("events").withColumns({"x": F.col("value") - 30, "y": F.col("user_id") - 75})
    b = ranks.fitted_buckets(e, "value", 5)
    return b.groupBy("bucket").agg(F.count(F.lit(1)).alias("n"), F.avg("value").alias("mean_x"), F.avg("y").alias("mean_y"),
                                   F.avg((F.signum("x") == F.signum("y")).cast("int")).alias("same_sign"))


def scan_sql(source: str, init: dict[str, str], step: dict[str, str], name: str = "scan", src: str = "src") -> str:
    """Recursive CTE over the rows of `src`; p is the row before, r the row."""
    return f"""{source}, {name} AS (
  SELECT r.symbol, r.bar_no, {', '.join(f'{v} AS {k}' for k, v in init.items())} FROM {src} r WHERE r.bar_no = 0
  UNION ALL
  SELECT r.symbol, r.bar_no, {', '.join(f'{v} AS {k}' for k, v in step.items())}
  FROM {name} p JOIN {src} r ON r.symbol = p.symbol AND r.bar_no = p.bar_no + 1)"""


def ema_step(col: str, x: str, a: str) -> str:
    return f"(1 - {a}) * p.{col} + {a} * {x}"


SRC = BARS_REC + ", src AS MATERIALIZED (SELECT * FROM bars)"
D = "cast({} AS double)"


@query("ema_seeded", "symbol:s bar_no:i e20:d e50:d", scan_sql(
    SRC, {"e20": "r.close", "e50": "r.close"},
    {"e20": ema_step("e20", "r.close", "(2.0::double / 21)"), "e50": ema_step("e50", "r.close", "(2.0::double / 51)")}) + """
SELECT symbol, bar_no, CASE WHEN bar_no >= 19 THEN e20 END AS e20, CASE WHEN bar_no >= 49 THEN e50 END AS e50 FROM scan""")
def _(T):
    def build(d, f):
        d = ewm.ewm_mean(d, f, "close", "e20", span=20, least=20)
        return ewm.ewm_mean(d, f, "close", "e50", span=50, least=50)
    return in_chunks(bars(T), build, history=ewm.reach(ewm.alpha_of(50)))


@query("ema_weighted", "symbol:s bar_no:i e14:d", scan_sql(
    SRC, {"num": "r.high - r.low", "den": "1::double"},
    {"num": "(1 - 2.0::double / 15) * p.num + r.high - r.low", "den": "(1 - 2.0::double / 15) * p.den + 1"}) + """
SELECT symbol, bar_no, CASE WHEN bar_no >= 4 THEN num / den END AS e14 FROM scan""")
def _(T):
    def build(d, f):
        return ewm.ewm_mean(d, f, F.col("high") - F.col("low"), "e14", span=14, least=5, adjust=True)
    return in_chunks(bars(T), build, history=ewm.reach(ewm.alpha_of(14)))


@query("ewm_std", "symbol:s bar_no:i sd:d", scan_sql(
    SRC, {"m": "r.close", "v": "0::double", "w": "1::double"},
    {"m": ema_step("m", "r.close", "(2.0::double / 31)"),
     "v": "(1 - 2.0::double / 31) * (p.v + (2.0::double / 31) * (r.close - p.m) * (r.close - p.m))",
     "w": "(1 - 2.0::double / 31) * (1 - 2.0::double / 31) * p.w + (2.0::double / 31) * (2.0::double / 31)"}) + """
SELECT symbol, bar_no, CASE WHEN bar_no >= 4 THEN sqrt(v / (1 - w)) END AS sd FROM scan""")
def _(T):
    return in_chunks(bars(T), lambda d, f: ewm.ewm_std(d, f, "close", "sd", span=30, least=5),
                     history=2 * ewm.reach(ewm.alpha_of(30)) + 1)


TR = """ (SELECT *, greatest(high - low, abs(high - coalesce(lag(close) OVER w, high)), abs(low - coalesce(lag(close) OVER w, low))) AS tr
  FROM bars WINDOW w AS (PARTITION BY symbol ORDER BY bar_no))"""


@query("wilder_atr", "symbol:s bar_no:i atr14:d atr22:d", scan_sql(
    BARS_REC + ", src AS MATERIALIZED" + TR, {"a": "r.tr", "b": "r.tr"},
    {"a": ema_step("a", "r.tr", "(1.0::double / 14)"), "b": ema_step("b", "r.tr", "(1.0::double / 22)")}) + """
SELECT symbol, bar_no, CASE WHEN bar_no >= 13 THEN a END AS atr14, CASE WHEN bar_no >= 21 THEN b END AS atr22 FROM scan""")
def _(T):
    def build(d, f):
        return ind.atr(ind.atr(d, f, 14, "atr14"), f, 22, "atr22")
    return in_chunks(bars(T), build, history=ewm.reach(1 / 22) + 1)


@query("kama", "symbol:s bar_no:i kama:d", scan_sql(
    BARS_REC + """, q AS (SELECT *, (high + low + close) / 3 AS p FROM bars),
  d AS (SELECT *, abs(p - lag(p) OVER w) AS step, abs(p - lag(p, 9) OVER w) AS move FROM q WINDOW w AS (PARTITION BY symbol ORDER BY bar_no)),
  src AS MATERIALIZED (SELECT *, power(coalesce(move / nullif(CASE WHEN count(step) OVER w9 >= 9 THEN sum(step) OVER w9 END, 0), 0)
     * (2.0::double / 3 - 2.0::double / 31) + 2.0::double / 31, 2) AS sc FROM d WINDOW w9 AS (PARTITION BY symbol ORDER BY bar_no ROWS 8 PRECEDING))""",
    {"k": "CASE WHEN r.bar_no = 8 THEN r.p END"},
    {"k": "CASE WHEN r.bar_no = 8 THEN r.p WHEN r.bar_no > 8 THEN p.k + r.sc * (r.p - p.k) END"}) + """
SELECT symbol, bar_no, k AS kama FROM scan""")
def _(T):
    return ind.kama(bars(T), 9, 2, 30, source="hlc3")


@query("kalman_level", "symbol:s bar_no:i kalman_mean:d kalman_residual:d kalman_velocity:d", scan_sql(
    SRC, {"m": "r.close", "v": "1::double", "x": "r.close", "vel": "0::double"},
    {"m": "p.m + (p.v + 1e-4) / (p.v + 1e-4 + 1e-2) * (r.close - p.m)", "v": "(1 - (p.v + 1e-4) / (p.v + 1e-4 + 1e-2)) * (p.v + 1e-4)",
     "x": "r.close", "vel": "(p.v + 1e-4) / (p.v + 1e-4 + 1e-2) * (r.close - p.m)"}) + """
SELECT symbol, bar_no, m AS kalman_mean, x - m AS kalman_residual, vel AS kalman_velocity FROM scan""")
def _(T):
    return ind.kalman(bars(T))


@query("session_marks", "user_id:i event_id:i session_id:i bar_of_session:i bars_remaining:i valid:b", """
WITH g AS (SELECT *, coalesce((ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) > INTERVAL 4 HOUR)::int, 0) AS brk FROM events),
s AS (SELECT *, sum(brk) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS session_id FROM g),
r AS (SELECT *, row_number() OVER (PARTITION BY user_id, session_id ORDER BY ts, event_id) - 1 AS bar_of_session,
  count(*) OVER (PARTITION BY user_id, session_id) - row_number() OVER (PARTITION BY user_id, session_id ORDER BY ts, event_id) AS bars_remaining FROM s)
SELECT *, bar_of_session >= 1 AND bars_remaining >= 1 AS valid FROM r""")
def _(T):
    e = number_rows(T("events"), ("user_id",), ("ts", "event_id"))
    return sessions.mark_sessions(e, keys=("user_id",), t="ts", open_skip=1, close_cutoff=1)


@query("run_lengths", "symbol:s bar_no:i consec_bull:i consec_bear:i same_state:i", BARS + """, s AS (
  SELECT *, sign(close - open) AS dir, coalesce((sign(close - open) <> lag(sign(close - open)) OVER w)::int, 1) AS chg FROM bars
  WINDOW w AS (PARTITION BY symbol ORDER BY bar_no)),
i AS (SELECT *, sum(chg) OVER (PARTITION BY symbol ORDER BY bar_no) AS isl FROM s),
r AS (SELECT *, row_number() OVER (PARTITION BY symbol, isl ORDER BY bar_no) AS n FROM i)
SELECT symbol, bar_no, CASE WHEN dir = 1 THEN n ELSE 0 END AS consec_bull, CASE WHEN dir = -1 THEN n ELSE 0 END AS consec_bear, least(n - 1, 40) AS same_state FROM r""")
def _(T):
    return seq.direction_runs(bars(T))


@query("run_with_condition", "symbol:s bar_no:i above_run:i counter_run:i", BARS + """, s AS (
  SELECT *, close > avg(close) OVER w20 AS above FROM bars WINDOW w20 AS (PARTITION BY symbol ORDER BY bar_no ROWS 19 PRECEDING)),
i AS (SELECT *, sum((NOT above)::int) OVER w AS g1, sum((close > open)::int) OVER w AS g2 FROM s WINDOW w AS (PARTITION BY symbol ORDER BY bar_no))
SELECT symbol, bar_no, sum(above::int) OVER (PARTITION BY symbol, g1 ORDER BY bar_no) AS above_run,
  sum((close < open AND bar_no > 0)::int) OVER (PARTITION BY symbol, g2 ORDER BY bar_no) AS counter_run FROM i""")
def _(T):
    d = in_chunks(bars(T), lambda x, f: x.withColumn("above", F.col("close") > f.mean("close", 20)), history=20)
    hit = (F.col("close") < F.col("open")) & (F.col("bar_no") > 0)
    return seq.counts_since_reset(d, {"above_run": (F.col("above"), ~F.col("above")),
                                      "counter_run": (hit, F.col("close") > F.col("open"))})


@query("micro_channel", "symbol:s bar_no:i consec:i micro:i", BARS + """, s AS (
  SELECT *, CASE WHEN bar_no > 0 AND close > open AND low >= lag(low) OVER w THEN 1 WHEN bar_no > 0 AND close < open AND high <= lag(high) OVER w THEN -1 ELSE 0 END AS v
  FROM bars WINDOW w AS (PARTITION BY symbol ORDER BY bar_no)),
i AS (SELECT *, sum((v = 0)::int) OVER (PARTITION BY symbol ORDER BY bar_no) AS g FROM s),
c AS (SELECT *, sum(v) OVER (PARTITION BY symbol, g ORDER BY bar_no) AS consec FROM i)
SELECT symbol, bar_no, consec, CASE WHEN abs(consec) >= 3 THEN sign(consec) * 20 ELSE 0 END AS micro FROM c""")
def _(T):
    return seq.micro_channel(bars(T))


@query("latch_until_reverse", "symbol:s bar_no:i long_on:b short_on:b", BARS + """, s AS (
  SELECT *, coalesce(close > lag(high) OVER w, false) AS buy, coalesce(close < lag(low) OVER w OR volume >= 6, false) AS sell FROM bars
  WINDOW w AS (PARTITION BY symbol ORDER BY bar_no))
SELECT symbol, bar_no, coalesce(last_value(CASE WHEN buy THEN true WHEN sell THEN false END IGNORE NULLS) OVER u, false) AS long_on,
  coalesce(last_value(CASE WHEN sell THEN true WHEN buy THEN false END IGNORE NULLS) OVER u, false) AS short_on
FROM s WINDOW u AS (PARTITION BY symbol ORDER BY bar_no ROWS UNBOUNDED PRECEDING)""")
def _(T):
    d = in_chunks(bars(T), lambda x, f: x.withColumns({
        "buy": F.coalesce(F.col("close") > f.lag("high"), F.lit(False)),
        "sell": F.coalesce((F.col("close") < f.lag("low")) | (F.col("volume") >= 6), F.lit(False))}), history=1)
    return seq.latch(d, "buy", "sell", "long_on", "short_on")


@query("signal_carry_same_day", "symbol:s bar_no:i sig:b carried:b recent:b", BARS + f""", s AS (SELECT *, volume >= 6 AS sig FROM bars)
SELECT symbol, bar_no, sig, bool_or(sig) OVER (PARTITION BY symbol, cast(t AS date) ORDER BY bar_no ROWS 2 PRECEDING) AS carried,
  bool_or(sig) OVER ({W} 4 PRECEDING) AS recent FROM s""")
def _(T):
    d = bars(T).withColumn("sig", F.col("volume") >= 6)
    d = seq.carry_same_day(d, "sig", 2, "carried")
    return in_chunks(d, lambda x, f: x.withColumn("recent", F.bool_or("sig").over(f.last(5))), history=5)


@query("position_from_signal", "symbol:s bar_no:i position:i intraday:i", BARS + """, s AS (
  SELECT *, CASE WHEN volume >= 6 THEN CASE WHEN close > open THEN 1 ELSE -1 END ELSE 0 END AS sig FROM bars),
f AS (SELECT *, coalesce(last_value(nullif(sig, 0) IGNORE NULLS) OVER (PARTITION BY symbol ORDER BY bar_no ROWS UNBOUNDED PRECEDING), 0) AS held,
  coalesce(last_value(nullif(sig, 0) IGNORE NULLS) OVER (PARTITION BY symbol, cast(t AS date) ORDER BY bar_no ROWS UNBOUNDED PRECEDING), 0) AS held_day FROM s)
SELECT symbol, bar_no, coalesce(lag(held) OVER (PARTITION BY symbol ORDER BY bar_no), 0) AS position,
  coalesce(lag(held_day) OVER (PARTITION BY symbol, cast(t AS date) ORDER BY bar_no), 0) AS intraday FROM f""")
def _(T):
    sig = F.when(F.col("volume") >= 6, F.when(F.col("close") > F.col("open"), 1).otherwise(-1)).otherwise(0)
    return seq.positions(bars(T).withColumn("sig", sig), "sig")


@query("contiguous_runs", "symbol:s i0:i i1:i regime:i n:i", BARS + """, s AS (
  SELECT *, CASE WHEN close > 40 THEN 2 WHEN close > 15 THEN 1 WHEN close > 3 THEN 0 END AS regime FROM bars),
c AS (SELECT *, (regime IS DISTINCT FROM lag(regime) OVER w OR bar_no = 0)::int AS chg FROM s WINDOW w AS (PARTITION BY symbol ORDER BY bar_no)),
i AS (SELECT *, sum(chg) OVER (PARTITION BY symbol ORDER BY bar_no) AS g FROM c)
SELECT symbol, min(bar_no) AS i0, max(bar_no) AS i1, min(regime) AS regime, count(*) AS n FROM i WHERE regime IS NOT NULL GROUP BY symbol, g""")
def _(T):
    k = F.col("close")
    d = bars(T).withColumn("regime", F.when(k > 40, 2).when(k > 15, 1).when(k > 3, 0))
    return seq.contiguous_runs(d, "regime")


@query("feature_sequences", "symbol:s bar_no:i width:i checksum:d", BARS + f""", w AS (
  SELECT symbol, bar_no, list([close, volume]) OVER ({W} 7 PRECEDING) AS xs FROM bars)
SELECT symbol, bar_no, len(xs) AS width, list_sum([xs[i][1] * i + xs[i][2] FOR i IN range(1, 9)]) AS checksum FROM w WHERE len(xs) = 8""")
def _(T):
    d = in_chunks(bars(T), lambda x, f: seq.sequences(x, f, ["close", "volume"], 8, "xs"), history=8).where("xs is not null")
    part = F.transform("xs", lambda v, i: v[0] * (i + 1) + v[1])
    return d.withColumns({"width": F.size("xs"), "checksum": F.aggregate(part, F.lit(0.0), lambda a, b: a + b)})


@query("padded_sequences", "symbol:s bar_no:i steps:i checksum:d", BARS + f""", w AS (
  SELECT symbol, bar_no, list(close) OVER ({W} 31 PRECEDING) AS xs FROM bars)
SELECT symbol, bar_no, len(xs) AS steps, list_sum([xs[i] * (i + 32 - len(xs)) FOR i IN range(1, len(xs) + 1)]) AS checksum FROM w""")
def _(T):
    d = in_chunks(bars(T), lambda x, f: seq.padded_tail(x, f, ["close"], 32, "xs", "steps"), history=32)
    part = F.transform("xs", lambda v, i: v[0] * (i + 1))
    return d.withColumn("checksum", F.aggregate(part, F.lit(0.0), lambda a, b: a + b))
