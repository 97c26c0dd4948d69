"""Queries: sources, projections, predicates and shapes of bars."""
from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.exprs import minute_of_day, price_source
from ..operators import gates, shapes
from ..operators.layout import in_chunks
from ..operators.resample import resample, tick_bars
from ..sources import bars as src
from .catalog import query
from .data import BARS, TRADES, bars, bars_cte, trades

BAR_COLS = "symbol:s t:t open:d high:d low:d close:d volume:d"


@query("bars_right_edge", BAR_COLS + " bar_no:i", BARS + " SELECT * FROM bars")
def _(T):
    return bars(T)


@query("bars_left_edge", "symbol:s t:t ready:t open:d high:d low:d close:d volume:d", """
SELECT event_type AS symbol, time_bucket(INTERVAL 5 MINUTE, ts) AS t,
       time_bucket(INTERVAL 5 MINUTE, ts) + INTERVAL 5 MINUTE AS ready,
       first(value ORDER BY ts, event_id) AS open, max(value) AS high, min(value) AS low,
       last(value ORDER BY ts, event_id) AS close, count(*) AS volume
FROM events GROUP BY 1, 2, 3""")
def _(T):
    b = tick_bars(T("events").withColumnRenamed("event_type", "symbol"), "5 minutes", symbol="symbol", t="ts",
                  price="value", tie="event_id", closed_only=False)
    return b.withColumn("ready", F.col("t")).withColumn("t", F.col("t") - F.expr("interval 5 minutes"))


@query("bars_coarse_from_bars", BAR_COLS, BARS + """
SELECT symbol, t4 AS t, first(open ORDER BY t) AS open, max(high) AS high, min(low) AS low,
       last(close ORDER BY t) AS close, sum(volume) AS volume
FROM (SELECT *, time_bucket(INTERVAL 4 HOUR, t) + INTERVAL 4 HOUR AS t4, max(t) OVER (PARTITION BY symbol) AS newest FROM bars)
WHERE t4 <= newest GROUP BY symbol, t4""")
def _(T):
    return resample(bars(T), "4 hours")


@query("bars_clean_numbers", "event_id:i price:d size:d", """
SELECT event_id, price, size FROM (
  SELECT event_id, try_cast(CASE WHEN event_type = 'error' AND value < 5 THEN 'n/a' ELSE cast(value AS varchar) END AS double) AS price,
         try_cast(json_extract_string(props, '$.k') AS double) AS size FROM events)
WHERE price IS NOT NULL AND size IS NOT NULL""")
def _(T):
    raw = T("events").select(
        "event_id",
        F.when((F.col("event_type") == "error") & (F.col("value") < 5), "n/a").otherwise(F.col("value").cast("string")).alias("price"),
        F.get_json_object("props", "$.k").alias("size"))
    return src.clean_bars(raw, ("price", "size"))


@query("bars_bounded_scan", "user_id:i minute:t event_id:i value:d", """
SELECT user_id, minute, event_id, value FROM (
  SELECT *, date_trunc('hour', ts) AS minute,
         row_number() OVER (PARTITION BY user_id, date_trunc('hour', ts) ORDER BY ts DESC, event_id DESC) AS rn
  FROM events WHERE ts >= TIMESTAMP '2024-01-05' AND ts < TIMESTAMP '2024-01-20')
WHERE rn = 1""")
def _(T):
    e = src.between(T("events"), "2024-01-05", "2024-01-20", "ts")
    e = e.select("user_id", F.date_trunc("hour", "ts").alias("minute"), "event_id", "value", F.struct("ts", "event_id").alias("at"))
    return src.keep_last(e, ["user_id", "minute"], "at")


@query("bars_warm_up_cut", "symbol:s t:t sma24:d", """
WITH """ + bars_cte() + """, recent AS (SELECT * FROM bars WHERE t >= TIMESTAMP '2024-01-02' AND t < TIMESTAMP '2024-01-25')
SELECT symbol, t, sma24 FROM (
  SELECT symbol, t, avg(close) OVER (PARTITION BY symbol ORDER BY t ROWS 23 PRECEDING) AS sma24 FROM recent)
WHERE t >= TIMESTAMP '2024-01-12'""")
def _(T):
    def build(d):
        return in_chunks(d, lambda x, f: x.withColumn("sma24", f.mean("close", 24)), history=24)
    return src.with_warm_up(bars(T), "2024-01-12", "2024-01-25", build, days=10)


@query("bars_upsert", "symbol:s t:t close:d", """
WITH pages AS (
  SELECT event_type AS symbol, date_trunc('hour', ts) AS t, value AS close,
         CASE WHEN value < 20 THEN -1 ELSE user_id END AS page, ts, event_id FROM events)
SELECT symbol, t, close FROM (
  SELECT *, row_number() OVER (PARTITION BY symbol, t ORDER BY page DESC, ts DESC, event_id DESC) AS rn FROM pages)
WHERE rn = 1""")
def _(T):
    e = T("events").select(F.col("event_type").alias("symbol"), F.date_trunc("hour", "ts").alias("t"),
                           F.col("value").alias("close"), "user_id", "ts", "event_id", "value")
    old = e.where("value < 20").withColumn("at", F.struct(F.lit(-1).cast("bigint"), "ts", "event_id")).select("symbol", "t", "close", "at")
    new = e.where("value >= 20").withColumn("at", F.struct("user_id", "ts", "event_id")).select("symbol", "t", "close", "at")
    names = "struct<page:bigint,ts:timestamp_ntz,event_id:bigint>"
    both = old.withColumn("at", F.col("at").cast(names)).unionByName(new.withColumn("at", F.col("at").cast(names)))
    return src.keep_last(both, ["symbol", "t"], "at")


@query("labels_optional_columns", "doc_id:i quality:i toxic:i lbl_chars:i", """
SELECT doc_id, quality, toxic, n_chars AS lbl_chars FROM labels JOIN documents USING (doc_id)""")
def _(T):
    lab = src.select_present(T("labels"), ["doc_id", "quality"], ["toxic", "missing_column"])
    docs = src.select_present(T("documents"), ["doc_id"], ["n_chars"], {"n_chars": "lbl_chars"})
    return lab.join(docs, "doc_id")


@query("index_scan_renamed", "t:t vix_close:d vix_high:d vix_low:d vix_volume:d", BARS + """
SELECT t, close AS vix_close, high AS vix_high, low AS vix_low, volume AS vix_volume FROM bars WHERE symbol = 'error'""")
def _(T):
    one = bars(T).where("symbol = 'error'")
    return one.withColumnsRenamed({n: f"vix_{n}" for n in ("close", "high", "low", "volume")})


@query("column_order", "symbol:s t:t close:d open:d", BARS + " SELECT symbol, t, close, open FROM bars")
def _(T):
    return src.ordered_columns(bars(T), ["t", "symbol", "close"])


@query("json_round_trip", "symbol:s n:i mean_close:d worst:d", BARS + """
SELECT symbol, count(*) AS n, avg(close) AS mean_close, CASE WHEN min(low) > 0.05 THEN min(low) END AS worst FROM bars GROUP BY symbol""")
def _(T):
    m = bars(T).groupBy("symbol").agg(F.count(F.lit(1)).alias("n"), F.avg("close").alias("mean_close"),
                                      F.when(F.min("low") > 0.05, F.min("low")).otherwise(F.lit(float("nan"))).alias("worst"))
    return src.from_json_rows(src.to_json_rows(m), "symbol string, n bigint, mean_close double, worst double")


@query("price_sources", "symbol:s t:t p_open:d p_high:d p_low:d p_close:d p_hl2:d p_hlc3:d p_ohlc4:d", BARS + """
SELECT symbol, t, open AS p_open, high AS p_high, low AS p_low, close AS p_close, (high + low) / 2 AS p_hl2,
       (high + low + close) / 3 AS p_hlc3, (open + high + low + close) / 4 AS p_ohlc4 FROM bars""")
def _(T):
    return bars(T).withColumns({f"p_{n}": price_source(n) for n in ("open", "high", "low", "close", "hl2", "hlc3", "ohlc4")})


ANATOMY = """anatomy_raw AS (
  SELECT *, close - open AS body, abs(close - open) AS body_abs, CASE WHEN high = low THEN 1e-10 ELSE high - low END AS bar_range,
         high - greatest(open, close) AS upper_wick, least(open, close) - low AS lower_wick,
         CASE WHEN close > open THEN 1 ELSE 0 END AS is_bull, CASE WHEN close < open THEN 1 ELSE 0 END AS is_bear FROM bars),
anatomy AS (
  SELECT *, body_abs / bar_range AS body_ratio, upper_wick / bar_range AS upper_wick_ratio, lower_wick / bar_range AS lower_wick_ratio,
         (close - low) / bar_range AS close_position,
         CASE WHEN is_bull = 1 AND body_abs / bar_range > 0.6 AND upper_wick / bar_range < 0.2 THEN 1 ELSE 0 END AS is_strong_bull_trend,
         CASE WHEN is_bear = 1 AND body_abs / bar_range > 0.6 AND lower_wick / bar_range < 0.2 THEN 1 ELSE 0 END AS is_strong_bear_trend
  FROM anatomy_raw)"""


@query("bar_anatomy", "symbol:s t:t body:d body_abs:d bar_range:d upper_wick:d lower_wick:d body_ratio:d upper_wick_ratio:d "
       "lower_wick_ratio:d is_bull:i is_bear:i close_position:d is_trend_bar:i is_doji:i is_strong_bull_trend:i is_strong_bear_trend:i",
       BARS + ", " + ANATOMY + """
SELECT *, CASE WHEN body_ratio > 0.6 THEN 1 ELSE 0 END AS is_trend_bar, CASE WHEN body_ratio < 0.3 THEN 1 ELSE 0 END AS is_doji FROM anatomy""")
def _(T):
    return shapes.bar_anatomy(bars(T))


@query("bar_shape", "symbol:s t:t is_inside_bar:i is_outside_bar:i gap_up:i gap_down:i body_gap_up:i body_gap_down:i "
       "higher_high:i lower_low:i higher_low:i lower_high:i overlap:d",
       BARS + ", " + ANATOMY + """, p AS (
  SELECT *, lag(high) OVER w AS ph, lag(low) OVER w AS pl, lag(close) OVER w AS pk FROM anatomy
  WINDOW w AS (PARTITION BY symbol ORDER BY bar_no))
SELECT symbol, t, coalesce((high <= ph AND low >= pl)::int, 0) AS is_inside_bar, coalesce((high > ph AND low < pl)::int, 0) AS is_outside_bar,
  coalesce((low > ph)::int, 0) AS gap_up, coalesce((high < pl)::int, 0) AS gap_down,
  coalesce((open > pk)::int, 0) AS body_gap_up, coalesce((open < pk)::int, 0) AS body_gap_down,
  coalesce((high > ph)::int, 0) AS higher_high, coalesce((low < pl)::int, 0) AS lower_low,
  coalesce((low > pl)::int, 0) AS higher_low, coalesce((high < ph)::int, 0) AS lower_high,
  CASE WHEN ph IS NOT NULL THEN greatest(0, least(high, ph) - greatest(low, pl)) / bar_range END AS overlap FROM p""")
def _(T):
    return in_chunks(shapes.bar_anatomy(bars(T)), shapes.bar_shape, history=1)


@query("pressure_label", "symbol:s t:t buy_pressure:d sell_pressure:d bull_body_growing:i bear_body_growing:i",
       BARS + ", " + ANATOMY + """, b AS (
  SELECT *, CASE WHEN is_bull = 1 THEN body_abs ELSE 0 END AS bb, CASE WHEN is_bear = 1 THEN body_abs ELSE 0 END AS eb FROM anatomy),
w AS (SELECT *, avg(is_bull) OVER w10 AS bull_ratio, avg(is_bear) OVER w10 AS bear_ratio,
        avg(bb) OVER w10 / (avg(eb) OVER w10 + 1e-10) AS dom, avg(close_position) OVER w10 AS acp,
        avg(lower_wick_ratio) OVER w10 AS alw, avg(upper_wick_ratio) OVER w10 AS auw,
        avg(bb) OVER w5 AS rb, avg(eb) OVER w5 AS re,
        avg(bb) OVER (PARTITION BY symbol ORDER BY bar_no ROWS BETWEEN 9 PRECEDING AND 5 PRECEDING) AS xb,
        avg(eb) OVER (PARTITION BY symbol ORDER BY bar_no ROWS BETWEEN 9 PRECEDING AND 5 PRECEDING) AS xe
  FROM b WINDOW w10 AS (PARTITION BY symbol ORDER BY bar_no ROWS 9 PRECEDING), w5 AS (PARTITION BY symbol ORDER BY bar_no ROWS 4 PRECEDING))
SELECT symbol, t, bull_ratio * 25 + least(greatest(dom, 0), 3) / 3 * 25 + acp * 25 + alw * 25 AS buy_pressure,
  bear_ratio * 25 + least(greatest(1 / (least(greatest(dom, 0.33), 3) + 1e-10), 0), 1) * 25 + (1 - acp) * 25 + auw * 25 AS sell_pressure,
  coalesce((rb > xb)::int, 0) AS bull_body_growing, coalesce((re > xe)::int, 0) AS bear_body_growing FROM w""")
def _(T):
    return in_chunks(shapes.bar_anatomy(bars(T)), shapes.pressure_label, history=10)


@query("session_filters", "event_id:i all_day:b first_hour:b morning:b before_1230:b trend_windows:b", """
SELECT event_id, true AS all_day, tm >= TIME '09:35' AND tm <= TIME '10:30' AS first_hour, tm >= TIME '09:35' AND tm <= TIME '11:00' AS morning,
  tm >= TIME '09:30' AND tm <= TIME '12:30' AS before_1230,
  (tm >= TIME '09:35' AND tm <= TIME '11:00') OR (tm >= TIME '14:00' AND tm <= TIME '15:30') AS trend_windows
FROM (SELECT event_id, cast(ts AS time) AS tm FROM events)""")
def _(T):
    return T("events").withColumns({n: gates.session_allowed("ts", n) for n in gates.SESSIONS})


STRATEGY_SQL = """CASE regime WHEN 0 THEN 'SHORT_STRADDLE_R0' WHEN 1 THEN 'LONG_STRADDLE_R1' WHEN 2 THEN 'GAMMA_SCALP_R2'
  WHEN 3 THEN 'SHORT_STRADDLE_R3' WHEN 4 THEN 'IRON_CONDOR_R4' ELSE 'LONG_STRADDLE_R1' END"""
REGIME_EVENTS = "SELECT event_id, ts, value, user_id, cast(floor(value) AS int) % 6 AS regime FROM events"


def regime_events(T):
    return T("events").withColumn("regime", F.floor("value").cast("int") % 6)


@query("strategy_of_regime", "event_id:i regime:i strategy:s strategy_ibf:s", f"""
SELECT *, CASE WHEN regime = 0 THEN 'IRON_BUTTERFLY_R0' ELSE strategy END AS strategy_ibf
FROM (SELECT *, {STRATEGY_SQL} AS strategy FROM ({REGIME_EVENTS}))""")
def _(T):
    return regime_events(T).withColumns({"strategy": gates.strategy_of("regime"),
                                         "strategy_ibf": gates.strategy_of("regime", butterfly=True)})


@query("entry_windows", "event_id:i strategy:s entry_start:i entry_cutoff:i force_exit:i expiry:i entry_ok:b", f"""
SELECT *, m >= entry_start AND m < entry_cutoff AS entry_ok FROM (
  SELECT *, hour(ts) * 60 + minute(ts) AS m, 960 AS expiry,
    CASE strategy WHEN 'SHORT_STRADDLE_R3' THEN 630 WHEN 'LONG_STRADDLE_R1' THEN 575 WHEN 'GAMMA_SCALP_R2' THEN 575 ELSE 645 END AS entry_start,
    CASE strategy WHEN 'SHORT_STRADDLE_R3' THEN 660 WHEN 'LONG_STRADDLE_R1' THEN 930 WHEN 'GAMMA_SCALP_R2' THEN 930 ELSE 900 END AS entry_cutoff,
    CASE WHEN strategy IN ('LONG_STRADDLE_R1', 'GAMMA_SCALP_R2') THEN 955 ELSE 930 END AS force_exit
  FROM (SELECT *, {STRATEGY_SQL} AS strategy FROM ({REGIME_EVENTS})))""")
def _(T):
    return gates.entry_window(regime_events(T).withColumn("strategy", gates.strategy_of("regime")), t="ts")


@query("regime_lists", "regime:i allowed:i not_blocked:i allow_wins:i n:i", f"""
SELECT regime, sum((regime IN (0, 1, 3))::int) AS allowed, sum((regime NOT IN (2, 4))::int) AS not_blocked,
  sum((regime IN (1))::int) AS allow_wins, count(*) AS n FROM ({REGIME_EVENTS}) GROUP BY regime""")
def _(T):
    e = regime_events(T)
    tally = {"allowed": gates.regime_allowed("regime", (0, 1, 3)),
             "not_blocked": gates.regime_allowed("regime", block=(2, 4)),
             "allow_wins": gates.regime_allowed("regime", (1,), (1, 2))}
    return e.groupBy("regime").agg(*[F.sum(x.cast("int")).alias(n) for n, x in tally.items()], F.count(F.lit(1)).alias("n"))


SIGNALS = """signals AS (SELECT event_id, value, ts, round(value / (value + 10), 4) AS conf, round((user_id % 9) / 8.0, 4) AS size,
  CASE WHEN event_type IN ('purchase', 'signup') THEN 1 WHEN event_type = 'error' THEN -1 ELSE 0 END AS sig FROM events)"""


def signals(T):
    v = F.col("value")
    return T("events").select(
        "event_id", "value", "ts", F.round(v / (v + 10), 4).alias("conf"), F.round((F.col("user_id") % 9) / 8.0, 4).alias("size"),
        F.when(F.col("event_type").isin("purchase", "signup"), 1).when(F.col("event_type") == "error", -1).otherwise(0).alias("sig"))


@query("decision_classes", "event_id:i cls:i stored:i side:i two_stage:i vetoed:d", "WITH " + SIGNALS + """, k AS (
  SELECT *, CASE WHEN sig > 0.5 THEN 0 WHEN sig < -0.5 THEN 2 ELSE 1 END AS cls,
     least(2, coalesce(CASE WHEN value > 100 THEN 7 WHEN value > 50 THEN 0 END, 1)) AS stored FROM signals)
SELECT event_id, cls, stored, CASE WHEN size < 0.25 OR conf < 0.4 THEN 0 WHEN cls = 0 THEN 1 WHEN cls = 2 THEN -1 ELSE 0 END AS side,
  CASE WHEN size < 0.3 THEN 1 WHEN abs(2 * conf - 1) <= 0.1 THEN 1 WHEN conf >= 0.5 THEN 0 ELSE 2 END AS two_stage,
  conf * greatest(0, least(1, 0.20 + 0.95 * size - 0.40 * (1 - conf) - 0.35 * conf * size - 0.20 * (1 - size))) AS vetoed FROM k""")
def _(T):
    s = signals(T).withColumn("l2_vol_signal", F.col("sig"))
    s = s.withColumn("cls", gates.decision_class(s))
    kept = s.withColumn("l2_decision_class", F.when(F.col("value") > 100, 7).when(F.col("value") > 50, 0).cast("string"))
    s = kept.withColumn("stored", gates.decision_class(kept))
    conf, size = F.col("conf"), F.col("size")
    return s.withColumns({
        "side": gates.entry_side("cls", "conf", "size", 0.4, 0.25),
        "two_stage": gates.two_stage("size", "conf", 0.3, 0.1),
        "vetoed": gates.structure_veto(conf, size, 1 - conf, conf * size, 1 - size),
    })


@query("exit_driver_backfill", "strategy:s driver:s n:i kept_learned:i kept_rules:i", TRADES + f""", d AS (
  SELECT *, coalesce(CASE driver WHEN 'A' THEN 'l3_learned' WHEN 'R' THEN 'deadline' END,
     CASE WHEN regexp_matches(strategy, '^(SHORT_STRADDLE|LONG_STRADDLE|GAMMA_SCALP|IRON_CONDOR|IRON_BUTTERFLY)_') THEN 'synthetic_rules' ELSE 'legacy_unlabeled' END) AS dr
  FROM (SELECT *, CASE WHEN book = 0 THEN 'MANUAL' ELSE {STRATEGY_SQL} END AS strategy FROM trades))
SELECT strategy, dr AS driver, count(*) AS n, sum((dr IN ('l3_learned', 'l3_mtm_adaptive'))::int) AS kept_learned,
  sum((dr = 'synthetic_rules')::int) AS kept_rules FROM d GROUP BY 1, 2""")
def _(T):
    t = trades(T).withColumn("strategy", F.when(F.col("book") == 0, "MANUAL").otherwise(gates.strategy_of("regime")))
    t = t.withColumn("primary_exit_driver", F.when(F.col("driver") == "A", "l3_learned").when(F.col("driver") == "R", "deadline"))
    t = t.withColumn("driver", gates.exit_driver(t))
    return t.groupBy("strategy", "driver").agg(
        F.count(F.lit(1)).alias("n"),
        F.sum(gates.driver_kept("driver", "l3_learned").cast("int")).alias("kept_learned"),
        F.sum(gates.driver_kept("driver", "synthetic_rules").cast("int")).alias("kept_rules"))


@query("fills_and_sizes", "event_id:i buy:d sell:d mult:d mult_flat:d", f"""
WITH {SIGNALS}, r AS (SELECT *, cast(floor(value) AS int) % 6 AS regime FROM signals)
SELECT event_id, value * (1 + 3e-4) AS buy, value * (1 - 3e-4) AS sell,
  CASE least(regime, 4) WHEN 0 THEN 0.7 WHEN 3 THEN 0.8 WHEN 4 THEN 0.6 ELSE 1.0 END AS mult_flat,
  CASE least(regime, 4) WHEN 0 THEN 0.7 WHEN 3 THEN 0.8 WHEN 4 THEN 0.6 ELSE 1.0 END
    * CASE WHEN conf > 0.6 THEN 1.0 WHEN conf >= 0.5 THEN 0.7 ELSE 0.5 END AS mult FROM r""")
def _(T):
    s = signals(T).withColumn("regime", F.floor("value").cast("int") % 6)
    return s.withColumns({
        "buy": gates.fill_price("value", F.lit(True), 2, 1), "sell": gates.fill_price("value", F.lit(False), 2, 1),
        "mult": gates.size_multiplier("regime", "conf"), "mult_flat": gates.size_multiplier("regime", "conf", False)})


@query("exit_levels", "event_id:i stop_atr:d target_atr:d stop_pct:d target_pct:d stop_mix:d target_mix:d", f"""
WITH {SIGNALS}, r AS (SELECT *, CASE WHEN size > 0.5 THEN 1 ELSE -1 END AS side, value * 0.02 AS atr FROM signals)
SELECT event_id, value - side * atr AS stop_atr, value + side * 2 * atr AS target_atr,
  value - side * value * 0.005 AS stop_pct, value + side * value * 0.01 AS target_pct, value - side * value * 0.005 AS stop_mix,
  CASE WHEN side > 0 THEN greatest(value + 2 * atr, value + 10 * abs(value * 0.005)) ELSE least(value - 2 * atr, value - 10 * abs(value * 0.005)) END AS target_mix
FROM r""")
def _(T):
    s = signals(T).withColumns({"side": F.when(F.col("size") > 0.5, 1).otherwise(-1), "atr": F.col("value") * 0.02})
    out = {}
    for n, model, floor in (("atr", "atr", 0), ("pct", "pct", 0), ("mix", "atr_tp_pct_sl", 10)):
        out[f"stop_{n}"], out[f"target_{n}"] = gates.exit_levels("value", "atr", "side", model, rr_floor=floor)
    return s.withColumns(out)


@query("clock_columns", "event_id:i minute:i weekday:i day:s month:s", """
SELECT event_id, hour(ts) * 60 + minute(ts) AS minute, isodow(ts) - 1 AS weekday, strftime(ts, '%Y-%m-%d') AS day, strftime(ts, '%Y-%m') AS month FROM events""")
def _(T):
    return T("events").withColumns({"minute": minute_of_day("ts"), "weekday": F.weekday("ts"),
                                    "day": F.date_format("ts", "yyyy-MM-dd"), "month": F.date_format("ts", "yyyy-MM")})
