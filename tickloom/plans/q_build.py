"""Queries: whole feature builds, target sets, grids, stored stages."""
from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..operators import feature_build as fb, labels as lab, sequences as seq, trend_rules as tr, volatility as vol
from ..operators.durable import shared_dir
from ..operators.layout import in_chunks
from ..sources import bars as src
from .catalog import ALL, query, stream_query, table
from .data import BARS, BARS_REC, TRADES, bars, trades
from .q_labels import A20, AHEAD, VOLCLS, vol_class_build, with_atr
from . import q_bars as _bars, q_vol as _vol  # noqa: F401  their queries are joined below
from .q_price_action import EMA, STACK
from .q_vol import REALISED, lagw, win
from .q_windows import ema_step, scan_sql
from .q_structure import evar, wsum

WANTED = ["pa_rv_cc_20", "pa_rv_gk_20", "pa_reversal_composite", "pa_continuation_composite", "pa_structure_clarity", "pa_pressure_score", "pa_pullback_stage"]


@query("feature_build", "symbol:s bar_no:i " + " ".join(f"{n}:d" for n in WANTED), EMA + ", " + STACK + ", " + REALISED.replace("FROM bars)", "FROM b)") + """
SELECT stack.*, pa_rv_cc_20, pa_rv_gk_20 FROM stack JOIN rv USING (symbol, bar_no)""")
def _(T):
    return fb.build_features(bars(T), WANTED)


def _blocks(parts: dict[str, tuple[str, ...]]) -> tuple[str, str]:
    """Columns and SQL of several block queries, joined on the bar."""
    kinds = {n: k for q in parts for n, k in ALL[q].cols}
    sql = [f"({ALL[q].sql}) AS q{i}" for i, q in enumerate(parts)]
    picked = ", ".join(f"q{i}.{n}" for i, ns in enumerate(parts.values()) for n in ns)
    return "symbol:s bar_no:i " + " ".join(f"{n}:{kinds[n]}" for ns in parts.values() for n in ns), \
        f"SELECT q0.symbol, q0.bar_no, {picked} FROM {sql[0]} " + " ".join(f"JOIN {x} ON q{i + 1}.symbol = q0.symbol AND q{i + 1}.bar_no = q0.bar_no" for i, x in enumerate(sql[1:]))


#: Blocks of the light build whose own queries say what each column must be; the full build has more.
LIGHT = {"feature_build": tuple(WANTED), "pa_micro_1m": fb.BLOCKS["micro"], "pa_opening_range": fb.BLOCKS["opening"], "pa_swing_types": fb.BLOCKS["swings"],
         "vol_annualised": fb.BLOCKS["annualised"], "vol_day_clock": fb.BLOCKS["clock"], "vol_moments": fb.BLOCKS["moments"], "vol_volume_price": fb.BLOCKS["volume_price"]}
FULL = LIGHT | {"vol_trend_noise": fb.BLOCKS["trend_noise"], "kalman_level": fb.BLOCKS["level"]}


@query("feature_build_light", *_blocks(LIGHT))
def _(T):
    return fb.build_features(bars(T), light=True)


@query("feature_build_full", *_blocks(FULL))
def _(T):
    return fb.build_features(bars(T))


@query("target_set", "symbol:s bar_no:i vol_class:i y_transition:i y_forecast:d y_trend:d straddle_edge:d y_time_in_regime:d", BARS + ", " + VOLCLS + f""", c AS (SELECT *, coalesce((vol_class <> {lagw('vol_class')})::int, 1) AS chg,
  min(vol_class) {AHEAD.format(10)} AS lo10, max(vol_class) {AHEAD.format(10)} AS hi10, avg(pa_rv_gk_20) {AHEAD.format(10)} AS fm, CASE WHEN bar_no >= 4 THEN avg(high - low) {win(20)} END AS atr,
  CASE WHEN count(*) {AHEAD.format(10)} = 10 THEN max(high) {AHEAD.format(10)} - min(low) {AHEAD.format(10)} END AS mv FROM volcls),
i AS (SELECT *, sum(chg) OVER (PARTITION BY symbol ORDER BY bar_no) AS isl FROM c)
SELECT symbol, bar_no, vol_class, coalesce((lo10 <> vol_class OR hi10 <> vol_class)::int, 0) AS y_transition, fm AS y_forecast, fm - pa_rv_gk_20 AS y_trend,
  CASE WHEN mv IS NULL OR atr IS NULL THEN 0 ELSE least(greatest(mv / close - 2 * atr / close, -0.1), 0.1) / 0.1 END AS straddle_edge,
  least(row_number() OVER (PARTITION BY symbol, isl ORDER BY bar_no) - 1, 120) / 120.0 AS y_time_in_regime FROM i""")
def _(T):
    def build(d, f):
        d = lab.target_set(vol_class_build(d, f), f)
        return d.withColumn("_chg", F.col("vol_class") != f.lag("vol_class"))
    d = in_chunks(bars(T), build, history=47 + lab.VOL_CLASS_HISTORY, lookahead=10)
    d = seq.run_of(d, {"_run": F.col("_chg")})
    return d.withColumn("y_time_in_regime", F.least(F.col("_run"), F.lit(120)) / 120.0)


GRID = ((1.0, 1.0), (2.0, 1.0), (3.0, 1.5), (1.0, 2.0))


@query("parameter_grid", "tp:d sl:d n:i mean_r:d win_rate:d stop_rate:d target_rate:d", BARS + ", " + A20 + """, e AS (SELECT symbol, bar_no, close AS entry, atr, CASE WHEN close > open THEN 1 ELSE -1 END AS side FROM atr20 WHERE atr > 0),
p AS (SELECT e.symbol, e.bar_no, b.bar_no - e.bar_no AS step, CASE WHEN side > 0 THEN b.high - entry ELSE entry - b.low END / atr AS bst, CASE WHEN side > 0 THEN entry - b.low ELSE b.high - entry END / atr AS wst, side * (b.close - entry) / atr AS c FROM e JOIN bars b ON b.symbol = e.symbol AND b.bar_no BETWEEN e.bar_no + 1 AND e.bar_no + 20),
g AS (SELECT * FROM (VALUES (1.0, 1.0), (2.0, 1.0), (3.0, 1.5), (1.0, 2.0)) x(tp, sl)),
t AS (SELECT symbol, bar_no, tp, sl, min(step) FILTER (wst >= sl) AS s, min(step) FILTER (bst >= tp) AS g, last(c ORDER BY step) AS fin FROM p, g GROUP BY 1, 2, 3, 4),
r AS (SELECT *, s IS NOT NULL AND (g IS NULL OR s <= g) AS lost FROM t), q AS (SELECT *, CASE WHEN lost THEN -sl WHEN g IS NOT NULL THEN tp ELSE fin END AS r FROM r)
SELECT tp, sl, count(*) AS n, avg(r) AS mean_r, avg((r > 0)::int) AS win_rate, avg(lost::int) AS stop_rate, avg((NOT lost AND g IS NOT NULL)::int) AS target_rate FROM q GROUP BY 1, 2""")
def _(T):
    b = in_chunks(bars(T), with_atr, history=20)
    e = b.where("atr > 0").select("symbol", "bar_no", F.col("close").alias("entry"), "atr", F.when(F.col("close") > F.col("open"), 1).otherwise(-1).alias("side"))
    return lab.parameter_grid(e, b, GRID, 20)


@stream_query("trade_log_round_trip", "symbol:s trade_id:s entry_time:t exit_time:t ret:d hold:i", TRADES + " SELECT * FROM trades")
def _(spark, d):
    home = f"{shared_dir(spark)}/trades-{uuid.uuid4().hex}"
    src.write_stage(trades(lambda n: table(spark, d, n)), home)
    return spark.read.parquet(home)


SP = "(2.0::double / 181)"


@query("ewm_z_spread", "symbol:s bar_no:i z_spread:d momentum_diff:d ratio_change:d", scan_sql(
    BARS_REC + ", src AS MATERIALIZED (SELECT *, high - low + 1 AS a, close AS b FROM bars)",
    {"m1": "r.a", "v1": "0::double", "w1": "1::double", "m2": "r.b", "v2": "0::double", "w2": "1::double"},
    {"m1": ema_step("m1", "r.a", SP), "v1": evar("v1", "m1", SP, "r.a"), "w1": wsum(SP, "w1"), "m2": ema_step("m2", "r.b", SP), "v2": evar("v2", "m2", SP, "r.b"), "w2": wsum(SP, "w2")}) + f""",
z AS (SELECT symbol, bar_no, ln(greatest(a, 1e-8)) AS la, ln(greatest(b, 1e-8)) AS lb, CASE WHEN bar_no >= 29 THEN least(greatest((a - m1) / greatest(sqrt(v1 / (1 - w1)), 1e-8), -5), 5) ELSE 0 END AS za,
  CASE WHEN bar_no >= 29 THEN least(greatest((b - m2) / greatest(sqrt(v2 / (1 - w2)), 1e-8), -5), 5) ELSE 0 END AS zb FROM src JOIN scan USING (symbol, bar_no))
SELECT symbol, bar_no, least(greatest(za - zb, -5), 5) AS z_spread, least(greatest(coalesce((la - {lagw('la', 30)}) - (lb - {lagw('lb', 30)}), 0), -3), 3) AS momentum_diff,
  least(greatest(coalesce((la - lb) - {lagw('la - lb', 15)}, 0), -3), 3) AS ratio_change FROM z""")
def _(T):
    b = bars(T).withColumns({"a": F.col("high") - F.col("low") + 1, "b": F.col("close")})
    return in_chunks(b, lambda d, f: vol.ewm_z_spread(d, f, "a", "b"), history=vol.Z_SPREAD_HISTORY)
