"""Queries: every entry gate by itself, and the named strategies."""
from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import context as cx, market_structure as ms, trend_rules as tr
from ..operators.durable import durable
from ..operators.layout import in_chunks
from ..operators.sequences import latch
from .catalog import query
from .data import BARS, bars
from .q_structure import _I, _S, _ZERO, FVG, PIV, RULE, rule_frame
from .q_windows import scan_sql

STATES = ("tight_bull_channel", "wide_bear_channel", "trading_range", "wide_bull_channel")
VARIANTS = {"plain": {}, **{g: {"gates": (g,)} for g in tr.GATE_COLUMNS}, "all_but_inside": {"gates": ("opening_range", "pressure", "regime", "twenty_bar")}, "relaxed": {"relaxed": True}, "flips_only": {"ce_only": True},
            "stacked": {"trend_mode": "stacked_trend"}, "slope": {"slope": 0.002}}


def gate_frame(T):
    """Rule frame with simple stand-ins for the columns that the gates read."""
    n, body, span = F.col("bar_no"), F.col("close") - F.col("open"), F.col("high") - F.col("low")
    d = latch(durable(rule_frame(T)), "ce_buy_signal", "ce_sell_signal", "_la", "_sa")
    return d.withColumns({
        "or_period": F.when(n % 9 != 0, F.hour("t") < 10), "pa_strong_bull_signal": body > 0.5 * span, "pa_strong_bear_signal": -body > 0.5 * span,
        "pa_is_h2_setup": n % 3 == 0, "pa_is_l2_setup": n % 3 == 1, "pa_net_pressure": F.try_divide(body, span), "pa_regime_trend": F.col("volume") > 4,
        "pa_trend_weakened": F.when(n % 7 != 0, n % 5 == 0), "pa_is_ii_pattern": span < 20, "pa_env_state": F.element_at(F.array(*[F.lit(x) for x in STATES]), (n % 4 + 1).cast("int")),
        "pa_env_trend_dir": F.element_at(F.array(*[F.lit(x) for x in (1, -1, 0, 1)]), (n % 4 + 1).cast("int")), "pa_mag20_bull": F.col("volume") % 2 == 0})


GATES_SQL = RULE + """, g AS (SELECT *, coalesce(bar_no % 9 = 0 OR hour(t) < 10, true) AS orp, close - open > 0.5 * (high - low) AS sb, open - close > 0.5 * (high - low) AS ss, (close - open) / nullif(high - low, 0) AS pr, volume > 4 AS rt,
  coalesce(bar_no % 7 <> 0 AND bar_no % 5 = 0, false) AS weak, high - low < 20 AS ii, bar_no % 4 AS st, coalesce(la AND k > z AND kslope > 0, false) AS pa, coalesce(sa AND k < z AND kslope < 0, false) AS pb FROM rule1),
v AS (SELECT *, coalesce(pr >= 0.0, false) AS p0, coalesce(pr <= 0.0, false) AS p1, NOT ((buy OR sell) AND rt) AS rg FROM g),
u AS (SELECT symbol, bar_no, unnest(['plain', 'opening_range', 'signal_bar', 'second_entry', 'pressure', 'regime', 'twenty_bar', 'inside_inside', 'higher_frame', 'triggers', 'all_but_inside', 'relaxed', 'flips_only', 'stacked', 'slope']) AS variant,
  unnest([ra, ra AND NOT orp, ra AND sb, ra AND bar_no % 3 = 0, ra AND p0, ra AND rg, ra AND NOT weak, ra OR (ii AND close > open), ra AND st IN (0, 3), ra AND (bar_no % 3 = 0 OR volume % 2 = 0), ra AND NOT orp AND p0 AND rg AND NOT weak,
    (buy AND coalesce(close > z AND (st = 2 OR close > k), false)) OR pa, buy, (buy AND coalesce(close > z AND close > k AND z > k, false)) OR pa,
    (buy AND coalesce(close > z AND close > k, false) AND coalesce(zslope, 0) >= -0.002) OR coalesce(la AND k > z AND kslope >= 0.002, false)]) AS long_,
  unnest([rb, rb AND NOT orp, rb AND ss, rb AND bar_no % 3 = 1, rb AND p1, rb AND rg, rb AND NOT weak, rb OR (ii AND close < open), rb AND st = 1, rb AND bar_no % 3 = 1, rb AND NOT orp AND p1 AND rg AND NOT weak,
    (sell AND coalesce(close < z AND (st = 2 OR close < k), false)) OR pb, sell, (sell AND coalesce(close < z AND close < k AND z < k, false)) OR pb,
    (sell AND coalesce(close < z AND close < k, false) AND coalesce(zslope, 0) <= 0.002) OR coalesce(sa AND k < z AND kslope <= -0.002, false)]) AS short_ FROM v)
SELECT * FROM u"""


@query("rule_entry_gates", "symbol:s bar_no:i variant:s long_:b short_:b", GATES_SQL)
def _(T):
    d = gate_frame(T)
    rows = []
    for name, kw in VARIANTS.items():
        a, b = tr.raw_signals(**{k: v for k, v in kw.items() if k != "gates"})
        a, b = tr.gated(a, b, kw.get("gates", ()), d.columns)
        rows.append(F.struct(F.lit(name).alias("variant"), a.alias("long_"), b.alias("short_")))
    return d.select("symbol", "bar_no", F.explode(F.array(*rows)).alias("r")).select("symbol", "bar_no", "r.*")


def _both(names):
    side = lambda s: " AND ".join(f"{n}_{s}" for n in names)
    return f"({side('l')})::int - ({side('s')})::int"


def _recent(p):
    return ", ".join(f"max({p}_{s}) OVER (PARTITION BY symbol ORDER BY bar_no ROWS {tr.RECENT - 1} PRECEDING) AS {p}_recent_{s}" for s in "ls")


STRATEGY_SQL = scan_sql(RULE + ", " + PIV, _ZERO, {**_S, **_I}, "ev", "pq") + ", " + FVG + f""",
sg AS (SELECT r.symbol, r.bar_no, r.t, buy AS flip_l, sell AS flip_s, coalesce(z > k, false) AS trend_l, coalesce(z < k, false) AS trend_s, sbu OR ibu AS structure_l, sbd OR ibd AS structure_s, sbu AS block_l, sbd AS block_s, up AS gap_l, dn AS gap_s
  FROM rule0 r JOIN ev USING (symbol, bar_no) JOIN fi USING (symbol, bar_no)),
sh AS (SELECT *, structure_l OR block_l OR gap_l AS any_l, structure_s OR block_s OR gap_s AS any_s, trend_l AND NOT coalesce(lag(trend_l) OVER (PARTITION BY symbol ORDER BY bar_no), false) AS cross_l,
  trend_s AND NOT coalesce(lag(trend_s) OVER (PARTITION BY symbol ORDER BY bar_no), false) AS cross_s FROM sg),
si AS (SELECT *, {", ".join(_recent(p) for p in ("structure", "gap", "block", "any"))} FROM sh)
SELECT symbol, bar_no, unnest([{", ".join(f"'{n}'" for n in tr.STRATEGIES)}]) AS strategy, unnest([{", ".join(_both(p) for p in tr.STRATEGIES.values())}]) AS signal FROM si"""


@query("strategy_signals", "symbol:s bar_no:i strategy:s signal:i", STRATEGY_SQL)
def _(T):
    b = bars(T)
    events = [c for c in (f"{w}_{s}_{e}" for w in ("swing", "internal") for s in ("bullish", "bearish") for e in ("bos", "choch"))]
    d = durable(rule_frame(T)).join(ms.structure_events(b, 15, 5).select("symbol", "bar_no", *events), ["symbol", "bar_no"])
    d = d.join(ms.order_blocks(b, 15, 30).select("symbol", "bar_no", "bullish_order_block_top", "bearish_order_block_top"), ["symbol", "bar_no"])
    d = d.join(ms.fair_value_gaps(b).select("symbol", "bar_no", "bullish_fvg", "bearish_fvg"), ["symbol", "bar_no"])
    return tr.strategy_signals(durable(d))


STACKED = ("l1a_regime_entropy l1a_regime_top2_gap l1b_cluster_top1 l1b_cluster_top2_gap l1b_novelty_x_vol l1b_regime_change_x_entropy l1b_unsup_pressure l2_l1b_edge_over_tau l2_vol_adjusted_l1b_edge "
           "l2_edge_x_breakout l2_breakout_x_abs_edge l2_signal_strength_mean_abs l2_signal_spread_var l2_bull_mass_x_abs_edge l2_range_mass_x_abs_edge volatility_regime_adjusted l2_directional_pressure "
           "l2_skew_imbalance l2_order_flow_asymmetry l2_direction_vol_pressure l2_recent_momentum_abs pa_l1a_regime_interaction").split()


@query("stacked_features", "symbol:s bar_no:i " + " ".join(f"{n}:d" for n in STACKED), BARS + """, i AS (SELECT *, [volume, close / 50, (high - low) / 40, bar_no % 5, 1.0::double] AS r, list_reverse_sort([close / 100, volume / 10, 0.2::double]) AS c, (high - close) / 50 AS nov, (close - low) / 60 AS chg, (high - low) / 100 AS vol,
  (close - open) / 50 AS tr, (close - open) / 100 AS e, volume / 20 AS b, (open - close) / 100 AS bias, coalesce(abs(close / lag(close, 5) OVER (PARTITION BY symbol ORDER BY bar_no) - 1), 0) AS mom FROM bars),
p AS (SELECT *, list_transform(r, lambda x: x / list_sum(r)) AS p FROM i), q AS (SELECT *, -list_sum(list_transform(p, lambda x: greatest(x, 1e-12) * ln(greatest(x, 1e-12)))) AS ent, list_reverse_sort(p) AS ps, abs(e) AS a FROM p)
SELECT symbol, bar_no, ent AS l1a_regime_entropy, ps[1] - ps[2] AS l1a_regime_top2_gap, c[1] AS l1b_cluster_top1, c[1] - c[2] AS l1b_cluster_top2_gap, nov * vol AS l1b_novelty_x_vol, chg * ent AS l1b_regime_change_x_entropy, c[1] - c[2] - nov AS l1b_unsup_pressure,
  e / 0.05 AS l2_l1b_edge_over_tau, e / greatest(vol, 1e-4) AS l2_vol_adjusted_l1b_edge, e * b AS l2_edge_x_breakout, b * a AS l2_breakout_x_abs_edge, a AS l2_signal_strength_mean_abs, power((e - b) / 2, 2) AS l2_signal_spread_var,
  (p[2] + p[3] + p[4]) * a AS l2_bull_mass_x_abs_edge, (p[1] + p[5]) * a AS l2_range_mass_x_abs_edge, e / (greatest(vol, 1e-4) * (1 + abs(tr))) AS volatility_regime_adjusted, a AS l2_directional_pressure, abs(tr) AS l2_skew_imbalance,
  abs(bias) AS l2_order_flow_asymmetry, a * (1 + least(abs(tr), 3)) AS l2_direction_vol_pressure, mom AS l2_recent_momentum_abs, (bias + 0.3) / 2 * ent AS pa_l1a_regime_interaction FROM q""")
def _(T):
    k, o, h, l, v = (F.col(n) for n in ("close", "open", "high", "low", "volume"))
    d = bars(T).withColumns({"r0": v, "r1": k / 50, "r2": (h - l) / 40, "r3": F.col("bar_no") % 5, "r4": F.lit(1.0), "c0": k / 100, "c1": v / 10, "c2": F.lit(0.2), "l1b_novelty_score": (h - k) / 50,
                             "l1b_regime_change_score": (k - l) / 60, "l1a_vol_forecast": (h - l) / 100, "l1a_vol_trend": (k - o) / 50, "l1b_edge_pred": (k - o) / 100, "l1b_breakout_quality": v / 20,
                             "pa_state_always_in_bias": (o - k) / 100, "pa_state_range_risk": F.lit(0.3)})
    return in_chunks(d, lambda x, f: cx.stacked_features(x, f, [f"r{i}" for i in range(5)], [f"c{i}" for i in range(3)]), history=5)


@query("handcrafted_features", "symbol:s bar_no:i l1b_bo_composite:d l1b_bo_active:d l1b_session_progress:d l1b_bo_range_x_garch_vol:d l1b_session_x_bo_range:d", BARS + """, i AS (SELECT *, (high - low) / 40 AS rg, (close - open) / 30 AS pd, volume / 10 AS gv, (hour(t) * 60 + minute(t)) / 1440.0 AS sp FROM bars)
SELECT symbol, bar_no, (tanh(least(greatest(rg, -5), 5)) + tanh(least(greatest(pd, -5), 5))) / 2 AS l1b_bo_composite, (abs(rg) > 0.02)::int AS l1b_bo_active, sp AS l1b_session_progress, least(greatest(rg * gv, -1e4), 1e4) AS l1b_bo_range_x_garch_vol,
  least(greatest(sp * rg, -1e4), 1e4) AS l1b_session_x_bo_range FROM i""")
def _(T):
    d = bars(T).withColumns({"bo_range_atr": (F.col("high") - F.col("low")) / 40, "bo_pressure_diff": (F.col("close") - F.col("open")) / 30, "pa_garch_vol": F.col("volume") / 10})
    return cx.handcrafted(d, ["bo_range_atr", "bo_pressure_diff"])
