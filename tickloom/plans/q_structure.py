"""Queries: soft states, stops, rule signals, market structure, context scores."""
from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import context as cx, indicators as ind, market_structure as ms, price_action as pa, regimes as rg, sequences as seq, shapes, trend_rules as tr
from ..operators.layout import in_chunks
from .catalog import query
from .data import BARS, BARS_REC, bars, bars_cte
from .q_bars import ANATOMY
from .q_labels import A20, with_atr
from .q_price_action import PRESSURE
from .q_vol import lagw, win
from .q_windows import TR as TRUE_RANGE, ema_step, scan_sql


def evar(v: str, m: str, a: str, x: str = "r.lr") -> str:
    return f"(1 - {a}) * (p.{v} + {a} * ({x} - p.{m}) * ({x} - p.{m}))"


A20_, A30_, A120_ = "(2.0::double / 21)", "(2.0::double / 31)", "(2.0::double / 121)"


def wsum(a: str, w: str) -> str:
    return f"(1 - {a}) * (1 - {a}) * p.{w} + {a} * {a}"


SOFT = scan_sql(
    BARS_REC + ", src AS MATERIALIZED (SELECT *, coalesce(ln(close / lag(close) OVER (PARTITION BY symbol ORDER BY bar_no)), 0) AS lr FROM bars)",
    {"m1": "r.lr", "v1": "0::double", "w1": "1::double", "m2": "r.lr", "v2": "0::double", "w2": "1::double"},
    {"m1": ema_step("m1", "r.lr", A20_), "v1": evar("v1", "m1", A20_), "w1": wsum(A20_, "w1"),
     "m2": ema_step("m2", "r.lr", A30_), "v2": evar("v2", "m2", A30_), "w2": wsum(A30_, "w2")}) + """,
so1 AS MATERIALIZED (SELECT src.*, CASE WHEN bar_no >= 4 THEN m1 ELSE 0 END / greatest(CASE WHEN bar_no >= 4 THEN coalesce(sqrt(v1 / (1 - w1)), 0) ELSE 0 END, 1e-10) AS ts,
  greatest(CASE WHEN bar_no >= 4 THEN coalesce(sqrt(v2 / (1 - w2)), 0) ELSE 0 END, 1e-10) AS vol FROM src JOIN scan USING (symbol, bar_no))"""
SOFT = scan_sql(SOFT, {"b": "r.vol"}, {"b": ema_step("b", "r.vol", A120_)}, "scan2", "so1") + """,
so2 AS (SELECT so1.*, least(greatest(vol / greatest(CASE WHEN bar_no >= 19 THEN b ELSE vol END, 1e-10) - 1, -4), 4) AS vz FROM so1 JOIN scan2 USING (symbol, bar_no)),
so3 AS (SELECT *, [1.25 * ts - 0.5 * vz, 1.25 * ts + 0.5 * vz, -1.25 * ts - 0.5 * vz, -1.25 * ts + 0.5 * vz, -0.9 * abs(ts) + 0.85 * greatest(0.65 - abs(ts), 0) - 0.5 * vz, -0.9 * abs(ts) + 0.85 * greatest(0.65 - abs(ts), 0) + 0.5 * vz] AS raw FROM so2),
so4 AS (SELECT *, list_transform(raw, lambda x: least(greatest(x, -12), 12)) AS cl FROM so3),
soft AS MATERIALIZED (SELECT *, list_transform(cl, lambda x: x - list_max(cl)) AS sc, list_position(cl, list_max(cl)) - 1 AS st, 1 / list_sum(list_transform(cl, lambda x: exp(x - list_max(cl)))) AS conf FROM so4)"""


@query("soft_states", "symbol:s bar_no:i pa_hmm_state:i hmm_conf:d pa_hmm_transition_pressure:d hmm_persist:d", SOFT + """, c AS (SELECT *, coalesce((st <> lag(st) OVER (PARTITION BY symbol ORDER BY bar_no))::int, 1) AS chg FROM soft),
i AS (SELECT *, sum(chg) OVER (PARTITION BY symbol ORDER BY bar_no) AS isl FROM c)
SELECT symbol, bar_no, st AS pa_hmm_state, conf AS hmm_conf, 1 - conf AS pa_hmm_transition_pressure, least(row_number() OVER (PARTITION BY symbol, isl ORDER BY bar_no) - 1, 40) / 40.0 AS hmm_persist FROM i""")
def _(T):
    return rg.soft_states(bars(T))


SEED = """, seed AS (SELECT symbol, greatest(max(CASE WHEN bar_no = 1 THEN lr * lr END), 1e-6) AS sv FROM soft GROUP BY symbol),
gs AS MATERIALIZED (SELECT soft.*, sv, lag(lr) OVER (PARTITION BY symbol ORDER BY bar_no) AS r0, lag(st) OVER (PARTITION BY symbol ORDER BY bar_no) IN (1, 3, 5) AS hv FROM soft JOIN seed USING (symbol))"""
GARCH = scan_sql(SOFT + SEED, {"var": "r.sv"}, {"var": "CASE WHEN r.hv THEN greatest(r.sv * 0.05, 1e-10) + 0.15 * r.r0 * r.r0 + 0.8 * p.var ELSE greatest(r.sv * (1.0::double - 0.05 - 0.94), 1e-10) + 0.05 * r.r0 * r.r0 + 0.94 * p.var END"}, "gscan", "gs") + """,
g1 AS MATERIALIZED (SELECT gs.*, var, sqrt(greatest(var, 1e-10)) AS gv, power(least(lr, 0), 2) AS neg, power(greatest(lr, 0), 2) AS pos FROM gs JOIN gscan USING (symbol, bar_no))"""
GARCH = scan_sql(GARCH, {"ma": "r.gv", "dn": "r.neg", "up": "r.pos"}, {"ma": ema_step("ma", "r.gv", A120_), "dn": ema_step("dn", "r.neg", A30_), "up": ema_step("up", "r.pos", A30_)}, "gscan2", "g1")


@query("garch_variance", "symbol:s bar_no:i pa_garch_vol:d pa_garch_shock:d pa_garch_vol_of_vol:d pa_egarch_downside_vol_ratio:d", GARCH + f"""
SELECT symbol, bar_no, gv AS pa_garch_vol, least(greatest(lr * lr / greatest(var, 1e-10) - 1, -3), 6) AS pa_garch_shock, coalesce(abs(gv - {lagw('gv')}) / greatest(CASE WHEN bar_no >= 19 THEN ma ELSE gv END, 1e-10), 0) AS pa_garch_vol_of_vol,
  least(greatest(sqrt(CASE WHEN bar_no >= 4 THEN dn ELSE 0 END + 1e-10) / sqrt(CASE WHEN bar_no >= 4 THEN up ELSE 0 END + 1e-10), 0), 6) AS pa_egarch_downside_vol_ratio FROM g1 JOIN gscan2 USING (symbol, bar_no)""")
def _(T):
    from ..operators.durable import durable
    return rg.garch(durable(rg.soft_states(bars(T))))


ADJ = "list_transform(list_zip(r.sc, range(6)), lambda z: least(greatest(z[1] + CASE WHEN z[2] = p.hs THEN 0.45 * greatest(1 - least((p.run + 1) / {u}, 2), 0) - 0.35 * greatest(least((p.run + 1) / {u}, 2) - 1, 0) ELSE 0 END, -12), 12))".format(
    u="[24.0::double, 14, 24, 14, 18, 10][p.hs + 1]")
HSMM = SOFT + f""", hs AS (SELECT symbol, bar_no, st AS hs, 0 AS run, conf AS pr FROM soft WHERE bar_no = 0
  UNION ALL
  SELECT symbol, bar_no, list_position(adj, list_max(adj)) - 1, CASE WHEN list_position(adj, list_max(adj)) - 1 = hs THEN run + 1 ELSE 0 END, 1 / list_sum(list_transform(adj, lambda x: exp(x - list_max(adj))))
  FROM (SELECT r.symbol, r.bar_no, p.hs, p.run, {ADJ} AS adj FROM hs p JOIN soft r ON r.symbol = p.symbol AND r.bar_no = p.bar_no + 1)),
hsmm AS MATERIALIZED (SELECT *, run + 1 AS db, [24.0::double, 14, 24, 14, 18, 10][hs + 1] AS target FROM hs)"""


@query("smoothed_states", "symbol:s bar_no:i hsmm_state:i pa_hsmm_duration_norm:d pa_hsmm_remaining_duration:d pa_hsmm_duration_percentile:d pa_hsmm_switch_hazard:d", HSMM + """
SELECT symbol, bar_no, hs AS hsmm_state, least(db / target, 2) AS pa_hsmm_duration_norm, greatest(target - db, 0) / target AS pa_hsmm_remaining_duration, 1 - exp(-db / target) AS pa_hsmm_duration_percentile,
  least(greatest(1 - pr + 0.55 * greatest(least(db / target, 2) - 1, 0), 0), 1) AS pa_hsmm_switch_hazard FROM hsmm""")
def _(T):
    from ..operators.durable import durable
    return rg.smoothed_states(durable(rg.soft_states(bars(T))))


HV = "(r.s0 IN (1, 3, 5))"
EGARCH = scan_sql(HSMM + """, seed AS (SELECT symbol, greatest(max(CASE WHEN bar_no = 1 THEN lr * lr END), 1e-6) AS sv FROM soft GROUP BY symbol),
eg AS MATERIALIZED (SELECT soft.symbol, soft.bar_no, lr, sv, lag(lr) OVER (PARTITION BY symbol ORDER BY bar_no) AS r0, lag(hs) OVER (PARTITION BY symbol ORDER BY bar_no) AS s0 FROM soft JOIN hsmm USING (symbol, bar_no) JOIN seed USING (symbol))""",
                  {"lv": "ln(r.sv)", "lev": "0::double"},
                  {"lv": f"least(greatest(CASE WHEN {HV} THEN -0.18 ELSE -0.30 END + CASE WHEN {HV} THEN 0.88 ELSE 0.92 END * p.lv + CASE WHEN {HV} THEN 0.16 ELSE 0.10 END * (abs(r.r0 / sqrt(greatest(exp(p.lv), 1e-10))) - sqrt(2 / pi())) + CASE WHEN {HV} THEN -0.10 ELSE -0.06 END * r.r0 / sqrt(greatest(exp(p.lv), 1e-10)), ln(1e-10)), ln(5e-2))",
                   "lev": f"CASE WHEN {HV} THEN -0.10 ELSE -0.06 END * r.r0 / sqrt(greatest(exp(p.lv), 1e-10))"}, "escan", "eg")


@query("egarch_variance", "symbol:s bar_no:i pa_egarch_leverage_effect:d pa_egarch_std_residual:d pa_egarch_vol_asymmetry:d", EGARCH + """, e AS (SELECT eg.symbol, eg.bar_no, lev, least(greatest(lr / sqrt(greatest(exp(lv), 1e-10)), -6), 6) AS sr FROM eg JOIN escan USING (symbol, bar_no))
SELECT symbol, bar_no, least(greatest(lev, -2), 2) AS pa_egarch_leverage_effect, sr AS pa_egarch_std_residual, least(greatest(sr * lev, -6), 6) AS pa_egarch_vol_asymmetry FROM e""")
def _(T):
    from ..operators.durable import durable
    return rg.egarch(rg.smoothed_states(durable(rg.soft_states(bars(T)))))


def ce_sql(source: str, n: int, mult: str) -> str:
    """CTE `ce`: chandelier stops and direction."""
    s = scan_sql(source, {"a": "r.tr"}, {"a": ema_step("a", "r.tr", f"(1.0::double / {n})")}, "cscan", "ctr") + f""",
cs AS MATERIALIZED (SELECT ctr.symbol, ctr.bar_no, close, CASE WHEN bar_no >= {n - 1} THEN max(close) {win(n)} - {mult} * a END AS up, CASE WHEN bar_no >= {n - 1} THEN min(close) {win(n)} + {mult} * a END AS dn,
  lag(close) OVER (PARTITION BY symbol ORDER BY bar_no) AS pc, CASE WHEN bar_no >= {n - 1} THEN {mult} * a END AS ca FROM ctr JOIN cscan USING (symbol, bar_no))"""
    s = scan_sql(s, {"ls": "r.up", "ss": "r.dn", "dir": "1"}, {
        "ls": "CASE WHEN p.ls IS NOT NULL AND r.up IS NOT NULL AND r.pc > p.ls THEN greatest(r.up, p.ls) ELSE r.up END",
        "ss": "CASE WHEN p.ss IS NOT NULL AND r.dn IS NOT NULL AND r.pc < p.ss THEN least(r.dn, p.ss) ELSE r.dn END",
        "dir": "CASE WHEN r.close > p.ss THEN 1 WHEN r.close < p.ls THEN -1 ELSE p.dir END"}, "cst", "cs")
    return s + """,
ce AS MATERIALIZED (SELECT cst.*, ca, coalesce(dir = 1 AND lag(dir) OVER (PARTITION BY symbol ORDER BY bar_no) = -1, false) AS buy, coalesce(dir = -1 AND lag(dir) OVER (PARTITION BY symbol ORDER BY bar_no) = 1, false) AS sell FROM cst JOIN cs USING (symbol, bar_no))"""


CTR = BARS_REC + ", ctr AS MATERIALIZED" + TRUE_RANGE


@query("chandelier", "symbol:s bar_no:i ce_atr:d ce_long_stop:d ce_short_stop:d ce_dir:i ce_buy_signal:b ce_sell_signal:b ce_state_long:b ce_state_short:b", ce_sql(CTR, 10, "1.5") + """
SELECT symbol, bar_no, ca AS ce_atr, ls AS ce_long_stop, ss AS ce_short_stop, dir AS ce_dir, buy AS ce_buy_signal, sell AS ce_sell_signal, dir = 1 AS ce_state_long, dir = -1 AS ce_state_short FROM ce""")
def _(T):
    return tr.chandelier(bars(T), 10, 1.5)


CVD = """cv1 AS (SELECT *, least(greatest(0.7 * coalesce(((close - low) - (high - close)) / nullif(high - low, 0), 0) + 0.3 * coalesce((close - open) / nullif(high - low, 0), 0), -1), 1) AS pr FROM bars),
cv2 AS (SELECT *, volume * pr AS dl, sum(volume * pr) OVER (PARTITION BY symbol, cast(t AS date) ORDER BY bar_no) AS cvd FROM cv1),
cv3 AS (SELECT *, CASE WHEN count(*) OVER pw >= 5 THEN max(close) OVER pw END AS ph, CASE WHEN count(*) OVER pw >= 5 THEN min(close) OVER pw END AS pl, CASE WHEN count(*) OVER pw >= 5 THEN max(cvd) OVER pw END AS ch,
  CASE WHEN count(*) OVER pw >= 5 THEN min(cvd) OVER pw END AS cl, round(cvd - lag(cvd, 3) OVER (PARTITION BY symbol, cast(t AS date) ORDER BY bar_no), 9) AS sl FROM cv2
  WINDOW pw AS (PARTITION BY symbol, cast(t AS date) ORDER BY bar_no ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING)),
cvd AS (SELECT *, NOT coalesce(close > ph AND cvd <= ch, false) AS long_ok, NOT coalesce(close < pl AND cvd >= cl, false) AS short_ok, coalesce(sl >= 0, false) AS sl_long, coalesce(sl <= 0, false) AS sl_short FROM cv3)"""


@query("volume_delta", "symbol:s bar_no:i cvd_pressure:d cvd_delta_proxy:d cvd_session:d cvd_price_prev_high:d cvd_price_prev_low:d cvd_prev_high:d cvd_prev_low:d cvd_slope:d cvd_classic_long_ok:b cvd_classic_short_ok:b cvd_slope_long_ok:b cvd_slope_short_ok:b",
       BARS + ", " + CVD + """ SELECT symbol, bar_no, pr AS cvd_pressure, dl AS cvd_delta_proxy, cvd AS cvd_session, ph AS cvd_price_prev_high, pl AS cvd_price_prev_low, ch AS cvd_prev_high, cl AS cvd_prev_low, sl AS cvd_slope,
  long_ok AS cvd_classic_long_ok, short_ok AS cvd_classic_short_ok, sl_long AS cvd_slope_long_ok, sl_short AS cvd_slope_short_ok FROM cvd""")
def _(T):
    return ind.cvd_divergence(ind.pseudo_cvd(bars(T)), 5, 3)


def rule_frame(T):
    from ..operators.durable import durable
    return tr.chandelier(durable(tr.rule_base(bars(T), zlsma=20, rank=40, cvd_lookback=5)), 10, 1.5)


KAMA_SRC = """, kq AS (SELECT *, (high + low + close) / 3 AS p FROM bars), kd AS (SELECT *, abs(p - lag(p) OVER w) AS stp, abs(p - lag(p, 9) OVER w) AS mv FROM kq WINDOW w AS (PARTITION BY symbol ORDER BY bar_no)),
ks AS MATERIALIZED (SELECT *, power(coalesce(mv / nullif(CASE WHEN count(stp) OVER w9 >= 9 THEN sum(stp) OVER w9 END, 0), 0) * (2.0::double / 3 - 2.0::double / 31) + 2.0::double / 31, 2) AS sc FROM kd WINDOW w9 AS (PARTITION BY symbol ORDER BY bar_no ROWS 8 PRECEDING))"""


def _zl(n: int) -> str:
    return f"""zl1 AS (SELECT symbol, bar_no, p, CASE WHEN bar_no >= {n - 1} THEN regr_intercept(p, bar_no) {win(n)} + regr_slope(p, bar_no) {win(n)} * bar_no END AS l1 FROM kq),
zl AS (SELECT symbol, bar_no, CASE WHEN bar_no >= {2 * n - 2} THEN 2 * l1 - (regr_intercept(l1, bar_no) {win(n)} + regr_slope(l1, bar_no) {win(n)} * bar_no) END AS z FROM zl1)"""


RULE = scan_sql(ce_sql(CTR, 10, "1.5") + KAMA_SRC, {"k": "CASE WHEN r.bar_no = 8 THEN r.p END"}, {"k": "CASE WHEN r.bar_no = 8 THEN r.p WHEN r.bar_no > 8 THEN p.k + r.sc * (r.p - p.k) END"}, "kscan", "ks") + ", " + _zl(20) + """,
rule0 AS (SELECT b.*, k, z, buy, sell, coalesce(k / lag(k) OVER w - 1, 0) AS kslope, coalesce(z / nullif(lag(z) OVER w, 0) - 1, 0) AS zslope,
  coalesce(last_value(CASE WHEN buy THEN true WHEN sell THEN false END IGNORE NULLS) OVER u, false) AS la, coalesce(last_value(CASE WHEN sell THEN true WHEN buy THEN false END IGNORE NULLS) OVER u, false) AS sa
  FROM bars b JOIN kscan USING (symbol, bar_no) JOIN zl USING (symbol, bar_no) JOIN ce USING (symbol, bar_no) WINDOW w AS (PARTITION BY symbol ORDER BY bar_no), u AS (PARTITION BY symbol ORDER BY bar_no ROWS UNBOUNDED PRECEDING)),
rule1 AS (SELECT *, (buy AND coalesce(close > z AND close > k, false)) OR (la AND coalesce(k > z, false) AND kslope > 0) AS ra, (sell AND coalesce(close < z AND close < k, false)) OR (sa AND coalesce(k < z, false) AND kslope < 0) AS rb FROM rule0)"""


@query("rule_entries", "symbol:s bar_no:i long_entry:b short_entry:b long_confirmed:b short_confirmed:b", RULE + f"""
SELECT symbol, bar_no, ra AS long_entry, rb AS short_entry, coalesce({lagw('ra')} AND cast({lagw('t')} AS date) = cast(t AS date) AND close > open, false) AS long_confirmed,
  coalesce({lagw('rb')} AND cast({lagw('t')} AS date) = cast(t AS date) AND close < open, false) AS short_confirmed FROM rule1""")
def _(T):
    d = tr.entry_signals(rule_frame(T))
    d = tr.entry_signals(d.withColumnsRenamed({"long_entry": "le", "short_entry": "se"}), confirmation="next_bar_body")
    return d.withColumnsRenamed({"long_entry": "long_confirmed", "short_entry": "short_confirmed"}).withColumnsRenamed({"le": "long_entry", "se": "short_entry"})


COMBOS = {"ce": ["ce"], "trend": ["trend"], "gap": ["gap"], "ce_trend": ["ce", "trend"], "trend_gap": ["trend", "gap"], "all": ["ce", "trend", "gap"]}


@query("signal_combinations", "symbol:s bar_no:i strategy:s signal:i", RULE + f""", q AS (SELECT *, coalesce(low > {lagw('high')}, false) AS gu, coalesce(high < {lagw('low')}, false) AS gd, coalesce(close > k, false) AS tu, coalesce(close < k, false) AS td FROM rule1)
SELECT symbol, bar_no, unnest(['ce', 'trend', 'gap', 'ce_trend', 'trend_gap', 'all']) AS strategy, unnest([buy::int - sell::int, tu::int - td::int, gu::int - gd::int, (buy AND tu)::int - (sell AND td)::int, (tu AND gu)::int - (td AND gd)::int,
  (buy AND tu AND gu)::int - (sell AND td AND gd)::int]) AS signal FROM q""")
def _(T):
    d = in_chunks(rule_frame(T), lambda x, f: x.withColumns({"gu": F.col("low") > f.lag("high"), "gd": F.col("high") < f.lag("low")}), history=1)
    k, m = F.col("close"), F.col("kama")
    return tr.combinations(d, {"ce": (F.col("ce_buy_signal"), F.col("ce_sell_signal")), "trend": (k > m, k < m), "gap": (F.col("gu"), F.col("gd"))}, COMBOS)


@query("point_of_control", "symbol:s bar_no:i session_poc:d poc_dist_atr:d poc_slope:d poc_acceptance:d poc_factor:d", BARS + ", " + A20 + """, b AS (SELECT *, round_even((high + low + close) / 3 / 10, 0) * 10 AS bk, cast(t AS date) AS day FROM atr20),
h AS (SELECT x.symbol, x.bar_no, x.close, y.bk, sum(y.volume) AS v FROM b x JOIN b y ON x.symbol = y.symbol AND x.day = y.day AND y.bar_no <= x.bar_no GROUP BY 1, 2, 3, 4),
p AS (SELECT symbol, bar_no, first(bk ORDER BY v DESC, abs(bk - close), bk) AS poc FROM h GROUP BY 1, 2), q AS (SELECT b.*, poc, close - poc AS d, poc - lag(poc) OVER (PARTITION BY symbol ORDER BY bar_no) AS sl FROM b JOIN p USING (symbol, bar_no)),
n AS (SELECT *, avg(coalesce((abs(d) <= 0.2 * atr)::int, 0)) """ + win(20) + """ AS acc FROM q)
SELECT symbol, bar_no, poc AS session_poc, d / atr AS poc_dist_atr, sl AS poc_slope, acc AS poc_acceptance, 0.5 * -coalesce(least(abs(d / atr), 3) / 3, 0) + 0.3 * (acc * 2 - 1) + 0.2 * sign(coalesce(sl, 0)) AS poc_factor FROM n""")
def _(T):
    return ind.session_poc(in_chunks(bars(T), with_atr, history=20), "atr", tick=10.0)


PIV = """pv AS MATERIALIZED (SELECT *, CASE WHEN count(*) OVER a = {2 * s + 1} AND high = max(high) OVER a THEN high END AS sh0, CASE WHEN count(*) OVER a = {2 * s + 1} AND low = min(low) OVER a THEN low END AS sl0,
  CASE WHEN count(*) OVER i = 11 AND high = max(high) OVER i THEN high END AS ih0, CASE WHEN count(*) OVER i = 11 AND low = min(low) OVER i THEN low END AS il0 FROM bars
  WINDOW a AS (PARTITION BY symbol ORDER BY bar_no ROWS BETWEEN {s} PRECEDING AND {s} FOLLOWING), i AS (PARTITION BY symbol ORDER BY bar_no ROWS BETWEEN 5 PRECEDING AND 5 FOLLOWING)),
pq AS MATERIALIZED (SELECT *, lag(sh0, {s}) OVER w AS sh, lag(sl0, {s}) OVER w AS sl, lag(ih0, 5) OVER w AS ih, lag(il0, 5) OVER w AS il, coalesce(lag(close) OVER w, close) AS pc FROM pv WINDOW w AS (PARTITION BY symbol ORDER BY bar_no))""".replace("{2 * s + 1}", "31").replace("{s}", "15")


def _brk(hi: str, lo: str, pre: str, up: str, dn: str, extra_up: str = "true", extra_dn: str = "true") -> dict[str, str]:
    """State expressions of one pivot family; `new` levels are the confirmed pivot or the one before."""
    h, l = f"coalesce(r.{hi}, p.{pre}h)", f"coalesce(r.{lo}, p.{pre}l)"
    bu = f"(r.pc <= {h} AND {h} < r.close AND (r.{hi} IS NOT NULL OR NOT p.{pre}hc) AND {extra_up})"
    bd = f"(r.pc >= {l} AND {l} > r.close AND (r.{lo} IS NOT NULL OR NOT p.{pre}lc) AND {extra_dn})"
    return {f"{pre}h": h, f"{pre}l": l, f"{pre}hc": f"(CASE WHEN r.{hi} IS NOT NULL THEN false ELSE p.{pre}hc END) OR coalesce({bu}, false)",
            f"{pre}lc": f"(CASE WHEN r.{lo} IS NOT NULL THEN false ELSE p.{pre}lc END) OR coalesce({bd}, false)",
            f"{pre}hi": f"CASE WHEN r.{hi} IS NOT NULL THEN r.bar_no - {'15' if pre == 's' else '5'} ELSE p.{pre}hi END", f"{pre}li": f"CASE WHEN r.{lo} IS NOT NULL THEN r.bar_no - {'15' if pre == 's' else '5'} ELSE p.{pre}li END",
            up: f"coalesce({bu}, false)", dn: f"coalesce({bd}, false)",
            f"{pre}t": f"CASE WHEN coalesce({bd}, false) THEN -1 WHEN coalesce({bu}, false) THEN 1 ELSE p.{pre}t END", f"{pre}t0": f"p.{pre}t"}


_S = _brk("sh", "sl", "s", "sbu", "sbd")
_I = _brk("ih", "il", "i", "ibu", "ibd", f"coalesce(coalesce(r.ih, p.ih) <> {_S['sh']}, true)", f"coalesce(coalesce(r.il, p.il) <> {_S['sl']}, true)")
_ZERO = {k: ("false" if k[-1] == "c" or k.endswith(("bu", "bd")) else "0" if k.endswith(("t", "t0")) else "NULL::bigint" if k in ("shi", "sli", "ihi", "ili") else "NULL::double") for k in {**_S, **_I}}
EVENTS = scan_sql(BARS_REC + ", " + PIV, _ZERO, {**_S, **_I}, "ev", "pq")


@query("structure_events", "symbol:s bar_no:i swing_pivot_high:d swing_pivot_low:d internal_pivot_high:d internal_pivot_low:d swing_bullish_bos:b swing_bullish_choch:b swing_bearish_bos:b swing_bearish_choch:b "
       "internal_bullish_bos:b internal_bullish_choch:b internal_bearish_bos:b internal_bearish_choch:b", EVENTS + """
SELECT symbol, bar_no, pq.sh AS swing_pivot_high, pq.sl AS swing_pivot_low, pq.ih AS internal_pivot_high, pq.il AS internal_pivot_low, sbu AND st0 <> -1 AS swing_bullish_bos, sbu AND st0 = -1 AS swing_bullish_choch,
  sbd AND (CASE WHEN sbu THEN 1 ELSE st0 END) <> 1 AS swing_bearish_bos, sbd AND (CASE WHEN sbu THEN 1 ELSE st0 END) = 1 AS swing_bearish_choch, ibu AND it0 <> -1 AS internal_bullish_bos, ibu AND it0 = -1 AS internal_bullish_choch,
  ibd AND (CASE WHEN ibu THEN 1 ELSE it0 END) <> 1 AS internal_bearish_bos, ibd AND (CASE WHEN ibu THEN 1 ELSE it0 END) = 1 AS internal_bearish_choch FROM ev JOIN pq USING (symbol, bar_no)""")
def _(T):
    return ms.structure_events(bars(T), 15, 5)


OB = scan_sql(EVENTS + ", ctr AS MATERIALIZED" + TRUE_RANGE, {"a": "r.tr"}, {"a": ema_step("a", "r.tr", "(1.0::double / 30)")}, "ascan", "ctr") + """,
pz AS MATERIALIZED (SELECT bars.*, CASE WHEN bar_no >= 29 AND high - low >= 2 * a THEN low ELSE high END AS phi, CASE WHEN bar_no >= 29 AND high - low >= 2 * a THEN high ELSE low END AS plo FROM bars JOIN ascan USING (symbol, bar_no)),
bu AS (SELECT e.symbol, e.bar_no, first(phi ORDER BY plo, z.bar_no) AS top, first(plo ORDER BY plo, z.bar_no) AS bottom FROM ev e JOIN pz z ON z.symbol = e.symbol AND z.bar_no BETWEEN e.shi AND e.bar_no WHERE sbu GROUP BY 1, 2),
be AS (SELECT e.symbol, e.bar_no, first(phi ORDER BY phi DESC, z.bar_no) AS top, first(plo ORDER BY phi DESC, z.bar_no) AS bottom FROM ev e JOIN pz z ON z.symbol = e.symbol AND z.bar_no BETWEEN e.sli AND e.bar_no WHERE sbd GROUP BY 1, 2)"""


def alive(zone: str, name: str, cond: str) -> str:
    """CTE: newest zone per bar whose life has not ended; `cond` tells when bar b breaks zone z."""
    return f"""{name}_d AS (SELECT z.symbol, z.bar_no, z.top, z.bottom, min(b.bar_no) AS dead FROM {zone} z LEFT JOIN bars b ON b.symbol = z.symbol AND b.bar_no >= z.bar_no AND {cond} GROUP BY 1, 2, 3, 4),
{name} AS (SELECT b.symbol, b.bar_no, arg_max(z.top, z.bar_no) AS top, arg_max(z.bottom, z.bar_no) AS bottom FROM bars b JOIN {name}_d z ON z.symbol = b.symbol AND z.bar_no <= b.bar_no AND (dead IS NULL OR dead > b.bar_no) GROUP BY 1, 2)"""


@query("order_blocks", "symbol:s bar_no:i bullish_order_block_top:d bullish_order_block_bottom:d bearish_order_block_top:d bearish_order_block_bottom:d active_bullish_ob_top:d active_bullish_ob_bottom:d active_bearish_ob_top:d active_bearish_ob_bottom:d",
       OB + ", " + alive("bu", "abu", "b.low < z.bottom") + ", " + alive("be", "abe", "b.high > z.top") + """
SELECT b.symbol, b.bar_no, bu.top AS bullish_order_block_top, bu.bottom AS bullish_order_block_bottom, be.top AS bearish_order_block_top, be.bottom AS bearish_order_block_bottom, abu.top AS active_bullish_ob_top, abu.bottom AS active_bullish_ob_bottom,
  abe.top AS active_bearish_ob_top, abe.bottom AS active_bearish_ob_bottom FROM bars b LEFT JOIN bu USING (symbol, bar_no) LEFT JOIN be USING (symbol, bar_no) LEFT JOIN abu USING (symbol, bar_no) LEFT JOIN abe USING (symbol, bar_no)""")
def _(T):
    return ms.order_blocks(bars(T), 15, 30)


FVG = f"""fg AS (SELECT *, coalesce(({lagw('close')} - {lagw('open')}) / nullif({lagw('open')}, 0), 0) AS d FROM bars), fh AS (SELECT *, 2 * avg(abs(d)) OVER (PARTITION BY symbol ORDER BY bar_no) AS thr FROM fg),
fi AS (SELECT *, coalesce(low > {lagw('high', 2)} AND {lagw('close')} > {lagw('high', 2)} AND d > thr, false) AS up, coalesce(high < {lagw('low', 2)} AND {lagw('close')} < {lagw('low', 2)} AND -d > thr, false) AS dn, {lagw('high', 2)} AS h2, {lagw('low', 2)} AS l2 FROM fh),
fu AS (SELECT symbol, bar_no, low AS top, h2 AS bottom FROM fi WHERE up), fd AS (SELECT symbol, bar_no, l2 AS top, high AS bottom FROM fi WHERE dn)"""


@query("fair_value_gaps", "symbol:s bar_no:i bullish_fvg:b bearish_fvg:b bullish_fvg_top:d bullish_fvg_bottom:d bearish_fvg_top:d bearish_fvg_bottom:d active_bullish_fvg_top:d active_bullish_fvg_bottom:d active_bearish_fvg_top:d active_bearish_fvg_bottom:d",
       BARS + ", " + FVG + ", " + alive("fu", "afu", "b.low < z.bottom") + ", " + alive("fd", "afd", "b.high > z.top") + """
SELECT fi.symbol, fi.bar_no, up AS bullish_fvg, dn AS bearish_fvg, fu.top AS bullish_fvg_top, fu.bottom AS bullish_fvg_bottom, fd.top AS bearish_fvg_top, fd.bottom AS bearish_fvg_bottom, afu.top AS active_bullish_fvg_top, afu.bottom AS active_bullish_fvg_bottom,
  afd.top AS active_bearish_fvg_top, afd.bottom AS active_bearish_fvg_bottom FROM fi LEFT JOIN fu USING (symbol, bar_no) LEFT JOIN fd USING (symbol, bar_no) LEFT JOIN afu USING (symbol, bar_no) LEFT JOIN afd USING (symbol, bar_no)""")
def _(T):
    return ms.fair_value_gaps(bars(T))


BO_COLS = "bo_body_atr bo_range_atr bo_vol_spike bo_close_extremity bo_wick_imbalance bo_range_compress bo_body_growth bo_gap_signal bo_consec_dir bo_inside_prior bo_pressure_diff bo_bb_width bo_atr_zscore".split()


def breakout_frame(T):
    d = pa.pressure_score(seq.direction_runs(bars(T)))
    d = in_chunks(shapes.bar_anatomy(d), lambda x, f: with_atr(shapes.bar_shape(x, f), f), history=20)
    return in_chunks(d, lambda x, f: cx.breakout_features(x, f, "atr"), history=500)


BO = PRESSURE.format(src="atr20") + f""", c1 AS (SELECT *, sign(close - open) AS dsg, coalesce((sign(close - open) <> {lagw('sign(close - open)')})::int, 1) AS chg FROM p5), c2 AS (SELECT *, sum(chg) OVER (PARTITION BY symbol ORDER BY bar_no) AS isl FROM c1),
c3 AS (SELECT *, row_number() OVER (PARTITION BY symbol, isl ORDER BY bar_no) AS rn, greatest(atr, 0.001) AS sa0, CASE WHEN atr > 0.001 THEN atr ELSE 0.001 END AS sa, high - low AS rg, greatest(high - low, 1e-6) AS sr, abs(close - open) AS bb, (high + low + close) / 3 AS tp,
  {lagw('high')} AS ph, {lagw('low')} AS pl FROM c2),
bo AS MATERIALIZED (SELECT *, bb / sa AS bo_body_atr, rg / sa AS bo_range_atr, volume / avg(volume) {win(20)} AS bo_vol_spike, CASE WHEN close >= open THEN close - low ELSE high - close END / sr AS bo_close_extremity,
  ((close - low) - (high - close)) / sr AS bo_wick_imbalance, avg(rg) {win(5)} / greatest(avg(rg) {win(20)}, 1e-6) AS bo_range_compress, bb / greatest(avg(bb) {win(5)}, 1e-6) AS bo_body_growth,
  coalesce((low > ph)::int, 0) - coalesce((high < pl)::int, 0) AS bo_gap_signal, CASE WHEN close >= open THEN CASE WHEN dsg = 1 THEN rn ELSE 0 END ELSE -CASE WHEN dsg = -1 THEN rn ELSE 0 END END AS bo_consec_dir,
  coalesce({lagw('(high <= ph AND low >= pl)::int')}, 0) AS bo_inside_prior, bp - ep AS bo_pressure_diff, 4 * coalesce(stddev_samp(tp) {win(20)}, 0) / avg(tp) {win(20)} AS bo_bb_width,
  (sa - avg(sa) {win(500)}) / greatest(coalesce(stddev_samp(sa) {win(500)}, 1e-6), 1e-6) AS bo_atr_zscore FROM c3)"""


@query("breakout_features", "symbol:s bar_no:i " + " ".join(f"{n}:d" for n in BO_COLS) + " composite:d active:i clock:d", BARS + ", " + A20 + ", " + BO + " SELECT *, (" + " + ".join(f"tanh(least(greatest({n}, -5), 5))" for n in BO_COLS)
       + f") / {len(BO_COLS)} AS composite, (abs(bo_range_atr) > 0.02)::int AS active, least(greatest((hour(t) * 60 + minute(t)) / 1440.0 * bo_range_atr, -1e4), 1e4) AS clock FROM bo")
def _(T):
    from ..functions.exprs import minute_of_day
    return breakout_frame(T).withColumns({"composite": cx.breakout_composite(breakout_frame(T), BO_COLS), "active": (F.abs("bo_range_atr") > 0.02).cast("int"),
                                          "clock": cx.interaction(minute_of_day("t") / 1440.0, "bo_range_atr")})


def u(x: str) -> str:
    return f"least(greatest({x}, 0), 1)"


CTX_IN = f"""cin AS (SELECT *, {u('0.5 + 0.5 * tanh(bo_pressure_diff / 2)')} AS pressure_long, {u('0.5 - 0.5 * tanh(bo_pressure_diff / 2)')} AS pressure_short, {u('0.5 + 0.5 * tanh(bo_consec_dir / 3)')} AS consec_long, {u('0.5 - 0.5 * tanh(bo_consec_dir / 3)')} AS consec_short,
  {u('0.5 + 0.5 * tanh(bo_gap_signal)')} AS gap_long, {u('0.5 - 0.5 * tanh(bo_gap_signal)')} AS gap_short, 0.5::double AS or_long, 0.5::double AS or_short, {u('bo_close_extremity')} AS close_long, {u('1 - bo_close_extremity')} AS close_short,
  {u('bo_body_growth / 2.5')} AS body_push, {u('bo_range_atr / 3')} AS range_push, {u('1 - ' + u('bo_range_compress / 1.5'))} AS tight, {u('1 - tanh(greatest(bo_bb_width, 0) * 2)')} AS bb_tight, {u('td')} AS trend_long, {u('-td')} AS trend_short, {u('tscore')} AS trend_score,
  {u('rscore')} AS range_score, {u('greatest(bfail, ' + u('rscore') + ' * 0.75)')} AS breakout_fail, 0::double AS weakened, {u('(0.75 - 0.5) / 0.45')} AS resume, 0::double AS second_long, 0::double AS second_short, 0::double AS pullback_long, 0::double AS pullback_short, 0::double AS open_ctx, bo_inside_prior AS inside,
  1 - abs(bo_pressure_diff) / (abs(bo_pressure_diff) + 1) AS calm FROM (SELECT *, sign(close - open) AS td, bo_close_extremity * 0.8 AS tscore, 1 - bo_close_extremity AS rscore, (volume > 4)::int AS bfail FROM bo))"""


def _lin(weights, s, o):
    return u(" + ".join(f"({w}) * {n.format(s=s, o=o)}" for n, w in weights.items()))


CTX = CTX_IN + ", cx1 AS (SELECT *, " + ", ".join(f"{_lin(w, s, o)} AS {n.format(s=s)}" for n, w in cx.SETUP.items() for s, o in cx.SIDES) + f""" FROM cin),
cx2 AS (SELECT *, {', '.join('greatest(' + ', '.join(f'pa_ctx_setup_{x}_{s}' for x in ('trend', 'pullback', 'range', 'failed_breakout')) + f') AS pa_ctx_setup_{s}' for s in ('long', 'short'))},
  {u('0.5 * range_score + 0.18 * tight + 0.12 * bb_tight + 0.1 * inside + 0.1 * calm')} AS pa_ctx_range_pressure FROM cx1),
cx3 AS (SELECT *, {u('0.42 * pa_ctx_range_pressure + 0.28 * breakout_fail + 0.18 * weakened + 0.12 * (1 - greatest(pa_ctx_follow_through_long, pa_ctx_follow_through_short))')} AS pa_ctx_structure_veto FROM cx2),
ctx AS (SELECT *, {u('0.42 * pa_ctx_structure_veto + 0.22 * pa_ctx_setup_short + 0.2 * greatest(pa_ctx_follow_through_short - pa_ctx_follow_through_long, 0) + 0.16 * pa_ctx_range_pressure')} AS pa_ctx_premise_break_long,
  {u('0.42 * pa_ctx_structure_veto + 0.22 * pa_ctx_setup_long + 0.2 * greatest(pa_ctx_follow_through_long - pa_ctx_follow_through_short, 0) + 0.16 * pa_ctx_range_pressure')} AS pa_ctx_premise_break_short FROM cx3)"""
CTX_COLS = [n.format(s=s) for n in cx.SETUP for s, _ in cx.SIDES] + [f"pa_ctx_setup_{s}" for s, _ in cx.SIDES] + ["pa_ctx_range_pressure", "pa_ctx_structure_veto", "pa_ctx_premise_break_long", "pa_ctx_premise_break_short"]


def context_frame(T):
    from ..operators.durable import durable
    d = durable(breakout_frame(T))
    d = d.withColumns({"pa_env_trend_dir": F.signum(F.col("close") - F.col("open")), "pa_env_trend_score_ratio": F.col("bo_close_extremity") * 0.8,
                       "pa_env_range_score_ratio": 1 - F.col("bo_close_extremity"), "pa_breakout_likely_fail": (F.col("volume") > 4).cast("int")})
    return cx.structure_context(d)


@query("structure_context", "symbol:s bar_no:i " + " ".join(f"{n}:d" for n in CTX_COLS), BARS + ", " + A20 + ", " + BO + ", " + CTX + " SELECT * FROM ctx")
def _(T):
    return context_frame(T)


def _mx(n: str) -> str:
    return f"greatest(pa_ctx_{n}_long, pa_ctx_{n}_short)"


STATE = f"""s1 AS (SELECT *, {_mx('setup_trend')} AS mtr, {_mx('setup_pullback')} AS mpu, {_mx('setup_range')} AS mra, {_mx('setup_failed_breakout')} AS mfb, {_mx('setup')} AS mst, {_mx('follow_through')} AS mfo, {_mx('premise_break')} AS mpb,
  tanh(2.4 * ((0.58 * pa_ctx_setup_trend_long + 0.42 * pa_ctx_follow_through_long + 0.18 * pa_ctx_setup_long) - (0.58 * pa_ctx_setup_trend_short + 0.42 * pa_ctx_follow_through_short + 0.18 * pa_ctx_setup_short))) AS always_in_bias FROM ctx),
s2 AS (SELECT *, {u('0.3 * mtr + 0.2 * mfo + 0.14 * mst + 0.12 * ' + u('tscore') + ' + 0.1 * abs(always_in_bias) + 0.08 * (1 - pa_ctx_range_pressure) + 0.06 * (1 - pa_ctx_structure_veto)')} AS trend_strength FROM s1),
sta AS (SELECT *, {u('0.46 * mfo + 0.14 * trend_strength + 0.1 * abs(always_in_bias) + 0.08 * (1 - bfail) - 0.14 * pa_ctx_range_pressure - 0.08 * pa_ctx_structure_veto - 0.06 * mfb')} AS followthrough_quality,
  {u('0.38 * pa_ctx_range_pressure + 0.2 * mra + 0.14 * pa_ctx_structure_veto + 0.1 * mfb + 0.1 * (1 - mfo) + 0.08 * ' + u('rscore'))} AS range_risk, {u('0.24 * mpu + 0.12 * pa_ctx_range_pressure + 0.08 * mpb + 0.06 * mfb')} AS pullback_exhaustion,
  {u('0.4 * mfb + 0.18 * bfail + 0.14 * pa_ctx_structure_veto + 0.12 * pa_ctx_range_pressure + 0.08 * (1 - mfo) + 0.08 * ' + u('rscore'))} AS breakout_failure_risk FROM s2)"""


@query("state_scores", "symbol:s bar_no:i " + " ".join(f"pa_state_{n}:d" for n in cx.STATE_COLS) + " bucket:s " + " ".join(f"mod_{n}:d" for n in cx.MODULATION), BARS + ", " + A20 + ", " + BO + ", " + CTX + ", " + STATE + " SELECT symbol, bar_no, "
       + ", ".join(f"{n} AS pa_state_{n}" for n in cx.STATE_COLS) + """, CASE WHEN breakout_failure_risk >= 0.6 THEN 'breakout_risky' WHEN pullback_exhaustion >= 0.58 AND trend_strength <= 0.72 THEN 'pullback_late' WHEN range_risk >= 0.57 THEN 'range_or_uncertain'
  WHEN trend_strength >= 0.56 AND followthrough_quality >= 0.52 AND abs(always_in_bias) >= 0.12 THEN 'trend_confirmed' ELSE 'neutral' END AS bucket, """
       + ", ".join("least(greatest(1 + " + " + ".join(f"({w}) * {n}" for n, w in ws.items()) + f", {lo}), {hi}) AS mod_{k}" for k, (ws, (lo, hi)) in cx.MODULATION.items()) + " FROM sta")
def _(T):
    d = cx.state_scores(context_frame(T))
    return d.withColumns({"bucket": cx.state_bucket(), **{f"mod_{k}": cx.modulation(k) for k in cx.MODULATION}})


@query("structure_tags", "symbol:s bar_no:i tags:s", BARS + f""" SELECT symbol, bar_no, coalesce(nullif(concat_ws(', ', CASE WHEN close > open AND volume > 3 THEN 'StrongBullTrend' END, CASE WHEN close < open AND volume > 3 THEN 'StrongBearTrend' END,
  CASE WHEN low > {lagw('high')} THEN 'BreakoutUp' END, CASE WHEN high < {lagw('low')} THEN 'BreakoutDown' END), ''), 'None') AS tags FROM bars""")
def _(T):
    def build(d, f):
        k, o, v = F.col("close"), F.col("open"), F.col("volume")
        return d.withColumn("tags", cx.structure_tags({"StrongBullTrend": (k > o) & (v > 3), "StrongBearTrend": (k < o) & (v > 3),
                                                       "BreakoutUp": F.col("low") > f.lag("high"), "BreakoutDown": F.col("high") < f.lag("low")}))
    return in_chunks(bars(T), build, history=1)


@query("probability_features", "symbol:s bar_no:i entropy:d gap:d kl:d change:d dist:d pressure:d", BARS + f""", p AS (SELECT symbol, bar_no, list_transform([open, high, low, close, volume], lambda x: x / (open + high + low + close + volume)) AS ps, close FROM bars),
q AS (SELECT *, {lagw('ps')} AS pp, list_reverse_sort(ps) AS so FROM p)
SELECT symbol, bar_no, -list_sum(list_transform(ps, lambda x: x * ln(x))) AS entropy, so[1] - so[2] AS gap, list_sum([ps[i] * (ln(ps[i]) - ln(0.2)) FOR i IN range(1, 6)]) AS kl, coalesce(0.5 * list_sum([abs(ps[i] - pp[i]) FOR i IN range(1, 6)]), 0) AS change,
  sqrt(list_sum([power(ps[i] - 0.2, 2) FOR i IN range(1, 6)])) AS dist, close / 50 / greatest(-list_sum(list_transform(ps, lambda x: x * ln(x))), 1e-4) AS pressure FROM q""")
def _(T):
    flat = F.array(*[F.lit(0.2)] * 5)
    d = bars(T).withColumn("raw", F.array("open", "high", "low", "close", "volume"))
    d = d.withColumn("ps", cx.normalised("raw"))
    d = d.withColumns({"entropy": cx.entropy("ps"), "gap": cx.top2_gap("ps"), "kl": cx.kl("ps", flat), "dist": cx.l2_distance("ps", flat)})
    d = d.withColumn("pressure", F.col("close") / 50 / F.greatest(F.col("entropy"), F.lit(1e-4)))
    return in_chunks(d, lambda x, f: x.withColumn("change", cx.change_score(f, "ps")), history=1)
