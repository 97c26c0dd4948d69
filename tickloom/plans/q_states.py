"""Queries: state machines over long keys, against recursive SQL."""
from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import states, trade_log as tl, trend_rules as tr
from .catalog import query
from .data import BARS_REC, TRADES_CTE, bars, trades
from .q_structure import RULE
from .q_vol import win
from .q_windows import ema_step, scan_sql

LIMIT = 25
CAP = scan_sql(f"""WITH RECURSIVE {TRADES_CTE}, src AS MATERIALIZED (SELECT cast(book AS varchar) AS symbol, ret, entry_time, exit_time, row_number() OVER (PARTITION BY book ORDER BY entry_time, symbol, trade_id) - 1 AS bar_no FROM trades)""",
               {"live": "[r.exit_time]", "kept": "true"},
               {"live": f"CASE WHEN len(list_filter(p.live, lambda x: x > r.entry_time)) < {LIMIT} THEN list_append(list_filter(p.live, lambda x: x > r.entry_time), r.exit_time) ELSE list_filter(p.live, lambda x: x > r.entry_time) END",
                "kept": f"len(list_filter(p.live, lambda x: x > r.entry_time)) < {LIMIT}"})


@query("position_cap", "book:i kept:b n:i total:d", CAP + " SELECT symbol AS book, kept, count(*) AS n, sum(ret) AS total FROM scan JOIN src USING (symbol, bar_no) GROUP BY 1, 2")
def _(T):
    got = tl.position_cap(trades(T).select("book", "symbol", "trade_id", "entry_time", "exit_time", "ret"), LIMIT, keys=("book",))
    return got.groupBy("book", "kept").agg(F.count(F.lit(1)).alias("n"), F.sum("ret").alias("total"))


SAME = "(p.reg = r.regime AND r.entry_time >= p.fin - INTERVAL 1 SECOND)"
RUNS = scan_sql(f"WITH RECURSIVE {TRADES_CTE}, src AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY entry_time, trade_id) - 1 AS bar_no FROM trades)",
                {"reg": "r.regime", "fin": "r.exit_time", "seg": "r.bar_no"},
                {"reg": "r.regime", "fin": f"CASE WHEN {SAME} THEN greatest(p.fin, r.exit_time) ELSE r.exit_time END", "seg": f"CASE WHEN {SAME} THEN p.seg ELSE r.bar_no END"})


@query("regime_segments", "symbol:s regime:i n_segments:i n_trades:i longest:i total:d", RUNS + """, g AS (SELECT symbol, regime, seg, count(*) AS n, sum(ret) AS total FROM src JOIN scan USING (symbol, bar_no) GROUP BY 1, 2, 3)
SELECT symbol, regime, count(*) AS n_segments, sum(n) AS n_trades, max(n) AS longest, sum(total) AS total FROM g GROUP BY 1, 2""")
def _(T):
    s = tl.regime_segments(trades(T))
    return s.groupBy("symbol", "regime").agg(F.count(F.lit(1)).alias("n_segments"), F.sum("n").alias("n_trades"), F.max("n").alias("longest"), F.sum("sum_return").alias("total"))


def _pick(before: str) -> str:
    """The most likely of six states after `before` (a list of six weights) and ahead of the next known one."""
    weights = f"list_transform(range(6), lambda s: {before} * CASE WHEN r.nx IS NULL THEN 1 ELSE r.tm[s * 6 + r.nx + 1] END)"
    return f"coalesce(r.st, list_position({weights}, list_max({weights})) - 1)"


FILLED = scan_sql(BARS_REC + """, st AS (SELECT symbol, bar_no, CASE WHEN volume > 2 THEN cast(least(floor(close / 20), 5) AS int) END AS st FROM bars),
pv AS (SELECT *, lag(st) OVER (PARTITION BY symbol ORDER BY bar_no) AS a, first_value(st IGNORE NULLS) OVER (PARTITION BY symbol ORDER BY bar_no ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS nx FROM st),
ct AS (SELECT symbol, a, st AS b, count(*) AS n FROM pv WHERE a IS NOT NULL AND st IS NOT NULL GROUP BY 1, 2, 3), gd AS (SELECT symbol, i // 6 AS a, i % 6 AS b FROM (SELECT DISTINCT symbol FROM bars), (SELECT unnest(range(36)) AS i)),
tc AS (SELECT g.symbol, g.a, g.b, coalesce(n, 0) + 1 AS n FROM gd g LEFT JOIN ct c ON c.symbol = g.symbol AND c.a = g.a AND c.b = g.b), tp AS (SELECT symbol, a, b, n / sum(n) OVER (PARTITION BY symbol, a) AS p FROM tc),
tm AS (SELECT symbol, list(p ORDER BY a, b) AS tm FROM tp GROUP BY symbol),
pk AS (SELECT symbol, [(count(*) FILTER (st = 0)) + 1.0::double, (count(*) FILTER (st = 1)) + 1, (count(*) FILTER (st = 2)) + 1, (count(*) FILTER (st = 3)) + 1, (count(*) FILTER (st = 4)) + 1, (count(*) FILTER (st = 5)) + 1] AS k FROM st WHERE st IS NOT NULL GROUP BY symbol),
src AS MATERIALIZED (SELECT pv.symbol, bar_no, st, nx, tm, list_transform(k, lambda x: x / list_sum(k)) AS prior FROM pv JOIN tm USING (symbol) JOIN pk USING (symbol))""",
                  {"cur": _pick("r.prior[s + 1]")}, {"cur": _pick("r.tm[p.cur * 6 + s + 1]")})


@query("state_imputation", "symbol:s bar_no:i filled:i", FILLED + " SELECT symbol, bar_no, cur AS filled FROM scan")
def _(T):
    d = bars(T).withColumn("st", F.when(F.col("volume") > 2, F.least(F.floor(F.col("close") / 20), F.lit(5)).cast("int")))
    return states.impute_states(d, "st", 6, "filled")


BASE = scan_sql(RULE, {"a14": "r.tr"}, {"a14": ema_step("a14", "r.tr", "(1.0::double / 14)")}, "atr14", "ctr") + f""",
ra AS (SELECT symbol, bar_no, k, z, kslope, zslope, CASE WHEN bar_no >= 13 THEN a14 END AS a FROM rule0 JOIN atr14 USING (symbol, bar_no)),
rb AS (SELECT *, list(a) FILTER (a IS NOT NULL) {win(40)} AS vs FROM ra)"""


@query("rule_base_features", "symbol:s bar_no:i kama:d zlsma:d kama_slope:d zlsma_slope:d atr_raw:d atr_percentile:d", BASE + """
SELECT symbol, bar_no, k AS kama, z AS zlsma, kslope AS kama_slope, zslope AS zlsma_slope, a AS atr_raw, CASE WHEN len(vs) >= 40 THEN len(list_filter(vs, lambda x: x <= a)) / 40.0 END AS atr_percentile FROM rb""")
def _(T):
    d = tr.rule_base(bars(T), zlsma=20, rank=40, cvd_lookback=5)
    return d.withColumns({n: F.coalesce(n, F.lit(0.0)) for n in ("kama_slope", "zlsma_slope")})
