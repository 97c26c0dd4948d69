"""Bars, trades and scores derived from the given tables, for Spark and for SQL."""
from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..operators.layout import number_rows
from ..operators.resample import tick_bars

WIDTH = "1 hour"


def bars(T, width: str = WIDTH) -> DataFrame:
    """Closed right-edge bars of `events` by event type, numbered."""
    return number_rows(tick_bars(T("events"), width, symbol="event_type", t="ts", price="value", tie="event_id"))


def bars_cte(width: str = "1 HOUR", name: str = "bars") -> str:
    return f"""{name}_raw AS (
  SELECT event_type AS symbol, time_bucket(INTERVAL {width}, ts) + INTERVAL {width} AS t,
         first(value ORDER BY ts, event_id) AS open, max(value) AS high, min(value) AS low,
         last(value ORDER BY ts, event_id) AS close, cast(count(*) AS double) AS volume, max(ts) AS newest
  FROM events GROUP BY 1, 2),
{name} AS (
  SELECT symbol, t, open, high, low, close, volume,
         row_number() OVER (PARTITION BY symbol ORDER BY t) - 1 AS bar_no
  FROM (SELECT *, max(newest) OVER (PARTITION BY symbol) AS last_row FROM {name}_raw)
  WHERE t <= last_row)"""


BARS = "WITH " + bars_cte()
BARS_REC = "WITH RECURSIVE " + bars_cte()


def trades(T) -> DataFrame:
    """A trade log from order lines: entry on the order day, exit on the ship day."""
    o = T("orders").select("o_orderkey", "o_custkey", "o_orderdate", "o_orderpriority")
    li = T("lineitem")
    j = li.join(o, li.l_orderkey == o.o_orderkey).where("l_shipdate > o_orderdate")
    return j.select(
        F.concat(F.lit("S"), (F.col("l_suppkey") % 7).cast("string")).alias("symbol"),
        F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.col("l_quantity").cast("int"),
                    F.round(F.col("l_extendedprice") * 100).cast("bigint")).alias("trade_id"),
        F.col("o_orderdate").alias("entry_time"),
        F.col("l_shipdate").alias("exit_time"),
        F.round(F.col("l_discount") - F.col("l_tax"), 2).alias("ret"),
        F.substring("o_orderpriority", 1, 1).cast("int").alias("regime"),
        F.datediff("l_shipdate", "o_orderdate").alias("hold"),
        F.col("l_returnflag").alias("driver"),
        F.col("l_linestatus").alias("reason"),
        (F.col("o_custkey") % 5).cast("int").alias("book"),
    )


TRADES_CTE = """trades AS (
  SELECT 'S' || cast(l_suppkey % 7 AS varchar) AS symbol,
         concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey, cast(l_quantity AS int),
                   cast(round(l_extendedprice * 100) AS bigint)) AS trade_id,
         o_orderdate AS entry_time, l_shipdate AS exit_time, round(l_discount - l_tax, 2) AS ret,
         cast(substr(o_orderpriority, 1, 1) AS int) AS regime,
         date_diff('day', cast(o_orderdate AS date), cast(l_shipdate AS date)) AS hold,
         l_returnflag AS driver, l_linestatus AS reason, o_custkey % 5 AS book
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE l_shipdate > o_orderdate)"""
TRADES = "WITH " + TRADES_CTE
