"""Registry of queries: a Spark plan and, where SQL can say it, the same query in SQL.

`cols` lists the output as "name:kind": s text, i whole number, d number
(6 digits), t time, b boolean. Both sides are brought to these types.
"""
from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, functions as F

DIGITS = 6
# Decimal averages often end exactly on half a digit; the nudge takes both sides off that edge.
NUDGE = 3e-9


@dataclass(frozen=True)
class Query:
    name: str
    plan: Callable[[SparkSession, str], DataFrame]
    cols: tuple[tuple[str, str], ...]
    sql: str | None


ALL: dict[str, Query] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _spark_col(name: str, kind: str):
    x = F.col(name)
    return {
        "s": x.cast("string"),
        "i": x.cast("bigint"),
        "d": F.round(x.cast("double") + F.lit(NUDGE), DIGITS) + F.lit(0.0),
        "t": F.date_format(x, "yyyy-MM-dd HH:mm:ss"),
        "b": x.cast("boolean"),
    }[kind].alias(name)


def _sql_col(name: str, kind: str) -> str:
    return {
        "s": f"cast({name} as varchar)",
        "i": f"cast({name} as bigint)",
        "d": f"round(cast({name} as double) + {NUDGE}, {DIGITS}) + 0.0",
        "t": f"strftime({name}, '%Y-%m-%d %H:%M:%S')",
        "b": f"cast({name} as boolean)",
    }[kind] + f" AS {name}"


def stream_query(name: str, cols: str, sql: str | None = None):
    """Register a plan that needs the session and the folder, such as a stream."""
    spec = tuple(tuple(c.split(":")) for c in cols.split())

    def wrap(fn):
        if name in ALL:
            raise ValueError(f"query {name} is registered twice")

        def plan(spark: SparkSession, sf_dir: str) -> DataFrame:
            return fn(spark, sf_dir).select(*[_spark_col(n, k) for n, k in spec])

        full = None
        if sql is not None:
            picked = ", ".join(_sql_col(n, k) for n, k in spec)
            full = f"SELECT {picked} FROM (\n{sql.strip()}\n) AS result_rows"
        ALL[name] = Query(name, plan, spec, full)
        return fn

    return wrap


def query(name: str, cols: str, sql: str | None = None):
    """Register a plan `(tables) -> DataFrame`; `tables("events")` reads a table."""
    def wrap(fn):
        return stream_query(name, cols, sql)(lambda spark, sf_dir: fn(lambda t: table(spark, sf_dir, t)))
    return wrap


def load() -> dict[str, Query]:
    """Import all query modules and return the registry."""
    from importlib import import_module
    from pkgutil import iter_modules

    from . import __path__ as here
    for m in iter_modules(here):
        if m.name.startswith("q_"):
            import_module(f"{__package__}.{m.name}")
    return ALL
