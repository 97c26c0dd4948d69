"""Newest open level per row, by a tree over chunks of a key.

A level is born on a row and lives while the price stays at or above it. A level that breaks no later than a newer one can
never be the newest alive again, so the open levels form a stack with rising values. A chunk walks its own rows and knows the
answer wherever one of its own levels is alive. Elsewhere the answer is the newest level of the chunks before that is at or
below the lowest price from there to the row, and only the lows of a chunk ask for it.

A chunk is summed up by two numbers, its lowest price and the lowest level that outlives it; `FAN` neighbouring chunks, and again
`FAN` of these, likewise. A question goes back through the neighbours of its node, up to the node above if none of them has a
level low enough, and down again into the latest one that has. Every step is an equi join of the questions with one row of at
most FAN nodes, so no task holds more than a chunk, a node or its share of the questions, however many levels stay open.
"""
from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F, types as T

from .durable import durable
from .layout import chunk_rows

FAN = 1000


def own_levels(level: np.ndarray, price: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[int]]:
    """Per row the row of the newest own level alive (-1: none) and, where there is none, the lowest price so far; the open rows at the end."""
    stack: list[int] = []
    newest = np.full(len(price), -1)
    for i, (v, p) in enumerate(zip(level.tolist(), price.tolist())):
        if v == v:
            while stack and level[stack[-1]] >= v:
                stack.pop()
            stack.append(i)
        while stack and p < level[stack[-1]]:
            stack.pop()
        if stack:
            newest[i] = stack[-1]
    low = np.fmin.accumulate(np.where(np.isnan(price), np.inf, price))
    return newest, np.where(newest < 0, low, np.nan), stack


def newest_alive(df: DataFrame, level: Column, price: Column, carry: dict[str, Column], *, keys: Sequence[str] = ("symbol",), pos: str = "bar_no",
                 rows: int | None = None, fan: int = FAN, warm: int | None = None) -> DataFrame:
    """df with the columns `carry` (doubles) of the newest level that no price since its row was below; null where there is none.

    `level` is null on rows without one, a null price breaks nothing, and `pos` is gapless (`number_rows`). `warm` is taken as by `ordered_fold` and not needed."""
    rows, names = chunk_rows(df, rows), list(carry)
    num = lambda x: x.cast("double")
    d = df.withColumns({"_level": num(level), "_price": num(price), **{f"_c_{n}": num(x) for n, x in carry.items()}, "_chunk": F.floor(F.col(pos) / rows).cast("bigint")})
    inner = [*keys, "_chunk", pos, "_level", "_price", *[f"_c_{n}" for n in names]]
    array = T.ArrayType(T.DoubleType())
    # The open levels of a chunk, lowest first, each followed by its carried values, stand on its first row.
    schema = T.StructType([d.schema[c] for c in (*keys, "_chunk", pos)] + [T.StructField(n, T.DoubleType()) for n in (*names, "_ask", "_low")] + [T.StructField("_open", array)])

    def walk(p: pd.DataFrame) -> pd.DataFrame:
        p = p.sort_values(pos, kind="stable").reset_index(drop=True)
        lv, pr = p["_level"].to_numpy(dtype=float), p["_price"].to_numpy(dtype=float)
        newest, ask, stack = own_levels(lv, pr)
        out = p[[*keys, "_chunk", pos]].copy()
        c = [p[f"_c_{n}"].to_numpy(dtype=float) for n in names]
        for n, x in zip(names, c):
            out[n] = np.where(newest >= 0, x[newest], np.nan)
        out["_ask"] = ask
        out["_low"] = [np.fmin.reduce(np.r_[pr, np.inf])] + [np.nan] * (len(p) - 1)
        out["_open"] = [[float(y) for i in stack for y in (lv[i], *[x[i] for x in c])]] + [None] * (len(p) - 1)
        return out

    done = durable(d.select(inner).groupBy(*keys, "_chunk").applyInPandas(walk, schema))
    first = done.where(F.col("_open").isNotNull())
    chunks = first.select(*keys, F.col("_chunk").alias("node"), F.col("_low").alias("low"), F.get("_open", F.lit(0)).alias("base"))
    asked = done.where(~F.isnan("_ask")).select(*keys, "_chunk", "_ask").distinct()
    found = _search(asked.select(*keys, F.col("_chunk").alias("node"), F.col("_ask").alias("limit"), F.struct("_chunk", "_ask").alias("q")), chunks, keys, fan)

    width = 1 + len(names)
    stacks = first.where(F.size("_open") > 0).select(*keys, F.col("_chunk").alias("node"), "_open")
    f = found.join(stacks, [*keys, "node"])
    # Levels rise, so the newest one within the limit is the last of those that are not above it.
    at = F.size(F.filter("_open", lambda v, i: (i % width == 0) & (v <= F.col("limit")))) - 1
    f = f.select(*keys, F.col("q._chunk").alias("_chunk"), F.col("q._ask").alias("_ask"), *[F.get("_open", at * width + 1 + i).alias(f"_f_{n}") for i, n in enumerate(names)])
    by = [*keys, "_chunk", "_ask"]
    own = lambda n: F.when(~F.isnan(n), F.col(n))
    answers = done.join(f, by, "left").select(*keys, pos, *[F.coalesce(own(n), own(f"_f_{n}")).alias(n) for n in names])
    return df.join(answers, [*keys, pos])


def _search(asked: DataFrame, nodes: DataFrame, keys: Sequence[str], fan: int) -> DataFrame:
    """The questions (node, limit, q) that have an answer, with the latest node before theirs that has a level within the limit, and the
    limit there: the lowest of the given one and the prices of the nodes passed."""
    levels = [nodes]
    while not levels[-1].where(F.col("node") >= fan).isEmpty():
        levels.append(durable(_joined(levels[-1], keys, fan).select(*keys, F.col("up").alias("node"), F.array_min(F.transform("nodes", lambda n: n["low"])).alias("low"), _outliving().alias("base"))))
    hits = None
    for depth, level in enumerate(levels):
        step = _back(asked, level, keys, fan)
        hit = _down(step.where("hit IS NOT NULL").select(*keys, F.col("hit").alias("node"), "limit", "q"), levels[:depth], keys, fan)
        hits = hit if hits is None else hits.union(hit)
        if depth + 1 < len(levels):
            asked = durable(step.where("hit IS NULL").select(*keys, F.floor(F.col("node") / fan).alias("node"), "limit", "q"))
    return hits


def _joined(level: DataFrame, keys: Sequence[str], fan: int) -> DataFrame:
    """One row of each `fan` neighbours: up (their number) and nodes (in order)."""
    up = F.floor(F.col("node") / fan).alias("up")
    return level.groupBy(*keys, up).agg(F.sort_array(F.collect_list(F.struct("node", "low", "base"))).alias("nodes"))


def _outliving() -> Column:
    """The lowest level of the nodes that outlives all nodes after its own: they are passed from the last to the first."""
    start = F.struct(F.lit(math.inf).alias("limit"), F.lit(None).cast("double").alias("base"))
    step = lambda s, n: F.struct(F.least(s["limit"], n["low"]).alias("limit"), F.least(s["base"], F.when(n["base"] <= s["limit"], n["base"])).alias("base"))
    return F.aggregate(F.reverse("nodes"), start, step)["base"]


def _scan(nodes: Column) -> Column:
    """hit (the latest node with a level within the limit, or null) and the limit after passing all nodes behind it."""
    start = F.struct(F.lit(None).cast("bigint").alias("hit"), F.col("limit").alias("limit"))

    def step(s, n):
        here = F.coalesce(s["hit"], F.when(n["base"] <= s["limit"], n["node"]))
        return F.struct(here.alias("hit"), F.when(here.isNotNull(), s["limit"]).otherwise(F.least(s["limit"], n["low"])).alias("limit"))
    return F.aggregate(F.reverse(nodes), start, step)


def _back(asked: DataFrame, level: DataFrame, keys: Sequence[str], fan: int) -> DataFrame:
    """The questions after a look at the neighbours before their node."""
    j = asked.withColumn("up", F.floor(F.col("node") / fan)).join(_joined(level, keys, fan), [*keys, "up"])
    s = _scan(F.filter("nodes", lambda n: n["node"] < F.col("node")))
    return j.withColumn("s", s).select(*keys, "node", F.col("s.hit").alias("hit"), F.col("s.limit").alias("limit"), "q")


def _down(hits: DataFrame, below: list[DataFrame], keys: Sequence[str], fan: int) -> DataFrame:
    """From the node of a hit down to the chunk that holds the level."""
    for level in reversed(below):
        j = hits.withColumnRenamed("node", "up").join(_joined(level, keys, fan), [*keys, "up"]).withColumn("s", _scan(F.col("nodes")))
        hits = j.select(*keys, F.col("s.hit").alias("node"), F.col("s.limit").alias("limit"), "q")
    return hits
