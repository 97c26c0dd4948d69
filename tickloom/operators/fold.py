"""Order-dependent state machines over long keys, run in parallel and checked.

A chunk of a key does not know the state it starts with. It guesses: it runs
the machine over the `warm` rows before it, from the start state. Machines
with a reset or a decay forget their past, so the guess is nearly always the
true state. Afterwards the end state of each chunk is compared with the state
its successor started from; chunks that started wrong run again from the right
state until none is left. The result therefore equals the serial fold, and the
driver only sees the number of wrong chunks.

Where the state after a chunk follows from the state before it and a short
summary of the chunk, `summary_fold` needs no guess: one pass makes the
summaries, they are combined in order, and a second pass runs every chunk from
its true state, however long the state lasts.
"""
from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

import pandas as pd
from pyspark.sql import DataFrame, functions as F, types as T

from .durable import durable
from .layout import chunk_rows

Step = Callable[[pd.DataFrame, list], tuple[Mapping[str, Sequence], list]]


def ordered_fold(df: DataFrame, step: Step, outputs: Mapping[str, str], start: Sequence[float], *, warm: int,
                 keys: Sequence[str] = ("symbol",), pos: str = "bar_no", rows: int | None = None,
                 tolerance: float = 0.0) -> DataFrame:
    """Fold the rows of a key in order; `pos` must be gapless (`number_rows`).

    `step(rows, state)` gets consecutive rows as a pandas frame and the state
    (a list of numbers of any length, NaN for missing) and returns the output columns and the state after them.
    """
    start, rows = [float(x) for x in start], chunk_rows(df, rows)
    names = list(outputs)

    spread = _with_warm_up(df, warm, pos, rows)
    fields = [f for f in spread.schema.fields]
    types = [T.StructField(o, T._parse_datatype_string(t)) for o, t in outputs.items()]
    bounds = [T.StructField("_from", T.ArrayType(T.DoubleType())), T.StructField("_to", T.ArrayType(T.DoubleType()))]
    schema = T.StructType(fields + types + bounds)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(pos, kind="stable").reset_index(drop=True)
        here = int(pdf["_chunk"].iloc[0])
        cut = int((pdf[pos] < here * rows).sum())
        live = pdf.iloc[cut:].reset_index(drop=True)
        if live.empty:
            return pd.DataFrame(columns=schema.names)
        given = live["_given"].iloc[0]
        if given is not None:
            state = [float("nan") if x is None else float(x) for x in given]
        else:
            state = list(start)
            if cut:
                _, state = step(pdf.iloc[:cut].reset_index(drop=True), state)
        begin = [float(x) for x in state]
        cols, state = step(live, list(state))
        for o in names:
            live[o] = cols[o]
        live["_from"] = [begin] + [None] * (len(live) - 1)
        live["_to"] = [None] * (len(live) - 1) + [[float(x) for x in state]]
        return live[schema.names]

    by = [*keys, "_chunk"]

    def go(d: DataFrame) -> DataFrame:
        return d.groupBy(*by).applyInPandas(run, schema)

    def edges(d: DataFrame) -> DataFrame:
        return d.groupBy(*by).agg(F.max("_from").alias("_from"), F.max("_to").alias("_to"))

    # the first pass is written once; later rounds only write the chunks they correct
    done = durable(go(spread))
    edge, fixed = durable(edges(done)), None
    while True:
        before = edge.select(*keys, (F.col("_chunk") + 1).alias("_chunk"), F.col("_to").alias("_want"))
        same = (F.size("_from") == F.size("_want")) & F.forall(F.zip_with("_from", "_want", _close(tolerance)), lambda ok: ok)
        wrong = durable(edge.join(before, by).where(~same).select(*by, "_want"))
        if wrong.isEmpty():
            break
        again = durable(go(spread.drop("_given").join(wrong.withColumnRenamed("_want", "_given"), by).select(*[f.name for f in fields])))
        edge = durable(edge.join(wrong, by, "left_anti").unionByName(edges(again)))
        fixed = again if fixed is None else durable(fixed.join(wrong, by, "left_anti").unionByName(again))
    if fixed is not None:
        done = done.join(fixed.select(*by).distinct(), by, "left_anti").select(*schema.names).unionByName(fixed)
    return done.drop("_chunk", "_given", "_from", "_to")


def summary_fold(df: DataFrame, summary: Callable[[pd.DataFrame], list], combine: Callable[[list, list], tuple[list, list]], step: Step,
                 outputs: Mapping[str, str], start: Sequence[float], *, cols: Sequence[str], keys: Sequence[str] = ("symbol",), pos: str = "bar_no",
                 rows: int | None = None, warm: int | None = None) -> DataFrame:
    """Fold the rows of a key in order in two passes; `pos` must be gapless. `warm` is taken as by `ordered_fold` and not needed.

    `summary(rows)` is a list of numbers made of the columns `cols`. `combine(state, summary)` returns what the chunk needs
    of the state before it, and the state after it, both lists of numbers. `step` is as in `ordered_fold` and starts from the
    former. One task combines the summaries of a key, one for each chunk.
    """
    rows = chunk_rows(df, rows)
    cut = df.withColumn("_chunk", F.floor(F.col(pos) / rows).cast("bigint"))
    by = [*keys, "_chunk"]
    key_fields = [cut.schema[k] for k in by]
    numbers = T.ArrayType(T.DoubleType())
    first = list(dict.fromkeys([*by, pos, *cols]))

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(pos, kind="stable").reset_index(drop=True)
        return pdf[by].iloc[:1].assign(_sum=[[float(x) for x in summary(pdf)]])

    def order(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("_chunk").reset_index(drop=True)
        state, given = [float(x) for x in start], []
        for s in pdf["_sum"]:
            need, state = combine(state, [float(x) for x in s])
            given.append([float(x) for x in need])
        return pdf[by].assign(_given=given)

    sums = durable(cut.select(first).groupBy(*by).applyInPandas(one, T.StructType([*key_fields, T.StructField("_sum", numbers)])))
    given = durable(sums.groupBy(*keys).applyInPandas(order, T.StructType([*key_fields, T.StructField("_given", numbers)])))
    names = list(outputs)
    schema = T.StructType([*cut.schema.fields, *[T.StructField(o, T._parse_datatype_string(t)) for o, t in outputs.items()]])

    def run(pdf: pd.DataFrame, state: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(pos, kind="stable").reset_index(drop=True)
        done, _ = step(pdf, [float(x) for x in state["_given"].iloc[0]])
        for o in names:
            pdf[o] = done[o]
        return pdf[schema.names]

    return cut.groupBy(*by).cogroup(given.groupBy(*by)).applyInPandas(run, schema).drop("_chunk")


def _close(tol: float):
    def same(a, b):
        return F.coalesce((F.isnan(a) & F.isnan(b)) | (F.abs(a - b) <= tol * (1.0 + F.abs(a))), F.lit(False))
    return same


def _with_warm_up(df: DataFrame, warm: int, pos: str, rows: int) -> DataFrame:
    first = F.floor(F.col(pos) / rows)
    last = F.floor((F.col(pos) + warm) / rows)
    return (df.withColumn("_chunk", F.explode(F.sequence(first.cast("bigint"), last.cast("bigint"))))
            .withColumn("_given", F.lit(None).cast("array<double>")))
