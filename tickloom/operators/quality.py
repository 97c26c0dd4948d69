"""Feature health, fingerprints, drift, stability and selection."""
from __future__ import annotations

from collections.abc import Mapping, Sequence

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, functions as F, types as T

from ..functions.exprs import c, clip, flag, pair_corr
from .layout import in_chunks
from .ranks import exact_quantiles
from .splits import blocked_folds

NUMERIC = (T.DoubleType, T.FloatType, T.IntegerType, T.LongType, T.ShortType, T.ByteType, T.BooleanType)


def feature_columns(df: DataFrame, prefixes: Sequence[str] = ("pa_", "or_"), exclude: Sequence[str] = ()) -> list[str]:
    """Numeric or boolean columns with a prefix, in table order."""
    return [f.name for f in df.schema.fields
            if f.name.startswith(tuple(prefixes)) and isinstance(f.dataType, NUMERIC) and f.name not in exclude]


def needed_blocks(wanted: Sequence[str], blocks: Mapping[str, Sequence[str]]) -> list[str]:
    """Blocks that make any wanted column, in order."""
    want = set(wanted)
    return [b for b, cols in blocks.items() if want & set(cols)]


def long_form(df: DataFrame, cols: Sequence[str], keep: Sequence[str] = ()) -> DataFrame:
    """(feature, value) rows; a long table makes one plan for any number of features."""
    pairs = F.array(*[F.struct(F.lit(n).alias("feature"), F.col(n).cast("double").alias("value")) for n in cols])
    return df.select(*keep, F.explode(pairs).alias("_p")).select(*keep, "_p.*")


def health(df: DataFrame, cols: Sequence[str], min_std: float = 1e-9) -> DataFrame:
    """Missing count, deviation, range and constant flag per feature."""
    g = long_form(df, cols).groupBy("feature").agg(
        F.sum(flag(F.col("value").isNull())).alias("missing"), F.coalesce(F.stddev_pop("value"), F.lit(0.0)).alias("std"),
        F.min("value").alias("lo"), F.max("value").alias("hi"))
    return g.withColumn("constant", (F.col("std") < min_std) | (F.col("lo") == F.col("hi")) | F.col("lo").isNull())


def fingerprint(df: DataFrame, cols: Sequence[str], fit: Column | None = None) -> DataFrame:
    """mean, std, null rate, three quantiles and n per feature."""
    rows = long_form(df if fit is None else df.where(fit), cols)
    g = rows.groupBy("feature").agg(F.avg("value").alias("mean"), F.stddev_pop("value").alias("std"),
                                    F.avg(flag(F.col("value").isNull())).alias("null_rate"), F.count("value").alias("n"))
    return g.join(exact_quantiles(rows, "value", {"q01": 0.01, "q50": 0.5, "q99": 0.99}, ("feature",)), "feature", "left")


def drift(old: DataFrame, new: DataFrame, z: float = 3.0, null_step: float = 0.05) -> DataFrame:
    """Shift of mean and median in old deviations and change of the null rate, per feature."""
    o = old.select("feature", *[F.col(n).alias(f"o_{n}") for n in ("mean", "std", "null_rate", "q50")])
    j = o.join(new, "feature")
    sd = F.greatest(F.coalesce("o_std", F.lit(0.0)), F.lit(1e-9))
    j = j.withColumns({"z_mean": F.abs(F.col("mean") - F.col("o_mean")) / sd, "z_median": F.abs(F.col("q50") - F.col("o_q50")) / sd,
                       "null_change": F.col("null_rate") - F.col("o_null_rate")})
    return j.select("feature", "z_mean", "z_median", "null_change",
                    ((F.col("z_mean") > z) | (F.col("z_median") > z) | (F.abs("null_change") > null_step)).alias("warn"))


def stability(df: DataFrame, cols: Sequence[str], order: Sequence[str], segments: int = 8) -> DataFrame:
    """1 / (1 + 5 cv of the segment means) per feature over contiguous segments in time."""
    seg = blocked_folds(df, segments, order, "_seg")
    m = long_form(seg, cols, ["_seg"]).groupBy("feature", "_seg").agg(F.avg("value").alias("m"))
    g = m.groupBy("feature").agg(F.stddev_pop("m").alias("sd"), F.avg(F.abs("m")).alias("am"))
    return g.select("feature", F.least(F.greatest(1.0 / (1.0 + 5.0 * F.col("sd") / (F.col("am") + 1e-12)), F.lit(0.0)), F.lit(1.0)).alias("stability"))


def lag1_strength(df: DataFrame, cols: Sequence[str], keys: Sequence[str] = ("symbol",), first: int | None = None) -> DataFrame:
    """Largest |lag-1 correlation| over the keys per feature, on all rows or the first ones of each key."""
    rows = df if first is None else df.where(F.col("bar_no") < first)
    d = in_chunks(rows, lambda x, f: x.withColumns({f"_l_{n}": f.lag(n) for n in cols}), history=1, keys=keys)
    aggs = [F.abs(F.when((F.stddev_pop(n) > 0) & (F.stddev_pop(f"_l_{n}") > 0), pair_corr(n, f"_l_{n}"))).alias(n) for n in cols]
    per_key = d.groupBy(*keys).agg(*aggs)
    return long_form(per_key, cols).groupBy("feature").agg(F.coalesce(F.max("value"), F.lit(0.0)).alias("strength"))


_SUMS = ("n", "x", "xx", "y", "yy", "xy")
MERGED = 1024  # groups of partial sums in the first of two steps


def pair_sums(df: DataFrame, cols: Sequence[str], centre: Sequence[float]) -> DataFrame:
    """at (place of a column) and, against every column, the arrays n, x, xx, y, yy, xy: sums over the rows where both are there.

    Values are taken as distances from `centre`. A task reads its rows once and multiplies whole batches, so what is moved grows with the
    columns squared and with the partitions, not with the rows; the sums are added up in two steps, so no task holds those of all partitions.
    """
    schema = "at int, lot int, " + ", ".join(f"{n} array<double>" for n in _SUMS)
    middle = np.array(centre, dtype=float)

    def partial(batches):
        acc = np.zeros((len(_SUMS), len(middle), len(middle)))
        for pdf in batches:
            x = pdf.to_numpy(dtype=float, na_value=np.nan) - middle
            there = np.isfinite(x)
            x, m = np.where(there, x, 0.0), there.astype(float)
            sx, sxx = x.T @ m, (x * x).T @ m
            acc += np.stack([m.T @ m, sx, sxx, sx.T, sxx.T, x.T @ x])
        lot = TaskContext.get().partitionId() % MERGED
        yield pd.DataFrame({"at": np.arange(len(middle)), "lot": lot} | {n: list(acc[k]) for k, n in enumerate(_SUMS)})

    def merged(pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"at": pdf["at"].iloc[:1], "lot": pdf["lot"].iloc[:1]} | {n: [np.sum(np.stack(list(pdf[n])), axis=0)] for n in _SUMS})

    part = df.select([F.col(n).cast("double").alias(n) for n in cols]).mapInPandas(partial, schema)
    part = part.groupBy("at", "lot").applyInPandas(merged, schema)
    return part.withColumn("lot", F.lit(0)).groupBy("at").applyInPandas(merged, schema).drop("lot")


def correlation_pairs(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """(a, b, r) for all column pairs from sums of products, over the rows where both are there (missing and infinite values are not).

    r is empty where a column does not move, or not on the rows of the pair. Columns are read twice: for their mean, then for the products.
    """
    fine = lambda n: F.when(~F.isnan(n) & (F.abs(F.col(n)) < float("inf")), F.col(n))
    x = df.select([F.col(n).cast("double").alias(n) for n in cols])
    stat = x.agg(*[F.avg(fine(n)).alias(f"m{i}") for i, n in enumerate(cols)], *[F.stddev_pop(fine(n)).alias(f"s{i}") for i, n in enumerate(cols)]).first()
    moves = [stat[f"s{i}"] is not None and stat[f"s{i}"] > 1e-12 for i in range(len(cols))]
    sums = pair_sums(x, cols, [stat[f"m{i}"] or 0.0 for i in range(len(cols))])
    one = sums.select("at", F.explode(F.arrays_zip(F.sequence(F.lit(0), F.lit(len(cols) - 1)).alias("to"), *_SUMS)).alias("p")).select("at", "p.*")
    names, moving = (F.array(*[F.lit(v) for v in values]) for values in (cols, moves))
    one = one.where("at < to").withColumns({v: F.try_divide(v, "n") for v in _SUMS[1:]})
    var = lambda s, ss: F.col(ss) - F.col(s) * F.col(s)
    # What is left of equal values by rounding is no movement.
    some = (var("x", "xx") > 1e-13 * F.col("xx")) & (var("y", "yy") > 1e-13 * F.col("yy")) & F.get(moving, F.col("at")) & F.get(moving, F.col("to"))
    r = F.when(some, F.try_divide(F.col("xy") - F.col("x") * F.col("y"), F.sqrt(var("x", "xx")) * F.sqrt(var("y", "yy"))))
    return one.select(F.get(names, F.col("at")).alias("a"), F.get(names, F.col("to")).alias("b"), clip(r, -1.0, 1.0).alias("r"))


def drop_correlated(df: DataFrame, cols: Sequence[str], limit: Mapping[str, float], protected: Sequence[str] = ()) -> list[str]:
    """Columns to keep: protected first, then in order, unless too correlated with a kept one.

    `limit` maps prefixes to thresholds, with "default"; the longest prefix holds and a pair
    takes the smaller threshold. Only the pairs of columns that reach the lowest threshold come to the driver.
    """
    def bound(n: str) -> float:
        hits = [p for p in limit if p != "default" and n.startswith(p)]
        return limit[max(hits, key=len)] if hits else limit.get("default", 0.9)
    r = {}
    for row in correlation_pairs(df, cols).where(F.abs("r") >= min([*limit.values(), limit.get("default", 0.9)])).collect():
        r[row["a"], row["b"]] = r[row["b"], row["a"]] = row["r"]
    kept: list[str] = []
    for n in [*[x for x in cols if x in protected], *[x for x in cols if x not in protected]]:
        near = any(r.get((n, k)) is not None and abs(r[n, k]) >= min(bound(n), bound(k)) for k in kept)
        if n in protected or not near:
            kept.append(n)
    return kept


def coverage(df: DataFrame, split: str, t: str) -> DataFrame:
    return df.groupBy(split).agg(F.count(F.lit(1)).alias("rows"), F.min(t).alias("first"), F.max(t).alias("last"))


def threshold_diff(old: DataFrame, new: DataFrame, key: str = "name", value: str = "value") -> DataFrame:
    """Old and new thresholds side by side with their change and status."""
    a, b = old.withColumnRenamed(value, "old"), new.withColumnRenamed(value, "new")
    j = a.join(b, key, "full")
    status = F.when(F.col("old").isNull(), "added").when(F.col("new").isNull(), "removed").when(F.col("old") == F.col("new"), "same").otherwise("changed")
    return j.withColumns({"status": status, "change": F.col("new") - F.col("old")})


def masking_audit(df: DataFrame, score, groups: Mapping[str, Sequence[str]], metric) -> DataFrame:
    """Metric with all features and with each group zeroed: score(df) -> df with a prediction, metric -> aggregate column."""
    base = score(df).agg(metric.alias("metric")).select(F.lit("all").alias("masked"), "metric")
    for name, cols in groups.items():
        m = score(df.withColumns({n: F.lit(0.0) for n in cols})).agg(metric.alias("metric"))
        base = base.unionByName(m.select(F.lit(name).alias("masked"), "metric"))
    return base
