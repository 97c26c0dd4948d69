"""Evaluation metrics as aggregates."""
from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.exprs import c, clip, pair_corr
from .ranks import average_rank, exact_quantiles, order_position, running_over_values


def weighted_quantiles(df: DataFrame, x: str, w: str, qs: Mapping[str, float], keys: Sequence[str] = ()) -> DataFrame:
    """Smallest value whose share of the summed weights (negative ones count 0) reaches q."""
    k = list(keys) or ["_k"]
    d = df if keys else df.withColumn("_k", F.lit(1))
    d = d.groupBy(*k, x).agg(F.sum(F.greatest(F.col(w), F.lit(0.0))).alias("_w"))
    d = running_over_values(d, x, {"_cw": F.col("_w")}, k)
    tot = d.groupBy(*k).agg(F.max("_cw").alias("_tw"))
    d = d.join(tot, k)
    got = d.groupBy(*k).agg(*[F.min(F.when(F.col("_cw") / F.col("_tw") >= q, F.col(x))).alias(n) for n, q in qs.items()])
    return got if keys else got.drop("_k")


def metric_gate(metrics: DataFrame, checks: Mapping[str, Column], key: str = "label", escalate_at: int = 3) -> DataFrame:
    """Number of passed checks, the failed names, and whether few enough pass to escalate."""
    bad = F.array_compact(F.array(*[F.when(~F.coalesce(x, F.lit(False)), n) for n, x in checks.items()]))
    return metrics.withColumn("_bad", bad).select(
        key, (F.lit(len(checks)) - F.size("_bad")).alias("passed"), F.array_join("_bad", ",").alias("failed"),
        (F.lit(len(checks)) - F.size("_bad") <= escalate_at).alias("escalate"))


#: The seven checks of the exit engine and their limits; the symbol gap must stay below its limit.
ENGINE_CHECKS = {"holdout_auc_ok": ("holdout_auc", 0.70), "combined_sharpe_ok": ("sharpe", 0.70), "combined_pf_ok": ("profit_factor", 1.05), "combined_mret_ok": ("mean_return", 2.0e-5),
                 "policy_exit_share_ok": ("policy_share", 0.20), "symbol_gap_ok": ("symbol_gap", 1.2e-4), "value_signal_ok": ("value_r2", 0.03)}


def engine_gate(metrics: DataFrame, key: str = "label", escalate_at: int = 3) -> DataFrame:
    """`metric_gate` with the seven checks; a missing metric fails its check."""
    checks = {n: F.abs(F.coalesce(x, F.lit(0.0))) <= limit if x == "symbol_gap" else F.col(x) >= limit for n, (x, limit) in ENGINE_CHECKS.items()}
    return metric_gate(metrics, checks, key, escalate_at)


def brier(y, p) -> Column:
    """Mean squared distance of a 0/1 label and a probability."""
    return F.avg(F.pow(c(y) - clip(c(p), 0.0, 1.0), F.lit(2)))


def brier_multi(y, probs) -> Column:
    """Mean squared distance to the one-hot label; `probs` is an array column."""
    sq = F.aggregate(F.transform(c(probs), lambda p, i: F.pow(p - (i == c(y)).cast("double"), F.lit(2))), F.lit(0.0), lambda a, b: a + b)
    return F.avg(sq)


def log_loss(y, probs, floor: float = 1e-12) -> Column:
    """Mean negative log of the label's probability after clipping and renormalising."""
    safe = F.transform(c(probs), lambda p: F.least(F.greatest(p, F.lit(floor)), F.lit(1.0)))
    total = F.aggregate(safe, F.lit(0.0), lambda a, b: a + b)
    return F.avg(-F.ln(F.element_at(safe, c(y).cast("int") + 1) / total))


def pinball(y, pred, q: float) -> Column:
    d = c(y) - c(pred)
    return F.avg(F.greatest(q * d, (q - 1) * d))


def pearson(a, b, least: int = 3) -> Column:
    """Correlation, missing for few rows or a flat side."""
    a, b = c(a).cast("double"), c(b).cast("double")
    ok = (F.count(F.when(a.isNotNull() & b.isNotNull(), 1)) >= least) & (F.stddev_pop(a) >= 1e-12) & (F.stddev_pop(b) >= 1e-12)
    return F.when(ok, pair_corr(a, b))


def ece_equal_count(df: DataFrame, y: str, p: str, tie: str, bins: int = 10) -> DataFrame:
    """Calibration error over bins of n // bins rows in order of (p, tie); the rest goes to the last bin."""
    d = df.withColumn(p, clip(F.col(p), 1e-9, 1.0 - 1e-9))
    n = d.agg(F.count(F.lit(1))).scalar()
    d = order_position(d, p, tie, "_pos").withColumn("_n", n)
    size = F.greatest(F.floor(F.col("_n") / bins), F.lit(1))
    g = d.groupBy(F.least(F.floor(F.col("_pos") / size), F.lit(bins - 1)).alias("bin")).agg(
        F.count(F.lit(1)).alias("n"), F.avg(y).alias("acc"), F.avg(p).alias("conf"), F.max("_n").alias("_n"))
    return g.agg(F.sum(F.col("n") / F.col("_n") * F.abs(F.col("acc") - F.col("conf"))).alias("ece"))


def ece_equal_width(df: DataFrame, correct: str, conf: str, bins: int = 10) -> DataFrame:
    """Calibration error over bins (lo, hi] of the confidence."""
    g = df.where(F.col(conf) > 0).groupBy(F.ceil(F.col(conf) * bins).alias("bin")).agg(
        F.count(F.lit(1)).alias("n"), F.avg(correct).alias("acc"), F.avg(conf).alias("mean_conf"))
    total = df.agg(F.count(F.lit(1))).scalar()
    return g.withColumn("_n", total).agg(F.sum(F.col("n") / F.col("_n") * F.abs(F.col("acc") - F.col("mean_conf"))).alias("ece"))


def tail_mae(df: DataFrame, y: str, pred: str, q: float = 0.9) -> DataFrame:
    """Mean absolute error on rows at or above the q quantile of the truth."""
    cut = exact_quantiles(df, y, {"q": q}).scalar()
    return df.withColumn("_q", cut).where(F.col(y) >= F.col("_q")).agg(F.avg(F.abs(F.col(y) - F.col(pred))).alias("tail_mae"))


def spearman(df: DataFrame, a: str, b: str) -> DataFrame:
    d = average_rank(df.where(F.col(a).isNotNull() & F.col(b).isNotNull()), a, "_ra")
    d = average_rank(d, b, "_rb")
    return d.agg(pearson("_ra", "_rb").alias("spearman"))


def regression_report(y, p) -> list[Column]:
    y, p = c(y).cast("double"), c(p).cast("double")
    e = y - p
    return [F.count(e).alias("n"), F.avg(F.abs(e)).alias("mae"), F.sqrt(F.avg(e * e)).alias("rmse"),
            (1.0 - F.sum(e * e) / F.nullif(F.var_pop(y) * F.count(y), F.lit(0.0))).alias("r2"),
            F.avg(F.when(F.abs(y) > 1e-8, (F.signum(y) == F.signum(p)).cast("int"))).alias("sign_acc"),
            F.avg(p).alias("pred_mean"), F.stddev_pop(p).alias("pred_std"), (F.stddev_pop(p) < 1e-5).alias("degenerate")]


def confusion_report(df: DataFrame, keys: Sequence[str], y: str, pred: str) -> DataFrame:
    """Counts, precision and recall per class for each key."""
    n = df.groupBy(*keys, y, pred).agg(F.count(F.lit(1)).alias("n"))
    n = n.withColumn("_c", F.explode(F.array_distinct(F.array(F.col(y).cast("int"), F.col(pred).cast("int")))))
    k = F.col("_c")
    g = n.groupBy(*keys, "_c").agg(
        F.sum(F.when((F.col(y) == k) & (F.col(pred) == k), F.col("n")).otherwise(0)).alias("tp"),
        F.sum(F.when((F.col(y) != k) & (F.col(pred) == k), F.col("n")).otherwise(0)).alias("fp"),
        F.sum(F.when((F.col(y) == k) & (F.col(pred) != k), F.col("n")).otherwise(0)).alias("fn"))
    return g.withColumnRenamed("_c", "cls").withColumns({"precision": F.try_divide(F.col("tp"), F.col("tp") + F.col("fp")), "recall": F.try_divide(F.col("tp"), F.col("tp") + F.col("fn"))})


def auc(df: DataFrame, y: str, score: str, keys: Sequence[str] = ()) -> DataFrame:
    """Area under the ROC curve from mean ranks, exact with ties."""
    g = df.groupBy(*keys, score).agg(F.count(F.lit(1)).alias("_n"), F.sum(F.col(y).cast("bigint")).alias("_p"))
    g = running_over_values(g, score, {"_upto": F.col("_n")}, keys)
    rank = F.col("_upto") - (F.col("_n") - 1) / 2.0
    pos, n = F.sum("_p"), F.sum("_n")
    return g.groupBy(*keys).agg(F.try_divide(F.sum(rank * F.col("_p")) - pos * (pos + 1) / 2.0, (pos * (n - pos)).cast("double")).alias("auc"))
