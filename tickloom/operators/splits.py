"""Time splits, folds, weights and fitted scalings."""
from __future__ import annotations

import math
from collections.abc import Sequence
from statistics import NormalDist

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.exprs import c, clip, fill, flag, pair_corr
from .durable import durable, stored
from .flips import median_deviations, signed_rows
from .gates import lookup
from .layout import number_rows
from .ranks import average_rank, exact_quantiles, running_over_values


def ts(text: str) -> Column:
    return F.lit(text).cast("timestamp_ntz")


def calendar_split(t, train_end: str, cal_end: str, test_end: str) -> Column:
    """train before train_end, cal before cal_end, test before test_end, else missing."""
    x = c(t)
    return F.when(x < ts(train_end), "train").when(x < ts(cal_end), "cal").when(x < ts(test_end), "test")


def expanding_folds(df: DataFrame, folds: Sequence[tuple[str, str]], t: str = "t") -> DataFrame:
    """One row per (row, fold) it takes part in: train before the fold's start, val inside [start, end).

    The folds are a short literal list, so this is an explode and no join.
    """
    for a, b in folds:
        if not a < b:
            raise ValueError(f"fold {a}..{b} is empty")
    lits = F.array(*[F.struct(F.lit(i).alias("fold"), ts(a).alias("vs"), ts(b).alias("ve")) for i, (a, b) in enumerate(folds)])
    x = c(t)
    d = df.withColumn("_f", F.explode(F.filter(lits, lambda f: x < f["ve"])))
    return d.withColumns({"fold": F.col("_f.fold"), "role": F.when(x < F.col("_f.vs"), "train").otherwise("val")}).drop("_f")


def time_position(df: DataFrame, order: Sequence[str], out: str = "pos") -> DataFrame:
    """Exact position in time over the whole table."""
    return number_rows(df, (), order, piece="range", out=out)


def blocked_folds(df: DataFrame, k: int, order: Sequence[str], out: str = "fold") -> DataFrame:
    """K contiguous blocks in time; the first n mod K blocks have one row more."""
    d = time_position(df, order, "_pos")
    d = d.withColumn("_n", d.agg(F.count(F.lit(1))).scalar())
    q, r = F.floor(F.col("_n") / k), F.col("_n") % k
    big = (q + 1) * r
    return d.withColumn(out, F.when(F.col("_pos") < big, F.floor(F.col("_pos") / (q + 1))).otherwise(
        r + F.floor((F.col("_pos") - big) / F.greatest(q, F.lit(1)))).cast("int")).drop("_pos", "_n")


def tune_report(df: DataFrame, share: float, order: Sequence[str], least: int = 50) -> DataFrame:
    """Early rows tune, late rows report; with fewer than twice `least` rows all do both."""
    n = df.agg(F.count(F.lit(1))).scalar()
    d = time_position(df, order, "_pos").withColumn("_n", n)
    cut = F.greatest(F.lit(least), F.least(F.col("_n") - least, F.bround(F.col("_n") * min(max(share, 0.2), 0.8))))
    few = F.col("_n") < 2 * least
    return d.withColumns({"tune": few | (F.col("_pos") < cut), "report": few | (F.col("_pos") >= cut)}).drop("_pos", "_n")


def trade_split(df: DataFrame, trade: Sequence[str], t: str, share: float = 0.7) -> DataFrame:
    """Whole trades by their first time: the first share is train, the rest val. Needs two trades."""
    first = df.groupBy(*trade).agg(F.min(t).alias("_t0"))
    n = first.agg(F.count(F.lit(1))).scalar()
    p = time_position(first, ("_t0", *trade), "_pos").withColumn("_n", n)
    cut = F.greatest(F.lit(1), F.least(F.col("_n") - 1, F.bround(F.col("_n") * share)))
    return df.join(p.select(*trade, F.when(F.col("_pos") < cut, "train").otherwise("val").alias("part")), list(trade))


def stitch_oof(folds: Sequence[DataFrame], key: Sequence[str], value: str) -> DataFrame:
    """Each row's value from the fold where it was validation."""
    d = folds[0]
    for f in folds[1:]:
        d = d.unionByName(f)
    return d.where("role = 'val'").select(*key, "fold", value)


def class_recency_weights(df: DataFrame, y: str, t: str, classes: int, out: str = "weight") -> DataFrame:
    """Inverse class frequency with mean 1 over the classes present, times 0.7 (oldest) .. 1.0 (newest)."""
    n = df.agg(F.count(F.lit(1))).scalar()
    g = df.groupBy(y).agg(F.count(F.lit(1)).alias("_k")).withColumn("_w", 1.0 / F.greatest(F.col("_k") / n * classes, F.lit(1e-6)))
    g = g.withColumn("_w", F.col("_w") / F.avg("_w").over(Window.partitionBy()))
    span = df.agg(F.max(t).alias("hi"), F.min(t).alias("lo")).select(F.struct("hi", "lo")).scalar()
    d = df.join(g.select(y, "_w"), y).withColumn("_s", span)
    day = lambda a, b: F.timestamp_diff("SECOND", a, b) / 86400.0
    age = day(F.col(t), F.col("_s.hi")) / F.greatest(day(F.col("_s.lo"), F.col("_s.hi")), F.lit(1.0))
    return d.withColumn(out, F.col("_w") * (0.7 + 0.3 * (1.0 - age))).drop("_w", "_s")


def tail_weights(df: DataFrame, y: str, start: float = 0.8, alpha: float = 2.0, out: str = "weight") -> DataFrame:
    """1 plus alpha times the linear rise from the start quantile to 1."""
    cut = exact_quantiles(df, y, {"q": min(max(start, 0.5), 0.99)}).scalar()
    d = df.withColumn("_c", cut)
    tail = clip((F.col(y) - F.col("_c")) / F.greatest(1.0 - F.col("_c"), F.lit(1e-3)), 0.0, 1.0)
    return d.withColumn(out, 1.0 + alpha * fill(tail, 0.0)).drop("_c")


def rank_step_weights(df: DataFrame, y: str, active_above: float = 0.05, out: str = "weight") -> DataFrame:
    """5, 2.5, 1.5 or 1 by the average-rank percentile among active rows; 1 for the others."""
    act = F.when(F.col(y) > active_above, F.col(y))
    d = average_rank(df.withColumn("_a", act), "_a", "_r")
    p = F.col("_r") / F.col("_r_of")
    w = F.when(p > 0.90, 5.0).when(p > 0.70, 2.5).when(p > 0.50, 1.5).otherwise(1.0)
    return d.withColumn(out, F.when(F.col("_a").isNotNull(), w).otherwise(1.0)).drop("_a", "_r", "_r_of")


# Hold-row weight by entry regime, and by unrealised result below each limit (last one above all).
HOLD_OF_REGIME = {0: 1.0, 1: 1.3, 2: 1.0, 3: 0.55, 4: 0.80}
HOLD_OF_RESULT = ((-1.5, 0.50), (-0.5, 0.70), (0.0, 0.85))


def hold_weight(y, hold, regime, u, most: int = 30, divergence=None) -> Column:
    """1 on exit rows; on hold rows regime x time x result (x divergence), within 0.4..2.5."""
    share = clip(c(hold).cast("double") / max(max(most, 2) - 1, 1), 0.0, 1.0)
    by_result = F.lit(1.0)
    for limit, w in HOLD_OF_RESULT:  # a later limit overrides an earlier one, as in the fixed rule
        by_result = F.when(c(u) < limit, w).otherwise(by_result)
    w = lookup(HOLD_OF_REGIME, c(regime).cast("int"), 1.0) * (1.15 + (0.65 - 1.15) * share) * by_result
    if divergence is not None:
        w = w * F.when(c(divergence) > 0.5, 0.70).otherwise(1.0)
    return F.when(c(y) == 1, 1.0).otherwise(F.least(F.greatest(w, F.lit(0.4)), F.lit(2.5)))


def trade_weights(df: DataFrame, trade: Sequence[str], hold: str, y: str, u: str, regime: str, *, most: int = 30, shape: bool = False,
                  regret: bool = False, out: str = "weight") -> DataFrame:
    """1/trade length x hold bucket x class, optionally x nearness to the peak x regret; clipped at 1% and 99%, mean 1."""
    w = Window.partitionBy(*trade).orderBy(hold)
    rest = w.rowsBetween(0, Window.unboundedFollowing)
    whole = Window.partitionBy(*trade)
    d = df.withColumns({
        "_len": F.count(F.lit(1)).over(whole), "_peak": F.max_by(hold, F.struct(F.col(u), -F.col(hold))).over(whole), "_tmax": F.max(hold).over(whole),
        "_mn": F.min(u).over(rest), "_mx": F.max(u).over(rest), "_hb": hold_bucket(hold)})
    sizes = d.groupBy("_hb").agg(F.count(F.lit(1)).alias("_n"))
    four = F.array(*[F.coalesce(F.max(F.when(F.col("_hb") == i, F.col("_n"))), F.lit(1)).cast("double") for i in range(4)])
    d = d.withColumn("_nb", sizes.agg(four).scalar())
    mean = F.aggregate("_nb", F.lit(0.0), lambda a, b: a + b) / 4.0
    weight = clip(F.sqrt(mean / F.element_at("_nb", F.col("_hb") + 1)), 0.75, 1.5) * hold_weight(y, hold, regime, u, most) / F.col("_len")
    h, x = F.col(hold), F.col(u)
    if shape:
        weight = weight * (F.when(h < 3, 0.3).otherwise(1.0) * F.when(F.col("_tmax") - h < 3, 0.5).otherwise(1.0)
                           * F.when(F.abs(h - F.col("_peak")) <= 5, 3.0).otherwise(1.0))
    if regret:
        weight = weight * F.when(F.col(y) == 1, clip(1.0 + F.greatest(x - F.col("_mn"), F.lit(0.0)), 1.0, 10.0)).otherwise(
            clip(0.5 + F.least(F.greatest(F.col("_mx") - x, F.lit(0.0)), F.lit(3.0)) / 3.0 * 1.5, 0.5, 2.0))
    d = durable(d.withColumn("_w", weight).drop("_len", "_peak", "_tmax", "_mn", "_mx", "_hb", "_nb"))
    lim = exact_quantiles(d, "_w", {"lo": 0.01, "hi": 0.99}).select(F.struct("lo", "hi")).scalar()
    d = d.withColumn("_lim", lim).withColumn("_w", F.least(F.greatest(F.col("_w"), F.col("_lim.lo")), F.col("_lim.hi")))
    total = d.agg(F.avg("_w")).scalar()
    return d.withColumn(out, F.col("_w") / total).drop("_w", "_lim")


def hold_bucket(hold) -> Column:
    """0 below 3, 1 below 8, 2 below 15, else 3."""
    h = fill(c(hold).cast("double"), 0.0)
    return F.when(h < 3, 0).when(h < 8, 1).when(h < 15, 2).otherwise(3)


def half_life_days(df: DataFrame, t: str, signal: str) -> DataFrame:
    """Half-life of the daily mean signal from its lag-1 correlation; missing when that is not in (0, 0.999)."""
    day = df.where(F.col(signal).isNotNull()).groupBy(F.to_date(t).alias("day")).agg(F.avg(signal).alias("x"))
    w = Window.orderBy("day")  # one row per calendar day
    d = day.withColumn("l", F.lag("x").over(w))
    ok = (F.stddev_pop(F.when(F.col("l").isNotNull(), F.col("x"))) > 1e-8) & (F.stddev_pop("l") > 1e-8) & (F.count(F.lit(1)) >= 4)
    rho = F.when(ok, pair_corr("l", "x"))
    return d.agg(rho.alias("rho"), F.count(F.lit(1)).alias("days")).withColumn(
        "half_life", F.when((F.col("rho") > 1e-6) & (F.col("rho") < 0.999), -math.log(2.0) / F.ln("rho")))


def decay_weights(df: DataFrame, order: Sequence[str], signal: str, out: str = "weight") -> DataFrame:
    """Exponential weights by row age with the signal's half-life, summing to 1; equal weights without one."""
    n = df.agg(F.count(F.lit(1)).cast("double")).scalar()
    hl = half_life_days(df, order[0], signal).select(F.struct("half_life", "days")).scalar()
    d = time_position(df, order, "_pos").withColumns({"_n": n, "_h": hl})
    rows = clip(F.col("_h.half_life") * F.greatest(F.lit(1.0), F.col("_n") / F.greatest(F.col("_h.days"), F.lit(1))), 1.0, F.greatest(F.lit(1.0), F.col("_n") * 1.5))
    lam = F.when(rows.isNotNull(), math.log(2.0) / rows).otherwise(0.0)
    d = d.withColumn("_l", lam).withColumn("_w", F.exp(-F.col("_l") * (F.col("_n") - 1 - F.col("_pos"))))
    # sum of the geometric series, in closed form
    total = F.when(F.col("_l") > 0, (1 - F.exp(-F.col("_l") * F.col("_n"))) / (1 - F.exp(-F.col("_l")))).otherwise(F.col("_n"))
    return d.withColumn(out, F.col("_w") / total).drop("_pos", "_n", "_h", "_l", "_w")


def fit_zscore(df: DataFrame, cols: Sequence[str], fit: Column, suffix: str = "_z") -> DataFrame:
    """(x - mean) / sd on the fit rows, tiny sd counts as 1; booleans stay."""
    nums = [n for n in cols if dict(df.dtypes)[n] != "boolean"]
    stats = df.where(fit).agg(F.struct(*[F.avg(n).alias(f"m_{n}") for n in nums], *[F.stddev_samp(n).alias(f"s_{n}") for n in nums])).scalar()
    d = df.withColumn("_st", stats)
    out = {}
    for n in nums:
        sd = F.coalesce(F.col(f"_st.s_{n}"), F.lit(0.0))
        out[n + suffix] = (F.col(n) - F.col(f"_st.m_{n}")) / F.when(sd < 1e-8, 1.0).otherwise(sd)
    for n in cols:
        if n not in nums:
            out[n + suffix] = F.col(n)
    return d.withColumns(out).drop("_st")


def robust_scale(df: DataFrame, x: str, fit: Column) -> Column:
    """Scalar struct(median, mad) of x on the fit rows, in two passes."""
    rows = df.where(fit & F.col(x).isNotNull())
    med = exact_quantiles(rows, x, {"m": 0.5}).scalar()
    dev = rows.withColumn("_m", med).withColumn("_dev", F.abs(F.col(x) - F.col("_m")))
    return exact_quantiles(dev, "_dev", {"mad": 0.5}).withColumn("med", med).select(F.struct("med", "mad")).scalar()


def robust_z(df: DataFrame, x: str, fit: Column, limit: float = 3.0, out: str = "rz") -> DataFrame:
    sd = df.where(fit).agg(F.stddev_pop(x)).scalar()
    d = df.withColumns({"_r": robust_scale(df, x, fit), "_sd": sd})
    scale = F.greatest(1.4826 * F.col("_r.mad"), 0.25 * F.col("_sd"), F.lit(1e-3))
    return d.withColumn(out, clip((F.col(x) - F.col("_r.med")) / scale, -limit, limit)).drop("_r", "_sd")


def percentile_map(df: DataFrame, x: str, fit: Column, out: str = "pct", tail_boost: float = 0.0) -> DataFrame:
    """Mid-rank of x among the fit values, 0..1; 0.5 where x is missing."""
    freq = df.where(F.col(x).isNotNull()).groupBy(x).agg(F.sum(flag(fit)).cast("double").alias("_k"))
    cum = running_over_values(freq, x, {"_upto": F.col("_k")})
    n = cum.agg(F.sum("_k")).scalar()
    m = cum.select(x, (0.5 * (F.col("_upto") - F.col("_k") + F.col("_upto")) / F.greatest(n, F.lit(1.0))).alias(out))
    d = df.join(stored(m), x, "left").withColumn(out, fill(F.col(out), 0.5))
    if tail_boost > 0:
        up = clip((F.col(out) - 0.80) / 0.20, 0.0, 1.0)
        d = d.withColumn(out, clip((1.0 - tail_boost) * F.col(out) + tail_boost * up, 0.0, 1.0))
    return d


def quantile_rescale(df: DataFrame, x: str, fit: Column, lo: float = 0.05, hi: float = 0.95, out: str = "scaled") -> DataFrame:
    """(x - q_lo) / (q_hi - q_lo) of the fit rows, clipped to 0..1."""
    q = exact_quantiles(df.where(fit), x, {"lo": lo, "hi": hi}).select(F.struct("lo", "hi")).scalar()
    d = df.withColumn("_q", q)
    top = F.when(F.col("_q.hi") <= F.col("_q.lo") + 1e-6, F.col("_q.lo") + 1.0).otherwise(F.col("_q.hi"))
    return d.withColumn(out, clip((F.col(x) - F.col("_q.lo")) / F.greatest(top - F.col("_q.lo"), F.lit(1e-6)), 0.0, 1.0)).drop("_q")


def clip_ceiling(df: DataFrame, x: str, fit: Column, z: float, q: float, floor: float, ceiling: float) -> DataFrame:
    """median + z MAD / 0.6745 between floor and ceiling; the q quantile where the MAD is 0."""
    r = robust_scale(df, x, fit)
    t = exact_quantiles(df.where(fit), x, {"q": q}).withColumn("r", r)
    sigma = F.col("r.mad") / 0.67448975
    raw = F.when(sigma > 1e-8, F.col("r.med") + z * sigma).otherwise(F.col("q"))
    return t.select(F.col("r.med").alias("median"), F.col("r.mad").alias("mad"), sigma.alias("sigma"), clip(raw, floor, ceiling).alias("ceiling"))


def sign_flip_threshold(df: DataFrame, x: str, key: str, rounds: int = 100, alpha: float = 0.05) -> DataFrame:
    """1 - alpha quantile over rounds of mean |x| plus the robust deviation of x with hashed random signs.

    The rows are read a few times and never copied per round; the driver holds counts per round and bin and one number per round.
    """
    rows = signed_rows(df, x, rounds, lambda r: hashed([key], r, 2) == 0)
    if rows.isEmpty():
        return df.sparkSession.createDataFrame([(None,)], "tau double")
    mean = df.agg(F.avg(F.abs(x))).first()[0]
    stats = [(max(0.0, mean + mad / 0.67448975),) for mad in median_deviations(rows, rounds)]
    return exact_quantiles(df.sparkSession.createDataFrame(stats, "stat double"), "stat", {"tau": max(0.5, 1 - alpha)})


def edge_threshold(df: DataFrame, x: str, key: str, *, mode: str = "hybrid", alpha: float = 0.05, least: int = 200, rounds: int = 600,
                   heavy: float = 8.0, p: float = 0.05, fixed: float = 0.1) -> DataFrame:
    """Threshold from which on an edge counts, with the way it was found: method, reason, tau, sigma, kurtosis.

    Two-sided normal quantile times the robust deviation; where there are fewer than `least` values, or their tails are heavy
    (excess kurtosis over `heavy`, or its test below `p`), the sign-flip quantile instead. `mode` forces mad_z or bootstrap.
    """
    spark = df.sparkSession
    d = df.where(F.col(x).isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))).select(key, F.col(x).cast("double").alias(x))
    s = d.agg(F.count(F.lit(1)).alias("n"), F.avg(x).alias("m")).first()
    if not s["n"]:
        return spark.createDataFrame([("fixed", "no_finite_values", fixed, None, None)], "method string, reason string, tau double, sigma double, kurtosis double")
    w = F.col(x) - float(s["m"])
    v = d.agg(F.avg(w * w).alias("v2"), F.avg(w * w * w * w).alias("v4")).first()
    kurt = v["v4"] / v["v2"] ** 2 - 3.0 if s["n"] >= 8 and v["v2"] > 1e-12 else None
    tail = kurt is not None and (kurt > heavy or math.exp(-0.5 * s["n"] / 24.0 * kurt * kurt) < p)
    flip = mode == "bootstrap" or (mode == "hybrid" and (s["n"] < least or tail))
    reason = {"bootstrap": "forced_bootstrap", "mad_z": "forced_mad_z"}.get(mode, "low_n" if s["n"] < least else "heavy_tail" if tail else "mad_z_ok")
    r = d.select(robust_scale(d, x, F.lit(True)).alias("r")).limit(1)
    sigma = F.coalesce(F.col("r.mad"), F.lit(0.0)) / 0.67448975
    if flip:
        tau = sign_flip_threshold(d, x, key, max(rounds, 100), alpha).select("tau").scalar()
    else:
        tau = NormalDist().inv_cdf(1.0 - alpha / 2.0) * F.greatest(sigma, F.lit(1e-8))
    return r.select(F.lit("bootstrap" if flip else "mad_z").alias("method"), F.lit(reason).alias("reason"), clip(tau, 1e-6, 5.0).alias("tau"),
                    sigma.alias("sigma"), F.lit(kurt).cast("double").alias("kurtosis"))


def hashed(key: Sequence[str], seed, below: int) -> Column:
    """A number from 0 to below - 1 from the MD5 of the key and a seed, the same in every engine."""
    text = F.concat_ws("|", *[F.col(k).cast("string") for k in key], (F.lit(seed) if isinstance(seed, int) else c(seed)).cast("string"))
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("bigint") % below


def feature_dropout(df: DataFrame, cols: Sequence[str], key: Sequence[str], share: float, rows: Column, seed: int = 7) -> DataFrame:
    """Zero a column group on a share of the given rows, chosen by hash, so a rerun drops the same rows."""
    hit = rows & (hashed(key, seed, 10_000) < int(share * 10_000))
    return df.withColumns({n: F.when(hit, 0.0).otherwise(F.col(n)) for n in cols})
