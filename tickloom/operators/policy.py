"""State keys, fitted buckets and threshold searches per state."""
from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.exprs import c, clip, fill, flag
from .durable import durable
from .paths import first_exits, uplift_score
from .ranks import exact_quantiles
from .splits import hold_bucket

# Volatility regimes with minimal profit and size multiplier.
VOL_REGIMES = ("low_vol_stable", "low_vol_rising", "mid_vol", "high_vol_stable", "high_vol_falling")
MIN_PROFIT = (2.5, 1.0, 1.5, 2.0, 3.0)
SIZE_MULT = (0.5, 1.5, 1.0, 0.8, 0.3)


def argmax(arr) -> Column:
    """0-based position of the first largest element."""
    return F.array_position(c(arr), F.array_max(c(arr))).cast("int") - 1


def quantile_buckets(df: DataFrame, x: str, n: int, out: str, fit: Column | None = None) -> DataFrame:
    """Number of fitted inner quantiles <= x; a missing x takes the median's bucket."""
    rows = df if fit is None else df.where(fit)
    qs = {f"e{i}": i / n for i in range(1, n)} | {"med": 0.5}
    e = exact_quantiles(rows, x, qs).select(F.struct(F.array(*[f"e{i}" for i in range(1, n)]).alias("e"), "med")).scalar()
    d = df.withColumn("_e", e)
    v = F.coalesce(F.col(x), F.col("_e.med"))
    return d.withColumn("_v", v).withColumn(out, F.size(F.filter("_e.e", lambda q: q <= F.col("_v")))).drop("_e", "_v")


def entry_key(regime, vol_bucket, pa_bucket=None) -> Column:
    k = F.concat(F.lit("r"), c(regime).cast("string"), F.lit("_v"), c(vol_bucket).cast("string"))
    return k if pa_bucket is None else F.concat(k, F.lit("_pa_"), c(pa_bucket))


def exit_key(regime, hold) -> Column:
    """Coarse state: 0 bull (0-1), 1 range (4-5), 2 bear (2-3), with the hold bucket."""
    r = c(regime)
    side = F.when(r <= 1, 0).when(r >= 4, 1).otherwise(2)
    return F.concat(F.lit("ex"), side.cast("string"), F.lit("_h"), hold_bucket(hold).cast("string"))


def fine_exit_key(regime, vol_bucket, hold) -> Column:
    return F.concat(entry_key(regime, vol_bucket), F.lit("_h"), hold_bucket(hold).cast("string"))


def pnl_phase_key(unreal, hold, median_hold, deep: float = 1.0) -> Column:
    """Profit in the first or second half of a usual hold, shallow or deep loss."""
    u, h = fill(c(unreal), 0.0), fill(c(hold).cast("double"), 0.0)
    half = 0.5 * F.greatest(c(median_hold), F.lit(1.0))
    return (F.when((u >= 0) & (h < half), "pnl_pf").when(u >= 0, "pnl_ps").when(F.abs(u) < deep, "pnl_um").otherwise("pnl_ud"))


def map_join(df: DataFrame, policy: DataFrame, key: str, defaults: Mapping[str, float]) -> DataFrame:
    """Thresholds of a row's state, the defaults where the state has none. The policy has one row per state."""
    j = df.join(policy.select(key, *defaults), key, "left")
    return j.withColumns({n: F.coalesce(F.col(n), F.lit(float(v))) for n, v in defaults.items()})


def vol_regimes(df: DataFrame, vol: str, trend: str, fit: Column, eps: float = 1e-3) -> DataFrame:
    """Five regimes from the fitted level thirds and the trend sign, with their name, minimal profit and size."""
    q = exact_quantiles(df.where(fit), vol, {"lo": 0.33, "hi": 0.66}).select(F.struct("lo", "hi")).scalar()
    d = df.withColumn("_q", q)
    v, t = F.col(vol), F.col(trend)
    rid = (F.when((v < F.col("_q.lo")) & (t > eps), 1).when(v < F.col("_q.lo"), 0)
           .when((v > F.col("_q.hi")) & (t < -eps), 4).when(v > F.col("_q.hi"), 3).otherwise(2))
    d = d.withColumn("vol_regime", rid)

    def pick(vals):
        return F.element_at(F.array(*[F.lit(x) for x in vals]), F.col("vol_regime") + 1)
    return d.withColumns({"vol_regime_name": pick(VOL_REGIMES), "min_profit": pick(MIN_PROFIT), "size_mult": pick(SIZE_MULT)}).drop("_q")


def straddle_edge(gate, range_pred, cost) -> Column:
    """Expected edge g (r - c) - (1 - g) c / 2."""
    g, r, k = clip(c(gate), 0.0, 1.0), F.greatest(c(range_pred), F.lit(0.0)), c(cost)
    return g * (r - k) + (1.0 - g) * (-k * 0.5)


def vol_signal(gate, threshold, edge, long_thr: float = 0.2, short_thr: float = 0.2) -> Column:
    on = c(gate) >= c(threshold) if isinstance(threshold, (str, Column)) else c(gate) >= threshold
    return F.when(on & (c(edge) >= long_thr), 1).when(on & (c(edge) <= -short_thr), -1).otherwise(0)


def straddle_size(df: DataFrame, gate: str, edge: str, on: Column, out: str = "size_pred") -> DataFrame:
    """gate x edge over its deviation and maximum on active rows, 0..1; 0 elsewhere."""
    raw = clip(F.col(gate), 0.0, 1.0) * F.greatest(F.col(edge), F.lit(0.0))
    d = df.withColumns({"_raw": raw, "_on": on})
    st = d.where("_on").agg(F.struct(F.stddev_pop("_raw").alias("sd"), F.max("_raw").alias("mx"))).scalar()
    d = d.withColumn("_st", st)
    den = F.col("_st.sd") + 1e-6
    top = F.col("_st.mx") / den
    return d.withColumn(out, F.when(F.col("_on") & (top > 1e-12), clip(F.col("_raw") / den / top, 0.0, 1.0)).otherwise(0.0)).drop("_raw", "_on", "_st")


def conditional_threshold(df: DataFrame, edge: str, key: str, fit: Column, q: float, base: float, least: int = 500,
                          scale: Column | None = None, out: str = "tau") -> DataFrame:
    """Quantile of |edge| per state with enough fit rows, else of all, within base multiples; scaled per row."""
    d = df.withColumn("_a", F.abs(edge))
    rows = d.where(fit & F.col("_a").isNotNull())
    overall = exact_quantiles(rows, "_a", {"g": q}).select(F.greatest(F.lit(0.5 * base), F.col("g"))).scalar()
    n = rows.groupBy(key).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") >= least)
    per = exact_quantiles(rows, "_a", {"_q": q}, (key,)).join(n, key)
    d = d.join(per.select(key, "_q"), key, "left").withColumn("_g", overall)
    top = F.greatest(F.lit(3.0 * base), 2.0 * F.col("_g"))
    tau = F.coalesce(F.least(F.greatest(F.col("_q"), F.lit(0.5 * base)), top), F.col("_g"))
    if scale is not None:
        tau = F.least(F.greatest(tau * scale, F.lit(0.5 * base)), top)
    return d.withColumn(out, tau).drop("_a", "_q", "_g")


def gate_candidates(df: DataFrame, gate: str, n: int = 101, rates: Sequence[float] = ()) -> DataFrame:
    """Distinct candidate thresholds from the gate's quantiles 1%..99%, and those at which the given shares of rows pass, cut to 0..1."""
    qs = {f"q{i}": 0.01 + 0.98 * i / (n - 1) for i in range(n)} | {f"r{i}": 1.0 - r for i, r in enumerate(rates)}
    return exact_quantiles(df, gate, qs).select(F.explode(F.array_distinct(F.array(*[clip(F.col(q), 0.0, 1.0) for q in qs]))).alias("threshold"))


def level_sums(df: DataFrame, gate: str, profit: str, limits: Column, keys: Sequence[str] = (), min_edge: float = 0.0) -> DataFrame:
    """Per key and level, the number of ascending `limits` that the gate reaches: rows, active rows, their gain and their largest weight.

    A row is active above `min_edge`; it weighs gate times positive profit and gains weight times profit. The sums of a threshold
    are those of its level and all higher ones, so rows are read once and never copied per threshold.
    """
    g, p = F.col(gate), F.col(profit)
    level = F.when(F.isnan(gate) | g.isNull(), 0).otherwise(F.size(F.filter("_limits", lambda t: t <= g)))
    on, weight = p > min_edge, clip(g, 0.0, 1.0) * F.greatest(p, F.lit(0.0))
    return df.withColumn("_limits", limits).withColumn("level", level).groupBy(*keys, "level").agg(
        F.count(F.lit(1)).alias("n"), F.sum(flag(on)).alias("active"), F.coalesce(F.sum(F.when(on, weight * p)), F.lit(0.0)).alias("gain"),
        F.coalesce(F.max(F.when(on, weight)), F.lit(0.0)).alias("top"))


def gate_score(active, gain, top, total, target_rate: float, rate_pen: float = 0.35, pf_bonus: float = 0.05) -> tuple[Column, Column, Column]:
    """(mean, rate, score) of a threshold from its sums.

    The size of an active row is its weight over the largest one and 0 without positive profit, so no active row loses: the terms for
    downside, drawdown and tail of the score are 0 at every threshold, and the gross loss of the profit factor is its floor, 1e-9.
    """
    total_gain = F.when(top / 1e-6 > 1e-12, gain / top).otherwise(0.0)
    mean, rate = total_gain / active, active / total
    return mean, rate, mean + pf_bonus * clip(total_gain / 1e-9, 0.0, 5.0) - rate_pen * F.abs(rate - target_rate)


def gate_search(df: DataFrame, gate: str, profit: str, target_rate: float, band: tuple[float, float], *, n: int = 101, min_edge: float = 0.0,
                **kw) -> DataFrame:
    """Scores of the quantile grid of the gate and of the thresholds at the lowest, wanted and highest rate. Thresholds that no row passes are left out.

    The candidates, about `n` numbers, come to the driver.
    """
    limits = sorted(r["threshold"] for r in gate_candidates(df, gate, n, (band[0], target_rate, band[1])).where("threshold IS NOT NULL").collect())
    sums = durable(level_sums(df, gate, profit, F.array(*[F.lit(x) for x in limits]).cast("array<double>"), min_edge=min_edge))
    total = sums.agg(F.sum("n")).scalar()
    place = df.sparkSession.createDataFrame([(i + 1, x) for i, x in enumerate(limits)], "level int, threshold double")
    both = place.join(sums.select("level", "active", "gain", "top"), "level", "full")
    up = Window.orderBy(F.desc("level")).rowsBetween(Window.unboundedPreceding, 0)  # one row for each candidate
    both = both.select("threshold", F.sum("active").over(up).alias("active"), F.sum("gain").over(up).alias("gain"), F.max("top").over(up).alias("top"))
    mean, rate, score = gate_score(F.col("active"), F.col("gain"), F.col("top"), total, target_rate, **kw)
    m = both.where("threshold IS NOT NULL AND active > 0").withColumns({"mean": mean, "rate": rate, "score": score, "max_dd": F.lit(0.0)})
    return m.withColumn("in_band", F.col("rate").between(*band)).drop("gain", "top")


def gate_offsets(df: DataFrame, gate: str, profit: str, key: str, base: float, target_rate: float, *,
                 steps: Sequence[float] = (-0.010, -0.006, -0.003, 0.0, 0.003, 0.006, 0.010), least: int = 500, min_edge: float = 0.0,
                 rate_pen: float = 0.35, pf_bonus: float = 0.05) -> DataFrame:
    """Best threshold offset per state: state after state in the order of names, with the offsets found so far in place.

    A step of 0 always competes, equal scores (to 12 digits) go to the lowest step, and states with fewer than `least` rows keep 0. The
    rows are read once, for their sums per state and step. The choice depends on all choices before it; it runs over these sums, one
    row for each state and step, on the driver: a state is one of a few (regime x volatility bucket) and not a key of the data.
    """
    steps = sorted({float(s) for s in steps} | {0.0})
    limits = [min(max(base + s, 0.0), 1.0) for s in steps]
    d = df.withColumn("state", F.col(key).cast("string"))
    sums = durable(level_sums(d, gate, profit, F.array(*[F.lit(x) for x in limits]), ("state",), min_edge))
    none = (0, 0.0, 0.0)
    tables, total, rows = {}, 0, {}
    for r in sums.orderBy("state", F.desc("level")).toLocalIterator():
        t = tables.setdefault(r["state"], [none] * len(steps))
        rows[r["state"]] = rows.get(r["state"], 0) + r["n"]
        total += r["n"]
        for i in range(r["level"]):
            t[i] = (t[i][0] + r["active"], t[i][1] + r["gain"], max(t[i][2], r["top"]))
    zero = steps.index(0.0)
    chosen = dict.fromkeys(tables, zero)
    large = sorted(s for s in tables if s is not None and rows[s] >= least)
    # Largest weights can't be taken away again, so those of the states that come later are kept as running maxima from the end.
    after = [0.0]
    for s in reversed(large):
        after.append(max(after[-1], tables[s][zero][2]))
    after.reverse()
    fixed = [tables[s][zero] for s in tables if s not in set(large)]
    active, gain = (sum(t[zero][k] for t in tables.values()) for k in (0, 1))
    top = max([x[2] for x in fixed], default=0.0)
    for j, s in enumerate(large):
        scored, old = [], tables[s][zero]
        for i, (n, w, m) in enumerate(tables[s]):
            a, g, t = active - old[0] + n, gain - old[1] + w, max(top, after[j + 1], m)
            if a:
                all_ = g / t if t / 1e-6 > 1e-12 else 0.0
                scored.append((-round(all_ / a + pf_bonus * min(max(all_ / 1e-9, 0.0), 5.0) - rate_pen * abs(a / total - target_rate), 12), i))
        if scored:
            chosen[s] = min(scored)[1]
        n, w, m = tables[s][chosen[s]]
        active, gain, top = active - old[0] + n, gain - old[1] + w, max(top, m)
    found = [(s, steps[i]) for s, i in chosen.items()]
    return df.sparkSession.createDataFrame(found, "state string, step double")


def product_size(gate, direction, edge, breakout, vol, persistence, threshold: float, clip_max: float = 5.0) -> Column:
    """Product of strength past the gate, direction margin, edge, breakout quality, damped volatility and persistence, 0..1."""
    act = clip((c(gate) - threshold) / max(1.0 - threshold, 1e-3), 0.0, 1.0)
    margin = F.abs(2.0 * clip(c(direction), 0.0, 1.0) - 1.0)
    return clip(act * (0.35 + 0.65 * margin) * (0.25 + 0.75 * clip(F.abs(c(edge)) / clip_max, 0.0, 1.0)) * (0.50 + 0.50 * clip(c(breakout), 0.0, 1.0))
                / (1.0 + clip(c(vol), 0.0, 5.0)) * (0.60 + 0.40 * clip(c(persistence), 0.0, 1.0)), 0.0, 1.0)


def bucket_size(df: DataFrame, gate: str, direction: str, edge: str, breakout: str, threshold: float, levels: Sequence[float] = (0.20, 0.35, 0.50, 0.70, 0.90),
                fit: Column | None = None, out: str = "size") -> DataFrame:
    """Size level by the quantiles of a signal score among active fit rows; 0 below the gate."""
    from .splits import quantile_rescale
    rows = F.lit(True) if fit is None else fit
    d = df.withColumns({"_ea": F.abs(edge), "_ba": F.abs(breakout)})
    d = quantile_rescale(quantile_rescale(d, "_ea", rows, out="_en"), "_ba", rows, out="_bn")
    act = clip((F.col(gate) - threshold) / max(1.0 - threshold, 1e-3), 0.0, 1.0)
    d = d.withColumn("_s", clip(0.45 * act + 0.30 * F.abs(2.0 * F.col(direction) - 1.0) + 0.15 * F.col("_bn") + 0.10 * F.col("_en"), 0.0, 1.0))
    k = len(levels) - 1
    qs = {f"c{i}": 0.2 + 0.6 * i / max(k - 1, 1) for i in range(k)}
    cuts = exact_quantiles(d.where(rows & (F.col(gate) >= threshold)), "_s", qs).select(F.array(*qs)).scalar()
    d = d.withColumn("_c", cuts)
    at = F.size(F.filter("_c", lambda q: q <= F.col("_s"))) + 1
    return d.withColumn(out, F.when(F.col(gate) < threshold, 0.0).otherwise(F.element_at(F.array(*[F.lit(float(x)) for x in levels]), at))).drop(
        "_ea", "_ba", "_en", "_bn", "_s", "_c")


def best_candidate(scores: DataFrame, target_rate: float) -> DataFrame:
    """Highest score inside the band if there is one, ties by the nearer rate."""
    rank = F.struct(F.col("in_band").cast("int").alias("b"), F.round("score", 12).alias("s"), (-F.abs(F.col("rate") - target_rate)).alias("r"))
    return scores.agg(F.max_by(F.struct("threshold", "score", "rate", "in_band"), rank).alias("x")).select("x.*")


def entry_search(df: DataFrame, key: str, cls: str, conf: str, size: str, edge: str, tau: float, confs: Sequence[float], sizes: Sequence[float],
                 least: int = 140, share: float = 0.35, bonus: Column | None = None) -> DataFrame:
    """Best (confidence, size) limits per state and overall ('*'), for states with enough rows.

    The candidates are the given ones and the `share` quantiles of confidence and size, cut to 0..1. `bonus` is a price-action
    score of each row (such as `context.entry_bonus`), whose mean over the rows that enter is added to the score.
    """
    truth = F.when(F.col(edge) > tau, 0).when(F.col(edge) < -tau, 2).otherwise(1)
    fine = lambda x: F.col(x).isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    limits = {}
    for name, x, given in (("min_confidence", conf, confs), ("min_size", size, sizes)):
        q = exact_quantiles(df.where(fine(x)), x, {"q": share}).first()["q"]
        limits[name] = sorted({min(max(float(v), 0.0), 1.0) for v in [*given, *([] if q is None else [q])]})
    grid = F.array(*[F.struct(F.lit(a).alias("min_confidence"), F.lit(b).alias("min_size")) for a in limits["min_confidence"] for b in limits["min_size"]])
    d = df.where(fine(conf) & fine(size) & fine(edge)).withColumns({"_t": truth, "_bonus": F.lit(0.0) if bonus is None else bonus})
    d = d.select(F.explode(F.array(F.col(key), F.lit("*"))).alias("state"), cls, conf, size, edge, "_t", "_bonus")
    d = d.withColumn("g", F.explode(grid)).select("state", cls, conf, size, edge, "_t", "_bonus", "g.*")
    go = (F.col(size) >= F.col("min_size")) & (F.col(conf) >= F.col("min_confidence")) & F.col(cls).isin(0, 2)
    act = F.col("_t") != 1
    m = d.groupBy("state", "min_confidence", "min_size").agg(
        F.count(F.lit(1)).alias("n"), F.avg(flag(act)).alias("target"), F.avg(flag(go)).alias("trade_rate"),
        F.avg(F.when(go, flag(F.col(cls) == F.col("_t")))).alias("correct_side"), F.avg(F.when(go, flag(act))).alias("precision"),
        F.avg(F.when(go, F.abs(edge))).alias("avg_abs_edge"), F.coalesce(F.avg(F.when(go, F.col("_bonus"))), F.lit(0.0)).alias("_bonus"))
    m = m.where((F.col("trade_rate") > 0) & ((F.col("state") == "*") | (F.col("n") >= least)))
    score = (0.55 * F.col("precision") + 0.30 * F.col("correct_side") + 0.20 * F.col("avg_abs_edge") - 0.20 * F.abs(F.col("trade_rate") - F.col("target")))
    m = m.withColumn("score", F.round(score + F.col("_bonus"), 12))
    first = F.struct(F.col("score"), (-F.col("min_confidence")).alias("a"), (-F.col("min_size")).alias("b"))
    return m.groupBy("state").agg(F.max_by(F.struct("min_confidence", "min_size", "score", "trade_rate", "precision", "correct_side", "avg_abs_edge"), first).alias("x")).select("state", "x.*")


def exit_search(path: DataFrame, trade: Sequence[str], prob: str, unreal: str, thresholds: Sequence[float], deltas: Sequence[float],
                early: int = 3, rate_band: tuple[float, float] = (0.001, 0.6)) -> DataFrame:
    """Uplift against the deadline per (threshold, early delta), with the exit rate and whether it is in bounds."""
    grid = F.array(*[F.struct(F.lit(float(a)).alias("threshold"), F.lit(float(b)).alias("delta")) for a in thresholds for b in deltas])
    d = path.select(*trade, "step", prob, unreal, F.explode(grid).alias("g")).select(*trade, "step", prob, unreal, "g.*")
    cut = F.when(F.col("step") < early, F.col("threshold") + F.col("delta")).otherwise(F.col("threshold"))
    d = d.withColumn("_x", F.col(prob) >= cut)
    k = ["threshold", "delta"]
    rate = d.groupBy(*k).agg(F.avg(flag(F.col("_x"))).alias("exit_rate"))
    up = uplift_score(first_exits(d, [*trade, *k], "_x", unreal), keys=k)
    return up.join(rate, k).withColumn("allowed", F.col("exit_rate").between(*rate_band))
