"""Black-Scholes columns; time in years of 252 days with 390 minutes."""
from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.exprs import c, num
from .normal import cdf, pdf, quantile

RATE = 0.04
DAYS, MINUTES = 252.0, 390.0


def _inputs(s, k, sigma):
    return (F.greatest(num(c(s) if isinstance(s, str) else s).cast("double"), F.lit(1e-9)),
            F.greatest(num(c(k) if isinstance(k, str) else k).cast("double"), F.lit(1e-9)),
            F.greatest(num(c(sigma) if isinstance(sigma, str) else sigma).cast("double"), F.lit(1e-6)))


def _t(t):
    return c(t) if isinstance(t, str) else num(t)


def d1(s, k, t, sigma, r=RATE) -> Column:
    s, k, v = _inputs(s, k, sigma)
    safe = F.when(_t(t) > 0, _t(t)).otherwise(1.0)
    return (F.ln(s / k) + (r + 0.5 * v * v) * safe) / (v * F.sqrt(safe))


def call(s, k, t, sigma, r=RATE) -> Column:
    a = d1(s, k, t, sigma, r)
    x, y, v = _inputs(s, k, sigma)
    t = _t(t)
    live = x * cdf(a) - y * F.exp(-r * t) * cdf(a - v * F.sqrt(t))
    return F.when(t > 0, live).otherwise(F.greatest(x - y, F.lit(0.0)))


def put(s, k, t, sigma, r=RATE) -> Column:
    a = d1(s, k, t, sigma, r)
    x, y, v = _inputs(s, k, sigma)
    t = _t(t)
    live = y * F.exp(-r * t) * cdf(v * F.sqrt(t) - a) - x * cdf(-a)
    return F.when(t > 0, live).otherwise(F.greatest(y - x, F.lit(0.0)))


def straddle(s, k, t, sigma, r=RATE) -> Column:
    return call(s, k, t, sigma, r) + put(s, k, t, sigma, r)


def add_straddle(df: DataFrame, s: Column, k: Column, t: Column, sigma: Column, prefix: str = "") -> DataFrame:
    """Add price, delta, gamma, theta per day and vega per point of a straddle; zero Greeks at expiry.

    The steps are separate projections: Catalyst keeps them apart because their
    columns are used many times, so nothing is computed twice.
    """
    x, y, v = _inputs(s, k, sigma)
    d = df.withColumns({"_x": x, "_y": y, "_v": v, "_t": t.cast("double")})
    x, y, v, t = (F.col(n) for n in ("_x", "_y", "_v", "_t"))
    d = d.withColumn("_root", F.sqrt(F.when(t > 0, t).otherwise(1.0)))
    d = d.withColumn("_a", (F.ln(x / y) + (RATE + 0.5 * v * v) * F.col("_root") * F.col("_root")) / (v * F.col("_root")))
    d = d.withColumn("_b", F.col("_a") - v * F.col("_root"))
    d = d.withColumns({"_n1": cdf(F.col("_a")), "_n2": cdf(F.col("_b")), "_dens": pdf(F.col("_a")), "_df": F.exp(-RATE * t)})
    n1, n2, dens, root = (F.col(n) for n in ("_n1", "_n2", "_dens", "_root"))
    live = t > 0

    def at(val):
        return F.when(live, val).otherwise(0.0)
    two = 2.0 * n2 - 1.0
    d = d.withColumns({
        f"{prefix}price": F.when(live, x * (2.0 * n1 - 1.0) - y * F.col("_df") * two).otherwise(F.abs(x - y)),
        f"{prefix}delta": at(2.0 * n1 - 1.0),
        f"{prefix}gamma": at(2.0 * dens / F.greatest(x * v * root, F.lit(1e-9))),
        f"{prefix}theta": at((-(x * dens * v) / root - RATE * y * F.col("_df") * two) / DAYS),
        f"{prefix}vega": at(2.0 * x * dens * root / 100.0)})
    return d.drop("_x", "_y", "_v", "_t", "_root", "_a", "_b", "_n1", "_n2", "_dens", "_df")


def call_strike(s, t, sigma, delta: float, r=RATE) -> Column:
    """Strike in [s, 3s] whose call delta is nearest to `delta`, in closed form."""
    target = min(max(delta, 0.01), 0.49)
    x, _, v = _inputs(s, s, sigma)
    t = _t(t)
    k = x * F.exp((r + 0.5 * v * v) * t - v * F.sqrt(t) * quantile(F.lit(target)))
    return F.least(F.greatest(k, x), 3.0 * x)


def put_strike(s, t, sigma, delta: float, r=RATE) -> Column:
    """Strike in [0.05s, s] whose put delta is nearest to -`delta`."""
    target = min(max(delta, 0.01), 0.49)
    x, _, v = _inputs(s, s, sigma)
    t = _t(t)
    k = x * F.exp((r + 0.5 * v * v) * t - v * F.sqrt(t) * quantile(F.lit(1.0 - target)))
    return F.least(F.greatest(k, 0.05 * x), x)


def short_spread(df: DataFrame, s, t, sigma, *, condor_delta: float | None = 0.16, wing_pct: float = 0.01,
                 least_wing: float = 0.25, prefix: str = "") -> DataFrame:
    """Legs, credit, maximal loss and finite-difference Greeks of a short condor; `condor_delta=None` quotes a butterfly.

    Every leg is priced in five situations (as is, price up and down, later,
    higher volatility), in staged projections.
    """
    base = {"_x": F.greatest(c(s).cast("double"), F.lit(1e-9)), "_v": F.greatest(c(sigma).cast("double"), F.lit(1e-6)),
            "_t": F.greatest(_t(t).cast("double"), F.lit(1e-9))}
    d = df.withColumns(base)
    x, v, t = F.col("_x"), F.col("_v"), F.col("_t")
    d = d.withColumns({"_wing": F.greatest(F.lit(least_wing), wing_pct * x),
                       "_sp": put_strike(x, t, v, condor_delta) if condor_delta is not None else x,
                       "_sc": call_strike(x, t, v, condor_delta) if condor_delta is not None else x})
    d = d.withColumns({"_lp": F.greatest(F.col("_sp") - F.col("_wing"), F.lit(1e-9)), "_lc": F.col("_sc") + F.col("_wing"),
                       "_ds": F.greatest(x * 1e-4, F.lit(1e-4)), "_dv": F.greatest(v * 1e-3, F.lit(1e-5))})
    ds, dv = F.col("_ds"), F.col("_dv")
    cases = {"0": (x, t, v), "u": (x + ds, t, v), "d": (F.greatest(x - ds, F.lit(1e-9)), t, v),
             "l": (x, F.greatest(t - 1.0 / (MINUTES * DAYS), F.lit(1e-9)), v), "v": (x, t, v + dv)}
    legs = {"sp": -1, "lp": -1, "sc": 1, "lc": 1}
    d = d.withColumns({f"_{n}{i}": val for i, case in cases.items() for n, val in zip("xtv", case)})
    d = d.withColumns({f"_a{i}{leg}": d1(F.col(f"_x{i}"), F.col(f"_{leg}"), F.col(f"_t{i}"), F.col(f"_v{i}")) for i in cases for leg in legs})
    d = d.withColumns({f"_b{i}{leg}": F.col(f"_a{i}{leg}") - F.col(f"_v{i}") * F.sqrt(F.col(f"_t{i}")) for i in cases for leg in legs})
    d = d.withColumns({f"_{n}{i}{leg}": cdf(F.col(f"_{z}{i}{leg}") * sign) for n, z in (("p", "a"), ("q", "b"))
                       for i in cases for leg, sign in legs.items()})

    def price(i, leg):
        sign = legs[leg]
        live = sign * (F.col(f"_x{i}") * F.col(f"_p{i}{leg}") - F.col(f"_{leg}") * F.exp(-RATE * F.col(f"_t{i}")) * F.col(f"_q{i}{leg}"))
        return live
    d = d.withColumns({f"_c{i}": F.greatest(price(i, "sp") + price(i, "sc") - price(i, "lp") - price(i, "lc"), F.lit(0.0)) for i in cases})
    c0 = F.col("_c0")
    width = (F.greatest(F.col("_sp") - F.col("_lp"), F.col("_lc") - F.col("_sc"), F.lit(1e-9)) if condor_delta is not None else F.col("_wing"))
    out = {"short_put": F.col("_sp"), "long_put": F.col("_lp"), "short_call": F.col("_sc"), "long_call": F.col("_lc"), "credit": c0,
           "max_loss": F.greatest(width - c0, F.lit(1e-9)), "delta": (F.col("_cu") - F.col("_cd")) / (2.0 * ds),
           "gamma": (F.col("_cu") - 2.0 * c0 + F.col("_cd")) / (ds * ds), "theta": F.col("_cl") - c0, "vega": (F.col("_cv") - c0) / dv / 100.0}
    return d.select(*df.columns, *[e.alias(prefix + n) for n, e in out.items()])
