"""Structure breaks, order blocks and fair value gaps as event tables."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.exprs import div, fill, flag, yes
from . import indicators as ind
from .durable import durable
from .ewm import reach
from .layout import in_chunks, running
from .sequences import expanding
from .stacks import newest_alive


def pivot_levels(df: DataFrame, arm: int, tag: str, keys=("symbol",)) -> DataFrame:
    """Pivot prices on the bar that confirms them and the live level with its position and number."""
    d = in_chunks(df, lambda x, f: ind.centered_pivots(x, f, arm, "_ph", "_pl"), history=arm, lookahead=arm, keys=keys)
    d = in_chunks(d, lambda x, f: x.withColumns({
        f"{tag}_pivot_high": F.when(f.lag("_ph", arm) == 1, f.lag("high", arm)), f"{tag}_pivot_low": F.when(f.lag("_pl", arm) == 1, f.lag("low", arm))}),
        history=arm, keys=keys)
    cols = {}
    for side in ("high", "low"):
        p = F.col(f"{tag}_pivot_{side}")
        cols[f"_{tag}_{side}"] = ("last", F.when(p.isNotNull(), F.struct(p.alias("v"), (F.col("bar_no") - arm).alias("at"), F.col("bar_no").alias("no"))))
    return running(d, cols, keys=keys).drop("_ph", "_pl")


def breaks(df: DataFrame, arm: int, tag: str, other: str | None = None, keys=("symbol",)) -> DataFrame:
    """First close across each live pivot level: break of structure, or change of character against the trend.

    The first cross of a level is the first cross since its pivot, a `running`
    sum with the pivot as reset. The trend is the side of the latest break.
    """
    d = pivot_levels(df, arm, tag, keys)
    hi, lo = F.col(f"_{tag}_high"), F.col(f"_{tag}_low")

    def cross(x, f):
        pk = F.coalesce(f.lag("close"), F.col("close"))
        up = yes((pk <= hi["v"]) & (hi["v"] < F.col("close")))
        dn = yes((pk >= lo["v"]) & (lo["v"] > F.col("close")))
        if other is not None:
            up = up & yes(~hi["v"].eqNullSafe(F.col(f"_{other}_high")["v"]))
            dn = dn & yes(~lo["v"].eqNullSafe(F.col(f"_{other}_low")["v"]))
        return x.withColumns({"_up": up, "_dn": dn})
    d = in_chunks(d, cross, history=1, keys=keys)
    d = running(d, {"_nu": ("sum", flag(F.col("_up")).cast("bigint"), "h"), "_nd": ("sum", flag(F.col("_dn")).cast("bigint"), "l")}, keys=keys,
                resets={"h": F.col(f"{tag}_pivot_high").isNotNull(), "l": F.col(f"{tag}_pivot_low").isNotNull()})
    d = durable(d.withColumns({"_bu": F.col("_up") & (F.col("_nu") == 1), "_bd": F.col("_dn") & (F.col("_nd") == 1)}))
    # on a bar with both breaks the bearish one comes second and sets the trend
    d = running(d, {"_tr": ("last", F.when(F.col("_bd"), -1).when(F.col("_bu"), 1))}, keys=keys)

    def name(x, f):
        before = F.coalesce(f.lag("_tr"), F.lit(0))
        mid = F.when(F.col("_bu"), 1).otherwise(before)
        return x.withColumns({
            f"{tag}_bullish_choch": F.col("_bu") & (before == -1), f"{tag}_bullish_bos": F.col("_bu") & (before != -1),
            f"{tag}_bearish_choch": F.col("_bd") & (mid == 1), f"{tag}_bearish_bos": F.col("_bd") & (mid != 1)})
    return in_chunks(d, name, history=1, keys=keys).drop("_up", "_dn", "_nu", "_nd", "_tr").withColumnsRenamed({"_bu": f"_{tag}_bu", "_bd": f"_{tag}_bd"})


def structure_events(df: DataFrame, swing: int = 50, internal: int = 5, keys=("symbol",)) -> DataFrame:
    """Swing and internal breaks; an internal level equal to the swing level gives none."""
    d = breaks(df, swing, "swing", keys=keys)
    d = breaks(d, internal, "internal", other="swing", keys=keys)
    return d.drop("_swing_high", "_swing_low", "_internal_high", "_internal_low", "_swing_bu", "_swing_bd", "_internal_bu", "_internal_bd")


def order_blocks(df: DataFrame, swing: int = 50, atr_length: int = 200, by_close: bool = False, keys=("symbol",), **kw) -> DataFrame:
    """Order block created at a swing break and the newest block not yet mitigated.

    The block is the extreme parsed bar between the pivot and the break: a running extreme that starts anew with each
    confirmed pivot, with the extreme of the bars since the pivot itself as its first value.
    """
    def parsed(x, f):
        x = ind.atr(x, f, atr_length, "_va")
        wild = yes(F.col("high") - F.col("low") >= 2.0 * F.col("_va"))
        return x.withColumns({"_phi": F.when(wild, F.col("low")).otherwise(F.col("high")), "_plo": F.when(wild, F.col("high")).otherwise(F.col("low"))})
    d = in_chunks(df, parsed, history=reach(1.0 / atr_length) + 1, keys=keys)
    d = durable(breaks(d, swing, "swing", keys=keys))
    ends = [F.col("_phi").alias("top"), F.col("_plo").alias("bottom")]
    own = {"bullish": F.struct(F.col("_plo").alias("rank"), F.col("bar_no").alias("at"), *ends), "bearish": F.struct((-F.col("_phi")).alias("rank"), F.col("bar_no").alias("at"), *ends)}
    new = {"bullish": F.col("swing_pivot_high").isNotNull(), "bearish": F.col("swing_pivot_low").isNotNull()}
    d = in_chunks(d, lambda x, f: x.withColumns({f"_w_{s}": F.when(new[s], F.min(own[s]).over(f.last(swing + 1))).otherwise(own[s]) for s in own}), history=swing, keys=keys)
    d = running(d, {f"_b_{s}": ("min", F.col(f"_w_{s}"), s) for s in own}, keys=keys, resets=new)
    evt = {"bullish": "_swing_bu", "bearish": "_swing_bd"}
    out = d.withColumns({f"{s}_order_block_{e}": F.when(F.col(evt[s]), F.col(f"_b_{s}.{e}")) for s in own for e in ("top", "bottom")})
    out = durable(out.drop(*[f"_{x}_{s}" for x in "wb" for s in own], "_swing_high", "_swing_low", "_swing_bu", "_swing_bd", "_phi", "_plo", "_va"))
    price = {"bullish": "close" if by_close else "low", "bearish": "close" if by_close else "high"}
    for s in own:
        out = alive_zones(out, f"{s}_order_block", f"active_{s}_ob", F.col(price[s]), s == "bullish", keys, **kw)
    return out


def alive_zones(df: DataFrame, zone: str, out: str, price: Column, above: bool, keys=("symbol",), **kw) -> DataFrame:
    """Newest zone per bar that no bar since its creation has broken.

    A bullish zone lives while the price stays at or above its bottom; bearish zones are bullish ones of the negated price.
    """
    side = 1.0 if above else -1.0
    t, b = F.col(f"{zone}_top"), F.col(f"{zone}_bottom")
    return newest_alive(df, (b if above else t) * side, price * side, {f"{out}_top": t, f"{out}_bottom": b}, keys=keys, **kw)


def fair_value_gaps(df: DataFrame, keys=("symbol",), auto: bool = True, **kw) -> DataFrame:
    """Three-bar gaps larger than twice the mean bar move so far, and the newest unfilled one."""
    d = in_chunks(df, lambda x, f: x.withColumn("_d", fill(div(f.lag("close") - f.lag("open"), f.lag("open")), 0.0)), history=1, keys=keys)
    if auto:
        d = expanding(d.withColumn("_ad", F.abs("_d")), "_ad", mean="_m", std="_s", keys=keys).drop("_ad", "_s")
    else:
        d = d.withColumn("_m", F.lit(0.0))

    def mark(x, f):
        h2, l2, k1 = f.lag("high", 2), f.lag("low", 2), f.lag("close")
        thr = 2.0 * F.col("_m")
        up = yes((F.col("low") > h2) & (k1 > h2) & (F.col("_d") > thr))
        dn = yes((F.col("high") < l2) & (k1 < l2) & (-F.col("_d") > thr))
        return x.withColumns({"bullish_fvg": up, "bearish_fvg": dn,
                              "bullish_fvg_top": F.when(up, F.col("low")), "bullish_fvg_bottom": F.when(up, h2),
                              "bearish_fvg_top": F.when(dn, l2), "bearish_fvg_bottom": F.when(dn, F.col("high"))})
    d = in_chunks(d, mark, history=2, keys=keys).drop("_d", "_m")
    d = alive_zones(d, "bullish_fvg", "active_bullish_fvg", F.col("low"), True, keys, **kw)
    return alive_zones(d, "bearish_fvg", "active_bearish_fvg", F.col("high"), False, keys, **kw)
