import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from conftest import same, sorted_pd
from tickloom.functions import normal, options as opt
from tickloom.functions.exprs import clip, div, yes
from tickloom.operators import (context as cx, indicators as ind, labels as lab, market_structure as ms, paths as pt, price_action as pa, quality as ql,
                                sequences as seq, sessions, shapes, splits as sp, states, trade_log as tl, trend_rules as tr, volatility as vol)
from tickloom.operators.layout import in_chunks


def bars_of(spark, rows):
    """rows: (minutes, open, high, low, close, volume)"""
    t0 = pd.Timestamp("2024-01-02 09:30")
    p = pd.DataFrame([("X", t0 + pd.Timedelta(minutes=m), float(o), float(h), float(l), float(c), float(v), i) for i, (m, o, h, l, c, v) in enumerate(rows)],
                     columns=["symbol", "t", "open", "high", "low", "close", "volume", "bar_no"])
    return spark.createDataFrame(p).withColumn("t", F.col("t").cast("timestamp_ntz"))


def test_missing_and_zero(spark):
    r = spark.sql("select cast(null as double) x, 0.0D z").select(
        clip(F.col("x"), 0, 1).alias("a"), div(F.lit(1.0), F.col("z")).alias("b"), yes(F.col("x") > 1).alias("c")).first()
    assert r["a"] is None and r["b"] is None and r["c"] is False


@pytest.mark.parametrize("k,want", [(1, [False, True, True, True, True]), (0, [False, True, False, True, False])])
def test_same_day_carry(spark, k, want):
    times = ["2024-01-02 09:30", "2024-01-02 09:31", "2024-01-02 09:32", "2024-01-03 09:30", "2024-01-03 09:31"]
    p = pd.DataFrame({"symbol": "X", "t": pd.to_datetime(times), "sig": [False, True, False, True, False], "bar_no": range(5)})
    d = seq.carry_same_day(spark.createDataFrame(p), "sig", k, "out")
    assert sorted_pd(d)["out"].tolist() == want


def test_carry_of_missing_is_false(spark):
    d = spark.createDataFrame([("X", 0, None), ("X", 1, True)], "symbol string, bar_no bigint, sig boolean").withColumn("t", F.lit("2024-01-02").cast("timestamp_ntz"))
    assert sorted_pd(seq.carry_same_day(d, "sig", 0, "out"))["out"].tolist() == [False, True]


def test_max_drawdown(spark):
    eq = [1.0, 1.2, 0.9, 1.1]
    p = pd.DataFrame({"symbol": "X", "bar_no": range(4), "r": [0.0] + [b / a - 1 for a, b in zip(eq, eq[1:])]})
    m = tl.equity_metrics(spark.createDataFrame(p), ["symbol"], "r").first()
    assert abs(m["max_drawdown"] + 0.25) < 1e-12


def test_session_gap_is_strict(spark):
    day = [(0, 0), (1, 0), (1 + 240, 0), (1 + 480, 1)]
    p = pd.DataFrame({"symbol": "X", "bar_no": range(4), "t": [pd.Timestamp("2024-01-02") + pd.Timedelta(minutes=m, seconds=s) for m, s in day]})
    d = sessions.mark_sessions(spark.createDataFrame(p).withColumn("t", F.col("t").cast("timestamp_ntz")), open_skip=1, rows=2)
    g = sorted_pd(d)
    assert g["session_id"].tolist() == [0, 0, 0, 1]
    assert g["bar_of_session"].tolist() == [0, 1, 2, 0] and g["bars_remaining"].tolist() == [2, 1, 0, 0]
    assert g["valid"].tolist() == [False, True, True, False]


def vote(spark, mtm, prob=None, regime=1, start=20, ref=0, most=60):
    prob = prob or [0.1] * len(mtm)
    rows = [("T", start - len(mtm) + 1 + i, float(m), float(q), regime, ref, most) for i, (m, q) in enumerate(zip(mtm, prob))]
    d = spark.createDataFrame(rows, "trade_id string, step int, mtm double, exit_prob double, regime int, hold_ref int, max_hold int")
    r = pt.exit_vote(d, ["trade_id"]).orderBy(F.desc("step")).first()
    return r["exit_now"], r["exit_code"], r


def test_exit_vote_cases(spark):
    assert vote(spark, [0.1, 0.2, 0.3], start=3)[1] == "hold_min"
    assert vote(spark, [0.0, 0.1, 0.2, 0.3, 0.42, 0.6, 0.2])[:2] == (True, "profit_decay")
    assert vote(spark, [-0.03] * 8)[:2] == (True, "underwater_bleed")
    assert vote(spark, [0.05] * 3 + [-0.2] * 5)[:2] == (True, "underwater_bleed")
    assert vote(spark, [0.005] * 8, start=41)[:2] == (True, "regime_safety")
    assert vote(spark, [0.0] * 8, prob=[0.5] * 8, start=30)[:2] == (False, "time_model_underwater")
    z = vote(spark, [0.05] * 10, prob=[0.1, 0.11, 0.1, 0.12, 0.1, 0.11, 0.1, 0.12, 0.1, 0.3])[2]
    assert z["sig_model"] and not z["sig_underwater"]
    dd = vote(spark, [0.0, 0.5, 0.3])[2]
    assert dd["sig_drawdown"]
    assert not vote(spark, [0.05] * 4 + [-0.03] * 3)[2]["sig_underwater"]
    assert vote(spark, [0.02] * 8)[1] == "hold"


def test_triple_barrier_stops_at_gaps(spark):
    rows = [(0, 10, 10, 10, 10, 1), (1, 10, 10.2, 9.9, 10, 1), (400, 10, 13, 9.9, 12, 1), (401, 12, 12, 8, 9, 1), (402, 9, 20, 1, 9, 1)]
    d = in_chunks(bars_of(spark, rows), lambda x, f: lab.triple_barrier(x, f, F.col("close") + 1, F.col("close") - 1, 3), history=1, lookahead=3)
    assert sorted_pd(d)["barrier"].tolist() == [2, 2, 1, 2, 2]


def test_stop_is_tested_before_target(spark):
    rows = [(0, 10, 11, 9, 10, 1), (1, 10, 20, 1, 10, 1), (2, 10, 10, 10, 10, 1)]
    d = bars_of(spark, rows).withColumns({"signal": F.lit(1), "atr": F.lit(2.0)})
    g = sorted_pd(in_chunks(d, lab.signal_outcome, history=0, lookahead=30))
    assert g["outcome"].tolist()[0] == -1 and g["exit_bar"].tolist()[0] == 1


def test_position_cap_against_loop(spark):
    rng = np.random.default_rng(5)
    n = 400
    start = rng.integers(0, 300, n)
    p = pd.DataFrame({"trade_id": [f"{i:04d}" for i in range(n)], "symbol": "S", "a": start, "b": start + rng.integers(1, 60, n)})
    t0 = pd.Timestamp("2024-01-01")
    p["entry_time"], p["exit_time"] = t0 + pd.to_timedelta(p.pop("a"), unit="D"), t0 + pd.to_timedelta(p.pop("b"), unit="D")
    p = p.sort_values(["entry_time", "symbol", "trade_id"]).reset_index(drop=True)
    live, want = [], {}
    for r in p.itertuples():
        live = [x for x in live if x > r.entry_time]
        want[r.trade_id] = len(live) < 5
        if want[r.trade_id]:
            live.append(r.exit_time)
    d = spark.createDataFrame(p)
    d = d.withColumns({c: F.col(c).cast("timestamp_ntz") for c in ("entry_time", "exit_time")})
    got = tl.position_cap(d, 5, rows=50, warm=10).toPandas()
    assert {r.trade_id: r.kept for r in got.itertuples()} == want


def test_position_cap_folds_moments(spark, monkeypatch):
    """Days with many trades, some without length, without times or twice: as the loop, and no trade is folded that can't take a place."""
    rng = np.random.default_rng(8)
    n, limit = 3000, 4
    start = rng.integers(0, 30, n)
    t0 = pd.Timestamp("2024-01-01")
    p = pd.DataFrame({"book": rng.integers(0, 2, n), "trade_id": rng.integers(0, 400, n).astype(str), "symbol": "S", "no": np.arange(n)})
    p["entry_time"], p["exit_time"] = t0 + pd.to_timedelta(start, unit="D"), t0 + pd.to_timedelta(start + rng.integers(0, 9, n), unit="D")
    p.loc[::97, "exit_time"] = pd.NaT
    p = pd.concat([p, p.iloc[:600]]).sort_values(["entry_time", "symbol", "trade_id", "exit_time"])
    want = {}
    for book, rows in p.groupby("book"):
        live = []
        for r in rows.itertuples():
            live = [x for x in live if x > r.entry_time]
            kept = len(live) < limit or pd.isna(r.exit_time)
            if kept and not pd.isna(r.exit_time):
                live.append(r.exit_time)
            k = (book, r.entry_time, r.trade_id, r.exit_time if not pd.isna(r.exit_time) else None)
            want.setdefault(k, []).append(kept)
    d = spark.createDataFrame(p)
    d = d.withColumns({c: F.col(c).cast("timestamp_ntz") for c in ("entry_time", "exit_time")})
    sizes, fold = [], tl.ordered_fold
    monkeypatch.setattr(tl, "ordered_fold", lambda df, *a, **kw: sizes.append(df.count()) or fold(df, *a, **kw))
    got = {}
    for r in tl.position_cap(d, limit, keys=("book",), rows=7, warm=2).collect():
        got.setdefault((r.book, r.entry_time, r.trade_id, r.exit_time), []).append(r.kept)
    assert {k: sorted(v) for k, v in got.items()} == {k: sorted(v) for k, v in want.items()}
    assert sizes == [60]


def test_regime_segments_against_loop(spark):
    rng = np.random.default_rng(6)
    n = 300
    t0 = pd.Timestamp("2024-01-01")
    a = np.sort(rng.integers(0, 2000, n))
    p = pd.DataFrame({"symbol": "S", "trade_id": [f"{i:04d}" for i in range(n)], "regime": rng.integers(0, 2, n), "ret": 1.0,
                      "entry_time": t0 + pd.to_timedelta(a, unit="h"), "exit_time": t0 + pd.to_timedelta(a + rng.integers(1, 12, n), unit="h")})
    segs, cur = [], None
    for r in p.sort_values(["entry_time", "trade_id"]).itertuples():
        if cur and cur[0] == r.regime and r.entry_time >= cur[1] - pd.Timedelta(seconds=1):
            cur[1], cur[2] = max(cur[1], r.exit_time), cur[2] + 1
        else:
            cur = [r.regime, r.exit_time, 1]
            segs.append(cur)
    d = spark.createDataFrame(p)
    d = d.withColumns({c: F.col(c).cast("timestamp_ntz") for c in ("entry_time", "exit_time")})
    got = tl.regime_segments(d, rows=32, warm=4).toPandas()
    assert sorted(got["n"]) == sorted(s[2] for s in segs)


def test_impute_states_against_loop(spark):
    rng = np.random.default_rng(7)
    st = [None if rng.random() < 0.4 else int(rng.integers(0, 3)) for _ in range(200)]
    p = spark.createDataFrame([("X", i, s) for i, s in enumerate(st)], "symbol string, bar_no bigint, st int")
    m = np.ones((3, 3))
    for a, b in zip(st, st[1:]):
        if a is not None and b is not None:
            m[a, b] += 1
    m /= m.sum(1, keepdims=True)
    prior = np.array([1.0 + sum(s == k for s in st) for k in range(3)])
    want, prev = [], None
    for i, s in enumerate(st):
        if s is None:
            nxt = next((x for x in st[i:] if x is not None), None)
            s = int(np.argmax((m[prev] if prev is not None else prior) * (m[:, nxt] if nxt is not None else 1.0)))
        want.append(s)
        prev = s
    got = sorted_pd(states.impute_states(p, "st", 3, "out", rows=30, warm=2))
    assert got["out"].tolist() == want


def test_chandelier_and_zones_do_not_depend_on_chunks(walk_df):
    a = sorted_pd(tr.chandelier(walk_df, 5, 2.0))
    b = sorted_pd(tr.chandelier(walk_df, 5, 2.0, rows=100, warm=3))
    for n in ("ce_long_stop", "ce_short_stop", "ce_dir"):
        same(a[n], b[n])
    f, g = sorted_pd(ms.fair_value_gaps(walk_df)), sorted_pd(ms.fair_value_gaps(walk_df, rows=64, warm=0))
    same(f["active_bullish_fvg_top"], g["active_bullish_fvg_top"])
    same(f["active_bearish_fvg_bottom"], g["active_bearish_fvg_bottom"])


def test_features_use_no_future(walk_df):
    def build(d, f):
        d = vol.realised(d, f)
        d = vol.straddle(d, f)
        return vol.hurst(vol.trend_noise(vol.jumps(d, f), f), f)
    full = sorted_pd(in_chunks(walk_df, build, history=400)).query("bar_no < 300").reset_index(drop=True)
    part = sorted_pd(in_chunks(walk_df.where("bar_no < 300"), build, history=400))
    for n in full.columns:
        if n.startswith(("pa_", "rv_")):
            same(full[n], part[n])


def test_degenerate_bars(spark):
    flat = bars_of(spark, [(i, 10, 10, 10, 10, 0) for i in range(40)])
    one = bars_of(spark, [(0, 10, 11, 9, 10.5, 3)])
    for d in (flat, one):
        g = in_chunks(shapes.bar_anatomy(d), lambda x, f: shapes.pressure_label(shapes.bar_shape(x, f), f), history=12)
        g = in_chunks(g, lambda x, f: vol.moments(vol.volume_price(vol.straddle(vol.realised(x, f), f), f), f), history=400)
        g = vol.day_clock(vol.vwap_deviation(ind.pseudo_cvd(pa.pressure_score(g))))
        p = g.toPandas().select_dtypes("number")
        assert not np.isinf(p.to_numpy(dtype=float)).any()
        assert len(p) == d.count()
    assert pa.market_regime(one).first()["pa_env_state"] == "wide_tr"


def test_normal_and_options(spark):
    xs = [-9.0, -7.2, -3.0, -0.5, 0.0, 1.3, 6.9, 8.0]
    d = spark.createDataFrame([(x,) for x in xs], "x double").select("x", normal.cdf(F.col("x")).alias("p")).toPandas()
    for x, p in zip(d["x"], d["p"]):
        assert abs(p - 0.5 * math.erfc(-x / math.sqrt(2))) < 1e-15
    q = spark.createDataFrame([(x,) for x in (1e-9, 0.01, 0.16, 0.5, 0.84, 0.999999)], "p double")
    q = q.withColumn("x", normal.quantile(F.col("p"))).withColumn("b", normal.cdf(F.col("x"))).toPandas()
    assert np.abs(q["b"] - q["p"]).max() < 1e-15
    o = spark.sql("select 100D s, 0.05D t, 0.3D v")
    r = o.select(opt.call("s", F.lit(105.0), "t", "v").alias("c"), opt.put("s", F.lit(105.0), "t", "v").alias("p"), opt.call_strike("s", "t", "v", 0.16).alias("k"),
                 opt.put_strike("s", "t", "v", 0.16).alias("j"), opt.call("s", F.lit(90.0), F.lit(0.0), "v").alias("e")).first()
    assert abs(r["c"] - r["p"] - (100 - 105 * math.exp(-0.04 * 0.05))) < 1e-10 and r["e"] == 10.0

    def delta(k):
        a = (math.log(100 / k) + (0.04 + 0.045) * 0.05) / (0.3 * math.sqrt(0.05))
        return 0.5 * math.erfc(-a / math.sqrt(2))
    assert abs(delta(r["k"]) - 0.16) < 1e-9 and abs(1 - delta(r["j"]) - 0.16) < 1e-9
    s = opt.short_spread(o, "s", F.col("t"), F.col("v")).first()
    assert s["credit"] > 0 and s["max_loss"] > 0 and s["theta"] < 0


def test_sign_flip_threshold_and_split(spark):
    d = spark.createDataFrame([(i, float(i % 7 - 3)) for i in range(60)], "id bigint, x double")
    tau = sp.sign_flip_threshold(d, "x", "id", rounds=20).first()["tau"]
    assert tau > np.mean([abs(i % 7 - 3) for i in range(60)])
    t = spark.createDataFrame([(i // 3, i) for i in range(30)], "trade int, step int").withColumn("t", F.timestamp_seconds(F.col("step")).cast("timestamp_ntz"))
    parts = sp.trade_split(t, ["trade"], "t").groupBy("trade").agg(F.count_distinct("part").alias("n"))
    assert parts.agg(F.max("n")).first()[0] == 1


def test_plan_time_helpers(spark):
    d = spark.createDataFrame([(1.0, "x", True, 2)], "pa_a double, pa_tag string, or_b boolean, other int")
    assert ql.feature_columns(d) == ["pa_a", "or_b"]
    from tickloom.operators.feature_build import BLOCKS
    assert ql.needed_blocks(["pa_hurst_20", "pa_rv_cc_20"], BLOCKS) == ["realised", "hurst"]
    c = spark.createDataFrame([(float(i), float(2 * i), float((i * 7) % 5)) for i in range(20)], "a double, b double, c double")
    assert ql.drop_correlated(c, ["a", "b", "c"], {"default": 0.9}) == ["a", "c"]
    s = cx.structure_tags({"A": F.lit(None).cast("boolean"), "B": F.lit(False)})
    assert spark.range(1).select(s.alias("s")).first()["s"] == "None"
