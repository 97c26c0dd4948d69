import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from conftest import same, sorted_pd
from tickloom.operators import ewm, fold, layout as L, ranks, rolling, scan, sequences as seq
from tickloom.operators.asof import asof_backward
from tickloom.operators.rangejoin import containing, forward_path


def per_key(p, fn):
    return np.concatenate([fn(g) for _, g in p.groupby("symbol")])


@pytest.mark.parametrize("piece", [None, "range"])
def test_number_rows(walk, walk_df, piece):
    got = sorted_pd(L.number_rows(walk_df.drop("bar_no"), piece=piece))
    assert (got["bar_no"] == got.groupby("symbol").cumcount()).all() and len(got) == len(walk)


@pytest.mark.parametrize("rows", [16, 64, 100_000])
def test_chunked_frames_equal_whole_frames(walk, walk_df, rows):
    def build(d, f):
        d = d.withColumns({"m": f.mean("close", 10, 3), "s": f.std("close", 20, 5), "q": f.quantile("close", 0.9, 15, 2), "n": f.lead("close", 2),
                           "k": rolling.kurt(f, "close", 12), "w": rolling.skew(f, "close", 12)})
        return rolling.linreg(d, f, "close", 8, "lr")
    p = sorted_pd(L.in_chunks(walk_df, build, history=20, lookahead=2, rows=rows))
    assert len(p) == len(walk)
    c = lambda fn: per_key(walk, lambda g: fn(g["close"]).to_numpy())
    same(p["m"], c(lambda x: x.rolling(10, min_periods=3).mean()))
    same(p["s"], c(lambda x: x.rolling(20, min_periods=5).std()))
    same(p["q"], c(lambda x: x.rolling(15, min_periods=2).quantile(0.9)))
    same(p["n"], c(lambda x: x.shift(-2)))
    same(p["k"], c(lambda x: x.rolling(12, min_periods=4).kurt()), 1e-6)
    same(p["w"], c(lambda x: x.rolling(12, min_periods=3).skew()), 1e-6)
    same(p["lr"], c(lambda x: x.rolling(8).apply(lambda y: np.polyval(np.polyfit(np.arange(8), y, 1), 7), raw=True)), 1e-6)


@pytest.mark.parametrize("rows", [300, 100_000])
def test_long_frames_equal_pandas(walk, walk_df, rows):
    flat = F.when(F.col("bar_no") > 500, F.lit(7.5)).otherwise(F.col("close"))
    gaps = F.when(F.col("volume") > 3, F.col("close"))
    d = walk_df.withColumns({"x": flat, "g": gaps})
    d = L.in_chunks(d, lambda v, f: v.withColumns({"m": f.mean("x", 200, 50), "s": f.std("x", 200, 50), "gm": f.mean("g", 150, 20), "gs": f.std("g", 150, 20),
                                                   "v": f.sum("volume", 130, 1), "hi": f.max("g", 140, 3), "lo": f.min("close", 133)}), history=201, rows=rows)
    p = sorted_pd(d)
    w = walk.assign(x=np.where(walk["bar_no"] > 500, 7.5, walk["close"]), g=walk["close"].where(walk["volume"] > 3))
    c = lambda n, fn: per_key(w, lambda g: fn(g[n]).to_numpy())
    same(p["m"], c("x", lambda x: x.rolling(200, min_periods=50).mean()))
    same(p["s"], c("x", lambda x: x.rolling(200, min_periods=50).std()), 1e-6)
    same(p["gm"], c("g", lambda x: x.rolling(150, min_periods=20).mean()))
    same(p["gs"], c("g", lambda x: x.rolling(150, min_periods=20).std()), 1e-6)
    same(p["v"], c("volume", lambda x: x.rolling(130, min_periods=1).sum()))
    same(p["hi"], c("g", lambda x: x.rolling(140, min_periods=3).max()))
    same(p["lo"], c("close", lambda x: x.rolling(133, min_periods=1).min()))
    assert p.query("symbol == 'A' and bar_no > 705")["s"].eq(0.0).all()


@pytest.mark.parametrize("rows", [16, 100_000])
def test_running_and_resets(walk, walk_df, rows):
    up = F.col("close") > F.col("open")
    d = L.running(walk_df, {"s": ("sum", F.col("close")), "m": ("max", F.col("close")), "l": ("last", F.when(up, F.col("close"))),
                            "z": ("sum", F.col("volume"), "r"), "zm": ("max", F.col("close"), "r")}, resets={"r": F.col("volume") == 0}, rows=rows)
    d = L.running(d, {"f": ("first", F.when(up, F.col("close"))), "b": ("min", F.col("close"))}, forward=True, rows=rows)
    p = sorted_pd(d)
    g = walk.groupby("symbol")
    same(p["s"], g["close"].cumsum(), 1e-6)
    same(p["m"], g["close"].cummax())
    hit = walk["close"].where(walk["close"] > walk["open"])
    same(p["l"], hit.groupby(walk["symbol"]).ffill())
    same(p["f"], hit.groupby(walk["symbol"]).bfill())
    same(p["b"], per_key(walk, lambda x: np.minimum.accumulate(x["close"].to_numpy()[::-1])[::-1]))
    isl = (walk["volume"] == 0).groupby(walk["symbol"]).cumsum()
    same(p["z"], walk.groupby(["symbol", isl])["volume"].cumsum())
    same(p["zm"], walk.groupby(["symbol", isl])["close"].cummax())


@pytest.mark.parametrize("rows", [100, 100_000])
def test_exponential_statistics(walk, walk_df, rows):
    def build(d, f):
        d = ewm.ewm_mean(d, f, "close", "a", span=20, least=20)
        d = ewm.ewm_mean(d, f, "close", "b", span=14, least=5, adjust=True)
        d = ewm.ewm_mean(d, f, "close", "c", alpha=0.5)
        return ewm.ewm_std(d, f, "close", "d", span=30, least=5)
    p = sorted_pd(L.in_chunks(walk_df, build, history=2 * ewm.reach(ewm.alpha_of(30)) + 1, rows=rows))
    c = lambda fn: per_key(walk, lambda g: fn(g["close"]).to_numpy())
    same(p["a"], c(lambda x: x.ewm(span=20, min_periods=20, adjust=False).mean()))
    same(p["b"], c(lambda x: x.ewm(span=14, min_periods=5).mean()))
    same(p["c"], c(lambda x: x.ewm(alpha=0.5, adjust=False).mean()))
    same(p["d"], c(lambda x: x.ewm(span=30, min_periods=5, adjust=False).std()))


@pytest.mark.parametrize("rows,depth", [(8, 3), (64, 3), (4096, 2)])
def test_affine_scan_is_exact(walk, walk_df, rows, depth):
    first = F.col("bar_no") == 0
    a = F.when(first, 0.0).otherwise(0.9 + 0.01 * F.col("volume"))
    d = scan.affine_scan(walk_df, {"y": (a, F.col("close"))}, rows=rows, depth=depth)

    def loop(g):
        out, y = [], 0.0
        for i, (k, v) in enumerate(zip(g["close"], g["volume"])):
            y = k if i == 0 else (0.9 + 0.01 * v) * y + k
            out.append(y)
        return np.array(out)
    want = per_key(walk, loop)
    got = sorted_pd(d)["y"].to_numpy()
    assert np.max(np.abs(got / want - 1)) < 1e-10


@pytest.mark.parametrize("warm", [0, 3, 50])
def test_fold_equals_serial_loop_whatever_the_guess(walk, walk_df, warm):
    def step(pdf, st):
        out = []
        for x in pdf["close"]:
            st = st + [x] if not st or x > st[-1] else st[:-1]
            out.append(float(len(st)))
        return {"s": out}, st
    got = sorted_pd(fold.ordered_fold(walk_df, step, {"s": "double"}, [], warm=warm, rows=200))
    want = per_key(walk, lambda g: np.array(step(g, [])[0]["s"]))
    assert (got["s"] == want).all()


def test_asof_against_pandas(spark):
    rng = np.random.default_rng(0)
    t0 = pd.Timestamp("2024-01-01")
    left = pd.DataFrame({"symbol": rng.choice(["A", "B"], 400), "t": t0 + pd.to_timedelta(rng.integers(0, 40_000, 400), unit="min"), "id": range(400)})
    right = pd.DataFrame({"symbol": rng.choice(["A", "B"], 60), "t": t0 + pd.to_timedelta(rng.integers(0, 40_000, 60), unit="min")}).drop_duplicates()
    right["v"] = np.arange(len(right), dtype=float)
    l, r = (spark.createDataFrame(x).withColumn("t", F.col("t").cast("timestamp_ntz")) for x in (left, right))
    for tol in (None, 600):
        kw = {"tolerance": F.expr(f"interval {tol} minutes")} if tol else {}
        got = asof_backward(l, r, ["v"], **kw).toPandas().sort_values("id")
        pk = {"tolerance": pd.Timedelta(minutes=tol)} if tol else {}
        want = pd.merge_asof(left.sort_values("t"), right.sort_values("t"), on="t", by="symbol", **pk).sort_values("id")
        same(got["v"], want["v"])


def test_forward_path_and_containment(walk, walk_df):
    e = walk_df.where("volume > 6").select("symbol", "bar_no", F.col("close").alias("entry"))
    got = forward_path(e, walk_df, 7, ["close"]).toPandas()
    want = sum(min(7, (walk["symbol"] == s).sum() - 1 - n) for s, n in walk.loc[walk["volume"] > 6, ["symbol", "bar_no"]].values)
    assert len(got) == want and got["step"].between(1, 7).all()
    seg = walk_df.where("bar_no % 100 = 0").select("symbol", F.col("t").alias("a"), (F.col("t") + F.expr("interval 3 hours")).alias("b"), F.col("bar_no").alias("seg"))
    hit = containing(walk_df, seg, "t", "a", "b", seconds=3600).toPandas()
    s = walk[walk["bar_no"] % 100 == 0]
    n = sum(((walk["symbol"] == r.symbol) & (walk["t"] >= r.t) & (walk["t"] <= r.t + pd.Timedelta(hours=3))).sum() for r in s.itertuples())
    assert len(hit) == n


def test_quantiles_and_ranks_with_a_hot_value(spark):
    x = np.r_[np.zeros(400), np.random.default_rng(1).normal(size=800).round(1)]
    p = pd.DataFrame({"k": np.where(np.arange(1200) % 3 == 0, "a", "b"), "x": x, "id": range(1200)})
    d = spark.createDataFrame(p).repartition(5)
    got = ranks.exact_quantiles(d, "x", {"a": 0.05, "b": 0.5, "c": 0.99}, ("k",)).toPandas().set_index("k").sort_index()
    same(got.to_numpy(), p.groupby("k")["x"].quantile([0.05, 0.5, 0.99]).unstack().to_numpy())
    r = ranks.average_rank(d, "x", "r").toPandas()
    same(r["r"], r["x"].rank())
    o = ranks.order_position(d, "x", "id").toPandas().sort_values(["x", "id"])
    assert (o["pos"].to_numpy() == np.arange(1200)).all()


def test_run_and_positions(walk, walk_df):
    p = sorted_pd(seq.direction_runs(walk_df))
    sg = np.sign(walk["close"] - walk["open"])
    isl = (sg != sg.groupby(walk["symbol"]).shift()).groupby(walk["symbol"]).cumsum()
    run = walk.groupby(["symbol", isl]).cumcount()
    assert (p["consec_bull"] == np.where(sg == 1, run + 1, 0)).all() and (p["same_state"] == run.clip(upper=40)).all()
