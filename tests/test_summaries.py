"""Two-pass folds over chunk summaries, the signal log under repeats, settings and caches."""
import datetime as dt
import hashlib
import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tickloom.operators import market_structure as ms, mlops, splits as sp, trade_log as tl
from tickloom.operators.durable import shared_dir
from tickloom.operators.layout import chunk_rows
from tickloom.sources import bars as src
from tickloom.streaming import live


def zones(n, seed, rising):
    rng = np.random.default_rng(seed)
    p = 100 + (np.arange(n) * 0.5 if rising else rng.normal(size=n).cumsum())
    b = np.where(rng.random(n) < 0.3, p - rng.random(n) * 3, np.nan)
    return pd.DataFrame({"symbol": "A", "bar_no": np.arange(n), "z_top": b + 1, "z_bottom": b, "price": p})


def newest_alive(z, above):
    out, alive = [], []
    for i, r in enumerate(z.itertuples()):
        if not math.isnan(r.z_bottom):
            alive.append(i)
        alive = [k for k in alive if (r.price >= z.z_bottom[k] if above else r.price <= z.z_top[k])]
        out.append(z.z_bottom[alive[-1]] if alive else None)
    return out


@pytest.mark.parametrize("rows, fan", [(1, 5), (7, 3), (64, 1000), (1000, 1000)])
@pytest.mark.parametrize("above, rising", [(True, True), (True, False), (False, False)])
def test_zones_do_not_depend_on_chunks(spark, rows, fan, above, rising):
    z = zones(150, 3, rising)
    df = spark.createDataFrame(z.sample(frac=1, random_state=1)).withColumns({n: F.when(~F.isnan(n), F.col(n)) for n in ("z_top", "z_bottom")})
    got = ms.alive_zones(df, "z", "o", F.col("price"), above, rows=rows, fan=fan).orderBy("bar_no").collect()
    assert [r.o_bottom for r in got] == newest_alive(z, above)


def test_trade_runs_do_not_depend_on_chunks(spark):
    rng = np.random.default_rng(5)
    n = 300
    start = np.sort(rng.integers(0, 4000, n))
    t = pd.DataFrame({"symbol": "A", "trade_id": [f"{i:04d}" for i in range(n)], "entry_time": pd.Timestamp("2024-01-01") + pd.to_timedelta(start, unit="s"),
                      "exit_time": pd.Timestamp("2024-01-01") + pd.to_timedelta(start + rng.integers(1, 40, n), unit="s"), "regime": (np.arange(n) // 40) % 3, "ret": 1.0})
    df = spark.createDataFrame(t).withColumns({x: F.col(x).cast("timestamp_ntz") for x in ("entry_time", "exit_time")})
    want, end, reg = [], None, None
    for r in t.itertuples():
        if reg == r.regime and r.entry_time >= end - pd.Timedelta(seconds=1):
            end, want[-1] = max(end, r.exit_time), want[-1] + 1
        else:
            end, reg = r.exit_time, r.regime
            want.append(1)
    for rows in (3, 50, 1000):
        got = tl.regime_segments(df, rows=rows).orderBy("segment").collect()
        assert [x.n for x in got] == want


def test_signal_log_repeats_nothing(spark):
    store = f"{shared_dir(spark)}/test-log"
    write = live.signal_log(store, store + "-late")
    rows = lambda *ms_: spark.createDataFrame([("S", dt.datetime(2024, 1, 1, 0, m), float(m)) for m in ms_], "symbol string, t timestamp, x double")
    write(rows(1, 2), 0)
    write(rows(3, 2, 4), 1)
    write(rows(3, 2, 4), 1)  # the same batch again
    write(rows(5, 4), 2)
    assert sorted(r.x for r in spark.read.parquet(store).collect()) == [1, 2, 3, 4, 5]
    assert sorted(r.x for r in spark.read.parquet(store + "-late").collect()) == [2, 4]


def test_cache_is_rebuilt_after_a_broken_build(spark, tmp_path):
    source, store, built = str(tmp_path / "in"), str(tmp_path / "store"), []
    spark.range(3).write.parquet(source)

    def build():
        built.append(1)
        if len(built) == 1:
            raise RuntimeError("broke off")
        return spark.read.parquet(source)
    with pytest.raises(RuntimeError):
        src.cached(spark, source, "v", store, build)
    assert src.cached(spark, source, "v", store, build).count() == 3 and src.cached(spark, source, "v", store, build).count() == 3 and len(built) == 2
    spark.range(2).write.mode("append").parquet(source)
    assert src.cached(spark, source, "v", store, build).count() == 5 and len(built) == 3


def test_infinite_bars_go(spark):
    rows = [("A", 1.0, 1.0, 1.0, 1.0, 1.0), ("B", 1.0, float("inf"), 1.0, 1.0, 1.0), ("C", 1.0, 1.0, float("nan"), 1.0, 1.0)]
    df = spark.createDataFrame(rows, "symbol string, open double, high double, low double, close double, volume double")
    assert [r.symbol for r in src.clean_bars(df).collect()] == ["A"]


def test_clusters_keep_rows_without_inputs_and_see_no_future(spark):
    rng = np.random.default_rng(2)
    v = rng.normal(size=90)
    v[10] = np.nan
    late = np.r_[v[:60], rng.normal(size=30) * 50]  # another future
    out = []
    for x in (v, late):
        df = spark.createDataFrame(pd.DataFrame({"i": np.arange(90), "v": x, "c": np.arange(90) // 30}))
        got = mlops.walk_forward_clusters(df, ["v"], 2, F.col("c")).orderBy("i").collect()
        assert len(got) == 90 and got[10].cluster is None
        out.append([r.cluster for r in got][:60])
    assert out[0] == out[1]


def test_edge_threshold_chooses(spark):
    rng = np.random.default_rng(1)
    cases = {"mad_z_ok": rng.normal(size=400), "low_n": rng.normal(size=60), "heavy_tail": rng.standard_t(2, size=400) ** 3}
    for reason, x in cases.items():
        df = spark.createDataFrame(pd.DataFrame({"k": np.arange(len(x)), "x": x}))
        r = sp.edge_threshold(df, "x", "k", rounds=100).first()
        assert r["reason"] == reason and 1e-6 <= r["tau"] <= 5
    empty = sp.edge_threshold(spark.createDataFrame([], "k int, x double"), "x", "k").first()
    assert (empty["method"], empty["reason"]) == ("fixed", "no_finite_values")


def test_sign_flips_are_exact_without_copies(spark, monkeypatch):
    """Continuous values, ties and zeros: the same threshold as with one copy of the rows per round, and no explode."""
    rng = np.random.default_rng(4)
    monkeypatch.setattr(F, "explode", None)
    for x in (rng.normal(size=3001), np.round(rng.normal(size=500), 1), np.zeros(7), np.array([0.3])):
        df = spark.createDataFrame(pd.DataFrame({"k": np.arange(len(x)), "x": x}))
        sign = [[1.0 if int(hashlib.md5(f"{k}|{r}".encode()).hexdigest()[:8], 16) % 2 == 0 else -1.0 for k in range(len(x))] for r in range(1, 21)]
        dev = []
        for s in np.array(sign) * np.abs(x):
            dev.append(max(0.0, np.abs(x).mean() + np.median(np.abs(s - np.median(s))) / 0.67448975))
        assert abs(sp.sign_flip_threshold(df, "x", "k", 20).first()["tau"] - np.quantile(dev, 0.95)) < 1e-12
    empty = spark.createDataFrame([], "k int, x double")
    assert sp.sign_flip_threshold(empty, "x", "k", 20).first()["tau"] is None


def test_chunk_size_comes_from_the_session(spark):
    df = spark.range(1)
    assert chunk_rows(df) == 32768 and chunk_rows(df, 5) == 5
    spark.conf.set("tickloom.chunkRows", "99")
    try:
        assert chunk_rows(df) == 99
    finally:
        spark.conf.unset("tickloom.chunkRows")


@pytest.mark.parametrize("floor", [0.0, None])
def test_deepest_fall_does_not_depend_on_pieces(spark, floor):
    from tickloom.operators.layout import deepest_fall
    rng = np.random.default_rng(7)
    x = {"A": rng.normal(size=200) - 0.1, "B": np.array([-1.0, 2.0, -3.0]), "C": np.array([1.0])}
    df = spark.createDataFrame([(k, i, float(v)) for k, vs in x.items() for i, v in enumerate(vs)], "k string, i long, x double").repartition(5)
    want = {}
    for k, v in x.items():
        run = np.cumsum(v)
        peak = np.maximum.accumulate(run)
        want[k] = float(np.min(run - (peak if floor is None else np.maximum(peak, floor))))
    for rows in (1, 7, 1000):
        got = {r.k: r.fall for r in deepest_fall(df, "x", keys=("k",), pos="i", floor=floor, rows=rows).collect()}
        assert got == pytest.approx(want)


def test_trades_are_joined_once(spark, tmp_path, monkeypatch):
    """Queries that read their scored trades several times read them from one written join, with few columns."""
    from tickloom.plans import q_model
    from tickloom.plans.catalog import load
    day = "timestamp_ntz '1996-03-01'"
    spark.range(60).selectExpr("id AS o_orderkey", "id AS o_custkey", f"{day} + make_dt_interval(int(id % 7)) AS o_orderdate", "concat(id % 5, '-X') AS o_orderpriority").write.parquet(f"{tmp_path}/orders.parquet")
    spark.range(300).selectExpr("id % 60 AS l_orderkey", "id AS l_partkey", "id % 9 AS l_suppkey", "int(id) AS l_linenumber", "double(id) AS l_quantity", "id * 1.5D AS l_extendedprice",
                                "(id % 11) / 100D AS l_discount", "(id % 8) / 100D AS l_tax", "if(id % 3 = 0, 'A', 'N') AS l_returnflag", "'O' AS l_linestatus",
                                f"{day} + make_dt_interval(int(id % 90)) AS l_shipdate").write.parquet(f"{tmp_path}/lineitem.parquet")
    joins, real = [], q_model.stored
    monkeypatch.setattr(q_model, "stored", lambda df: joins.append(df.columns) or real(df))
    for name in ("size_formulas", "scale_robust", "engine_gate", "conditional_threshold", "metrics_tail_spearman", "weights_tail_rank", "policy_map_join"):
        joins.clear()
        got = load()[name].plan(spark, str(tmp_path))
        assert len(joins) == 1 and len(joins[0]) <= 7, name
        assert "lineitem" not in "".join(got.inputFiles()) and got.count() > 0, name


def test_last_results_in_pieces(monkeypatch):
    """Rows of a state leave in pieces and go on from the kept results, whatever the size of a piece."""
    class Kept:
        xs = None

        def exists(self):
            return self.xs is not None

        def get(self):
            return self.xs

        def update(self, v):
            self.xs = v
    monkeypatch.setattr(live, "PIECE", 7)
    rng = np.random.default_rng(3)
    state, want, got = live.LastN(), [], []
    state.kept = Kept()
    xs = []
    for n in (1, 3, 30, 70, 120):
        p = pd.DataFrame({"key": "k", "id": np.arange(n), "t": pd.Timestamp("2024-01-01") + pd.to_timedelta(rng.integers(0, 9, n), unit="s"), "x": rng.normal(size=n)})
        for r in p.sort_values(["t", "id"]).itertuples():
            xs = [*xs, r.x][-50:]
            want.append((r.id, np.mean(np.array(xs) > 0), np.mean(xs)))
        parts = list(state.handleInputRows(("k",), iter([p.iloc[:n // 2], p.iloc[n // 2:]]), None))
        assert max(map(len, parts)) <= 7
        got += [(r.id, r.win_rate, r.mean) for q in parts for r in q.itertuples()]
    assert np.allclose(np.array(got), np.array(want))


def test_trees_get_even_parts(spark):
    """Rows in order of time: no part is larger than asked for, and every part has rows of each fold."""
    d = spark.range(0, 5000, 1, 1).withColumn("fold", (F.col("id") >= 2500).cast("int"))
    parts = [r.asDict() for r in mlops.even_parts(d, 500).groupBy(F.spark_partition_id().alias("p")).agg(
        F.count(F.lit(1)).alias("n"), F.count_distinct("fold").alias("k")).collect()]
    assert sum(p["n"] for p in parts) == 5000 and max(p["n"] for p in parts) <= 510 and {p["k"] for p in parts} == {2}
    assert mlops.even_parts(d, 5000).rdd.getNumPartitions() == 1  # small enough as they are
    assert mlops.even_parts(d.limit(0)).count() == 0
