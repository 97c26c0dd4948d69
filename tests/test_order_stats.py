"""Rolling ranks and quantiles against pandas and against sorting each window."""
import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tickloom.operators.layout import in_chunks
from tickloom.operators.order_stats import Order, Sliding, order_stats, slide

SPECS = {"share": Order("x", 9, "share", 3), "rank": Order("x", 9, "rank", 4), "med": Order("x", 9, "quantile", 2), "q9": Order("x", 30, "quantile", 1, 0.9), "one": Order("y", 1, "rank")}


@pytest.mark.parametrize("size", [1, 3, 512])
def test_sliding_buckets(size):
    r, held, s = random.Random(1), [], Sliding(size)
    for _ in range(2000):
        if held and r.random() < 0.45:
            s.remove(held.pop(r.randrange(len(held))))
        else:
            held.append(r.choice([float(r.randrange(8)), r.random() * 8]))
            s.add(held[-1])
        v, order = r.choice([1.0, 3.0, 3.5, 9.0, -1.0]), sorted(held)
        assert (s.below(v), s.at_most(v)) == (sum(x < v for x in held), sum(x <= v for x in held))
        assert [s.kth(i) for i in range(len(order))] == order


@pytest.mark.parametrize("rows", [5, 40, 1000])
def test_against_pandas(spark, rows):
    rng = np.random.default_rng(2)
    x = np.where(rng.random(150) < 0.15, np.nan, rng.integers(0, 9, 150) / 2.0)
    p = pd.DataFrame({"symbol": np.where(np.arange(150) < 120, "A", "B"), "bar_no": np.r_[np.arange(120), np.arange(30)], "x": x, "y": rng.random(150).astype("float32")})
    d = spark.createDataFrame(p.sample(frac=1, random_state=1)).withColumns({"x": F.when(~F.isnan("x"), F.col("x")), "n": F.when(F.col("bar_no") % 2 == 0, F.array("bar_no"))})
    got = in_chunks(d, lambda t, f: order_stats(t, f, SPECS), history=30, rows=rows).orderBy("symbol", "bar_no")
    assert got.where("n[0] = bar_no").count() == d.where("n IS NOT NULL").count()
    got = got.toPandas()
    for _, g in p.groupby("symbol"):
        mine = got[got["symbol"] == g["symbol"].iloc[0]]
        r = g["x"].rolling(9, min_periods=1)
        k = r.count()
        want = {"med": g["x"].rolling(9, min_periods=2).median(), "q9": g["x"].rolling(30, min_periods=1).quantile(0.9), "one": g["y"] * 0 + 1,
                "rank": (g["x"].rolling(9, min_periods=1).rank() / k).where((k >= 4) & g["x"].notna()), "share": (r.rank(method="max") / k).where((k >= 3) & g["x"].notna())}
        for n, w in want.items():
            np.testing.assert_allclose(mine[n].to_numpy(dtype=float), w.to_numpy(dtype=float), atol=1e-12)


def test_wide_window_is_linear():
    x = np.random.default_rng(1).random(60_000)
    out = slide(x, [Order("x", 20_000, "rank"), Order("x", 20_000, "quantile", q=0.5)])
    assert out[0][-1] == (x[-20_000:] < x[-1]).sum() / 20_000 + 1 / 20_000 and abs(out[1][-1] - np.median(x[-20_000:])) < 1e-15
