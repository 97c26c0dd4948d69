"""Ranges ahead by the sparse table and long intervals by cells of every width, against brute force."""
import datetime as dt
import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tickloom.operators import labels
from tickloom.operators.layout import in_chunks
from tickloom.operators.rangejoin import containing
from tickloom.operators.sparse_table import Ahead


@pytest.mark.parametrize("most", [1, 2, 7, 30])
def test_ahead(most):
    rng = np.random.default_rng(most)
    x = np.where(rng.random(90) < 0.1, np.nan, rng.random(90))
    y = np.where(rng.random(90) < 0.1, np.nan, x - rng.random(90))
    a = Ahead(x, y, most)

    def span(i, n):
        h, l = x[i + 1:i + 1 + n], y[i + 1:i + 1 + n]
        return np.nan if np.isnan(h).all() or np.isnan(l).all() else np.nanmax(h) - np.nanmin(l)
    for n in range(1, most + 1):
        np.testing.assert_array_equal(a.span(n), [span(i, n) for i in range(90)])
    for goal in (0.0, 0.6, 1.3, 9.0):
        got = a.first(lambda s, goal=goal: s >= goal)
        want = [next((n for n in range(1, most + 1) if span(i, n) >= goal), most + 1) for i in range(90)]
        assert np.minimum(got, most + 1).tolist() == want


@pytest.mark.parametrize("rows", [7, 64, 1000])
def test_forward_ranges_do_not_depend_on_chunks(spark, walk_df, rows):
    d = walk_df.withColumn("atr", F.when(F.col("bar_no") % 11 != 0, 1.0 + F.col("volume")))
    one, two = (in_chunks(d, lambda x, f: labels.forward_ranges(x, f), history=0, lookahead=30, rows=n).orderBy("symbol", "bar_no").toPandas() for n in (rows, 5000))
    names = [c for c in one.columns if c.startswith("decision")]
    pd.testing.assert_frame_equal(one[names], two[names])
    a = one[one["symbol"] == "A"].reset_index(drop=True)
    assert a[names].iloc[-30:, 1:].isna().all().all() and a["decision_range_ttp90_norm_30"].notna().sum() > 700


def test_minutes_and_years_in_one_table(spark):
    r, t0 = random.Random(4), dt.datetime(2024, 1, 1)
    segs, rows = [], []
    for i in range(60):
        a = t0 + dt.timedelta(seconds=r.randrange(3 * 365 * 86400))
        segs.append((r.choice("AB"), i, a, a + dt.timedelta(seconds=r.choice([0, 30, 61, 3600, 90 * 86400, 1000 * 86400]))))
    for i in range(300):
        s = r.choice(segs)
        rows.append((r.choice("AB"), i, r.choice([s[2], s[3], s[2] - dt.timedelta(seconds=1), t0 + dt.timedelta(seconds=r.randrange(4 * 365 * 86400))])))
    ntz = lambda d, *c: d.withColumns({n: F.col(n).cast("timestamp_ntz") for n in c})
    d = ntz(spark.createDataFrame(rows, "symbol string, i int, t timestamp"), "t")
    s = ntz(spark.createDataFrame(segs, "symbol string, seg int, a timestamp, b timestamp"), "a", "b")
    got = sorted((x.i, x.seg) for x in containing(d, s, "t", "a", "b").collect())
    assert got == sorted((i, g) for k, i, t in rows for q, g, a, b in segs if k == q and a <= t <= b)
    assert containing(d, s.limit(0), "t", "a", "b").count() == 0
