import os
import sys

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import SparkSession, functions as F

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    s = (SparkSession.builder.master("local[8]").appName("tickloom-tests")
         .config("spark.sql.shuffle.partitions", "4").config("spark.ui.enabled", "false")
         .config("spark.ui.showConsoleProgress", "false").config("spark.driver.memory", "8g")
         .config("spark.sql.session.timeZone", "UTC")
         .config("spark.checkpoint.dir", str(tmp_path_factory.mktemp("shared"))).getOrCreate())
    s.sparkContext.setLogLevel("OFF")
    return s


@pytest.fixture(scope="session")
def walk():
    """Two keys of random bars, a long one that fills many chunks and a short one, in shuffled order."""
    rng = np.random.default_rng(3)
    parts = []
    for key, n in (("A", 900), ("B", 30)):
        k = 50 + rng.normal(size=n).cumsum() * 0.5
        o = np.r_[k[0], k[:-1]] + rng.normal(size=n) * 0.1
        parts.append(pd.DataFrame({
            "symbol": key, "t": pd.Timestamp("2024-01-02 09:30") + pd.to_timedelta(np.arange(n) * 7, unit="min"),
            "open": o, "high": np.maximum(o, k) + rng.random(n), "low": np.minimum(o, k) - rng.random(n), "close": k,
            "volume": rng.integers(0, 9, n).astype(float), "bar_no": np.arange(n)}))
    return pd.concat(parts, ignore_index=True)


@pytest.fixture(scope="session")
def walk_df(spark, walk):
    d = spark.createDataFrame(walk.sample(frac=1, random_state=1))
    return d.withColumn("t", F.col("t").cast("timestamp_ntz")).cache()


def sorted_pd(df, by=("symbol", "bar_no")):
    return df.toPandas().sort_values(list(by)).reset_index(drop=True)


def same(a, b, tol=1e-8):
    a, b = np.asarray(a, dtype=float), np.asarray(b, dtype=float)
    assert (np.isnan(a) == np.isnan(b)).all()
    assert np.nanmax(np.abs(a - b), initial=0.0) < tol
