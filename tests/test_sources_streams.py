import json

import pandas as pd
import pytest
from pyspark.sql import functions as F

from tickloom.operators.resample import resample
from tickloom.sources import bars as src
from tickloom.streaming import live


def ntz(d, *cols):
    return d.withColumns({c: F.col(c).cast("timestamp_ntz") for c in cols})


def test_csv_scan_and_cleaning(spark, tmp_path):
    (tmp_path / "AAA.csv").write_text("time_key,open,high,low,close,volume\n2024-01-02 09:31:00,1,2,0.5,1.5,10\n2024-01-02 09:30:00,1,2,0.5,n/a,10\n")
    d = src.clean_bars(src.read_bars(spark, str(tmp_path), "csv"))
    r = d.collect()
    assert len(r) == 1 and r[0]["symbol"] == "AAA" and r[0]["close"] == 1.5


def test_upsert_newest_page_wins(spark):
    s = "symbol string, t string, close double"
    old = ntz(spark.createDataFrame([("A", "2024-01-02 09:30", 1.0), ("A", "2024-01-02 09:31", 2.0)], s), "t")
    new = ntz(spark.createDataFrame([("A", "2024-01-02 09:31", 3.0, 0), ("A", "2024-01-02 09:31", 4.0, 1), ("A", "2024-01-02 09:32", 5.0, 0)], s + ", page bigint"), "t")
    assert [r["close"] for r in src.upsert(old, new).orderBy("t").collect()] == [1.0, 4.0, 5.0]


def test_cache_is_rebuilt_only_when_stale(spark, tmp_path):
    calls = []
    source, store = tmp_path / "in", str(tmp_path / "store")
    source.mkdir()
    (source / "a.txt").write_text("1")

    def build():
        calls.append(1)
        return spark.range(3)
    for version, n in (("v1", 1), ("v1", 1), ("v2", 2)):
        assert src.cached(spark, str(source), version, store, build).count() == 3
        assert len(calls) == n


def test_folds_are_checked(spark, tmp_path):
    good, bad = tmp_path / "good.json", tmp_path / "bad.json"
    good.write_text(json.dumps([{"test_start": "2024-01-01", "test_end": "2024-02-01", "note": "x"}]))
    bad.write_text(json.dumps([{"test_start": "2024-03-01", "test_end": "2024-02-01"}]))
    assert src.read_folds(spark, str(good)).count() == 1
    with pytest.raises(ValueError):
        src.read_folds(spark, str(bad)).count()


def test_bucket_edges_and_open_bucket(spark):
    rows = [("A", f"2024-01-02 {h}", float(i)) for i, h in enumerate(("09:00", "09:04", "09:05", "09:09", "09:12"))]
    d = ntz(spark.createDataFrame(rows, "symbol string, t string, close double"), "t")
    d = d.withColumns({n: F.col("close") for n in ("open", "high", "low")}).withColumn("volume", F.lit(1.0))
    r = resample(d, "5 minutes").orderBy("t").collect()
    assert [(str(x["t"])[11:16], x["open"], x["close"]) for x in r] == [("09:05", 0.0, 1.0), ("09:10", 2.0, 3.0)]


def test_pruned_scan_pushes_filter_and_columns(spark, tmp_path, walk_df):
    walk_df.write.parquet(str(tmp_path / "b"))
    d = src.between(spark.read.parquet(str(tmp_path / "b")), "2024-01-03", "2024-01-04").select("symbol", "close")
    plan = d._jdf.queryExecution().executedPlan().toString()
    scan = next(x for x in plan.splitlines() if "ReadSchema" in x)
    assert "GreaterThanOrEqual(t" in scan and "volume" not in scan


def test_late_rows_go_to_the_side_table(spark, tmp_path):
    store, late = str(tmp_path / "log"), str(tmp_path / "late")
    write = live.signal_log(store, late)
    one = spark.createDataFrame([("A", "2024-01-02 09:31", 1.0)], "symbol string, t string, x double").withColumn("t", F.col("t").cast("timestamp"))
    two = spark.createDataFrame([("A", "2024-01-02 09:30", 2.0), ("A", "2024-01-02 09:32", 3.0)], "symbol string, t string, x double").withColumn("t", F.col("t").cast("timestamp"))
    write(one, 0)
    write(two, 1)
    assert sorted(r["x"] for r in spark.read.parquet(store).collect()) == [1.0, 3.0]
    assert [r["x"] for r in spark.read.parquet(late).collect()] == [2.0]


def test_running_total_over_batches_equals_batch(spark, tmp_path):
    live.use_rocksdb(spark)
    for i in range(3):
        p = pd.DataFrame({"symbol": ["A", "A", "B"], "t": pd.to_datetime([f"2024-01-0{i + 1} 09:3{j}" for j in range(3)]), "delta": [1.0, 2.0, float(i)]})
        spark.createDataFrame(p).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    s = spark.readStream.schema("symbol string, t timestamp, delta double").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    got = live.drain(live.running_delta(s, spark.createDataFrame([("A", 10.0)], "symbol string, total double")), spark).toPandas()
    assert got[got["symbol"] == "A"]["total"].max() == 19.0 and got[got["symbol"] == "B"]["total"].max() == 3.0


def test_stream_vote_over_batches_equals_batch(spark, tmp_path):
    from tickloom.operators import paths as pt
    import numpy as np
    rng = np.random.default_rng(2)
    rows = [(f"T{k}", i + 1, float(rng.normal() * 0.1), float(rng.random() * 0.6), k % 5, 6, 28) for k in range(6) for i in range(30)]
    cols = "trade_id string, step int, mtm double, exit_prob double, regime int, hold_ref int, max_hold int"
    d = spark.createDataFrame(rows, cols)
    for lo in (0, 10, 20):
        d.where((F.col("step") > lo) & (F.col("step") <= lo + 10)).coalesce(1).write.mode("append").parquet(str(tmp_path / "in" / f"p{lo:02d}"))
    live.use_rocksdb(spark)
    s = spark.readStream.schema(cols).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(str(tmp_path / "in"))
    got = live.drain(live.exit_votes(s), spark)
    want = pt.exit_vote(d, ["trade_id"]).select("trade_id", "step", F.col("exit_code").alias("w"))
    j = got.join(want, ["trade_id", "step"])
    assert j.count() == 180 and j.where("exit_code <> w").count() == 0
