"""Queries: files that bars, folds and caches are read from, column selection, the edge threshold."""
from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..operators import quality as ql, splits as sp
from ..operators.durable import shared_dir
from ..sources import bars as src
from .catalog import query, stream_query, table
from .data import BARS, TRADES, bars, trades


@stream_query("bars_from_files", "symbol:s t:t open:d high:d low:d close:d volume:d", BARS + " SELECT symbol, t, open, high, low, close, volume FROM bars")
def _(spark, d):
    """CSV files of bars, a folder for each symbol, scanned and cleaned."""
    home = f"{shared_dir(spark)}/bars-{uuid.uuid4().hex}"
    b = bars(lambda n: table(spark, d, n)).select("symbol", F.date_format("t", "yyyy-MM-dd HH:mm:ss").alias("time_key"), *src.OHLCV)
    bad = b.withColumns({"close": F.lit(float("inf")), "time_key": F.lit("1999-01-01 00:00:00")}).limit(5)
    b.unionByName(bad).write.partitionBy("symbol").option("header", True).csv(home)
    return src.clean_bars(src.read_bars(spark, home, "csv"))


@stream_query("feature_cache_reuse", "event_type:s n:i total:d builds:i", "SELECT event_type, count(*) AS n, sum(value) AS total, 2 AS builds FROM events GROUP BY event_type")
def _(spark, d):
    """Built once for a state of the source and a code version; a new version builds again."""
    store, built = f"{shared_dir(spark)}/cache-{uuid.uuid4().hex}", []

    def build():
        built.append(1)
        return table(spark, d, "events").groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))
    for version in ("a", "a", "b", "a", "b"):
        rows = src.cached(spark, f"{d}/events.parquet", version, store, build)
    return rows.withColumn("builds", F.lit(len(built)))


@stream_query("fold_specs", "fold:i test_start:t test_end:t n:i", TRADES + """, y AS (SELECT DISTINCT year(entry_time) AS y FROM trades), f AS (SELECT row_number() OVER (ORDER BY y) - 1 AS fold, make_date(y, 1, 1) AS a, make_date(y + 1, 1, 1) AS b FROM y)
SELECT fold, cast(a AS timestamp) AS test_start, cast(b AS timestamp) AS test_end, count(*) AS n FROM trades JOIN f ON entry_time >= a AND entry_time < b GROUP BY 1, 2, 3""")
def _(spark, d):
    """A JSON list of yearly folds, read back, checked, and joined to the trades."""
    home = f"{shared_dir(spark)}/folds-{uuid.uuid4().hex}"
    t = trades(lambda n: table(spark, d, n))
    years = t.select(F.year("entry_time").alias("y")).distinct()
    spec = years.select(F.concat(F.col("y"), F.lit("-01-01")).alias("test_start"), F.concat(F.col("y") + 1, F.lit("-01-01")).alias("test_end"))
    spec.coalesce(1).agg(F.to_json(F.collect_list(F.struct("test_start", "test_end"))).alias("value")).write.text(home)  # one row for each year
    folds = src.read_folds(spark, home)
    j = t.join(F.broadcast(folds), (F.col("entry_time") >= F.col("test_start")) & (F.col("entry_time") < F.col("test_end")))
    return j.groupBy("fold", F.col("test_start").cast("timestamp").alias("test_start"), F.col("test_end").cast("timestamp").alias("test_end")).agg(F.count(F.lit(1)).alias("n"))


@query("numeric_columns", "feature:s n:i mean:d", """WITH u AS (SELECT unnest(['pa_quantity', 'or_flag', 'pa_line']) AS feature, unnest([l_quantity, (l_tax > 0.04)::int::double, l_linenumber::double]) AS value FROM lineitem)
SELECT feature, count(value) AS n, avg(value) AS mean FROM u GROUP BY 1""")
def _(T):
    li = T("lineitem").select(F.col("l_quantity").alias("pa_quantity"), F.col("l_returnflag").alias("pa_returnflag"), (F.col("l_tax") > 0.04).alias("or_flag"), F.col("l_linenumber").alias("pa_line"),
                              F.col("l_discount").alias("pa_tag"), F.col("l_extendedprice").alias("price"))
    cols = ql.feature_columns(li, exclude=("pa_tag",))
    return ql.long_form(li, cols).groupBy("feature").agg(F.count("value").alias("n"), F.avg("value").alias("mean"))


@query("edge_threshold", "mode:s method:s reason:s tau:d sigma:d kurtosis:d", """WITH e AS (SELECT event_id, (value - 50) / 100 AS x FROM events), k AS (SELECT avg(x) AS m, count(*) AS n FROM e), v AS (SELECT avg(power(x - m, 2)) AS v2, avg(power(x - m, 4)) AS v4 FROM e, k),
q AS (SELECT v4 / (v2 * v2) - 3 AS kurtosis, n FROM v, k), c AS (SELECT quantile_cont(x, 0.5) AS md FROM e), z AS (SELECT quantile_cont(abs(x - md), 0.5) / 0.67448975 AS sigma FROM e, c),
r AS (SELECT event_id, abs(x) AS a, r FROM e, (SELECT unnest(range(1, 101)) AS r)), s AS (SELECT r, CASE WHEN cast('0x' || substr(md5(concat_ws('|', event_id, r)), 1, 8) AS bigint) % 2 = 0 THEN a ELSE -a END AS s FROM r),
m AS (SELECT r, quantile_cont(s, 0.5) AS md FROM s GROUP BY r), d AS (SELECT s.r, quantile_cont(abs(s - md), 0.5) AS mad FROM s JOIN m USING (r) GROUP BY s.r),
b AS (SELECT quantile_cont(greatest(0, (SELECT avg(abs(x)) FROM e) + mad / 0.67448975), 0.95) AS tau FROM d),
h AS (SELECT *, kurtosis > 8 OR exp(-0.5 * n / 24.0 * kurtosis * kurtosis) < 0.05 AS heavy FROM q, z, b)
SELECT 'hybrid' AS mode, CASE WHEN heavy THEN 'bootstrap' ELSE 'mad_z' END AS method, CASE WHEN heavy THEN 'heavy_tail' ELSE 'mad_z_ok' END AS reason, least(greatest(CASE WHEN heavy THEN tau ELSE 1.959963984540054 * sigma END, 1e-6), 5) AS tau, sigma, kurtosis FROM h
UNION ALL SELECT 'mad_z', 'mad_z', 'forced_mad_z', least(greatest(1.959963984540054 * sigma, 1e-6), 5), sigma, kurtosis FROM h""")
def _(T):
    e = T("events").select("event_id", ((F.col("value") - 50) / 100).alias("x"))
    one, two = (sp.edge_threshold(e, "x", "event_id", mode=m, rounds=100).withColumn("mode", F.lit(m)) for m in ("hybrid", "mad_z"))
    return one.unionByName(two)
