"""Queries: bounded streams over the event files, and Spark ML on scored rows."""
from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.exprs import div
from ..operators import mlops
from ..operators.durable import durable, shared_dir
from ..operators.layout import number_rows
from ..streaming import live
from .catalog import query, stream_query
from .data import TRADES
from .q_model import scored, A
from .q_paths import PATH, TR, VOTE, path
from ..operators import splits as sp

DELAY = "1 hour"
CUT = "(SELECT max(ts) - INTERVAL 1 HOUR FROM events)"


def ticks(spark, sf_dir):
    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    live.use_rocksdb(spark)
    e = live.read_ticks(spark, f"{sf_dir}/event[s].parquet", schema, delay=DELAY)
    return e.withColumn("symbol", F.col("event_type"))


BAR_SQL = f"""b AS (SELECT event_type AS symbol, time_bucket(INTERVAL 1 HOUR, ts) + INTERVAL 1 HOUR AS t, first(value ORDER BY ts, event_id) AS open, max(value) AS high, min(value) AS low, last(value ORDER BY ts, event_id) AS close, count(*) AS volume,
  sum(CASE WHEN user_id % 3 = 0 THEN value WHEN user_id % 3 = 1 THEN -value ELSE 0 END) AS delta FROM events GROUP BY 1, 2 HAVING time_bucket(INTERVAL 1 HOUR, min(ts)) + INTERVAL 1 HOUR <= {CUT})"""


def signed():
    d = F.when(F.col("user_id") % 3 == 0, "BUY").when(F.col("user_id") % 3 == 1, "sell").otherwise("none")
    return live.signed_volume(d, "value")


@stream_query("stream_closed_bars", "symbol:s t:t open:d high:d low:d close:d volume:d", "WITH " + BAR_SQL + " SELECT * FROM b")
def _(spark, d):
    return live.drain(live.bars(ticks(spark, d), "1 hour").drop("w"), spark)


@stream_query("stream_running_delta", "symbol:s t:t delta:d total:d", "WITH " + BAR_SQL + " SELECT symbol, t, delta, sum(delta) OVER (PARTITION BY symbol ORDER BY t) + CASE symbol WHEN 'view' THEN 100 ELSE 0 END AS total FROM b")
def _(spark, d):
    start = spark.createDataFrame([("view", 100.0)], "symbol string, total double")
    return live.drain(live.running_delta(live.delta_per_window(ticks(spark, d), "1 hour", signed()), start), spark)


@stream_query("stream_bar_delta_join", "symbol:s t:t close:d delta:d", "WITH " + BAR_SQL + " SELECT * FROM b")
def _(spark, d):
    b = live.bars(ticks(spark, d), "1 hour")
    return live.drain(live.bar_with_delta(b, live.delta_per_window(ticks(spark, d), "1 hour", signed())).drop("w"), spark)


@stream_query("stream_sessions", "user_id:i start_:t last_:t n:i", f"""WITH g AS (SELECT *, coalesce((ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) >= INTERVAL 4 HOUR)::int, 0) AS brk FROM events),
s AS (SELECT *, sum(brk) OVER (PARTITION BY user_id ORDER BY ts) AS sid FROM g) SELECT user_id, min(ts) AS start_, max(ts) AS last_, count(*) AS n FROM s GROUP BY user_id, sid HAVING max(ts) + INTERVAL 4 HOUR <= {CUT}""")
def _(spark, d):
    return live.drain(live.sessions(ticks(spark, d), keys=("user_id",)), spark).withColumnsRenamed({"start": "start_", "last": "last_"})


@stream_query("stream_dedupe", "event_id:i symbol:s value:d", "SELECT event_id, event_type AS symbol, value FROM events")
def _(spark, d):
    twice = ticks(spark, d).withColumn("copy", F.explode(F.array(F.lit(0), F.lit(1))))
    return live.drain(live.dedupe(twice, ("symbol", "event_id")), spark)


@stream_query("stream_live_statistics", "id:i win_rate:d mean:d", """SELECT event_id AS id, avg((value > 30)::int) OVER w AS win_rate, avg(value - 30) OVER w AS mean FROM events WINDOW w AS (PARTITION BY event_type ORDER BY ts, event_id ROWS 49 PRECEDING)""")
def _(spark, d):
    e = ticks(spark, d).select(F.col("symbol").alias("key"), F.col("event_id").alias("id"), F.col("ts").alias("t"), (F.col("value") - 30).alias("x"))
    return live.drain(live.live_statistics(e), spark)


@stream_query("stream_exit_vote", "trade_id:s step:i exit_code:s", PATH + ", " + VOTE + " SELECT symbol || '-' || eb AS trade_id, step, code AS exit_code FROM vote")
def _(spark, d):
    from .catalog import table
    p = path(lambda n: table(spark, d, n)).select(F.concat_ws("-", "symbol", "eb").alias("trade_id"), "step", "mtm", "exit_prob", "regime",
                                                  F.lit(6).alias("hold_ref"), F.lit(28).alias("max_hold"))
    import uuid
    home = f"{shared_dir(spark)}/marks-{uuid.uuid4().hex}"
    p.write.parquet(home)
    live.use_rocksdb(spark)
    return live.drain(live.exit_votes(spark.readStream.schema(p.schema).parquet(home)), spark)


@stream_query("stream_signal_log", "symbol:s t:t close:d", "WITH " + BAR_SQL + " SELECT * FROM b")
def _(spark, d):
    import uuid
    store = f"{shared_dir(spark)}/log-{uuid.uuid4().hex}"
    live.foreach_drain(live.bars(ticks(spark, d), "1 hour").drop("w"), spark, live.signal_log(store, store + "-late"))
    return spark.read.parquet(store).drop("batch", "day")


@stream_query("stream_bar_running_delta", "symbol:s t:t close:d delta:d total:d", f"""WITH b AS (SELECT event_type AS symbol, time_bucket(INTERVAL 1 HOUR, ts) + INTERVAL 1 HOUR AS t, last(value ORDER BY ts, value) AS close, sum(CASE WHEN value > 80 THEN CASE WHEN user_id % 3 = 0 THEN value WHEN user_id % 3 = 1 THEN -value ELSE 0 END END) AS delta
  FROM events GROUP BY 1, 2 HAVING time_bucket(INTERVAL 1 HOUR, min(ts)) + INTERVAL 1 HOUR <= {CUT}) SELECT *, sum(delta) OVER (PARTITION BY symbol ORDER BY t) AS total FROM b""")
def _(spark, d):
    return live.drain(live.bars_with_running_delta(ticks(spark, d), ticks(spark, d).where("value > 80").withColumn("signed", signed()), "1 hour"), spark)


@query("ml_soft_clusters", "cluster:i n:i mean_member:d")
def _(T):
    d = mlops.soft_clusters(T("embeddings"), "embedding", 5)
    return d.groupBy("cluster").agg(F.count(F.lit(1)).alias("n"), F.avg(F.array_max("membership")).alias("mean_member"))


@query("ml_walk_forward_clusters", "cluster:i n:i mean_value:d")
def _(T):
    e = T("events").select("ts", "value", F.col("user_id").cast("double").alias("u"))
    d = mlops.walk_forward_clusters(e, ["value", "u"], 3, F.floor(F.datediff("ts", F.lit("1970-01-01")) / 10).cast("int"))
    return d.groupBy("cluster").agg(F.count(F.lit(1)).alias("n"), F.avg("value").alias("mean_value"))


@query("ml_two_streams", "state:i n:i n_smooth:i")
def _(T):
    d = number_rows(T("events").select(F.col("event_type").alias("symbol"), "ts", "event_id", "value", F.abs(F.col("value") - 50).alias("dev"), (F.col("user_id") % 17).cast("double").alias("u")), ("symbol",), ("ts", "event_id"), "range")
    d = mlops.two_streams(d, ["value", "u"], ["dev", "u"], (3, 2), F.floor(F.datediff("ts", F.lit("1970-01-01")) / 10).cast("int"))
    one = d.groupBy("state").agg(F.count(F.lit(1)).alias("n"))
    return one.join(d.groupBy(F.col("smooth_state").alias("state")).agg(F.count(F.lit(1)).alias("n_smooth")), "state", "full")


@query("ml_boosted_heads", "fold:i n:i gate:d range_:d edge:d quality:d")
def _(T):
    s = scored(T).select("trade_id", "entry_time", F.col("hold").cast("double").alias("hold"), "p", F.col("regime").cast("double").alias("rg"), "y", "v", F.abs("v").alias("size"))
    s = s.withColumn("good", (F.col("v") > 0.5).cast("int"))
    d = sp.blocked_folds(s, 2, ("entry_time", "trade_id")).select("hold", "p", "rg", "y", "v", "size", "good", "fold")
    o = mlops.boosted_heads(d, ["hold", "p", "rg"], {"gate": ("classifier", "y"), "range_": ("regressor", "size"), "edge": ("regressor", "v"), "quality": ("classifier", "good")}, "fold", 2, most=4)
    return o.groupBy("fold").agg(F.count(F.lit(1)).alias("n"), *[F.avg(h).alias(h) for h in ("gate", "range_", "edge", "quality")])


@query("ml_novelty", "label:i n:i mean_novelty:d")
def _(T):
    d = mlops.novelty(T("embeddings"), "embedding", 8, F.col("label") < 5)
    return d.groupBy("label").agg(F.count(F.lit(1)).alias("n"), F.avg("novelty").alias("mean_novelty"))


@query("ml_isotonic", "n:i brier:d lo:d hi:d")
def _(T):
    d = mlops.isotonic(scored(T), "y", "p", F.col("entry_time") < sp.ts(A))
    return d.agg(F.count(F.lit(1)).alias("n"), F.avg(F.pow(F.col("y") - F.col("calibrated"), F.lit(2))).alias("brier"), F.min("calibrated").alias("lo"), F.max("calibrated").alias("hi"))


@query("ml_boosted_oof", "fold:i n:i mean_oof:d")
def _(T):
    s = scored(T).select("trade_id", "entry_time", F.col("hold").cast("double").alias("hold"), "p", F.col("regime").cast("double").alias("rg"), "y")
    d = sp.blocked_folds(s, 2, ("entry_time", "trade_id")).select("hold", "p", "rg", "y", "fold")
    o = mlops.out_of_fold_trees(d, ["hold", "p", "rg"], "y", "fold", 2, rounds=3)
    return o.groupBy("fold").agg(F.count(F.lit(1)).alias("n"), F.avg("oof").alias("mean_oof"))


@query("ml_gain_share", "name:s")
def _(T):
    d = durable(scored(T).select(F.col("hold").cast("double").alias("hold"), "p", F.col("regime").cast("double").alias("rg"), "v"))
    return mlops.gain_share(d, ["hold", "p", "rg"], "v", keep_min=1).where("kept").select("name")


@query("hurdle_prediction", "trade_id:s pred:d epsilon:d", TRADES + """, e AS (SELECT least(greatest(quantile_cont(abs(ret), 0.1), 0.05), 0.35) AS epsilon FROM trades WHERE abs(ret) > 0)
SELECT trade_id, power(hold / (hold + 500.0), 0.5) * ret AS pred, epsilon FROM trades, e""")
def _(T):
    d = scored(T).withColumn("pnz", div("hold", F.col("hold") + 500.0))
    return d.withColumns({"pred": mlops.hurdle("pnz", "ret", 0.5), "epsilon": mlops.hurdle_epsilon(d, "ret").scalar()})
