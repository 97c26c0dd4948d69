"""Queries: joins, costs, pairs, imputation, sorts and sets."""
from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import pairs as pr, sequences as seq, states
from ..operators.asof import asof_backward
from ..operators.layout import in_chunks, number_rows
from ..operators.rangejoin import forward_path
from ..operators.resample import resample
from ..sources.bars import keep_one
from .catalog import query
from .data import BARS, BARS_REC, TRADES, bars, bars_cte, trades
from .q_labels import A20, with_atr
from .q_vol import lagw, need, win


@query("join_features_labels", "doc_id:i source:s n_chars:i quality:i toxic:i", "SELECT doc_id, source, n_chars, quality, toxic FROM documents JOIN labels USING (doc_id)")
def _(T):
    left, right = T("documents").withColumn("quality", F.lit(-1)), T("labels")
    overlap = [n for n in left.columns if n in right.columns and n != "doc_id"]
    return left.drop(*overlap).join(right, "doc_id")


@query("join_stage_outputs", "symbol:s t:t close:d day_mean:d week_max:d", BARS + """, a AS (SELECT symbol, t, avg(close) OVER (PARTITION BY symbol, cast(t AS date)) AS day_mean FROM bars WHERE volume >= 2),
b AS (SELECT symbol, t, max(close) OVER (PARTITION BY symbol, date_trunc('week', t)) AS week_max FROM bars WHERE volume >= 3)
SELECT bars.symbol, bars.t, close, day_mean, week_max FROM bars LEFT JOIN a USING (symbol, t) LEFT JOIN b USING (symbol, t)""")
def _(T):
    from pyspark.sql import Window
    b = bars(T)
    day, week = Window.partitionBy("symbol", F.to_date("t")), Window.partitionBy("symbol", F.date_trunc("week", "t"))
    one = b.where("volume >= 2").select("symbol", "t", F.avg("close").over(day).alias("day_mean"))
    two = b.where("volume >= 3").select("symbol", "t", F.max("close").over(week).alias("week_max"))
    return b.join(one, ["symbol", "t"], "left").join(two, ["symbol", "t"], "left")


@query("asof_closed_bar", "symbol:s t:t htf_t:t htf_close:d htf_volume:d", BARS + """, c AS (SELECT symbol, t4 AS t, last(close ORDER BY t) AS close, sum(volume) AS volume
  FROM (SELECT *, time_bucket(INTERVAL 4 HOUR, t) + INTERVAL 4 HOUR AS t4, max(t) OVER (PARTITION BY symbol) AS newest FROM bars) WHERE t4 <= newest GROUP BY symbol, t4)
SELECT b.symbol, b.t, c.t AS htf_t, c.close AS htf_close, c.volume AS htf_volume FROM bars b ASOF LEFT JOIN c ON b.symbol = c.symbol AND b.t >= c.t""")
def _(T):
    b = bars(T)
    c = resample(b.drop("bar_no"), "4 hours").select("symbol", "t", F.col("close").alias("htf_close"), F.col("volume").alias("htf_volume"))
    return asof_backward(b, c, ["htf_close", "htf_volume"], matched="htf_t")


@query("asof_events_tolerance", "event_id:i user_id:i match_id:i value:d", """WITH l AS (SELECT * FROM events WHERE event_type = 'purchase'), r AS (SELECT user_id, ts, event_id AS match_id, value FROM events WHERE event_type = 'click'),
j AS (SELECT l.event_id, l.user_id, l.ts, r.ts AS rt, r.match_id, r.value FROM l ASOF LEFT JOIN r ON l.user_id = r.user_id AND l.ts >= r.ts)
SELECT event_id, user_id, match_id, value FROM j WHERE rt IS NOT NULL AND ts <= rt + INTERVAL 12 HOUR""")
def _(T):
    e = T("events")
    left = e.where("event_type = 'purchase'").select("event_id", "user_id", F.col("ts").alias("t"))
    right = e.where("event_type = 'click'").select("user_id", F.col("ts").alias("t"), F.col("event_id").alias("match_id"), "value")
    got = asof_backward(left, right, ["match_id", "value"], keys=("user_id",), tolerance=F.expr("interval 12 hours"), piece_seconds=None)
    return got.where("match_id is not null")


@query("first_touch", "symbol:s bar_no:i touch:i up:b", BARS + ", " + A20 + """, p AS (SELECT a.symbol, a.bar_no, b.bar_no - a.bar_no AS k, b.high >= a.close + 2 * atr AS u, b.low <= a.close - atr AS d FROM atr20 a JOIN bars b ON a.symbol = b.symbol AND b.bar_no BETWEEN a.bar_no + 1 AND a.bar_no + 10 WHERE atr > 0)
SELECT symbol, bar_no, min(k) AS touch, first(u ORDER BY k) AS up FROM p WHERE u OR d GROUP BY 1, 2""")
def _(T):
    b = in_chunks(bars(T), with_atr, history=20)
    e = b.where("atr > 0").select("symbol", "bar_no", (F.col("close") + 2 * F.col("atr")).alias("hi"), (F.col("close") - F.col("atr")).alias("lo"))
    p = forward_path(e, b, 10, ["high", "low"]).withColumn("up", F.col("high") >= F.col("hi"))
    hit = p.where(F.col("up") | (F.col("low") <= F.col("lo")))
    return hit.groupBy("symbol", "bar_no").agg(F.min("step").alias("touch"), F.min_by("up", "step").alias("up"))


@query("interval_containment", "symbol:s t:t seg:i", BARS + f""", r AS (SELECT *, sum(chg) OVER (PARTITION BY symbol ORDER BY bar_no) AS isl FROM (SELECT *, coalesce(((close > 60) <> {lagw('close > 60')})::int, 1) AS chg FROM bars)),
s AS (SELECT symbol, min(t) AS a, max(t) + INTERVAL 2 HOUR AS b, min(bar_no) AS seg FROM r WHERE close > 60 GROUP BY symbol, isl)
SELECT bars.symbol, t, min(seg) AS seg FROM bars JOIN s ON s.symbol = bars.symbol AND t BETWEEN a AND b GROUP BY 1, 2""")
def _(T):
    from ..operators.rangejoin import containing
    b = bars(T)
    runs = seq.contiguous_runs(b.withColumn("hot", (F.col("close") > 60).cast("int")), "hot").where("hot = 1")
    at = b.select("symbol", F.col("bar_no").alias("i0"), F.col("t").alias("a"))
    to = b.select("symbol", F.col("bar_no").alias("i1"), F.col("t").alias("z"))
    seg = runs.join(at, ["symbol", "i0"]).join(to, ["symbol", "i1"]).select("symbol", "a", (F.col("z") + F.expr("interval 2 hours")).alias("b"), F.col("i0").alias("seg"))
    hit = containing(b, seg, "t", "a", "b")
    return hit.groupBy("symbol", "t").agg(F.min("seg").alias("seg"))


@query("nearest_not_later", "event_id:i bar_at:i", BARS + """, l AS (SELECT symbol, max(bar_no) AS n FROM bars GROUP BY symbol), j AS (SELECT e.event_id, e.event_type AS symbol, b.bar_no FROM events e ASOF LEFT JOIN bars b ON b.symbol = e.event_type AND e.ts >= b.t)
SELECT event_id, coalesce(bar_no, 0) AS bar_at FROM j""")
def _(T):
    e = T("events").select("event_id", F.col("event_type").alias("symbol"), F.col("ts").alias("t"))
    return asof_backward(e, bars(T).select("symbol", "t", F.col("bar_no").alias("_n")), ["_n"], piece_seconds=None).withColumn("bar_at", F.coalesce("_n", F.lit(0)))


@query("pair_features", "symbol:s t:t pair_corr:d pair_vol_ratio:d pair_beta:d", BARS + f""", g AS (SELECT t, 'p' AS symbol, max(close) FILTER (symbol = 'click') AS a0, max(close) FILTER (symbol = 'view') AS b0 FROM bars WHERE symbol IN ('click', 'view') GROUP BY t),
f AS (SELECT *, last_value(a0 IGNORE NULLS) OVER w AS a, last_value(b0 IGNORE NULLS) OVER w AS b, row_number() OVER (ORDER BY t) - 1 AS bar_no FROM g WINDOW w AS (ORDER BY t ROWS UNBOUNDED PRECEDING)),
r AS (SELECT *, coalesce(a / {lagw('a')} - 1, 0) AS ra, coalesce(b / {lagw('b')} - 1, 0) AS rb FROM f),
p AS (SELECT t, CASE WHEN bar_no >= 19 THEN corr(ra, rb) {win(60)} ELSE 0 END AS pair_corr, CASE WHEN bar_no >= 19 THEN stddev_samp(ra) {win(60)} / (stddev_samp(rb) {win(60)} + 1e-8) ELSE 1 END AS pair_vol_ratio,
  CASE WHEN bar_no >= 19 THEN covar_samp(ra, rb) {win(60)} / var_samp(rb) {win(60)} ELSE 0 END AS pair_beta FROM r)
SELECT x.symbol, x.t, pair_corr, pair_vol_ratio, pair_beta FROM bars x ASOF LEFT JOIN p ON x.t >= p.t""")
def _(T):
    b = bars(T)
    return pr.attach_pair(b, pr.pair_features(b, "click", "view"))


@query("cost_rolling", "symbol:s bar_no:i roll_cost:d", BARS + """, m AS (SELECT *, quantile_cont(x, 0.5) OVER (PARTITION BY symbol ORDER BY bar_no ROWS BETWEEN 200 PRECEDING AND 1 PRECEDING) AS q FROM (SELECT *, (high - low) / 20 AS x FROM bars))
SELECT symbol, bar_no, least(greatest(CASE WHEN bar_no >= 50 THEN q ELSE 3 END, 2), 8) AS roll_cost FROM m""")
def _(T):
    b = bars(T).withColumn("x", (F.col("high") - F.col("low")) / 20)
    return in_chunks(b, lambda d, f: pr.rolling_cost(d, f, "x", 200), history=201)


@query("cost_dynamic", "symbol:s bar_no:i dynamic_cost:d", BARS + ", " + A20 + f""", r AS (SELECT *, CASE WHEN count(atr) {win(100)} >= 10 THEN quantile_cont(atr, 0.7) {win(100)} END AS rf FROM atr20),
f AS (SELECT *, coalesce(last_value(nullif(rf, 0) IGNORE NULLS) OVER (PARTITION BY symbol ORDER BY bar_no ROWS UNBOUNDED PRECEDING), first_value(rf IGNORE NULLS) OVER (PARTITION BY symbol ORDER BY bar_no ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) AS rr FROM r)
SELECT symbol, bar_no, CASE WHEN atr IS NOT NULL THEN least(greatest(1.5 * least(greatest(atr / rr, 0.5), 3), 0.05), 5) END AS dynamic_cost FROM f""")
def _(T):
    return pr.dynamic_cost(in_chunks(bars(T), with_atr, history=20), "atr", 1.5, 100)


@query("implied_range", "symbol:s bar_no:i implied_range_atr:d", BARS + ", " + A20 + f""", r AS (SELECT *, coalesce(close / {lagw('close')} - 1, 0) AS ret FROM atr20)
SELECT symbol, bar_no, CASE WHEN atr IS NOT NULL THEN least(greatest(least(greatest(least(greatest({need('ret', 100, 20, 'stddev_samp(ret)')}, 1e-7), 1) / 0.85 * sqrt(20), 1e-7), 2.5) * close / greatest(atr, 1e-6), 0.01), 50) END
  * CASE WHEN count(ret) {win(100)} >= 20 THEN 1 END AS implied_range_atr FROM r""")
def _(T):
    return in_chunks(in_chunks(bars(T), with_atr, history=20), lambda d, f: pr.implied_range(d, f, "atr", 20, 100), history=102)


@query("heads_by_group", "symbol:s bar_no:i close:d", BARS + " SELECT * FROM bars WHERE bar_no < 25")
def _(T):
    return bars(T).where("bar_no < 25")


@query("stable_sort_positions", "trade_id:s pos:i", TRADES + " SELECT trade_id, row_number() OVER (ORDER BY exit_time, symbol, trade_id) - 1 AS pos FROM trades")
def _(T):
    return number_rows(trades(T), (), ("exit_time", "symbol", "trade_id"), "range", out="pos")


@query("seeded_sample", "event_id:i value:d", """SELECT event_id, value FROM events ORDER BY md5(concat_ws('|', event_id, 42)), event_id LIMIT 500""")
def _(T):
    """500 rows without replacement, the same ones for the same seed."""
    return T("events").orderBy(F.md5(F.concat_ws("|", F.col("event_id").cast("string"), F.lit("42"))), "event_id").limit(500).select("event_id", "value")


@query("set_algebra", "part:s n:i", TRADES + """, a AS (SELECT DISTINCT symbol, exit_time FROM trades WHERE regime <= 2), b AS (SELECT DISTINCT symbol, exit_time FROM trades WHERE regime >= 3)
SELECT 'both' AS part, count(*) AS n FROM (SELECT * FROM a INTERSECT SELECT * FROM b) UNION ALL SELECT 'only_a', count(*) FROM (SELECT * FROM a EXCEPT SELECT * FROM b) UNION ALL SELECT 'all', count(*) FROM (SELECT * FROM a UNION SELECT * FROM b)""")
def _(T):
    t = trades(T)
    a = t.where("regime <= 2").select("symbol", "exit_time").distinct()
    b = t.where("regime >= 3").select("symbol", "exit_time").distinct()
    count = lambda d, n: d.agg(F.count(F.lit(1)).alias("n")).select(F.lit(n).alias("part"), "n")
    return count(a.intersect(b), "both").unionByName(count(a.join(b, ["symbol", "exit_time"], "left_anti"), "only_a")).unionByName(count(a.union(b).distinct(), "all"))


@query("scalar_functions", "event_id:i a:d b:d c:d d:d e:s f:s", """SELECT event_id, ln(value) + log2(value) + sqrt(value) AS a, tanh(value / 50) + sin(value) + cos(value) AS b, 1 / (1 + exp(-(value - 30) / 10)) AS c, sign(value - 30) * abs(value - 30) / nullif(value - 0.01, 0) AS d,
  event_type || '-' || lpad(cast(user_id AS varchar), 4, '0') AS e, CASE WHEN event_type LIKE 'p%' THEN 'buy' WHEN contains(event_type, 'sign') THEN 'sell' ELSE 'none' END AS f FROM events""")
def _(T):
    from ..functions.exprs import div, logistic
    v, k = F.col("value"), F.col("event_type")
    return T("events").withColumns({
        "a": F.ln(v) + F.log2(v) + F.sqrt(v), "b": F.tanh(v / 50) + F.sin(v) + F.cos(v), "c": logistic((v - 30) / 10),
        "d": div(F.signum(v - 30) * F.abs(v - 30), v - 0.01), "e": F.concat(k, F.lit("-"), F.lpad(F.col("user_id").cast("string"), 4, "0")),
        "f": F.when(k.startswith("p"), "buy").when(k.contains("sign"), "sell").otherwise("none")})


@query("map_lookup", "event_id:i weight:d", "SELECT event_id, CASE event_type WHEN 'click' THEN 0.5 WHEN 'view' THEN 0.1 ELSE 1.0 END AS weight FROM events")
def _(T):
    from ..operators.gates import lookup
    return T("events").withColumn("weight", lookup({"click": 0.5, "view": 0.1}, F.col("event_type"), 1.0))


@query("vector_distance", "label:i n:i mean_dist:d nearest:i", """WITH c AS (SELECT label, list(embedding) AS vs FROM embeddings GROUP BY label), l AS (SELECT label, unnest(range(1, 65)) AS i FROM (SELECT DISTINCT label FROM embeddings)),
m AS (SELECT e.label, i, avg(embedding[i]::double) AS x FROM embeddings e JOIN l ON l.label = e.label GROUP BY 1, 2), k AS (SELECT label, list(x ORDER BY i) AS centre FROM m GROUP BY label),
d AS (SELECT e.vec_id, e.label, k.label AS other, sqrt(list_sum([power(embedding[i]::double - centre[i], 2) FOR i IN range(1, 65)])) AS dist FROM embeddings e, k)
SELECT label, count(*) AS n, avg(own) AS mean_dist, sum((best = label)::int) AS nearest FROM (SELECT vec_id, label, min(dist) FILTER (other = label) AS own, arg_min(other, dist) AS best FROM d GROUP BY 1, 2) GROUP BY label""")
def _(T):
    from ..operators.context import l2_distance
    e = T("embeddings")
    x = e.select("vec_id", "label", F.posexplode("embedding").alias("i", "x"))
    centre = x.groupBy("label", "i").agg(F.avg(F.col("x").cast("double")).alias("x")).groupBy("label").agg(
        F.transform(F.sort_array(F.collect_list(F.struct("i", "x"))), lambda s: s["x"]).alias("centre"))
    # ten centres: their array is one scalar, checked by the number of labels
    packed = centre.agg(F.sort_array(F.collect_list(F.struct("label", "centre")))).scalar()
    d = e.withColumn("_c", packed).withColumn("_d", F.transform("_c", lambda c: F.struct(l2_distance("embedding", c["centre"]).alias("dist"), c["label"].alias("label"))))
    d = d.withColumns({"own": F.element_at(F.filter("_d", lambda z: z["label"] == F.col("label")), 1)["dist"], "best": F.array_min("_d")["label"]})
    return d.groupBy("label").agg(F.count(F.lit(1)).alias("n"), F.avg("own").alias("mean_dist"), F.sum((F.col("best") == F.col("label")).cast("int")).alias("nearest"))
