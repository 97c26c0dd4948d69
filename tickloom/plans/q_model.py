"""Queries: splits, weights, scalings, feature quality, metrics, state keys and searches."""
from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.exprs import div, pair_corr
from ..operators import metrics as mt, policy as pol, quality as ql, splits as sp
from ..operators.durable import stored
from ..operators.ranks import exact_quantiles
from .catalog import query
from .data import BARS, TRADES, bars, trades
from .q_paths import PATH, TR, path

SCORED = TRADES + """, sc AS (SELECT *, round(hold / (hold + 500.0), 4) AS p, (ret > 0.02)::int AS y, ret * 100 AS v, hold / 400.0 AS pred, least(greatest(regime - 1, 0), 4) AS cls FROM trades)"""


def scored(T, *once: str):
    """Scored trades. With names, the trades are joined once and written with these columns and those of the scores only, for queries that read them again."""
    d = stored(trades(T).select(*dict.fromkeys([*once, "hold", "ret", "regime"]))) if once else trades(T)
    return d.withColumns({"p": F.round(div("hold", F.col("hold") + 500.0), 4), "y": (F.col("ret") > 0.02).cast("int"),
                                  "v": F.col("ret") * 100, "pred": F.col("hold") / 400.0, "cls": F.least(F.greatest(F.col("regime") - 1, F.lit(0)), F.lit(4))})


A, B, C = "1997-01-01", "2000-01-01", "2001-01-01"


@query("split_calendar", "part:s n:i first:t last:t", TRADES + f"""
SELECT CASE WHEN entry_time < '{A}' THEN 'train' WHEN entry_time < '{B}' THEN 'cal' WHEN entry_time < '{C}' THEN 'test' END AS part, count(*) AS n, min(entry_time) AS first, max(entry_time) AS last FROM trades GROUP BY 1""")
def _(T):
    d = trades(T).withColumn("part", sp.calendar_split("entry_time", A, B, C))
    return ql.coverage(d, "part", "entry_time").withColumnRenamed("rows", "n")


FOLDS = (("1996-01-01", "1998-01-01"), ("1998-01-01", "2000-01-01"), ("2000-01-01", "2001-06-01"))


@query("split_expanding_folds", "fold:i role:s n:i total:d", TRADES + f""", f AS (SELECT * FROM (VALUES {', '.join(f"({i}, TIMESTAMP '{a}', TIMESTAMP '{b}')" for i, (a, b) in enumerate(FOLDS))}) x(fold, vs, ve))
SELECT fold, CASE WHEN entry_time < vs THEN 'train' ELSE 'val' END AS role, count(*) AS n, sum(ret) AS total FROM trades, f WHERE entry_time < ve GROUP BY 1, 2""")
def _(T):
    return sp.expanding_folds(trades(T), FOLDS, "entry_time").groupBy("fold", "role").agg(F.count(F.lit(1)).alias("n"), F.sum("ret").alias("total"))


@query("split_blocked_folds", "trade_id:s fold:i", TRADES + " SELECT trade_id, ntile(7) OVER (ORDER BY entry_time, trade_id) - 1 AS fold FROM trades")
def _(T):
    return sp.blocked_folds(trades(T), 7, ("entry_time", "trade_id"))


@query("split_tune_report", "tune:b report:b n:i last:t", TRADES + """, o AS (SELECT *, row_number() OVER (ORDER BY entry_time, trade_id) - 1 < round_even((SELECT count(*) FROM trades) * 0.6, 0) AS tune FROM trades)
SELECT tune, NOT tune AS report, count(*) AS n, max(entry_time) AS last FROM o GROUP BY 1""")
def _(T):
    d = sp.tune_report(trades(T), 0.6, ("entry_time", "trade_id"))
    return d.groupBy("tune", "report").agg(F.count(F.lit(1)).alias("n"), F.max("entry_time").alias("last"))


@query("split_by_trade", "symbol:s eb:i part:s steps:i", PATH + """, f AS (SELECT symbol, eb, min(t) AS t0, count(*) AS steps FROM path GROUP BY 1, 2),
o AS (SELECT *, row_number() OVER (ORDER BY t0, symbol, eb) - 1 AS pos, count(*) OVER () AS n FROM f)
SELECT symbol, eb, CASE WHEN pos < round_even(n * 0.7, 0) THEN 'train' ELSE 'val' END AS part, steps FROM o""")
def _(T):
    return sp.trade_split(path(T), TR, "t").groupBy(*TR, "part").agg(F.count(F.lit(1)).alias("steps"))


@query("oof_stitched", "trade_id:s fold:i oof:d", TRADES + f""", f AS (SELECT * FROM (VALUES {', '.join(f"({i}, TIMESTAMP '{a}', TIMESTAMP '{b}')" for i, (a, b) in enumerate(FOLDS))}) x(fold, vs, ve)),
m AS (SELECT fold, avg(ret) AS oof FROM trades, f WHERE entry_time < vs GROUP BY fold)
SELECT trade_id, f.fold, oof FROM trades JOIN f ON entry_time >= vs AND entry_time < ve JOIN m ON m.fold = f.fold""")
def _(T):
    rows = sp.expanding_folds(trades(T), FOLDS, "entry_time")
    fit = rows.where("role = 'train'").groupBy("fold").agg(F.avg("ret").alias("oof"))
    return sp.stitch_oof([rows.join(fit, "fold")], ["trade_id"], "oof")


@query("weights_class_recency", "trade_id:s weight:d", SCORED + """, k AS (SELECT cls, 1 / (count(*) / (SELECT count(*) FROM sc) * 5) AS w FROM sc GROUP BY cls), m AS (SELECT cls, w / avg(w) OVER () AS w FROM k),
s AS (SELECT max(entry_time) AS hi, min(entry_time) AS lo FROM sc)
SELECT trade_id, w * (0.7 + 0.3 * (1 - date_diff('second', entry_time, hi) / greatest(date_diff('second', lo, hi), 86400))) AS weight FROM sc JOIN m USING (cls), s""")
def _(T):
    return sp.class_recency_weights(scored(T), "cls", "entry_time", 5)


@query("weights_tail_rank", "trade_id:s tail:d step:d", SCORED + """, q AS (SELECT quantile_cont(p, 0.8) AS c FROM sc), a AS (SELECT trade_id, p, c, CASE WHEN v > 0.05 THEN v END AS av FROM sc, q),
r AS (SELECT *, (rank() OVER (ORDER BY av) + (count(*) OVER (PARTITION BY av) - 1) / 2.0) / count(*) OVER () AS pc FROM a WHERE av IS NOT NULL)
SELECT a.trade_id, 1 + 2 * least(greatest((a.p - a.c) / greatest(1 - a.c, 1e-3), 0), 1) AS tail, CASE WHEN pc > 0.9 THEN 5 WHEN pc > 0.7 THEN 2.5 WHEN pc > 0.5 THEN 1.5 ELSE 1 END AS step FROM a LEFT JOIN r USING (trade_id)""")
def _(T):
    d = scored(T, "trade_id").withColumn("v", F.round("v", 6))
    return sp.rank_step_weights(sp.tail_weights(d, "p", out="tail"), "v", out="step")


@query("weights_trade", "symbol:s eb:i step:i weight:d", PATH + """, a AS (SELECT *, (exit_prob > 0.4)::int AS y, count(*) OVER k AS len, first(step) OVER (PARTITION BY symbol, eb ORDER BY unreal DESC, step ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS pk, max(step) OVER k AS tmax,
   min(unreal) OVER r AS mn, max(unreal) OVER r AS mx, CASE WHEN step < 3 THEN 0 WHEN step < 8 THEN 1 WHEN step < 15 THEN 2 ELSE 3 END AS hb FROM path
   WINDOW k AS (PARTITION BY symbol, eb), r AS (PARTITION BY symbol, eb ORDER BY step ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)),
b AS (SELECT hb, count(*) AS nb FROM a GROUP BY hb),
w AS (SELECT a.*, least(greatest(sqrt((SELECT avg(nb) FROM b) / nb), 0.75), 1.5) * CASE WHEN step < 3 THEN 0.3 ELSE 1 END * CASE WHEN tmax - step < 3 THEN 0.5 ELSE 1 END * CASE WHEN abs(step - pk) <= 5 THEN 3 ELSE 1 END
   * CASE WHEN y = 1 THEN 1 ELSE least(greatest([1.0, 1.3, 1.0, 0.55, 0.8][regime + 1] * (1.15 - 0.5 * least(step / 29.0, 1)) * CASE WHEN unreal < 0 THEN 0.85 ELSE 1 END, 0.4), 2.5) END
   * CASE WHEN y = 1 THEN least(greatest(1 + greatest(unreal - mn, 0), 1), 10) ELSE least(greatest(0.5 + least(greatest(mx - unreal, 0), 3) / 3 * 1.5, 0.5), 2) END / len AS w FROM a JOIN b USING (hb)),
q AS (SELECT quantile_cont(w, 0.01) AS lo, quantile_cont(w, 0.99) AS hi FROM w), cl AS (SELECT symbol, eb, step, least(greatest(w, lo), hi) AS w FROM w, q)
SELECT symbol, eb, step, w / (SELECT avg(w) FROM cl) AS weight FROM cl""")
def _(T):
    return sp.trade_weights(path(T).withColumn("y", (F.col("exit_prob") > 0.4).cast("int")), TR, "step", "y", "unreal", "regime", shape=True, regret=True)


@query("weights_half_life", "rho:d days:i half_life:d", """WITH d AS (SELECT cast(ts AS date) AS day, avg(value + 100 * epoch(ts) / 1e9) AS x FROM events GROUP BY 1), l AS (SELECT x, lag(x) OVER (ORDER BY day) AS l FROM d)
SELECT corr(l, x) AS rho, count(*) AS days, CASE WHEN corr(l, x) BETWEEN 1e-6 AND 0.999 THEN -ln(2) / ln(corr(l, x)) END AS half_life FROM l""")
def _(T):
    e = T("events").withColumn("s", F.col("value") + 100 * (F.timestamp_diff("MICROSECOND", F.lit("1970-01-01").cast("timestamp_ntz"), F.col("ts")) / 1e6) / 1e9)
    return sp.half_life_days(e, "ts", "s")


@query("weights_decay", "event_id:i weight:d", """WITH e AS (SELECT event_id, ts, value + day(ts) * 20 AS s, row_number() OVER (ORDER BY ts, event_id) - 1 AS pos, count(*) OVER () AS n FROM events),
d AS (SELECT cast(ts AS date) AS day, avg(s) AS x FROM e GROUP BY 1), l AS (SELECT x, lag(x) OVER (ORDER BY day) AS l FROM d),
h AS (SELECT count(*) AS days, CASE WHEN corr(l, x) BETWEEN 1e-6 AND 0.999 THEN -ln(2) / ln(corr(l, x)) END AS hl FROM l),
w AS (SELECT e.*, CASE WHEN hl IS NULL THEN 0 ELSE ln(2) / least(greatest(hl * greatest(1, n / days), 1), greatest(1, n * 1.5)) END AS lam FROM e, h),
x AS (SELECT *, exp(-lam * (n - 1 - pos)) AS w FROM w) SELECT event_id, 1000 * w / sum(w) OVER () AS weight FROM x""")
def _(T):
    e = T("events").withColumn("s", F.col("value") + F.dayofmonth("ts") * 20)
    return sp.decay_weights(e, ("ts", "event_id"), "s").withColumn("weight", F.col("weight") * 1000)


@query("scale_zscore", "trade_id:s ret_z:d hold_z:d", SCORED + """, s AS (SELECT avg(ret) AS m1, stddev_samp(ret) AS s1, avg(hold) AS m2, stddev_samp(hold) AS s2 FROM sc WHERE entry_time < TIMESTAMP '1997-01-01')
SELECT trade_id, (ret - m1) / s1 AS ret_z, (hold - m2) / s2 AS hold_z FROM sc, s""")
def _(T):
    return sp.fit_zscore(scored(T), ["ret", "hold"], F.col("entry_time") < sp.ts(A))


FIT = "entry_time < TIMESTAMP '1997-01-01'"


@query("scale_robust", "trade_id:s rz:d pct:d scaled:d", SCORED + f""", m AS (SELECT quantile_cont(hold, 0.5) AS med, stddev_pop(hold) AS sd, quantile_cont(hold, 0.05) AS lo, quantile_cont(hold, 0.95) AS hi FROM sc WHERE {FIT}),
k AS (SELECT quantile_cont(abs(hold - med), 0.5) AS mad FROM sc, m WHERE {FIT}),
c AS (SELECT hold, sum(sum(({FIT})::int)) OVER (ORDER BY hold) AS r, sum(({FIT})::int) AS n FROM sc GROUP BY hold)
SELECT trade_id, least(greatest((hold - med) / greatest(1.4826 * mad, 0.25 * sd, 1e-3), -3), 3) AS rz, 0.5 * (r - n + r) / (SELECT count(*) FROM sc WHERE {FIT}) AS pct, least(greatest((hold - lo) / (hi - lo), 0), 1) AS scaled FROM sc JOIN c USING (hold), m, k""")
def _(T):
    fit = F.col("entry_time") < sp.ts(A)
    d = sp.robust_z(scored(T, "trade_id", "entry_time").withColumn("hold", F.col("hold").cast("double")), "hold", fit)
    d = sp.percentile_map(d, "hold", fit)
    return sp.quantile_rescale(d, "hold", fit)


@query("scale_clip_ceiling", "median:d mad:d sigma:d ceiling:d", SCORED + f""", m AS (SELECT quantile_cont(hold, 0.5) AS med FROM sc WHERE {FIT}), k AS (SELECT med, quantile_cont(abs(hold - med), 0.5) AS mad FROM sc, m WHERE {FIT} GROUP BY med)
SELECT med AS median, mad, mad / 0.67448975 AS sigma, least(greatest(med + 1.959964 * mad / 0.67448975, 10), 1500) AS ceiling FROM k""")
def _(T):
    d = scored(T).withColumn("hold", F.col("hold").cast("double"))
    return sp.clip_ceiling(d, "hold", F.col("entry_time") < sp.ts(A), 1.959964, 0.995, 10.0, 1500.0)


FEATS = ("quantity", "price", "discount", "tax", "flat")


def features(T):
    li = T("lineitem")
    return li.select(F.col("l_quantity").alias("quantity"), F.when(F.col("l_tax") > 0, F.col("l_extendedprice")).alias("price"), F.col("l_discount").alias("discount"),
                     F.col("l_tax").alias("tax"), F.lit(1.0).alias("flat"), F.col("l_shipdate").alias("t"), F.xxhash64(*li.columns).alias("rid"))


FEAT_SQL = """WITH ft AS (SELECT l_quantity AS quantity, CASE WHEN l_tax > 0 THEN l_extendedprice END AS price, l_discount AS discount, l_tax AS tax, 1.0::double AS flat, l_shipdate AS t FROM lineitem),
lg AS (SELECT t, unnest(['quantity', 'price', 'discount', 'tax', 'flat']) AS feature, unnest([quantity, price, discount, tax, flat]) AS value FROM ft)"""


@query("quality_health", "feature:s missing:i std:d lo:d hi:d constant:b", FEAT_SQL + """
SELECT feature, sum((value IS NULL)::int) AS missing, stddev_pop(value) AS std, min(value) AS lo, max(value) AS hi, stddev_pop(value) < 1e-9 OR min(value) = max(value) AS constant FROM lg GROUP BY feature""")
def _(T):
    return ql.health(features(T), FEATS)


PRINT = """SELECT feature, avg(value) AS mean, stddev_pop(value) AS std, avg((value IS NULL)::int) AS null_rate, count(value) AS n, quantile_cont(value, 0.01) AS q01, quantile_cont(value, 0.5) AS q50, quantile_cont(value, 0.99) AS q99 FROM lg WHERE {} GROUP BY feature"""


@query("quality_fingerprint", "feature:s mean:d std:d null_rate:d n:i q01:d q50:d q99:d", FEAT_SQL + PRINT.format("t < TIMESTAMP '1998-01-01'"))
def _(T):
    return ql.fingerprint(features(T), FEATS, F.col("t") < sp.ts("1998-01-01"))


@query("quality_drift", "feature:s z_mean:d z_median:d null_change:d warn:b", FEAT_SQL + f""", o AS ({PRINT.format("t < TIMESTAMP '1998-01-01'")}), n AS ({PRINT.format("t >= TIMESTAMP '1998-01-01'")})
SELECT o.feature, abs(n.mean - o.mean) / greatest(o.std, 1e-9) AS z_mean, abs(n.q50 - o.q50) / greatest(o.std, 1e-9) AS z_median, n.null_rate - o.null_rate AS null_change,
  abs(n.mean - o.mean) / greatest(o.std, 1e-9) > 3 OR abs(n.q50 - o.q50) / greatest(o.std, 1e-9) > 3 OR abs(n.null_rate - o.null_rate) > 0.05 AS warn FROM o JOIN n USING (feature)""")
def _(T):
    f = features(T)
    return ql.drift(ql.fingerprint(f, FEATS, F.col("t") < sp.ts("1998-01-01")), ql.fingerprint(f, FEATS, F.col("t") >= sp.ts("1998-01-01")))


@query("quality_stability", "feature:s stability:d", """WITH s AS (SELECT value, user_id, ntile(8) OVER (ORDER BY ts, event_id) AS seg FROM events),
l AS (SELECT seg, unnest(['value', 'user']) AS feature, unnest([value, user_id::double]) AS x FROM s), m AS (SELECT feature, seg, avg(x) AS m FROM l GROUP BY 1, 2)
SELECT feature, 1 / (1 + 5 * stddev_pop(m) / (avg(abs(m)) + 1e-12)) AS stability FROM m GROUP BY feature""")
def _(T):
    e = T("events").withColumn("user", F.col("user_id").cast("double"))
    return ql.stability(e, ["value", "user"], ("ts", "event_id"))


@query("quality_lag1", "feature:s strength:d", BARS + """, l AS (SELECT symbol, close, volume, lag(close) OVER w AS c1, lag(volume) OVER w AS v1 FROM bars WINDOW w AS (PARTITION BY symbol ORDER BY bar_no)),
k AS (SELECT symbol, abs(corr(close, c1)) AS close, abs(corr(volume, v1)) AS volume FROM l GROUP BY symbol)
SELECT 'close' AS feature, max(close) AS strength FROM k UNION ALL SELECT 'volume', max(volume) FROM k""")
def _(T):
    return ql.lag1_strength(bars(T), ["close", "volume"])


@query("quality_correlations", "a:s b:s r:d", FEAT_SQL + """ SELECT 'quantity' AS a, 'price' AS b, corr(quantity, price) AS r FROM ft UNION ALL SELECT 'quantity', 'discount', corr(quantity, discount) FROM ft
UNION ALL SELECT 'quantity', 'tax', corr(quantity, tax) FROM ft UNION ALL SELECT 'price', 'discount', corr(price, discount) FROM ft UNION ALL SELECT 'price', 'tax', corr(price, tax) FROM ft UNION ALL SELECT 'discount', 'tax', corr(discount, tax) FROM ft""")
def _(T):
    return ql.correlation_pairs(features(T), [n for n in FEATS if n != "flat"])


KEPT = """WITH ft AS (SELECT l_quantity AS quantity, l_extendedprice AS price, l_extendedprice * (1 - l_discount) AS cost, l_discount AS discount, l_tax AS tax FROM lineitem),
r AS (SELECT abs(corr(quantity, discount)) AS qd, abs(corr(price, discount)) AS pd, abs(corr(price, quantity)) AS pq, abs(corr(cost, discount)) AS cd, abs(corr(cost, quantity)) AS cq, abs(corr(cost, price)) AS cp FROM ft)
SELECT 'discount' AS name UNION ALL SELECT 'quantity' FROM r WHERE qd < 0.95 UNION ALL SELECT 'price' FROM r WHERE pd < 0.95 AND pq < 0.95 UNION ALL SELECT 'cost' FROM r WHERE cd < 0.95 AND cq < 0.95 AND cp < 0.95 UNION ALL SELECT 'tax'"""


@query("quality_columns_kept", "name:s", KEPT)
def _(T):
    li = T("lineitem")
    f = li.select(F.col("l_quantity").alias("quantity"), F.col("l_extendedprice").alias("price"), (F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("cost"),
                  F.col("l_discount").alias("discount"), F.col("l_tax").alias("tax"))
    kept = ql.drop_correlated(f, f.columns, {"default": 0.97, "co": 0.95, "pr": 0.95, "qu": 0.95}, protected=("discount",))
    return f.agg(F.max(F.lit(1))).select(F.explode(F.array(*[F.lit(n) for n in kept])).alias("name"))


@query("quality_threshold_diff", "name:s old:d new:d status:s change:d", """WITH o AS (SELECT event_type AS name, round(avg(value), 4) AS v FROM events WHERE event_type <> 'view' GROUP BY 1), n AS (SELECT event_type AS name, round(CASE WHEN event_type = 'click' THEN avg(value) ELSE max(value) END, 4) AS v FROM events WHERE event_type <> 'error' GROUP BY 1)
SELECT coalesce(o.name, n.name) AS name, o.v AS old, n.v AS new, CASE WHEN o.v IS NULL THEN 'added' WHEN n.v IS NULL THEN 'removed' WHEN o.v = n.v THEN 'same' ELSE 'changed' END AS status, n.v - o.v AS change FROM o FULL JOIN n ON o.name = n.name""")
def _(T):
    e = T("events")
    k = F.col("event_type").alias("name")
    old = e.where("event_type <> 'view'").groupBy(k).agg(F.round(F.avg("value"), 4).alias("value"))
    new = e.where("event_type <> 'error'").groupBy(k).agg(F.round(F.when(F.col("name") == "click", F.avg("value")).otherwise(F.max("value")), 4).alias("value"))
    return ql.threshold_diff(old, new)


@query("quality_masking", "masked:s metric:d", SCORED + """ SELECT 'all' AS masked, avg(abs(v - (pred + 2 * p))) AS metric FROM sc UNION ALL SELECT 'hold', avg(abs(v - 2 * p)) FROM sc UNION ALL SELECT 'prob', avg(abs(v - pred)) FROM sc""")
def _(T):
    return ql.masking_audit(scored(T), lambda d: d.withColumn("out", F.col("pred") + 2 * F.col("p")), {"hold": ["pred"], "prob": ["p"]}, F.avg(F.abs(F.col("v") - F.col("out"))))


@query("feature_dropout", "l_orderkey:i l_linenumber:i l_quantity:d", """SELECT l_orderkey, l_linenumber, CASE WHEN l_shipdate < TIMESTAMP '1998-01-01' AND
  cast('0x' || substr(md5(concat_ws('|', l_orderkey, l_linenumber, l_suppkey, 7)), 1, 8) AS bigint) % 10000 < 1000 THEN 0 ELSE l_quantity END AS l_quantity FROM lineitem""")
def _(T):
    return sp.feature_dropout(T("lineitem"), ["l_quantity"], ["l_orderkey", "l_linenumber", "l_suppkey"], 0.1, F.col("l_shipdate") < sp.ts("1998-01-01"))


@query("metrics_binary", "symbol:s brier:d pin:d pear:d", SCORED + """ SELECT symbol, avg(power(y - p, 2)) AS brier, avg(greatest(0.9 * (v - pred), -0.1 * (v - pred))) AS pin, corr(v, pred) AS pear FROM sc GROUP BY symbol""")
def _(T):
    return scored(T).groupBy("symbol").agg(mt.brier("y", "p").alias("brier"), mt.pinball("v", "pred", 0.9).alias("pin"), mt.pearson("v", "pred").alias("pear"))


PROBS = "pr AS (SELECT *, [p * 0.5, 0.3, (1 - p) * 0.5, 0.1, 0.1] AS raw FROM sc), pn AS (SELECT *, list_transform(raw, lambda x: x / list_sum(raw)) AS ps FROM pr)"


def prob_rows(T):
    p = F.col("p")
    d = scored(T).withColumn("raw", F.array(p * 0.5, F.lit(0.3), (1 - p) * 0.5, F.lit(0.1), F.lit(0.1)))
    d = d.withColumn("s", F.aggregate("raw", F.lit(0.0), lambda a, b: a + b))
    return d.withColumn("ps", F.transform("raw", lambda x: x / F.col("s")))


@query("metrics_multi", "symbol:s brier:d nll:d acc:d", SCORED + ", " + PROBS + """ SELECT symbol, avg(list_sum([power(ps[i] - (i = cls + 1)::int, 2) FOR i IN range(1, 6)])) AS brier, avg(-ln(ps[cls + 1])) AS nll, avg((list_position(ps, list_max(ps)) = cls + 1)::int) AS acc FROM pn GROUP BY symbol""")
def _(T):
    return prob_rows(T).groupBy("symbol").agg(mt.brier_multi("cls", "ps").alias("brier"), mt.log_loss("cls", "ps").alias("nll"),
                                              F.avg((pol.argmax("ps") == F.col("cls")).cast("int")).alias("acc"))


@query("metrics_ece_equal_count", "ece:d", """WITH o AS (SELECT (event_type = 'purchase')::int AS y, round(value / (value + 30), 2) AS p0, event_id FROM events),
q AS (SELECT y, least(greatest(p0, 1e-9), 1 - 1e-9) AS p, row_number() OVER (ORDER BY p0, event_id) - 1 AS pos, count(*) OVER () AS n FROM o),
b AS (SELECT least(pos // (n // 10), 9) AS bin, count(*) AS k, avg(y) AS acc, avg(p) AS conf, max(n) AS n FROM q GROUP BY 1) SELECT sum(k / n * abs(acc - conf)) AS ece FROM b""")
def _(T):
    e = T("events").select("event_id", (F.col("event_type") == "purchase").cast("int").alias("y"), F.round(F.col("value") / (F.col("value") + 30), 2).alias("p"))
    return mt.ece_equal_count(e, "y", "p", "event_id")


@query("metrics_ece_equal_width", "ece:d", SCORED + ", " + PROBS + """, q AS (SELECT list_max(ps) AS conf, (list_position(ps, list_max(ps)) = cls + 1)::int AS ok FROM pn),
b AS (SELECT ceil(conf * 10) AS bin, count(*) AS k, avg(ok) AS acc, avg(conf) AS conf FROM q GROUP BY 1) SELECT sum(k / (SELECT count(*) FROM q) * abs(acc - conf)) AS ece FROM b""")
def _(T):
    d = prob_rows(T).withColumns({"conf": F.array_max("ps"), "ok": (pol.argmax("ps") == F.col("cls")).cast("int")})
    return mt.ece_equal_width(d, "ok", "conf")


@query("metrics_tail_spearman", "tail_mae:d spearman:d", SCORED + """, q AS (SELECT quantile_cont(v, 0.9) AS c FROM sc), r AS (SELECT rank() OVER (ORDER BY v) + (count(*) OVER (PARTITION BY v) - 1) / 2.0 AS a, rank() OVER (ORDER BY pred) + (count(*) OVER (PARTITION BY pred) - 1) / 2.0 AS b FROM sc)
SELECT (SELECT avg(abs(v - pred)) FROM sc, q WHERE v >= c) AS tail_mae, (SELECT corr(a, b) FROM r) AS spearman""")
def _(T):
    d = scored(T, "hold")
    s = mt.spearman(d, "v", "pred").scalar()
    return mt.tail_mae(d, "v", "pred").withColumn("spearman", s)


@query("metrics_flip_rate", "symbol:s flip:d n:i", TRADES + """, p AS (SELECT symbol, hold / (hold + 500.0) AS p, lag(hold / (hold + 500.0)) OVER (PARTITION BY symbol ORDER BY entry_time, trade_id) AS q FROM trades)
SELECT symbol, avg(abs(p - q)) AS flip, count(q) AS n FROM p GROUP BY symbol""")
def _(T):
    from ..operators.layout import in_chunks, number_rows
    d = number_rows(trades(T), ("symbol",), ("entry_time", "trade_id"), "range").withColumn("p", div("hold", F.col("hold") + 500.0))
    d = in_chunks(d, lambda x, f: x.withColumn("dp", F.abs(f.diff("p"))), history=1)
    return d.groupBy("symbol").agg(F.avg("dp").alias("flip"), F.count("dp").alias("n"))


@query("metrics_regression", "symbol:s n:i mae:d rmse:d r2:d sign_acc:d pred_mean:d pred_std:d degenerate:b branch:s", SCORED + """ SELECT *, CASE WHEN sign_acc > 0.6 THEN 'A1' WHEN abs(rho) < 0.05 THEN 'A2' ELSE 'A3' END AS branch FROM (
  SELECT symbol, count(*) AS n, avg(abs(v - pred)) AS mae, sqrt(avg(power(v - pred, 2))) AS rmse, 1 - sum(power(v - pred, 2)) / (var_pop(v) * count(*)) AS r2, avg((sign(v) = sign(pred))::int) FILTER (abs(v) > 1e-8) AS sign_acc,
  avg(pred) AS pred_mean, stddev_pop(pred) AS pred_std, stddev_pop(pred) < 1e-5 AS degenerate, corr(v, pred) AS rho FROM sc GROUP BY symbol)""")
def _(T):
    m = scored(T).groupBy("symbol").agg(*mt.regression_report("v", "pred"), pair_corr("v", "pred").alias("rho"))
    return m.withColumn("branch", F.when(F.col("sign_acc") > 0.6, "A1").when(F.abs("rho") < 0.05, "A2").otherwise("A3"))


@query("metrics_confusion", "symbol:s cls:i tp:i fp:i fn:i precision:d recall:d", SCORED + """, q AS (SELECT symbol, cls AS t, least(hold // 500, 4) AS g FROM sc), k AS (SELECT DISTINCT symbol, t AS c FROM q UNION SELECT DISTINCT symbol, g FROM q)
SELECT k.symbol, c AS cls, sum((t = c AND g = c)::int) AS tp, sum((t <> c AND g = c)::int) AS fp, sum((t = c AND g <> c)::int) AS fn, sum((t = c AND g = c)::int) / nullif(sum((g = c)::int), 0) AS precision,
  sum((t = c AND g = c)::int) / nullif(sum((t = c)::int), 0) AS recall FROM k JOIN q ON q.symbol = k.symbol GROUP BY 1, 2""")
def _(T):
    d = scored(T).withColumn("g", F.least(F.floor(F.col("hold") / 500), F.lit(4)).cast("int"))
    return mt.confusion_report(d, ["symbol"], "cls", "g")


@query("metrics_temperature", "temperature:d nll:d", SCORED + ", " + PROBS + """, g AS (SELECT 0.5 + 2.5 * i / 63.0 AS tt FROM (SELECT unnest(range(64)) AS i)),
s AS (SELECT tt, cls, list_transform(ps, lambda x: power(x, 1 / tt)) AS w FROM pn, g), n AS (SELECT tt, round(avg(-ln(w[cls + 1] / list_sum(w))), 9) AS nll FROM s GROUP BY tt)
SELECT tt AS temperature, nll FROM n ORDER BY nll, tt LIMIT 1""")
def _(T):
    from ..operators.mlops import fit_temperature
    return fit_temperature(prob_rows(T), "cls", "ps")


@query("metrics_ablation", "mode:s trades:i mean:d", TRADES + """ SELECT mode, count(*) FILTER (k) AS trades, avg(ret) FILTER (k) AS mean FROM (SELECT m.mode, ret, CASE m.mode WHEN 'all' THEN true WHEN 'short_hold' THEN hold < 200 ELSE regime >= 3 END AS k FROM trades, (SELECT unnest(['all', 'short_hold', 'late_regime']) AS mode) m) GROUP BY mode""")
def _(T):
    modes = F.explode(F.array(F.struct(F.lit("all").alias("mode"), F.lit(True).alias("k")), F.struct(F.lit("short_hold").alias("mode"), (F.col("hold") < 200).alias("k")),
                              F.struct(F.lit("late_regime").alias("mode"), (F.col("regime") >= 3).alias("k"))))
    return trades(T).withColumn("m", modes).groupBy("m.mode").agg(F.sum(F.col("m.k").cast("int")).alias("trades"), F.avg(F.when(F.col("m.k"), F.col("ret"))).alias("mean"))


@query("metrics_calibration_bins", "bin:i n:i mean_p:d rate:d", SCORED + " SELECT least(floor(p * 10), 9) AS bin, count(*) AS n, avg(p) AS mean_p, avg(y) AS rate FROM sc GROUP BY 1")
def _(T):
    return scored(T).groupBy(F.least(F.floor(F.col("p") * 10), F.lit(9)).alias("bin")).agg(F.count(F.lit(1)).alias("n"), F.avg("p").alias("mean_p"), F.avg("y").alias("rate"))


KEYS = SCORED + """, e AS (SELECT quantile_cont(hold, 1.0 / 3) AS a, quantile_cont(hold, 2.0 / 3) AS b FROM sc WHERE entry_time < TIMESTAMP '1997-01-01'),
ky AS (SELECT sc.*, (hold >= a)::int + (hold >= b)::int AS vb, 'r' || cls || '_v' || ((hold >= a)::int + (hold >= b)::int) AS key FROM sc, e)"""


def keyed(T, *once: str):
    d = scored(T, *once).withColumn("hold", F.col("hold").cast("double"))
    d = pol.quantile_buckets(d, "hold", 3, "vb", F.col("entry_time") < sp.ts(A))
    return d.withColumn("key", pol.entry_key("cls", "vb"))


@query("state_keys", "key:s xkey:s fkey:s phase:s n:i", KEYS + """ SELECT key, 'ex' || CASE WHEN cls <= 1 THEN 0 WHEN cls >= 4 THEN 1 ELSE 2 END || '_h' || CASE WHEN book * 5 < 3 THEN 0 WHEN book * 5 < 8 THEN 1 WHEN book * 5 < 15 THEN 2 ELSE 3 END AS xkey,
  key || '_h' || CASE WHEN book * 5 < 3 THEN 0 WHEN book * 5 < 8 THEN 1 WHEN book * 5 < 15 THEN 2 ELSE 3 END AS fkey, CASE WHEN v >= 0 AND book * 5 < 5 THEN 'pnl_pf' WHEN v >= 0 THEN 'pnl_ps' WHEN abs(v) < 2.5 THEN 'pnl_um' ELSE 'pnl_ud' END AS phase, count(*) AS n FROM ky GROUP BY 1, 2, 3, 4""")
def _(T):
    d = keyed(T).withColumn("h5", F.col("book") * 5)
    d = d.withColumns({"xkey": pol.exit_key("cls", "h5"), "fkey": pol.fine_exit_key("cls", "vb", "h5"), "phase": pol.pnl_phase_key("v", "h5", F.lit(10.0), 2.5)})
    return d.groupBy("key", "xkey", "fkey", "phase").agg(F.count(F.lit(1)).alias("n"))


@query("policy_map_join", "trade_id:s key:s limit_:d", KEYS + """, p AS (SELECT key, quantile_cont(v, 0.5) AS m FROM ky GROUP BY key HAVING count(*) >= 1500) SELECT trade_id, key, coalesce(m, 0.25) AS limit_ FROM ky LEFT JOIN p USING (key)""")
def _(T):
    d = keyed(T, "trade_id", "entry_time")
    n = d.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n >= 1500")
    p = exact_quantiles(d, "v", {"limit_": 0.5}, ("key",)).join(n, "key")
    return pol.map_join(d, p, "key", {"limit_": 0.25})


@query("vol_regimes", "trade_id:s vol_regime:i vol_regime_name:s min_profit:d size_mult:d", SCORED + """, q AS (SELECT quantile_cont(hold, 0.33) AS lo, quantile_cont(hold, 0.66) AS hi FROM sc WHERE entry_time < TIMESTAMP '1997-01-01'),
r AS (SELECT trade_id, CASE WHEN hold < lo THEN CASE WHEN ret > 0.001 THEN 1 ELSE 0 END WHEN hold > hi THEN CASE WHEN ret < -0.001 THEN 4 ELSE 3 END ELSE 2 END AS id FROM sc, q)
SELECT trade_id, id AS vol_regime, ['low_vol_stable', 'low_vol_rising', 'mid_vol', 'high_vol_stable', 'high_vol_falling'][id + 1] AS vol_regime_name, [2.5, 1.0, 1.5, 2.0, 3.0][id + 1] AS min_profit, [0.5, 1.5, 1.0, 0.8, 0.3][id + 1] AS size_mult FROM r""")
def _(T):
    return pol.vol_regimes(scored(T).withColumn("hold", F.col("hold").cast("double")), "hold", "ret", F.col("entry_time") < sp.ts(A))


@query("edge_and_signal", "trade_id:s edge:d profit:d sig:i size_pred:d", SCORED + """, g AS (SELECT *, p * (pred - 1.2) + (1 - p) * (-0.6) AS edge, pred - 1.2 AS profit FROM sc),
a AS (SELECT *, p * greatest(edge, 0) AS raw, p >= 0.4 AS is_on FROM g), s AS (SELECT stddev_pop(raw) + 1e-6 AS sd, max(raw) AS mx FROM a WHERE is_on)
SELECT trade_id, edge, profit, CASE WHEN p >= 0.4 AND edge >= 0.2 THEN 1 WHEN p >= 0.4 AND edge <= -0.2 THEN -1 ELSE 0 END AS sig, CASE WHEN is_on THEN least(greatest((raw / sd) / (mx / sd), 0), 1) ELSE 0 END AS size_pred FROM a, s""")
def _(T):
    d = scored(T).withColumn("cost", F.lit(1.2))
    d = d.withColumns({"edge": pol.straddle_edge("p", "pred", "cost"), "profit": F.greatest(F.col("pred"), F.lit(0.0)) - F.col("cost")})
    d = d.withColumn("sig", pol.vol_signal("p", 0.4, "edge"))
    return pol.straddle_size(d, "p", "edge", F.col("p") >= 0.4)


@query("conditional_threshold", "trade_id:s tau:d", KEYS + """, f AS (SELECT * FROM ky WHERE entry_time < TIMESTAMP '1997-01-01'), g AS (SELECT greatest(0.5, quantile_cont(abs(v), 0.8)) AS gt FROM f),
k AS (SELECT key, quantile_cont(abs(v), 0.8) AS q FROM f GROUP BY key HAVING count(*) >= 900)
SELECT trade_id, least(greatest(coalesce(least(greatest(q, 0.5), greatest(3, 2 * gt)), gt) * (1 + 0.24 * p), 0.5), greatest(3, 2 * gt)) AS tau FROM ky LEFT JOIN k USING (key), g""")
def _(T):
    return pol.conditional_threshold(keyed(T, "trade_id", "entry_time"), "v", "key", F.col("entry_time") < sp.ts(A), 0.8, 1.0, 900, 1 + 0.24 * F.col("p"))


GATE = SCORED + """, c AS (SELECT DISTINCT unnest(quantile_cont(p, [""" + ", ".join(repr(0.01 + 0.98 * i / 100) for i in range(101)) + """, 0.95, 0.9, 0.8])) AS threshold FROM sc),
a AS (SELECT threshold, entry_time, trade_id, p * greatest(v, 0) AS raw, v FROM sc, c WHERE p >= threshold AND v > 0),
s AS (SELECT threshold, stddev_pop(raw) + 1e-6 AS sd, max(raw) AS mx FROM a GROUP BY threshold),
r AS (SELECT a.threshold, entry_time, trade_id, least(greatest((raw / sd) / (mx / sd), 0), 1) * v AS r FROM a JOIN s ON a.threshold = s.threshold),
q AS (SELECT *, sum(r) OVER w AS eq FROM r WINDOW w AS (PARTITION BY threshold ORDER BY entry_time, trade_id)), d AS (SELECT *, max(eq) OVER (PARTITION BY threshold ORDER BY entry_time, trade_id) AS pk FROM q),
m AS (SELECT threshold, avg(r) AS mean, count(*) AS active, count(*) / (SELECT count(*) FROM sc) AS rate, max(pk - eq) AS max_dd, quantile_cont(r, 0.05) AS p05 FROM d GROUP BY threshold),
scores AS (SELECT *, mean - 0.1 * max_dd - 0.15 * greatest(-p05, 0) + 0.05 * 5 - 0.35 * abs(rate - 0.1) AS score, rate BETWEEN 0.05 AND 0.2 AS in_band FROM m)"""


@query("gate_search", "threshold:d mean:d rate:d active:i max_dd:d score:d in_band:b", GATE + " SELECT * FROM scores")
def _(T):
    return pol.gate_search(scored(T), "p", "v", 0.1, (0.05, 0.2))


@query("gate_choice", "threshold:d score:d rate:d in_band:b", GATE + " SELECT threshold, score, rate, in_band FROM scores ORDER BY in_band DESC, round(score, 12) DESC, abs(rate - 0.1) LIMIT 1")
def _(T):
    return pol.best_candidate(pol.gate_search(scored(T), "p", "v", 0.1, (0.05, 0.2)), 0.1)


@query("entry_search", "state:s min_confidence:d min_size:d score:d trade_rate:d precision:d correct_side:d avg_abs_edge:d", KEYS + """, u AS (SELECT key AS state, *, CASE WHEN v > 1 THEN 0 WHEN v < -1 THEN 2 ELSE 1 END AS tr FROM ky UNION ALL SELECT '*' AS state, *, CASE WHEN v > 1 THEN 0 WHEN v < -1 THEN 2 ELSE 1 END AS tr FROM ky),
g AS (SELECT DISTINCT unnest([0.0, 0.35, 0.55, (SELECT quantile_cont(p, 0.35) FROM ky)]) AS mc), h AS (SELECT DISTINCT unnest([0.0, 0.05, 0.12, (SELECT quantile_cont(book / 10.0, 0.35) FROM ky)]) AS ms),
m AS (SELECT state, mc, ms, count(*) AS n, avg((tr <> 1)::int) AS target, avg(k::int) AS trade_rate, avg((cls = tr)::int) FILTER (k) AS correct_side, avg((tr <> 1)::int) FILTER (k) AS precision, avg(abs(v)) FILTER (k) AS avg_abs_edge, coalesce(avg(CASE WHEN book = 1 THEN 0.05 ELSE 0.0 END) FILTER (k), 0) AS bonus
  FROM (SELECT *, book / 10.0 >= ms AND p >= mc AND cls IN (0, 2) AS k FROM u, g, h) GROUP BY 1, 2, 3),
s AS (SELECT *, round(0.55 * precision + 0.3 * correct_side + 0.2 * avg_abs_edge - 0.2 * abs(trade_rate - target) + bonus, 12) AS score FROM m WHERE trade_rate > 0 AND (state = '*' OR n >= 140))
SELECT state, mc AS min_confidence, ms AS min_size, score, trade_rate, precision, correct_side, avg_abs_edge FROM s QUALIFY row_number() OVER (PARTITION BY state ORDER BY score DESC, mc, ms) = 1""")
def _(T):
    d = keyed(T).withColumn("size", F.col("book") / 10.0)
    return pol.entry_search(d, "key", "cls", "p", "size", "v", 1.0, (0.0, 0.35, 0.55), (0.0, 0.05, 0.12), bonus=F.when(F.col("book") == 1, 0.05).otherwise(0.0))


@query("exit_search", "threshold:d delta:d n_trades:i mean_uplift:d p10_uplift:d score:d exit_rate:d allowed:b", PATH + """, g AS (SELECT * FROM (SELECT unnest([0.3, 0.45, 0.6]) AS threshold), (SELECT unnest([-0.08, 0.0, 0.04]) AS delta)),
x AS (SELECT threshold, delta, symbol, eb, step, unreal, exit_prob >= CASE WHEN step < 3 THEN threshold + delta ELSE threshold END AS k FROM path, g),
f AS (SELECT threshold, delta, symbol, eb, coalesce(first(unreal ORDER BY step) FILTER (k), last(unreal ORDER BY step)) - last(unreal ORDER BY step) AS u, count(*)::double AS w FROM x GROUP BY 1, 2, 3, 4),
c AS (SELECT threshold, delta, u, sum(sum(w)) OVER (PARTITION BY threshold, delta ORDER BY u) / sum(sum(w)) OVER (PARTITION BY threshold, delta) AS cw FROM f GROUP BY 1, 2, 3),
p AS (SELECT threshold, delta, min(u) AS p10_uplift FROM c WHERE cw >= 0.1 GROUP BY 1, 2), r AS (SELECT threshold, delta, avg(k::int) AS exit_rate FROM x GROUP BY 1, 2),
m AS (SELECT threshold, delta, count(*) AS n_trades, sum(u * w) / sum(w) AS mean_uplift FROM f GROUP BY 1, 2)
SELECT *, mean_uplift + 0.25 * p10_uplift AS score, exit_rate BETWEEN 0.001 AND 0.6 AS allowed FROM m JOIN p USING (threshold, delta) JOIN r USING (threshold, delta)""")
def _(T):
    return pol.exit_search(path(T), TR, "exit_prob", "unreal", (0.3, 0.45, 0.6), (-0.08, 0.0, 0.04))


@query("horizon_by_state", "key:s horizon:i", KEYS + " SELECT key, least(greatest(cast(floor(quantile_cont(hold / 40, 0.5)) AS int), 2), 30) AS horizon FROM ky GROUP BY key HAVING count(*) >= 120")
def _(T):
    d = keyed(T).withColumn("pk", F.col("hold") / 40)
    n = d.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n >= 120")
    return exact_quantiles(d, "pk", {"m": 0.5}, ("key",)).join(n, "key").withColumn("horizon", F.least(F.greatest(F.floor("m").cast("int"), F.lit(2)), F.lit(30)))


@query("loss_buffer", "buffer:d", SCORED + " SELECT greatest(0, quantile_cont(-v, 0.75) * 1.5) AS buffer FROM sc WHERE v < 0")
def _(T):
    d = scored(T).where("v < 0").withColumn("loss", -F.col("v"))
    return exact_quantiles(d, "loss", {"q": 0.75}).select(F.greatest(F.lit(0.0), F.col("q") * 1.5).alias("buffer"))


@query("metrics_auc", "symbol:s auc:d", SCORED + """, r AS (SELECT symbol, y, rank() OVER w + (count(*) OVER (PARTITION BY symbol, p) - 1) / 2.0 AS r FROM sc WINDOW w AS (PARTITION BY symbol ORDER BY p))
SELECT symbol, (sum(r) FILTER (y = 1) - sum(y) * (sum(y) + 1) / 2.0) / (sum(y) * (count(*) - sum(y))) AS auc FROM r GROUP BY symbol""")
def _(T):
    return mt.auc(scored(T), "y", "p", ["symbol"])


@query("size_formulas", "trade_id:s product:d bucket:d", SCORED + """, q AS (SELECT quantile_cont(abs(ret), 0.05) AS e5, quantile_cont(abs(ret), 0.95) AS e95, quantile_cont(abs(pred), 0.05) AS b5, quantile_cont(abs(pred), 0.95) AS b95 FROM sc),
u AS (SELECT *, least(greatest((p - 0.4) / 0.6, 0), 1) AS act, abs(2 * p - 1) AS dc, least(greatest((abs(ret) - e5) / (e95 - e5), 0), 1) AS en, least(greatest((abs(pred) - b5) / (b95 - b5), 0), 1) AS bn FROM sc, q),
w AS (SELECT *, least(greatest(0.45 * act + 0.3 * dc + 0.15 * bn + 0.1 * en, 0), 1) AS s FROM u),
b AS (SELECT quantile_cont(s, 0.2) AS c1, quantile_cont(s, 0.4) AS c2, quantile_cont(s, 0.6) AS c3, quantile_cont(s, 0.8) AS c4 FROM w WHERE p >= 0.4)
SELECT trade_id, act * (0.35 + 0.65 * dc) * (0.25 + 0.75 * least(abs(ret) / 5, 1)) * (0.5 + 0.5 * least(pred, 1)) / (1 + least(pred, 5)) * (0.6 + 0.4 * p) AS product,
  CASE WHEN p < 0.4 THEN 0 ELSE [0.2, 0.35, 0.5, 0.7, 0.9][(s >= c1)::int + (s >= c2)::int + (s >= c3)::int + (s >= c4)::int + 1] END AS bucket FROM w, b""")
def _(T):
    d = scored(T, "trade_id").withColumn("dir", F.col("p"))
    d = d.withColumn("product", pol.product_size("p", "dir", "ret", "pred", "pred", "p", 0.4))
    return pol.bucket_size(d, "p", "dir", "ret", "pred", 0.4, out="bucket")


# State after state, in the order of names: the lists hold a number for each state and step, `ch` the places of the steps chosen so far.
OFFSETS = KEYS + """, st AS (SELECT unnest([-0.01, 0.0, 0.01]) AS step, unnest([1, 2, 3]) AS i), src AS (SELECT cast(vb AS varchar) AS state, p, v, least(greatest(p, 0), 1) * greatest(v, 0) AS raw FROM ky),
c AS (SELECT state, i, count(*) AS rows, count(*) FILTER (p >= 0.6 + step AND v > 0) AS n, coalesce(sum(raw * v) FILTER (p >= 0.6 + step AND v > 0), 0) AS w, coalesce(max(raw) FILTER (p >= 0.6 + step AND v > 0), 0) AS m FROM src, st GROUP BY 1, 2),
s AS (SELECT state, any_value(rows) AS rows, list(n ORDER BY i) AS n, list(w ORDER BY i) AS w, list(m ORDER BY i) AS m FROM c GROUP BY 1),
a AS MATERIALIZED (SELECT list(state ORDER BY state) AS state, list(rows ORDER BY state) AS rows, list(n ORDER BY state) AS n, list(w ORDER BY state) AS w, list(m ORDER BY state) AS m, count(*) AS k, sum(rows) AS total FROM s),
pick AS (SELECT 0 AS j, list_transform(state, lambda x: 2) AS ch FROM a UNION ALL SELECT j, list_transform(range(1, k + 1), lambda x: CASE WHEN x = j THEN best ELSE ch[x] END) AS ch FROM (
  SELECT j, k, ch, CASE WHEN rows[j] < 500 THEN 2 ELSE coalesce(list_position(f, list_max(list_filter(f, lambda x: x IS NOT NULL))), 2) END AS best FROM (
    SELECT j, k, ch, rows, list_transform([1, 2, 3], lambda i: CASE WHEN ns[i] > 0 THEN round(ws[i] / ms[i] / ns[i] + 0.05 * 5 - 0.35 * abs(ns[i] / total - 0.1), 12) END) AS f FROM (
      SELECT p.j + 1 AS j, k, ch, rows, total, list_transform([1, 2, 3], lambda i: list_sum(list_transform(range(1, k + 1), lambda x: n[x][CASE WHEN x = p.j + 1 THEN i ELSE ch[x] END]))) AS ns,
        list_transform([1, 2, 3], lambda i: list_sum(list_transform(range(1, k + 1), lambda x: w[x][CASE WHEN x = p.j + 1 THEN i ELSE ch[x] END]))) AS ws,
        list_transform([1, 2, 3], lambda i: list_max(list_transform(range(1, k + 1), lambda x: m[x][CASE WHEN x = p.j + 1 THEN i ELSE ch[x] END]))) AS ms FROM pick p, a WHERE p.j < k))))"""


@query("gate_offsets", "state:s step:d", OFFSETS.replace("WITH ", "WITH RECURSIVE ", 1) + " SELECT unnest(state) AS state, unnest(list_transform(ch, lambda x: [-0.01, 0.0, 0.01][x])) AS step FROM pick, a WHERE j = k")
def _(T):
    return pol.gate_offsets(keyed(T), "p", "v", "vb", 0.6, 0.1, steps=(-0.01, 0.0, 0.01))


@query("engine_gate", "label:s passed:i failed:s escalate:b", SCORED + """, r AS (SELECT y, rank() OVER (ORDER BY p) + (count(*) OVER (PARTITION BY p) - 1) / 2.0 AS r FROM sc), au AS (SELECT (sum(r) FILTER (y = 1) - sum(y) * (sum(y) + 1) / 2.0) / (sum(y) * (count(*) - sum(y))) AS auc FROM r),
m AS (SELECT avg(ret) / stddev_samp(ret) * sqrt(count(*) / (date_diff('second', min(exit_time), max(exit_time)) / 86400.0 / 365.25)) AS sh, sum(CASE WHEN ret > 0 THEN ret ELSE 0 END) / -sum(CASE WHEN ret < 0 THEN ret END) AS pf, avg(ret) AS mu,
  avg((driver = 'A')::int) AS ps, power(corr(v, pred), 2) AS r2 FROM sc), g AS (SELECT max(mu) - min(mu) AS gap FROM (SELECT symbol, avg(ret) AS mu FROM sc GROUP BY symbol)),
k AS (SELECT [CASE WHEN auc >= 0.7 THEN NULL ELSE 'holdout_auc_ok' END, CASE WHEN sh >= 0.7 THEN NULL ELSE 'combined_sharpe_ok' END, CASE WHEN pf >= 1.05 THEN NULL ELSE 'combined_pf_ok' END, CASE WHEN mu >= 2e-5 THEN NULL ELSE 'combined_mret_ok' END,
  CASE WHEN ps >= 0.2 THEN NULL ELSE 'policy_exit_share_ok' END, CASE WHEN gap <= 1.2e-4 THEN NULL ELSE 'symbol_gap_ok' END, CASE WHEN r2 >= 0.03 THEN NULL ELSE 'value_signal_ok' END] AS f FROM m, au, g)
SELECT 'COMBINED' AS label, 7 - len(list_filter(f, lambda x: x IS NOT NULL)) AS passed, array_to_string(list_filter(f, lambda x: x IS NOT NULL), ',') AS failed, 7 - len(list_filter(f, lambda x: x IS NOT NULL)) <= 3 AS escalate FROM k""")
def _(T):
    from ..operators import trade_log as tl
    s = scored(T, "symbol", "trade_id", "exit_time", "driver").withColumn("label", F.lit("COMBINED"))
    m = tl.summarise(tl.in_order(s.select("label", "exit_time", "trade_id", "ret", "hold"))).select("label", "sharpe", "profit_factor", "mean_return")
    means = s.groupBy("symbol").agg(F.avg("ret").alias("mu"))
    share = s.agg(F.avg((F.col("driver") == "A").cast("int")).alias("policy_share"), F.pow(F.corr("v", "pred"), F.lit(2)).alias("value_r2"))
    auc = mt.auc(s, "y", "p", ["label"]).select(F.col("auc").alias("holdout_auc"))
    gap = means.agg((F.max("mu") - F.min("mu")).alias("symbol_gap"))
    one = {n: d.select(n).scalar() for d in (share, auc, gap) for n in d.columns}
    return mt.engine_gate(m.withColumns(one))
