"""Model-side data work on Spark ML and aggregates."""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.classification import GBTClassifier
from pyspark.ml.clustering import KMeans
from pyspark.ml.feature import PCA, RobustScaler, VectorAssembler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import GBTRegressor, IsotonicRegression
from pyspark.sql import Column, DataFrame, functions as F

from ..functions.exprs import c, clip
from .durable import durable
from .layout import in_chunks
from .ranks import exact_quantiles

TREE_ROWS = 1 << 19  # of a part that trees are fitted on


def fit_temperature(df: DataFrame, y: str, probs: str, lo: float = 0.5, hi: float = 3.0, points: int = 64) -> DataFrame:
    """Temperature with the least mean negative log likelihood on a grid; ties take the smaller one.

    All grid points are aggregated in one pass over the rows.
    """
    grid = [lo + (hi - lo) * i / (points - 1) for i in range(points)]
    logs = F.transform(c(probs), lambda p: F.ln(F.least(F.greatest(p, F.lit(1e-12)), F.lit(1.0))))
    d = df.select(F.col(y).cast("int").alias("_y"), logs.alias("_l")).withColumn("_mx", F.array_max("_l"))

    def nll(t):
        z = F.ln(F.aggregate(F.transform("_l", lambda v: F.exp((v - F.col("_mx")) / t)), F.lit(0.0), lambda a, b: a + b))
        return z - (F.element_at("_l", F.col("_y") + 1) - F.col("_mx")) / t
    one = d.agg(*[F.round(F.avg(nll(t)), 9).alias(f"n{i}") for i, t in enumerate(grid)])
    rows = F.array(*[F.struct(F.col(f"n{i}").alias("nll"), F.lit(t).alias("temperature")) for i, t in enumerate(grid)])
    return one.select(F.array_min(rows).alias("r")).select("r.temperature", "r.nll")


def soft_clusters(df: DataFrame, vec: str, k: int, seed: int = 7, least_t: float = 0.35) -> DataFrame:
    """K-means centres and softmax(-d^2 / T^2) memberships, T the median nearest distance, at least `least_t`."""
    d = df.withColumn("_v", array_to_vector(F.transform(vec, lambda x: x.cast("double"))))
    model = KMeans(k=k, seed=seed, featuresCol="_v", predictionCol="cluster", maxIter=20).fit(d)
    centres = F.array(*[F.array(*[F.lit(float(x)) for x in cc]) for cc in model.clusterCenters()])
    dist = F.transform(centres, lambda m: F.aggregate(F.zip_with(m, F.col(vec), lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda a, b: a + b))
    d = model.transform(d).withColumn("_d2", dist).withColumn("nearest", F.sqrt(F.array_min("_d2")))
    t = exact_quantiles(d, "nearest", {"m": 0.5}).select(F.greatest(F.col("m"), F.lit(least_t))).scalar()
    d = d.withColumn("_t", t).withColumn("_w", F.transform("_d2", lambda x: F.exp(-(x - F.array_min("_d2")) / (F.col("_t") * F.col("_t")))))
    d = d.withColumn("_s", F.aggregate("_w", F.lit(0.0), lambda a, b: a + b))
    return d.withColumn("membership", F.transform("_w", lambda w: w / F.col("_s"))).drop("_v", "_d2", "_t", "_w", "_s")


def walk_forward_clusters(df: DataFrame, cols: Sequence[str], k: int, chunk: Column, seed: int = 7, past: int | None = None,
                          out: str = "cluster") -> DataFrame:
    """For each time chunk, clusters fitted on the chunks before it (the last `past` of them), after robust scaling.

    `chunk` is a whole number that grows with time; the chunks are those that
    occur, and as few as periods of time. The first one is fitted on itself.
    Clusters are numbered by their centre in the first column, so a number
    means the same in every chunk. Rows with a missing input keep a missing cluster.
    """
    ok = F.lit(True)
    for n in cols:
        ok = ok & F.col(n).isNotNull() & ~F.isnan(F.col(n).cast("double"))
    rows = durable(df.withColumns({"_c": chunk, "_ok": F.coalesce(ok & chunk.isNotNull(), F.lit(False))}))
    d = VectorAssembler(inputCols=list(cols), outputCol="_v").transform(rows.where("_ok"))
    parts = rows.where("NOT _ok").withColumn(out, F.lit(None).cast("int"))
    chunks = [r["_c"] for r in d.select("_c").distinct().orderBy("_c").collect()]
    first = chunks[0] if chunks else None
    for i in chunks:
        if i == first:
            fit = d.where(F.col("_c") == i)
        else:
            fit = d.where(F.col("_c") < i) if past is None else d.where((F.col("_c") < i) & (F.col("_c") >= i - past))
        scaler = RobustScaler(inputCol="_v", outputCol="_s", withCentering=True).fit(fit)
        model = KMeans(k=k, seed=seed, featuresCol="_s", predictionCol="_k", maxIter=10).fit(scaler.transform(fit))
        order = sorted(range(k), key=lambda j: float(model.clusterCenters()[j][0]))
        number = F.array(*[F.lit(order.index(j)) for j in range(k)])
        got = model.transform(scaler.transform(d.where(F.col("_c") == i))).withColumn(out, F.element_at(number, F.col("_k") + 1)).drop("_v", "_s", "_k")
        parts = parts.unionByName(got)
    return parts.drop("_c", "_ok")


def two_streams(df: DataFrame, direction: Sequence[str], volatility: Sequence[str], k: tuple[int, int], chunk: Column, *, order: Sequence[str] = ("bar_no",),
                keys: Sequence[str] = ("symbol",), seed: int = 7, past: int | None = None, width: int = 3) -> DataFrame:
    """Direction and volatility clusters walked forward apart, their joint state, and the most frequent state of the last `width` rows.

    Both numberings grow with the stream's first column, so state = direction * k[1] + volatility. Among equally frequent
    states the latest one holds. Rows without a cluster have no state and don't count.
    """
    d = walk_forward_clusters(df, direction, k[0], chunk, seed, past, "dir_cluster")
    d = durable(walk_forward_clusters(d, volatility, k[1], chunk, seed, past, "vol_cluster"))
    d = d.withColumn("state", F.col("dir_cluster") * k[1] + F.col("vol_cluster"))

    def mode(x, f):
        last = F.array_compact(F.array(*[f.lag("state", i) if i else F.col("state") for i in range(width)]))  # the latest first
        rank = F.transform(last, lambda v, i: F.struct(F.size(F.filter(last, lambda u: u == v)).alias("n"), (-i).alias("late"), v.alias("v")))
        return x.withColumn("smooth_state", F.array_max(rank)["v"])
    return in_chunks(d, mode, history=width - 1, keys=keys, pos=order[0])


def novelty(df: DataFrame, vec: str, k: int, fit: Column) -> DataFrame:
    """PCA reconstruction error, rescaled 0..1 by the 5% and 95% quantiles of the fit rows."""
    d = df.withColumn("_v", array_to_vector(F.transform(vec, lambda x: x.cast("double"))))
    model = PCA(k=k, inputCol="_v", outputCol="_z").fit(d.where(fit))
    pc = model.pc.toArray()
    d = model.transform(d).withColumn("_z", vector_to_array("_z"))
    total = F.aggregate(F.transform(vec, lambda x: x.cast("double") * x.cast("double")), F.lit(0.0), lambda a, b: a + b)
    kept = F.aggregate(F.transform("_z", lambda x: x * x), F.lit(0.0), lambda a, b: a + b)
    assert pc.shape[1] == k
    d = d.withColumn("residual", F.sqrt(F.greatest(total - kept, F.lit(0.0))))
    q = exact_quantiles(d.where(fit), "residual", {"lo": 0.05, "hi": 0.95}).select(F.struct("lo", "hi")).scalar()
    d = d.withColumn("_q", q)
    return d.withColumn("novelty", clip((F.col("residual") - F.col("_q.lo")) / F.greatest(F.col("_q.hi") - F.col("_q.lo"), F.lit(1e-6)), 0.0, 1.0)).drop("_v", "_z", "_q")


def isotonic(df: DataFrame, y: str, p: str, fit: Column, out: str = "calibrated", least: int = 100) -> DataFrame:
    """Isotonic calibration on the fit rows, clipped to 0..1; the raw value with too few rows or one class."""
    rows = df.where(fit)
    n = rows.agg(F.count(F.lit(1)).alias("n"), F.count_distinct(y).alias("k")).first()
    if n["n"] < least or n["k"] < 2:
        return df.withColumn(out, F.col(p))
    # equal scores share one weighted row, so the fit grows with distinct scores only
    pts = rows.groupBy(F.col(p).alias("_p")).agg(F.avg(F.col(y).cast("double")).alias("label"), F.count(F.lit(1)).cast("double").alias("weight"))
    model = IsotonicRegression(featuresCol="_p", labelCol="label", weightCol="weight", predictionCol="_iso").fit(pts)
    return model.transform(df.withColumn("_p", F.col(p))).withColumn(out, clip(F.col("_iso"), 0.0, 1.0)).drop("_p", "_iso")


def even_parts(df: DataFrame, most: int = TREE_ROWS) -> DataFrame:
    """df kept in parts of at most `most` rows, as trees hold a part in the memory of one task; where one is larger, the rows are dealt evenly."""
    d = durable(df)
    parts = d.groupBy(F.spark_partition_id()).agg(F.count(F.lit(1)).alias("n")).agg(F.max("n").alias("most"), F.sum("n").alias("n")).first()
    if not parts["n"] or parts["most"] <= most:
        return d
    return durable(d.repartition(max(-(-parts["n"] // most), d.sparkSession.sparkContext.defaultParallelism)))


def out_of_fold_trees(df: DataFrame, cols: Sequence[str], y: str, fold: str, folds: int, *, kind: str = "classifier", rounds: int = 10,
                      depth: int = 3, seed: int = 7, out: str = "oof") -> DataFrame:
    """Boosted trees fitted on all other folds predict each fold."""
    d = VectorAssembler(inputCols=list(cols), outputCol="_v", handleInvalid="keep").transform(even_parts(df).withColumn("_y", F.col(y).cast("double")))
    parts = None
    for i in range(folds):
        args = dict(featuresCol="_v", labelCol="_y", maxIter=rounds, maxDepth=depth, seed=seed)
        est = GBTClassifier(**args) if kind == "classifier" else GBTRegressor(**args)
        got = est.fit(d.where(F.col(fold) != i)).transform(d.where(F.col(fold) == i))
        val = vector_to_array("probability")[1] if kind == "classifier" else F.col("prediction")
        got = got.withColumn(out, val).select(*df.columns, out)
        parts = got if parts is None else parts.unionByName(got)
    return parts


def boosted_heads(df: DataFrame, cols: Sequence[str], heads: dict[str, tuple[str, str]], fold: str, folds: int, *, most: int = 20, depth: int = 3,
                  share: int = 5, seed: int = 7) -> DataFrame:
    """Out-of-fold predictions of several boosted heads, {name: (classifier | regressor, label)}.

    In each fold a head stops growing when its error on every `share`-th training row (by hash) does not fall. Then each
    fold is fitted with the median of these rounds over the folds, so that no fold is better grown than the others.
    """
    d = even_parts(df.withColumn("_hold", F.pmod(F.xxhash64(*cols), F.lit(share)) == 0))
    d = VectorAssembler(inputCols=list(cols), outputCol="_v", handleInvalid="keep").transform(d)
    parts = None
    rounds: dict[str, int] = {}

    def fitted(kind, label, n, rows, stop):
        args = dict(featuresCol="_v", labelCol=label, maxIter=n, maxDepth=depth, seed=seed)
        args |= dict(validationIndicatorCol="_hold", validationTol=0.01) if stop else {}
        return (GBTClassifier(**args) if kind == "classifier" else GBTRegressor(**args)).fit(rows)

    for name, (kind, y) in heads.items():
        rows = d.withColumn("_y", F.col(y).cast("double")).where(F.col("_y").isNotNull())
        grown = sorted(fitted(kind, "_y", most, rows.where(F.col(fold) != i), True).getNumTrees for i in range(folds))
        rounds[name] = max(1, int(grown[(folds - 1) // 2] + grown[folds // 2]) // 2)
    for i in range(folds):
        part = d.where(F.col(fold) == i)
        for name, (kind, y) in heads.items():
            train = d.withColumn("_y", F.col(y).cast("double")).where((F.col(fold) != i) & F.col("_y").isNotNull())
            got = fitted(kind, "_y", rounds[name], train, False).transform(part)
            part = got.withColumn(name, vector_to_array("probability")[1] if kind == "classifier" else F.col("prediction")).drop("prediction", "rawPrediction", "probability")
        parts = part if parts is None else parts.unionByName(part)
    return parts.drop("_v", "_hold")


def gain_share(df: DataFrame, cols: Sequence[str], y: str, least: float = 0.01, keep_min: int = 20, seed: int = 7) -> DataFrame:
    """(name, importance, kept): columns with at least `least` of the gain, but no fewer than keep_min, are kept."""
    d = VectorAssembler(inputCols=list(cols), outputCol="_v", handleInvalid="keep").transform(df.withColumn("_y", F.col(y).cast("double")))
    imp = GBTRegressor(featuresCol="_v", labelCol="_y", maxIter=10, maxDepth=3, seed=seed).fit(d).featureImportances.toArray()
    order = sorted(range(len(cols)), key=lambda i: (-imp[i], i))
    kept = [i for i in order if imp[i] >= least]
    kept = set(kept if len(kept) >= keep_min else order[:keep_min])
    return df.sparkSession.createDataFrame([(cols[i], float(imp[i]), i in kept) for i in order], "name string, importance double, kept boolean")


def hurdle(p_nonzero, value, power: float = 1.0) -> Column:
    """p^k times the value, k in 0.5..2."""
    return F.pow(clip(c(p_nonzero), 0.0, 1.0), F.lit(min(max(power, 0.5), 2.0))) * c(value)


def hurdle_epsilon(df: DataFrame, y: str) -> DataFrame:
    """10% quantile of positive |y| between 0.05 and 0.35."""
    d = df.withColumn("_a", F.abs(y)).where("_a > 0")
    return exact_quantiles(d, "_a", {"q": 0.1}).select(F.least(F.greatest(F.col("q"), F.lit(0.05)), F.lit(0.35)).alias("epsilon"))
