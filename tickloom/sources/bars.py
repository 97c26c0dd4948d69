"""Bar tables: scans, cleaning, upsert, warm-up, manifests."""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from ..functions.exprs import c

BAR = ("symbol string, t timestamp_ntz, open double, high double, low double, close double, volume double")
OHLCV = ("open", "high", "low", "close", "volume")


def read_bars(spark: SparkSession, paths: Sequence[str] | str, fmt: str = "parquet", time_col: str = "time_key") -> DataFrame:
    """Scan bar files into BAR.

    CSV files have one symbol each and no symbol column; the symbol is the
    file name. A partition column `symbol` is used when the files have one.
    """
    paths = [paths] if isinstance(paths, str) else list(paths)
    if fmt == "csv":
        raw = spark.read.option("header", True).csv(paths)
    else:
        raw = spark.read.format(fmt).load(paths)
    if "symbol" not in raw.columns:
        name = F.regexp_extract(F.col("_metadata.file_name"), r"^([^.]+)", 1)
        raw = raw.select("*", name.alias("symbol"))
    if time_col in raw.columns and time_col != "t":
        raw = raw.withColumnRenamed(time_col, "t")
    return raw.withColumn("t", F.col("t").cast("timestamp_ntz"))


def clean_bars(df: DataFrame, cols: Sequence[str] = OHLCV) -> DataFrame:
    """Finite numbers or nothing; rows without all of OHLCV are dropped."""
    return (df.withColumns({n: F.col(n).try_cast("double") for n in cols})
            .withColumns({n: F.when(~F.isnan(n) & (F.abs(n) < float("inf")), F.col(n)) for n in cols})
            .dropna(subset=list(cols)))


def between(df: DataFrame, start: Column | str, end: Column | str, t: str = "t") -> DataFrame:
    """Half-open time range; reaches the Parquet scan as a pushed filter."""
    lo, hi = (F.lit(x).cast("timestamp_ntz") if isinstance(x, str) else x for x in (start, end))
    return df.where((c(t) >= lo) & (c(t) < hi))


def with_warm_up(df: DataFrame, start: str, end: str, build, *, days: int = 10, t: str = "t") -> DataFrame:
    """Compute `build` on [start - days, end), then keep [start, end)."""
    lo = F.lit(start).cast("timestamp_ntz") - F.make_dt_interval(F.lit(days))
    hi = F.lit(end).cast("timestamp_ntz")
    return build(between(df, lo, hi, t)).where(c(t) >= F.lit(start).cast("timestamp_ntz"))


def keep_one(df: DataFrame, by: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """First row per `by` in the given order, as an aggregate so that copies fold before the shuffle.

    The order columns must make the choice unique.
    """
    rest = [n for n in df.columns if n not in by]
    rank = F.struct(*[x.alias(f"o{i}") for i, x in enumerate(order)])
    return (df.groupBy(*by).agg(F.min_by(F.struct(*rest), rank).alias("_r"))
            .select(*by, "_r.*").select(*df.columns))


def keep_last(df: DataFrame, by: Sequence[str], ingest: str) -> DataFrame:
    """Newest row per key; `ingest` grows with arrival."""
    rest = [n for n in df.columns if n not in by]
    return (df.groupBy(*by).agg(F.max_by(F.struct(*rest), F.col(ingest)).alias("_r"))
            .select(*by, "_r.*").select(*df.columns))


def upsert(old: DataFrame, new: DataFrame, by: Sequence[str] = ("symbol", "t"), page: str = "page") -> DataFrame:
    """Bars of `old` overlaid by `new`; among new rows the last page wins."""
    a = old.withColumn(page, F.lit(-1).cast("bigint"))
    return keep_last(a.unionByName(new, allowMissingColumns=True), by, page).drop(page)


def ordered_columns(df: DataFrame, preferred: Sequence[str]) -> DataFrame:
    """Preferred columns first, the others after them."""
    first = [n for n in preferred if n in df.columns]
    return df.select(*first, *[n for n in df.columns if n not in first])


def select_present(df: DataFrame, required: Sequence[str], optional: Sequence[str] = (),
                   rename: dict[str, str] | None = None) -> DataFrame:
    """Required columns, those optional ones that exist, some renamed."""
    missing = [n for n in required if n not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {missing}")
    picked = [*required, *[n for n in optional if n in df.columns]]
    names = rename or {}
    return df.select(*[F.col(n).alias(names.get(n, n)) for n in picked])


def write_stage(df: DataFrame, path: str, partition_by: Sequence[str] = ("symbol",)) -> None:
    """A stage output or trade log as Parquet, split by symbol."""
    df.write.mode("overwrite").partitionBy(*partition_by).parquet(path)


def file_state(spark: SparkSession, path: str, version: str) -> DataFrame:
    """Manifest rows: file, size, modification time, code version."""
    return (spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
            .select(F.col("path"), F.col("length").alias("size"),
                    F.col("modificationTime").alias("changed"), F.lit(version).alias("version")))


def cached(spark: SparkSession, source: str, version: str, store: str, build) -> DataFrame:
    """The table in `store` that was built from the present state of `source`; built anew if there is none.

    The state's digest names both folders. The manifest is written after the data, so a build that broke off is never read.
    """
    now = file_state(spark, source, version)
    one = F.sort_array(F.collect_list(F.concat_ws("|", "path", "size", F.col("changed").cast("string"), "version")))
    name = now.agg(F.sha2(F.array_join(one, "\n"), 256)).first()[0]  # one line for each input file
    data, manifest = f"{store}/{name}/data", f"{store}/{name}/manifest"
    try:
        spark.read.schema(now.schema).parquet(manifest)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        build().write.mode("overwrite").parquet(data)
        now.write.mode("overwrite").parquet(manifest)
    return spark.read.parquet(data)


def read_folds(spark: SparkSession, path: str) -> DataFrame:
    """Fold list from JSON: test_start, test_end and optional is_start, is_end; empty or reversed folds raise."""
    raw = spark.read.option("multiLine", True).json(path)
    if "folds" in raw.columns:
        raw = raw.select(F.posexplode("folds").alias("fold", "f")).select("fold", "f.*")
    else:
        raw = raw.withColumn("fold", F.row_number().over(Window.orderBy("test_start")) - 1)
    day = {n: F.col(n).cast("date") for n in raw.columns if n.endswith(("_start", "_end"))}
    folds = raw.withColumns(day)
    bad = folds.where("test_start is null or test_end is null or test_start >= test_end")
    if not bad.isEmpty():
        raise ValueError("each fold needs test_start < test_end")
    return folds


def to_json_rows(df: DataFrame, out: str = "doc") -> DataFrame:
    """One JSON document per row; NaN and infinities become null."""
    from ..functions.exprs import finite
    doubles = {f.name: finite(F.col(f.name)) for f in df.schema.fields if f.dataType.simpleString() in ("double", "float")}
    clean = df.withColumns(doubles) if doubles else df
    return clean.select(F.to_json(F.struct(*clean.columns), {"ignoreNullFields": "false"}).alias(out))


def from_json_rows(df: DataFrame, schema: str, col: str = "doc") -> DataFrame:
    return df.select(F.from_json(col, schema).alias("d")).select("d.*")


def write_document(df: DataFrame, path: str) -> None:
    """Metric rows as JSON lines."""
    to_json_rows(df).write.mode("overwrite").text(path)
