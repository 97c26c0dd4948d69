"""Tables between steps, in the folder that all executors share."""
from __future__ import annotations

import uuid
from collections.abc import Callable
from contextvars import ContextVar

from pyspark.sql import Column, DataFrame, functions as F

from ..operators.durable import shared_dir

_passing: ContextVar[list[str] | None] = ContextVar("passing", default=None)  # tables written inside the nearest `concluded`


def scratch(spark, name: str) -> str:
    """A new path in the shared folder of `spark.checkpoint.dir`."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """df written as Parquet in the shared folder and read again: lineage ends here, and lost executors lose nothing of it."""
    spark, path = df.sparkSession, scratch(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    if (tables := _passing.get()) is not None:
        tables.append(path)
    return spark.read.schema(df.schema).parquet(path)


def concluded(make: Callable[[], DataFrame], name: str) -> DataFrame:
    """The rows of make() as `written`. The tables that make() wrote on its way are deleted then; nothing but its rows may read them."""
    mark = _passing.set(tables := [])
    try:
        rows = make()
    finally:
        _passing.reset(mark)
    rows = written(rows, name)
    spark = rows.sparkSession
    for table in tables:
        path = spark._jvm.org.apache.hadoop.fs.Path(table)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
    return rows


def let(value: Column, body) -> Column:
    """body(value) with value computed once: inside a lambda an expression would be computed for every element."""
    return F.transform(F.array(value), body)[0]


def text_of(name: str = "text") -> Column:
    """The text as it is; null counts as empty."""
    return F.coalesce(F.col(name), F.lit(""))
