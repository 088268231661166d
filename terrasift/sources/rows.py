"""From parsed features to DataFrames."""

from __future__ import annotations

from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from terrasift.model import FID


def _column(values: list[Any]) -> pa.Array:
    """Of one type: the values' own, or text where they differ."""
    kinds = {type(v) for v in values if v is not None}
    if not kinds:
        return pa.array(values, pa.string())
    if kinds <= {bool} or kinds <= {str} or kinds <= {bytes}:
        return pa.array(values)
    if kinds <= {int} and all(v is None or -(2**63) <= v < 2**63 for v in values):
        return pa.array(values, pa.int64())
    if kinds <= {int, float}:
        return pa.array([None if v is None else float(v) for v in values], pa.float64())
    return pa.array([None if v is None else v if isinstance(v, str) else str(v) for v in values], pa.string())


def frame_of(spark: SparkSession, rows: list[dict[str, Any]], geom: str | None, crs: str | None) -> tuple[DataFrame, str | None, str | None]:
    """(df, geometry column, crs) of features in file order; names missing in some rows are null there."""
    names = list(dict.fromkeys(k for r in rows for k in r)) or ([geom] if geom else [])
    columns = {FID: pa.array(range(len(rows)), pa.int64())}
    for n in names:
        values = [r.get(n) for r in rows]
        columns[n] = pa.array(values, pa.binary()) if n == geom else _column(values)
    return spark.createDataFrame(pa.table(columns)), geom, crs


def numbered(df: DataFrame, key: str | None = None) -> DataFrame:
    """df with ids 0 to n - 1 in its own order (or a key's values): one count of rows per partition, no shuffle of the rows."""
    if key:
        return df.withColumn(FID, F.col(key).cast("long"))
    if FID in df.columns:
        return df
    marked = df.withColumn("__p", F.spark_partition_id()).withColumn("__m", F.monotonically_increasing_id())
    sizes = marked.groupBy("__p").agg(F.count("*").alias("n"), F.min("__m").alias("first"))
    start = sizes.withColumn("start", F.coalesce(F.sum("n").over(W.orderBy("__p").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))).select("__p", "start", "first")
    # One row per partition.
    out = marked.join(F.broadcast(start), "__p").withColumn(FID, F.col("start") + F.col("__m") - F.col("first"))
    return out.select(FID, *[F.col(f"`{c}`") for c in df.columns])
