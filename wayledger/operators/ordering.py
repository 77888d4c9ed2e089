"""Ranks over whole tables without a window that meets in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W

from ..sources.tables import stored


def ranked(df: DataFrame, name: str, *order: Column) -> DataFrame:
    """``df`` with its place (from 1) in ``order`` as ``name``; the order must leave no ties for reruns to agree.

    Rows are sorted into ranges, numbered inside each, and each range is moved by the size of those before it: only one
    count a range is gathered.  Neither ``name`` nor ``_range``, ``_of`` and ``_before`` may be a column of ``df``.
    """
    ranges = stored(df.orderBy(*order).withColumn("_range", F.spark_partition_id()))
    sizes = ranges.groupBy("_range").agg(F.count("*").alias("_n"))
    earlier = F.coalesce(F.sum("_n").over(W.Window.orderBy("_range").rowsBetween(W.Window.unboundedPreceding, -1)), F.lit(0))
    moved = sizes.select(F.col("_range").alias("_of"), earlier.alias("_before"))
    inside = F.row_number().over(W.Window.partitionBy("_range").orderBy(*order))
    placed = ranges.withColumn(name, inside).join(F.broadcast(moved), F.col("_range") == F.col("_of"))  # one row a range
    return placed.withColumn(name, F.col(name) + F.col("_before")).drop("_range", "_of", "_before")
