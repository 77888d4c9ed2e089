"""Exact ranks and quantiles of groups of any size: distinct values sorted into ranges, and one count for each group and range."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W

from ..sources.tables import stored


def ranges(df: DataFrame, group: list[str], value: str) -> DataFrame:
    """(_g, _v, _same, _below, _n): each group's distinct non-null values, how many rows bear one, how many bear a smaller one,
    and how many the group has.  ``_g`` is a struct of the group's keys, in which null equals null.

    The distinct values of all groups are sorted into ranges; running counts are made inside a range and moved by the
    group's counts in the ranges before.  So a group that holds most rows is spread over as many tasks as it fills ranges,
    and neither a window nor a buffer is ever as large as a group.
    """
    counts = df.where(F.col(value).isNotNull()).groupBy(F.struct(*[F.col(g) for g in group], F.lit(0)).alias("_g"), F.col(value).alias("_v")).agg(F.count("*").alias("_same"))
    placed = stored(counts.orderBy("_g", "_v").withColumn("_range", F.spark_partition_id()))
    of = W.Window.partitionBy("_g")
    sums = placed.groupBy("_g", "_range").agg(F.sum("_same").alias("_sum"))  # a row for each group and range it reaches into
    before = sums.select("_g", "_range", (F.sum("_sum").over(of.orderBy("_range")) - F.col("_sum")).alias("_before"), F.sum("_sum").over(of).alias("_n"))
    inside = W.Window.partitionBy("_g", "_range").orderBy("_v").rowsBetween(W.Window.unboundedPreceding, -1)
    within = placed.withColumn("_within", F.coalesce(F.sum("_same").over(inside), F.lit(0)))
    return within.join(before, ["_g", "_range"]).select("_g", "_v", "_same", (F.col("_before") + F.col("_within")).alias("_below"), "_n")


def at_shares(cumulated: DataFrame, shares: dict[str, float]) -> DataFrame:
    """(_g, the named quantiles) from ``ranges``: between two neighbours by the share of the way, as ``percentile`` has it."""
    aggs = {}
    holds = lambda place: (F.col("_below") <= place) & (place < F.col("_below") + F.col("_same"))
    for name, q in shares.items():
        place = (F.col("_n") - 1) * q
        aggs[f"{name}_lo"] = F.max(F.when(holds(F.floor(place)), F.col("_v").cast("double")))
        aggs[f"{name}_hi"] = F.max(F.when(holds(F.ceil(place)), F.col("_v").cast("double")))
        aggs[f"{name}_way"] = F.max(place - F.floor(place))
    out = cumulated.groupBy("_g").agg(*[v.alias(k) for k, v in aggs.items()])
    return out.select("_g", *[((1 - F.col(f"{n}_way")) * F.col(f"{n}_lo") + F.col(f"{n}_way") * F.col(f"{n}_hi")).alias(n) for n in shares])


def quantiles(df: DataFrame, group: list[str], value: str, shares: dict[str, float]) -> DataFrame:
    """(group, the named quantiles of ``value``), for groups that have a value; null is a group of its own."""
    out = at_shares(ranges(df, group, value), shares)
    return out.select(*[F.col("_g")[g].alias(g) for g in group], *shares)


def joined(df: DataFrame, group: list[str], found: DataFrame) -> DataFrame:
    """``df`` with the columns of ``found`` (group, ...), null groups meeting null groups; few rows are broadcast by their size."""
    named = found.select(F.struct(*[F.col(g) for g in group], F.lit(0)).alias("_found"), *[c for c in found.columns if c not in group])
    return df.join(named, F.struct(*[F.col(g) for g in group], F.lit(0)) == F.col("_found"), "left").drop("_found")
