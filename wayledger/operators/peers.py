"""Comparison with peers: hierarchical back-off, leave-one-out percentiles and robust distances."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import DEFAULT, Thresholds
from .quantiles import joined, quantiles, ranges


def backed_off(works: DataFrame, levels: list[list[str]], t: Thresholds = DEFAULT, min_peers: int | None = None) -> DataFrame:
    """``peer_level``, ``peer_group`` and ``peer_group_size``: the first level whose group, over all rows, is large enough.

    A row with a null key at a level doesn't qualify there; after the last level comes the whole table.  Group sizes are
    small aggregates joined back, so the rows themselves are shuffled for no level if Spark broadcasts them.
    """
    least = t.min_peers if min_peers is None else min_peers
    out, level, group, size = works, F.lit("global"), F.lit("global"), works.select(F.count("*")).scalar()
    for i, keys in reversed(list(enumerate(levels))):
        counts = works.na.drop(subset=keys).groupBy(*keys).agg(F.count("*").alias(f"_n{i}"))
        out = out.join(counts, keys, "left")
        enough = F.coalesce(F.col(f"_n{i}") >= least, F.lit(False))
        name = "|".join(keys)
        level = F.when(enough, name).otherwise(level)
        group = F.when(enough, F.concat_ws("|", F.lit(name), *keys)).otherwise(group)
        size = F.when(enough, F.col(f"_n{i}")).otherwise(size)
    out = out.withColumns({"peer_level": level, "peer_group": group, "peer_group_size": size})
    return out.drop(*[f"_n{i}" for i in range(len(levels))])


def leave_one_out_percentile(df: DataFrame, group: list[str], value: str, name: str) -> DataFrame:
    """(average rank - 1) / (n - 1) within the group; n counts null values, which get null, as do groups of one row.

    Ranks come from ranges of the distinct values, so neither ties nor a giant group meet in one task.
    """
    keys = F.struct(*[F.col(g) for g in group], F.lit(0))
    sizes = df.groupBy(keys.alias("_of")).agg(F.count("*").alias("_all"))
    ranked = ranges(df, group, value).join(sizes, F.col("_g") == F.col("_of"))
    pct = F.when(F.col("_all") > 1, (F.col("_below") + (F.col("_same") - 1) / 2) / (F.col("_all") - 1))
    ranked = ranked.select("_g", "_v", pct.alias(name))
    return df.join(ranked, (keys == F.col("_g")) & (F.col(value) == F.col("_v")), "left").drop("_g", "_v")


def robust_z(df: DataFrame, group: list[str], value: str, name: str, t: Thresholds = DEFAULT, approximate: bool = False) -> DataFrame:
    """(value - median) / spread: the scaled median deviation, where that is 0 the scaled quartile range, else 0 for all.

    Exact quantiles come from ranges of the distinct values, in two sorts; ``approximate`` needs none, but one bounded
    sketch a group.  A null is a group of its own.
    """
    shares = {"_m": 0.5, "_q1": 0.25, "_q3": 0.75}

    def found(d: DataFrame, of: str, at: dict[str, float]) -> DataFrame:
        if not approximate:
            return quantiles(d, group, of, at)
        return d.groupBy(*group).agg(*[F.percentile_approx(of, q, 10_000).alias(n) for n, q in at.items()])

    near = joined(df, group, found(df, value, shares)).withColumn("_d", F.abs(F.col(value) - F.col("_m")))
    out = joined(near, group, found(near, "_d", {"_mad": 0.5}))
    mad, iqr = F.col("_mad") * t.mad_scale, (F.col("_q3") - F.col("_q1")) / t.iqr_scale
    z = F.when(mad > 0, (F.col(value) - F.col("_m")) / mad).when(iqr > 0, (F.col(value) - F.col("_m")) / iqr).otherwise(F.when(F.col(value).isNotNull(), 0.0))
    return out.withColumn(name, z).drop("_m", "_q1", "_q3", "_d", "_mad")
