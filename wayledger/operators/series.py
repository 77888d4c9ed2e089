"""Monthly series: classification of shifts, entity trends and the radar of categories."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W

from ..config import DEFAULT, Thresholds


def monthly(works: DataFrame, date: str, amount: str, keys: tuple[str, ...] = (), drop_last: bool = False) -> DataFrame:
    """(keys, month, works, median_amount, total): ``drop_last`` leaves out the newest month, which may be partial."""
    month = F.date_trunc("month", F.col(date)).cast("date")
    out = works.where(F.col(date).isNotNull()).groupBy(*keys, month.alias("month")).agg(F.count("*").alias("works"), F.percentile(amount, 0.5).alias("median_amount"), F.sum(amount).alias("total"))
    if not drop_last:
        return out
    newest = works.select(F.max(month)).scalar()
    return out.where(F.col("month") < newest)


def trends(points: DataFrame, keys: list[str], order: str, value: str, t: Thresholds = DEFAULT) -> DataFrame:
    """(keys, points, latest, baseline, shift, z_last, trend): the last points of each series against all before."""
    back = F.row_number().over(W.Window.partitionBy(*keys).orderBy(F.desc(order)))
    v, recent = F.col(value).cast("double"), F.col("_back") <= t.series_recent
    out = points.withColumn("_back", back).groupBy(*keys).agg(
        F.count("*").alias("points"),
        F.max(F.when(F.col("_back") == 1, v)).alias("latest"),
        F.avg(F.when(~recent, v)).alias("baseline"),
        F.stddev_pop(F.when(~recent, v)).alias("_sd"),
        F.avg(F.when(recent, v)).alias("_recent"),
        F.percentile(v, 0.5).alias("_median"),
    )
    spread = F.when(F.col("_sd") > 0, F.col("_sd")).otherwise(1e-9)
    move = F.col("_recent") - F.col("baseline")
    out = out.withColumns({"shift": move / (F.abs("baseline") + 1e-9), "z_last": (F.col("latest") - F.col("baseline")) / spread})
    trend = (
        F.when(F.col("points") < t.series_points, "INSUFFICIENT")
        .when((F.abs("shift") >= 0.35) & (F.abs(move) > spread), "PERSISTENT")
        .when(F.abs("z_last") >= 2.5, "SUDDEN")
        .when((F.col("shift") > 0.20) & (F.col("baseline") < F.col("_median")), "EMERGING")
        .otherwise("NORMAL")
    )
    return out.withColumn("trend", trend).drop("_sd", "_recent", "_median")


def radar(works: DataFrame, category: str, date: str, months: int = 12) -> DataFrame:
    """(category, recent_works, earlier_share, recent_share, delta, growth, state): the last year's shares against before."""
    cutoff = F.add_months(works.select(F.date_trunc("month", F.max(date)).cast("date")).scalar(), -months)
    late = F.date_trunc("month", F.col(date)).cast("date") > cutoff
    counts = works.where(F.col(date).isNotNull()).groupBy(category).agg(F.sum(late.cast("long")).alias("_r"), F.sum((~late).cast("long")).alias("_e"))
    whole = W.Window.partitionBy()
    out = counts.withColumns(
        {
            "recent_works": F.when(F.col("_r") > 0, F.col("_r")),
            "recent_share": F.coalesce(F.col("_r") / F.sum("_r").over(whole), F.lit(0.0)),
            "earlier_share": F.coalesce(F.col("_e") / F.sum("_e").over(whole), F.lit(0.0)),
        }
    )
    out = out.withColumn("delta", F.col("recent_share") - F.col("earlier_share")).withColumn("growth", F.col("delta") / (F.col("earlier_share") + 1e-6))
    state = (
        F.when((F.col("earlier_share") < 0.002) & (F.col("recent_share") > 0.005), "EMERGING").when(F.col("growth") > 0.5, "GROWING")
        .when(F.col("growth") < -0.4, "DECLINING").otherwise("STABLE")
    )
    return out.withColumn("state", state).drop("_r", "_e")


def by_year(df: DataFrame, keys: list[str], date: str, **aggregates: Column) -> DataFrame:
    """Aggregates by key and year, with the total of each year and of everything as rows of null keys."""
    return df.withColumn("year", F.year(date)).rollup("year", *keys).agg(*[c.alias(n) for n, c in aggregates.items()])
