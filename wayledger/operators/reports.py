"""Aggregated reports over scored works: rates with floors, significance, rankings, concentration, calibration, ageing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W

from ..config import DEFAULT, Thresholds
from ..functions.columns import share, wilson
from ..sources.tables import stored
from .quantiles import joined, quantiles, ranges


def group_report(works: DataFrame, keys: list[str], floor: int = DEFAULT.rate_floor) -> DataFrame:
    """Counts, sums and distincts by group; rates and exposure a work are null below ``floor`` works, not 0."""
    lead = F.col("band").isin("MEDIUM", "HIGH")
    enough = lambda c: F.when(F.col("works") >= floor, c)
    out = works.groupBy(*keys).agg(
        F.count("*").alias("works"), F.sum("recommended_amount").alias("amount"), F.sum("exposure").alias("exposure"), F.count_if(lead).alias("leads"),
        F.countDistinct("implementing_agency").alias("agencies"), F.avg("is_completed").alias("_done"), share(lead).alias("_lead"),
    )
    return out.withColumns({"completion_rate": enough(F.col("_done")), "lead_rate": enough(F.col("_lead")), "exposure_a_work": enough(F.col("exposure") / F.col("works"))}).drop("_done", "_lead")


def significance(works: DataFrame, keys: list[str], event: Column, floor: int = DEFAULT.rate_floor, t: Thresholds = DEFAULT) -> DataFrame:
    """(keys, works, hits, rate, low, high, reading): each group's interval against the overall rate."""
    overall = works.select(share(event)).scalar()
    out = works.groupBy(*keys).agg(F.count("*").alias("works"), F.count_if(event).alias("hits"))
    low, high = wilson("hits", "works", t)
    out = out.withColumns({"rate": F.col("hits") / F.col("works"), "low": low, "high": high})
    reading = F.when(F.col("works") < floor, "no_rate").when(F.col("low") > overall, "above").when(F.col("high") < overall, "below").otherwise("inconclusive")
    return out.withColumn("reading", reading)


def top(df: DataFrame, n: int, *order: Column) -> DataFrame:
    return df.orderBy(*order).limit(n)


def top_of_each(df: DataFrame, keys: list[str], n: int, *order: Column) -> DataFrame:
    """The first ``n`` rows of each group, numbered."""
    return df.withColumn("place", F.row_number().over(W.Window.partitionBy(*keys).orderBy(*order))).where(F.col("place") <= n)


def profile(works: DataFrame, key: str, listed: str, most: int = 5) -> DataFrame:
    """Totals of each entity with its first few distinct values of another column, for all entities at once."""
    names = top_of_each(works.select(key, listed).distinct(), [key], most, F.col(listed)).groupBy(key).agg(F.array_join(F.array_sort(F.collect_list(listed)), ",").alias("names"))
    totals = works.groupBy(key).agg(F.count("*").alias("works"), F.sum("recommended_amount").alias("amount"), F.avg("is_completed").alias("completion_rate"))
    return totals.join(names, key, "left")


def concentration(payments: DataFrame, by: str, vendor: str, amount: str, t: Thresholds = DEFAULT) -> DataFrame:
    """(by, payments, vendors, hhi, top_share, top3_share, effective_vendors, band, percentile), withheld below a floor.

    Usable rows have an authority, a vendor and an amount above 0.  The index is the sum of squared shares of amount.
    """
    usable = payments.where((F.trim(F.col(by)) != "") & F.col(vendor).isNotNull() & (F.col(amount) > 0))
    each = stored(usable.groupBy(by, vendor).agg(F.sum(amount).alias("paid"), F.count("*").alias("n")))
    first = top_of_each(each, [by], 3, F.desc("paid"), F.asc(vendor)).groupBy(by).agg(F.sum("paid").alias("_top3"))  # tasks keep three vendors an authority
    totals = each.groupBy(by).agg(
        F.sum("n").alias("payments"), F.count("*").alias("vendors"), (F.sum(F.col("paid") * F.col("paid")) / (F.sum("paid") * F.sum("paid"))).alias("_hhi"),
        (F.max("paid") / F.sum("paid")).alias("top_share"), F.sum("paid").alias("_paid"),
    )
    out = totals.join(first, by).withColumn("top3_share", F.col("_top3") / F.col("_paid"))
    out = stored(out.withColumn("hhi", F.when(F.col("payments") >= t.min_payments, F.col("_hhi"))).drop("_hhi", "_top3", "_paid"))
    band = F.when(F.col("hhi") >= 0.25, "CONCENTRATED").when(F.col("hhi") >= 0.15, "MODERATE").when(F.col("hhi").isNotNull(), "SPREAD")
    below = ranges(out, [], "hhi").select(F.col("_v").alias("_hhi"), ((F.col("_below") + F.col("_same") / 2) / F.col("_n")).alias("percentile"))
    out = out.join(below, F.col("hhi") == F.col("_hhi"), "left").drop("_hhi")
    return out.withColumns({"effective_vendors": 1 / F.col("hhi"), "band": band})


def distribution(df: DataFrame, value: str) -> DataFrame:
    """One row of least, quartiles, ninth decile and greatest, by linear interpolation."""
    at = {"least": 0.0, "p25": 0.25, "median": 0.5, "p75": 0.75, "p90": 0.9, "greatest": 1.0}
    return joined(df.agg(F.count(value).alias("scored")), [], quantiles(df, [], value, at))


def calibration(verifications: DataFrame, bands: DataFrame, key: str, confirms: list[str], t: Thresholds = DEFAULT) -> DataFrame:
    """(band, visits, confirmed, rate, low, high): latest verification of each key; no rate below a floor of visits."""
    latest = verifications.groupBy(key).agg(F.max_by("outcome", F.struct("created_at", "id")).alias("outcome"))
    placed = latest.join(bands.select(key, "band"), key, "left").withColumn("band", F.coalesce("band", F.lit("NOT SURFACED")))
    out = placed.groupBy("band").agg(F.count("*").alias("visits"), F.count_if(F.col("outcome").isin(*confirms)).alias("confirmed"))
    low, high = wilson("confirmed", "visits", t)
    enough = F.col("visits") >= t.visit_floor
    return out.withColumns({"rate": F.when(enough, F.col("confirmed") / F.col("visits")), "low": F.round(low, 3), "high": F.round(high, 3)})


def ageing(cases: DataFrame, due: str, as_of: Column, tier: str) -> DataFrame:
    """(tier, bucket, cases, oldest): days late in three buckets; cases not yet due are left out."""
    late = F.datediff(as_of, due)
    bucket = F.when(late <= 30, "1-30").when(late <= 90, "31-90").otherwise("over 90")
    return cases.where(late > 0).groupBy(tier, bucket.alias("bucket")).agg(F.count("*").alias("cases"), F.max(late).alias("oldest"))


def health_index(works: DataFrame, pairs: Column) -> DataFrame:
    """(part, weight, value, contribution): five rounded parts of an index between 0 and 1."""
    parts = [
        ("completion", 0.30, F.avg("is_completed")), ("no_flag", 0.25, share(F.col("checks_fired") == 0)), ("not_surfaced", 0.20, share(~F.col("band").isin("MEDIUM", "HIGH"))),
        ("unique", 0.15, 1 - F.least(F.lit(1.0), pairs / F.count("*"))), ("described", 0.10, share(F.col("work_description").isNotNull())),
    ]
    rows = F.array(*[F.struct(F.lit(n).alias("part"), F.lit(w).alias("weight"), F.round(v, 3).alias("value")) for n, w, v in parts])
    return works.agg(rows.alias("r")).select(F.inline("r")).withColumn("contribution", F.round(F.col("weight") * F.col("value"), 6))


def text_search(df: DataFrame, columns: list[str], terms: list[str], stop: frozenset[str] = frozenset({"the", "a", "of", "in", "and", "for"})) -> DataFrame:
    """Rows whose joined columns contain every term that isn't a stop word, in any case."""
    hay = F.lower(F.concat_ws(" ", *columns))
    for term in terms:
        if term.lower() not in stop:
            df = df.where(hay.contains(term.lower()))
    return df
