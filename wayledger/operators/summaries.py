"""Summaries of whole portfolios: totals, profiles, drill-downs, dossiers, readiness, coverage and reconciliation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import printed, share
from ..sources.tables import stored
from .quantiles import joined, quantiles
from .reports import significance, top_of_each

LEAD = ("MEDIUM", "HIGH")

# Least exposure of a tier with its days to the first review, and how a band stretches them.
TIERS = (("Ministry Review", 50_000_000, 7), ("State Nodal", 5_000_000, 14), ("District Monitoring", 0, 30))
STRETCH = (("HIGH", 1), ("MEDIUM", 2), ("LOW", 3))


def is_lead() -> Column:
    return F.col("band").isin(*LEAD)


def national(works: DataFrame) -> DataFrame:
    """One row: counts, sums, distinct entities and how many works are in each band."""
    bands = [F.count_if(F.col("band") == b).alias(f"band_{b.lower()}") for b in ("HIGH", "MEDIUM", "LOW", "NONE")]
    return works.agg(
        F.count("*").alias("works"), F.sum("is_completed").alias("completed"), F.sum("is_open").alias("open"), F.countDistinct("state_name").alias("states"),
        F.countDistinct("mp_id").alias("constituencies"), F.countDistinct("implementing_agency").alias("agencies"),
        F.sum("recommended_amount").alias("amount"), F.sum("exposure").alias("exposure"), F.count_if(is_lead()).alias("leads"), *bands,
    )


def archetypes(works: DataFrame, kind: str) -> DataFrame:
    """Profile of each kind of work: size, spread, typical amount and days, rates, exposure, commonest state.

    Works without a kind are left out; of equally common states the first by name counts.
    """
    known = works.where(F.col(kind).isNotNull()).withColumn("_days", F.when(F.col("is_completed") == 1, F.col("duration_days")))
    typical = joined(quantiles(known, [kind], "recommended_amount", {"median_amount": 0.5}), [kind], quantiles(known, [kind], "_days", {"median_days": 0.5}))
    counts = known.groupBy(kind).agg(
        F.count("*").alias("works"), F.countDistinct("state_name").alias("states"), F.countDistinct("implementing_agency").alias("agencies"),
        F.avg("is_completed").alias("completion_rate"), share(is_lead()).alias("lead_rate"), F.sum("exposure").alias("exposure"), F.mode("state_name", True).alias("top_state"),
    )
    return joined(counts, [kind], typical)


def pair_summary(pairs: DataFrame, concerning: DataFrame, owners: DataFrame, key: str, owner: str, text: str) -> DataFrame:
    """(part, name, pairs): all pairs, those of concern, by class, of one owner, and of the same text.

    ``pairs`` has (a, b, class); a missing owner or text is no match.
    """
    side = lambda x: owners.select(F.col(key).alias(x), F.col(owner).alias(f"owner_{x}"), F.col(text).alias(f"text_{x}"))
    both = pairs.join(side("a"), "a", "left").join(side("b"), "b", "left")
    totals = both.agg(F.count("*").alias("all"), F.count_if(F.col("owner_a") == F.col("owner_b")).alias("same_owner"), F.count_if(F.col("text_a") == F.col("text_b")).alias("same_text"))
    rows = F.inline(F.array(*[F.struct(F.lit("total").alias("part"), F.lit(c).alias("name"), F.col(c).alias("pairs")) for c in ("all", "same_owner", "same_text")]))
    of_class = pairs.groupBy("class").agg(F.count("*").alias("pairs")).select(F.lit("class").alias("part"), F.col("class").alias("name"), "pairs")
    return totals.select(rows).unionByName(of_class).unionByName(concerning.agg(F.lit("total").alias("part"), F.lit("concerning").alias("name"), F.count("*").alias("pairs")))


def with_total(works: DataFrame, key: str, total: str, floor: int) -> DataFrame:
    """Counts and rates of each value of ``key`` and, under the name ``total``, of all works, in one aggregation.

    Rates and exposure a work are null below ``floor`` works, except in the total.
    """
    out = works.rollup(key).agg(
        F.grouping(key).alias("_all"), F.count("*").alias("works"), F.count_if(F.col("band") == "HIGH").alias("high"), F.count_if(is_lead()).alias("leads"),
        F.sum("exposure").alias("exposure"), F.countDistinct("implementing_agency").alias("agencies"),
    )
    enough = lambda c: F.when((F.col("_all") == 1) | (F.col("works") >= floor), c / F.col("works"))
    rates = {"high_rate": enough(F.col("high")), "lead_rate": enough(F.col("leads")), "exposure_a_work": enough(F.col("exposure"))}
    return out.withColumns(rates).withColumn(key, F.when(F.col("_all") == 1, total).otherwise(F.col(key))).drop("_all")


def drill_down(works: DataFrame, keys: list[str], named: str, floor: int = 50) -> DataFrame:
    """Counts, rates (null below ``floor`` works) and the first work's ``named`` of each group."""
    out = works.groupBy(*keys).agg(
        F.count("*").alias("works"), F.count_if(F.col("band") == "HIGH").alias("high"), F.count_if(is_lead()).alias("leads"), F.sum("exposure").alias("exposure"),
        F.countDistinct("implementing_agency").alias("agencies"), F.min_by(named, F.when(F.col(named).isNotNull(), F.col("work_ref"))).alias("first_name"),
    )
    rate = lambda c: F.when(F.col("works") >= floor, F.col(c) / F.col("works"))
    return out.withColumns({"high_rate": rate("high"), "lead_rate": rate("leads"), "rate_withheld": F.col("works") < floor})


def dossiers(works: DataFrame, agency: str = "implementing_agency", leads: int = 8, categories: int = 5, floor: int = 30) -> DataFrame:
    """One row an agency, all at once: portfolio, completion and lead rates read against all works, first leads, main categories.

    ``leads`` and ``categories`` bound the two listed arrays; all counts cover every work.
    """
    done = significance(works, [agency], F.col("is_completed") == 1, floor).select(agency, F.col("rate").alias("completion_rate"), F.col("reading").alias("completion_reading"))
    lead = significance(works, [agency], is_lead(), floor).select(agency, F.col("hits").alias("leads"), F.col("rate").alias("lead_rate"), F.col("reading").alias("lead_reading"))
    totals = works.groupBy(agency).agg(F.count("*").alias("works"), F.sum("recommended_amount").alias("amount"), F.sum("exposure").alias("exposure"), F.count_if(F.col("is_open") == 1).alias("open"))
    first = top_of_each(works.where(is_lead()), [agency], leads, F.desc("audit_roi"), F.asc("work_ref"))
    first = first.groupBy(agency).agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "work_ref"))), lambda x: x.work_ref).alias("first_leads"))
    kinds = works.groupBy(agency, "activity_category").agg(F.count("*").alias("n"))
    kinds = top_of_each(kinds, [agency], categories, F.desc("n"), F.asc("activity_category"))
    kinds = kinds.groupBy(agency).agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "activity_category", "n"))), lambda x: F.struct(x.activity_category.alias("category"), x.n.alias("works"))).alias("categories"))
    return totals.join(done, agency).join(lead, agency).join(first, agency, "left").join(kinds, agency, "left")


def label_readiness(visits: DataFrame, confirms: list[str], target: int = 500) -> DataFrame:
    """One row: visits that are no demonstration, works among them, concerns confirmed, and how many labels are missing."""
    real = ~F.coalesce(F.col("demo"), F.lit(False))
    out = visits.agg(
        F.count_if(real).alias("visits"), F.countDistinct(F.when(real, F.col("work"))).alias("works"), F.count_if(~real).alias("demo_excluded"),
        F.count_if(real & F.col("outcome").isin(*confirms)).alias("confirmed"),
    )
    return out.withColumns({"labels_needed": F.greatest(F.lit(0), F.lit(target) - F.col("visits")), "ready": F.col("visits") >= target})


def escalated(works: DataFrame, as_of: Column, exposure: str = "exposure") -> DataFrame:
    """Adds ``tier`` by exposure (missing counts as 0) and ``review_due``: the tier's days, stretched by the band, after ``as_of``."""
    amount = F.coalesce(F.col(exposure), F.lit(0))
    tier, days, times = F.lit(TIERS[-1][0]), F.lit(TIERS[-1][2]), F.lit(2)
    for name, least, wait in reversed(TIERS):
        tier, days = F.when(amount >= least, name).otherwise(tier), F.when(amount >= least, wait).otherwise(days)
    for band, by in STRETCH:
        times = F.when(F.col("band") == band, by).otherwise(times)
    return works.withColumns({"tier": tier, "review_due": F.date_add(as_of, days * times)})


def case_overview(cases: DataFrame, first_states: int = 10) -> DataFrame:
    """(part, name, cases, exposure): cases by tier, by band, and of the states of most exposure."""
    by = lambda c: cases.groupBy(F.col(c).alias("name")).agg(F.count("*").alias("cases"), F.sum("exposure").alias("exposure"))
    states = by("state_name").orderBy(F.desc("exposure"), "name").limit(first_states)
    parts = [by("tier").withColumn("part", F.lit("tier")), by("band").withColumn("part", F.lit("band")), states.withColumn("part", F.lit("state"))]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).select("part", "name", "cases", "exposure")


def actions() -> Column:
    """What an officer can do, in order, by the signals that fired; the last one always applies."""
    steps = [
        (F.col("sig_duplicate") > 0, "COMPARE_RECORDS"), (F.col("checks_fired") > 0, "REVIEW_LIFECYCLE"), (F.col("sig_amount") > 0, "COMPARE_ESTIMATE"),
        (F.col("warning_level").isin("HIGH", "CRITICAL"), "REQUEST_PROGRESS"), (F.lit(True), "VERIFY_EVIDENCE"),
    ]
    return F.array_compact(F.array(*[F.when(when, name) for when, name in steps]))


def warning_reason() -> Column:
    """Why an open work has its warning level, with numbers by their exact value; ties of the last digit go to the even one."""
    ratio, risk = F.col("stall_ratio"), F.col("risk")
    slow = F.when(ratio >= 1.2, F.concat(F.lit("open "), printed(ratio, 1), F.lit(" times as long as usual in "), F.col("state_name")))
    late = F.when(risk >= 0.4, F.concat(F.lit("risk of "), F.rint(risk * 100).cast("long"), F.lit(" % not to be done in time")))
    said = F.concat_ws("; ", slow, late)
    return F.when(F.col("is_open") != 1, "completed").when(said == "", "in its usual range").otherwise(F.concat("warning_level", F.lit(": "), said))


def equal_content(files: DataFrame, digest: str, owner: str, most: int = 200) -> DataFrame:
    """(digest, owners, files, first_owner, last_owner): contents held by several owners, the ``most`` widest spread of them."""
    out = files.where(F.col(digest).isNotNull()).groupBy(digest).agg(F.countDistinct(owner).alias("owners"), F.count("*").alias("files"), F.min(owner).alias("first_owner"), F.max(owner).alias("last_owner"))
    return out.where("owners > 1").orderBy(F.desc("owners"), F.desc("files"), digest).limit(most)


def coverage(files: DataFrame, kind: str, digest: str, size: str) -> DataFrame:
    """(kind, entries, with_content, contents, duplicates, bytes): what each kind of file holds; duplicates repeat a content."""
    out = files.groupBy(kind).agg(F.count("*").alias("entries"), F.count(digest).alias("with_content"), F.countDistinct(digest).alias("contents"), F.sum(size).alias("bytes"))
    return out.withColumn("duplicates", F.col("with_content") - F.col("contents"))


def per_owner(items: DataFrame, owner: str, value: str) -> DataFrame:
    """One row: owners, their mean and most items, and the mean and median of their summed values."""
    each = stored(items.groupBy(owner).agg(F.count("*").alias("n"), F.sum(value).alias("v")))
    one = each.agg(F.count("*").alias("owners"), F.avg("n").alias("mean_items"), F.max("n").alias("most_items"), F.avg("v").alias("mean_value"))
    return joined(one, [], quantiles(each, [], "v", {"median_value": 0.5}))


def ingest_report(works: DataFrame, flags: list[str]) -> DataFrame:
    """(section, reason, count): all rows, those without a flag, and how many each flag marks."""
    clean = ~F.greatest(*[F.coalesce(F.col(c).cast("boolean"), F.lit(False)) for c in flags])
    counts = [("rows", "all", F.count("*")), ("rows", "clean", F.count_if(clean)), *[("flagged", c, F.count_if(F.col(c).cast("boolean"))) for c in flags]]
    names = [F.struct(F.lit(s).alias("section"), F.lit(n).alias("reason"), v.alias("count")) for s, n, v in counts]
    return works.agg(F.array(*names).alias("r")).select(F.inline("r"))


def live_status(feed: DataFrame, key: str, at: str) -> DataFrame:
    """One row: entries, keys, last entry, entries of the day up to it, and the key's last check that lies longest back."""
    last = feed.select(F.max(at)).scalar()
    each = feed.withColumn("_day", F.col(at) > last - F.expr("INTERVAL 24 HOURS")).groupBy(key).agg(F.count("*").alias("n"), F.max(at).alias("last"), F.count_if("_day").alias("day"))
    return each.agg(F.sum("n").alias("entries"), F.count("*").alias("keys"), F.max("last").alias("last_entry"), F.min("last").alias("oldest_check"), F.sum("day").alias("last_day"))


def three_way(own: DataFrame, totals: DataFrame, tiles: DataFrame, keys: list[str]) -> DataFrame:
    """Our rows against the server's grand total and the published tile, by scope.

    ``own`` has (keys, own_count, own_sum), ``totals`` (keys, grand_total), ``tiles`` (keys, tile_count, tile_amount); a scope
    is listed if any has it.  A check that lacks a side is null, neither passed nor failed; sums may be off by less than
    0.01, rounded tiles by less than 1.
    """
    out = own.join(totals, keys, "full").join(tiles, keys, "full")
    out = out.withColumns({"sum_delta": F.round(F.col("own_sum") - F.col("grand_total"), 2), "tile_delta": F.round(F.col("grand_total") - F.col("tile_amount"), 2), "count_delta": F.col("own_count") - F.col("tile_count")})
    checks = {"sum_matches": F.abs("sum_delta") < 0.01, "total_matches_tile": F.abs("tile_delta") < 1, "count_matches_tile": F.col("count_delta") == 0}
    return out.withColumns(checks)


def mismatches(found: DataFrame) -> DataFrame:
    """Only scopes of which some check failed, with how many did."""
    failed = sum((F.coalesce((~F.col(c)).cast("int"), F.lit(0)) for c in ("sum_matches", "total_matches_tile", "count_matches_tile")), F.lit(0))
    return found.withColumn("failed", failed).where("failed > 0")
