"""Reports on casework, payments, files and checks: what is late, what a scope holds, what was moved or left out, and what is stale."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import DEFAULT, Thresholds
from ..sources.tables import stored
from .ordering import ranked
from .pages import holds
from .quantiles import joined, quantiles
from .reports import top_of_each
from .signals import evidence
from .summaries import equal_content, is_lead


def worklist(works: DataFrame, equal: dict[str, str] | None = None, signal: str | None = None, part: str | None = None, texts: tuple[str, ...] = ("work_description", "implementing_agency")) -> DataFrame:
    """The leads that have the ``equal`` values, a ``signal`` among those that fired and ``part`` in one of ``texts``.

    A null value equals nothing and a null text holds nothing; what is not asked for doesn't filter.
    """
    out = reduce(lambda d, kv: d.where(F.col(kv[0]) == kv[1]), (equal or {}).items(), works.where(is_lead()))
    if signal:
        out = out.where(F.exists(evidence(), lambda x: x.signal == signal))
    return out.where(reduce(lambda a, b: a | b, [holds(c, part) for c in texts])) if part else out


def scope_totals(works: DataFrame, scope: str) -> DataFrame:
    """(scope, leads, exposure, high, medium) of the leads in each value of ``scope``, for all scopes at once.

    A scope without leads is listed with zeros; works of no scope are their own row.
    """
    of = lambda band: F.count_if(F.col("band") == band)
    return works.groupBy(scope).agg(F.count_if(is_lead()).alias("leads"), F.coalesce(F.sum(F.when(is_lead(), F.col("exposure"))), F.lit(0.0)).alias("exposure"), of("HIGH").alias("high"), of("MEDIUM").alias("medium"))


def baselines(works: DataFrame) -> DataFrame:
    """One row of what every group is read against: works, surfaced_rate, open_rate, median_amount; no works give rates of 0."""
    rate = lambda c: F.coalesce(F.avg(c.cast("int")), F.lit(0.0))
    one = works.agg(F.count("*").alias("works"), rate(is_lead()).alias("surfaced_rate"), rate(F.col("is_open")).alias("open_rate"))
    return joined(one, [], quantiles(works, [], "recommended_amount", {"median_amount": 0.5})).withColumn("median_amount", F.coalesce("median_amount", F.lit(0.0)))


def band_ordering(rates: DataFrame, bands: tuple[str, ...]) -> DataFrame:
    """(reportable, testable, holds, separated): whether rates fall in the order of ``bands``, and whether intervals part them.

    ``rates`` has (band, rate, low, high), a row a band; bands without a rate are left out.  Equal rates (to three digits)
    hold, and intervals that touch don't part.  Fewer than two rates test nothing: both answers are null then.
    """
    at = F.array_position(F.array(*[F.lit(b) for b in bands]), F.col("band"))
    few = rates.where(F.col("rate").isNotNull() & (at > 0)).select(F.struct(at.alias("at"), F.round("rate", 3).alias("rate"), "low", "high").alias("b"))
    n, r = F.col("reportable"), F.col("_r")
    each = lambda test: F.when(n >= 2, F.forall(F.sequence(F.lit(1), n - 1), lambda i: test(F.get(r, i - 1), F.get(r, i))))
    out = few.agg(F.array_sort(F.collect_list("b")).alias("_r")).withColumn("reportable", F.size("_r"))
    return out.select("reportable", (n >= 2).alias("testable"), each(lambda a, b: a.rate >= b.rate).alias("holds"), each(lambda a, b: a.low > b.high).alias("separated"))


def outcome_counts(visits: DataFrame, outcome: str, work: str, demo: str) -> DataFrame:
    """(outcome, visits, works, demo_excluded): demonstrations are counted apart; an outcome with nothing else has 0 visits."""
    real = ~F.coalesce(F.col(demo), F.lit(False))
    return visits.groupBy(F.col(outcome).alias("outcome")).agg(F.count_if(real).alias("visits"), F.countDistinct(F.when(real, F.col(work))).alias("works"), F.count_if(~real).alias("demo_excluded"))


def lateness(cases: DataFrame, stages: tuple[str, ...], as_of: Column, stage: str = "stage", due: str = "review_due", moved: str = "moved_at", exposure: str = "exposure") -> DataFrame:
    """One row: cases, open ones, late ones with their exposure, those never picked up, the longest delay, and how to read it.

    Late is an open case past its date; never picked up is one that was not moved since it was loaded, late or not.  A case
    without a date is never late.
    """
    open_ = F.coalesce(F.col(stage).isin(*stages), F.lit(False))
    days = F.datediff(as_of, due)
    late = open_ & F.coalesce(days > 0, F.lit(False))
    out = cases.agg(
        F.count("*").alias("cases"), F.count_if(open_).alias("open_cases"), F.count_if(late).alias("late"), F.coalesce(F.sum(F.when(late, F.col(exposure))), F.lit(0.0)).alias("late_exposure"),
        F.count_if(open_ & F.col(moved).isNull()).alias("never_picked_up"), F.coalesce(F.max(F.when(late, days)), F.lit(0)).alias("oldest"),
    )
    first_day = (F.col("open_cases") > 0) & (F.col("never_picked_up") == F.col("open_cases"))
    return out.withColumn("reading", F.when(first_day, "first day").when(F.col("late") == 0, "none late").otherwise("late"))


def stage_table(cases: DataFrame, stages: tuple[str, ...], stage: str = "stage", exposure: str = "exposure") -> DataFrame:
    """(stage, place, cases, exposure) of all ``stages`` in their order, those without a case too; other stages come last, as one."""
    known = F.when(F.col(stage).isin(*stages), F.col(stage)).otherwise("OTHER")
    found = cases.groupBy(known.alias("stage")).agg(F.count("*").alias("cases"), F.sum(exposure).alias("exposure"))
    names = F.array(*[F.struct(F.lit(s).alias("stage"), F.lit(i).alias("place")) for i, s in enumerate((*stages, "OTHER"), 1)])
    listed = cases.sparkSession.range(1).select(F.inline(names))
    return listed.join(found, "stage", "left").withColumns({"cases": F.coalesce("cases", F.lit(0)), "exposure": F.coalesce("exposure", F.lit(0.0))})


def unusable(payments: DataFrame, by: str, vendor: str, amount: str) -> DataFrame:
    """(reason, payments, amount): payments that an index of concentration can use, and the others by the first reason against them."""
    why = F.when(F.coalesce(F.trim(F.col(by)) == "", F.lit(True)), "no authority").when(F.col(vendor).isNull(), "no vendor").when(F.coalesce(F.col(amount) <= 0, F.lit(True)), "no amount").otherwise("usable")
    return payments.groupBy(why.alias("reason")).agg(F.count("*").alias("payments"), F.coalesce(F.sum(amount), F.lit(0.0)).alias("amount"))


def vendor_lists(payments: DataFrame, by: str, vendor: str, amount: str, most: int = 10, t: Thresholds = DEFAULT) -> DataFrame:
    """(by, payments, vendors, paid, top_vendor, listed, withheld): the ``most`` paid vendors of each authority with their shares.

    All vendors count in the totals.  Only each task's first few vendors of an authority are shuffled.  ``withheld`` says
    why an authority has no index, and is null where it has one.
    """
    usable = payments.where((F.trim(F.col(by)) != "") & F.col(vendor).isNotNull() & (F.col(amount) > 0))
    each = stored(usable.groupBy(by, vendor).agg(F.sum(amount).alias("paid"), F.count("*").alias("n")))
    totals = each.groupBy(by).agg(F.sum("n").alias("payments"), F.count("*").alias("vendors"), F.sum("paid").alias("_all"))
    first = top_of_each(each, [by], most, F.desc("paid"), F.asc(vendor)).join(totals.select(by, "_all"), by)
    rows = F.array_sort(F.collect_list(F.struct("place", F.col(vendor).alias("vendor"), "paid", (F.col("paid") / F.col("_all")).alias("share"))))
    withheld = F.when(F.col("payments") < t.min_payments, F.concat(F.lit("only "), "payments", F.lit(" payments")))
    out = totals.join(first.groupBy(by).agg(rows.alias("listed")), by)
    return out.select(by, "payments", "vendors", F.col("_all").alias("paid"), F.get("listed", F.lit(0)).vendor.alias("top_vendor"), "listed", withheld.alias("withheld"))


def band_counts(concentrated: DataFrame, bands: tuple[str, ...] = ("CONCENTRATED", "MODERATE", "SPREAD")) -> DataFrame:
    """(band, authorities, payments) of every band, empty ones too, and of the authorities without an index as ``WITHHELD``."""
    found = concentrated.groupBy(F.coalesce("band", F.lit("WITHHELD")).alias("band")).agg(F.count("*").alias("authorities"), F.sum("payments").alias("payments"))
    listed = concentrated.sparkSession.range(1).select(F.explode(F.array(*[F.lit(b) for b in (*bands, "WITHHELD")])).alias("band"))
    return listed.join(found, "band", "left").na.fill(0, ["authorities", "payments"])


def file_manifest(rows: DataFrame, file: str, key: str, attachment: str, state: str, listed: int = 5) -> DataFrame:
    """(file, rows, ids, with_attachment, states, first_states) of each file that was read; empty keys and attachments (0 too) are none."""
    filled = lambda c: F.when(~F.trim(F.col(c).cast("string")).isin("", "0"), F.col(c))
    has_id = F.when(F.trim(F.col(key).cast("string")) != "", F.col(key))
    out = rows.groupBy(file).agg(F.count("*").alias("rows"), F.countDistinct(has_id).alias("ids"), F.countDistinct(F.when(filled(attachment).isNotNull(), has_id)).alias("with_attachment"), F.countDistinct(F.when(F.col(state) != "", F.col(state))).alias("states"))
    names = top_of_each(rows.where(F.col(state) != "").select(file, state).distinct(), [file], listed, F.asc(state))
    return joined(out, [file], names.groupBy(file).agg(F.array_sort(F.collect_list(state)).alias("first_states")))


def evidence_coverage(works: DataFrame, files: DataFrame, key: str, digest: str, size: str) -> DataFrame:
    """One row: works, those with files and their share, files, indexed ones and their share, contents, bytes, files of unknown works.

    ``files`` has a row a file; an indexed one has a digest.  Keys that repeat among works count once.
    """
    known = works.where(F.col(key).isNotNull()).select(key).distinct().withColumn("_w", F.lit(1))
    own = files.groupBy(key).agg(F.count("*").alias("_f"), F.count(digest).alias("_i"), F.sum(size).alias("_b"))
    both = known.join(own, key, "full")
    one = both.agg(
        F.count("_w").alias("works"), F.count_if(F.col("_w").isNotNull() & F.col("_f").isNotNull()).alias("with_files"), F.coalesce(F.sum("_f"), F.lit(0)).alias("files"),
        F.coalesce(F.sum("_i"), F.lit(0)).alias("indexed"), F.coalesce(F.sum("_b"), F.lit(0)).alias("bytes"), F.coalesce(F.sum(F.when(F.col("_w").isNull(), F.col("_f"))), F.lit(0)).alias("of_unknown_works"),
    )
    out = joined(one, [], files.agg(F.countDistinct(digest).alias("contents")))
    part = lambda a, b: F.when(F.col(b) > 0, F.col(a) / F.col(b))
    return out.withColumns({"covered": part("with_files", "works"), "indexed_share": part("indexed", "files")})


def shared_contents(files: DataFrame, digest: str, owner: str, most: int = 200, listed: int = 10) -> DataFrame:
    """(digest, owners, files, listed): the ``most`` widest spread contents, each with its first owners by name.

    Every owner counts; the list alone is bounded.
    """
    widest = stored(equal_content(files, digest, owner, most).select(digest, "owners", "files"))
    names = files.join(F.broadcast(widest.select(digest)), digest).select(digest, owner).where(F.col(owner).isNotNull()).distinct()  # ``most`` rows
    names = top_of_each(names, [digest], listed, F.asc(owner)).groupBy(digest).agg(F.array_sort(F.collect_list(owner)).alias("listed"))
    return widest.join(names, digest)


def table_counts(tables: dict[str, tuple[DataFrame, str]]) -> DataFrame:
    """(table, rows, last): how many rows each table has and the greatest of its moments, as text; an empty one has 0 and null."""
    parts = [df.agg(F.lit(name).alias("table"), F.count("*").alias("rows"), F.max(at).cast("string").alias("last")) for name, (df, at) in tables.items()]
    return reduce(lambda a, b: a.unionByName(b), parts)


def grain_report(raw: DataFrame, key: str, summary: Column) -> DataFrame:
    """(section, reason, count): what became of all raw rows on the way to one row a work.

    Summary rows and rows without a key leave the grain, others of a key collapse into one: raw = the three + works.
    """
    is_summary = F.coalesce(summary, F.lit(False))
    each = raw.groupBy(key).agg(F.count("*").alias("n"), F.count_if(is_summary).alias("s")).withColumn("r", F.col("n") - F.col("s"))
    work = F.col(key).isNotNull() & (F.col("r") > 0)
    sums = [
        ("rows", "raw", F.sum("n")), ("moved", "summary rows", F.sum("s")), ("moved", "rows without a key", F.sum(F.when(F.col(key).isNull(), F.col("r")))),
        ("moved", "collapsed into one row a work", F.sum(F.when(work, F.col("r") - 1))), ("rows", "works", F.count_if(work)),
    ]
    rows = F.array(*[F.struct(F.lit(s).alias("section"), F.lit(x).alias("reason"), F.coalesce(v, F.lit(0)).alias("count")) for s, x, v in sums])
    return each.agg(rows.alias("r")).select(F.inline("r"))


def scope_freshness(checks: DataFrame, scope: str, at: str, as_of: Column) -> DataFrame:
    """(scope, checks, seconds, place): how long ago each scope was last checked, the longest wait first, ties by scope.

    A scope whose checks have no moment was never checked: it has no seconds and comes first.
    """
    each = checks.groupBy(scope).agg(F.count("*").alias("checks"), F.max(at).alias("_last"))
    d = each.withColumn("seconds", F.unix_timestamp(as_of.cast("timestamp")) - F.unix_timestamp(F.col("_last").cast("timestamp"))).drop("_last")
    return ranked(d, "place", F.desc_nulls_first("seconds"), F.asc(scope))


def activity(records: DataFrame, outcome: str, work: str, at: str) -> DataFrame:
    """(outcome, records, works, first_at, last_at, last_work) of what people recorded; of one moment the greatest work is the last."""
    return records.groupBy(outcome).agg(
        F.count("*").alias("records"), F.countDistinct(work).alias("works"), F.min(at).alias("first_at"), F.max(at).alias("last_at"),
        F.max_by(work, F.when(F.col(at).isNotNull(), F.struct(at, work))).alias("last_work"),
    )


def ratio_summary(reconciled: DataFrame, within: float = 0.001) -> DataFrame:
    """One row over ``canonical.reconciled``: keys, those with a ratio, the median ratio and the share of them within ``within`` of 1."""
    near = F.abs(F.col("ratio") - 1) <= within
    one = reconciled.agg(F.count("*").alias("keys"), F.count("ratio").alias("compared"), F.avg(near.cast("int")).alias("share_within"))
    return joined(one, [], quantiles(reconciled, [], "ratio", {"median_ratio": 0.5}))


def placed(groups: DataFrame, *keys: str) -> DataFrame:
    """Groups of a drill-down with ``place``: by lead rate, those whose rate is withheld last, then by exposure, then by ``keys``."""
    return ranked(groups, "place", F.desc_nulls_last("lead_rate"), F.desc_nulls_last("exposure"), *[F.asc(k) for k in keys])


def first_states(works: DataFrame, agency: str = "implementing_agency", most: int = 40) -> DataFrame:
    """(agency, works, amount, exposure, state): the agencies with most works, each with the state of its first work by key."""
    out = works.where(F.col(agency).isNotNull()).groupBy(agency).agg(
        F.count("*").alias("works"), F.sum("recommended_amount").alias("amount"), F.sum("exposure").alias("exposure"), F.min_by("state_name", F.when(F.col("state_name").isNotNull(), F.col("work_ref"))).alias("state"),
    )
    return out.orderBy(F.desc("works"), F.desc("exposure"), F.asc(agency)).limit(most)
