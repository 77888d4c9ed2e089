"""Signals, their fusion to a priority, rule checks, early warning and the documents that explain a lead."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W

from ..config import DEFAULT, Thresholds
from ..functions.columns import clipped, money
from .ordering import ranked
from .quantiles import joined, quantiles

CHECKS = (
    ("orphan", "HIGH"), ("backdated", "HIGH"), ("future_dated", "MEDIUM"), ("no_sanction", "HIGH"),
    ("nonpositive", "MEDIUM"), ("no_text", "LOW"), ("stalled", "MEDIUM"), ("amount", "MEDIUM"),
)
RANK = {"LOW": 1, "MEDIUM": 2, "HIGH": 3}


def signals(t: Thresholds = DEFAULT) -> dict[str, Column]:
    """Seven gated signals between 0 and 1 over amount_pct, amount_z, open_pct, risk, flags, change, outlier and similarity."""
    c, none = F.col, F.lit(0.0)
    flags = sum((c(x).cast("double") for x in ("is_backdated", "completed_without_sanction", "is_future_dated", "is_orphan")), none)
    return {
        "amount": F.when(c("amount_pct") >= t.extreme_percentile, 1 / (1 + F.exp(-clipped(c("amount_z") - 2, -6.0, 6.0)))).otherwise(none),
        "duration": F.when(c("open_pct") >= t.extreme_percentile, c("open_pct")).otherwise(none),
        "risk": F.when(c("risk") >= t.risk_gate, c("risk")).otherwise(none),
        "conformance": 0.9 * F.least(F.lit(1.0), flags),
        "change": F.coalesce(c("change"), none),
        "anomaly": F.coalesce(c("outlier").cast("double"), none),
        "duplicate": F.when(c("similarity") >= t.duplicate_gate, c("similarity")).otherwise(none),
    }


def fused(works: DataFrame, t: Thresholds = DEFAULT) -> DataFrame:
    """``priority`` by noisy-or of weighted signals, ``families`` that any signal supports, band, exposure and return."""
    out = works.withColumns({f"sig_{k}": v for k, v in signals(t).items()})
    quiet = reduce(lambda a, b: a * b, [1 - w * F.col(f"sig_{k}") for k, w in t.weights])
    hits = [reduce(lambda a, b: a | b, [F.col(f"sig_{s}") > 0 for s in members]).cast("int") for _, members in t.families]
    out = out.withColumns({"priority": 1 - quiet, "families": sum(hits, F.lit(0))})
    band = F.when(F.col("families") >= 3, "HIGH").when(F.col("families") == 2, "MEDIUM").when(F.col("families") == 1, "LOW").otherwise("NONE")
    exposure = F.coalesce("recommended_amount", F.lit(0.0)) * clipped(F.coalesce("risk", F.lit(0.0)), 0.0, 1.0)
    out = out.withColumns({"band": band, "exposure": exposure})
    return out.withColumn("audit_roi", F.col("priority") * F.col("exposure") * (1 + F.col("families")))


def checks(t: Thresholds = DEFAULT) -> dict[str, Column]:
    no = lambda x: F.coalesce(x, F.lit(False))
    return {
        "orphan": no(F.col("is_orphan")),
        "backdated": no(F.col("is_backdated")),
        "future_dated": no(F.col("is_future_dated")),
        "no_sanction": no(F.col("completed_without_sanction")),
        "nonpositive": no(F.col("has_nonpositive_amount")),
        "no_text": no(F.col("work_description").isNull()),
        "stalled": no((F.col("is_open") == 1) & (F.col("open_pct") >= t.rule_percentile)),
        "amount": no(F.col("amount_pct") >= t.rule_percentile),
    }


def ruled(works: DataFrame, t: Thresholds = DEFAULT) -> DataFrame:
    """``chk_*``, their number, the worst severity and ``findings``, an array of the checks that fired."""
    out = works.withColumns({f"chk_{k}": v for k, v in checks(t).items()})
    fired = [F.col(f"chk_{k}") for k, _ in CHECKS]
    worst = F.greatest(*[F.when(f, RANK[s]).otherwise(0) for f, (_, s) in zip(fired, CHECKS)])
    severity = F.when(worst == 3, "HIGH").when(worst == 2, "MEDIUM").when(worst == 1, "LOW").otherwise("NONE")
    all_ = F.array(*[F.struct(F.lit(k).alias("check"), F.lit(s).alias("severity"), f.alias("hit")) for f, (k, s) in zip(fired, CHECKS)])
    return out.withColumns({"checks_fired": sum((f.cast("int") for f in fired), F.lit(0)), "severity": severity, "findings": F.filter(all_, lambda x: x.hit)})


def rule_summary(works: DataFrame, t: Thresholds = DEFAULT) -> DataFrame:
    """(check, fired, share) of each check and of any, from one pass."""
    each = checks(t)
    named = [*each.items(), ("any", reduce(lambda a, b: a | b, each.values()))]
    one = works.agg(F.count("*").alias("n"), *[F.count_if(c).alias(k) for k, c in named])
    return one.select("n", F.stack(F.lit(len(named)), *[x for k, _ in named for x in (F.lit(k), F.col(k))]).alias("check", "fired")).select("check", "fired", F.when(F.col("n") > 0, F.col("fired") / F.col("n")).alias("share"))


def early_warning(works: DataFrame, peer: list[str], t: Thresholds = DEFAULT) -> DataFrame:
    """``stall_ratio`` against the median of completed peers, ``warning`` (0.6 risk + 0.4 stall / 3) and its level.

    The medians are of whole days, so a group's buffer has a count for each of some thousand days at most.
    """
    done = works.where("is_event = 1 and duration_days is not null")
    medians = done.groupBy(*peer).agg(F.percentile("duration_days", 0.5).alias("_median"))
    overall = done.select(F.percentile("duration_days", 0.5)).scalar()
    default = F.coalesce(F.when(overall != 0, overall), F.lit(float(t.stall_default_days)))
    out = works.join(medians, peer, "left").withColumn("_median", F.coalesce("_median", default))
    is_open = F.col("is_open") == 1
    out = out.withColumn("stall_ratio", F.when(is_open, F.col("duration_days") / F.greatest("_median", F.lit(float(t.stall_floor_days))))).drop("_median")
    score = 0.6 * F.coalesce("risk", F.lit(0.0)) + 0.4 * clipped(F.coalesce("stall_ratio", F.lit(0.0)) / 3, 0.0, 1.0)
    out = out.withColumn("warning", F.when(is_open, score).otherwise(0.0))
    level = F.when((F.col("warning") >= 0.75) & (F.col("stall_ratio") >= 2), "CRITICAL").when(F.col("warning") >= 0.60, "HIGH").when(F.col("warning") >= 0.40, "MEDIUM").otherwise("LOW")
    return out.withColumn("warning_level", level)


def change_points(works: DataFrame, entity: str, year: Column, value: str, t: Thresholds = DEFAULT) -> DataFrame:
    """(entity, change, from_year, to_year, before, after): the largest relative step between medians of kept years.

    Years with fewer rows than the floor are left out, steps may span them; a step counts above ``change_shift``, at most
    1, and of equal ones the earliest is named.
    """
    dated = works.withColumn("year", year)
    yearly = dated.groupBy(entity, "year").agg(F.count("*").alias("n")).where(F.col("n") >= t.change_min_rows)
    yearly = joined(yearly, [entity, "year"], quantiles(dated, [entity, "year"], value, {"median": 0.5}))
    by = W.Window.partitionBy(entity).orderBy("year")
    steps = yearly.withColumns({"before": F.lag("median").over(by), "from_year": F.lag("year").over(by)}).where("before is not null")
    steps = steps.withColumn("step", F.abs(F.col("median") - F.col("before")) / (F.col("before") + 1e-9))
    best = steps.groupBy(entity).agg(F.max_by(F.struct("step", "from_year", F.col("year").alias("to_year"), "before", F.col("median").alias("after")), F.struct("step", -F.col("year"))).alias("b"))
    return best.select(entity, F.when(F.col("b.step") > t.change_shift, F.least(F.col("b.step"), F.lit(1.0))).otherwise(0.0).alias("change"), "b.from_year", "b.to_year", "b.before", "b.after")


def evidence() -> Column:
    """An array of (signal, detail) for the signals above 0, in order of the fusion's families."""
    text = {
        "amount": F.format_string("amount at percentile %.3f of its peers", "amount_pct"),
        "duration": F.format_string("open longer than %.3f of its peers", "open_pct"),
        "risk": F.format_string("risk %.2f", "risk"),
        "conformance": F.lit("dates or stages don't fit together"),
        "change": F.format_string("step of %.2f between years", "change"),
        "anomaly": F.lit("unusual in several features"),
        "duplicate": F.format_string("similarity %.4f to another", "similarity"),
    }
    return F.array_compact(F.array(*[F.when(F.col(f"sig_{k}") > 0, F.struct(F.lit(k).alias("signal"), v.alias("detail"))) for k, v in text.items()]))


def recommended() -> Column:
    """The next step, by precedence."""
    return (
        F.when(F.col("sig_duplicate") > 0, "COMPARE_RECORDS").when(F.col("sig_conformance") > 0, "CHECK_DOCUMENTS").when(F.col("sig_amount") > 0, "CHECK_ESTIMATE")
        .when((F.col("sig_duration") > 0) | (F.col("sig_risk") > 0), "VISIT_SITE").otherwise("NONE")
    )


def case_files(works: DataFrame, key: str = "work_ref") -> DataFrame:
    """Leads (bands MEDIUM and HIGH) as nested documents with their rank by return."""
    leads = ranked(works.where(F.col("band").isin("MEDIUM", "HIGH")), "rank", F.desc("audit_roi"), F.asc(key))
    return leads.select(
        key, "rank", "band", F.struct("priority", "exposure", "audit_roi", "families").alias("scores"), money("recommended_amount").alias("amount_text"),
        evidence().alias("evidence"), "findings", recommended().alias("next_step"),
    )


def worklist(works: DataFrame, bands: tuple[str, ...] = ("MEDIUM", "HIGH"), where: Column | None = None, offset: int = 0, limit: int | None = None, key: str = "work_ref") -> DataFrame:
    """Leads by return, ties by key, in pages."""
    out = works.where(F.col("band").isin(*bands))
    out = (out if where is None else out.where(where)).orderBy(F.desc("audit_roi"), key)
    out = out.offset(offset) if offset else out
    return out if limit is None else out.limit(limit)
