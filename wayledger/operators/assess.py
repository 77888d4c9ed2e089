"""A batch of submissions judged stage by stage against scored works."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import DEFAULT, Thresholds


def matched_amount(read: Column, known: Column, share: float = 0.01, least: float = 1.0) -> Column:
    """Whether an amount that was read agrees with the known one, to 1 % or one rupee; null if either is missing."""
    return F.abs(read - known) <= F.greatest(known * share, F.lit(least))


def assessed(submissions: DataFrame, works: DataFrame, key: str, amount: str, t: Thresholds = DEFAULT) -> DataFrame:
    """Submissions with ``stages``, an array of (stage, status), and ``status``, the worst of them.

    A submission that matches no work stops at its identity; stages whose facts are missing are UNKNOWN.
    """
    facts = works.select(key, F.col("recommended_amount").alias("_known"), "amount_pct", "checks_fired", "risk", "similarity")
    d = submissions.join(facts, key, "left")
    found = F.col("_known").isNotNull()
    check = lambda bad: F.when(~found, "SKIPPED").when(bad.isNull(), "UNKNOWN").when(bad, "CHECK").otherwise("OK")
    stages = [
        ("identity", F.when(found, "OK").otherwise("REJECT")), ("amount", check(~matched_amount(F.col(amount), F.col("_known")))),
        ("peers", check(F.col("amount_pct") >= t.extreme_percentile)), ("findings", check(F.col("checks_fired") > 0)),
        ("risk", check(F.col("risk") >= t.risk_gate)), ("duplicate", check(F.coalesce(F.col("similarity"), F.lit(0.0)) >= t.duplicate_gate)),
    ]
    d = d.withColumn("stages", F.array(*[F.struct(F.lit(n).alias("stage"), s.alias("status")) for n, s in stages]))
    has = lambda status: F.exists("stages", lambda x: x.status == status)
    status = F.when(has("REJECT"), "REJECT").when(has("CHECK"), "CHECK").when(has("UNKNOWN"), "UNKNOWN").otherwise("OK")
    return d.withColumn("status", status).select(*submissions.columns, "stages", "status")
