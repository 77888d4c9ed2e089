"""Batches of submitted photographs and documents: which work each is about, how sure that is, and what the record says to it."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import DEFAULT, Thresholds
from ..sources.tables import stored
from .assess import matched_amount
from .extract import near_misses

OK, INFO, ATTENTION, BLOCKED = "OK", "INFO", "ATTENTION", "BLOCKED"

#: About so many letters of references are looked at in a round of near misses, which bounds its shuffle.
EACH_ROUND = 4_000_000

#: Peers are remarkable beyond these shares here, at both ends.  Fixed values.
LOW_END, HIGH_END = 0.01, 0.99


def filled(c: str) -> Column:
    """A text that is not empty, else null."""
    return F.when(F.trim(F.col(c)) != "", F.trim(F.col(c)))


def identified(submissions: DataFrame, works: DataFrame, key: str = "work_ref", amount: str = "recommended_amount", most: int = 5) -> DataFrame:
    """Submissions (read_ref, other_ref, typed_ref, stated: two readers' references, the form's, an amount) with what they are about.

    Adds ``reference`` (the form's, or else the first reader's), ``alternatives`` (works whose reference differs in one digit from
    the one read, and the second reader's if it is a work: the first ``most`` by name), ``matched``, ``readers_agree`` (null without
    two readings), ``amount_agrees`` (null where an amount is missing or 0), ``needs_confirmation`` and ``identity``, a status.
    No match is settled while a work is one digit away, the readers or the amounts disagree, the form says otherwise, or
    nothing was read.  References are looked up by joins, which carry a submission twice; near misses of many go in rounds.
    """
    d = stored(submissions.withColumns({"_read": filled("read_ref"), "_other": filled("other_ref"), "_typed": filled("typed_ref")}))
    known = works.where(F.col(key).isNotNull()).groupBy(key).agg(F.max(amount).alias("_known"))
    digits = d.where("_read IS NOT NULL").agg(F.sum(F.length("_read")).alias("n"), F.max(F.length("_read")).alias("most")).first()
    rounds = max(1, min(digits.most or 1, math.ceil((digits.n or 0) / EACH_ROUND)))
    near = near_misses(d.select("_read"), "_read", works.select(key), key, rounds).select(F.col("key").alias("_k"), F.col("match").alias("_near"))
    other = d.where("_read <> _other").select(F.col("_read").alias("_k"), F.col("_other").alias("_m")).distinct().join(known.select(F.col(key).alias("_m")), "_m", "left_semi")
    found = near.unionByName(other, allowMissingColumns=True).groupBy("_k").agg(F.array_sort(F.collect_set("_near")).alias("_near"), F.collect_set("_m").alias("_seconds"))  # of misses nine a digit at most
    d = d.join(stored(found), F.col("_read") == F.col("_k"), "left").withColumn("_m", F.when(F.array_contains("_seconds", F.col("_other")), F.col("_other"))).drop("_k", "_seconds")
    none = F.array().cast("array<string>")
    both = F.array_sort(F.array_union(F.coalesce("_near", none), F.when(F.col("_m").isNotNull(), F.array("_m")).otherwise(none)))
    d = d.withColumns({"reference": F.coalesce("_typed", "_read"), "alternatives": F.slice(both, 1, most)}).drop("_near", "_m")
    d = d.join(known.select(F.col(key).alias("_w"), "_known"), F.col("reference") == F.col("_w"), "left")
    agrees = F.when((F.col("stated") > 0) & (F.col("_known") > 0), matched_amount(F.col("stated"), F.col("_known")))
    typed_over = F.coalesce(F.col("_typed") != F.col("_read"), F.lit(False))
    d = d.withColumns({"matched": F.col("_w").isNotNull(), "readers_agree": F.col("_read") == F.col("_other"), "amount_agrees": agrees})
    unsure = ~F.col("matched") | F.col("_read").isNull() | typed_over | (F.size("alternatives") > 0) | ~F.coalesce("readers_agree", F.lit(True)) | ~F.coalesce("amount_agrees", F.lit(True))
    d = d.withColumn("needs_confirmation", unsure)
    identity = (
        F.when(F.col("reference").isNull(), BLOCKED).when(typed_over, BLOCKED).when(F.col("_read").isNull(), ATTENTION)
        .when(F.col("_typed").isNotNull(), OK).when(F.col("needs_confirmation"), ATTENTION).otherwise(OK)
    )
    return d.withColumn("identity", identity).drop("_read", "_other", "_typed", "_w", "_known")


def chained(found: DataFrame, works: DataFrame, reused: DataFrame, key: str = "work_ref", kinds: tuple[str, ...] = ("photo", "document"), t: Thresholds = DEFAULT) -> DataFrame:
    """``identified`` submissions with ``stages``, an array of (stage, status) in order, and ``outcome``.

    ``found`` also has ``kind`` and ``picture``; ``reused`` has (picture, others): how many other works bear the same picture.
    ``works`` has amount_pct, checks_fired, warning_level, similarity and band by key.  A submission of an unknown kind, without
    a reference or of an unknown work is BLOCKED there, and later stages are not reached; one whose form contradicts the reading
    goes on with the form's reference.  The outcome is BLOCKED, CONFIRM, LEAD or CLEAR.
    """
    facts = works.select(F.col(key).alias("_w"), "amount_pct", "checks_fired", "warning_level", "similarity", "band").dropDuplicates(["_w"])
    used = stored(reused.groupBy(F.col("picture").alias("_p")).agg(F.max("others").alias("_others")))  # so Spark knows its size
    d = found.join(facts, F.col("reference") == F.col("_w"), "left").join(used, F.col("picture") == F.col("_p"), "left")
    taken = F.coalesce(F.col("kind").isin(*kinds), F.lit(False))
    look = lambda bad: F.when(F.coalesce(bad, F.lit(False)), ATTENTION).otherwise(OK)
    nothing_read = F.coalesce(F.trim("read_ref"), F.lit("")) == ""
    named, known = taken & F.col("reference").isNotNull(), taken & F.col("matched")
    picture = F.when(F.col("kind") == "photo", look(F.col("_others") > 0)).otherwise(F.when(F.coalesce(F.trim("read_ref") == F.col("reference"), F.lit(False)), OK).otherwise(INFO))
    steps = [  # stage, reached, status
        ("received", F.lit(True), F.when(taken, OK).otherwise(BLOCKED)), ("read", taken, F.when(nothing_read, INFO).otherwise(OK)), ("identify", taken, F.col("identity")), ("record", named, F.when(F.col("matched"), OK).otherwise(BLOCKED)),
        ("picture", known, picture), ("amount", known, F.when(F.col("amount_agrees").isNull(), INFO).otherwise(look(~F.col("amount_agrees")))), ("peers", known, look((F.col("amount_pct") >= HIGH_END) | (F.col("amount_pct") <= LOW_END))),
        ("lifecycle", known, look(F.col("checks_fired") > 0)), ("risk", known, look(F.col("warning_level").isin("HIGH", "CRITICAL"))), ("duplicate", known, look(F.col("similarity") >= t.duplicate_gate)),
        ("lead", known, F.when(F.col("band").isin("MEDIUM", "HIGH"), ATTENTION).otherwise(INFO)),
    ]
    stages = F.array_compact(F.array(*[F.when(reached, F.struct(F.lit(n).alias("stage"), status.alias("status"))) for n, reached, status in steps]))
    outcome = F.when(~known, "BLOCKED").when(F.col("needs_confirmation"), "CONFIRM").when(F.coalesce(F.col("band").isin("MEDIUM", "HIGH"), F.lit(False)), "LEAD").otherwise("CLEAR")
    return d.withColumns({"stages": stages, "outcome": outcome}).select(*found.columns, "stages", "outcome")
