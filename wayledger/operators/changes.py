"""Differences between snapshots as a field-level change feed, and the state that polling keeps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W

from ..sources.tables import stored
from .ordering import ranked


def normal(c: str) -> Column:
    """A value as text: 3.0 and 3 are equal, null and the empty text are."""
    t = F.trim(F.col(c).cast("string"))
    return F.when((t == "") | t.isNull(), None).otherwise(F.regexp_replace(t, r"^(-?\d+)\.0+$", "$1"))


def diffed(old: DataFrame, new: DataFrame, key: str, fields: list[str], vanished: bool = False) -> DataFrame:
    """(key, change_type, field, old_value, new_value): appeared, changed (a row a field) and, on request, vanished."""
    packed = lambda df, name: df.select(key, F.struct(*[normal(c).alias(c) for c in fields]).alias(name))
    both = packed(old, "o").join(packed(new, "n"), key, "full")
    moved = F.filter(
        F.array(*[F.struct(F.lit("changed").alias("change_type"), F.lit(c).alias("field"), F.col(f"o.{c}").alias("old_value"), F.col(f"n.{c}").alias("new_value")) for c in fields]),
        lambda x: ~x.old_value.eqNullSafe(x.new_value),
    )
    alone = lambda what: F.array(F.struct(F.lit(what).alias("change_type"), *[F.lit(None).cast("string").alias(c) for c in ("field", "old_value", "new_value")]))
    rows = F.when(F.col("o").isNull(), alone("appeared")).when(F.col("n").isNull(), alone("vanished")).otherwise(moved)
    out = both.select(key, F.explode(rows).alias("c")).select(key, "c.*")
    return out if vanished else out.where("change_type <> 'vanished'")


def feed_of(versions: DataFrame, key: str, order: list[str], fields: list[str]) -> DataFrame:
    """The change feed of a whole history: each version against the one before, so batch borders make no difference."""
    by = W.Window.partitionBy(key).orderBy(*order)
    state = F.struct(*[normal(c).alias(c) for c in fields])
    v = versions.select(key, *order, state.alias("n")).withColumn("o", F.lag("n").over(by))
    moved = F.filter(
        F.array(*[F.struct(F.lit("changed").alias("change_type"), F.lit(c).alias("field"), F.col(f"o.{c}").alias("old_value"), F.col(f"n.{c}").alias("new_value")) for c in fields]),
        lambda x: ~x.old_value.eqNullSafe(x.new_value),
    )
    first = F.array(F.struct(F.lit("appeared").alias("change_type"), *[F.lit(None).cast("string").alias(c) for c in ("field", "old_value", "new_value")]))
    return v.select(key, *order, F.explode(F.when(F.col("o").isNull(), first).otherwise(moved)).alias("c")).select(key, *order, "c.*")


def latest(versions: DataFrame, key: str, order: list[str]) -> DataFrame:
    """The newest version of each key."""
    return versions.groupBy(key).agg(F.max_by(F.struct(*versions.columns), F.struct(*order)).alias("v")).select("v.*")


def fingerprint(*columns: str) -> Column:
    return F.sha2(F.to_json(F.struct(*[F.col(c).cast("string").alias(c) for c in columns]), {"ignoreNullFields": "false"}), 256)


def watermarks(checks: DataFrame, scope: str, at: str, print_: str, cold_after: int = 12, every: int = 6) -> DataFrame:
    """(scope, checks, changes, last_checked, last_changed, unchanged, is_due) from a scope's history of fingerprints."""
    by = W.Window.partitionBy(scope).orderBy(at)
    marked = checks.withColumn("_new", ~F.col(print_).eqNullSafe(F.lag(print_).over(by)) | (F.row_number().over(by) == 1))
    marked = marked.withColumn("_run", F.sum(F.col("_new").cast("int")).over(by.rowsBetween(W.Window.unboundedPreceding, 0)))
    runs = marked.groupBy(scope, "_run").agg(F.count("*").alias("_n"), F.min(at).alias("_from"), F.max(at).alias("_to"))
    out = runs.groupBy(scope).agg(
        F.sum("_n").alias("checks"), (F.max("_run") - 1).alias("changes"), F.max("_to").alias("last_checked"), F.max_by("_from", "_run").alias("last_changed"), (F.max_by("_n", "_run") - 1).alias("unchanged"),
    )
    return out.withColumn("is_due", (F.col("unchanged") < cold_after) | (F.col("unchanged") % every == 0))


def moved_scopes(current: DataFrame, known: DataFrame, scope: str, print_: str) -> DataFrame:
    """Scopes whose fingerprint isn't the known one."""
    return current.join(known.select(scope, print_), [scope, print_], "left_anti")


def chain_breaks(log: DataFrame, seq: str, prev: str, own: str, expected: Column) -> DataFrame:
    """(seq, fault): rows that don't hash to their own hash, don't follow the row before, or share a parent."""
    marks = log.select(F.col(seq).alias("seq"), F.col(prev).alias("p"), F.col(own).alias("h"), (expected != F.col(own)).alias("edited"))
    marks = stored(ranked(marks, "place", F.asc("seq"), F.asc("h"), F.asc("p")))
    before = marks.select((F.col("place") + 1).alias("place"), F.col("h").alias("_h"))
    shared = marks.groupBy("p").agg((F.count("*") > 1).alias("fork")).withColumnRenamed("p", "_p")
    marks = marks.join(before, "place", "left").join(shared, F.col("p").eqNullSafe(F.col("_p")))
    marks = marks.withColumn("gap", ~F.col("_h").eqNullSafe(F.col("p")) & (F.col("place") > 1))
    fault = F.when(F.col("edited"), "edited").when(F.col("gap"), "gap").when(F.col("fork"), "fork")
    return marks.select("seq", fault.alias("fault")).where("fault is not null")


def composite(*columns: str) -> Column:
    """A key for rows that have none: SHA-256 of the columns' normal texts joined by ``|``, the empty text for null."""
    return F.sha2(F.concat_ws("|", *[F.coalesce(normal(c), F.lit("")) for c in columns]), 256)


def run_counters(versions: DataFrame, run: str, key: str, order: list[str], fields: list[str]) -> DataFrame:
    """(run, seen, keys, appeared, changed): what each run brought, if runs came in order; ``changed`` counts fields.

    A run's last version of a key is held against that of the key's run before.
    """
    last = versions.groupBy(run, key).agg(F.count("*").alias("_seen"), F.max_by(F.struct(*[normal(c).alias(c) for c in fields]), F.struct(*order)).alias("n"))
    d = last.withColumn("o", F.lag("n").over(W.Window.partitionBy(key).orderBy(run)))
    moved = sum(((~F.col(f"o.{c}").eqNullSafe(F.col(f"n.{c}"))).cast("int") for c in fields), F.lit(0))
    return d.groupBy(run).agg(
        F.sum("_seen").alias("seen"), F.count("*").alias("keys"), F.count_if(F.col("o").isNull()).alias("appeared"), F.sum(F.when(F.col("o").isNotNull(), moved).otherwise(0)).alias("changed")
    )


def history(feed: DataFrame, key: str, value: Column, *newest: Column) -> DataFrame:
    """The changes of one entity, newest first."""
    return feed.where(F.col(key).eqNullSafe(value)).orderBy(*newest)


def freshness(checks: DataFrame, scope: str, at: str, as_of: Column) -> DataFrame:
    """One row: scopes, seconds from the last check of any scope to ``as_of``, and from the last check of the one checked least recently."""
    each = checks.groupBy(scope).agg(F.max(at).alias("_last"))
    seconds = lambda c: F.unix_timestamp(as_of.cast("timestamp")) - F.unix_timestamp(c.cast("timestamp"))
    return each.agg(F.count("*").alias("scopes"), seconds(F.max("_last")).alias("since_last"), seconds(F.min("_last")).alias("since_oldest"))


def judged_entries(entries: DataFrame, outcome: str, domain: tuple[str, ...], hashed: list[str]) -> DataFrame:
    """Ledger entries with ``row_hash`` over ``hashed`` and ``reason``: null for accepted ones, else why not."""
    reason = F.when(F.col(outcome).isNull(), "no outcome").when(~F.col(outcome).isin(*domain), F.concat(F.lit("unknown outcome: "), F.col(outcome)))
    return entries.withColumns({"row_hash": composite(*hashed), "reason": reason})
