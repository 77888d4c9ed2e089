"""From raw stage rows to one row a work, with flags for what doesn't fit together."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W

from ..functions.columns import parsed_date, parsed_flag, whole_number


def first_of(df: DataFrame, keys: list[str], *order: Column) -> DataFrame:
    """One row for each key, the first in an order that the caller makes total."""
    row = F.row_number().over(W.Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn("_row", row).where("_row = 1").drop("_row")


def typed(df: DataFrame, longs=(), doubles=(), flags=(), dates=(), formats=("dd-MMM-yyyy",)) -> DataFrame:
    """Columns of text cast by kind; what can't be cast is null."""
    out = {c: whole_number(c) for c in longs} | {c: F.col(c).try_cast("double") for c in doubles}
    return df.withColumns(out | {c: parsed_flag(c) for c in flags} | {c: parsed_date(c, *formats) for c in dates})


def unpivoted(columns: list[str]) -> Column:
    """Rows of (name, value) from one row's columns of equal type."""
    return F.stack(F.lit(len(columns)), *[x for c in columns for x in (F.lit(c), F.col(c))])


def uncastable(raw: DataFrame, cast: DataFrame, columns: list[str]) -> DataFrame:
    """(column, lost): values that a cast turned to null.  Both frames must come from the same rows, in place."""
    counted = lambda df, name: df.agg(*[F.count(c).alias(c) for c in columns]).select(unpivoted(columns).alias("column", name))
    before, after = counted(raw, "n"), counted(cast, "m")
    return before.join(after, "column").select("column", (F.col("n") - F.col("m")).alias("lost"))


def labelled(df: DataFrame, column: str, codes: dict[str, str]) -> DataFrame:
    """A label column replaced by its code; unknown labels raise when the row is read."""
    known = F.create_map(*[F.lit(x) for kv in codes.items() for x in kv])
    code = known[F.col(column)]
    return df.withColumn(column, F.when(F.col(column).isNull() | code.isNotNull(), code).otherwise(F.raise_error(F.concat(F.lit("unknown label: "), F.col(column)))))


def split_grain(df: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """Rows with the key and rows without: together every row, once."""
    return df.where(F.col(key).isNotNull()), df.where(F.col(key).isNull())


def stage_log(stages: DataFrame, key: str, stage: str, date: str, order: dict[str, int], undated: tuple[str, ...] = ()) -> DataFrame:
    """``stage_seq`` by stage; the date only for stages that have one of their own."""
    seq = F.create_map(*[F.lit(x) for kv in order.items() for x in kv])[F.col(stage)]
    return stages.withColumns({"stage_seq": seq, "stage_date": F.when(~F.col(stage).isin(*undated), F.col(date))})


def assembled(universe: DataFrame, records: DataFrame, stages: DataFrame, completions: DataFrame, key: str) -> DataFrame:
    """One row for each key of the universe with its record, the stages it reached and its completion record.

    ``records`` and ``completions`` hold a key once at most.  ``stages`` is (key, is_sanctioned) rows, any number a key.
    """
    reached = stages.groupBy(key).agg(F.max("is_sanctioned").alias("is_sanctioned"))
    out = universe.select(key).distinct().join(records, key, "left").join(reached, key, "left").join(completions, key, "left")
    return out.withColumn("is_sanctioned", F.coalesce("is_sanctioned", F.lit(False))).withColumn("is_completed", F.col("completion_date").isNotNull())


def flagged(works: DataFrame, anchor: Column | None = None) -> DataFrame:
    """What doesn't fit: amounts of 0 or less, completion before the start or after the last start, no sanction, no stage."""
    last = anchor if anchor is not None else works.select(F.max("recommendation_date")).scalar()
    no = lambda c: F.coalesce(c, F.lit(False))
    return works.withColumns(
        {
            "has_nonpositive_amount": no(F.col("recommended_amount") <= 0),
            "is_backdated": no(F.col("completion_date") < F.col("recommendation_date")),
            "is_future_dated": no(F.col("completion_date") > last),
            "completed_without_sanction": no(F.col("is_completed") & ~F.col("is_sanctioned")),
        }
    )


def featured(works: DataFrame, snapshot: Column) -> DataFrame:
    """Event, open flag, days from start to completion or snapshot (negative: null), log amount and age (missing or negative: 0)."""
    valid = ~F.col("is_backdated") & ~F.col("is_future_dated")
    event = F.col("is_completed") & valid
    days = F.datediff(F.when(event, F.col("completion_date")).otherwise(snapshot), "recommendation_date")
    return works.withColumns(
        {
            "is_event": event.cast("int"),
            "is_open": (~F.col("is_completed")).cast("int"),
            "duration_days": F.when(days >= 0, days),
            "age_days": F.greatest(F.coalesce(F.datediff(snapshot, "recommendation_date"), F.lit(0)), F.lit(0)),
            "log_amount": F.log1p(F.greatest(F.coalesce("recommended_amount", F.lit(0.0)), F.lit(0.0))),
        }
    )


def checked_counts(rows_in: int, *rows_out: int, reason: str = "") -> None:
    """Raises if rows went in that none of the outputs accounts for."""
    if rows_in != sum(rows_out):
        raise ValueError(f"{rows_in} rows in, {' + '.join(map(str, rows_out))} out{': ' + reason if reason else ''}")


def digest(df: DataFrame) -> Column:
    """A fingerprint of a table that doesn't depend on the order of its rows."""
    return F.sum(F.xxhash64(*df.columns).cast("decimal(38,0)"))


def without_banned(df: DataFrame, banned: set[str]) -> DataFrame:
    """The columns that computations may use."""
    return df.drop(*[c for c in df.columns if c in banned])


def key_sets(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """One row: distinct keys in both, only left, only right."""
    a, b = left.select(key).distinct().withColumn("l", F.lit(1)), right.select(key).distinct().withColumn("r", F.lit(1))
    both = a.join(b, key, "full")
    return both.agg(F.count_if(F.col("l").isNotNull() & F.col("r").isNotNull()).alias("in_both"), F.count_if(F.col("r").isNull()).alias("only_left"), F.count_if(F.col("l").isNull()).alias("only_right"))


def reconciled(works: DataFrame, published: DataFrame, key: str, amount: str, total: str, tolerance: float = 0.001) -> DataFrame:
    """(key, own, published, ratio, matches): own sums against published totals."""
    own = works.groupBy(key).agg(F.sum(amount).alias("own"))
    out = own.join(published.select(key, F.col(total).alias("published")), key)
    return out.withColumns({"ratio": F.when(F.col("published") != 0, F.col("own") / F.col("published")), "matches": F.abs(F.col("own") - F.col("published")) <= tolerance * F.abs("published")})


def completeness(df: DataFrame, columns: list[str]) -> DataFrame:
    """(column, filled): the share of non-null values, from one pass."""
    one = df.agg(*[F.avg(F.col(c).isNotNull().cast("double")).alias(c) for c in columns])
    return one.select(unpivoted(columns).alias("column", "filled"))


def profiled(df: DataFrame, columns: list[str]) -> DataFrame:
    """(column, rows, nulls, distinct, least, greatest, all_long, all_double), all as one pass with exact distinct counts."""
    aggs = []
    for c in columns:
        t = F.col(c).cast("string")
        fits = lambda kind, t=t: F.coalesce(F.bool_and(t.try_cast(kind).isNotNull()), F.lit(False))
        aggs.append(F.struct(F.lit(c).alias("column"), F.count("*").alias("rows"), F.count_if(F.col(c).isNull()).alias("nulls"), F.countDistinct(c).alias("distinct"),
                             F.min(t).alias("least"), F.max(t).alias("greatest"), fits("long").alias("all_long"), fits("double").alias("all_double")))
    return df.agg(F.array(*aggs).alias("p")).select(F.inline("p"))


def merged_stages(stages: DataFrame, key: str, seq: str, columns: list[str]) -> DataFrame:
    """For each key and column the value of the latest stage that has one."""
    return stages.groupBy(key).agg(*[F.max_by(c, F.when(F.col(c).isNotNull(), F.col(seq))).alias(c) for c in columns])
