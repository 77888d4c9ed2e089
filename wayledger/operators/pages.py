"""Lookups, filters and pages, and the shaping of rows as a portal sends them."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W


def holds(column: str, part: str) -> Column:
    """Whether a text holds ``part``, taken literally, in any case; null holds nothing."""
    return F.coalesce(F.contains(F.lower(column), F.lit(part.lower())), F.lit(False))


def in_scope(df: DataFrame, role: str, value: str | None, columns: dict[str, str]) -> DataFrame:
    """The rows a role may see: those whose column for the role has its value; a role without a column sees all."""
    return df.where(F.col(columns[role]) == value) if role in columns else df


def paged(df: DataFrame, order: list[Column], offset: int = 0, limit: int = 50) -> DataFrame:
    """One page in ``order``; a page is what is asked for, all else reads whole tables."""
    return df.orderBy(*order).offset(offset).limit(limit)


def case_page(cases: DataFrame, order: list[Column], equal: dict[str, str] | None = None, part: str | None = None, texts: tuple[str, ...] = (), offset: int = 0, limit: int = 50) -> DataFrame:
    """A page of the cases that have the ``equal`` values and ``part`` in one of ``texts``."""
    out = reduce(lambda d, kv: d.where(F.col(kv[0]) == kv[1]), (equal or {}).items(), cases)
    if part:
        out = out.where(reduce(lambda a, b: a | b, [holds(c, part) for c in texts]))
    return paged(out, order, offset, limit)


def looked_up(works: DataFrame, cases: DataFrame, wanted: DataFrame, key: str, defaults: dict[str, object]) -> DataFrame:
    """Each wanted work with its case's columns; a work that is no case has the ``defaults``, a key of no work is left out."""
    known = works.join(wanted.select(key).distinct(), key, "left_semi")
    out = known.select(key, *[c for c in known.columns if c not in defaults and c != key]).join(cases.select(key, *defaults, F.lit(True).alias("is_case")), key, "left")
    return out.withColumns({c: F.coalesce(F.col(c), F.lit(v)) for c, v in defaults.items()} | {"is_case": F.coalesce("is_case", F.lit(False))})


def pair_sentence() -> Column:
    """What makes a pair alike, as one sentence, over similarity, same_text, state, same_seat, same_agency and same_owner."""
    no = lambda c: F.coalesce(F.col(c), F.lit(False))
    bits = [
        F.format_string("texts are %.2f%% alike", F.col("similarity") * 100), F.when(no("same_text"), "letter by letter"), F.when(F.col("state").isNotNull(), F.concat(F.lit("both in "), "state")),
        F.when(no("same_seat"), "the same seat"), F.when(no("same_agency"), "the same agency"), F.when(no("same_owner"), "the same owner"),
    ]
    return F.concat_ws(", ", *bits)


def pair_order() -> list[Column]:
    """Pairs most alike first, of one agency before others, then of one seat; ties by their ends."""
    return [F.desc("similarity"), F.desc("same_agency"), F.desc("same_seat"), F.asc("a"), F.asc("b")]


def activity_category(text: str) -> Column:
    """The category at the end of a composite activity name; anything else is uncategorised."""
    found = F.trim(F.regexp_extract(text, r"(?s)^WS/MP\d+/\d{4}-\d{4}/\d+-(.+)$", 1))
    return F.coalesce(F.when(found != "", found), F.lit("Uncategorised"))


def ids_by_name(people: DataFrame, name: str, id_: str) -> DataFrame:
    """(name, id): the first id of each name, trimmed and in lower case; empty names are left out."""
    clean = F.lower(F.trim(F.col(name)))
    return people.where(clean != "").groupBy(clean.alias("name")).agg(F.min(id_).alias("id"))


def live_works(raw: DataFrame, names: DataFrame, scope: str, state: str) -> DataFrame:
    """Rows as sent (work_id, owner_name, activity, state_name, amount) shaped as works; rows without an id go.

    The reference is that of the owner whose name it is, or else of the scope; a missing state is the scope's.
    """
    d = raw.where(F.col("work_id").isNotNull()).withColumn("_n", F.lower(F.trim(F.coalesce("owner_name", F.lit("")))))
    d = d.join(names.select(F.col("name").alias("_n"), F.col("id").alias("owner_id")), "_n", "left").drop("_n")
    ref = F.when(F.col("owner_id").isNotNull(), F.concat(F.lit("MP"), "owner_id")).otherwise(F.concat(F.lit("S"), F.col(scope)))
    return d.withColumns({"work_ref": F.concat(ref, F.lit("-W"), "work_id"), "category": activity_category("activity"), "state": F.coalesce("state_name", F.col(state))})


def attachment_bearing(rows: DataFrame, key: str, attachment: str, *order: Column, flag: str = "flag") -> DataFrame:
    """The first row of each key that bears an attachment (null, empty and 0 are none); a missing flag is 1."""
    has = F.col(attachment).isNotNull() & ~F.col(attachment).cast("string").isin("", "0")
    first = rows.where(F.col(key).isNotNull() & has).withColumn("_at", F.row_number().over(W.Window.partitionBy(key).orderBy(*order)))
    return first.where(F.col("_at") == 1).drop("_at").withColumn(flag, F.coalesce(F.col(flag), F.lit(1)))


def feed_page(feed: DataFrame, newest: list[Column], entity: Column | None = None, field: str | None = None, limit: int = 100) -> DataFrame:
    """The newest changes, of one entity or field if asked."""
    out = feed if entity is None else feed.where(entity)
    return paged(out if field is None else out.where(F.col("field") == field), newest, 0, limit)


def kinds_of(works: DataFrame, assigned: DataFrame, catalogue: DataFrame, text: str, kind: str, label: str) -> DataFrame:
    """Works with the kind that their text was assigned and its label; a text without one has no kind and a stated label.

    ``assigned`` has (text, kind) and may repeat a text: its least kind counts, so no work is doubled.
    """
    one = assigned.where(F.col(text).isNotNull()).groupBy(text).agg(F.min(kind).alias(kind))
    return works.join(one, text, "left").join(catalogue.select(kind, label), kind, "left").withColumn(label, F.coalesce(F.col(label), F.lit("Unclassified")))
