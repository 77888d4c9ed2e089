"""Rows for a case system's import: cases, their evidence, visits assigned and visits made, as one-line ASCII texts in quoted CSV."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import col
from ..operators.casework import with_parent
from ..operators.summaries import escalated

# Characters that an import would mangle, and what is written for them.
SINGLE = ("‘’“”\"–—·•×⁄", "'''''----x/")
SEVERAL = (("…", "..."), ("₹", "Rs "), ("°", " deg "))


def ascii_line(c: Column | str, most: int | None = None) -> Column:
    """A text as one line of printable ASCII: quotes, dashes and signs by their likeness, all else as blanks, runs of blanks as one.

    Null gives the empty text.  A text longer than ``most``, a field's limit, ends in three dots after its first ``most`` - 1 characters.
    """
    t = F.translate(F.coalesce(col(c).cast("string"), F.lit("")), *SINGLE)
    for sign, plain in SEVERAL:
        t = F.replace(t, F.lit(sign), F.lit(plain))
    t = F.trim(F.regexp_replace(t, r"[^\x21-\x7E]+", " "))
    return t if most is None else F.when(F.length(t) <= most, t).otherwise(F.concat(F.rtrim(F.substring(t, 1, most - 1)), F.lit("...")))


def plain_number(c: Column | str, places: int = 2) -> Column:
    """A number without commas or sign of currency; what is no finite number gives the empty text."""
    x = col(c).cast("string").try_cast("double")
    return F.when(x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")), "").otherwise(F.format_string(f"%.{places}f", x))


def iso_day(c: Column | str) -> Column:
    """The first ten characters of a text that begins like YYYY-MM-DD, else the empty text."""
    t = F.substring(col(c).cast("string"), 1, 10)
    return F.when((F.length(t) == 10) & (F.substring(t, 5, 1) == "-"), t).otherwise("")


def flag(c: Column | str) -> Column:
    return F.when(F.coalesce(col(c).cast("boolean"), F.lit(False)), "TRUE").otherwise("FALSE")


def cases(documents: DataFrame, as_of: Column, key: str = "work_ref") -> DataFrame:
    """One row a case document (``casework.documents``), with its tier and the day of its first review; every value is a text."""
    listed = lambda of, form: F.array_join(F.transform(F.col(f"case.{of}"), form), "; ")
    d = documents.select("*", F.col("case.scores.exposure").alias("_exposure"), F.col("case.scores.band").alias("band"))
    d = escalated(d, as_of, "_exposure")
    text = {
        key: (F.col(key), 40), "description": (F.col("case.identity.description"), 5000), "state": (F.col("case.identity.state"), 80), "agency": (F.col("case.identity.agency"), 255),
        "band": (F.col("band"), 20), "kind": (F.col("case.kind"), 255), "evidence": (listed("evidence", lambda e: F.concat(e.signal, F.lit(": "), e.detail)), 5000), "first_step": (F.col("case.first_step"), 5000),
        "actions": (F.array_join("case.actions", " | "), 2000), "warning": (F.coalesce("case.warning.level", F.lit("LOW")), 20), "findings": (listed("findings", lambda f: F.concat(f.check, F.lit(" ("), f.severity, F.lit(")"))), 2000), "tier": (F.col("tier"), 40),
    }
    number = {"amount": ("case.identity.amount", 2), "exposure": ("case.scores.exposure", 2), "audit_roi": ("case.scores.audit_roi", 2), "priority": ("case.scores.priority", 4)}
    return d.select(
        *[ascii_line(c, n).alias(name) for name, (c, n) in text.items()], *[plain_number(c, n).alias(name) for name, (c, n) in number.items()], F.coalesce(F.col("case.scores.families"), F.lit(0)).cast("string").alias("families"),
        iso_day("case.identity.since").alias("since"), iso_day("review_due").alias("review_due"), F.when(F.col("case.identity.stage") == "Completed", "Completed").otherwise("Open").alias("status"), F.lit("New").alias("stage"), F.lit("TRUE").alias("not_a_finding"),
    )


def evidence(documents: DataFrame, key: str = "work_ref") -> DataFrame:
    """One row a piece of evidence, with its place in the document and the key of its case; documents without any give none."""
    e = documents.select(key, F.posexplode("case.evidence").alias("_at", "e"))
    return e.select(ascii_line(key, 40).alias(key), (F.col("_at") + 1).cast("string").alias("place"), ascii_line("e.signal", 120).alias("signal"), ascii_line("e.detail", 5000).alias("detail"))


def assignments(visits: DataFrame, known: DataFrame, budget: int, people: int, first_visit: float, key: str = "work_ref") -> DataFrame:
    """Planned visits (key, auditor, agency, state, place, day_from, day_to, cost, exposure, band) as rows to import.

    Budget and number of people are in the row's own key: another plan's visits are other rows, not changes to these.
    The case is named only where it is among ``known``; a visit that costs less than the first one is a repeat.
    """
    d = with_parent(visits, known, key)
    whole = lambda c: F.coalesce(F.col(c).cast("long").cast("string"), F.lit(""))
    return d.select(
        ascii_line(F.concat(F.lit(f"{budget}d-{people}a-"), key), 80).alias("assignment"), ascii_line(key, 40).alias(key), ascii_line("parent", 40).alias("case"), ascii_line("auditor", 80).alias("auditor"), ascii_line("agency", 255).alias("agency"),
        ascii_line("state", 80).alias("state"), whole("place").alias("place"), whole("day_from").alias("day_from"), whole("day_to").alias("day_to"), plain_number("cost").alias("cost"), plain_number("exposure").alias("exposure"), ascii_line("band", 20).alias("band"),
        flag(F.col("cost") < first_visit).alias("repeat_visit"), F.lit("Planned").alias("stage"),
    )


def verifications(records: DataFrame, known: DataFrame, key: str = "work_ref") -> DataFrame:
    """Visits made (key, outcome, created_at, actor, board_ref, board_amount, confidence, needed_confirmation, demo, reuse) as rows to import.

    Whether the board disagrees is derived from the two references here, so it can't drift from them; a board that names no
    work disagrees with none.  A confidence of 0 to 1 becomes per cent.
    """
    d = with_parent(records, known, key)
    board = F.coalesce(F.col("board_ref"), F.lit(""))
    return d.select(
        ascii_line(key, 40).alias(key), ascii_line("parent", 40).alias("case"), ascii_line("outcome", 40).alias("outcome"), iso_day("created_at").alias("created_at"), ascii_line("actor", 80).alias("actor"), ascii_line("board_ref", 40).alias("board_ref"),
        plain_number("board_amount").alias("board_amount"), plain_number(F.col("confidence") * 100).alias("confidence"), flag("needed_confirmation").alias("needed_confirmation"), flag("demo").alias("demo"),
        F.coalesce(F.col("reuse").cast("string"), F.lit("")).alias("reuse"), flag((board != "") & (board != F.coalesce(F.col(key), F.lit("")))).alias("board_disagrees"),
    )


def write(rows: DataFrame, path: str) -> None:
    """CSV with a header and every value in quotes."""
    rows.write.mode("overwrite").options(quoteAll=True, header=True, emptyValue="", escape='"').csv(path)
