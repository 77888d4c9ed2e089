"""Rows for import: one-line texts, numbers and days, the four exports, and the files they become."""

import csv
import glob

from pyspark.sql import functions as F
from test_portfolio import leads

from wayledger.operators import casework
from wayledger.sources import exports


def test_one_line_of_ascii(spark):
    texts = ["  a\tb\r\n c ", "“x” – ‘y’ \"z\"", "₹5…° é×", "", None, "\x00\x1f ", "a" * 10, "abcd efghi", "𝛂b", "a b"]
    d = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").select("i", exports.ascii_line("t").alias("x"), exports.ascii_line("t", 6).alias("y")).orderBy("i").collect()
    assert [r.x for r in d] == ["a b c", "'x' - 'y' 'z'", "Rs 5... deg x", "", "", "", "a" * 10, "abcd efghi", "b", "a b"]
    assert [r.y for r in d][6:8] == ["aaaaa...", "abcd..."] and d[0].y == "a b c"


def test_numbers_days_and_flags(spark):
    d = spark.createDataFrame([("1234567.891",), ("x",), (None,), ("NaN",), ("Infinity",), ("-0.5",)], "t string")
    assert [r[0] for r in d.select(exports.plain_number("t")).collect()] == ["1234567.89", "", "", "", "", "-0.50"]
    days = spark.createDataFrame([("2024-02-03T10:00",), ("2024/02/03",), ("2024-02",), (None,), ("",)], "t string")
    assert [r[0] for r in days.select(exports.iso_day("t")).collect()] == ["2024-02-03", "", "", "", ""]
    assert [r[0] for r in spark.createDataFrame([(True,), (False,), (None,)], "b boolean").select(exports.flag("b")).collect()] == ["TRUE", "FALSE", "FALSE"]


def documents(spark):
    rows = [("MP1-W1", "X", "HIGH", "amount", 'A "big"\nroad', "p", 6e6, 1, 10.0), ("MP1-W2", None, "MEDIUM", None, None, None, None, 0, None)]
    d = leads(spark, rows).withColumns({"amount_pct": F.lit(.99), "recommendation_date": F.lit("2024-01-02").cast("date"), "findings": F.array(F.struct(F.lit("orphan").alias("check"), F.lit("HIGH").alias("severity"))), "is_completed": 1 - F.col("is_open")})
    blank = {"activity_category": "string", "peer_level": "string", "peer_group_size": "long", "priority": "double", "families": "int", "audit_roi": "double", "warning_level": "string", "warning": "double", "stall_ratio": "double", "duration_days": "int", "checks_fired": "int"}
    d = d.withColumns({c: F.lit(None).cast(t) for c, t in blank.items()}).withColumns({c: F.lit(False) for c in ("is_backdated", "completed_without_sanction", "is_future_dated", "is_sanctioned")})
    return casework.documents(d)


def test_cases_and_their_evidence(spark):
    got = {r.work_ref: r for r in exports.cases(documents(spark), F.lit("2024-03-01").cast("date")).collect()}
    one, two = got["MP1-W1"], got["MP1-W2"]
    assert (one.description, one.tier, one.review_due, one.exposure, one.status, one.since) == ("A 'big' road", "State Nodal", "2024-03-15", "6000000.00", "Open", "2024-01-02")
    assert one.evidence.startswith("amount: amount at percentile 0.990") and one.findings == "orphan (HIGH)" and one.actions.endswith("VERIFY_DOCUMENTS")
    assert (two.description, two.state, two.amount, two.exposure, two.families, two.tier, two.review_due, two.status, two.warning, two.evidence) == ("", "", "", "", "0", "District Monitoring", "2024-04-30", "Completed", "LOW", "")
    assert [(r.work_ref, r.place, r.signal) for r in exports.evidence(documents(spark)).collect()] == [("MP1-W1", "1", "amount")]
    assert exports.cases(documents(spark).where("false"), F.current_date()).count() == 0


def test_assignments_and_verifications(spark):
    known = spark.createDataFrame([("a",), ("a",)], "work_ref string")
    visits = spark.createDataFrame([("a", "Me", "g", "X", 1, 1, 2, 1.0, 5.0, "HIGH"), ("b", None, None, None, 2, None, None, .35, None, None)], "work_ref string, auditor string, agency string, state string, place int, day_from int, day_to int, cost double, exposure double, band string")
    got = {r.work_ref: r for r in exports.assignments(visits, known, 10, 4, 1.0).collect()}
    assert (got["a"].assignment, got["a"].case, got["a"].repeat_visit, got["a"].cost, got["a"].day_to) == ("10d-4a-a", "a", "FALSE", "1.00", "2")
    assert (got["b"].case, got["b"].repeat_visit, got["b"].day_from, got["b"].exposure) == ("", "TRUE", "", "")
    records = spark.createDataFrame(
        [("a", "ok", "2024-01-02 10:00", "me", "b", 5.0, .5, True, False, 2), ("b", "bad", None, None, None, None, None, None, True, None), ("c", "ok", "soon", "me", "c", 0.0, 1.0, False, None, 0), (None, "ok", "", "", "", None, None, None, None, None)],
        "work_ref string, outcome string, created_at string, actor string, board_ref string, board_amount double, confidence double, needed_confirmation boolean, demo boolean, reuse int",
    )
    got = {r.work_ref: r for r in exports.verifications(records, known).collect()}
    assert (got["a"].case, got["a"].board_disagrees, got["a"].confidence, got["a"].created_at, got["a"].needed_confirmation, got["a"].reuse) == ("a", "TRUE", "50.00", "2024-01-02", "TRUE", "2")
    assert (got["b"].case, got["b"].board_disagrees, got["b"].board_amount, got["b"].demo) == ("", "FALSE", "", "TRUE")
    assert (got["c"].board_disagrees, got["c"].created_at, got["c"].reuse) == ("FALSE", "", "0") and got[""].board_disagrees == "FALSE"


def test_files_are_quoted_throughout(spark, tmp_path):
    exports.write(exports.evidence(documents(spark)), str(tmp_path / "e"))
    text = "".join(open(f).read() for f in glob.glob(str(tmp_path / "e" / "*.csv")))
    assert text.splitlines()[0] == '"work_ref","place","signal","detail"' and list(csv.reader(text.splitlines()))[1][:3] == ["MP1-W1", "1", "amount"]
