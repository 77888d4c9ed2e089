"""What submissions are about and how they fare, on readings that miss, differ, lie a digit apart or are not there."""

from wayledger.operators import submissions as S

WORKS = "work_ref string, recommended_amount double, amount_pct double, checks_fired int, warning_level string, similarity double, band string"
SENT = "id int, read_ref string, other_ref string, typed_ref string, stated double, kind string, picture string"


def works(spark):
    rows = [("MP1-W10", 1000.0, .5, 0, "LOW", None, "NONE"), ("MP1-W11", 1000.0, .995, 1, "HIGH", .98, "HIGH"), ("MP7-W500", 50.0, None, 0, None, .1, "MEDIUM"), ("MP7-W500", 50.0, None, 0, None, .1, "MEDIUM"), ("MP8-W777", 0.0, .005, 0, "LOW", None, "LOW"), (None, 1.0, .5, 0, "LOW", None, "NONE")]
    return spark.createDataFrame(rows, WORKS)


def found(spark, *rows):
    d = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], SENT)
    return S.identified(d, works(spark))


def test_identity(spark):
    rows = found(
        spark,
        ("MP7-W500", None, None, 50.9, "photo", None),  # one reading, no work a digit away, amount within a rupee
        ("MP1-W10", None, None, None, "photo", None),  # a real work one digit away
        ("MP7-W500", "MP8-W777", None, None, "photo", None),  # readers differ, the other one read a real work
        ("MP7-W500", "MP7-W999", None, None, "photo", None),  # and one that is no work
        ("MP7-W500", "MP7-W500", "MP7-W500", 52.0, "photo", None),  # all agree but the amount
        ("MP7-W500", None, "MP8-W777", None, "photo", None),  # the form says otherwise
        (" ", None, "MP7-W500", None, "photo", None), ("", None, None, 5.0, "photo", None), ("MP9-W9", None, None, None, "photo", None),
        ("MP8-W777", None, None, 5.0, "photo", None),  # no amount on record
        ("MP1-W12", None, None, None, "photo", None),  # no work itself, two are a digit away
    ).orderBy("id").collect()
    got = [(r.reference, r.alternatives, r.matched, r.readers_agree, r.amount_agrees, r.needs_confirmation, r.identity) for r in rows]
    assert got == [
        ("MP7-W500", [], True, None, True, False, "OK"), ("MP1-W10", ["MP1-W11"], True, None, None, True, "ATTENTION"), ("MP7-W500", ["MP8-W777"], True, False, None, True, "ATTENTION"),
        ("MP7-W500", [], True, False, None, True, "ATTENTION"), ("MP7-W500", [], True, True, False, True, "OK"), ("MP8-W777", [], True, None, None, True, "BLOCKED"), ("MP7-W500", [], True, None, None, True, "ATTENTION"),
        (None, [], False, None, None, True, "BLOCKED"), ("MP9-W9", [], False, None, None, True, "ATTENTION"), ("MP8-W777", [], True, None, None, False, "OK"), ("MP1-W12", ["MP1-W10", "MP1-W11"], False, None, None, True, "ATTENTION"),
    ]


def test_copies_of_a_submission_stay(spark):
    rows = found(spark, *[("MP7-W500", None, None, None, "photo", None)] * 3)
    assert rows.count() == 3 and found(spark, ("MP1-W10", None, None, None, None, None)).where("false").count() == 0


def test_stages(spark):
    reused = spark.createDataFrame([("p", 2), ("q", 0), (None, 9)], "picture string, others int")
    d = found(
        spark, ("MP7-W500", None, None, 50.0, "photo", "p"), ("MP1-W11", None, "MP1-W11", None, "document", None), ("MP8-W777", None, None, 5.0, "photo", "q"), ("", None, None, None, "photo", "p"), ("MP9-W9", None, None, None, "photo", "p"),
        ("MP7-W500", None, None, None, "film", "p"), ("MP7-W500", None, "MP8-W777", None, "document", None), ("MP7-W500", None, None, None, None, None),
    )
    got = {r.id: ({s.stage: s.status for s in r.stages}, r.outcome) for r in S.chained(d, works(spark), reused).collect()}
    names = ["received", "read", "identify", "record", "picture", "amount", "peers", "lifecycle", "risk", "duplicate", "lead"]
    assert list(got[0][0]) == names and list(got[0][0].values()) == ["OK", "OK", "OK", "OK", "ATTENTION", "OK", "OK", "OK", "OK", "OK", "ATTENTION"] and got[0][1] == "LEAD"
    assert list(got[1][0].values()) == ["OK", "OK", "OK", "OK", "OK", "INFO", "ATTENTION", "ATTENTION", "ATTENTION", "ATTENTION", "ATTENTION"] and got[1][1] == "CONFIRM"
    assert got[2][0]["picture"] == "OK" and got[2][0]["peers"] == "ATTENTION" and got[2][0]["lead"] == "INFO" and got[2][1] == "CLEAR"
    assert got[3] == ({"received": "OK", "read": "INFO", "identify": "BLOCKED"}, "BLOCKED")
    assert got[4] == ({"received": "OK", "read": "OK", "identify": "ATTENTION", "record": "BLOCKED"}, "BLOCKED")
    assert got[5] == got[7] == ({"received": "BLOCKED"}, "BLOCKED")
    assert got[6][0]["identify"] == "BLOCKED" and got[6][0]["picture"] == "INFO" and got[6][1] == "CONFIRM" and list(got[6][0]) == names
