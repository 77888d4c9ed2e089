"""Case documents, casework, lookups and pages on small rows."""

from pyspark.sql import functions as F

from wayledger.operators import casework, pages


def test_steps_and_actions(spark):
    rows = [  # is_backdated, orphan, amount, risk, duration, duplicate, checks, warning
        (1, True, True, .5, .9, .0, .0, 1, "LOW"), (2, False, True, .0, .0, .0, .0, 1, "LOW"), (3, False, False, .4, .0, .8, .98, 0, "HIGH"), (4, False, False, .0, .0, .8, .0, 0, "CRITICAL"), (5, None, False, .0, .0, .0, .0, 0, None),
    ]
    d = spark.createDataFrame(rows, "k int, is_backdated boolean, is_orphan boolean, sig_amount double, sig_risk double, sig_duration double, sig_duplicate double, checks_fired int, warning_level string")
    d = d.withColumns({"completed_without_sanction": F.lit(False), "is_future_dated": F.lit(False)})
    got = {r.k: (r.s, list(r.a)) for r in d.select("k", casework.first_step().alias("s"), casework.actions().alias("a")).collect()}
    assert got == {
        1: ("CHECK_STAGES", ["REVIEW_STAGES", "COMPARE_WITH_PEERS", "VERIFY_DOCUMENTS"]), 2: ("REVIEW_EVIDENCE", ["REVIEW_STAGES", "VERIFY_DOCUMENTS"]),
        3: ("CHECK_ESTIMATE", ["COMPARE_WITH_MATCH", "COMPARE_WITH_PEERS", "ASK_FOR_PROGRESS", "VERIFY_DOCUMENTS"]), 4: ("ASK_FOR_PROGRESS", ["ASK_FOR_PROGRESS", "VERIFY_DOCUMENTS"]), 5: ("REVIEW_EVIDENCE", ["VERIFY_DOCUMENTS"]),
    }


def test_export_tiers_part_all_works(spark):
    works = spark.createDataFrame([("a", "HIGH", 1), ("b", "HIGH", None), ("c", "MEDIUM", 3), ("d", "LOW", 4), ("e", "LOW", 5)], "work_ref string, band string, attach int")
    plan = spark.createDataFrame([("a",), ("d",), ("d",), ("zz",)], "work_ref string")
    tiers = casework.export_tiers(works, plan)
    assert {r.work_ref: r.tier[0] for r in tiers.collect()} == {"a": "1", "d": "1", "b": "2", "c": "3"}
    costs = {r.tier[0]: (r.works, r.with_files, r.slow_hours) for r in casework.tier_costs(tiers, "attach").collect()}
    assert costs == {"1": (2, 2, 0.0), "2": (1, 0, 0.0), "3": (1, 1, 0.0)}
    assert [r.work_ref for r in casework.to_fetch(plan, works, "work_ref", "attach", F.desc("attach")).collect()] == ["d", "a"]


def test_visits_parents_and_steps(spark):
    cases = spark.createDataFrame([("a",), ("b",)], "k string")
    visits = spark.createDataFrame([("a", 1, "x"), ("a", 2, "y"), ("c", 3, "z")], "k string, t int, o string")
    got = {r.k: (r.visits, r.outcome, r.outcomes) for r in casework.with_visits(cases, visits, "k", "o", F.desc("t"), last=1).collect()}
    assert got == {"a": (2, "y", ["y"]), "b": (0, None, [])}
    assert sorted((r.t, r.parent) for r in casework.with_parent(visits, cases, "k").collect()) == [(1, "a"), (2, "a"), (3, None)]
    records = spark.createDataFrame([("me", "p", None, "", 1, "h"), ("anonymous", None, None, "read", 0, ""), (None, None, None, None, None, None)], "actor string, photo string, document string, ocr_text string, readers_agree int, row_hash string")
    assert sorted(r.reached for r in casework.evidence_steps(records).collect()) == [1, 2, 5]


def test_pages_and_lookups(spark):
    d = spark.createDataFrame([("a", "N1", "Road (50%) built", 3.0), ("b", "N1", "ROAD", 5.0), ("c", "N2", None, 9.0), ("d", "N2", "road", 5.0)], "k string, s string, t string, v double")
    page = lambda **kw: [r.k for r in pages.case_page(d, [F.desc("v"), F.asc("k")], **kw).collect()]
    assert page() == ["c", "b", "d", "a"] and page(offset=1, limit=2) == ["b", "d"] and page(equal={"s": "N1"}) == ["b", "a"]
    assert page(part="(50%", texts=("t",)) == ["a"] and page(part="roa", texts=("t", "s")) == ["b", "d", "a"] and page(part="n2", texts=("t", "s")) == ["c", "d"]
    assert pages.in_scope(d, "state", "N2", {"state": "s"}).count() == 2 and pages.in_scope(d, "all", "N2", {"state": "s"}).count() == 4
    wanted = spark.createDataFrame([("a",), ("c",), ("zz",)], "k string")
    got = {r.k: (r.band, r.is_case) for r in pages.looked_up(d, d.where("k = 'a'").select("k", F.lit("HIGH").alias("band")), wanted, "k", {"band": "NONE"}).collect()}
    assert got == {"a": ("HIGH", True), "c": ("NONE", False)}


def test_rows_as_sent(spark):
    cats = spark.createDataFrame([("WS/MP12/2019-2020/7-Roads\nand drains ",), ("WS/MP1/19-20/7-x",), (None,), ("WS/MP1/2019-2020/7- ",)], "a string")
    assert [r.c for r in cats.select(pages.activity_category("a").alias("c")).collect()] == ["Roads\nand drains", "Uncategorised", "Uncategorised", "Uncategorised"]
    people = spark.createDataFrame([(" Ann ", 7), ("ANN", 3), ("", 1), (None, 2)], "n string, i int")
    names = pages.ids_by_name(people, "n", "i")
    assert [tuple(r) for r in names.collect()] == [("ann", 3)]
    raw = spark.createDataFrame([(1, "Ann", None, None, 5, "HOME"), (2, None, "x", "AWAY", 5, "HOME"), (None, "Ann", None, None, 5, "HOME")], "work_id int, owner_name string, activity string, state_name string, sc int, st string")
    assert sorted((r.work_ref, r.state) for r in pages.live_works(raw, names, "sc", "st").collect()) == [("MP3-W1", "HOME"), ("S5-W2", "AWAY")]
    rows = spark.createDataFrame([(1, "0", 1, None), (1, "x", 2, None), (1, "y", 3, 5), (2, "", 1, 1), (None, "x", 1, 1)], "k int, a string, n int, flag int")
    assert [tuple(r) for r in pages.attachment_bearing(rows, "k", "a", F.asc("n")).collect()] == [(1, "x", 2, 1)]


def test_pairs_are_explained_and_kinds_joined(spark):
    p = spark.createDataFrame([(0.9712, True, "S", True, None, False)], "similarity double, same_text boolean, state string, same_seat boolean, same_agency boolean, same_owner boolean")
    assert p.select(pages.pair_sentence()).first()[0] == "texts are 97.12% alike, letter by letter, both in S, the same seat"
    works = spark.createDataFrame([(1, "a"), (2, "b"), (3, None), (4, "zz")], "k int, t string")
    assigned = spark.createDataFrame([("a", 2), ("a", 1), ("b", 9)], "t string, kind int")
    got = {r.k: (r.kind, r.label) for r in pages.kinds_of(works, assigned, spark.createDataFrame([(1, "one")], "kind int, label string"), "t", "kind", "label").collect()}
    assert got == {1: (1, "one"), 2: (9, "Unclassified"), 3: (None, "Unclassified"), 4: (None, "Unclassified")}
