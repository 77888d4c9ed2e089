"""Reports on casework, payments, files and checks, on small rows with nulls, ties, repeats and nothing at all."""

from pyspark.sql import functions as F

from wayledger.operators import portfolio, reports

SIGNALS = ("amount", "duration", "risk", "conformance", "change", "anomaly", "duplicate")


def leads(spark, rows):
    """(work_ref, state, band, fired signal, text, agency) with the columns that evidence reads."""
    d = spark.createDataFrame(rows, "work_ref string, state_name string, band string, fired string, work_description string, implementing_agency string, exposure double, is_open int, recommended_amount double")
    d = d.withColumns({f"sig_{s}": F.when(F.col("fired") == s, 0.5).otherwise(0.0) for s in SIGNALS})
    return d.withColumns({c: F.lit(None).cast("double") for c in ("amount_pct", "open_pct", "risk", "change", "similarity")})


ROWS = [
    ("a", "X", "HIGH", "amount", "New ROAD 100%", "p/1", 5.0, 1, 10.0), ("b", "X", "MEDIUM", "risk", None, "Roads", 1.0, 0, 20.0), ("c", "Y", "LOW", "amount", "road", "r", 9.0, 1, None), ("d", None, "MEDIUM", "amount", "well", None, None, 1, 40.0),
]


def test_worklist_filters_take_text_literally(spark):
    d = leads(spark, ROWS)
    got = lambda **kw: sorted(r.work_ref for r in portfolio.worklist(d, **kw).collect())
    assert got() == ["a", "b", "d"]
    assert got(part="road") == ["a", "b"] and got(part="100%") == ["a"] and got(part="1_0") == []
    assert got(signal="amount") == ["a", "d"] and got(signal="nothing") == []
    assert got(equal={"state_name": "X", "band": "MEDIUM"}, signal="risk", part="ROAD") == ["b"]


def test_scopes_and_baselines(spark):
    d = leads(spark, ROWS)
    assert {r.state_name: tuple(r)[1:] for r in portfolio.scope_totals(d, "state_name").collect()} == {"X": (2, 6.0, 1, 1), "Y": (0, 0.0, 0, 0), None: (1, 0.0, 0, 1)}
    assert tuple(portfolio.baselines(d).first()) == (4, 0.75, 0.75, 20.0)
    assert tuple(portfolio.baselines(d.where("false")).first()) == (0, 0.0, 0.0, 0.0)
    assert [tuple(r) for r in portfolio.first_states(d.withColumn("implementing_agency", F.lit("g"))).collect()] == [("g", 4, 70.0, 15.0, "X")]


def test_bands_in_order(spark):
    judged = lambda rows: tuple(portfolio.band_ordering(spark.createDataFrame(rows, "band string, rate double, low double, high double"), ("HIGH", "MEDIUM", "LOW")).first())
    high, mid, low = ("HIGH", .9, .8, .95), ("MEDIUM", .5, .4, .6), ("LOW", .2, .1, .3)
    assert judged([low, high, mid]) == (3, True, True, True)
    assert judged([("HIGH", .9, .5, .95), mid]) == (2, True, True, False)
    assert judged([("HIGH", .5001, .4, .6), ("MEDIUM", .5004, .4, .6)]) == (2, True, True, False)
    assert judged([("HIGH", .1, .0, .2), ("LOW", .2, .1, .3)]) == (2, True, False, False)
    assert judged([high, ("MEDIUM", None, .0, 1.), ("OTHER", .1, .0, .2)]) == (1, False, None, None)
    assert judged([]) == (0, False, None, None)


def test_outcomes_lateness_and_stages(spark):
    visits = spark.createDataFrame([("ok", 1, False), ("ok", 1, None), ("ok", 2, True), ("bad", 3, True), (None, 4, False)], "o string, w int, demo boolean")
    assert {r.outcome: tuple(r)[1:] for r in portfolio.outcome_counts(visits, "o", "w", "demo").collect()} == {"ok": (2, 1, 1), "bad": (0, 0, 1), None: (1, 1, 0)}
    cases = spark.createDataFrame(
        [("New", "2024-01-01", None, 5.0), ("New", "2024-01-10", "x", 7.0), ("New", None, None, 1.0), ("Seen", "2024-01-05", "x", None), ("Done", "2023-01-01", None, 9.0), (None, "2023-01-01", None, 9.0)],
        "stage string, review_due string, moved_at string, exposure double",
    )
    as_of = F.lit("2024-01-10").cast("date")
    assert tuple(portfolio.lateness(cases, ("New", "Seen"), as_of).first()) == (6, 4, 2, 5.0, 2, 9, "late")
    assert portfolio.lateness(cases.where("moved_at IS NULL"), ("New",), as_of).first().reading == "first day"
    assert portfolio.lateness(cases.where("stage = 'Done'"), ("New",), as_of).first().reading == "none late"
    assert tuple(portfolio.lateness(cases.where("false"), ("New",), as_of).first()) == (0, 0, 0, 0.0, 0, 0, "none late")
    table = {r.stage: (r.place, r.cases, r.exposure) for r in portfolio.stage_table(cases, ("New", "Seen", "Shut")).collect()}
    assert table == {"New": (1, 3, 13.0), "Seen": (2, 1, 0.0), "Shut": (3, 0, 0.0), "OTHER": (4, 2, 18.0)}


def test_vendors(spark):
    rows = [("A", v, float(p)) for v, p in ((1, 50), (1, 10), (2, 30), (3, 30), (4, 5))] * 6 + [("B", 1, 1.0), ("B", None, 9.0), ("B", 2, -1.0), ("B", 2, 0.0), (" ", 1, 4.0), (None, 1, 4.0), ("C", None, 3.0)]
    d = spark.createDataFrame(rows, "by string, v int, amount double")
    assert {r.reason: (r.payments, r.amount) for r in portfolio.unusable(d, "by", "v", "amount").collect()} == {"usable": (31, 751.0), "no authority": (2, 8.0), "no vendor": (2, 12.0), "no amount": (2, -1.0)}
    got = {r.by: r for r in portfolio.vendor_lists(d, "by", "v", "amount", most=3).collect()}
    assert [(x.vendor, x.paid) for x in got["A"].listed] == [(1, 360.0), (2, 180.0), (3, 180.0)] and got["A"].listed[0].share == 360 / 750
    assert (got["A"].vendors, got["A"].paid, got["A"].top_vendor, got["A"].withheld, got["B"].withheld, set(got)) == (4, 750.0, 1, None, "only 1 payments", {"A", "B"})
    hhi = {r.by: r for r in reports.concentration(d, "by", "v", "amount").collect()}
    assert abs(hhi["A"].hhi - (360**2 + 2 * 180**2 + 30**2) / 750**2) < 1e-12 and hhi["A"].top3_share == 720 / 750 and hhi["A"].percentile == .5 and hhi["B"].hhi is None and hhi["B"].percentile is None
    counts = {r.band: (r.authorities, r.payments) for r in portfolio.band_counts(reports.concentration(d, "by", "v", "amount")).collect()}
    assert counts == {"CONCENTRATED": (1, 30), "MODERATE": (0, 0), "SPREAD": (0, 0), "WITHHELD": (1, 1)}
    assert reports.concentration(d.where("false"), "by", "v", "amount").count() == 0 and portfolio.vendor_lists(d.where("false"), "by", "v", "amount").count() == 0


def test_shares_of_tied_authorities(spark):
    """Two equal and one greater index: the share below, and half of the equal ones."""
    rows = [(a, v, 1.0) for a, n in (("p", 4), ("q", 4), ("r", 2)) for v in range(n) for _ in range(20)]
    got = {r.by: r.percentile for r in reports.concentration(spark.createDataFrame(rows, "by string, v int, amount double"), "by", "v", "amount").collect()}
    assert got == {"p": 1 / 3, "q": 1 / 3, "r": 2.5 / 3}


def test_manifest_of_files_read(spark, tmp_path):
    for name, rows in (("one", '{"id": "1", "at": "7", "s": "X"}\n{"id": "1", "at": null, "s": "Y"}\n{"id": "", "at": "8", "s": ""}\n{"id": "2", "at": "0", "s": "X"}'), ("two", '{"id": null, "at": "7", "s": null}')):
        (tmp_path / f"{name}.json").write_text(rows)
    d = spark.read.schema("id string, at string, s string").json(str(tmp_path)).withColumn("file", F.col("_metadata.file_name"))
    got = {r.file: tuple(r)[1:] for r in portfolio.file_manifest(d, "file", "id", "at", "s").collect()}
    assert got == {"one.json": (4, 2, 1, 2, ["X", "Y"]), "two.json": (1, 0, 0, 0, None)}


def test_coverage_and_shared_contents(spark):
    works = spark.createDataFrame([(1,), (1,), (2,), (3,), (None,)], "k int")
    files = spark.createDataFrame([(1, "h", 10), (1, "h", 10), (2, None, 5), (9, "i", 1), (None, "j", 2)], "k int, h string, n int")
    got = portfolio.evidence_coverage(works, files, "k", "h", "n").first().asDict()
    assert got == {"works": 3, "with_files": 2, "files": 5, "indexed": 4, "bytes": 28, "of_unknown_works": 2, "contents": 3, "covered": 2 / 3, "indexed_share": .8}
    nothing = portfolio.evidence_coverage(works.where("false"), files.where("false"), "k", "h", "n").first()
    assert (nothing.works, nothing.files, nothing.covered, nothing.indexed_share) == (0, 0, None, None)
    held = spark.createDataFrame([("h", o) for o in (3, 1, 2, 2, None)] + [("i", 1), ("i", 1), (None, 1), (None, 2), ("j", 5), ("j", 4)], "h string, o int")
    assert [(r.digest, r.owners, r.files, r.listed) for r in sorted(portfolio.shared_contents(held.withColumnRenamed("h", "digest"), "digest", "o", listed=2).collect())] == [("h", 3, 5, [1, 2]), ("j", 2, 2, [4, 5])]


def test_all_raw_rows_are_accounted_for(spark):
    raw = spark.createDataFrame([("a", False), ("a", False), ("a", True), ("b", None), ("c", True), (None, False), (None, True)], "k string, s boolean")
    got = {r.reason: r["count"] for r in portfolio.grain_report(raw, "k", F.col("s")).collect()}
    assert got == {"raw": 7, "summary rows": 3, "rows without a key": 1, "collapsed into one row a work": 1, "works": 2}
    assert got["raw"] == sum(v for k, v in got.items() if k != "raw")
    assert {r["count"] for r in portfolio.grain_report(raw.where("false"), "k", F.col("s")).collect()} == {0}


def test_freshness_activity_counts_and_ratios(spark):
    seen = spark.createDataFrame([("a", "2024-01-01 00:00:00"), ("a", "2024-01-01 00:01:00"), ("b", "2024-01-01 00:00:30"), ("c", None), ("d", "2024-01-01 00:00:30")], "s string, at string")
    got = [(r.s, r.checks, r.seconds, r.place) for r in portfolio.scope_freshness(seen, "s", "at", F.lit("2024-01-01 00:02:00")).orderBy("place").collect()]
    assert got == [("c", 1, None, 1), ("b", 1, 90, 2), ("d", 1, 90, 3), ("a", 2, 60, 4)]
    done = spark.createDataFrame([("ok", 1, 5), ("ok", 2, 5), ("ok", 2, 3), (None, 7, None)], "o string, w int, t int")
    assert {r.o: tuple(r)[1:] for r in portfolio.activity(done, "o", "w", "t").collect()} == {"ok": (3, 2, 3, 5, 2), None: (1, 1, None, None, None)}
    assert {r.table: (r.rows, r.last) for r in portfolio.table_counts({"x": (done, "t"), "y": (done.where("false"), "t")}).collect()} == {"x": (4, "5"), "y": (0, None)}
    ratios = spark.createDataFrame([(1.0,), (1.0005,), (2.0,), (None,)], "ratio double")
    assert portfolio.ratio_summary(ratios).first().asDict() == {"keys": 4, "compared": 3, "share_within": 2 / 3, "median_ratio": 1.0005}


def test_withheld_rates_come_last(spark):
    d = spark.createDataFrame([("x", 1, .2, 5.0), ("x", 2, None, 99.0), ("y", 1, .2, 7.0), ("y", 2, None, None)], "s string, t int, lead_rate double, exposure double")
    assert [(r.s, r.t) for r in portfolio.placed(d, "s", "t").orderBy("place").collect()] == [("y", 1), ("x", 1), ("x", 2), ("y", 2)]
