"""Summaries and ranks on small literal tables."""

from pyspark.sql import functions as F

from wayledger.operators import ordering, summaries


def test_ranked_equals_plain_order_over_many_ranges(spark):
    d = spark.range(5000).select(F.col("id"), (F.xxhash64("id") % 97).alias("v")).repartition(16)
    got = {r.id: r.place for r in ordering.ranked(d, "place", F.desc("v"), F.asc("id")).collect()}
    want = sorted(((-r.v, r.id) for r in d.collect()))
    assert got == {i: k for k, (_, i) in enumerate(want, 1)}


def test_ranked_of_nothing_and_of_equal_values(spark):
    d = spark.range(300).withColumn("v", F.lit(1))
    assert ordering.ranked(d.where("id < 0"), "place", F.asc("v"), F.asc("id")).count() == 0
    assert [r.place for r in ordering.ranked(d, "place", F.asc("v"), F.asc("id")).orderBy("id").collect()] == list(range(1, 301))


def test_three_way_lists_scopes_of_any_side(spark):
    own = spark.createDataFrame([("a", 3, 10.0), ("b", 1, 5.0)], "k string, own_count long, own_sum double")
    totals = spark.createDataFrame([("a", 10.0), ("c", 7.0)], "k string, grand_total double")
    tiles = spark.createDataFrame([("a", 4, 10.4), ("c", 2, 9.0)], "k string, tile_count long, tile_amount double")
    found = summaries.three_way(own, totals, tiles, ["k"])
    got = {r.k: (r.sum_matches, r.total_matches_tile, r.count_matches_tile) for r in found.collect()}
    assert got == {"a": (True, True, False), "b": (None, None, None), "c": (None, False, None)}
    assert {r.k: r.failed for r in summaries.mismatches(found).collect()} == {"a": 1, "c": 1}


def test_escalation_by_exposure_and_band(spark):
    d = spark.createDataFrame([(1, 5e7, "HIGH"), (2, 5e6, "MEDIUM"), (3, None, "LOW"), (4, 1.0, None)], "i int, exposure double, band string")
    out = summaries.escalated(d, F.lit("2024-01-01").cast("date"))
    assert [(r.tier, str(r.review_due)) for r in out.orderBy("i").collect()] == [
        ("Ministry Review", "2024-01-08"), ("State Nodal", "2024-01-29"), ("District Monitoring", "2024-03-31"), ("District Monitoring", "2024-03-01"),
    ]


def test_readiness_counts_unmarked_visits_as_real(spark):
    d = spark.createDataFrame([("w1", "X", None), ("w1", "OK", False), ("w2", "X", True)], "work string, outcome string, demo boolean")
    r = summaries.label_readiness(d, ["X"], target=3).first()
    assert (r.visits, r.works, r.demo_excluded, r.confirmed, r.labels_needed, r.ready) == (2, 1, 1, 1, 1, False)


def test_reasons_name_only_what_fired(spark):
    d = spark.createDataFrame(
        [(1, 1, 2.25, 0.125, "S", "LOW"), (2, 1, 1.1, 0.455, "S", "HIGH"), (3, 1, None, 0.1, "S", "LOW"), (4, 0, 9.0, 0.9, "S", "LOW")],
        "i int, is_open int, stall_ratio double, risk double, state_name string, warning_level string",
    )
    got = [r[0] for r in d.orderBy("i").select(summaries.warning_reason()).collect()]
    assert got[0] == "LOW: open 2.2 times as long as usual in S" and got[2:] == ["in its usual range", "completed"]
    assert got[1].startswith("HIGH: risk of 4")


def test_total_line_keeps_rates_below_the_floor(spark):
    d = spark.createDataFrame([("x", "HIGH", 1.0, "a"), ("x", "NONE", 3.0, "b"), ("y", "LOW", 2.0, "a")], "s string, band string, exposure double, implementing_agency string")
    got = {r.s: (r.works, r.high_rate, r.agencies) for r in summaries.with_total(d, "s", "ALL", 2).collect()}
    assert got == {"x": (2, 0.5, 2), "y": (1, None, 1), "ALL": (3, 1 / 3, 2)}


def test_drill_down_withholds_rates_and_names_the_first(spark):
    d = spark.createDataFrame([("s", "w2", "n2", "HIGH", 1.0, "a"), ("s", "w1", None, "LOW", 1.0, "a")], "k string, work_ref string, n string, band string, exposure double, implementing_agency string")
    r = summaries.drill_down(d, ["k"], "n").first()
    assert (r.works, r.high_rate, r.rate_withheld, r.first_name) == (2, None, True, "n2")


def test_content_reuse_and_coverage(spark):
    d = spark.createDataFrame([(1, "k", "h", 2), (2, "k", "h", 2), (2, "k", "g", 1), (3, "k", None, None)], "o int, kind string, h string, b long")
    assert [tuple(r) for r in summaries.equal_content(d, "h", "o").collect()] == [("h", 2, 2, 1, 2)]
    r = summaries.coverage(d, "kind", "h", "b").first()
    assert (r.entries, r.with_content, r.contents, r.duplicates, r.bytes) == (4, 3, 2, 1, 5)
