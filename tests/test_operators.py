"""Operators on small literal tables."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from wayledger import config
from wayledger.functions import columns as C
from wayledger.operators import canonical, changes, duplicates, extract, models, peers, planning, reports, series, signals


def rows(df, *cols):
    return sorted(tuple(r) for r in df.select(*cols).collect()) if cols else sorted(map(tuple, df.collect()), key=str)


def test_parsing(spark):
    d = spark.createDataFrame([("03-Jan-2024", "Rs. 1,234.50", " TRUE ", "2.6"), ("x", "1.2.3", "maybe", "y"), (None, None, None, None)], "a string, b string, c string, d string")
    got = d.select(C.parsed_date("a").cast("string"), C.parsed_amount(F.regexp_replace("b", r"^Rs\. ", "")), C.parsed_flag("c"), C.whole_number("d")).collect()
    assert [tuple(r) for r in got] == [("2024-01-03", 1234.5, True, 3), (None, None, None, None), (None, None, None, None)]


def test_unknown_label_raises(spark):
    d = spark.createDataFrame([("Recommended",), ("Lost",)], "stage string")
    with pytest.raises(Exception, match="unknown label"):
        canonical.labelled(d, "stage", {"Recommended": "R"}).collect()


def test_row_counts_must_add_up():
    canonical.checked_counts(5, 3, 2)
    with pytest.raises(ValueError):
        canonical.checked_counts(5, 3, 1, reason="totals")


def test_first_of_does_not_depend_on_partitions(spark):
    d = spark.createDataFrame([(k % 7, k % 5, k) for k in range(100)], "k long, d long, r long")
    one = rows(canonical.first_of(d.repartition(1), ["k"], F.desc("d"), F.desc("r")))
    assert one == rows(canonical.first_of(d.repartition(8), ["k"], F.desc("d"), F.desc("r"))) and len(one) == 7


def test_flags_are_false_where_unknown(spark):
    d = spark.createDataFrame(
        [("a", 0.0, dt.date(2024, 1, 5), dt.date(2024, 1, 1), True, False), ("b", None, None, None, False, False), ("c", 5.0, dt.date(2024, 1, 1), dt.date(2025, 1, 1), True, True)],
        "work_ref string, recommended_amount double, recommendation_date date, completion_date date, is_completed boolean, is_sanctioned boolean",
    )
    got = rows(canonical.flagged(d), "work_ref", "has_nonpositive_amount", "is_backdated", "is_future_dated", "completed_without_sanction")
    assert got == [("a", True, True, False, True), ("b", False, False, False, False), ("c", False, False, True, False)]


def test_back_off_levels(spark):
    d = spark.createDataFrame([("x", "s1")] * 3 + [("x", "s2")] * 2 + [("y", "s2")] + [(None, "s3")], "c string, s string")
    got = dict((tuple(r[:2]), (r[2], r[3])) for r in peers.backed_off(d, [["c", "s"], ["c"], ["s"]], min_peers=3).select("c", "s", "peer_level", "peer_group_size").collect())
    assert got == {("x", "s1"): ("c|s", 3), ("x", "s2"): ("c", 5), ("y", "s2"): ("s", 3), (None, "s3"): ("global", 7)}


def test_percentiles_with_ties_nulls_and_single_rows(spark):
    d = spark.createDataFrame([("g", 1.0), ("g", 2.0), ("g", 2.0), ("g", None), ("h", 5.0)], "g string, v double")
    got = sorted(((r.g, r.v, r.p) for r in peers.leave_one_out_percentile(d, ["g"], "v", "p").collect()), key=str)
    assert got == [("g", 1.0, 0.0), ("g", 2.0, 0.5), ("g", 2.0, 0.5), ("g", None, None), ("h", 5.0, None)]


def test_robust_z_falls_back_to_quartiles_and_zero(spark):
    d = spark.createDataFrame([("a", float(v)) for v in (1, 2, 3, 4, 100)] + [("b", 7.0)] * 3, "g string, v double")
    got = {(r.g, r.v): r.z for r in peers.robust_z(d, ["g"], "v", "z").collect()}
    assert got[("a", 100.0)] == pytest.approx(97 / 1.4826) and got[("b", 7.0)] == 0.0


def test_noisy_or_and_bands(spark):
    d = spark.createDataFrame([(0.95, 10.0, None, 0.7, True, False, False, False, 0.6, True, 0.98, 100.0)],
        "amount_pct double, amount_z double, open_pct double, risk double, is_backdated boolean, completed_without_sanction boolean, is_future_dated boolean, is_orphan boolean, change double, outlier boolean, similarity double, recommended_amount double")
    r = signals.fused(d).first()
    quiet = 1.0
    for k, w in config.DEFAULT.weights:
        quiet *= 1 - w * r[f"sig_{k}"]
    assert r.families == 6 and r.band == "HIGH" and r.priority == pytest.approx(1 - quiet) and r.exposure == pytest.approx(70.0)


@pytest.mark.parametrize("values,trend", [([10] * 8 + [45, 47, 46], "PERSISTENT"), ([1, 2, 3], "INSUFFICIENT"), ([10, 11] * 5, "NORMAL")])
def test_trends(spark, values, trend):
    d = spark.createDataFrame([("e", i, float(v)) for i, v in enumerate(values)], "e string, i int, v double")
    assert series.trends(d, ["e"], "i", "v").first().trend == trend


def test_wilson_ends(spark):
    got = spark.createDataFrame([(0, 20), (20, 20), (0, 0), (5, 10)], "a int, n int").select(*C.wilson("a", "n")).collect()
    assert got[0][0] == pytest.approx(0.0, abs=1e-12) and got[1][1] == pytest.approx(1.0) and tuple(got[2]) == (0.0, 1.0) and got[3][0] == pytest.approx(0.2366, abs=1e-4)


def test_concentration_is_withheld_below_the_floor(spark):
    d = spark.createDataFrame([("a", 1, 10.0)] * 20 + [("b", 1, 1.0)] * 19 + [(" ", 1, 5.0), ("a", None, 5.0), ("a", 2, 0.0)], "who string, v long, m double")
    got = {r.who: (r.hhi, r.band, r.payments) for r in reports.concentration(d, "who", "v", "m").collect()}
    assert got == {"a": (1.0, "CONCENTRATED", 20), "b": (None, None, 19)}


def test_calibration_takes_the_latest_visit(spark):
    v = spark.createDataFrame([(1, "w1", "NOT_FOUND", 1), (2, "w1", "VERIFIED_COMPLETE", 2), (3, "w2", "NOT_FOUND", 1)], "id long, work string, outcome string, created_at long")
    b = spark.createDataFrame([("w1", "HIGH")], "work string, band string")
    got = {r.band: (r.visits, r.confirmed, r.rate) for r in reports.calibration(v, b, "work", ["NOT_FOUND"]).collect()}
    assert got == {"HIGH": (1, 0, None), "NOT SURFACED": (1, 1, None)}


def test_block_pairs_are_symmetric_by_default(spark):
    d = spark.createDataFrame([(1, "x", [1.0, 0.0]), (2, "x", [1.0, 0.01]), (3, "y", [1.0, 0.0]), (4, "x", None)], "k long, b string, v array<double>")
    assert rows(duplicates.block_pairs(d, "k", ["b"], "v"), "a", "b", "class") == [(1, 2, "EXACT")]


def test_image_pairs_miss_none_within_reach(spark):
    import random

    rng = random.Random(3)
    h = [rng.getrandbits(63) for _ in range(30)]
    h += [x ^ sum(1 << b for b in rng.sample(range(63), rng.choice([1, 7, 14, 16]))) for x in h]
    d = spark.createDataFrame([(i, i, x) for i, x in enumerate(h)], "k long, o long, h long")
    want = {(i, j) for i in range(len(h)) for j in range(i + 1, len(h)) if bin(h[i] ^ h[j]).count("1") <= 14}
    assert {(r.a, r.b) for r in duplicates.image_pairs(d, "k", "o", "h", "h").collect()} == want


def test_diff_ignores_number_format_and_empty_text(spark):
    kind = "k string, a string, b string"
    old = spark.createDataFrame([("1", "2999928.0", ""), ("2", "5", "x"), ("4", "1", "1")], kind)
    new = spark.createDataFrame([("1", "2999928", None), ("2", "6", "x"), ("3", "1", "1")], kind)
    assert rows(changes.diffed(old, new, "k", ["a", "b"]), "k", "change_type", F.coalesce("field", F.lit("-")), F.coalesce("new_value", F.lit("-"))) == [("2", "changed", "a", "6"), ("3", "appeared", "-", "-")]
    assert changes.diffed(old, new, "k", ["a", "b"], vanished=True).where("change_type = 'vanished'").count() == 1


def test_hash_chain_faults(spark):
    import hashlib

    log, prev = [], ""
    for i in range(5):
        own = hashlib.sha256(f"{i}|{prev}".encode()).hexdigest()
        log.append((i, prev, own, str(i)))
        prev = own
    check = lambda x: sorted(map(tuple, changes.chain_breaks(spark.createDataFrame(x, "seq long, prev string, own string, body string"), "seq", "prev", "own", F.sha2(F.concat_ws("|", "body", "prev"), 256)).collect()))
    assert check(log) == []
    log[2] = (2, log[2][1], log[2][2], "9")
    assert check(log) == [(2, "edited")]


def plan_rows(spark, works, budget):
    d = spark.createDataFrame([("s", a, f"w{i}", float(e)) for i, (a, e) in enumerate(works)], "state string, agency string, work string, exposure double")
    return [tuple(r) for r in planning.plans(d, "state", [budget], "agency", "exposure", "work").orderBy("plan_order").select("agency", "cost", "spent").collect()]


@pytest.mark.parametrize("budget,n", [(1, 1), (2, 3), (10, 11), (0, 0)])
def test_greedy_plan_keeps_the_budget(spark, budget, n):
    works = [("CLUSTER", 40)] * 8 + [("REMOTE", 90), ("FARAWAY", 85)]
    got = plan_rows(spark, works, float(budget))
    assert all(s <= budget + 1e-9 for _, _, s in got) and sum(c for _, c, _ in got) <= budget + 1e-9
    assert len(got) == min(n, 10) or budget == 2 and len(got) >= 2


def test_rota_keeps_agencies_whole(spark):
    t = spark.createDataFrame([("s", f"a{i}", float(c), 1.0) for i, c in enumerate((5, 3, 3, 2, 1))], "state string, agency string, cost double, exposure double")
    got = planning.rota(t, ["state"], 2).collect()
    loads = {}
    for r in got:
        loads[r.auditor] = loads.get(r.auditor, 0) + r.cost
    assert len(got) == 5 and sorted(loads.values()) == [7.0, 7.0]


def test_near_misses_differ_in_one_digit(spark):
    d = spark.createDataFrame([("MP1-W23",)], "k string")
    known = spark.createDataFrame([("MP1-W24",), ("MP1-W23",), ("MP2-W23",), ("MP2-W24",), ("MP1-W2",)], "r string")
    assert rows(extract.near_misses(d, "k", known, "r"), "match") == [("MP1-W24",), ("MP2-W23",)]


def test_extraction(spark):
    d = spark.createDataFrame([("work MP1O3–W2S and mp 7-w8; cost Rs. 1,50,000 or INR 2.5 lakh",)], "t string")
    r = d.select(extract.references("t").alias("r"), extract.amounts("t").alias("a")).first()
    assert r.r == ["MP103-W25", "MP7-W8"] and r.a == [150000.0, 250000.0]


def test_kaplan_meier(spark):
    d = spark.createDataFrame([("g", 1, 1), ("g", 2, 0), ("g", 3, 1), ("g", 3, 1)], "g string, t int, e int")
    got = {r.day: (r.at_risk, round(r.survival, 4)) for r in models.kaplan_meier(d, ["g"], "t", "e").collect()}
    assert got == {1: (4, 0.75), 2: (3, 0.75), 3: (2, 0.0)}


def test_cox_finds_the_sign(spark):
    import numpy as np

    rng = np.random.default_rng(1)
    x = rng.normal(size=600)
    t = np.ceil(rng.exponential(50 * np.exp(-1.0 * x))).astype(int) + 1
    d = spark.createDataFrame([(float(a), int(b), 1) for a, b in zip(x, t)], "x double, t int, e int")
    assert 0.5 < models.cox(d, ["x"], "t", "e", penalty=0.01)[0] < 1.3


def test_isolation_forest_flags_the_far_point(spark):
    d = spark.createDataFrame([(i, float(i % 10), float(i % 7)) for i in range(300)] + [(999, 500.0, -400.0)], "k long, a double, b double")
    assert models.isolation(d, ["a", "b"], trees=30, contamination=0.01).orderBy(F.desc("score")).first().k == 999


def test_concordance_counts_every_pair(spark):
    rng = random.Random(5)
    rows = [(rng.choice([None, *range(1, 12)]), rng.random() < 0.6, rng.choice([None, -2.5, 0.0, 0.25, 3.0, rng.random()])) for _ in range(150)]
    kept = [r for r in rows if r[0] is not None and r[2] is not None]
    want = [(a[2] > b[2]) + (a[2] == b[2]) / 2 for a in kept if a[1] for b in kept if a[0] < b[0]]
    got = models.concordance(spark.createDataFrame(rows, "t int, e boolean, s double"), "t", "e", "s").first()
    assert got.pairs == len(want) and abs(got.concordance - sum(want) / len(want)) < 1e-12
    none = models.concordance(spark.createDataFrame([], "t int, e boolean, s double"), "t", "e", "s").collect()
    assert [tuple(r) for r in none] == [(0, None)]
