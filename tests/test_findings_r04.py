"""What the findings of round 4 named: numbers as C prints them, pairs of blocks, near misses, pictures."""

import os
import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from wayledger import adapters
from wayledger.functions import columns
from wayledger.operators import duplicates, extract, submissions, summaries
from wayledger.plans import leads
from wayledger.sources import tables

SMALL = "/root/testdata/sf0.001"


@pytest.mark.parametrize("places", [0, 1, 2])
def test_numbers_are_printed_by_their_exact_value(spark, places):
    rng = random.Random(places)
    values = [1.95, 2.15, 0.25, 0.35, 50000.5, 50001.5, 1.235, 1.005, 0.0, -2.5, -0.06, 1e11 + 0.5, 3e15, 0.5, 99999.5, 999999.995]
    values += [round(rng.uniform(0, 10 ** rng.randrange(1, 7)), places) + 0.5 * 10**-places for _ in range(3000)]
    got = spark.createDataFrame([(v,) for v in [*values, None]], "x double").select("x", columns.printed("x", places).alias("s")).collect()
    assert {r.s for r in got if r.x is None} == {None}
    assert [(r.x, r.s) for r in got if r.x is not None and r.s != f"{r.x:.{places}f}"] == []


def test_warning_reason_rounds_the_double_not_its_decimal(spark):
    d = spark.createDataFrame([(1, 1.95, 0.0, "LOW", "S"), (1, 2.25, 0.0, "LOW", "S"), (1, 1.65, 0.5, "LOW", "S")], "is_open int, stall_ratio double, risk double, warning_level string, state_name string")
    said = [r.said for r in d.select(summaries.warning_reason().alias("said")).collect()]
    assert [x.split()[2] for x in said] == ["1.9", "2.2", "1.6"] == [f"{v:.1f}" for v in (1.95, 2.25, 1.65)]


def plain_pairs(rows, least, k):
    """(a, b) of unit vectors of a block, each among the other's or its own ``k`` most similar, with sums in the order of places."""
    out = set()
    for a, of, v in rows:
        near = []
        for b, other, w in rows:
            if a != b and of == other and of is not None and v and w and len(v) == len(w) and None not in v + w:
                s = 0.0
                for x, y in zip(v, w):
                    s += x * y
                if s >= least:
                    near.append((-round(s, 12), b))
        out |= {(min(a, b), max(a, b)) for _, b in sorted(near)[:k]}
    return out


@pytest.mark.parametrize("doubles, keyed", [(1 << 19, int), (64 * 6, int), (64 * 6, "k{:03d}".format)])
def test_blocks_in_tiles_equal_all_pairs(spark, doubles, keyed):
    rng = random.Random(7)
    unit = lambda v: [x / sum(y * y for y in v) ** 0.5 for x in v]
    rows = [(keyed(i), rng.choice(["x", "x", "x", "y", None]), unit([rng.gauss(0, 1) for _ in range(6)])) for i in range(400)]
    rows += [(keyed(400 + i), "x", rows[0][2]) for i in range(30)] + [(keyed(500 + i), f"b{i // 2}", unit([1.0, i % 2])) for i in range(60)]  # copies; small blocks
    rows += [(keyed(600), "x", unit([1.0, 2.0])), (keyed(601), "x", unit([1.0, 2.1])), (keyed(602), "x", [None, *rows[0][2][1:]]), (keyed(603), "y", [])]
    d = spark.createDataFrame(rows, f"a {'long' if keyed is int else 'string'}, _b0 string, va array<double>")
    near = duplicates._near_in_blocks(d, ["_b0"], 0.7, 3, doubles)
    place = F.row_number().over(Window.partitionBy("a").orderBy(F.desc(F.round("_s", 12)), "b"))
    got = {(min(r.a, r.b), max(r.a, r.b)) for r in near.withColumn("p", place).where("p <= 3").collect()}
    assert got == plain_pairs(rows, 0.7, 3) and len(got) > 300


def test_tiles_pass_on_only_each_rows_first(spark):
    d = spark.range(3000).select(F.col("id").alias("a"), F.lit(1).alias("_b0"), F.array(F.lit(0.6), F.lit(0.8)).alias("va"))
    near = duplicates._near_in_blocks(d, ["_b0"], 0.9, 5, 2000)  # three tiles
    assert near.count() == 3000 * 5 * 3
    assert duplicates.block_pairs(d, "a", ["_b0"], "va").count() == 5 * 2999 - 10  # copies: 0 to 4 with all, and 5 with 0 to 4


def test_near_misses_equal_plain_python_and_shuffle_a_row_a_digit(spark):
    rng = random.Random(11)
    keys = [f"{rng.choice(['MP', 'é7', '', '??'])}{rng.randrange(60)}-W{rng.randrange(300):03d}" for _ in range(900)] + ["", "7", "8", "a", None]
    asked, known = keys[:600] + keys[:50] + ["7"], keys[300:] + keys[300:340] + ["9"]
    d, k = (spark.createDataFrame([(x,) for x in v], "k string") for v in (asked, known))
    got = extract.near_misses(d, "k", k, "k")
    differ = lambda a, b: [(x, y) for x, y in zip(a, b) if x != y]
    one = lambda a, b: len(a) == len(b) and len(p := differ(a, b)) == 1 and "".join(p[0]).isdigit()
    assert sorted(map(tuple, got.collect())) == sorted({(a, b) for a in asked if a for b in known if b and one(a, b)})
    assert sorted(map(tuple, extract.near_misses(d, "k", k, "k", 4).collect())) == sorted(map(tuple, got.collect()))
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan and plan.count("Aggregate") == 1  # before: a row for each digit and each value, made distinct, then joined


def test_settled_keeps_one_table_and_drops_those_on_the_way(spark):
    there = lambda d: os.path.isdir(d.rpartition("/")[0].removeprefix("file:").replace("///", "/"))
    seen = []

    def inner():
        seen.append(tables.stored(spark.range(5)).inputFiles()[0])
        return spark.read.parquet(seen[0].rpartition("/")[0]).withColumn("x", F.col("id") + 1)

    def outer():
        first = tables.settled(spark, inner)
        seen.append(first.inputFiles()[0])
        assert not there(seen[0]) and there(seen[1])
        kept = tables.settled(spark, lambda: spark.range(3), last=True)
        seen.append(kept.inputFiles()[0])
        return first.where("x > 2")

    out = tables.settled(spark, outer, last=True)
    assert [there(f) for f in seen] == [False, False, True]
    assert sorted(r.x for r in out.collect()) == [3, 4, 5] and not tables._scopes.open
    with pytest.raises(ZeroDivisionError):
        tables.settled(spark, lambda: seen.append(tables.stored(spark.range(1)).inputFiles()[0]) or 1 / 0)
    assert not there(seen[3]) and not tables._scopes.open


def test_near_misses_of_submissions_in_rounds(spark, monkeypatch):
    rows = [(f"MP{i % 9}-W{i}", f"MP{i % 9}-W{i + i % 2}", None, 1.0) for i in range(200)]
    sent = spark.createDataFrame(rows, "read_ref string, other_ref string, typed_ref string, stated double")
    works = spark.createDataFrame([(r[0], 1.0) for r in rows], "work_ref string, recommended_amount double")
    want = sorted(map(str, submissions.identified(sent, works).collect()))
    calls = []
    monkeypatch.setattr(submissions, "EACH_ROUND", 300)
    monkeypatch.setattr(submissions, "near_misses", lambda *a: calls.append(a[-1]) or extract.near_misses(*a))
    assert sorted(map(str, submissions.identified(sent, works).collect())) == want and calls[0] > 1


def test_risk_at_the_horizon_and_texts_need_no_planes(spark, monkeypatch):
    def never(*_):
        raise AssertionError

    monkeypatch.setattr(adapters, "modelled", never)
    monkeypatch.setattr(duplicates, "_near_by_planes", never)
    assert leads.horizon_risk(spark, SMALL).where("risk < 0 or risk > 1 or risk is null").isEmpty()
    assert leads.horizon_risk(spark, SMALL).count() == adapters.conformed(spark, SMALL).count()
    assert leads.similar_texts(spark, SMALL).count() > 0


@pytest.mark.parametrize("most, bands", [(14, 5), (14, 4), (12, 3)])
def test_pictures_in_bands_one_after_another(spark, monkeypatch, most, bands):
    rng = random.Random(bands)
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    flip = lambda x, n: x ^ sum(1 << b for b in rng.sample(range(64), n))
    base = [(rng.getrandbits(64), rng.getrandbits(64)) for _ in range(8)]
    rows = [(i, rng.choice("xyz"), *(flip(h, rng.randrange(0, 12)) for h in base[i % 8])) for i in range(100)] + [(7, "w", *base[7]), (7, "v", *base[7])]  # a key of three owners
    d = spark.createDataFrame([(k, o, signed(p), signed(q)) for k, o, p, q in rows], "k long, o string, p long, q long")
    monkeypatch.setattr(duplicates, "NAMED_AT_ONCE", 0)
    got = sorted((r.a, r.b, r.distance) for r in duplicates.image_pairs(d, "k", "o", "p", "q", most, bands).collect())
    far = lambda x, y: max((x[2] ^ y[2]).bit_count(), (x[3] ^ y[3]).bit_count())
    assert got == sorted((x[0], y[0], far(x, y)) for x in rows for y in rows if x[0] < y[0] and x[1] != y[1] and far(x, y) <= most) and len(got) > 50


def test_pictures_are_made_in_one_shuffle(spark):
    plan = adapters.pictures(spark, SMALL)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1
