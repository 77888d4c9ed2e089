"""Records and the smaller operators, on literal rows."""

import datetime
import json

import pytest
from pyspark.sql import functions as F

from wayledger.functions import columns as C
from wayledger.operators import canonical, changes, models, planning, summaries
from wayledger.sources import files, records


def rows(df, *cols):
    return sorted((tuple(r) for r in (df.select(*cols) if cols else df).collect()), key=str)


def test_findings_under_many_headers(spark, tmp_path):
    (tmp_path / "f.csv").write_text('﻿Work Ref,Result,Remarks\nMP1-W1,Verified,"ok, ""seen"""\nMP1-W2,nonsense,\nMP1-W3,,x\n,NOT FOUND,y\n', encoding="utf-8")
    found, unknown = records.findings(spark, str(tmp_path / "f.csv"), {"work": ["work_ref", "Work Ref"], "outcome": ["Outcome", "result"], "notes": ["Remarks"], "by": ["Officer"]}, "outcome", {"verified": "OK", "Not Found": "NOT_FOUND"})
    assert rows(found) == [("MP1-W1", "OK", 'ok, "seen"', None), (None, "NOT_FOUND", "y", None)] and rows(unknown) == [("nonsense", 1)]


def test_tiles(spark, tmp_path):
    (tmp_path / "s7_h1_t18").mkdir()
    (tmp_path / "s7_h1_t18/x.json").write_text(json.dumps({"works": ["1,200", "34.5"], "total": "99", "empty": []}))
    got = records.tile_numbers(records.tiles(spark, str(tmp_path)))
    assert rows(got, "state_id", "house", "tenure_id", "tile", "count", "amount") == [(7, 1, 18, "empty", None, None), (7, 1, 18, "total", None, 99.0), (7, 1, 18, "works", 1200, 34.5)]


def test_cases_are_overlaid(spark):
    cases = spark.createDataFrame([("a", "NEW", "f0"), ("b", "NEW", None)], "k string, stage string, finding string")
    stages = spark.createDataFrame([("a", 1, "OPEN", "f1"), ("a", 2, "DONE", ""), ("z", 3, "DONE", "")], "k string, t int, stage string, finding string")
    evidence = spark.createDataFrame([("a", "p2"), ("a", "p1"), ("z", "p9")], "k string, file string")
    got = records.overlaid(cases, stages, evidence, "k", "t", ["stage", "finding"])
    assert sorted((r.k, r.stage, r.finding, [e.file for e in r.evidence]) for r in got.collect()) == [("a", "DONE", "f0", ["p1", "p2"]), ("b", "NEW", None, [])]
    assert got.columns == ["k", "stage", "finding", "evidence"]


def test_documents_out(spark, tmp_path):
    one = spark.range(5).agg(F.count("*").alias("n"), F.max("id").alias("most"))
    assert json.loads(records.write_document(one, str(tmp_path / "d"))) == {"n": 5, "most": 4} and spark.read.json(str(tmp_path / "d")).first().n == 5
    with pytest.raises(ValueError):
        records.write_document(spark.range(2), str(tmp_path / "e"))
    nested = spark.createDataFrame([(1, [("x", 2)])], "k int, l array<struct<a:string,b:int>>")
    files.write_documents(nested, str(tmp_path / "n"))
    assert spark.read.json(str(tmp_path / "n")).first().l[0].a == "x"


def test_manifests_references_and_separators(spark, tmp_path):
    (tmp_path / "m.jsonl").write_text('{"kind":"file","attach_id":"1"}\n{"kind":"file","attach_id":"1"}\n{"kind":"page","attach_id":"2"}\n')
    assert rows(files.manifest(spark, str(tmp_path / "m.jsonl"), "file"), "attach_id", "stage") == [("1", None)]
    (tmp_path / "ref_12.json").write_text('[{"CAPTION":"A"},{"CAPTION":"A"},{"CAPTION":"B"}]')
    assert rows(files.references(spark, str(tmp_path / "ref_12.json"), r"ref_(\d+)", ["CAPTION"]), "CAPTION", "id") == [("A", 12), ("B", 12)]
    (tmp_path / "s.csv").write_text("a;b\n1;2\n3;4\n")
    assert rows(files.csv(spark, str(tmp_path / "s.csv"), ["a", "b"], sep=";", index=True), "a", "b", "raw_row_index") == [("1", "2", 0), ("3", "4", 1)]


def test_row_numbers_are_those_of_each_file(spark, tmp_path):
    for f in ("x", "y", "z"):
        (tmp_path / f"{f}.csv").write_text("a\n" + "".join(f'"{f}\n{i}"\n' for i in range(50)))
    d = files.csv(spark, str(tmp_path), ["a"], index=True)
    assert {(r.source_file, r.a, r.raw_row_index) for r in d.collect()} == {(f"{f}.csv", f"{f}\n{i}", i) for f in "xyz" for i in range(50)}


def test_casting_and_grains(spark):
    raw = spark.createDataFrame([("1", "2.5", "true", "03-Jan-2020"), ("x", "", " FALSE", "2020"), (None, None, "?", None)], "a string, b string, c string, d string")
    cast = canonical.typed(raw, ["a"], ["b"], ["c"], ["d"])
    assert rows(cast) == sorted([(1, 2.5, True, datetime.date(2020, 1, 3)), (None, None, False, None), (None, None, None, None)], key=str)
    assert dict(rows(canonical.uncastable(raw, cast.withColumn("d", F.col("d").cast("string")).select(*[F.col(c).cast("string") for c in "abcd"]), ["a", "d"]))) == {"a": 1, "d": 1}
    whole, rest = canonical.split_grain(raw, "a")
    assert (whole.count(), rest.count()) == (2, 1) and canonical.without_banned(raw, {"a", "zz"}).columns == ["b", "c", "d"]
    named = spark.createDataFrame([(7, 5, "a \n b  c", 0.98, 123456.0), (7, None, "x" * 10, 0.5, 2e7)], "o int, s int, t string, x double, m double")
    got = named.select(C.surrogate("MP", "o", "s").alias("k"), C.flattened("t", 6).alias("t"), C.duplicate_class("x").alias("c"), C.money("m").alias("m"))
    assert [tuple(r) for r in got.collect()] == [("MP7-W5", "a b c", "NEAR_EXACT", "1.23 lakh"), (None, "xxxxx…", "NORMAL", "2.00 crore")]


def test_scopes_fingerprints_and_due_checks(spark):
    d = spark.createDataFrame([("a", 1, None), ("b", 1, 2), ("c", 1, 2)], "scope string, x int, y int").withColumn("f", changes.fingerprint("x", "y"))
    prints = [r.f for r in d.orderBy("scope").collect()]
    assert len(set(prints)) == 2 and all(len(p) == 64 for p in prints)
    known = d.withColumn("f", F.when(F.col("scope") == "b", "old").otherwise(F.col("f")))
    assert rows(changes.moved_scopes(d, known.where("scope <> 'c'"), "scope", "f"), "scope") == [("b",), ("c",)]
    checks = spark.createDataFrame([("cold", t, "p") for t in range(14)] + [("cold6", t, "p") for t in range(19)] + [("new", 0, "p"), ("new", 1, "q")], "s string, t int, p string")
    got = {r.s: (r.unchanged, r.is_due, r.changes) for r in changes.watermarks(checks, "s", "t", "p").collect()}
    assert got == {"cold": (13, False, 0), "cold6": (18, True, 0), "new": (0, True, 1)}
    freshness = changes.freshness(spark.createDataFrame([("a", datetime.datetime(2024, 1, 1)), ("b", datetime.datetime(2024, 1, 2))], "s string, t timestamp"), "s", "t", F.lit("2024-01-03 00:00:00")).first()
    assert (freshness.scopes, freshness.since_last, freshness.since_oldest) == (2, 86400, 172800)


def test_walks_and_recalls(spark):
    d = spark.createDataFrame([("s", "a", "w1", 5.0, 1.0), ("s", "b", "w2", 9.0, 3.0), ("s", "a", "w3", 2.0, 2.0)], "st string, ag string, w string, e double, o double")
    got = planning.walked(d, "st", {"o": "o", "e": "e"}, 2.0, "ag", "e", "w").collect()
    assert {r.strategy: (r.works, r.agencies, r.covered) for r in got} == {"o": (2, 2, 11.0), "e": (2, 2, 14.0)}
    s = spark.createDataFrame([("w1", "x", 0.9), ("w2", None, 0.8), ("w3", "x", 0.1), ("w4", "y", 0.0)], "w string, planted string, p double")
    assert {r.planted: (r.total, r.found) for r in models.recall_at(s, "w", "p", 2).collect()} == {"x": (2, 1), "y": (1, 0)}


def test_clusters_and_summaries(spark):
    v = spark.createDataFrame([(i, [float(i % 2) * 10 + i * 0.01, 1.0]) for i in range(40)], "k int, v array<double>")
    found, best, scores = models.clustered(v, "v", [2, 5])
    assert best == 2 and scores[2] > scores[5] and found.groupBy("cluster").count().count() == 2 and found.where("k % 2 = 0").select("cluster").distinct().count() == 1
    w = spark.createDataFrame(
        [("w1", "a", "s1", 10.0, 1, 0, 5, "HIGH", 2.0), ("w2", "a", "s2", 30.0, 0, 1, 9, "NONE", 0.0), ("w3", None, "s1", None, 1, 0, 7, "MEDIUM", 1.0)],
        "work_ref string, kind string, state_name string, recommended_amount double, is_completed int, is_open int, duration_days int, band string, exposure double",
    ).withColumns({"mp_id": F.lit(1), "implementing_agency": F.lit("x")})
    n = summaries.national(w).first()
    assert (n.works, n.completed, n.open, n.states, n.leads, n.band_high, n.band_none, n.amount) == (3, 2, 1, 2, 2, 1, 1, 40.0)
    a = summaries.archetypes(w, "kind").first()
    assert (a.kind, a.works, a.median_amount, a.median_days, a.completion_rate, a.top_state) == ("a", 2, 20.0, 5.0, 0.5, "s1")
    o = summaries.per_owner(spark.createDataFrame([("a", 1.0), ("a", 2.0), ("b", 7.0)], "o string, v double"), "o", "v").first()
    assert (o.owners, o.mean_items, o.most_items, o.mean_value, o.median_value) == (2, 1.5, 2, 5.0, 5.0)
