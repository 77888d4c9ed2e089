"""Labels, questions, readers, flags and the planted-anomaly harness against plain Python."""

import datetime
import re

import pandas as pd
from pyspark.sql import functions as F

from wayledger.operators import evidence, labels, planting


def plain_label(terms):
    """The label rules, said again with regular expressions and loops."""
    marks, glue = {*labels.GLOSS, *labels.PLACES, *labels.GLUE}, set(labels.GLUE)
    words = [w for t in terms for w in t.split(" ")]
    share = sum(w in marks for w in words) / len(words) if words else 0.0
    done = []
    for t in terms:
        t = re.sub(r"\s+", " ", t.strip().lower())
        if t in labels.GLOSS:
            t = labels.GLOSS[t]
        else:
            whole = " ".join(dict.fromkeys(labels.GLOSS.get(w, w) for w in t.split(" ") if w not in glue))
            t = labels.PRETTY.get(whole, whole or t)
        if t and t not in done and not all(w in glue for w in t.split(" ")):
            done.append(t)
    own = [t for t in done if not any(len(o) > len(t) and f" {t} " in f" {o} " for o in done)]
    strong = [t for t in own if t not in labels.WEAK]
    if not strong:
        hint = " · ".join(own[:2])
        return (f"Mixed / uninterpretable ({hint})" if hint else "Mixed / uninterpretable"), False, share
    parts = strong[:3]
    parts += [t for t in own if t not in parts][: 3 - len(parts)]
    label = " · ".join(parts)
    return label[0].upper() + label[1:], True, share


CATALOGUE = [
    ["hall", "community hall", "community"], ["ke", "ki", "lai ki"], ["ka nirman", "sadak", "cc road", "road"], ["construction", "repair"], ["ka nirman road", "talab", "gp"],
    ["Kalyan  Mandap", "mandap", "ghar"], [], ["installation", "led", "led lights", "prakash"], ["village road", "road work", "gram panchayat"], ["smashan", "talab", "naali", "pulia"],
]


def test_labels_equal_plain_python(spark):
    d = spark.createDataFrame(list(enumerate(CATALOGUE)), "cluster int, terms array<string>")
    got = {r.cluster: r for r in labels.labelled(d, "terms").collect()}
    for i, terms in enumerate(CATALOGUE):
        label, good, share = plain_label(terms)
        assert (got[i].label, got[i].interpretable) == (label, good) and abs(got[i].language_share - share) < 1e-12, terms
    assert got[0].label == "Community hall" and not got[1].interpretable and got[9].note.startswith("grouped")


def test_cluster_terms_skip_stop_words_and_rare_terms(spark):
    rows = [("a", "The new bridge over a river, the new bridge"), ("b", "new bridge repair"), ("c", "NEW bridge lighting"), (None, "new bridge"), ("d", None)]
    got = labels.cluster_terms(spark.createDataFrame(rows, "c string, t string"), "c", "t", min_clusters=3).collect()
    assert {r.term for r in got} == {"new", "bridge", "new bridge"} and {r.c for r in got} == {"a", "b", "c"}
    assert all(abs(sum(r.weight**2 for r in got if r.c == c) - 1) < 1e-9 for c in "abc")


def test_question_slots(spark):
    rows = [
        (1, "Plan 100 auditor-days for the PWD Division North (office 4)"), (2, "split 50 days across 4 auditors"), (3, "Divide the work: team of 7"), (4, "show 2500 things"), (5, "nothing"),
        (6, "PWD DIVISION north east, 0 days, 99 people"), (7, None), (8, "30 officers"),
    ]
    q = spark.createDataFrame(rows, "k int, t string")
    got = {r.k: (r.d, r.m) for r in q.select("k", evidence.asked_days("t").alias("d"), evidence.asked_team("t").alias("m")).collect()}
    assert got == {1: (100, 1), 2: (50, 4), 3: (50, 7), 4: (1000, 4), 5: (50, 4), 6: (1, 24), 7: (50, 4), 8: (30, 24)}
    names = spark.createDataFrame([("PWD Division (A)",), ("PWD division North (B)",), ("PWD division north (C)",), ("Div",), (None,)], "n string")
    found = {r.k: r.n for r in evidence.named_in(q, "k", "t", names, "n").collect()}
    assert found == {1: "PWD division North (B)", 6: "PWD division North (B)"}
    assert evidence.named_in(q, "k", "t", names.limit(0), "n").count() == 0


def test_flags_and_readers(spark):
    d = spark.createDataFrame([(1, "x", 1), (1, "x", 2), (1, "y", 2), (2, "y", 5), (2, "y", 5), (3, None, 1)], "k int, f string, i int")
    got = {r.flag: (r.keys, r["items"], r.complete, r.only_here) for r in evidence.flag_sufficiency(d, "k", "f", "i").collect()}
    assert got == {"x": (1, 2, 1, 1), "y": (2, 2, 1, 1)}
    rows = [(1, "a", "c", 100.0, 100.0), (1, "b", "c", 100.9, 100.0), (2, "a", "c", None, 5.0), (2, "b", "c", 5.2, 5.0), (3, "a", "e", 7.0, 7.0), (3, "b", "e", 7.0, 7.0)]
    r = spark.createDataFrame(rows, "item int, reader string, condition string, read double, truth double")
    acc = {(x.reader, x.condition): (x.n, x.found, x.exact, x.close) for x in evidence.reader_accuracy(r, "truth").collect()}
    assert acc == {("a", "c"): (2, 0.5, 0.5, 0.5), ("b", "c"): (2, 1.0, 0.0, 0.5), ("a", "e"): (1, 1, 1, 1), ("b", "e"): (1, 1, 1, 1)}
    agree = {x.condition: tuple(x)[1:] for x in evidence.reader_agreement(r, "a", "b", "truth").collect()}
    assert agree == {"c": (1, 0, 0, 1, 0), "e": (1, 0, 0, 0, 1)}


def test_pairs_and_history_of_some_keys(spark):
    pairs = spark.createDataFrame([(1, 2, "s"), (1, 3, "s"), (4, 5, "s")], "a int, b int, c string")
    assert [tuple(x) for x in evidence.restricted(pairs, spark.createDataFrame([(1,), (2,), (2,), (4,)], "k int"), "k").collect()] == [(1, 2, "s")]
    visits = spark.createDataFrame([(w, t, f"o{t}") for w, t in [(1, 1), (1, 2), (2, 3), (3, 4), (1, 5), (2, 6), (1, 7)]], "w int, t int, outcome string")
    works = spark.createDataFrame([(1, "x"), (2, "x"), (3, "y")], "w int, o string")
    got = {r.o: (r.visits, r.works, r["last"]) for r in evidence.field_history(visits, works, "w", "o", F.desc("t")).collect()}
    assert got == {"x": (6, 2, ["o7", "o6", "o5", "o3", "o2"]), "y": (1, 1, ["o4"])}


def ordinary(spark, n=400):
    day = datetime.date(2020, 1, 1)
    rows = [
        (f"w{i:04d}", ["NONE", "LOW", "HIGH"][i % 3], float(100 + i), day + datetime.timedelta(i), f"text {i}" if i % 10 else None, f"ag{i % 7}", "sx" if i % 2 else "sy", i % 5, int(i % 4 > 0), 1 - int(i % 4 > 0),
         None if i % 4 == 0 else day + datetime.timedelta(i + 50), True, i)
        for i in range(n)
    ]
    return spark.createDataFrame(rows, "k string, band string, recommended_amount double, recommendation_date date, work_description string, implementing_agency string, s string, a int, is_completed int, is_open int, completion_date date, is_sanctioned boolean, doc int")


def test_each_pick_gets_one_sibling(spark):
    d = ordinary(spark).unionByName(ordinary(spark, 1).withColumns({"k": F.lit("alone"), "s": F.lit(None).cast("string")}))
    found = {r.k: r.donor for r in planting.siblings(d, d, "k", ["s", "a"]).collect()}
    block = {r.k: (r.s, r.a) for r in d.collect()}
    assert len(found) == 400 and "alone" not in found
    assert all(k != v and block[k] == block[v] for k, v in found.items()) and len(set(found.values())) > 150
    assert found == {r.k: r.donor for r in planting.siblings(d.repartition(7), d, "k", ["s", "a"]).collect()}


def test_four_kinds_are_planted_where_nobody_looks(spark):
    d = ordinary(spark)
    out = planting.planted(d, "k", ["s", "a"], 20, ("doc",))
    before, after = d.toPandas().set_index("k"), out.toPandas().set_index("k")
    assert len(after) == 400 and set(out.columns) == {*d.columns, "planted"}
    counts = after.planted.value_counts().to_dict()
    assert set(counts) == set(planting.KINDS) and max(counts.values()) == 20 and counts["stalled_lifecycle"] < 20
    hit = after[after.planted.notna()]
    assert set(before.loc[hit.index].band) == {"NONE", "LOW"} and before.loc[hit.index].work_description.notna().all()
    same = after[after.planted.isna()].drop(columns="planted").sort_index()
    assert same.equals(before.loc[same.index][same.columns].sort_index())
    of = lambda kind: after[after.planted == kind]
    grown = of("inflated_amount").recommended_amount / before.loc[of("inflated_amount").index].recommended_amount
    assert grown.between(6, 14).all()
    late = of("stalled_lifecycle")
    days = pd.to_datetime(before.loc[late.index].recommendation_date) - pd.to_datetime(late.recommendation_date)
    assert days.dt.days.between(900, 2199).all() and (before.loc[late.index].is_open == 1).all()
    for k, row in of("cloned_description").iterrows():
        donor = before[before.work_description == row.work_description].iloc[0]
        assert donor.name != k and (donor.s, donor.a, donor.implementing_agency, donor.recommended_amount, donor.doc) == (row.s, row.a, row.implementing_agency, row.recommended_amount, row.doc)
    broken = of("lifecycle_break")
    assert not broken.is_sanctioned.any() and (broken.is_completed == 1).all() and 5 <= (broken.completion_date < broken.recommendation_date).sum() <= 15


def test_detection_equals_pandas(spark):
    d = planting.planted(ordinary(spark), "k", ["s", "a"], 20)
    d = d.withColumns({"audit_roi": F.pmod(F.xxhash64("k"), F.lit(50)).cast("double"), "priority": F.pmod(F.xxhash64("k", F.lit(2)), F.lit(90)).cast("double")})
    got = {(r.planted, r.by, r.k): (r.total, r.surfaced, r.recall, r.precision) for r in planting.detection(d, "k", (10, 100)).collect()}
    p = d.toPandas()
    for by in ("audit_roi", "priority"):
        p = p.sort_values([by, "k"], ascending=[False, True]).reset_index(drop=True)
        for kind in (*planting.KINDS, "all"):
            mine = p.planted.notna() if kind == "all" else p.planted == kind
            for k in (10, 100):
                hits = int((mine & (p.index < k)).sum())
                assert got[kind, by, k] == (int(mine.sum()), 0.0, hits / mine.sum(), hits / k)
