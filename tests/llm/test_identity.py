"""Rows whose keys are null or repeat, columns whose names clash, bounds, and the shared folder."""

import os
import random
import subprocess
import sys

import pytest
from pyspark.sql import functions as F

from wayledger.llm import common, langid, mixing, quality, simhash, suffixdedup, urls

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def prose(rng, n):
    return " ".join(f"w{rng.randrange(5000)}" for _ in range(n))


def test_texts_of_one_key_are_told_apart(spark):
    """Null and repeated ids: windows are judged as if the rows stood in the order of key and SHA-256 of the text."""
    rng = random.Random(1)
    passage = prose(rng, 160)
    rows = [(None, prose(rng, 200)), (None, prose(rng, 20) + passage + prose(rng, 20)), (4, passage), (4, prose(rng, 90)), (4, "q" + passage), (7, prose(rng, 50)), (7, None)]
    rows += [(None, prose(rng, 60)) for _ in range(40)]
    d = spark.createDataFrame(rows, "doc_id long, text string")
    got = suffixdedup.deduplicated(d).withColumn("n", F.octet_length("kept"))
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, __import__("hashlib").sha256((r[1] or "").encode()).hexdigest()))
    seen, want = set(), []
    for key, text in order:
        b = (text or "").encode()
        gone = bytearray(len(b))
        for p in range(len(b) - 99):
            if b[p : p + 100] in seen:
                gone[p : p + 100] = b"\1" * 100
            seen.add(b[p : p + 100])
        want.append((key, bytes(x for x, y in zip(b, gone) if not y)))
    assert sorted(((r.doc_id, bytes(r.kept)) for r in got.collect()), key=str) == sorted(want, key=str)
    assert sum(len(k) for _, k in want) < sum(len(r[1] or "") for r in rows) - 1000


def test_one_row_of_each_class_whatever_the_keys(spark):
    rng = random.Random(2)
    a, *own = [prose(rng, 80) for _ in range(7)]
    rows = [(1, a), (None, a), *((None, t) for t in own[:3]), (5, own[3]), (5, own[4]), (9, own[5]), (9, own[5])]
    d = spark.createDataFrame(rows, "doc_id long, text string")
    for c in ("_key", "key", "sha", "rows", "row", "id", "component"):
        d = d.withColumn(c, F.lit(3))
    kept = simhash.representatives(d, simhash.near_classes(d))
    assert kept.columns == d.columns and {r.key for r in kept.collect()} == {3}
    assert sorted(((r.doc_id, r.text) for r in kept.collect()), key=str) == sorted([(1, a), *((None, t) for t in own[:3]), (5, own[3]), (5, own[4]), (9, own[5])], key=str)


NAMES = ("_quality_score", "_key", "_copy", "_k", "_s", "_n", "_c", "score", "key", "sha", "rows", "spans", "kept", "_keep_0", "_doc", "_h", "_text", "bin", "copies", "taken", "size", "id", "component", "ids")


def test_stages_with_clashing_columns_repeated_rows_and_nothing(spark, tmp_path):
    import corpus_pipeline

    rng = random.Random(4)
    rows = [(i, prose(rng, 60) + ("." if i % 4 else " !!!" * 40), "en", f"s{i % 2}", 1) for i in range(60)] + [(1, "again " * 30, "en", "s1", 1)] * 2 + [(None, None, None, None, None)]
    spark.createDataFrame([(i, int(i % 4 > 0)) for i in range(60)], "doc_id long, quality int").write.parquet(str(tmp_path / "labels.parquet"))
    d = spark.createDataFrame(rows, DOCS)
    plain, odd, none = d, d, d.limit(0)
    for c in NAMES:
        odd, none = odd.withColumn(c, F.lit(7)), none.withColumn(c, F.lit(7))
    for name, stage in corpus_pipeline.STAGES:
        plain, odd, none = (common.written(stage(spark, x, str(tmp_path)), name) for x in (plain, odd, none))
        assert none.count() == 0
        same = [c for c in plain.columns if c in odd.columns]
        assert sorted(map(str, odd.select(*same).collect())) == sorted(map(str, plain.select(*same).collect())), name
        if name != "bpe":
            assert {r[c] for r in odd.select(*NAMES).collect() for c in NAMES} == {7}, name
    assert plain.count() > 40


def test_samples_are_bounded_by_rows(spark):
    d = spark.createDataFrame([(1, f"text {i}") for i in range(500)] + [(2, "x"), (2, "x"), (3, "y")], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 0), (2, 1), (3, 1)], "doc_id long, quality int")
    rows = common.sample_rows(d, labels, "doc_id", "text", "quality", 20).collect()
    assert sum(r.quality == 0 for r in rows) == 20 and sorted(r.text for r in rows if r.quality == 1) == ["x", "y"]
    assert quality.fit(d, labels, per_class=20).weights is not None


def test_all_of_a_large_dictionary_is_used(spark):
    rng, letters = random.Random(5), [chr(c) for c in range(97, 123)] + [chr(c) for c in range(0x3B1, 0x3CA)]
    texts = ["".join(rng.choice(letters) for _ in range(30_000)) for _ in range(110)]
    d = spark.createDataFrame([(0, texts[0]), (1, texts[-1])], "doc_id long, text string")
    got = langid.predict(d, {"xx": "\n".join(texts).encode(), "yy": b"abcdefghij" * 100}).collect()
    assert all(r.lang_pred == "xx" and r.margin > 5 for r in got), got


def test_every_substring_of_urls_on_request(spark):
    u = spark.createDataFrame([("ab/c", True), ("ab/d", False), ("ab/e", True)], "u string, accepted boolean")
    some, every = ({r.g for r in urls.model(u, seen=n).collect()} for n in (2, 1))
    assert "c" in every - some and some < every


@pytest.mark.parametrize("module, function", [("wayledger.llm.common", "shared_dir")])
def test_shared_folder_where_the_setting_is_absent(tmp_path, module, function):
    code = f"""
from pyspark.sql import SparkSession
from {module} import {function} as f
s = SparkSession.builder.master("local[1]").config("spark.ui.enabled", "false").getOrCreate()
a, b = f(s), f(s)
assert a == b and a.startswith("file:///"), a
s.range(3).write.parquet(a + "/x")
print("rows", s.read.parquet(a + "/x").count())
"""
    env = os.environ | {"SPARK_CONF_DIR": str(tmp_path)}
    said = subprocess.run([sys.executable, "-c", code], env=env, capture_output=True, text=True, timeout=120)
    assert "rows 3" in said.stdout, said.stderr[-800:]


def test_repeated_takes_rows_of_their_own_columns(spark):
    d = spark.createDataFrame([(1, "a b c", "s", 4), (2, None, "s", 5)], "doc_id long, text string, source string, _copy int")
    assert {r._copy for r in mixing.repeated(d).collect()} <= {4}
