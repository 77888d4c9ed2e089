"""File sources and streaming jobs."""

import json

import pytest
from pyspark.sql import functions as F

from wayledger.operators import changes
from wayledger.sources import files
from wayledger.streaming import feed


def test_csv_contract(spark, tmp_path):
    (tmp_path / "a.csv").write_text('﻿id,name\n1,"x, ""y"""\n2,\n', encoding="utf-8")
    (tmp_path / "b.csv").write_text("id\n3\n")
    d = files.csv(spark, [str(tmp_path / "a.csv"), str(tmp_path / "b.csv")], ["id", "name", "extra"], {"id": "key"}, index=True)
    got = sorted((r.key, r.name, r.extra, r.source_file, r.raw_row_index) for r in d.collect())
    assert got == [("1", 'x, "y"', None, "a.csv", 0), ("2", None, None, "a.csv", 1), ("3", None, None, "b.csv", 0)]
    with pytest.raises(ValueError, match="unknown columns"):
        files.csv(spark, str(tmp_path / "a.csv"), ["id"])


def test_enveloped_json_drops_the_grand_total(spark, tmp_path):
    d = tmp_path / "s5_c6_m7_h1_t18"
    d.mkdir()
    (d / "x.json").write_text(json.dumps({"data": json.dumps([{"ID": "1", "Total_Amt": None}, {"ID": "2"}, {"Total_Amt": "9"}])}))
    got = sorted(tuple(r) for r in files.enveloped_json(spark, str(tmp_path), "ID:string,Total_Amt:string").select("ID", "state_id", "mp_id", "tenure_id").collect())
    assert got == [("1", 5, 7, 18), ("2", 5, 7, 18)]


def test_attachment_listings(spark):
    rows = [('[{"FILE_NAME":["a","b"],"ATTACH_ID":["1","2"]}]',), ('[{"FILE_NAME":["N/A"],"ATTACH_ID":["9"]}]',), ("[]",), ('[{"FILE_NAME":["a","b"],"ATTACH_ID":["3"]}]',), ('[{"FILE_NAME":["a"],"ATTACH_ID":["1"]}]',)]
    d = spark.createDataFrame(rows, "listing string").withColumn("work", F.lit("w"))
    assert sorted((r.file_name, r.attach_id) for r in files.attachments(d, "listing").collect()) == [("a", "1"), ("b", "2")]


def test_binaries_and_sinks(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.pdf").write_bytes(b"%PDF-1.7 x")
    (tmp_path / "in/b.png").write_bytes(b"\x89PNG\r\n\x1a\n")
    (tmp_path / "in/c.PNG").write_bytes(b"\x89PNG\r\n\x1a\n")
    got = {r.path[-5:]: (r.kind, r.mime, r.copies) for r in files.inspected(spark, str(tmp_path / "in")).collect()}
    assert got == {"a.pdf": ("document", "application/pdf", 1), "b.png": ("image", "image/png", 2), "c.PNG": ("image", "image/png", 2)}
    d = spark.createDataFrame([(i, f"a  {i}") for i in range(20)], "k long, t string")
    assert files.write_sorted(d, str(tmp_path / "p"), "k") == files.write_sorted(d.repartition(3), str(tmp_path / "q"), "k")
    written = files.write_dataset({"t": d}, str(tmp_path / "set")).collect()
    assert written and all(len(r.sha256) == 64 for r in written)
    assert spark.read.csv(str(tmp_path / "set/csv/t"), header=True).where("t = 'a 3'").count() == 1


VERSIONS = [(u, t, (u * t) % 3, "x" if t < 4 else "y") for u in range(4) for t in range(6)]
KIND = "u long, t long, a long, b string"


@pytest.mark.parametrize("batches", [1, 3])
def test_stream_feed_equals_batch_feed(spark, tmp_path, batches):
    src = str(tmp_path / "in")
    for i in range(batches):
        part = [v for v in VERSIONS if v[1] * batches // 6 == i]
        spark.createDataFrame(part, KIND).coalesce(1).write.mode("append").parquet(src)
    stream = spark.readStream.schema(KIND).option("maxFilesPerTrigger", 1).parquet(src)
    out = feed.changes(stream, "u", "t", ["a", "b"])
    name = f"feed{batches}"
    q = out.writeStream.format("memory").queryName(name).outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    want = changes.feed_of(spark.createDataFrame(VERSIONS, KIND), "u", ["t"], ["a", "b"])
    assert sorted(map(str, map(tuple, spark.table(name).collect()))) == sorted(map(str, map(tuple, want.collect())))


def test_mirror_keeps_snapshot_and_feed_in_step(spark, tmp_path):
    src = str(tmp_path / "in")
    for t in range(3):
        spark.createDataFrame([(u, t, (u + t) % 2, "x") for u in range(2 + t)], KIND).coalesce(1).write.mode("append").parquet(src)
    stream = spark.readStream.schema(KIND).option("maxFilesPerTrigger", 1).parquet(src)
    q = feed.mirror(stream, str(tmp_path / "tab"), str(tmp_path / "feed"), "u", ["t"], ["a", "b"], str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    got = spark.read.parquet(str(tmp_path / "tab/v=2"))
    assert sorted((r.u, r.t, r.a) for r in got.collect()) == [(0, 2, 0), (1, 2, 1), (2, 2, 0), (3, 2, 1)]
    kinds = {r.change_type: r["count"] for r in spark.read.parquet(str(tmp_path / "feed")).groupBy("change_type").count().collect()}
    assert kinds["appeared"] == 4 and kinds["changed"] == 5


def test_windows_tumble_and_slide(spark):
    d = spark.createDataFrame([("2024-01-01 00:10:00", "a"), ("2024-01-01 00:50:00", "a"), ("2024-01-01 01:10:00", "b")], "t string, field string").withColumn("t", F.to_timestamp("t"))
    assert sorted((r.field, r.changes) for r in feed.per_window(d, "t", "field").collect()) == [("a", 2), ("b", 1)]
    assert feed.per_window(d, "t", "field", slide="30 minutes").count() == 5
