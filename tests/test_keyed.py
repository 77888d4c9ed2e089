"""The keyed table by buckets, its feed and counters, and the ledger: stream against batch."""

import os
import random

import pytest

from wayledger.operators import changes
from wayledger.streaming import keyed

KIND = "u long, t long, a long, b string"


def history(seed, n=400, users=90):
    rng = random.Random(seed)
    return [(rng.randrange(users), t, rng.randrange(3), rng.choice(["x", "y", None])) for t in range(n)]


def files(path):
    return {os.path.join(r, f): os.stat(os.path.join(r, f)).st_mtime_ns for r, _, names in os.walk(path) for f in names if f.endswith(".parquet")}


@pytest.mark.parametrize("numbers", [[0, 1, 2, 3], [2, 5, 6, 40]])
def test_batches_touch_only_their_buckets_and_replays_change_nothing(spark, tmp_path, numbers):
    rows, table, feed = history(1), str(tmp_path / "t"), str(tmp_path / "f")
    parts = [rows[:300], rows[300:303], rows[303:310] + rows[:5], rows[310:]]  # the third brings old versions again
    put = lambda i: keyed.apply_batch(spark.createDataFrame(parts[i], KIND), numbers[i], table, feed, "u", ["t"], ["a", "b"], buckets=32, keep=2)
    put(0)
    before = files(f"{table}/data")
    put(1)
    after = files(f"{table}/data")
    assert before.items() <= after.items()  # nothing written again
    new = {p for p in after if p not in before}
    assert {p.split("bucket=")[1].split("/")[0] for p in new} and len({p.split("bucket=")[1].split("/")[0] for p in new}) <= 3
    counts = [put(2), put(3)]
    want = changes.latest(spark.createDataFrame(rows, KIND), "u", ["t"])
    whole = sorted(map(tuple, want.collect()))
    assert sorted(map(tuple, keyed.snapshot(spark, table, KIND).collect())) == whole
    assert put(3) == counts[1] and sorted(map(tuple, keyed.snapshot(spark, table, KIND).collect())) == whole
    early = changes.latest(spark.createDataFrame(rows[:310], KIND), "u", ["t"])
    assert sorted(map(tuple, keyed.snapshot(spark, table, KIND, numbers[2]).collect())) == sorted(map(tuple, early.collect()))
    assert keyed._numbers(spark, f"{table}/manifest") == numbers[2:]
    named = {(v, b) for n in numbers[2:] for b, v in keyed._manifest(spark, table, n).items()}
    assert {(int(p.split("/v=")[1].split("/")[0]), int(p.split("bucket=")[1].split("/")[0])) for p in files(f"{table}/data")} == named
    runs = {r.batch_id: (r.seen, r.appeared, r.changed) for r in spark.read.parquet(f"{table}/runs").collect()}
    assert [runs[n][0] for n in numbers] == [len(p) for p in parts]
    assert sum(r[1] for r in runs.values()) == len(whole)
    kinds = spark.read.parquet(feed).groupBy("change_type").count().collect()
    assert {r.change_type: r["count"] for r in kinds} == {"appeared": len(whole), "changed": sum(r[2] for r in runs.values())}


def test_stream_equals_batch_twin(spark, tmp_path):
    rows, src = history(2, 120, 20), str(tmp_path / "in")
    parts = [rows[i : i + 40] for i in (0, 40, 80)]
    for part in parts:
        spark.createDataFrame(part, KIND).coalesce(1).write.mode("append").parquet(src)
    stream = spark.readStream.schema(KIND).option("maxFilesPerTrigger", 1).parquet(src)
    q = keyed.keyed_mirror(stream, str(tmp_path / "t"), str(tmp_path / "f"), "u", ["t"], ["a", "b"], str(tmp_path / "cp"), buckets=8).trigger(availableNow=True).start()
    q.awaitTermination(240)
    assert q.exception() is None
    runs = sorted((r.batch_id, r.seen, r.appeared, r.changed) for r in spark.read.parquet(str(tmp_path / "t/runs")).collect())
    numbered = spark.createDataFrame([(i, *v) for i, part in enumerate(parts) for v in part], "run long, " + KIND)
    twin = sorted((r.run, r.seen, r.appeared, r.changed) for r in changes.run_counters(numbered, "run", "u", ["t"], ["a", "b"]).collect())
    assert runs == twin


def test_ledger_has_two_sinks(spark, tmp_path):
    src, kind = str(tmp_path / "in"), "id long, work string, outcome string"
    rows = [(1, "a", "DONE"), (2, "a", "MAYBE"), (3, "b", None), (4, "a", "NOT_FOUND"), (5, None, "DONE")]
    for part in (rows[:2], rows[2:]):
        spark.createDataFrame(part, kind).coalesce(1).write.mode("append").parquet(src)
    stream = spark.readStream.schema(kind).option("maxFilesPerTrigger", 1).parquet(src)
    q = keyed.ledger(stream, str(tmp_path / "yes"), str(tmp_path / "no"), "outcome", ("DONE", "NOT_FOUND"), ["id", "work", "outcome"], str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(240)
    assert q.exception() is None
    yes, no = spark.read.parquet(str(tmp_path / "yes")), spark.read.parquet(str(tmp_path / "no"))
    assert sorted(r.id for r in yes.collect()) == [1, 4, 5] and len({r.row_hash for r in yes.collect()}) == 3
    assert {(r.id, r.reason) for r in no.collect()} == {(2, "unknown outcome: MAYBE"), (3, "no outcome")}
    twin = changes.judged_entries(spark.createDataFrame(rows, kind), "outcome", ("DONE", "NOT_FOUND"), ["id", "work", "outcome"])
    assert {(r.id, r.row_hash) for r in twin.where("reason is null").collect()} == {(r.id, r.row_hash) for r in yes.collect()}


def test_composite_keys(spark):
    d = spark.createDataFrame([(1, 5.0, None), (1, 5.0, ""), (1, 5.5, None), (2, 5.0, None)], "w long, x double, v string")
    keys = [r.k for r in d.select(changes.composite("w", "x", "v").alias("k")).collect()]
    assert keys[0] == keys[1] and len(set(keys)) == 3
