"""A keyed table kept by a stream: buckets of keys, of which a batch rewrites only those it touches; and a checked ledger."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from ..operators.changes import diffed, judged_entries, latest
from ..sources.tables import stored


def _fs(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def _numbers(spark: SparkSession, folder: str) -> list[int]:
    """The numbers n of the folders ``v=n``, ascending."""
    fs, p = _fs(spark, folder)
    names = [s.getPath().getName() for s in fs.listStatus(p)] if fs.exists(p) else []
    return sorted(int(n[2:]) for n in names if n.startswith("v="))


def _manifest(spark: SparkSession, table: str, number: int) -> dict[int, int]:
    """Which version holds each bucket: a row a bucket."""
    return {r.bucket: r.version for r in spark.read.schema("bucket int, version long").parquet(f"{table}/manifest/v={number}").collect()}


def _rows(spark: SparkSession, table: str, held: dict[int, int], schema) -> DataFrame:
    paths = [f"{table}/data/v={v}/bucket={b}" for b, v in sorted(held.items())]
    return spark.read.schema(schema).parquet(*paths) if paths else spark.createDataFrame([], schema)


def snapshot(spark: SparkSession, table: str, schema, number: int | None = None) -> DataFrame:
    """The table as of batch ``number`` (or the batch before it that is kept; the last one if not given)."""
    known = [n for n in _numbers(spark, f"{table}/manifest") if number is None or n <= number]
    return _rows(spark, table, _manifest(spark, table, known[-1]) if known else {}, schema)


def apply_batch(versions: DataFrame, number: int, table: str, feed: str, key: str, order: list[str], fields: list[str], buckets: int = 64, keep: int = 3) -> dict[str, int]:
    """One batch of versions into the table, its changes into the feed and its counts into the runs; gives the counts.

    Keys are dealt to ``buckets`` by hash (for ever: the number belongs to the table).  Only buckets with a key of the batch
    are read and written again, the others' files stay as they are; the manifest, written last, says which version holds
    which bucket, so a batch that fails half-way changes nothing and a replayed one replaces what it wrote.  Batch numbers
    may have gaps.  A version older than the stored one is seen but changes nothing.  Manifests but the last ``keep`` go,
    and with them the files that no kept manifest names.
    """
    spark, schema = versions.sparkSession, versions.schema
    before = [n for n in _numbers(spark, f"{table}/manifest") if n < number]
    held = _manifest(spark, table, before[-1]) if before else {}
    run = Observation()
    seen = versions.where(F.col(key).isNotNull()).observe(run, F.count("*").alias("seen"))
    bucket = F.pmod(F.xxhash64(F.col(key)), F.lit(buckets)).cast("int")
    new = stored(latest(seen, key, order))
    touched = [r.b for r in new.select(bucket.alias("b")).distinct().collect()]  # ``buckets`` at most
    old = _rows(spark, table, {b: held[b] for b in touched if b in held}, schema)
    whole = stored(latest(old.unionByName(new), key, order).withColumn("bucket", bucket))
    keys, moves = new.select(key), Observation()
    moved = diffed(old.join(keys, key, "left_semi"), whole.drop("bucket").join(keys, key, "left_semi"), key, fields)
    moved = moved.observe(moves, F.count_if(F.col("change_type") == "appeared").alias("appeared"), F.count_if(F.col("change_type") == "changed").alias("changed"))
    moved.write.mode("overwrite").parquet(f"{feed}/batch_id={number}")
    whole.repartition("bucket").write.partitionBy("bucket").mode("overwrite").parquet(f"{table}/data/v={number}")
    counts = {"seen": run.get["seen"], **moves.get}
    spark.createDataFrame([(number, *counts.values())], "batch_id long, seen long, appeared long, changed long").write.mode("overwrite").parquet(f"{table}/runs/v={number}")
    now = sorted((held | dict.fromkeys(touched, number)).items())
    spark.createDataFrame(now, "bucket int, version long").coalesce(1).write.mode("overwrite").parquet(f"{table}/manifest/v={number}")
    retire(spark, table, keep)
    return counts


def retire(spark: SparkSession, table: str, keep: int) -> int:
    """Removes all manifests but the last ``keep``, and the buckets that none of these names; gives how many buckets went."""
    numbers, gone = _numbers(spark, f"{table}/manifest"), 0
    kept = numbers[-keep:]
    named = {(v, b) for n in kept for b, v in _manifest(spark, table, n).items()}
    for n in numbers[:-keep]:
        fs, p = _fs(spark, f"{table}/manifest/v={n}")
        fs.delete(p, True)
    for v in _numbers(spark, f"{table}/data") if numbers[:-keep] else []:
        fs, p = _fs(spark, f"{table}/data/v={v}")
        of = [s.getPath() for s in fs.listStatus(p) if s.getPath().getName().startswith("bucket=")]
        stale = [x for x in of if (v, int(x.getName()[7:])) not in named]
        for x in stale:
            fs.delete(x, True)
        if len(stale) == len(of):
            fs.delete(p, True)
        gone += len(stale)
    return gone


def keyed_mirror(versions: DataFrame, table: str, feed: str, key: str, order: list[str], fields: list[str], checkpoint: str, buckets: int = 64, keep: int = 3):
    """A stream writer that keeps a keyed table, its feed and its run counters in step (``apply_batch``)."""

    def batch(df: DataFrame, number: int) -> None:
        apply_batch(df, number, table, feed, key, order, fields, buckets, keep)

    return versions.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)


def ledger(entries: DataFrame, accepted: str, rejected: str, outcome: str, domain: tuple[str, ...], hashed: list[str], checkpoint: str):
    """A stream writer of an append-only ledger: entries of a known outcome to one sink, the others with a reason to another.

    A batch has its own folder in each sink, so a replayed batch replaces its rows; a correction is a new entry.
    """

    def batch(df: DataFrame, number: int) -> None:
        judged = stored(judged_entries(df, outcome, domain, hashed))
        judged.where("reason IS NULL").drop("reason").write.mode("overwrite").parquet(f"{accepted}/batch_id={number}")
        judged.where("reason IS NOT NULL").drop("row_hash").write.mode("overwrite").parquet(f"{rejected}/batch_id={number}")

    return entries.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)
