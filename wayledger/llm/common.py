"""Helpers that the corpus operators share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import window as W

#: The ASCII white space that separates words, and the words themselves.
SPACE = r"[\x20\x09-\x0D]+"
SPACE_CHARS = " \t\n\x0b\x0c\r"


#: The folders made for applications that set none.
_own: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``; where unset (tests), a new local one."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base:
        return base
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    app = spark.sparkContext.applicationId
    if app not in _own:
        _own[app] = "file://" + tempfile.mkdtemp(prefix="spark-shared-")
    return _own[app]


def in_small_batches(docs: DataFrame, most: int = 4 << 20) -> DataFrame:
    """``docs``, with the session's Arrow batches bounded to ``most`` bytes, or less if they are already.

    Up to 10,000 whole texts make a batch, and each worker and its JVM hold several copies of one.
    """
    conf, name = docs.sparkSession.conf, "spark.sql.execution.arrow.maxBytesPerBatch"
    if not conf.get(name).rstrip("b").isdigit() or int(conf.get(name).rstrip("b")) > most:
        conf.set(name, f"{most}b")
    return docs


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` written once as Parquet in the shared folder and read back: cuts lineage and survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/wayledger/{uuid.uuid4().hex}-{name}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.written_to = path
    return out


def discard(*frames: DataFrame) -> None:
    """Removes the folders of ``written`` frames that no later plan reads."""
    for df in frames:
        jvm, conf = df.sparkSession._jvm, df.sparkSession._jsc.hadoopConfiguration()
        path = jvm.org.apache.hadoop.fs.Path(df.written_to)
        path.getFileSystem(conf).delete(path, True)


def small(df: DataFrame, max_rows: int) -> DataFrame:
    """``df`` with a broadcast hint if a count shows that it has at most ``max_rows`` rows, else as it is."""
    return F.broadcast(df) if df.limit(max_rows + 1).count() <= max_rows else df


def fold(key: str, n: int) -> Column:
    """crc32 of the key's text, modulo ``n``; a null key counts as the empty text."""
    return F.crc32(F.coalesce(F.col(key).cast("string"), F.lit("")).cast("binary")) % n


def unused(df: DataFrame, *names: str) -> list[str]:
    """``names`` made longer than any column's name of ``df``, so that none clashes."""
    return [name + "_" * (1 + max(map(len, df.columns), default=0)) for name in names]


def placed(rows: DataFrame, *order: Column) -> DataFrame:
    """``rows`` with ``pos`` (from 0) inside their ``tree`` and the tree's row count ``n``; written.

    Rows are sorted into ranges by tree and ``order``; their places follow from one count for each tree and range, so a
    tree that holds most rows is still dealt over all tasks.  ``order`` must leave no ties.
    """
    ranges = rows.orderBy("tree", *order).withColumns({"_range": F.spark_partition_id(), "_at": F.monotonically_increasing_id()})
    ranges = written(ranges, "ranges")
    counts = ranges.groupBy("tree", "_range").agg(F.count("*").alias("_n"), F.min("_at").alias("_first"))
    of = W.Window.partitionBy("tree")
    before = F.coalesce(F.sum("_n").over(of.orderBy("_range").rowsBetween(W.Window.unboundedPreceding, -1)), F.lit(0))
    moves = counts.select("tree", "_range", (before - F.col("_first")).alias("_move"), F.sum("_n").over(of).alias("n"))
    out = ranges.join(small(written(moves, "moves"), 100_000), ["tree", "_range"])
    return written(out.withColumn("pos", F.col("_at") + F.col("_move")).drop("_range", "_at", "_move"), "placed")


def words(text: str) -> Column:
    """Array of the non-empty runs without ASCII white space; empty for null."""
    return F.filter(F.split(F.coalesce(F.col(text), F.lit("")), SPACE), lambda w: w != "")


def agreed_labels(labels: DataFrame, key: str, label: str) -> DataFrame:
    """One row (key, label) for each key all of whose non-null labels agree; keys with contradicting labels go."""
    return (
        labels.where(F.col(key).isNotNull() & F.col(label).isNotNull())
        .groupBy(key)
        .agg(F.min(label).alias("_lo"), F.max(label).alias("_hi"))
        .where("_lo = _hi")
        .select(key, F.col("_lo").cast("int").alias(label))
    )


def sample_ids(labelled: DataFrame, key: str, label: str, per_class: int, *then: str) -> DataFrame:
    """At most ``per_class`` keys of either label, those of smallest hash: a bounded, repeatable fitting sample."""
    out = None
    for value in (0, 1):
        part = labelled.where(F.col(label) == value).orderBy(F.xxhash64(key), key, *then).limit(per_class)
        out = part if out is None else out.unionByName(part)
    return out


def sample_rows(docs: DataFrame, labelled: DataFrame, key: str, text: str, label: str, per_class: int) -> DataFrame:
    """(key, text, label) of at most ``per_class`` rows of either label, however often a key repeats; equal rows count once.

    Of the keys of ``sample_ids`` the rows of smallest hash of key, then of text; only hashes are sorted, no texts.
    """
    sample, name = F.broadcast(sample_ids(labelled, key, label, per_class)), F.xxhash64(text).alias("_text")
    rows = docs.select(key, text).join(sample, key)
    picked = sample_ids(rows.select(key, label, name).distinct(), key, label, per_class, "_text").select(key, "_text")
    return rows.withColumn("_text", F.xxhash64(text)).join(F.broadcast(picked), [key, "_text"], "left_semi").select(key, text, label).dropDuplicates([key, text])
