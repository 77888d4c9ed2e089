"""Scans and sinks: delimited exports, doubly encoded JSON, manifests, listings, binaries, and tables with digests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.canonical import digest

#: The first bytes of file kinds.
MAGIC = {"25504446": "application/pdf", "89504E47": "image/png", "FFD8FF": "image/jpeg", "504B0304": "application/zip", "47494638": "image/gif"}
#: Kinds by file extension.
KINDS = {"pdf": "document", "doc": "document", "docx": "document", "jpg": "image", "jpeg": "image", "png": "image", "gif": "image"}


def csv(spark: SparkSession, path: str | list[str], columns: list[str], rename: dict[str, str] | None = None, sep: str = ",", index: bool = False) -> DataFrame:
    """A CSV export, all texts, with ``source_file``; a header with unknown columns raises, missing ones are null.

    ``index`` adds ``raw_row_index``, the row's place in its file from 0: such a file is read by one task from its first line
    to its last, so that is the row's number in the scan less the least number of its file.
    """
    options = {"header": True, "multiLine": True, "escape": '"', "sep": sep, "encoding": "UTF-8"}
    parts = []
    for p in [path] if isinstance(path, str) else path:
        raw = spark.read.options(**options).csv(p)
        raw = raw.withColumnsRenamed({c: c.removeprefix("﻿") for c in raw.columns})
        if unknown := set(raw.columns) - set(columns):
            raise ValueError(f"unknown columns: {sorted(unknown)}")
        d = raw.withColumn("source_file", F.element_at(F.split(F.input_file_name(), "/"), -1))
        if index:
            d = d.withColumns({"_file": F.input_file_name(), "_row": F.monotonically_increasing_id()})
            first = d.groupBy(F.col("_file").alias("_of")).agg(F.min("_row").alias("_first"))
            d = d.join(first, F.col("_file") == F.col("_of")).withColumn("raw_row_index", F.col("_row") - F.col("_first")).drop("_file", "_row", "_of", "_first")
        parts.append(d)
    out = parts[0]
    for d in parts[1:]:
        out = out.unionByName(d, allowMissingColumns=True)
    out = out.withColumns({c: F.lit(None).cast("string") for c in columns if c not in out.columns})
    return out.withColumnsRenamed(rename or {})


def enveloped_json(spark: SparkSession, path: str, row: str, scope: str = r"s(\d+)_c(\d+)_m(\d+)_h(\d+)_t(\d+)", total: str | None = "Total_Amt") -> DataFrame:
    """Rows of documents ``{"envelope": "[{...}, ...]"}``, with the five ids of their folder's name.

    A row of which only ``total`` is filled is the grand total and goes.
    """
    text = spark.read.text(path, wholetext=True, recursiveFileLookup=True).withColumn("file", F.input_file_name())
    inner = text.select("file", F.explode(F.map_values(F.from_json("value", "map<string,string>"))).alias("rows"))
    out = inner.select("file", F.inline(F.from_json("rows", f"array<struct<{row}>>")))
    ids = {n: F.regexp_extract("file", scope, i).cast("long") for i, n in enumerate(("state_id", "constituency_id", "mp_id", "house", "tenure_id"), 1)}
    if total:
        others = [c for c in out.columns if c not in ("file", total)]
        out = out.where(F.coalesce(*[F.col(c).isNotNull() | F.lit(None) for c in others], F.col(total).isNull()))
    return out.withColumns(ids).drop("file")


def references(spark: SparkSession, path: str, pattern: str, key: list[str]) -> DataFrame:
    """Small JSON files of rows as a dimension: ``id`` from the file's name, one row a key."""
    return spark.read.json(path, multiLine=True).withColumn("id", F.regexp_extract(F.input_file_name(), pattern, 1).cast("long")).dropDuplicates(key)


def manifest(spark: SparkSession, path: str, kind: str) -> DataFrame:
    """A JSON-lines manifest's entries of a kind, one an attachment."""
    return spark.read.json(path).where(F.col("kind") == kind).dropDuplicates(["attach_id"]).withColumn("stage", F.lit(None).cast("string"))


def attachments(df: DataFrame, listing: str, missing: str = "N/A") -> DataFrame:
    """(other columns, file_name, attach_id) from listings of two parallel arrays; sentinels and unequal lengths go."""
    kind = "array<struct<FILE_NAME:array<string>,ATTACH_ID:array<string>>>"
    d = df.withColumn("_l", F.explode(F.from_json(listing, kind)))
    d = d.where((F.size("_l.FILE_NAME") == F.size("_l.ATTACH_ID")) & ~F.array_contains("_l.FILE_NAME", missing))
    d = d.withColumn("_z", F.explode(F.arrays_zip(F.col("_l.FILE_NAME").alias("f"), F.col("_l.ATTACH_ID").alias("a"))))
    return d.select(*[c for c in df.columns if c != listing], F.col("_z.f").alias("file_name"), F.col("_z.a").alias("attach_id")).dropDuplicates(["attach_id"])


def mime(content: Column | str) -> Column:
    head = F.hex(F.substring(content, 1, 8))
    out = F.lit("application/octet-stream")
    for magic, name in MAGIC.items():
        out = F.when(head.startswith(magic), name).otherwise(out)
    return out


def kind(path: Column | str) -> Column:
    ext = F.lower(F.regexp_extract(path, r"\.([A-Za-z0-9]+)$", 1))
    return F.coalesce(F.create_map(*[F.lit(x) for kv in KINDS.items() for x in kv])[ext], F.lit("other"))


def inspected(spark: SparkSession, path: str) -> DataFrame:
    """(path, kind, mime, bytes, sha256, copies) of binary files."""
    from pyspark.sql import window as W

    d = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    d = d.select("path", kind("path").alias("kind"), mime("content").alias("mime"), F.length("content").alias("bytes"), F.sha2("content", 256).alias("sha256"))
    return d.withColumn("copies", F.count("*").over(W.Window.partitionBy("sha256")))


def write_sorted(df: DataFrame, path: str, *key: str) -> str:
    """Parquet sorted by key, one range a file; returns a digest of the rows that doesn't depend on their order."""
    df.repartitionByRange(*key).sortWithinPartitions(*key).write.mode("overwrite").parquet(path)
    return str(df.sparkSession.read.parquet(path).agg(digest(df)).first()[0])


def write_quoted(df: DataFrame, path: str) -> None:
    """CSV with a header, every value quoted and white space collapsed."""
    clean = {c: F.trim(F.regexp_replace(c, r"\s+", " ")) for c, t in df.dtypes if t == "string"}
    df.withColumns(clean).write.mode("overwrite").option("quoteAll", True).csv(path, header=True)


def write_documents(df: DataFrame, path: str) -> None:
    """Nested documents as JSON lines; files have no order, so a rank is a column."""
    df.write.mode("overwrite").json(path)


def write_dataset(tables: dict[str, DataFrame], path: str) -> DataFrame:
    """Every table as Parquet and CSV, and (file, bytes, sha256) of what was written."""
    spark = next(iter(tables.values())).sparkSession
    for name, df in tables.items():
        df.write.mode("overwrite").parquet(f"{path}/parquet/{name}")
        write_quoted(df, f"{path}/csv/{name}")
    return inspected(spark, path).select(F.col("path").alias("file"), "bytes", "sha256").where(F.col("file").rlike(r"part-.*\.(parquet|csv)$"))
