"""Records that people and portals send back: findings, published tiles, exported cases with overlays; small documents out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.canonical import first_of


def first_filled(df: DataFrame, names: list[str]) -> Column:
    """The first non-empty of those ``names`` that ``df`` has, in any case; null if it has none."""
    known = {c.strip().lower(): c for c in df.columns}
    there = [F.trim(F.col(f"`{known[n.lower()]}`")) for n in names if n.lower() in known]
    return F.coalesce(*[F.when(c != "", c) for c in there], F.lit(None).cast("string"))


def findings(spark: SparkSession, path: str, headers: dict[str, list[str]], outcome: str, outcomes: dict[str, str]) -> tuple[DataFrame, DataFrame]:
    """Findings from a CSV whose headers differ from sender to sender, and the outcomes in it that nobody knows.

    ``headers`` has for each column the headers it may stand under, the first filled one counts; a byte-order mark before the
    first header goes.  ``outcomes`` maps what senders write, in any case, to codes; a row of another outcome is not a
    finding.  The second frame is (value, rows) of these.
    """
    raw = spark.read.options(header=True, multiLine=True, escape='"').csv(path)
    raw = raw.withColumnsRenamed({c: c.removeprefix("﻿") for c in raw.columns})
    d = raw.select(*[first_filled(raw, names).alias(c) for c, names in headers.items()])
    codes = F.create_map(*[F.lit(x) for k, v in outcomes.items() for x in (k.lower(), v)])
    d = d.withColumn("_code", codes[F.lower(F.col(outcome))])
    unknown = d.where(F.col("_code").isNull() & F.col(outcome).isNotNull()).groupBy(F.col(outcome).alias("value")).agg(F.count("*").alias("rows"))
    return d.where(F.col("_code").isNotNull()).withColumn(outcome, F.col("_code")).drop("_code"), unknown


def tiles(spark: SparkSession, path: str, scope: str = r"s(\d+)_h(\d+)_t(\d+)") -> DataFrame:
    """(state_id, house, tenure_id, tile, raw_value) of documents ``{tile: [..] or value}``, one a scope; values as JSON texts."""
    text = spark.read.text(path, wholetext=True, recursiveFileLookup=True).withColumn("file", F.input_file_name())
    each = text.select("file", F.explode(F.from_json("value", "map<string,string>")).alias("tile", "raw_value"))
    ids = {n: F.regexp_extract("file", scope, i).cast("long") for i, n in enumerate(("state_id", "house", "tenure_id"), 1)}
    return each.withColumns(ids).select(*ids, "tile", "raw_value")


def tile_numbers(found: DataFrame) -> DataFrame:
    """``tiles`` with ``count`` and ``amount``: the first two numbers of a list, or the amount alone of a single value."""
    listed = F.from_json("raw_value", "array<string>")
    number = lambda c: F.regexp_replace(c, ",", "").try_cast("double")
    is_list = F.col("raw_value").startswith("[")
    return found.withColumns({"count": F.when(is_list, number(F.get(listed, F.lit(0)))).cast("long"), "amount": F.when(is_list, number(F.get(listed, F.lit(1)))).otherwise(number(F.col("raw_value")))})


def overlaid(cases: DataFrame, stages: DataFrame, evidence: DataFrame, key: str, at: str, columns: list[str]) -> DataFrame:
    """Exported cases with the newest of later ``stages`` laid over them, and their ``evidence`` as an array, by key.

    A column that the newest stage leaves empty keeps the exported value; of stages of one time the last by their values
    counts.  Evidence and stages of unknown cases go.
    """
    newest = first_of(stages, [key], F.desc_nulls_last(at), *[F.desc_nulls_last(c) for c in columns]).select(F.col(key).alias("_k"), *[F.col(c).alias(f"_{c}") for c in columns])
    own = evidence.groupBy(F.col(key).alias("_e")).agg(F.array_sort(F.collect_list(F.struct(*[c for c in evidence.columns if c != key]))).alias("evidence"))
    d = cases.join(newest, F.col(key) == F.col("_k"), "left").join(own, F.col(key) == F.col("_e"), "left")
    empty = F.array().cast(own.schema["evidence"].dataType)
    d = d.withColumns({c: F.coalesce(F.when(F.col(f"_{c}") != "", F.col(f"_{c}")), F.col(c)) for c in columns} | {"evidence": F.coalesce("evidence", empty)})
    return d.drop("_k", "_e", *[f"_{c}" for c in columns])


def write_document(one: DataFrame, path: str) -> str:
    """A small document, of one row, as one JSON file; gives its text.  More than a row raises."""
    rows = one.limit(2).toJSON().collect()
    if len(rows) != 1:
        raise ValueError("a document is one row")
    one.coalesce(1).write.mode("overwrite").json(path)
    return rows[0]
