"""Mixing sources to target weights by weighted fair queueing.

Each copy of a document gets a virtual finish time: the tokens of its source up to and including it, in a shuffled order,
divided by the source's target.  Copies are taken in the order of finish times until the total budget is spent.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W

from .common import small, unused, words, written

BEFORE = (W.Window.unboundedPreceding, -1)
UP_TO = (W.Window.unboundedPreceding, W.Window.currentRow)


def targets(sizes: DataFrame, weights: tuple[float, ...], most: int) -> DataFrame:
    """(source, source_size, target) from (source, source_size).

    Sources in the order of code points, null last, get the weights in turn and share the sum of all sizes; no target
    exceeds ``most`` times its source's size, and what is cut off is shared by weight among the rest.  Sorted by the share
    at which they fill up, the sources before some place are full and all others get the same amount a unit of weight.
    """
    place = F.row_number().over(W.Window.orderBy(F.col("source").asc_nulls_last())) - 1
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (place % len(weights) + 1).cast("int"))
    s = sizes.withColumn("weight", weight).withColumn("full", F.col("source_size") * most)
    order = W.Window.orderBy(F.col("full") / F.col("weight"), F.col("source").asc_nulls_last())
    everything = W.Window.partitionBy()
    none = F.lit(0.0)
    budget = F.sum("source_size").over(everything) - F.coalesce(F.sum("full").over(order.rowsBetween(*BEFORE)), none)
    weighs = F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(order.rowsBetween(*BEFORE)), none)
    s = s.withColumn("level", budget / weighs)
    # the level is the first that doesn't overfill its own source; before it they are full
    level = F.min(F.when(F.col("level") * F.col("weight") <= F.col("full"), F.struct(F.col("full") / F.col("weight"), "level"))).over(everything)
    share = F.least(F.col("full").cast("double"), F.coalesce(level["level"] * F.col("weight"), F.col("full").cast("double")))
    return s.select("source", "source_size", share.alias("target"))


def mixed(
    docs: DataFrame,
    weights: tuple[float, ...] = (5.0, 2.0, 1.0),
    most: int = 3,
    key: str = "doc_id",
    text: str = "text",
    source: str = "source",
    seed: int = 1,
    rows_per_bin: int = 20_000,
    max_broadcast: int = 100_000,
) -> DataFrame:
    """(key, source, size, source_size, target, taken, copies) of every row.

    ``size`` counts the words of the whole text, ``copies`` how often the mix takes the document, ``taken`` their words.
    Null and empty texts have size 0 and are never taken; a null source is a source of its own; repeated rows queue one
    after the other; other columns are ignored.  The shuffled order depends on the key's hash alone, so reruns agree.

    A source's running sums are made within bins of about ``rows_per_bin`` rows of neighbouring hashes, started from the
    bins' own sums; so are those over all finish times.  No source, however large, meets in one task.
    """
    h = F.xxhash64(F.lit(seed), F.col(key))
    rows = written(docs.select(F.col(key).alias("key"), F.col(source).alias("source"), F.size(words(text)).cast("long").alias("size"), h.alias("h")), "sizes")
    n_bins = max(1, -(-rows.count() // rows_per_bin))
    share = targets(rows.groupBy("source").agg(F.sum("size").alias("source_size")), weights, most)
    share = written(share.select(F.col("source").alias("_source"), "source_size", "target"), "targets")
    binned = rows.withColumn("bin", F.least(F.floor((F.col("h") / 2.0**64 + 0.5) * n_bins), F.lit(n_bins - 1)))
    bins = binned.groupBy("source", "bin").agg(F.sum("size").alias("bin_size"))
    started = bins.withColumn("before", F.coalesce(F.sum("bin_size").over(W.Window.partitionBy("source").orderBy("bin").rowsBetween(*BEFORE)), F.lit(0)))
    started = started.select(F.col("source").alias("_of"), F.col("bin").alias("_bin"), "before")
    within = F.sum("size").over(W.Window.partitionBy("source", "bin").orderBy("h", "key", "size").rowsBetween(*UP_TO))
    queued = (
        binned.withColumn("within", within)
        .join(small(written(started, "bins"), max_broadcast), F.col("source").eqNullSafe(F.col("_of")) & (F.col("bin") == F.col("_bin")))
        .join(small(share, max_broadcast), F.col("source").eqNullSafe(F.col("_source")))
    )
    queued = queued.select("key", "source", "size", "source_size", "target", (F.col("before") + F.col("within")).alias("upto"))
    queued = written(queued, "queued")
    last = cut(queued, most, n_bins)
    copies = sum((F.when(_runs(e) & (_finish(e) <= last), 1).otherwise(0) for e in range(most)), F.lit(0))
    return queued.withColumn("copies", copies).select(F.col("key").alias(key), F.col("source").alias(source), "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"), "copies")


def _finish(copy: int) -> Column:
    """The virtual finish time of a document's copy of that number, from 0."""
    return (F.col("source_size") * copy + F.col("upto")) / F.col("target")


def _runs(copy: int) -> Column:
    """A copy exists if its service begins before time 1, when its source has had its target; empty documents have none."""
    return (F.col("size") > 0) & ((F.col("source_size") * copy + F.col("upto") - F.col("size")) < F.col("target"))


def cut(queued: DataFrame, most: int, n_bins: int) -> float:
    """The last finish time at which all copies finished so far still fit the sum of all sizes."""
    finish = F.explode(F.array_compact(F.array(*[F.when(_runs(e), _finish(e)) for e in range(most)])))
    copies = queued.select("size", finish.alias("at")).withColumn("bin", F.floor(F.col("at") * n_bins))
    budget = queued.agg(F.sum("size")).first()[0] or 0
    sums = copies.groupBy("bin").agg(F.sum("size").alias("size"))
    filled = sums.select("bin", "size", F.sum("size").over(W.Window.orderBy("bin").rowsBetween(*UP_TO)).alias("total"))
    over = filled.where(F.col("total") > budget).orderBy("bin").first()
    if over is None:
        return float("inf")
    before = over["total"] - over["size"]
    # times within the bin that is cut, ties together
    times = copies.where(F.col("bin") == over["bin"]).groupBy("at").agg(F.sum("size").alias("size"))
    running = times.select("at", F.sum("size").over(W.Window.orderBy("at").rowsBetween(*UP_TO)).alias("total"))
    fits = running.where(F.col("total") + before <= budget).agg(F.max("at")).first()[0]
    return fits if fits is not None else copies.where(F.col("bin") < over["bin"]).agg(F.max("at")).first()[0] or 0.0


def repeated(docs: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source", **options) -> DataFrame:
    """The rows of ``docs``, each as often as the mix takes it, with their own columns.

    Rows equal in key, source and size appear alike, as often as the most taken of them.
    """
    taken = mixed(docs, key=key, text=text, source=source, **options).where("copies > 0")
    k, s, n, c, each = unused(docs, "k", "s", "n", "c", "copy")
    taken = taken.groupBy(F.col(key).alias(k), F.col(source).alias(s), F.col("size").alias(n)).agg(F.max("copies").alias(c))
    same = F.col(key).eqNullSafe(F.col(k)) & F.col(source).eqNullSafe(F.col(s)) & (F.size(words(text)) == F.col(n))
    return docs.join(taken, same).withColumn(each, F.explode(F.sequence(F.lit(1), c))).select(*docs.columns)
