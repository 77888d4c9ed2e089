"""Connected components of an edge list by repeated contraction, each round's tables written to the shared folder."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written


def roots(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, root): equal roots for nodes joined by a path; only nodes that have an edge to another node appear.

    In each round every node points to the closed neighbour of smallest hash, and the edges are renamed to what their
    ends point to.  A hub's edges meet in partial aggregates, never in one task as a list.  Null ends are ignored.
    """
    e = edges.select(F.col(a).alias("a"), F.col(b).alias("b")).where("a <> b").distinct()
    e, rounds = written(e, "edges"), []
    while not e.isEmpty():
        rank = lambda c: F.struct(F.xxhash64(c), F.col(c))
        both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min(rank("b")).alias("m"))
        parent = written(least.select(F.col("a").alias("node"), F.when(F.col("m") < rank("a"), F.col("m.b")).otherwise(F.col("a")).alias("parent")), "parents")
        rounds.append(parent)
        ends = [parent.select(F.col("node").alias(x), F.col("parent").alias(f"p{x}")) for x in ("a", "b")]
        renamed = e.join(ends[0], "a").join(ends[1], "b").where("pa <> pb").select(F.least("pa", "pb").alias("a"), F.greatest("pa", "pb").alias("b"))
        e = written(renamed.distinct(), "edges")
    if not rounds:
        return e.select(F.col("a").alias("node"), F.col("a").alias("root"))
    out = rounds[0].select("node", F.col("parent").alias("root"))
    for parent in rounds[1:]:
        step = parent.select(F.col("node").alias("root"), F.col("parent").alias("next"))
        out = out.join(step, "root", "left").select("node", F.coalesce("next", "root").alias("root"))
    return out


def joined(edges: DataFrame, before: DataFrame | None) -> DataFrame:
    """``roots`` of some (a, b) together with the edges that ``before``, its result for others, stands for; written."""
    if before is None:
        return written(roots(edges), "roots")
    ends = [before.select(F.col("node").alias(x), F.col("root").alias(f"r{x}")) for x in ("a", "b")]
    between = edges.join(ends[0], "a", "left").join(ends[1], "b", "left").select(F.coalesce("ra", "a").alias("a"), F.coalesce("rb", "b").alias("b"))
    step = written(roots(between), "steps")
    if step.isEmpty():
        return before
    onward = step.select(F.col("node").alias("root"), F.col("root").alias("next"))
    moved = before.join(onward, "root", "left").select("node", F.coalesce("next", "root").alias("root"))
    return written(moved.unionByName(step.join(before, "node", "left_anti")), "roots")
