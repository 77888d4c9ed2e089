"""Approximate nearest neighbours by an inverted multi-index.

The two halves of the vectors are quantised by codebooks of their own; a cell is a pair of centroids.  A query visits
cells in the order of summed centroid distances, by a heap, until they hold enough entries, whose distances are exact.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W

from .common import written


def usable(vector: str) -> Column:
    """Not null, without null or non-finite components, and not zero."""
    v = F.col(vector).cast("array<double>")
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(v.isNotNull() & finite & F.exists(v, lambda x: x != 0), F.lit(False))


def k_means(x: np.ndarray, k: int, steps: int = 12, seed: int = 7) -> np.ndarray:
    """Centroids of a bounded sample; an empty cluster takes over a random point."""
    rng = np.random.default_rng(seed)
    c = x[rng.choice(len(x), k, replace=False)].copy()
    for _ in range(steps):
        nearest = (-2 * x @ c.T + (c * c).sum(1)).argmin(1)
        n = np.bincount(nearest, minlength=k)
        sums = np.zeros_like(c)
        np.add.at(sums, nearest, x)
        c = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], x[rng.integers(0, len(x), k)])
    return c


@dataclass
class MultiIndex:
    """Two codebooks and the number of entries of each cell (first centroid x size of a codebook + second)."""

    first: np.ndarray
    second: np.ndarray
    entries: np.ndarray

    @property
    def k(self) -> int:
        return len(self.first)

    def halves(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Squared distances of the vectors' halves to the centroids."""
        m = self.first.shape[1]
        out = []
        for part, book in ((x[:, :m], self.first), (x[:, m:], self.second)):
            out.append((part * part).sum(1)[:, None] - 2 * part @ book.T + (book * book).sum(1))
        return out[0], out[1]

    def cells(self, x: np.ndarray) -> np.ndarray:
        a, b = self.halves(x)
        return a.argmin(1) * self.k + b.argmin(1)

    def visits(self, x: np.ndarray, enough: int) -> Iterator[list[int]]:
        """For each query the non-empty cells in the order of summed distances until they hold ``enough`` entries."""
        for a, b in zip(*self.halves(x)):
            i_of, j_of = np.argsort(a, kind="stable").tolist(), np.argsort(b, kind="stable").tolist()
            a, b = np.sort(a).tolist(), np.sort(b).tolist()
            heap, got, out = [(a[0] + b[0], 0, 0)], 0, []
            while heap and got < enough:
                _, i, j = heapq.heappop(heap)
                cell = i_of[i] * self.k + j_of[j]
                if self.entries[cell]:
                    out.append(cell)
                    got += int(self.entries[cell])
                if j + 1 < self.k:  # (i, j) is reached from (i, j - 1), or for j = 0 from (i - 1, 0)
                    heapq.heappush(heap, (a[i] + b[j + 1], i, j + 1))
                if j == 0 and i + 1 < self.k:
                    heapq.heappush(heap, (a[i + 1] + b[0], i + 1, 0))
            yield out


def nearest(queries: tuple[np.ndarray, np.ndarray], entries: tuple[np.ndarray, np.ndarray, np.ndarray], k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query's place, entry's place, distance) of each query's k nearest entries but its own row, ties to the smaller id.

    ``queries`` are (row, vector), ``entries`` (row, id, vector); distances are exact, in double precision.
    """
    (qrow, q), (row, vid, v) = queries, entries
    found = []
    square = (v * v).sum(1)
    for at in range(0, len(q), 32):
        block, own = q[at : at + 32], qrow[at : at + 32]
        rough = square - 2 * block @ v.T + (block * block).sum(1)[:, None]
        rough[own[:, None] == row[None, :]] = np.inf
        limit = np.partition(rough, k - 1, axis=1)[:, k - 1] if len(v) > k else np.full(len(block), np.inf)
        reach = np.where(np.isfinite(limit), limit + 1e-9 * (1 + np.abs(limit)), np.finfo(float).max)
        i, j = np.nonzero(rough <= reach[:, None])
        found.append((i + at, j, np.sqrt(((v[j] - block[i]) ** 2).sum(1))))
    i, j, d = (np.concatenate(c) for c in zip(*found)) if found else (np.zeros(0, int), np.zeros(0, int), np.zeros(0))
    best = first_of_each(i, k, d, vid[j], row[j])
    return i[best], j[best], d[best]


def first_of_each(of: np.ndarray, k: int, *order: np.ndarray) -> np.ndarray:
    """The places of the first ``k`` of each value of ``of``, in the order of the other columns."""
    at = np.lexsort((*order[::-1], of))
    of = of[at]
    return at[np.arange(len(of)) - np.searchsorted(of, of) < k]


FOUND = "query long, query_id long, row long, vec_id long, score double"


def stacked(vectors: pd.Series) -> np.ndarray:
    return np.array(vectors.tolist(), dtype=np.float64)


def search(
    vectors: DataFrame,
    is_query: Column,
    k: int = 10,
    key: str = "vec_id",
    vector: str = "embedding",
    sample: int = 20_000,
    tuning_queries: int = 64,
    recall: float = 0.96,
    entries_per_cell: int = 512,
    least_codebook: int = 16,
    max_codebook: int = 512,
    entries_per_group: int = 4096,
    queries_per_group: int = 2048,
) -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest found by Euclidean distance for each query, nearest first.

    Every usable vector is indexed; the codebooks are fitted on the ``sample`` vectors of smallest hash (the documented
    bound).  How many entries a query looks at is measured, not set: for ``tuning_queries`` queries, again those of
    smallest hash, the exact neighbours are found by one pass over all vectors, and the number is the least with which
    their mean recall reaches ``recall``.  Unusable vectors, null keys, and vectors whose length isn't the commonest
    take no part; an empty table gives no rows.  A query row never finds itself, but finds other rows of its key; a
    repeated query gets its neighbours once for each row.

    A task searches cells that share a first centroid, in parts of bounded entries and queries, so neither a cell that
    holds many copies of one vector nor one that many queries visit becomes a single task's work.
    """
    spark = vectors.sparkSession
    schema = "query_id long, rank int, vec_id long, score double"
    clean = vectors.where(F.col(key).isNotNull() & usable(vector)).select(F.col(key).cast("long").alias("vec_id"), F.col(vector).cast("array<double>").alias("v"), is_query.alias("q"))
    lengths = clean.groupBy(F.size("v").alias("d")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "d").first()
    if lengths is None:
        return spark.createDataFrame([], schema)
    d, n = lengths.d, lengths.n
    clean = clean.where(F.size("v") == d)
    picked = stacked(pd.Series([r.v for r in clean.select("v").orderBy(F.xxhash64("vec_id")).limit(sample).collect()]))
    size = int(min(max_codebook, max(least_codebook, round((n / entries_per_cell) ** 0.5)), len(picked)))
    half = max(1, d // 2)
    index = MultiIndex(k_means(picked[:, :half], size), k_means(picked[:, half:], size), np.zeros(size * size, dtype=np.int64))

    def assign(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for v in batches:
            yield pd.Series(index.cells(stacked(v)) if len(v) else [], dtype="int32")

    cells = written(clean.withColumns({"row": F.monotonically_increasing_id(), "cell": F.pandas_udf(assign, "int")("v")}), "cells")
    for r in cells.groupBy("cell").agg(F.count("*").alias("n")).collect():  # at most max_codebook squared rows
        index.entries[r.cell] = r.n
    enough = tuned(cells, index, k, tuning_queries, recall)
    shared = spark.sparkContext.broadcast(index)

    def visit(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for v in batches:
            out = []
            for order in shared.value.visits(stacked(v), enough) if len(v) else ():
                seconds: dict[int, list[int]] = {}
                for cell in order:
                    seconds.setdefault(cell // size, []).append(cell % size)
                out.append([{"first": i, "seconds": j} for i, j in seconds.items()])
            yield pd.Series(out, dtype=object)

    visited = F.inline(F.pandas_udf(visit, "array<struct<first:int,seconds:array<int>>>")("v"))
    visits = written(cells.where("q").select(F.col("row").alias("query"), F.col("vec_id").alias("query_id"), "v", visited), "visits")
    cells = cells.withColumns({"first": F.floor(F.col("cell") / size).cast("int"), "second": F.pmod("cell", F.lit(size))})
    parts = visits.groupBy("first").agg(F.ceil(F.count("*") / queries_per_group).alias("qs")).join(
        cells.groupBy("first").agg(F.ceil(F.count("*") / entries_per_group).alias("vs")), "first"
    )
    parts = F.broadcast(parts)  # at most max_codebook rows
    span = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    # the halves of a group's work: its entries dealt into vs parts, each for all qs parts of its queries, and the other way round
    left = cells.join(parts, "first").withColumn("vp", F.pmod(F.xxhash64("row"), F.col("vs"))).withColumn("qp", span("qs")).select("first", "vp", "qp", "row", "vec_id", "v", "second")
    right = visits.join(parts, "first").withColumn("qp", F.pmod(F.xxhash64("query"), F.col("qs"))).withColumn("vp", span("vs")).select("first", "vp", "qp", "query", "query_id", "v", "seconds")

    def compare(entries: pd.DataFrame, queries: pd.DataFrame) -> pd.DataFrame:
        row, vid, qrow, qid = entries.row.to_numpy(), entries.vec_id.to_numpy(), queries["query"].to_numpy(), queries.query_id.to_numpy()
        cell, asks, found = entries.second.to_numpy(), [set(x) for x in queries.seconds], []
        v, q = (stacked(entries.v), stacked(queries.v)) if len(row) and len(qrow) else (None, None)
        for second in np.unique(cell) if v is not None else ():
            here, ask = np.flatnonzero(cell == second), np.array([n for n, x in enumerate(asks) if second in x], dtype=int)
            i, j, d = nearest((qrow[ask], q[ask]), (row[here], vid[here], v[here]), k)
            found.append((ask[i], here[j], d))
        i, j, d = (np.concatenate(c) for c in zip(*found)) if found else (np.zeros(0, int), np.zeros(0, int), np.zeros(0))
        best = first_of_each(i, k, d, vid[j], row[j])
        i, j, d = i[best], j[best], d[best]
        return pd.DataFrame({"query": qrow[i], "query_id": qid[i], "row": row[j], "vec_id": vid[j], "score": d})

    groups = ["first", "vp", "qp"]
    found = left.groupBy(*groups).cogroup(right.groupBy(*groups)).applyInPandas(compare, FOUND)
    rank = F.row_number().over(W.Window.partitionBy("query").orderBy("score", "vec_id", "row"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def exact(vectors: DataFrame, queries: tuple[np.ndarray, np.ndarray], k: int) -> dict[int, list[int]]:
    """The cells of the k exact nearest rows of each of a few queries (row, vector), by one pass over all rows."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            if len(b):
                row, vid, cell = b.row.to_numpy(), b.vec_id.to_numpy(), b.cell.to_numpy()
                i, j, d = nearest(queries, (row, vid, stacked(b.v)), k)
                yield pd.DataFrame({"query": queries[0][i], "row": row[j], "vec_id": vid[j], "score": d, "cell": cell[j]})

    found = vectors.select("row", "vec_id", "v", "cell").mapInPandas(run, "query long, row long, vec_id long, score double, cell int")
    rank = F.row_number().over(W.Window.partitionBy("query").orderBy("score", "vec_id", "row"))
    out: dict[int, list[int]] = {}
    for r in found.withColumn("rank", rank).where(F.col("rank") <= k).collect():
        out.setdefault(r.query, []).append(r.cell)
    return out


def tuned(cells: DataFrame, index: MultiIndex, k: int, queries: int, recall: float) -> int:
    """The least number of entries to look at with which the sampled queries' mean recall reaches ``recall``."""
    rows = cells.where("q").select("row", "v").orderBy(F.xxhash64("vec_id"), "row").limit(queries).collect()
    if not rows:
        return k + 1
    qrow, q = np.array([r.row for r in rows]), stacked(pd.Series([r.v for r in rows]))
    truth, needs = exact(cells, (qrow, q), k), []
    for one, order in zip(qrow.tolist(), index.visits(q, int(index.entries.sum()))):
        held = dict(zip(order, np.cumsum(index.entries[order]).tolist()))
        needs += [held[c] for c in truth.get(one, [])]
    if not needs:
        return k + 1
    needs.sort()
    return max(k + 1, int(needs[min(len(needs) - 1, int(np.ceil(recall * len(needs))) - 1)]))
