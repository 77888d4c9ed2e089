"""Document quality by Bradley-Terry ranking: weights learnt from preference pairs, a threshold at a score quantile."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field, replace

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import agreed_labels, discard, in_small_batches, placed, sample_rows, unused, written

#: Names of the features of a text, in the order of the vectors.
FEATURES = ("words", "word_length", "upper", "digits", "symbols", "pipes", "bangs", "other_punctuation", "distinct_words", "repeated_neighbours", "repeated_lines", "short_lines", "odd_words", "spaces", "sentence_ends")


def features(text: str | None) -> list[float]:
    """Numbers that describe how a whole text is written, by the same rules at every length; those of length are n / (n + half)."""
    t = text or ""
    b = t.encode()
    counts = np.bincount(np.frombuffer(b, "u1"), minlength=256) if b else np.zeros(256)
    n = max(len(t), 1)
    ws = b.split()
    k = max(len(ws), 1)
    letters = max(float(counts[65:91].sum() + counts[97:123].sum() + counts[0xC2:].sum()), 1)  # ASCII letters and all characters beyond ASCII
    some = lambda chars: float(counts[list(chars)].sum())
    lines = [x for x in b.split(b"\n") if x.strip()]
    odd = sum(1 for w in ws if w[-1:] in b"*#$%&!|" or w[:1] in b"*#$%&|<")
    same = sum(map(bytes.__eq__, ws, ws[1:]))
    return [
        len(ws) / (len(ws) + 50),
        len(b) / (len(b) + 7 * k),
        float(counts[65:91].sum()) / letters,
        float(counts[48:58].sum()) / n,
        some(b"#*$%&<>@^~{}[]\\=_") / n,
        some(b"|") / n,
        some(b"!") / n,
        some(b",;:'\"()-?/") / n,
        len(set(ws)) / k ** 0.9,
        same / k,
        1 - len(set(lines)) / max(len(lines), 1),
        sum(1 for x in lines if len(x) < 20) / max(len(lines), 1),
        odd / k,
        some(b" \t\n\r") / n,
        some(b".") / k,
    ]


def feature_udf():
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series([features(t) for t in texts], dtype=object)

    return F.pandas_udf(run, "array<double>")


@dataclass(frozen=True)
class Model:
    """Score of a text = weights . (features - mean) / scale; texts from ``cut`` on are accepted."""

    mean: list[float] = field(default_factory=lambda: [0.0] * len(FEATURES))
    scale: list[float] = field(default_factory=lambda: [1.0] * len(FEATURES))
    weights: list[float] = field(default_factory=lambda: [0.0] * len(FEATURES))
    cut: float = 0.0
    accept_at: float = 0.7

    def raw(self, x: np.ndarray) -> np.ndarray:
        """Bradley-Terry scores: a row's doesn't depend on the rows beside it, so equal rows meet the cut alike."""
        return ((x - np.array(self.mean)) / np.array(self.scale) * np.array(self.weights)).sum(1)

    def scores(self, x: np.ndarray) -> np.ndarray:
        """Scores in (0, 1), rising with the Bradley-Terry score, equal to ``accept_at`` exactly at the cut."""
        z = np.clip(self.raw(x) - self.cut + math.log(self.accept_at / (1 - self.accept_at)), -30, 30)
        return 1 / (1 + np.exp(-z))


def pair_sums(good: np.ndarray, bad: np.ndarray, w: np.ndarray, pairs_per_item: int) -> tuple[int, np.ndarray, np.ndarray]:
    """(pairs, gradient, Hessian) of log(1 + exp(-w . (good_i - bad_j))), summed over pairs.

    Each item of the larger side meets ``pairs_per_item`` of the other, at strides, so pairs stay linear in the items.
    """
    n = max(len(good), len(bad))
    i = np.arange(n * pairs_per_item)
    step = i // n * 7919
    d = good[(i % n) % len(good)] - bad[(i % n + step) % len(bad)]
    p = 1 / (1 + np.exp(np.clip(d @ w, -30, 30)))
    return len(d), -(d * p[:, None]).sum(0), (d * (p * (1 - p))[:, None]).T @ d


def newton(sums: Callable[[np.ndarray], tuple[int, np.ndarray, np.ndarray]], size: int, l2: float, steps: int) -> np.ndarray:
    """Weights w that minimise the mean over pairs + l2 |w|^2, given ``sums(w)`` as ``pair_sums`` has them."""
    w = np.zeros(size)
    for _ in range(steps):
        n, gradient, hessian = sums(w)
        move = np.linalg.solve(hessian / n + 2 * l2 * np.eye(size), gradient / n + 2 * l2 * w)
        w = w - move
        if np.abs(move).max() < 1e-6:
            break
    return w


def bradley_terry(good: np.ndarray, bad: np.ndarray, pairs_per_item: int = 8, l2: float = 1e-3, steps: int = 25) -> np.ndarray:
    """Weights w that minimise mean log(1 + exp(-w . (good_i - bad_j))) + l2 |w|^2 over the pairs of two arrays."""
    return newton(lambda w: pair_sums(good, bad, w, pairs_per_item), good.shape[1], l2, steps)


def pair_blocks(rows: DataFrame, good: int, bad: int, per_block: int = 2048, least: int = 8) -> DataFrame:
    """(block, good, bad): features of both classes, one vector after the other, in blocks whose items meet each other; written.

    ``rows`` has (tree, pos, x) with each class's places from 0, ``good`` of tree 1 and ``bad`` of tree 0.  Each row of the
    larger class is in one block of about ``per_block``; each row of the smaller one is in at least one, and in more where
    a block would else hold under ``least`` of them.
    """
    larger, n, m = (1, good, bad) if good >= bad else (0, bad, good)
    blocks = -(-n // per_block)
    each = min(m, max(least, -(-m // blocks)))
    own = rows.where(F.col("tree") == larger).select(F.expr(f"pos * {blocks}L div {n}L").alias("block"), "tree", "pos", "x")
    slots = rows.sparkSession.range(blocks * each).select(
        F.expr(f"id div {each}L").alias("block"), F.expr(f"((id div {each}L) * {m}L div {blocks}L + id % {each}L) % {m}L").alias("pos")
    )
    shared = slots.join(rows.where(F.col("tree") != larger), "pos").select("block", "tree", "pos", "x")
    vectors = lambda tree: F.flatten(F.transform(F.sort_array(F.collect_list(F.when(F.col("tree") == tree, F.struct("pos", "x")))), lambda r: r.x))
    return written(own.unionByName(shared).groupBy("block").agg(vectors(1).alias("good"), vectors(0).alias("bad")), "pair_blocks")


def block_sums(blocks: DataFrame, scale: np.ndarray, pairs_per_item: int = 8) -> Callable[[np.ndarray], tuple[int, np.ndarray, np.ndarray]]:
    """``pair_sums`` over the pairs of all blocks, as a function of the weights: each task sends its sums, no features."""
    size = len(scale)

    def sums(w: np.ndarray) -> tuple[int, np.ndarray, np.ndarray]:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = np.zeros(1 + size + size * size)
            for batch in batches:
                for sides in zip(batch.column("good"), batch.column("bad")):
                    good, bad = (v.values.to_numpy().reshape(-1, size) / scale for v in sides)
                    n, gradient, hessian = pair_sums(good, bad, w, pairs_per_item)
                    total += np.concatenate([[n], gradient, hessian.ravel()])
            yield pa.RecordBatch.from_pydict({"sums": pa.array([total], pa.list_(pa.float64()))})

        total = np.sum([r.sums for r in blocks.select("good", "bad").mapInArrow(run, "sums array<double>").collect()], axis=0)
        return int(total[0]), total[1 : 1 + size], total[1 + size :].reshape(size, size)

    return sums


def place_of_cut(n: int, rejected_share: float) -> int:
    """How many of ``n`` scores lie below the cut: at least one, and not all."""
    return min(max(round(rejected_share * n), 1), n - 1)


def cut_at_quantile(scores: np.ndarray, rejected_share: float) -> float:
    """The score quantile below which ``rejected_share`` of the scores lie, midway between its two neighbours."""
    s = np.sort(scores)
    k = place_of_cut(len(s), rejected_share)
    return float((s[k - 1] + s[k]) / 2)


def featured(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, name, x) of every row: its key, a hash of its text and its features; written, so texts are read once."""
    return written(in_small_batches(docs).select(F.col(key).alias("key"), F.xxhash64(text).alias("name"), feature_udf()(F.col(text)).alias("x")), "features")


def fit_featured(rows: DataFrame, labels: DataFrame, key: str = "doc_id", label: str = "quality", accept_at: float = 0.7, sampled: bool = False) -> Model:
    """A model from all labelled ``rows``, the result of ``featured``; 1 is preferred to 0.

    Weights and cut come from every row whose key has a label: the driver gets counts, means and sums over pairs only.
    The cut is the exact quantile of their scores at the share of rejected ones among them; if they are ``sampled`` by
    class, at the share among all labels.  Rows of equal key and text count once.  Keys whose labels contradict each other
    are left out; where a label has no text at all, the model accepts everything.
    """
    agreed = agreed_labels(labels, key, label).where(F.col(label).isin(0, 1)).select(F.col(key).alias("key"), F.col(label).alias("tree"))
    known = placed(rows.join(agreed, "key").dropDuplicates(["key", "name"]), F.xxhash64("key"), F.col("key"), F.col("name"))
    x = [F.get("x", F.lit(i)) for i in range(len(FEATURES))]
    of = known.agg(F.count_if(F.col("tree") == 1).alias("good"), F.count_if(F.col("tree") == 0).alias("bad"), F.array(*map(F.avg, x)).alias("mean"), F.array(*map(F.stddev_pop, x)).alias("scale")).first()
    if not of.good or not of.bad:
        return Model(accept_at=accept_at)
    short = lambda v: [float(f"{c:.9g}") for c in v]  # noqa: E731  # sums in another order give the same
    scale = np.maximum(short(of.scale), 1e-6)
    blocks = pair_blocks(known, of.good, of.bad)
    w = newton(block_sums(blocks, scale), len(FEATURES), l2=1e-3, steps=25)
    model = Model(short(of.mean), scale.tolist(), w.tolist(), accept_at=accept_at)
    copies = {0: 1, 1: 1}
    if sampled:  # as many rejected scores as the labels' share asks for, each class weighted to its size among all labels
        shares = {r.tree: r["count"] for r in agreed.groupBy("tree").count().collect()}
        copies = {k: max(1, round(shares[k] / n * 4)) for k, n in ((0, of.bad), (1, of.good))}
    repeated = F.explode(F.sequence(F.lit(1), F.when(F.col("tree") == 1, copies[1]).otherwise(copies[0])))
    scored = known.select("x", F.col("pos").alias("at"), repeated).select(F.lit(0).alias("tree"), raw_udf(model)("x").alias("raw"), "at")
    ranked, below, n = placed(scored, F.col("raw"), F.col("at")), of.bad * copies[0], of.bad * copies[0] + of.good * copies[1]
    k = place_of_cut(n, below / n)
    beside = [r.raw for r in ranked.where(F.col("pos").isin(k - 1, k)).select("raw").collect()]
    discard(known, blocks, ranked)
    return replace(model, cut=sum(beside) / 2)


def fit(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "quality", per_class: int | None = None, accept_at: float = 0.7) -> Model:
    """A model from all labelled texts, as ``fit_featured`` learns it.

    With ``per_class``, on request only, it learns from at most that many rows of either label: those whose keys, then
    texts, have the smallest hashes.
    """
    if per_class is not None:
        docs = sample_rows(in_small_batches(docs), agreed_labels(labels, key, label), key, text, label, per_class)
    rows = featured(docs, key, text)
    model = fit_featured(rows, labels, key, label, accept_at, per_class is not None)
    discard(rows)
    return model


def vectors_udf(of: Callable[[np.ndarray], np.ndarray]):
    """A column function: features -> a number."""

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for xs in batches:
            yield pd.Series(of(np.array(xs.tolist(), dtype=float).reshape(len(xs), len(FEATURES))))

    return F.pandas_udf(run, "double")


def raw_udf(model: Model):
    """A column function: features -> Bradley-Terry score."""
    return vectors_udf(model.raw)


def featured_score_udf(model: Model):
    """A column function: features -> score."""
    return vectors_udf(model.scores)


def score_udf(model: Model):
    """A column function: text -> score; null and empty texts are scored as texts without words."""

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series(model.scores(np.array([features(t) for t in texts], dtype=float).reshape(len(texts), len(FEATURES))))

    return F.pandas_udf(run, "double")


def accepted(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """The rows whose text the model accepts, with their own columns only; repeated rows are judged alike."""
    columns, (score,) = docs.columns, unused(docs, "score")
    return in_small_batches(docs).withColumn(score, score_udf(model)(F.col(text))).where(F.col(score) >= model.accept_at).select(*columns)
