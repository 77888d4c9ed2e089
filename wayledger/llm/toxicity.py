"""Toxicity by multiple-instance learning: sentence probabilities, combined by noisy-or, learnt from document labels."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import agreed_labels, in_small_batches, sample_rows, written

SENTENCE = re.compile(r"[^.!?\n]+[.!?]*")
WORD = re.compile(r"\w+")


@dataclass(frozen=True)
class Model:
    """A sentence's log-odds = bias + the weights of its distinct known words."""

    bias: float = -30.0
    weights: dict[str, float] = field(default_factory=dict)

    def sentences(self, text: str | None) -> tuple[list[tuple[int, int, float]], int]:
        """(start, end, probability) of the sentences with a known word, and the number of the others, which have the bias alone."""
        out, others, get = [], 0, self.weights.get
        for m in SENTENCE.finditer(text or ""):
            known = [w for w in map(get, set(WORD.findall(m[0].lower()))) if w is not None]
            if known:
                out.append((m.start(), m.end(), self.probability(sum(known))))
            else:
                others += 1
        return out, others

    def probability(self, weight: float = 0.0) -> float:
        return float(1 / (1 + np.exp(-np.clip(self.bias + weight, -30, 30))))

    def score(self, found: list[tuple[int, int, float]], others: int = 0) -> float:
        """Noisy-or of all sentences' probabilities: that at least one is toxic; 0 without sentences."""
        return float(-np.expm1(sum((np.log1p(-min(p, 1 - 1e-12)) for _, _, p in found), others * np.log1p(-self.probability()))))


def vocabulary(sample: DataFrame, text: str, label: str, min_docs: int, min_g: float, of_best: float) -> list[str]:
    """The words that are more frequent in toxic documents and tell most about the label.

    A word's worth is half its G-test statistic over documents with and without it; below ``min_g``, or
    below ``of_best`` of the best word's, it may be chance or come from near copies of few documents.
    """
    words = F.array_distinct(F.filter(F.split(F.lower(F.coalesce(F.col(text), F.lit(""))), r"[^\p{L}\p{N}_]+"), lambda w: w != ""))
    total = {r[label]: r["n"] for r in sample.groupBy(label).agg(F.count("*").alias("n")).collect()}
    n1, n0 = total.get(1, 0), total.get(0, 0)
    if not n1 or not n0:
        return []
    counts = sample.select(label, F.explode(words).alias("w")).groupBy("w").agg(F.count_if(F.col(label) == 1).alias("a"), F.count_if(F.col(label) == 0).alias("b"))
    a, b, n = F.col("a"), F.col("b"), n1 + n0
    cells = ((a, (a + b) * n1 / n), (b, (a + b) * n0 / n), (n1 - a, (n - a - b) * n1 / n), (n0 - b, (n - a - b) * n0 / n))
    g = sum((F.when(seen > 0, seen * F.log(seen / expected)).otherwise(0.0) for seen, expected in cells), F.lit(0.0))
    telling = counts.where((a + b >= min_docs) & (a * n0 > b * n1)).withColumn("g", g).where(F.col("g") >= min_g)
    best = telling.orderBy(F.desc("g"), "w").collect()  # words of a bounded sample
    return [r.w for r in best if r.g >= of_best * best[0].g]


def fit_noisy_or(bags: list[list[list[int]]], others: np.ndarray, y: np.ndarray, n_words: int, toxic_share: float = 0.5, l2: float = 2e-6, steps: int = 300, rate: float = 0.3) -> tuple[float, np.ndarray]:
    """Bias and word weights that minimise the log-loss of noisy-or document probabilities, by Adam on all sentences.

    ``bags``: for each document its sentences, each a list of word numbers; ``others``: how many more sentences it has, without known words.
    ``toxic_share`` is the weight of all toxic documents together.
    """
    sentence_doc, pair_sentence, pair_word, s = [], [], [], 0
    for d, bag in enumerate(bags):
        for words in bag:
            sentence_doc.append(d)
            pair_sentence += [s] * len(words)
            pair_word += words
            s += 1
    sd, ps, pw = np.array(sentence_doc, dtype=int), np.array(pair_sentence, dtype=int), np.array(pair_word, dtype=int)
    theta = np.zeros(n_words + 1)
    theta[-1] = -4.0
    m, v = np.zeros_like(theta), np.zeros_like(theta)
    balance = np.where(y == 1, toxic_share / max(1, (y == 1).sum()), (1 - toxic_share) / max(1, (y == 0).sum()))
    for t in range(1, steps + 1):
        z = np.clip(theta[-1] + np.bincount(ps, theta[pw], minlength=s), -30, 30)
        p = 1 / (1 + np.exp(-z))
        alone = 1 / (1 + np.exp(-np.clip(theta[-1], -30, 30)))
        # log P(no sentence is toxic)
        log_none = np.bincount(sd, np.log1p(-np.minimum(p, 1 - 1e-12)), minlength=len(y)) + others * np.log1p(-alone)
        # d loss / d z of a sentence = p * (1 - y / P(document toxic))
        slope = balance * (1 - y / np.maximum(-np.expm1(log_none), 1e-9))
        dz = p * slope[sd]
        g = np.append(np.bincount(pw, dz[ps], minlength=n_words) + 2 * l2 * theta[:-1], dz.sum() + alone * (slope * others).sum())
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        theta -= rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    return float(theta[-1]), theta[:-1]


def fit(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "toxic", per_class: int = 3000, min_docs: int = 3, min_g: float = 5.0, of_best: float = 0.01) -> Model:
    """A model from document labels.

    The documented bound on what is learnt from: at most ``per_class`` documents of either label, their whole texts; the
    driver gets the numbers of their telling words by sentence, nothing else.  Keys with
    contradicting labels are left out and copies of a text count once; where a label has no document, nothing is toxic.
    """
    agreed = agreed_labels(labels, key, label)
    sample = sample_rows(in_small_batches(docs), agreed, key, text, label, per_class)
    sample = written(sample.dropDuplicates([text, label]), "toxicity-sample")
    names = vocabulary(sample, text, label, min_docs, min_g, of_best)
    if not names:
        return Model()
    number = {w: i for i, w in enumerate(names)}

    def bags(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            out = []
            for t in texts:
                found = [sorted({number[w] for w in WORD.findall(m[0].lower()) if w in number}) for m in SENTENCE.finditer(t or "")]
                known = [x for x in found if x]
                out.append((known, len(found) - len(known)))
            yield pd.DataFrame(out, columns=["bag", "others"])

    rows = sample.select(F.col(label).alias("y"), F.pandas_udf(bags, "bag array<array<int>>, others int")(F.col(text)).alias("b")).select("y", "b.*").collect()
    shares = {r[label]: r["n"] for r in agreed.groupBy(label).agg(F.count("*").alias("n")).collect()}
    bias, weights = fit_noisy_or([r.bag for r in rows], np.array([r.others for r in rows]), np.array([r.y for r in rows]), len(names), shares[1] / sum(shares.values()))
    return Model(bias, {w: float(x) for w, x in zip(names, weights)})


def judge_udf(model: Model, locate_at: float = 0.5):
    """A column function: text -> struct(score, offending array<struct(start, end, score)>), offsets in characters.

    Null and empty texts score 0 with no offending sentence.
    """

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            rows = []
            for t in texts:
                found, others = model.sentences(t)
                rows.append((model.score(found, others), [{"start": a, "end": b, "score": p} for a, b, p in found if p >= locate_at]))
            yield pd.DataFrame(rows, columns=["score", "offending"])

    return F.pandas_udf(run, "score double, offending array<struct<start:int,end:int,score:double>>")


def judge(docs: DataFrame, model: Model, key: str = "doc_id", text: str = "text", keep: tuple = ()) -> DataFrame:
    """key, kept columns, score and the offending sentences of every row; repeated rows stay, other columns go."""
    out = in_small_batches(docs).select(key, *keep, judge_udf(model)(F.col(text)).alias("_j"))
    return out.select(*out.columns[:-1], "_j.score", "_j.offending")
