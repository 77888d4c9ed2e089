"""Completion risk: proportional hazards on one-hot features, the baseline survival, and each work's risk at a horizon."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.tables import stored
from .quantiles import quantiles

OTHER = "OTHER"


@dataclass(frozen=True)
class Frame:
    """How rows become features: log amount (missing: the median), a flag, and the commonest values of some columns.

    ``levels`` has each column's values in order; the first is left out, and what is not among them counts as OTHER.
    """

    amount: str
    flag: str
    median: float
    levels: tuple[tuple[str, tuple[str, ...]], ...]

    @property
    def names(self) -> list[str]:
        return ["log_amount", self.flag, *(f"{c}={v}" for c, values in self.levels for v in values[1:])]

    def lumped(self, column: str, values: tuple[str, ...]) -> Column:
        known = F.col(column).cast("string")
        return F.when(known.isin(*[v for v in values if v != OTHER]), known).otherwise(OTHER)

    def features(self) -> list[Column]:
        amount = F.log1p(F.greatest(F.coalesce(F.col(self.amount).cast("double"), F.lit(self.median)), F.lit(0.0)))
        dummies = [(self.lumped(c, values) == v).cast("double") for c, values in self.levels for v in values[1:]]
        return [amount, F.coalesce(F.col(self.flag).cast("double"), F.lit(0.0)), *dummies]


def framed(works: DataFrame, amount: str, flag: str, lumps: dict[str, int]) -> Frame:
    """The features' fixed values: the median amount and each column's ``lumps`` commonest values, of equally common ones the first."""
    middle = quantiles(works, [], amount, {"m": 0.5}).first()
    levels = []
    for column, n in lumps.items():
        known = works.where(F.col(column).isNotNull()).groupBy(F.col(column).cast("string").alias("v")).agg(F.count("*").alias("n"))
        common = [r.v for r in known.orderBy(F.desc("n"), "v").limit(n).collect()]
        rest = not works.where(F.col(column).isNull() | ~F.col(column).cast("string").isin(*common)).isEmpty() if common else True
        levels.append((column, tuple(sorted({*common, OTHER} if rest else common))))
    return Frame(amount, flag, float(middle.m) if middle else 0.0, tuple(levels))


@dataclass(frozen=True)
class Hazard:
    frame: Frame
    weights: tuple[float, ...]
    centre: float  # the weighted features of the mean row
    days: tuple[float, ...]  # of events, ascending
    survival: tuple[float, ...]  # of the mean row after each

    def baseline(self, horizon: float) -> float:
        """The mean row's survival at ``horizon``, between two days by the share of the way; 1 where there are no events."""
        return float(np.interp(horizon, self.days, self.survival)) if self.days else 1.0

    def partial(self) -> Column:
        """exp of the weighted features against the mean row's."""
        terms = [x * w for x, w in zip(self.frame.features(), self.weights)]
        return F.exp(sum(terms, F.lit(-self.centre)))


def _sums(x: np.ndarray, r: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
    weighted = x * r[:, None]
    return float(r.sum()), weighted.sum(0), weighted.T @ x


def fit(works: DataFrame, frame: Frame, key: str, days: str, event: str, most: int = 60_000, penalty: float = 0.1, steps: int = 25, seed: int = 42) -> Hazard:
    """Weights of the penalised partial likelihood (ties by Efron's rule) on standardised features, by Newton steps.

    Rows whose days are null or below 1 are left out.  The documented bound: about ``most`` rows are learnt from, those of
    smallest hash.  They are kept in ranges of days; in a step every range first sums its rows, and then, given the sums of
    all later ranges, its part of gradient and curvature.  The driver gets these sums and one row for each day with an event.
    """
    rows = works.where(F.col(days) >= 1)
    n = rows.count()
    fraction = min(1.0, most / max(n, 1))
    picked = rows.where(F.pmod(F.xxhash64(F.lit(seed), key), F.lit(1 << 30)) < int(fraction * (1 << 30))) if fraction < 1 else rows
    sample = picked.select(F.col(days).cast("double").alias("t"), F.coalesce(F.col(event).cast("double"), F.lit(0.0)).alias("e"), F.array(*frame.features()).alias("x"))
    sample = stored(sample.repartitionByRange("t").withColumn("part", F.spark_partition_id()))
    p = len(frame.names)
    moments = sample.select(F.count("*").alias("n"), *[F.avg(F.get("x", F.lit(i))).alias(f"m{i}") for i in range(p)], *[F.stddev_samp(F.get("x", F.lit(i))).alias(f"s{i}") for i in range(p)]).first()
    count = moments["n"]
    mean = np.array([moments[f"m{i}"] or 0.0 for i in range(p)])
    scale = np.array([moments[f"s{i}"] or 0.0 for i in range(p)])
    scale = np.where(scale > 1e-12, scale, 1.0)

    def each_range(work, schema: str) -> list:
        def run(data: pd.DataFrame) -> pd.DataFrame:
            x = (np.array(data.x.tolist(), dtype=float).reshape(len(data), p) - mean) / scale
            return work(int(data.part.iloc[0]), data.t.to_numpy(), data.e.to_numpy(), x)

        return sorted(sample.groupBy("part").applyInPandas(run, schema).collect(), key=lambda r: r.part)

    def by_day(t: np.ndarray, e: np.ndarray, x: np.ndarray, r: np.ndarray, later: tuple) -> Iterator[tuple]:
        """(day, events, their features, sums of all at risk, sums of the events), days descending."""
        at_risk = later
        order = np.argsort(-t, kind="stable")
        cuts = np.flatnonzero(np.diff(t[order])) + 1
        for rows in np.split(order, cuts):
            at_risk = tuple(a + b for a, b in zip(at_risk, _sums(x[rows], r[rows])))
            dead = rows[e[rows] > 0]
            if len(dead):
                yield t[rows[0]], x[dead], at_risk, _sums(x[dead], r[dead])

    def later_sums(w: np.ndarray) -> dict[int, tuple]:
        def total(part, t, e, x):
            s0, s1, s2 = _sums(x, np.exp(x @ w))
            return pd.DataFrame({"part": [part], "s0": [s0], "s1": [s1.tolist()], "s2": [s2.reshape(-1).tolist()]})

        out, behind = {}, (0.0, np.zeros(p), np.zeros((p, p)))
        for row in reversed(each_range(total, "part int, s0 double, s1 array<double>, s2 array<double>")):
            out[row.part] = behind
            behind = (behind[0] + row.s0, behind[1] + np.array(row.s1), behind[2] + np.array(row.s2).reshape(p, p))
        return out

    w = np.zeros(p)
    for _ in range(steps if count else 0):
        later = later_sums(w)

        def slopes(part, t, e, x):
            r, gradient, curvature = np.exp(x @ w), np.zeros(p), np.zeros((p, p))
            for _, dead, (s0, s1, s2), (d0, d1, d2) in by_day(t, e, x, r, later[part]):
                share = np.arange(len(dead)) / len(dead)
                left = s0 - share * d0
                means = (s1 - share[:, None] * d1) / left[:, None]
                gradient += dead.sum(0) - means.sum(0)
                curvature += s2 * (1 / left).sum() - d2 * (share / left).sum() - means.T @ means
            return pd.DataFrame({"part": [part], "g": [gradient.tolist()], "h": [curvature.reshape(-1).tolist()]})

        found = each_range(slopes, "part int, g array<double>, h array<double>")
        gradient = np.sum([r.g for r in found], axis=0) / count - penalty * w
        curvature = np.sum([r.h for r in found], axis=0).reshape(p, p) / count + penalty * np.eye(p)
        move = np.linalg.solve(curvature, gradient)
        w = w + move
        if np.abs(move).max() < 1e-9:
            break
    later = later_sums(w) if count else {}

    def hazards(part, t, e, x):
        found = [(part, day, len(dead) / s0) for day, dead, (s0, _, _), _ in by_day(t, e, x, np.exp(x @ w), later[part])]
        return pd.DataFrame(found, columns=["part", "day", "hazard"])

    table = sorted((r.day, r.hazard) for r in each_range(hazards, "part int, day double, hazard double")) if count else []
    raw = w / scale
    survival = np.exp(-np.cumsum([h for _, h in table]))
    return Hazard(frame, tuple(raw.tolist()), float(raw @ mean), tuple(d for d, _ in table), tuple(survival.tolist()))


def at_horizon(works: DataFrame, model: Hazard, days: str, open_: str, horizon: float = 365.0, name: str = "risk", completed: bool = False) -> DataFrame:
    """``works`` with ``p_incomplete``, S0(horizon) ^ exp(xb), and ``p_complete``, what is left to 1, where the model covers them
    (days of 1 or more, else null); and ``name``: for open works the first (the second if ``completed``), else 0.

    Both are chances at the horizon counted from a work's start; published scores take the second for the risk.
    """
    left = F.when(F.col(days) >= 1, F.pow(F.lit(model.baseline(horizon)), model.partial()))
    out = works.withColumn("p_incomplete", F.greatest(F.lit(0.0), F.least(F.lit(1.0), left))).withColumn("p_incomplete", F.when(left.isNotNull(), F.col("p_incomplete")))
    out = out.withColumn("p_complete", 1 - F.col("p_incomplete"))
    return out.withColumn(name, F.when(F.col(open_) == 1, F.coalesce("p_complete" if completed else "p_incomplete", F.lit(0.0))).otherwise(0.0))


def weights_table(model: Hazard, spark) -> DataFrame:
    """(feature, weight, ratio): what a unit more of each feature adds to the log hazard, and the factor that makes."""
    rows = [(n, float(w), float(np.exp(w))) for n, w in zip(model.frame.names, model.weights)]
    return spark.createDataFrame(rows, "feature string, weight double, ratio double")
