"""Outliers, near neighbours by planes: against plain NumPy."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from wayledger.operators import duplicates, models


def plain_forest(draws, trees, features, seed, rows):
    """Scores of ``rows`` by a forest grown on the same draws."""
    total, sizes = np.zeros(len(rows)), []
    for tree in range(trees):
        data = np.array([x for _, x in sorted(draws[tree])]).reshape(-1, features)
        if not len(data):
            continue
        sizes.append(len(data))
        rng, deepest = np.random.default_rng([seed, tree]), int(np.ceil(np.log2(max(len(data), 2))))

        def walk(sample, at, level):  # noqa: B023
            spread = np.ptp(sample, axis=0)
            if level >= deepest or len(sample) <= 1 or not spread.any():  # noqa: B023
                n = len(sample)
                total[at] += level + (2 * (np.log(n - 1) + 0.5772156649) - 2 * (n - 1) / n if n > 2 else float(n == 2))
                return
            f = int(rng.choice(np.flatnonzero(spread)))  # noqa: B023
            cut = rng.uniform(sample[:, f].min(), sample[:, f].max())  # noqa: B023
            low = rows[at, f] < cut
            walk(sample[sample[:, f] < cut], at[low], level + 1)
            walk(sample[sample[:, f] >= cut], at[~low], level + 1)

        walk(data, np.arange(len(rows)), 0)
    n = np.mean(sizes)
    return 2.0 ** -(total / len(sizes) / (2 * (np.log(n - 1) + 0.5772156649) - 2 * (n - 1) / n))


@pytest.mark.parametrize("n", [60, 900])
def test_forest_equals_numpy_with_the_same_draws(spark, n):
    rng = np.random.default_rng(n)
    rows = [(i, float(a), float(b)) for i, (a, b) in enumerate(rng.standard_normal((n, 2)))]
    rows[3] = (3, 9.0, None)
    d = spark.createDataFrame(rows, "k long, a double, b double")
    trees, sample = 15, 32
    got = {r.k: (r.score, r.outlier) for r in models.isolation(d, ["a", "b"], "k", trees=trees, sample=sample).collect()}
    x = np.array([[a, b or 0.0] for _, a, b in rows])
    x = (x - x.mean(0)) / (x.std(0, ddof=1) + 1e-9)
    std = models.standardised(d, ["a", "b"])
    assert np.allclose([r._x for r in std.orderBy("k").collect()], x)
    draws = {t: [] for t in range(trees)}
    for r in models.tree_draws(std, "k", trees, sample, 42, n).collect():
        draws[r.tree].append((r.h, list(r._x)))
    assert abs(sum(map(len, draws.values())) - trees * sample) < 6 * np.sqrt(trees * sample)
    want = plain_forest(draws, trees, 2, 42, x)
    assert np.allclose([got[i][0] for i in range(n)], want)
    assert [got[i][1] for i in range(n)] == list(want > np.quantile(want, 0.98)) and got[3][1]


def test_forest_of_nothing(spark):
    assert models.isolation(spark.createDataFrame([], "k long, a double"), ["a"], trees=3).count() == 0


def test_planes_find_what_the_exact_join_finds(spark):
    rng = np.random.default_rng(5)
    centres = rng.standard_normal((150, 24))
    rows = [(i, int(i % 2), [float(v) for v in centres[i % 150] + 0.25 * rng.standard_normal(24)]) for i in range(1200)]
    rows += [(2000 + i, 0, rows[0][2]) for i in range(300)] + [(3000, 0, None)]  # copies of one row
    d = spark.createDataFrame(rows, "k long, b int, v array<double>")
    exact = {(r.a, r.b): r.similarity for r in duplicates.block_pairs(d, "k", ["b"], "v").collect()}
    near = {(r.a, r.b): r.similarity for r in duplicates.block_pairs(d, "k", ["b"], "v", exact=False).collect()}
    assert len(exact) > 3000 and all(near[p] == exact[p] for p in near if p in exact)
    recall = len(exact.keys() & near.keys()) / len(exact)
    print("recall", recall)
    assert recall >= 0.97
    copies = {p for p in exact if exact[p] == 1.0}
    assert copies <= near.keys() and len(copies) > 300
    whole = {(r.a, r.b) for r in duplicates.block_pairs(d, "k", ["b"], "v", exact=False, missed=1e-9).collect()}
    assert whole == exact.keys()
    assert duplicates.block_pairs(d.limit(0), "k", ["b"], "v", exact=False).count() == 0


def test_draws_follow_the_chance():
    assert duplicates.draws_for(0.97, 8, 0.02) < duplicates.draws_for(0.86, 8, 0.02) < duplicates.draws_for(0.86, 8, 1e-6)
    together = (1 - np.arccos(0.86) / np.pi) ** 8
    assert (1 - together) ** duplicates.draws_for(0.86, 8, 0.02) <= 0.02 < (1 - together) ** (duplicates.draws_for(0.86, 8, 0.02) - 1)
