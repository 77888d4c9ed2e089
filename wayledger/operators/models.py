"""Statistical models as Spark jobs: clusters, survival, hazards, outliers and the planted-anomaly harness."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.ml.clustering import KMeans
from pyspark.ml.evaluation import ClusteringEvaluator
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W

from ..sources.tables import stored
from .quantiles import quantiles


def clustered(df: DataFrame, vector: str, ks: list[int], seed: int = 42) -> tuple[DataFrame, int, dict[int, float]]:
    """The rows with a ``cluster``, for the number of clusters of best silhouette, and all silhouettes."""
    d = df.withColumn("_v", array_to_vector(F.col(vector).cast("array<double>")))
    found = {}
    for k in ks:
        model = KMeans(k=k, seed=seed, featuresCol="_v", predictionCol="cluster").fit(d)
        found[k] = (ClusteringEvaluator(featuresCol="_v", predictionCol="cluster").evaluate(model.transform(d)), model)
    best = max(found, key=lambda k: (found[k][0], -k))
    return found[best][1].transform(d).drop("_v"), best, {k: s for k, (s, _) in found.items()}


def class_terms(df: DataFrame, cluster: str, text: str, top: int = 8, min_clusters: int = 1) -> DataFrame:
    """(cluster, place, term, weight): words by count x (ln((1 + n) / (1 + clusters with it)) + 1)."""
    words = df.select(cluster, F.explode(F.split(F.lower(text), r"[^\p{L}\p{N}]+")).alias("term")).where(F.length("term") >= 2)
    counts = words.groupBy(cluster, "term").agg(F.count("*").alias("n"))
    spread = counts.groupBy("term").agg(F.count("*").alias("df")).where(F.col("df") >= min_clusters)
    k = df.select(F.countDistinct(cluster)).scalar()
    weight = F.col("n") * (F.log((1 + k) / (1 + F.col("df"))) + 1)
    ranked = counts.join(spread, "term").withColumn("weight", weight)
    place = F.row_number().over(W.Window.partitionBy(cluster).orderBy(F.desc(F.round("weight", 9)), "term"))
    return ranked.withColumn("place", place).where(F.col("place") <= top).select(cluster, "place", "term", "weight")


def kaplan_meier(df: DataFrame, keys: list[str], days: str, event: str) -> DataFrame:
    """(keys, day, at_risk, events, survival) from one aggregate by day."""
    daily = df.where(F.col(days) >= 1).groupBy(*keys, F.col(days).alias("day")).agg(F.count("*").alias("n"), F.sum(F.col(event).cast("long")).alias("events"))
    by = W.Window.partitionBy(*keys).orderBy("day")
    at_risk = F.sum("n").over(by.rowsBetween(0, W.Window.unboundedFollowing))
    out = daily.withColumn("at_risk", at_risk)
    left = F.when(F.col("events") < F.col("at_risk"), F.log(1 - F.col("events") / F.col("at_risk"))).otherwise(F.lit(-745.0))
    return out.withColumn("survival", F.exp(F.sum(left).over(by.rowsBetween(W.Window.unboundedPreceding, 0)))).drop("n")


def cox(df: DataFrame, features: list[str], days: str, event: str, penalty: float = 0.1, steps: int = 8) -> np.ndarray:
    """Weights of a proportional-hazards model with a ridge penalty, by Newton steps.

    Each step is one aggregate by day; the days (not the rows) reach the driver, where sums over later days are cut.
    """
    p = len(features)
    d = df.where(F.col(days) >= 1).select(F.col(days).alias("t"), F.col(event).cast("double").alias("e"), *[F.col(f).cast("double").alias(f"x{i}") for i, f in enumerate(features)]).na.drop()
    n = max(1, d.count())
    w = np.zeros(p)
    pairs = [(i, j) for i in range(p) for j in range(i, p)]
    for _ in range(steps):
        r = F.exp(sum((F.col(f"x{i}") * float(w[i]) for i in range(p)), F.lit(0.0)))
        rows = d.withColumn("r", r).groupBy("t").agg(
            F.sum("e").alias("d"), F.sum("r").alias("s0"), *[F.sum(F.col("e") * F.col(f"x{i}")).alias(f"a{i}") for i in range(p)],
            *[F.sum(F.col("r") * F.col(f"x{i}")).alias(f"s{i + 1}") for i in range(p)], *[F.sum(F.col("r") * F.col(f"x{i}") * F.col(f"x{j}")).alias(f"m{i}_{j}") for i, j in pairs],
        ).toPandas().sort_values("t", ascending=False)
        s0 = rows.s0.cumsum().to_numpy()
        s1 = rows[[f"s{i + 1}" for i in range(p)]].cumsum().to_numpy()
        s2 = np.zeros((len(rows), p, p))
        for i, j in pairs:
            s2[:, i, j] = s2[:, j, i] = rows[f"m{i}_{j}"].cumsum().to_numpy()
        dead, mean = rows.d.to_numpy(), s1 / s0[:, None]
        gradient = rows[[f"a{i}" for i in range(p)]].sum().to_numpy() - (dead[:, None] * mean).sum(0) - n * penalty * w
        hessian = (dead[:, None, None] * (s2 / s0[:, None, None] - mean[:, :, None] * mean[:, None, :])).sum(0) + n * penalty * np.eye(p)
        move = np.linalg.solve(hessian, gradient)
        w = w + move
        if np.abs(move).max() < 1e-8:
            break
    return w


def standardised(df: DataFrame, features: list[str]) -> DataFrame:
    """``df`` with ``_x``: the features (null counts as 0) less their mean, by their sample deviation plus 1e-9."""
    x = [F.coalesce(F.col(f).cast("double"), F.lit(0.0)) for f in features]
    one = df.agg(*[F.avg(v).alias(f"m{i}") for i, v in enumerate(x)], *[F.stddev_samp(v).alias(f"s{i}") for i, v in enumerate(x)]).first()
    return df.withColumn("_x", F.array(*[(v - F.lit(one[f"m{i}"] or 0.0)) / F.lit((one[f"s{i}"] or 0.0) + 1e-9) for i, v in enumerate(x)]))


def tree_draws(df: DataFrame, key: str, trees: int, sample: int, seed: int, n: int) -> DataFrame:
    """(tree, h, _x): about ``trees`` x ``sample`` rows in all, whatever the size of ``df``, about ``sample`` a tree.

    One pool of rows of small hash is dealt to the trees by another hash; where the table is smaller than the pool its rows
    are dealt as often as that takes.
    """
    wanted = trees * sample
    times = max(1, -(-wanted // max(n, 1)))
    chance = min(1.0, wanted / max(n * times, 1))
    h = F.xxhash64(F.lit(seed), key, "_time")
    pool = df.select(F.col(key), "_x").withColumn("_time", F.explode(F.sequence(F.lit(1), F.lit(times)))).withColumn("h", h)
    pool = pool.where(F.pmod("h", F.lit(1 << 30)) < round(chance * (1 << 30)))
    return pool.select(F.pmod(F.xxhash64("h"), F.lit(trees)).cast("int").alias("tree"), "h", "_x")


def usual_depth(n: float) -> float:
    """The mean depth of an unsuccessful search among ``n``: what a tree not grown further stands for."""
    return 2 * (np.log(n - 1) + 0.5772156649) - 2 * (n - 1) / n if n > 2 else float(n == 2)


def isolation(df: DataFrame, features: list[str], key: str | None = None, trees: int = 200, sample: int = 256, contamination: float = 0.02, seed: int = 42) -> DataFrame:
    """The rows with an isolation ``score`` and an ``outlier`` flag above the quantile of the contamination.

    Every tree is grown in a group of its own, on about ``sample`` rows of standardised features (``tree_draws``), a bounded
    sample; all rows are then scored in one pass, once.  ``key`` (the first column if not given) names a row.
    """
    key = key or df.columns[0]
    d = standardised(df, features)
    drawn = tree_draws(d, key, trees, sample, seed, df.count())

    def grow(group: pd.DataFrame) -> pd.DataFrame:
        tree = int(group.tree.iloc[0])
        rng, nodes = np.random.default_rng([seed, tree]), []
        data = np.array(group.sort_values("h")._x.tolist()).reshape(len(group), len(features))
        depth = int(np.ceil(np.log2(max(len(data), 2))))

        def split(rows: np.ndarray, level: int) -> int:
            at = len(nodes)
            nodes.append(None)
            spread = np.ptp(rows, axis=0)
            if level >= depth or len(rows) <= 1 or not spread.any():
                nodes[at] = (-1, 0.0, 0, 0, level + usual_depth(len(rows)))
                return at
            f = int(rng.choice(np.flatnonzero(spread)))
            cut = rng.uniform(rows[:, f].min(), rows[:, f].max())
            nodes[at] = (f, cut, split(rows[rows[:, f] < cut], level + 1), split(rows[rows[:, f] >= cut], level + 1), 0.0)
            return at

        split(data, 0)
        return pd.DataFrame({"tree": [tree], "nodes": [[list(map(float, t)) for t in nodes]], "rows": [len(data)]})

    grown = sorted(drawn.groupBy("tree").applyInPandas(grow, "tree int, nodes array<array<double>>, rows int").collect(), key=lambda r: r.tree)  # trees x sample nodes
    forest = [np.array(r.nodes) for r in grown]
    usual = max(usual_depth(float(np.mean([r.rows for r in grown]))) if grown else 0.0, 1e-9)

    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for b in batches:
            data, total = np.array(b.tolist()).reshape(len(b), len(features)), np.zeros(len(b))
            for nodes in forest:
                at = np.zeros(len(b), int)
                while (inner := nodes[at, 0] >= 0).any():
                    f = nodes[at, 0].astype(int)
                    goes = np.where(data[np.arange(len(b)), np.maximum(f, 0)] < nodes[at, 1], nodes[at, 2], nodes[at, 3]).astype(int)
                    at = np.where(inner, goes, at)
                total += nodes[at, 4]
            yield pd.Series(2.0 ** -(total / max(len(forest), 1) / usual))

    scored = stored(d.withColumn("score", F.pandas_udf(score, "double")(F.col("_x"))).drop("_x"))
    limit = quantiles(scored, [], "score", {"limit": 1 - contamination}).first()
    return scored.withColumn("outlier", F.col("score") > (limit.limit if limit else 1.0))


def planted(works: DataFrame, key: str, kinds: dict[str, dict[str, Column]], each: int, seed: int = 42) -> DataFrame:
    """The rows with ``planted`` (a kind or null): ``each`` rows of smallest hash a kind, changed as the kind says."""
    place = F.row_number().over(W.Window.orderBy("_h", key))
    picks = works.select(key, F.xxhash64(F.lit(seed), key).alias("_h")).orderBy("_h", key).limit(each * len(kinds)).withColumn("_p", place)
    names = F.array(*[F.lit(k) for k in kinds])
    picks = picks.select(key, F.element_at(names, (F.floor((F.col("_p") - 1) / each) + 1).cast("int")).alias("planted"))
    out = works.join(F.broadcast(picks), key, "left")
    for c in sorted({c for changes in kinds.values() for c in changes}):
        changed = F.col(c)
        for kind, changes in kinds.items():
            if c in changes:
                changed = F.when(F.col("planted") == kind, changes[c]).otherwise(changed)
        out = out.withColumn(c, changed)
    return out


def recall_at(scored: DataFrame, key: str, score: str, n: int) -> DataFrame:
    """(planted, total, found, recall): how many of each kind are among the ``n`` rows of highest score."""
    best = scored.where(F.col(score) > 0).orderBy(F.desc(score), key).limit(n).select(key).withColumn("_hit", F.lit(1))
    out = scored.where("planted is not null").join(best, key, "left").groupBy("planted").agg(F.count("*").alias("total"), F.sum(F.coalesce("_hit", F.lit(0))).alias("found"))
    return out.withColumn("recall", F.col("found") / F.col("total"))


def risk_bands(df: DataFrame, predicted: str, actual: str, edges: tuple[float, ...] = (0.2, 0.4, 0.6, 0.8)) -> DataFrame:
    """(band, n, predicted, actual): mean prediction against what happened, by band of prediction."""
    band = sum(((F.col(predicted) >= e).cast("int") for e in edges), F.lit(0))
    return df.groupBy(band.alias("band")).agg(F.count("*").alias("n"), F.avg(predicted).alias("predicted"), F.avg(F.col(actual).cast("double")).alias("actual"))


def concordance(df: DataFrame, days: str, event: str, score: str) -> DataFrame:
    """One row (pairs, concordance): how often, of an event and a later row, the event has the higher score, ties half.

    All pairs count, none is made.  The scores' ranks are numbers; of two of them the higher has a one in the highest bit in
    which they differ, where all bits above agree.  So for each bit, rows are summed by the bits above it, by day and by the
    bit itself, and a running sum over the days pairs ones with later zeros.  No window has more rows than there are days.
    Rows without days or score are left out; without pairs the concordance is null.
    """
    d = df.where(F.col(days).isNotNull() & F.col(score).isNotNull()).select(F.col(days).alias("t"), (F.col(event).cast("int") == 1).cast("long").alias("e"), F.col(score).cast("double").alias("s"))
    d = stored(d.groupBy("t", "s").agg(F.sum(F.coalesce("e", F.lit(0))).alias("events"), F.count("*").alias("n")))
    ranges = stored(d.select("s").distinct().repartitionByRange("s").withColumn("part", F.spark_partition_id()))
    sizes = ranges.groupBy("part").agg(F.count("*").alias("size"))
    before = sizes.select("part", (F.sum("size").over(W.Window.orderBy("part")) - F.col("size")).alias("before"))  # a row for each partition
    ranks = ranges.join(before, "part").select("s", (F.col("before") + F.row_number().over(W.Window.partitionBy("part").orderBy("s"))).alias("r"))
    bits = max(1, ranges.count().bit_length())
    later = W.Window.partitionBy("bit", "above").orderBy(F.desc("t")).rowsBetween(W.Window.unboundedPreceding, -1)
    each = d.join(ranks, "s").withColumn("bit", F.explode(F.sequence(F.lit(0), F.lit(bits))))
    one = F.expr("shiftright(r, bit) & 1") == 1
    # the last of the bits stands for ties and for all pairs: equal ranks, and everything
    ties = each.where(F.col("bit") == bits).select(F.lit(-1).alias("bit"), F.col("r").alias("above"), "t", F.col("events").alias("high"), F.col("n").alias("low"))
    every = each.where(F.col("bit") == bits).select(F.lit(-2).alias("bit"), F.lit(0).cast("long").alias("above"), "t", F.col("events").alias("high"), F.col("n").alias("low"))
    by_bit = each.where(F.col("bit") < bits).select("bit", F.expr("shiftright(r, bit + 1)").alias("above"), "t", F.when(one, F.col("events")).otherwise(0).alias("high"), F.when(one, 0).otherwise(F.col("n")).alias("low"))
    sums = by_bit.unionByName(ties).unionByName(every).groupBy("bit", "above", "t").agg(F.sum("high").alias("high"), F.sum("low").alias("low"))
    pairs = sums.select("bit", (F.col("high") * F.coalesce(F.sum("low").over(later), F.lit(0))).alias("pairs"))
    of = lambda wanted: F.coalesce(F.sum(F.when(wanted, F.col("pairs"))), F.lit(0))
    total, tied, right = of(F.col("bit") == -2), of(F.col("bit") == -1), of(F.col("bit") >= 0)
    return pairs.agg(total.alias("pairs"), F.when(total > 0, (right + tied / 2) / total).alias("concordance"))
