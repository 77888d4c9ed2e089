"""Visit plans under a budget of days: bundles, greedy plans for many scopes at once, strategies, trips and rotas."""

from __future__ import annotations

import heapq

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W

from ..config import DEFAULT, Thresholds


def reduced(works: DataFrame, agency: str, exposure: str, key: str, budget: float, t: Thresholds = DEFAULT, keys: tuple[str, ...] = ()) -> DataFrame:
    """Each agency's best works, numbered: no plan of ``budget`` days can hold more of one, since they go best first."""
    most = max(1 + int((budget - t.first_visit) / t.repeat_visit), t.look_ahead)
    place = F.row_number().over(W.Window.partitionBy(*keys, agency).orderBy(F.desc(exposure), key))
    return works.withColumn("place", place).where(F.col("place") <= most)


def bundle_ratios(works: DataFrame, agency: str, exposure: str, key: str, budget: float, t: Thresholds = DEFAULT) -> DataFrame:
    """(agency, ratio, size): the best exposure a day of an agency's first works, within the look-ahead and the budget."""
    by = W.Window.partitionBy(agency).orderBy("place").rowsBetween(W.Window.unboundedPreceding, 0)
    d = reduced(works, agency, exposure, key, budget, t).where(F.col("place") <= t.look_ahead)
    cost = t.first_visit + (F.col("place") - 1) * t.repeat_visit
    d = d.withColumn("cost", cost).withColumn("ratio", F.sum(exposure).over(by) / F.col("cost")).where(F.col("cost") <= budget)
    return d.groupBy(agency).agg(F.max("ratio").alias("ratio"), F.min_by("place", F.struct(-F.round("ratio", 9), "place")).alias("size"))


def greedy(group: pd.DataFrame, budget: float, agency: str, exposure: str, key: str, t: Thresholds) -> pd.DataFrame:
    """One scope's plan from its reduced works: open an agency for its best bundle, or add to an open one.

    A bundle is an agency's first works that still fit the budget, its worth the most exposure a day among them; opening takes
    one work.  An open agency's next work goes before a bundle of the same worth.  Of equal bundles the agency first met going
    down the exposures wins, of equal next works the first by name.
    """
    rows = group.sort_values([exposure, key], ascending=[False, True])
    names = pd.unique(rows[agency])
    values, works = ({a: g.tolist() for a, g in rows.groupby(agency, sort=False)[c]} for c in (exposure, key))
    costs = t.first_visit + np.arange(t.look_ahead) * t.repeat_visit
    worth = np.full((len(names), t.look_ahead), -np.inf)  # of the best bundle of at most so many works, by agency
    for row, a in zip(worth, names):
        sums = np.cumsum(values[a][: t.look_ahead])
        row[: len(sums)] = sums / costs[: len(sums)]
    worth = np.maximum.accumulate(worth, axis=1)
    taken, spent, plan = np.zeros(len(names), int), 0.0, []
    following = np.full(len(names), -np.inf)  # what an open agency's next work is worth
    alphabet = np.argsort(np.argsort(names.astype(str), kind="stable"))
    while len(names):
        left = budget - spent
        fits = int((costs <= left).sum())
        bundles = np.where(taken == 0, worth[:, fits - 1], -np.inf) if fits else np.full(len(names), -np.inf)
        fresh, more = int(bundles.argmax()), following.max() if t.repeat_visit <= left else -np.inf
        if max(bundles[fresh], more) <= 0:
            break
        at = fresh
        if more >= bundles[fresh]:
            at = int(min(np.flatnonzero(following == more), key=alphabet.__getitem__))
        cost, a = t.repeat_visit if taken[at] else t.first_visit, names[at]
        spent += cost
        plan.append((len(plan) + 1, a, works[a][taken[at]], cost, values[a][taken[at]], round(spent, 6)))
        taken[at] += 1
        following[at] = values[a][taken[at]] / t.repeat_visit if taken[at] < len(values[a]) else -np.inf
    return pd.DataFrame(plan, columns=["plan_order", "agency", "work", "cost", "exposure", "spent"])


PLAN = "plan_order int, agency string, work string, cost double, exposure double, spent double"


def plans(works: DataFrame, scope: str, budgets: list[float], agency: str, exposure: str, key: str, t: Thresholds = DEFAULT) -> DataFrame:
    """(scope, budget, plan_order, agency, work, cost, exposure, spent): a plan for each scope and budget, all at once."""
    cut = reduced(works.where(F.col(exposure) > 0), agency, exposure, key, max(budgets), t, (scope,)).select(scope, agency, key, exposure, "place")
    each = cut.withColumn("budget", F.explode(F.array(*[F.lit(float(b)) for b in budgets])))

    def run(names: tuple, group: pd.DataFrame) -> pd.DataFrame:
        out = greedy(group, names[1], agency, exposure, key, t)
        out.insert(0, "budget", names[1])
        out.insert(0, scope, names[0])
        return out

    return each.groupBy(scope, "budget").applyInPandas(run, f"{scope} string, budget double, {PLAN}")


def walked(works: DataFrame, scope: str, strategies: dict[str, str], budget: float, agency: str, exposure: str, key: str, t: Thresholds = DEFAULT) -> DataFrame:
    """(scope, strategy, works, agencies, covered): the budget spent down each order, skipping what doesn't fit."""
    orders = F.array(*[F.struct(F.lit(n).alias("strategy"), F.col(c).cast("double").alias("_o")) for n, c in strategies.items()])
    d = works.select(scope, agency, key, exposure, F.inline(orders))
    most = int(budget / t.repeat_visit) + 1
    # a walk can't take more of an agency than fits, so those are enough
    d = d.withColumn("_p", F.row_number().over(W.Window.partitionBy(scope, "strategy", agency).orderBy(F.desc("_o"), key))).where(F.col("_p") <= most)

    def run(names: tuple, group: pd.DataFrame) -> pd.DataFrame:
        left, seen, total, n = budget, set(), 0.0, 0
        for a, e in group.sort_values(["_o", key], ascending=[False, True])[[agency, exposure]].itertuples(index=False):
            cost = t.repeat_visit if a in seen else t.first_visit
            if cost <= left + 1e-9:
                left, total, n = left - cost, total + e, n + 1
                seen.add(a)
        return pd.DataFrame([(*names, n, len(seen), total)], columns=[scope, "strategy", "works", "agencies", "covered"])

    return d.groupBy(scope, "strategy").applyInPandas(run, f"{scope} string, strategy string, works int, agencies int, covered double")


def compared(walks: DataFrame, plan: DataFrame, scope: str) -> DataFrame:
    """(scope, strategy, works, agencies, covered, share_of_best): the walked strategies and the plan, of the same budget."""
    own = plan.groupBy(scope).agg(F.count("*").cast("int").alias("works"), F.countDistinct("agency").cast("int").alias("agencies"), F.sum("exposure").alias("covered"))
    every = walks.unionByName(own.withColumn("strategy", F.lit("plan")))
    best = F.max("covered").over(W.Window.partitionBy(scope))  # a few strategies a scope
    return every.withColumn("share_of_best", F.when(best > 0, F.round(F.col("covered") / best, 3)).otherwise(0.0))


#: Budgets in days that a curve of coverage shows.
PRESETS = (10.0, 20.0, 50.0, 100.0, 250.0)


def coverage_curve(works: DataFrame, scope: str, order: str, agency: str, exposure: str, key: str, budgets: tuple[float, ...] = PRESETS, t: Thresholds = DEFAULT) -> DataFrame:
    """(scope, budget, plan_works, plan_covered, walk_works, walk_covered): what plans and a walk down ``order`` cover at each budget."""
    plan = plans(works, scope, list(budgets), agency, exposure, key, t).groupBy(scope, "budget").agg(F.count("*").alias("plan_works"), F.sum("exposure").alias("plan_covered"))
    walk = None
    for b in budgets:
        one = walked(works, scope, {"walk": order}, b, agency, exposure, key, t).select(scope, F.lit(b).alias("budget"), F.col("works").alias("walk_works"), F.col("covered").alias("walk_covered"))
        walk = one if walk is None else walk.unionByName(one)
    return walk.join(plan, [scope, "budget"], "left").select(scope, "budget", F.coalesce("plan_works", F.lit(0)).alias("plan_works"), F.coalesce("plan_covered", F.lit(0.0)).alias("plan_covered"), "walk_works", "walk_covered")


def trips(plan: DataFrame, keys: list[str]) -> DataFrame:
    """A plan as one trip an agency: cost, exposure and its works in plan order."""
    return plan.groupBy(*keys, "agency").agg(
        F.round(F.sum("cost"), 6).alias("cost"), F.sum("exposure").alias("exposure"), F.min("plan_order").alias("first_order"),
        F.transform(F.array_sort(F.collect_list(F.struct("plan_order", "work"))), lambda x: x.work).alias("works"),
    )


def rota(trips_: DataFrame, keys: list[str], team: int) -> DataFrame:
    """(keys, agency, auditor, cost): whole trips, longest first, each to the least loaded of a team."""
    schema = ", ".join(f"{trips_.schema[k].name} {trips_.schema[k].dataType.simpleString()}" for k in keys) + ", agency string, auditor int, cost double"

    def run(names: tuple, group: pd.DataFrame) -> pd.DataFrame:
        loads, out = [(0.0, i) for i in range(1, team + 1)], []
        heapq.heapify(loads)
        for row in group.sort_values(["cost", "exposure", "agency"], ascending=[False, False, True]).itertuples():
            days, who = heapq.heappop(loads)
            out.append((*names, row.agency, who, row.cost))
            heapq.heappush(loads, (round(days + row.cost, 6), who))
        return pd.DataFrame(out, columns=[*keys, "agency", "auditor", "cost"])

    return trips_.groupBy(*keys).applyInPandas(run, schema)


def calendar(trips_: DataFrame, keys: list[str], *order) -> DataFrame:
    """Whole days of each trip, from and to, one after the other."""
    by = W.Window.partitionBy(*keys).orderBy(*order).rowsBetween(W.Window.unboundedPreceding, 0)
    d = trips_.withColumn("span", F.ceil(F.col("cost") - 1e-9)).withColumn("day_to", F.sum("span").over(by))
    return d.withColumn("day_from", F.col("day_to") - F.col("span") + 1)
