"""Greedy plans against a rescan of everything at every step; strategies and curves on the same budget."""

import random

import pytest

from wayledger.operators import planning

FIRST, MORE, AHEAD = 1.0, 0.35, 40
TOY = [("CLUSTER", f"c{i}", 40.0) for i in range(8)] + [("REMOTE", "r", 90.0), ("FARAWAY", "f", 85.0)]


def rescanned(works, budget):
    """(agency, work) in plan order, every agency looked at anew at every step."""
    rows = sorted(works, key=lambda w: (-w[2], w[1]))
    agencies = list(dict.fromkeys(a for a, _, _ in rows))
    queue = {a: [w for w in rows if w[0] == a] for a in agencies}
    opened, spent, plan = set(), 0.0, []
    while True:
        left, best = budget - spent, (0.0, None)
        for a in agencies:
            if a not in opened and FIRST <= left:
                total = 0.0
                for i, w in enumerate(queue[a][:AHEAD]):
                    total += w[2]
                    cost = FIRST + i * MORE
                    if cost <= left and total / cost > best[0]:
                        best = (total / cost, a)
        going = [(-queue[a][0][2] / MORE, a) for a in opened if queue[a]] if MORE <= left else []
        if going and -min(going)[0] >= best[0] and min(going)[0] < 0:
            a, cost = min(going)[1], MORE
        elif best[1]:
            a, cost = best[1], FIRST
        else:
            return plan
        opened.add(a)
        spent += cost
        plan.append(queue[a].pop(0)[:2])


def frame(spark, works, state="s"):
    return spark.createDataFrame([(state, a, k, e, e * 2, float(i)) for i, (a, k, e) in enumerate(works)], "state string, agency string, work string, exposure double, amount double, roi double")


def planned(spark, works, budgets):
    out = {float(b): [] for b in budgets}
    for r in planning.plans(frame(spark, works), "state", [float(b) for b in budgets], "agency", "exposure", "work").orderBy("plan_order").collect():
        out[r.budget].append((r.agency, r.work))
        assert r.spent <= r.budget + 1e-9
    return out


def test_toy_plans(spark):
    budgets = (0, 1, 2, 3, 3.5, 4, 5, 6, 10)
    got = planned(spark, TOY, budgets)
    assert all(got[float(b)] == rescanned(TOY, b) for b in budgets)
    worth = {k: e for _, k, e in TOY}
    covered = [sum(worth[k] for _, k in got[float(b)]) for b in budgets]
    assert covered == sorted(covered) and covered[3] <= 240 and got[0.0] == []


@pytest.mark.parametrize("seed", range(4))
def test_random_plans_with_many_ties(spark, seed):
    rng = random.Random(seed)
    works = [(f"a{rng.randrange(12):02d}", f"w{i:03d}", float(rng.choice([10, 10, 20, 20, 35, 70]))) for i in range(150)]
    got = planned(spark, works, (2.5, 7, 20))
    assert all(got[float(b)] == rescanned(works, b) for b in (2.5, 7, 20))


def test_agencies_first_met_win_ties(spark):
    works = [("zeta", "w1", 50.0), ("alpha", "w2", 50.0), ("beta", "w0", 50.0)]
    assert planned(spark, works, (2,))[2.0] == [("beta", "w0"), ("zeta", "w1")]


def test_strategies_and_curve(spark):
    d = frame(spark, TOY).unionByName(frame(spark, [("x", "x1", 5.0)], "t"))
    walks = planning.walked(d, "state", {"amount": "amount", "roi": "roi"}, 4.0, "agency", "exposure", "work")
    got = {(r.state, r.strategy): (r.works, r.covered, r.share_of_best) for r in planning.compared(walks, planning.plans(d, "state", [4.0], "agency", "exposure", "work"), "state").collect()}
    assert max(v[2] for k, v in got.items() if k[0] == "s") == 1.0 == got["s", "plan"][2] and got["t", "plan"] == (1, 5.0, 1.0)
    assert set(got) == {(s, k) for s in "st" for k in ("amount", "roi", "plan")}
    curve = {(r.state, r.budget): (r.plan_works, r.plan_covered, r.walk_works) for r in planning.coverage_curve(d, "state", "roi", "agency", "exposure", "work", (1.0, 4.0, 20.0)).collect()}
    assert len(curve) == 6 and curve["s", 20.0][:2] == (10, 495.0) and curve["t", 1.0] == (1, 5.0, 1) and curve["s", 4.0][1] >= curve["s", 1.0][1]
