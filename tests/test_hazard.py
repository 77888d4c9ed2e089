"""The fitted hazards against plain NumPy."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from wayledger.operators import hazard


@pytest.fixture(scope="module")
def works(spark):
    rng = np.random.default_rng(7)
    rows = []
    for i in range(700):
        state = rng.choice(["a", "b", "c", "d", "e"], p=[0.4, 0.3, 0.2, 0.05, 0.05])
        amount = None if i % 50 == 0 else float(rng.lognormal(10, 1))
        flag = int(rng.integers(0, 2))
        rate = 0.02 * np.exp(0.8 * flag - 0.3 * (state == "b"))
        day, stop = int(rng.exponential(1 / rate)), int(rng.integers(20, 90))
        rows.append((f"w{i:04d}", state, amount, flag, min(day, stop), int(day <= stop), int(day > stop)))
    rows += [("null", None, 1.0, 1, None, 0, 1), ("zero", "a", 1.0, 1, 0, 1, 0)]
    return spark.createDataFrame(rows, "key string, state string, amount double, flag int, days int, event int, open int")


def plain(works):
    d = works.where("days >= 1").toPandas().sort_values("key")
    median = works.toPandas().amount.median()
    levels = sorted(["a", "b", "c", "OTHER"])
    state = d.state.where(d.state.isin(["a", "b", "c"]), "OTHER")
    x = np.column_stack([np.log1p(d.amount.fillna(median)), d.flag, *[(state == v).astype(float) for v in levels[1:]]])
    mean, sd = x.mean(0), x.std(0, ddof=1)
    z, t, e = (x - mean) / sd, d.days.to_numpy(), d.event.to_numpy()
    w = np.zeros(z.shape[1])
    for _ in range(50):
        r, g, h = np.exp(z @ w), np.zeros(len(w)), np.zeros((len(w), len(w)))
        for day in np.unique(t[e == 1]):
            risk, dead = t >= day, np.flatnonzero((t == day) & (e == 1))
            for k in range(len(dead)):
                weight = r * risk
                weight[dead] -= r[dead] * k / len(dead)
                m = weight @ z / weight.sum()
                g += z[dead[k]] - m
                h += (z * weight[:, None]).T @ z / weight.sum() - np.outer(m, m)
        w = w + np.linalg.solve(h / len(z) + 0.1 * np.eye(len(w)), g / len(z) - 0.1 * w)
    days = np.unique(t[e == 1])
    s0 = np.exp(-np.cumsum([((t == day) & (e == 1)).sum() / np.exp(z @ w)[t >= day].sum() for day in days]))
    risk = 1 - np.interp(40, days, s0) ** np.exp(z @ w)
    return w / sd, dict(zip(days, s0)), dict(zip(d.key, np.where(d.open == 1, risk, 0.0)))


def test_weights_baseline_and_risk_equal_numpy(spark, works):
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # several ranges of days
    try:
        frame = hazard.framed(works, "amount", "flag", {"state": 3})
        model = hazard.fit(works, frame, "key", "days", "event")
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert frame.levels == (("state", ("OTHER", "a", "b", "c")),) and frame.names == ["log_amount", "flag", "state=a", "state=b", "state=c"]
    w, s0, risk = plain(works)
    assert np.allclose(model.weights, w, atol=1e-7)
    assert np.allclose(list(model.survival), list(s0.values()), atol=1e-9) and list(model.days) == list(s0)
    got = {r.key: r.risk for r in hazard.at_horizon(works, model, "days", "open", 40, completed=True).collect()}
    left = {r.key: (r.risk, r.p_incomplete, r.p_complete) for r in hazard.at_horizon(works, model, "days", "open", 40).collect()}
    assert all(abs(left[k][2] - (1 - left[k][1])) < 1e-12 and (v == 0 or abs(left[k][0] + v - 1) < 1e-9) for k, v in risk.items()) and left["null"] == (0, None, None)
    assert len(got) == 702 and got["null"] == 0 and got["zero"] == 0
    assert all(abs(got[k] - v) < 1e-9 for k, v in risk.items()) and max(risk.values()) > 0.3
    table = hazard.weights_table(model, spark).collect()
    assert [r.feature for r in table] == frame.names and table[1].ratio > 1


def test_the_sample_is_bounded_and_nothing_fits(works):
    frame = hazard.framed(works, "amount", "flag", {"state": 3})
    few = hazard.fit(works, frame, "key", "days", "event", most=200)
    assert few.weights != hazard.fit(works, frame, "key", "days", "event").weights
    none = works.limit(0)
    empty = hazard.fit(none, hazard.framed(none, "amount", "flag", {"state": 3}), "key", "days", "event")
    assert empty.baseline(10) == 1.0 and hazard.at_horizon(works, empty, "days", "open", completed=True).select(F.max("risk")).first()[0] == 0
    never = works.withColumn("event", F.lit(0))
    assert hazard.fit(never, frame, "key", "days", "event").baseline(10) == 1.0


def test_sql_over_the_stored_risk(spark, works, tmp_path):
    """The risk's place in the fusion, said again in SQL over the stored column."""
    import duckdb

    from wayledger.operators import signals

    model = hazard.fit(works, hazard.framed(works, "amount", "flag", {"state": 3}), "key", "days", "event")
    d = hazard.at_horizon(works, model, "days", "open", 60, completed=True)
    for c, v in {"amount_pct": 0.0, "amount_z": 0.0, "open_pct": 0.0, "change": 0.0, "similarity": 0.0}.items():
        d = d.withColumn(c, F.lit(v))
    d = d.withColumns({"outlier": F.lit(False), "recommended_amount": F.col("amount")} | {c: F.lit(False) for c in ("is_backdated", "completed_without_sanction", "is_future_dated", "is_orphan")})
    d.write.parquet(str(tmp_path / "risk"))
    got = {r.key: (r.families, round(r.priority, 9), round(r.audit_roi, 4)) for r in signals.fused(spark.read.parquet(str(tmp_path / "risk"))).collect()}
    rows = duckdb.sql(f"""SELECT key, (risk >= .6)::INT AS f, CASE WHEN risk >= .6 THEN .6 * risk ELSE 0 END AS p, coalesce(amount, 0) * risk AS x
        FROM '{tmp_path}/risk/*.parquet'""").fetchall()
    assert got == {k: (f, round(p, 9), round(p * x * (1 + f), 4)) for k, f, p, x in rows} and any(v[0] for v in got.values())
