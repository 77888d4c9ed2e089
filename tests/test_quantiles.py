"""Exact ranks and quantiles by ranges, against pandas."""

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from wayledger.operators import peers, quantiles


def frame(spark):
    rng = np.random.default_rng(3)
    rows = [("big", float(v)) for v in rng.integers(0, 4000, 6000)] + [("small", 5.0)] * 3 + [(None, float(v)) for v in range(7)] + [("big", None)] * 5 + [("empty", None)] + [("one", 2.0)]
    return spark.createDataFrame(rows, "g string, v double"), pd.DataFrame(rows, columns=["g", "v"])


def in_many_ranges(spark):
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")


def test_a_group_is_spread_over_ranges(spark):
    d, p = frame(spark)
    in_many_ranges(spark)
    try:
        found = quantiles.ranges(d, ["g"], "v")
        by = {(r._g.g, r._v): r for r in found.collect()}
        placed = d.groupBy("g", "v").count().orderBy("g", "v").withColumn("r", F.spark_partition_id())
        assert placed.where("g = 'big'").select("r").distinct().count() > 1
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    for g, rows in p.dropna(subset=["v"]).groupby("g", dropna=False):
        key = None if pd.isna(g) else g
        for v, n in rows.v.value_counts().items():
            r = by[(key, v)]
            assert (r._same, r._below, r._n) == (n, int((rows.v < v).sum()), len(rows))


def test_quantiles_and_ranks_equal_pandas(spark):
    d, p = frame(spark)
    got = {r.g: r for r in quantiles.quantiles(d, ["g"], "v", {"a": 0.25, "b": 0.5, "c": 0.98}).collect()}
    want = p.dropna(subset=["v"]).groupby("g", dropna=False).v
    assert len(got) == 4
    for g, v in want:
        r = got[None if pd.isna(g) else g]
        assert np.allclose([r.a, r.b, r.c], np.quantile(v, [0.25, 0.5, 0.98]))
    ranked = peers.leave_one_out_percentile(d, ["g"], "v", "pct").toPandas()
    p["want"] = p.groupby("g", dropna=False).v.rank()
    sizes = p.groupby("g", dropna=False).v.transform("size")
    p["want"] = ((p.want - 1) / (sizes - 1)).where(sizes > 1)
    order = ["g", "v"]
    a, b = ranked.sort_values(order, na_position="last").reset_index(drop=True), p.sort_values(order, na_position="last").reset_index(drop=True)
    assert len(a) == len(b) and np.allclose(a.pct.astype(float), b.want.astype(float), equal_nan=True)


def test_robust_z_falls_back(spark):
    rows = [("mad", v) for v in (1.0, 2.0, 3.0, 9.0)] + [("iqr", v) for v in (1.0, 1.0, 1.0, 1.0, 1.0, 5.0, 6.0)] + [("flat", 2.0)] * 3 + [("flat", None), (None, 1.0), (None, 3.0)]
    d = spark.createDataFrame(rows, "g string, v double")
    got = {(r.g, r.v): r.z for r in peers.robust_z(d, ["g"], "v", "z").collect()}
    assert np.isclose(got[("mad", 9.0)], 6.5 / 1.4826) and np.isclose(got[("iqr", 6.0)], 5 / (2.0 / 1.349))
    assert got[("flat", 2.0)] == 0.0 and got[("flat", None)] is None and np.isclose(got[(None, 3.0)], 1 / 1.4826)
    rough = {(r.g, r.v): r.z for r in peers.robust_z(d, ["g"], "v", "z", approximate=True).collect()}
    assert rough.keys() == got.keys()
    assert peers.robust_z(d.limit(0), ["g"], "v", "z").count() == 0
