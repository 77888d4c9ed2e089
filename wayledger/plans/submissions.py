"""Queries on submitted photographs and documents, with the SQL that must give the same rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import adapters as A
from ..operators import submissions
from .base_sql import SCORED
from .registry import query

SENT = """+ sb AS (SELECT o_orderkey AS id, CASE WHEN o_orderkey % 13 <> 0 THEN 'MP' || o_custkey || '-W' || o_orderkey END AS read_ref, CASE WHEN o_orderkey % 5 = 0 THEN 'MP' || o_custkey || '-W' || (o_orderkey + CASE WHEN o_orderkey % 10 = 0 THEN 1 ELSE 0 END) END AS other_ref,
  CASE WHEN o_orderkey % 11 = 0 THEN 'MP' || (o_custkey + 1) || '-W' || o_orderkey WHEN o_orderkey % 4 = 0 THEN 'MP' || o_custkey || '-W' || o_orderkey END AS typed_ref, CASE WHEN o_orderkey % 6 <> 0 THEN o_totalprice * CASE WHEN o_orderkey % 9 = 0 THEN 1.02 ELSE 1.005 END END AS stated,
  CASE WHEN o_orderkey % 17 = 0 THEN 'film' WHEN o_orderkey % 2 = 0 THEN 'photo' ELSE 'document' END AS kind, o_custkey % 400 AS picture FROM orders),
kr AS (SELECT work_ref, max(recommended_amount) AS known FROM scored GROUP BY 1),
vr AS (SELECT k, substr(k, 1, i - 1) || d || substr(k, i + 1) AS m FROM (SELECT k, unnest(range(1, length(k) + 1)) AS i FROM (SELECT DISTINCT read_ref AS k FROM sb WHERE read_ref IS NOT NULL)), (SELECT unnest(range(10))::VARCHAR AS d) WHERE substr(k, i, 1) BETWEEN '0' AND '9' AND substr(k, i, 1) <> d),
al AS (SELECT k, m FROM vr WHERE m IN (SELECT work_ref FROM kr) UNION SELECT read_ref, other_ref FROM sb WHERE read_ref <> other_ref AND other_ref IN (SELECT work_ref FROM kr)),
ag AS (SELECT id, string_agg(m, ',' ORDER BY m) AS alternatives FROM (SELECT id, m, row_number() OVER (PARTITION BY id ORDER BY m) AS nth FROM (SELECT DISTINCT id, m FROM sb JOIN al ON k = read_ref WHERE m IN (SELECT m FROM vr v WHERE v.k = read_ref) OR m = other_ref)) WHERE nth <= 5 GROUP BY 1),
i0 AS (SELECT sb.*, coalesce(typed_ref, read_ref) AS reference, coalesce(alternatives, '') AS alternatives, kr.work_ref IS NOT NULL AS matched, read_ref = other_ref AS readers_agree, CASE WHEN stated > 0 AND known > 0 THEN abs(stated - known) <= greatest(known * 0.01, 1) END AS amount_agrees
  FROM sb LEFT JOIN ag USING (id) LEFT JOIN kr ON kr.work_ref = coalesce(typed_ref, read_ref)),
i1 AS (SELECT *, NOT matched OR read_ref IS NULL OR coalesce(typed_ref <> read_ref, false) OR alternatives <> '' OR NOT coalesce(readers_agree, true) OR NOT coalesce(amount_agrees, true) AS needs_confirmation FROM i0),
ids AS (SELECT *, CASE WHEN reference IS NULL OR coalesce(typed_ref <> read_ref, false) THEN 'BLOCKED' WHEN read_ref IS NULL THEN 'ATTENTION' WHEN typed_ref IS NOT NULL THEN 'OK' WHEN needs_confirmation THEN 'ATTENTION' ELSE 'OK' END AS identity FROM i1)"""


def sent(spark, d):
    """Orders as submissions: some unread, read otherwise by the second reader, or contradicted by the form."""
    o, k = A.table(spark, d, "orders"), F.col("o_orderkey")
    ref = lambda owner, serial: F.concat(F.lit("MP"), owner, F.lit("-W"), serial)
    own = ref(F.col("o_custkey"), k)
    return o.select(
        k.alias("id"), F.when(k % 13 != 0, own).alias("read_ref"), F.when(k % 5 == 0, ref(F.col("o_custkey"), k + F.when(k % 10 == 0, 1).otherwise(0))).alias("other_ref"), F.when(k % 11 == 0, ref(F.col("o_custkey") + 1, k)).when(k % 4 == 0, own).alias("typed_ref"),
        F.when(k % 6 != 0, F.col("o_totalprice") * F.when(k % 9 == 0, 1.02).otherwise(1.005)).alias("stated"), F.when(k % 17 == 0, "film").when(k % 2 == 0, "photo").otherwise("document").alias("kind"), (F.col("o_custkey") % 400).alias("picture"),
    )


@query(SENT + " SELECT id, reference, alternatives, matched, readers_agree, amount_agrees, needs_confirmation, identity FROM ids", SCORED)
def submission_identity(spark, d):
    """What each submission is about, and how sure that is."""
    out = submissions.identified(sent(spark, d), A.scored(spark, d))
    return out.select("id", "reference", F.array_join("alternatives", ",").alias("alternatives"), "matched", "readers_agree", "amount_agrees", "needs_confirmation", "identity")


@query(SENT + """, us AS (SELECT picture, count(DISTINCT id) - 1 AS others FROM sb WHERE kind = 'photo' AND id % 3 = 0 GROUP BY 1), j AS (SELECT ids.*, others, amount_pct, checks_fired, warning_level, band, kind IN ('photo', 'document') AS taken FROM ids LEFT JOIN scored ON reference = work_ref LEFT JOIN us USING (picture)),
st AS (SELECT id, needs_confirmation, band, taken AND matched AS known, CASE WHEN NOT taken THEN 'received:BLOCKED' ELSE concat_ws(',', 'received:OK', CASE WHEN read_ref IS NULL THEN 'read:INFO' ELSE 'read:OK' END, 'identify:' || identity, CASE WHEN reference IS NULL THEN NULL WHEN matched THEN 'record:OK' ELSE 'record:BLOCKED' END,
  CASE WHEN matched THEN concat_ws(',', 'picture:' || CASE WHEN kind = 'photo' THEN CASE WHEN others > 0 THEN 'ATTENTION' ELSE 'OK' END WHEN read_ref = reference THEN 'OK' ELSE 'INFO' END, 'amount:' || CASE WHEN amount_agrees IS NULL THEN 'INFO' WHEN amount_agrees THEN 'OK' ELSE 'ATTENTION' END,
  'peers:' || CASE WHEN amount_pct >= 0.99 OR amount_pct <= 0.01 THEN 'ATTENTION' ELSE 'OK' END, 'lifecycle:' || CASE WHEN checks_fired > 0 THEN 'ATTENTION' ELSE 'OK' END, 'risk:' || CASE WHEN warning_level IN ('HIGH', 'CRITICAL') THEN 'ATTENTION' ELSE 'OK' END, 'duplicate:OK',
  'lead:' || CASE WHEN band IN ('MEDIUM', 'HIGH') THEN 'ATTENTION' ELSE 'INFO' END) END) END AS stages FROM j)
SELECT id, stages, CASE WHEN NOT known THEN 'BLOCKED' WHEN needs_confirmation THEN 'CONFIRM' WHEN band IN ('MEDIUM', 'HIGH') THEN 'LEAD' ELSE 'CLEAR' END AS outcome FROM st""", SCORED)
def submission_stages(spark, d):
    """Each submission's way through all stages, up to the one that blocks it."""
    rows, s = sent(spark, d), A.scored(spark, d)
    reused = rows.where("kind = 'photo' AND id % 3 = 0").groupBy("picture").agg((F.countDistinct("id") - 1).alias("others"))
    out = submissions.chained(submissions.identified(rows, s), s, reused)
    return out.select("id", F.array_join(F.transform("stages", lambda x: F.concat(x.stage, F.lit(":"), x.status)), ",").alias("stages"), "outcome")
