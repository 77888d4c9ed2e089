"""SQL for the adapters' tables, as the start of a WITH clause."""

WORKS = r"""
c0 AS (
  SELECT * FROM (SELECT l_orderkey, l_shipdate::DATE AS completion_date, l_extendedprice AS actual_amount,
    row_number() OVER (PARTITION BY l_orderkey ORDER BY l_shipdate DESC, l_linenumber DESC, l_extendedprice DESC) AS rn FROM lineitem) WHERE rn = 1),
s0 AS (SELECT l_orderkey, bool_or(l_linestatus = 'F') AS ok FROM lineitem GROUP BY 1),
lastday AS (SELECT max(o_orderdate)::DATE AS d FROM orders),
w0 AS (
  SELECT o_orderkey AS serial, concat('MP', o_custkey, '-W', o_orderkey) AS work_ref, o_custkey AS mp_id, n_name AS state_name,
    concat(n_name, '/', c_mktsegment) AS implementing_agency, o_orderpriority AS activity_category, o_totalprice AS recommended_amount,
    o_orderdate::DATE AS recommendation_date, coalesce(s0.ok, false) AS is_sanctioned, s0.l_orderkey IS NULL AS is_orphan,
    CASE WHEN s0.l_orderkey IS NOT NULL THEN concat(o_orderpriority, ' ', n_name, '/', c_mktsegment) END AS work_description,
    CASE WHEN o_orderstatus = 'F' THEN c0.completion_date END AS completion_date, CASE WHEN o_orderstatus = 'F' THEN c0.actual_amount END AS actual_amount
  FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey
    LEFT JOIN s0 ON s0.l_orderkey = o_orderkey LEFT JOIN c0 ON c0.l_orderkey = o_orderkey),
w1 AS (
  SELECT w0.*, (completion_date IS NOT NULL)::INT AS is_completed, coalesce(recommended_amount <= 0, false) AS has_nonpositive_amount,
    coalesce(completion_date < recommendation_date, false) AS is_backdated, coalesce(completion_date > d, false) AS is_future_dated,
    completion_date IS NOT NULL AND NOT is_sanctioned AS completed_without_sanction, d AS snapshot FROM w0, lastday),
w2 AS (
  SELECT *, (is_completed = 1 AND NOT is_backdated AND NOT is_future_dated)::INT AS is_event, 1 - is_completed AS is_open,
    ln(1 + greatest(coalesce(recommended_amount, 0), 0)) AS log_amount FROM w1),
w AS (
  SELECT *, CASE WHEN days >= 0 THEN days END AS duration_days
  FROM (SELECT *, date_diff('day', recommendation_date, CASE WHEN is_event = 1 THEN completion_date ELSE snapshot END) AS days FROM w2))"""

PEERS = (
    WORKS
    + r""",
p0 AS (
  SELECT *, count(*) OVER (PARTITION BY activity_category, state_name) AS n0, count(*) OVER (PARTITION BY activity_category) AS n1,
    count(*) OVER (PARTITION BY state_name) AS n2, count(*) OVER () AS n3 FROM w),
p AS (
  SELECT *, CASE WHEN n0 >= 120 THEN 'activity_category|state_name' WHEN n1 >= 120 THEN 'activity_category' WHEN n2 >= 120 THEN 'state_name' ELSE 'global' END AS peer_level,
    CASE WHEN n0 >= 120 THEN concat('activity_category|state_name|', activity_category, '|', state_name) WHEN n1 >= 120 THEN concat('activity_category|', activity_category)
      WHEN n2 >= 120 THEN concat('state_name|', state_name) ELSE 'global' END AS peer_group,
    CASE WHEN n0 >= 120 THEN n0 WHEN n1 >= 120 THEN n1 WHEN n2 >= 120 THEN n2 ELSE n3 END AS peer_group_size,
    CASE WHEN is_open = 1 THEN duration_days END AS open_days FROM p0),
z0 AS (SELECT peer_group, quantile_cont(recommended_amount, 0.5) AS m, quantile_cont(recommended_amount, 0.25) AS q1, quantile_cont(recommended_amount, 0.75) AS q3 FROM p GROUP BY 1),
z1 AS (SELECT peer_group, quantile_cont(abs(recommended_amount - m), 0.5) AS mad FROM p JOIN z0 USING (peer_group) GROUP BY 1),
q AS (
  SELECT p.*,
    CASE WHEN count(*) OVER (PARTITION BY peer_group) > 1 THEN (rank() OVER (PARTITION BY peer_group ORDER BY recommended_amount) - 1
      + (count(*) OVER (PARTITION BY peer_group, recommended_amount) - 1) / 2.0) / (count(*) OVER (PARTITION BY peer_group) - 1) END AS amount_pct,
    CASE WHEN mad * 1.4826 > 0 THEN (recommended_amount - m) / (mad * 1.4826) WHEN q3 - q1 > 0 THEN (recommended_amount - m) / ((q3 - q1) / 1.349) ELSE 0.0 END AS amount_z,
    CASE WHEN open_days IS NOT NULL AND count(*) OVER (PARTITION BY peer_group, is_open) > 1 THEN (count(*) OVER (PARTITION BY peer_group, is_open ORDER BY open_days)
      - count(*) OVER (PARTITION BY peer_group, is_open, open_days) + (count(*) OVER (PARTITION BY peer_group, is_open, open_days) - 1) / 2.0)
      / (count(*) OVER (PARTITION BY peer_group, is_open) - 1) END AS open_pct
  FROM p JOIN z0 USING (peer_group) JOIN z1 USING (peer_group))"""
)

STEPS = r""",
y0 AS (SELECT implementing_agency, year(recommendation_date) AS y, count(*) AS n, quantile_cont(recommended_amount, 0.5) AS med FROM w GROUP BY 1, 2 HAVING count(*) >= 5),
y1 AS (SELECT *, lag(med) OVER o AS before, lag(y) OVER o AS from_year FROM y0 WINDOW o AS (PARTITION BY implementing_agency ORDER BY y)),
y2 AS (SELECT *, abs(med - before) / (before + 1e-9) AS step FROM y1 WHERE before IS NOT NULL),
cp AS (
  SELECT implementing_agency, CASE WHEN step > 0.5 THEN least(step, 1.0) ELSE 0.0 END AS change, from_year, y AS to_year, before, med AS after
  FROM (SELECT *, row_number() OVER (PARTITION BY implementing_agency ORDER BY step DESC, y) AS rn FROM y2) WHERE rn = 1)"""

SCORED = (
    PEERS
    + STEPS
    + r""",
f0 AS (
  SELECT q.*, change, CASE WHEN is_open = 1 THEN least(1.0, coalesce(duration_days, 0) / 4000.0) ELSE 0.0 END AS risk, abs(amount_z) > 3 AS outlier
  FROM q LEFT JOIN cp USING (implementing_agency)),
f1 AS (
  SELECT *, CASE WHEN amount_pct >= 0.9 THEN 1 / (1 + exp(-least(greatest(amount_z - 2, -6.0), 6.0))) ELSE 0.0 END AS sig_amount,
    CASE WHEN open_pct >= 0.9 THEN open_pct ELSE 0.0 END AS sig_duration, CASE WHEN risk >= 0.6 THEN risk ELSE 0.0 END AS sig_risk,
    0.9 * least(1.0, is_backdated::INT + completed_without_sanction::INT + is_future_dated::INT + is_orphan::INT) AS sig_conformance,
    coalesce(change, 0.0) AS sig_change, outlier::INT::DOUBLE AS sig_anomaly, 0.0 AS sig_duplicate FROM f0),
f2 AS (
  SELECT *, 1 - (1 - 0.6 * sig_amount) * (1 - 0.55 * sig_duration) * (1 - 0.6 * sig_risk) * (1 - 0.75 * sig_conformance) * (1 - 0.5 * sig_change) * (1 - 0.4 * sig_anomaly) AS priority,
    (sig_amount > 0)::INT + (sig_duration > 0 OR sig_risk > 0)::INT + (sig_conformance > 0)::INT + (sig_change > 0)::INT + (sig_anomaly > 0)::INT AS families,
    coalesce(recommended_amount, 0) * risk AS exposure FROM f1),
f3 AS (
  SELECT *, CASE WHEN families >= 3 THEN 'HIGH' WHEN families = 2 THEN 'MEDIUM' WHEN families = 1 THEN 'LOW' ELSE 'NONE' END AS band,
    priority * exposure * (1 + families) AS audit_roi, coalesce(is_open = 1 AND open_pct >= 0.99, false) AS chk_stalled, coalesce(amount_pct >= 0.99, false) AS chk_amount,
    work_description IS NULL AS chk_no_text FROM f2),
em AS (SELECT activity_category, state_name, quantile_cont(duration_days, 0.5) AS pm FROM w WHERE is_event = 1 AND duration_days IS NOT NULL GROUP BY 1, 2),
eo AS (SELECT quantile_cont(duration_days, 0.5) AS om FROM w WHERE is_event = 1 AND duration_days IS NOT NULL),
f4 AS (
  SELECT f3.*, is_orphan::INT + is_backdated::INT + is_future_dated::INT + completed_without_sanction::INT + has_nonpositive_amount::INT + chk_no_text::INT + chk_stalled::INT
      + chk_amount::INT AS checks_fired,
    CASE WHEN is_orphan OR is_backdated OR completed_without_sanction THEN 'HIGH' WHEN is_future_dated OR has_nonpositive_amount OR chk_stalled OR chk_amount THEN 'MEDIUM'
      WHEN chk_no_text THEN 'LOW' ELSE 'NONE' END AS severity,
    CASE WHEN is_open = 1 THEN duration_days / greatest(coalesce(pm, CASE WHEN om <> 0 THEN om END, 400.0), 30.0) END AS stall_ratio
  FROM f3 LEFT JOIN em USING (activity_category, state_name), eo),
f5 AS (SELECT *, CASE WHEN is_open = 1 THEN 0.6 * risk + 0.4 * least(greatest(coalesce(stall_ratio, 0) / 3, 0.0), 1.0) ELSE 0.0 END AS warning FROM f4),
scored AS (
  SELECT *, CASE WHEN warning >= 0.75 AND stall_ratio >= 2 THEN 'CRITICAL' WHEN warning >= 0.6 THEN 'HIGH' WHEN warning >= 0.4 THEN 'MEDIUM' ELSE 'LOW' END AS warning_level FROM f5)"""
)

PAYMENTS = r"""
pay AS (
  SELECT n_name AS authority, l_suppkey AS vendor, l_extendedprice * (1 - l_discount) AS amount, l_shipdate::DATE AS paid_on, l_orderkey AS serial
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey)"""


def wilson(hits: str, n: str) -> tuple[str, str]:
    p, z2 = f"({hits} / {n}::DOUBLE)", "(1.96 * 1.96)"
    middle = f"({p} + {z2} / (2 * {n})) / (1 + {z2} / {n})"
    half = f"1.96 * sqrt({p} * (1 - {p}) / {n} + {z2} / (4 * {n} * {n}::DOUBLE)) / (1 + {z2} / {n})"
    return f"CASE WHEN {n} > 0 THEN greatest({middle} - {half}, 0.0) ELSE 0.0 END", f"CASE WHEN {n} > 0 THEN least({middle} + {half}, 1.0) ELSE 1.0 END"
