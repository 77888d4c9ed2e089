"""One query an operator, over the star-schema tables, with the SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import adapters as A
from ..functions import columns as C
from ..operators import assess, canonical, changes, duplicates, extract, models, peers, planning, reports, series, signals
from ..sources.tables import stored
from ..streaming import feed as streaming
from .base_sql import PAYMENTS, PEERS, SCORED, STEPS, WORKS, wilson

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None, base: str = ""):
    """Registers a function under its name; ``base`` starts the WITH clause of its SQL."""

    def put(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = (f"WITH {base}{',' if sql.lstrip().startswith('+') else ''} " + sql.lstrip().removeprefix("+")) if base else sql
        return f

    return put


def r(c: str | Column, places: int = 4, name: str | None = None) -> Column:
    return F.round(c, places).alias(name or c)


# ------------------------------------------------------------------------------------------------ canonical model


@query("SELECT work_ref, mp_id, state_name, is_sanctioned, is_completed, completion_date::VARCHAR AS completion_date, is_orphan, has_nonpositive_amount, is_backdated, is_future_dated, completed_without_sanction, duration_days, round(log_amount, 6) AS log_amount FROM w", WORKS)
def canonical_works(spark, d):
    w = A.conformed(spark, d)
    names = ["work_ref", "mp_id", "state_name", "is_sanctioned", "is_completed", "is_orphan", "has_nonpositive_amount", "is_backdated", "is_future_dated", "completed_without_sanction", "duration_days"]
    return w.select(*names, F.col("completion_date").cast("string"), r("log_amount", 6))


@query("""SELECT o_orderkey AS key, stage, CASE stage WHEN 'O' THEN 1 WHEN 'P' THEN 2 ELSE 3 END AS stage_seq, CASE WHEN stage <> 'O' THEN day::VARCHAR END AS stage_date
FROM (SELECT o_orderkey, o_orderstatus AS stage, o_orderdate::DATE AS day FROM orders)""")
def stage_log(spark, d):
    o = A.table(spark, d, "orders").select(F.col("o_orderkey").alias("key"), F.col("o_orderstatus").alias("stage"), F.col("o_orderdate").cast("date").alias("day"))
    out = canonical.stage_log(o, "key", "stage", "day", {"O": 1, "P": 2, "F": 3}, undated=("O",))
    return out.select("key", "stage", "stage_seq", F.col("stage_date").cast("string"))


@query("""SELECT l_orderkey, l_linenumber, l_suppkey, l_extendedprice FROM (
SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_shipdate DESC, l_extendedprice DESC, l_suppkey DESC, l_partkey DESC) AS rn FROM lineitem) WHERE rn = 1""")
def latest_wins(spark, d):
    one = canonical.first_of(A.table(spark, d, "lineitem"), ["l_orderkey", "l_linenumber"], F.desc("l_shipdate"), F.desc("l_extendedprice"), F.desc("l_suppkey"), F.desc("l_partkey"))
    return one.select("l_orderkey", "l_linenumber", "l_suppkey", "l_extendedprice")


@query("""SELECT count(*) FILTER (o_custkey IS NOT NULL AND c_custkey IS NOT NULL) AS in_both, count(*) FILTER (c_custkey IS NULL) AS only_left, count(*) FILTER (o_custkey IS NULL) AS only_right
FROM (SELECT DISTINCT o_custkey FROM orders) FULL JOIN customer ON o_custkey = c_custkey""")
def key_overlap(spark, d):
    return canonical.key_sets(A.table(spark, d, "orders").withColumnRenamed("o_custkey", "k"), A.table(spark, d, "customer").withColumnRenamed("c_custkey", "k"), "k")


@query("""SELECT l_orderkey, round(own, 2) AS own, published, abs(own - published) <= 0.001 * abs(published) AS matches
FROM (SELECT l_orderkey, sum(l_extendedprice) AS own FROM lineitem GROUP BY 1) JOIN (SELECT o_orderkey, o_totalprice AS published FROM orders) ON l_orderkey = o_orderkey""")
def totals_reconciled(spark, d):
    published = A.table(spark, d, "orders").withColumnRenamed("o_orderkey", "l_orderkey")
    out = canonical.reconciled(A.table(spark, d, "lineitem"), published, "l_orderkey", "l_extendedprice", "o_totalprice")
    return out.select("l_orderkey", r("own", 2), "published", "matches")


@query("+ x AS (SELECT avg((completion_date IS NOT NULL)::INT) AS a, avg((work_description IS NOT NULL)::INT) AS b, avg((actual_amount IS NOT NULL)::INT) AS c FROM w) SELECT 'completion_date' AS \"column\", round(a, 6) AS filled FROM x UNION ALL SELECT 'work_description', round(b, 6) FROM x UNION ALL SELECT 'actual_amount', round(c, 6) FROM x", WORKS)
def completeness(spark, d):
    return canonical.completeness(A.conformed(spark, d), ["completion_date", "work_description", "actual_amount"]).select("column", r("filled", 6))


@query(" UNION ALL ".join(f"""SELECT '{c}' AS "column", count(*) AS rows, count(*) FILTER ({c} IS NULL) AS nulls, count(DISTINCT {c}) AS "distinct", min({c}::VARCHAR) AS least, max({c}::VARCHAR) AS greatest,
bool_and(try_cast({c}::VARCHAR AS BIGINT) IS NOT NULL AND {c}::VARCHAR NOT LIKE '%.%') AS all_long, bool_and(try_cast({c}::VARCHAR AS DOUBLE) IS NOT NULL) AS all_double FROM events""" for c in ("event_id", "user_id", "event_type")))
def column_profile(spark, d):
    return canonical.profiled(A.table(spark, d, "events"), ["event_id", "user_id", "event_type"])


@query("""SELECT user_id, max_by(event_type, event_id) FILTER (event_type IS NOT NULL) AS event_type, max_by(value, event_id) FILTER (value IS NOT NULL) AS value FROM events GROUP BY 1""")
def stage_merge(spark, d):
    return canonical.merged_stages(A.table(spark, d, "events"), "user_id", "event_id", ["event_type", "value"])


# ------------------------------------------------------------------------------------------------ peers and signals


@query("SELECT work_ref, peer_level, peer_group_size FROM q", PEERS)
def peer_backoff_levels(spark, d):
    return peers.backed_off(A.conformed(spark, d), A.PEER_LEVELS, min_peers=A.MIN_PEERS).select("work_ref", "peer_level", "peer_group_size")


@query("SELECT work_ref, round(amount_pct, 6) AS amount_pct FROM q", PEERS)
def peer_amount_percentile(spark, d):
    w = stored(peers.backed_off(A.conformed(spark, d), A.PEER_LEVELS, min_peers=A.MIN_PEERS))
    return peers.leave_one_out_percentile(w, ["peer_group"], "recommended_amount", "amount_pct").select("work_ref", r("amount_pct", 6))


@query("SELECT work_ref, round(amount_z, 4) AS amount_z FROM q", PEERS)
def peer_robust_z(spark, d):
    w = stored(peers.backed_off(A.conformed(spark, d), A.PEER_LEVELS, min_peers=A.MIN_PEERS))
    return peers.robust_z(w, ["peer_group"], "recommended_amount", "amount_z").select("work_ref", r("amount_z"))


@query("SELECT work_ref, round(open_pct, 6) AS open_pct FROM q", PEERS)
def open_duration_percentile(spark, d):
    return A.scored(spark, d).select("work_ref", r("open_pct", 6))


@query("SELECT state_name, count(*) AS outliers, round(sum(recommended_amount), 2) AS amount, round(max(amount_z), 4) AS largest_z FROM q WHERE amount_pct >= 0.9 GROUP BY 1", PEERS)
def peer_outliers_by_state(spark, d):
    w = stored(peers.backed_off(A.conformed(spark, d), A.PEER_LEVELS, min_peers=A.MIN_PEERS))
    w = peers.robust_z(peers.leave_one_out_percentile(w, ["peer_group"], "recommended_amount", "amount_pct"), ["peer_group"], "recommended_amount", "amount_z")
    out = w.where("amount_pct >= 0.9").groupBy("state_name").agg(F.count("*").alias("outliers"), F.sum("recommended_amount").alias("amount"), F.max("amount_z").alias("largest_z"))
    return out.select("state_name", "outliers", r("amount", 2), r("largest_z"))


@query("SELECT implementing_agency, round(change, 6) AS change, from_year, to_year, round(before) AS before, round(after) AS after FROM cp", WORKS + STEPS)
def agency_change_points(spark, d):
    out = signals.change_points(A.conformed(spark, d), "implementing_agency", F.year("recommendation_date"), "recommended_amount")
    return out.select("implementing_agency", r("change", 6), "from_year", "to_year", r("before", 0), r("after", 0))


@query("SELECT work_ref, round(priority, 6) AS priority, families, band, round(audit_roi, 2) AS audit_roi FROM scored", SCORED)
def fusion_bands(spark, d):
    return A.scored(spark, d).select("work_ref", r("priority", 6), "families", "band", r("audit_roi", 2))


@query("SELECT work_ref, checks_fired, severity FROM scored WHERE checks_fired > 0", SCORED)
def compliance_checks(spark, d):
    return A.scored(spark, d).where("checks_fired > 0").select("work_ref", "checks_fired", "severity")


@query(
    "+ n AS (SELECT count(*) AS n FROM scored) "
    + " UNION ALL ".join(
        f"SELECT '{k}' AS \"check\", count(*) FILTER ({c}) AS fired, round(count(*) FILTER ({c}) / max(n)::DOUBLE, 6) AS share FROM scored, n"
        for k, c in {"orphan": "is_orphan", "backdated": "is_backdated", "future_dated": "is_future_dated", "no_sanction": "completed_without_sanction", "nonpositive": "has_nonpositive_amount",
                     "no_text": "chk_no_text", "stalled": "chk_stalled", "amount": "chk_amount", "any": "checks_fired > 0"}.items()
    ),
    SCORED,
)
def compliance_summary(spark, d):
    return signals.rule_summary(A.scored(spark, d)).select("check", "fired", r("share", 6))


@query("SELECT work_ref, round(stall_ratio, 4) AS stall_ratio, round(warning, 6) AS warning, warning_level FROM scored WHERE is_open = 1", SCORED)
def early_warning_levels(spark, d):
    return A.scored(spark, d).where("is_open = 1").select("work_ref", r("stall_ratio"), r("warning", 6), "warning_level")


@query("""SELECT l.warning_level, count(work_ref) AS works, round(coalesce(sum(exposure), 0), 2) AS exposure FROM (SELECT unnest(['CRITICAL', 'HIGH', 'MEDIUM', 'LOW']) AS warning_level) l
LEFT JOIN (SELECT * FROM scored WHERE is_open = 1) s USING (warning_level) GROUP BY 1""", SCORED)
def early_warning_summary(spark, d):
    levels = spark.createDataFrame([("CRITICAL",), ("HIGH",), ("MEDIUM",), ("LOW",)], "warning_level string")
    counts = A.scored(spark, d).where("is_open = 1").groupBy("warning_level").agg(F.count("*").alias("works"), F.sum("exposure").alias("exposure"))
    return levels.join(counts, "warning_level", "left").select("warning_level", F.coalesce("works", F.lit(0)).alias("works"), r(F.coalesce("exposure", F.lit(0.0)), 2, "exposure"))


@query("""SELECT work_ref, band, round(audit_roi, 2) AS audit_roi FROM scored WHERE band IN ('MEDIUM', 'HIGH') AND state_name <> 'CHINA' ORDER BY scored.audit_roi DESC, work_ref LIMIT 50 OFFSET 10""", SCORED)
def worklist_top(spark, d):
    return signals.worklist(A.scored(spark, d), where=F.col("state_name") != "CHINA", offset=10, limit=50).select("work_ref", "band", r("audit_roi", 2))


@query("""SELECT work_ref, row_number() OVER (ORDER BY audit_roi DESC, work_ref) AS rank, band,
 (sig_amount > 0)::INT + (sig_duration > 0)::INT + (sig_risk > 0)::INT + (sig_conformance > 0)::INT + (sig_change > 0)::INT + (sig_anomaly > 0)::INT AS evidence, checks_fired AS findings,
 CASE WHEN sig_conformance > 0 THEN 'CHECK_DOCUMENTS' WHEN sig_amount > 0 THEN 'CHECK_ESTIMATE' WHEN sig_duration > 0 OR sig_risk > 0 THEN 'VISIT_SITE' ELSE 'NONE' END AS next_step,
 CASE WHEN recommended_amount >= 1e7 THEN printf('%.2f crore', recommended_amount / 1e7) WHEN recommended_amount >= 1e5 THEN printf('%.2f lakh', recommended_amount / 1e5) ELSE printf('%.0f', recommended_amount) END AS amount_text
FROM scored WHERE band IN ('MEDIUM', 'HIGH')""", SCORED)
def case_files(spark, d):
    return signals.case_files(A.scored(spark, d)).select("work_ref", "rank", "band", F.size("evidence").alias("evidence"), F.size("findings").alias("findings"), "next_step", "amount_text")


# ------------------------------------------------------------------------------------------------ reports and series


@query("""SELECT state_name, count(*) AS works, round(sum(recommended_amount), 2) AS amount, round(sum(exposure), 2) AS exposure, count(*) FILTER (band IN ('MEDIUM', 'HIGH')) AS leads,
count(DISTINCT implementing_agency) AS agencies, round(CASE WHEN count(*) >= 500 THEN avg(is_completed) END, 6) AS completion_rate FROM scored GROUP BY 1""", SCORED)
def state_report(spark, d):
    return reports.group_report(A.scored(spark, d), ["state_name"]).select("state_name", "works", r("amount", 2), r("exposure", 2), "leads", "agencies", r("completion_rate", 6))


LOW, HIGH = wilson("hits", "works")


@query(f"""+ o AS (SELECT avg((severity = 'HIGH')::INT) AS overall FROM scored), g AS (SELECT state_name, count(*) AS works, count(*) FILTER (severity = 'HIGH') AS hits FROM scored GROUP BY 1),
i AS (SELECT *, {LOW} AS low, {HIGH} AS high FROM g)
SELECT state_name, works, hits, round(low, 6) AS low, round(high, 6) AS high, CASE WHEN works < 500 THEN 'no_rate' WHEN low > overall THEN 'above' WHEN high < overall THEN 'below' ELSE 'inconclusive' END AS reading FROM i, o""", SCORED)
def state_significance(spark, d):
    return reports.significance(A.scored(spark, d), ["state_name"], F.col("severity") == "HIGH").select("state_name", "works", "hits", r("low", 6), r("high", 6), "reading")


@query("SELECT year(recommendation_date) AS year, state_name, count(*) AS works, round(sum(recommended_amount), 2) AS amount FROM w GROUP BY ROLLUP (1, 2)", WORKS)
def state_year_timeline(spark, d):
    out = series.by_year(A.conformed(spark, d), ["state_name"], "recommendation_date", works=F.count("*"), amount=F.sum("recommended_amount"))
    return out.select("year", "state_name", "works", r("amount", 2))


@query("""SELECT date_trunc('month', recommendation_date)::DATE::VARCHAR AS month, count(*) AS works, round(quantile_cont(recommended_amount, 0.5)) AS median_amount, round(sum(recommended_amount), 2) AS total
FROM w WHERE date_trunc('month', recommendation_date) < (SELECT max(date_trunc('month', recommendation_date)) FROM w) GROUP BY 1""", WORKS)
def monthly_national(spark, d):
    out = series.monthly(A.conformed(spark, d), "recommendation_date", "recommended_amount", drop_last=True)
    return out.select(F.col("month").cast("string"), "works", r("median_amount", 0), r("total", 2))


@query("""+ m AS (SELECT state_name, date_trunc('month', recommendation_date) AS month, count(*)::DOUBLE AS v FROM w GROUP BY 1, 2),
b AS (SELECT *, row_number() OVER (PARTITION BY state_name ORDER BY month DESC) AS k FROM m),
t AS (SELECT state_name, count(*) AS points, max(v) FILTER (k = 1) AS latest, avg(v) FILTER (k > 3) AS baseline, stddev_pop(v) FILTER (k > 3) AS sd, avg(v) FILTER (k <= 3) AS rec, quantile_cont(v, 0.5) AS med FROM b GROUP BY 1),
u AS (SELECT *, CASE WHEN sd > 0 THEN sd ELSE 1e-9 END AS s, (rec - baseline) / (abs(baseline) + 1e-9) AS shift FROM t)
SELECT state_name, points, latest, round(baseline, 4) AS baseline, round(shift, 4) AS shift, CASE WHEN points < 6 THEN 'INSUFFICIENT' WHEN abs(shift) >= 0.35 AND abs(rec - baseline) > s THEN 'PERSISTENT'
WHEN abs((latest - baseline) / s) >= 2.5 THEN 'SUDDEN' WHEN shift > 0.2 AND baseline < med THEN 'EMERGING' ELSE 'NORMAL' END AS trend FROM u""", WORKS)
def entity_trends(spark, d):
    points = series.monthly(A.conformed(spark, d), "recommendation_date", "recommended_amount", ("state_name",))
    return series.trends(points, ["state_name"], "month", "works").select("state_name", "points", "latest", r("baseline"), r("shift"), "trend")


@query("""+ c AS (SELECT max(date_trunc('month', recommendation_date)) - INTERVAL 12 MONTH AS cut FROM w), k AS (SELECT activity_category, count(*) FILTER (date_trunc('month', recommendation_date) > cut) AS r,
count(*) FILTER (date_trunc('month', recommendation_date) <= cut) AS e FROM w, c GROUP BY 1), s AS (SELECT activity_category, r, r / sum(r) OVER () AS rs, e / sum(e) OVER () AS es FROM k)
SELECT activity_category, r AS recent_works, round(rs, 6) AS recent_share, round(es, 6) AS earlier_share, CASE WHEN es < 0.002 AND rs > 0.005 THEN 'EMERGING' WHEN (rs - es) / (es + 1e-6) > 0.5 THEN 'GROWING'
WHEN (rs - es) / (es + 1e-6) < -0.4 THEN 'DECLINING' ELSE 'STABLE' END AS state FROM s""", WORKS)
def category_radar(spark, d):
    return series.radar(A.conformed(spark, d), "activity_category", "recommendation_date").select("activity_category", "recent_works", r("recent_share", 6), r("earlier_share", 6), "state")


@query("""+ n AS (SELECT activity_category, string_agg(state_name, ',' ORDER BY state_name) AS names FROM (SELECT activity_category, state_name, row_number() OVER (PARTITION BY activity_category ORDER BY state_name) AS k
FROM (SELECT DISTINCT activity_category, state_name FROM w)) WHERE k <= 5 GROUP BY 1)
SELECT activity_category, count(*) AS works, round(sum(recommended_amount), 2) AS amount, round(avg(is_completed), 6) AS completion_rate, any_value(names) AS names FROM w JOIN n USING (activity_category) GROUP BY 1""", WORKS)
def entity_profile(spark, d):
    return reports.profile(A.conformed(spark, d), "activity_category", "state_name").select("activity_category", "works", r("amount", 2), r("completion_rate", 6), "names")


@query("""SELECT implementing_agency, works, round(exposure, 2) AS exposure FROM (SELECT implementing_agency, count(*) AS works, sum(exposure) AS exposure FROM scored GROUP BY 1) t ORDER BY t.exposure DESC, implementing_agency LIMIT 50""", SCORED)
def agency_ranking(spark, d):
    g = A.scored(spark, d).groupBy("implementing_agency").agg(F.count("*").alias("works"), F.sum("exposure").alias("exposure"))
    return reports.top(g, 50, F.desc("exposure"), F.asc("implementing_agency")).select("implementing_agency", "works", r("exposure", 2))


@query("""SELECT implementing_agency, work_ref, place FROM (SELECT implementing_agency, work_ref, row_number() OVER (PARTITION BY implementing_agency ORDER BY audit_roi DESC, work_ref) AS place
FROM scored WHERE band IN ('MEDIUM', 'HIGH')) WHERE place <= 8""", SCORED)
def agency_top_leads(spark, d):
    leads = A.scored(spark, d).where(F.col("band").isin("MEDIUM", "HIGH"))
    return reports.top_of_each(leads, ["implementing_agency"], 8, F.desc("audit_roi"), F.asc("work_ref")).select("implementing_agency", "work_ref", "place")


HHI = r"""+ v AS (SELECT authority, vendor, sum(amount) AS paid, count(*) AS n FROM pay WHERE amount > 0 GROUP BY 1, 2),
k AS (SELECT *, row_number() OVER (PARTITION BY authority ORDER BY paid DESC, vendor) AS place FROM v),
h0 AS (SELECT authority, sum(n) AS payments, count(*) AS vendors, sum(paid * paid) / (sum(paid) * sum(paid)) AS x, max(paid) / sum(paid) AS top_share, sum(paid) FILTER (place <= 3) / sum(paid) AS top3_share FROM k GROUP BY 1),
h AS (SELECT *, CASE WHEN payments >= 20 THEN x END AS hhi FROM h0)"""


@query(HHI + """ SELECT authority, payments, vendors, round(hhi, 6) AS hhi, round(top_share, 6) AS top_share, round(top3_share, 6) AS top3_share,
CASE WHEN hhi >= 0.25 THEN 'CONCENTRATED' WHEN hhi >= 0.15 THEN 'MODERATE' WHEN hhi IS NOT NULL THEN 'SPREAD' END AS band,
round(CASE WHEN hhi IS NOT NULL THEN (rank() OVER (PARTITION BY hhi IS NULL ORDER BY hhi) - 1 + count(*) OVER (PARTITION BY hhi) / 2.0) / count(*) OVER (PARTITION BY hhi IS NULL) END, 6) AS percentile FROM h""", PAYMENTS)
def vendor_hhi(spark, d):
    out = reports.concentration(A.payments(spark, d), "authority", "vendor", "amount")
    return out.select("authority", "payments", "vendors", r("hhi", 6), r("top_share", 6), r("top3_share", 6), "band", r("percentile", 6))


@query(HHI + """ SELECT count(hhi) AS scored, round(min(hhi), 6) AS least, round(quantile_cont(hhi, 0.25), 6) AS p25, round(quantile_cont(hhi, 0.5), 6) AS median, round(quantile_cont(hhi, 0.75), 6) AS p75,
round(quantile_cont(hhi, 0.9), 6) AS p90, round(max(hhi), 6) AS greatest FROM h""", PAYMENTS)
def vendor_hhi_distribution(spark, d):
    out = reports.distribution(reports.concentration(A.payments(spark, d), "authority", "vendor", "amount"), "hhi")
    return out.select("scored", *[r(c, 6) for c in out.columns[1:]])


@query("SELECT serial, sum(amount::DECIMAL(18, 4))::DOUBLE AS total, count(*) AS payments, min(paid_on)::VARCHAR AS first_paid, max(paid_on)::VARCHAR AS last_paid FROM pay GROUP BY 1", PAYMENTS)
def payments_per_work(spark, d):
    g = A.payments(spark, d).groupBy("serial").agg(F.sum(F.col("amount").cast("decimal(18,4)")).cast("double").alias("total"), F.count("*").alias("payments"), F.min("paid_on").cast("string").alias("first_paid"), F.max("paid_on").cast("string").alias("last_paid"))
    return g


CLOW, CHIGH = wilson("confirmed", "visits")


@query(f"""WITH v AS (SELECT l.doc_id, quality, CASE WHEN n_chars >= 3000 THEN 'HIGH' WHEN n_chars >= 1000 THEN 'MEDIUM' ELSE 'NOT SURFACED' END AS band FROM labels l LEFT JOIN documents d ON d.doc_id = l.doc_id),
g AS (SELECT band, count(*) AS visits, count(*) FILTER (quality <> 1) AS confirmed FROM v GROUP BY 1)
SELECT band, visits, confirmed, round(CASE WHEN visits >= 10 THEN confirmed / visits::DOUBLE END, 6) AS rate, round({CLOW}, 3) AS low, round({CHIGH}, 3) AS high FROM g""")
def calibration_bands(spark, d):
    visits, bands = A.verifications(spark, d)
    return reports.calibration(visits, bands, "work", ["NOT_STARTED", "NOT_FOUND", "RECORD_MISMATCH"]).select("band", "visits", "confirmed", r("rate", 6), "low", "high")


@query("""SELECT activity_category AS tier, CASE WHEN late <= 30 THEN '1-30' WHEN late <= 90 THEN '31-90' ELSE 'over 90' END AS bucket, count(*) AS cases, max(late) AS oldest
FROM (SELECT activity_category, date_diff('day', recommendation_date, DATE '2001-06-01') AS late FROM w WHERE is_open = 1) WHERE late > 0 GROUP BY 1, 2""", WORKS)
def case_ageing(spark, d):
    open_ = A.conformed(spark, d).where("is_open = 1").withColumnRenamed("activity_category", "tier")
    return reports.ageing(open_, "recommendation_date", F.lit("2001-06-01").cast("date"), "tier")


NEAR = """WITH e AS (SELECT vec_id, label, embedding::DOUBLE[] AS v FROM embeddings), p AS (SELECT a.vec_id AS a, b.vec_id AS b, list_cosine_similarity(a.v, b.v) AS s FROM e a JOIN e b ON a.label = b.label AND a.vec_id <> b.vec_id),
n AS (SELECT *, row_number() OVER (PARTITION BY a ORDER BY round(s, 12) DESC, b) AS k FROM p WHERE s >= 0.3), m AS (SELECT least(a, b) AS a, greatest(a, b) AS b, max(s) AS s FROM n WHERE k <= 5 GROUP BY 1, 2),
pairs AS (SELECT a, b, round(s, 4) AS similarity FROM m)"""


@query("""+ a AS (SELECT avg(is_completed) AS c, avg((checks_fired = 0)::INT) AS f, avg((band NOT IN ('MEDIUM', 'HIGH'))::INT) AS s, avg((work_description IS NOT NULL)::INT) AS t, count(*) AS n FROM scored),
b AS (SELECT 'completion' AS part, 0.30 AS weight, round(c, 3) AS value FROM a UNION ALL SELECT 'no_flag', 0.25, round(f, 3) FROM a UNION ALL SELECT 'not_surfaced', 0.20, round(s, 3) FROM a
UNION ALL SELECT 'unique', 0.15, round(1 - least(1.0, (""" + NEAR + """ SELECT count(*) FROM pairs)::DOUBLE / n), 3) FROM a UNION ALL SELECT 'described', 0.10, round(t, 3) FROM a)
SELECT part, weight::DOUBLE AS weight, value::DOUBLE AS value, round(weight * value, 6)::DOUBLE AS contribution FROM b""", SCORED)
def health_index(spark, d):
    pairs = duplicates.block_pairs(A.table(spark, d, "embeddings"), "vec_id", ["label"], "embedding", least=0.30).count()
    return reports.health_index(A.scored(spark, d), F.lit(pairs))


@query("SELECT doc_id FROM documents WHERE contains(lower(concat_ws(' ', text, source)), 'idiot') AND contains(lower(concat_ws(' ', text, source)), 'src1')")
def text_search(spark, d):
    return reports.text_search(A.table(spark, d, "documents"), ["text", "source"], ["Idiot", "the", "src1"]).select("doc_id")


@query("+ x AS (SELECT DISTINCT state_name FROM w) SELECT state_name FROM x ORDER BY 1 LIMIT 600", WORKS)
def distinct_values(spark, d):
    return A.conformed(spark, d).select("state_name").distinct().orderBy("state_name").limit(600)


# ------------------------------------------------------------------------------------------------ duplicates


@query(NEAR + " SELECT a, b, similarity FROM pairs")
def near_duplicate_pairs(spark, d):
    return duplicates.block_pairs(A.table(spark, d, "embeddings"), "vec_id", ["label"], "embedding", least=0.30).select("a", "b", "similarity")


@query(NEAR + """, b AS (SELECT a AS key, b AS partner, similarity FROM pairs UNION ALL SELECT b, a, similarity FROM pairs)
SELECT key, partner, similarity FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY similarity DESC, partner) AS k FROM b) WHERE k = 1""")
def best_partners(spark, d):
    return duplicates.best_partner(duplicates.block_pairs(A.table(spark, d, "embeddings"), "vec_id", ["label"], "embedding", least=0.30))


@query(NEAR + """, f AS (SELECT vec_id, vec_id % 3 AS agency, (vec_id % 7 + 100)::DOUBLE AS amount FROM embeddings)
SELECT a, b FROM pairs JOIN f x ON x.vec_id = a JOIN f y ON y.vec_id = b WHERE similarity >= 0.35 AND x.agency = y.agency AND abs(x.amount - y.amount) / greatest(x.amount, y.amount, 1) <= 0.02""")
def concerning_pairs(spark, d):
    e = A.table(spark, d, "embeddings")
    pairs = duplicates.block_pairs(e, "vec_id", ["label"], "embedding", least=0.30)
    facts = e.select("vec_id", (F.col("vec_id") % 3).alias("agency"), (F.col("vec_id") % 7 + 100).cast("double").alias("amount"))
    return duplicates.concerning(pairs, facts, "vec_id", "agency", "amount", least=0.35).select("a", "b")


@query("""WITH h AS (SELECT vec_id, label, list_sum([CASE WHEN embedding[i] > 0 THEN (1::HUGEINT << (i - 1)) ELSE 0 END for i in range(1, 65)])::HUGEINT AS u FROM embeddings)
SELECT a.vec_id AS a, b.vec_id AS b, bit_count(xor(a.u, b.u))::INT AS distance FROM h a JOIN h b ON a.vec_id < b.vec_id AND a.label <> b.label WHERE bit_count(xor(a.u, b.u)) <= 14""")
def near_image_pairs(spark, d):
    e = A.table(spark, d, "embeddings")
    bits = F.aggregate(F.zip_with("embedding", F.sequence(F.lit(0), F.lit(63)), lambda x, i: F.when(x > 0, F.expr("1L")).otherwise(0).cast("long") * 0 + F.when(x > 0, i).otherwise(-1)), F.lit(0).cast("long"),
                       lambda s, i: F.when(i >= 0, s.bitwiseOR(F.call_function("shiftleft", F.lit(1).cast("long"), i.cast("int")))).otherwise(s))
    return duplicates.image_pairs(e.select("vec_id", "label", bits.alias("h")), "vec_id", "label", "h", "h").select("a", "b", "distance")


# ------------------------------------------------------------------------------------------------ change feed


FEED = """WITH v AS (SELECT user_id, ts, event_id, event_type, regexp_replace(value::VARCHAR, '^(-?\\d+)\\.0+$', '\\1') AS value, json_extract_string(props, '$.k') AS k FROM events),
o AS (SELECT *, row_number() OVER w AS n, lag(event_type) OVER w AS pt, lag(value) OVER w AS pv, lag(k) OVER w AS pk FROM v WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
feed AS (SELECT user_id, ts, event_id, 'appeared' AS change_type, NULL AS field FROM o WHERE n = 1
UNION ALL SELECT user_id, ts, event_id, 'changed', 'event_type' FROM o WHERE n > 1 AND pt IS DISTINCT FROM event_type
UNION ALL SELECT user_id, ts, event_id, 'changed', 'k' FROM o WHERE n > 1 AND pk IS DISTINCT FROM k)"""


@query(FEED + " SELECT user_id, event_id, change_type, field FROM feed")
def change_feed(spark, d):
    return changes.feed_of(A.versions(spark, d), "user_id", ["ts", "event_id"], ["event_type", "k"]).select("user_id", "event_id", "change_type", "field")


@query(FEED + " SELECT date_trunc('hour', ts)::VARCHAR AS start, field, count(*) AS changes FROM feed WHERE change_type = 'changed' GROUP BY 1, 2")
def changes_per_hour(spark, d):
    f = changes.feed_of(A.versions(spark, d), "user_id", ["ts", "event_id"], ["event_type", "k"]).where("change_type = 'changed'")
    return streaming.per_window(f.withColumn("ts", F.col("ts").cast("timestamp_ntz")), "ts", "field").select(F.date_format("start", "yyyy-MM-dd HH:mm:ss").alias("start"), "field", "changes")


@query("""WITH c AS (SELECT min(ts) + (max(ts) - min(ts)) / 2 AS cut FROM events), v AS (SELECT user_id, event_type, ts, event_id, json_extract_string(props, '$.k') AS k FROM events),
o AS (SELECT user_id, max_by(event_type, (ts, event_id)) AS event_type, max_by(k, (ts, event_id)) AS k FROM v, c WHERE ts <= cut GROUP BY 1), n AS (SELECT user_id, max_by(event_type, (ts, event_id)) AS event_type, max_by(k, (ts, event_id)) AS k FROM v GROUP BY 1)
SELECT user_id, 'changed' AS change_type, 'event_type' AS field, o.event_type AS old_value, n.event_type AS new_value FROM o JOIN n USING (user_id) WHERE o.event_type IS DISTINCT FROM n.event_type
UNION ALL SELECT user_id, 'changed', 'k', o.k, n.k FROM o JOIN n USING (user_id) WHERE o.k IS DISTINCT FROM n.k
UNION ALL SELECT user_id, 'appeared', NULL, NULL, NULL FROM n WHERE user_id NOT IN (SELECT user_id FROM o)""")
def snapshot_diff(spark, d):
    v = A.versions(spark, d)
    ends = v.select(F.min("ts").alias("a"), F.max("ts").alias("b"))
    cut = ends.select(F.col("a") + (F.col("b") - F.col("a")) / 2).scalar()
    newest = lambda x: changes.latest(x, "user_id", ["ts", "event_id"])
    return changes.diffed(newest(v.where(F.col("ts") <= cut)), newest(v), "user_id", ["event_type", "k"])


@query("""WITH f AS (SELECT user_id AS scope, event_id AS t, event_type AS p, lag(event_type) OVER w AS q, row_number() OVER w AS n FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id)),
m AS (SELECT *, sum((n = 1 OR p IS DISTINCT FROM q)::INT) OVER (PARTITION BY scope ORDER BY t) AS run FROM f), g AS (SELECT scope, run, count(*) AS n, min(t) AS a, max(t) AS b FROM m GROUP BY 1, 2)
SELECT scope, sum(n) AS checks, max(run) - 1 AS changes, max(b) AS last_checked, max_by(a, run) AS last_changed, max_by(n, run) - 1 AS unchanged FROM g GROUP BY 1""")
def scope_watermarks(spark, d):
    e = A.table(spark, d, "events").select(F.col("user_id").alias("scope"), F.col("event_id").alias("at"), F.col("event_type").alias("p"))
    return changes.watermarks(e, "scope", "at", "p").drop("is_due")


# ------------------------------------------------------------------------------------------------ planning


@query("""+ a AS (SELECT implementing_agency, exposure, row_number() OVER (PARTITION BY implementing_agency ORDER BY exposure DESC, work_ref) AS place FROM scored),
b AS (SELECT implementing_agency, place, sum(exposure) OVER (PARTITION BY implementing_agency ORDER BY place) / (1 + (place - 1) * 0.35) AS ratio, 1 + (place - 1) * 0.35 AS cost FROM a WHERE place <= 40)
SELECT implementing_agency, round(max(ratio), 2) AS ratio FROM b WHERE cost <= 10 GROUP BY 1""", SCORED)
def bundle_ratio(spark, d):
    return planning.bundle_ratios(A.scored(spark, d), "implementing_agency", "exposure", "work_ref", 10.0).select("implementing_agency", r("ratio", 2))


@query()
def greedy_plan(spark, d):
    leads = A.scored(spark, d).where(F.col("band").isin("MEDIUM", "HIGH"))
    return planning.plans(leads, "state_name", [3.0, 5.0, 10.0], "implementing_agency", "exposure", "work_ref")


@query()
def strategy_compare(spark, d):
    s = A.scored(spark, d).withColumn("chance", F.xxhash64("work_ref").cast("double"))
    return planning.walked(s, "state_name", {"amount": "recommended_amount", "priority": "priority", "roi": "audit_roi", "random": "chance"}, 10.0, "implementing_agency", "exposure", "work_ref")


@query()
def rota(spark, d):
    return planning.rota(planning.trips(greedy_plan(spark, d), ["state_name", "budget"]), ["state_name", "budget"], 4)


@query("""+ t AS (SELECT implementing_agency AS agency, state_name, count(*) * 0.35 + 0.65 AS cost FROM w GROUP BY 1, 2), s AS (SELECT *, ceil(cost - 1e-9) AS span FROM t)
SELECT state_name, agency, span::BIGINT AS span, (sum(span) OVER o - span + 1)::BIGINT AS day_from, (sum(span) OVER o)::BIGINT AS day_to FROM s WINDOW o AS (PARTITION BY state_name ORDER BY agency)""", WORKS)
def trip_calendar(spark, d):
    t = A.conformed(spark, d).groupBy(F.col("implementing_agency").alias("agency"), "state_name").agg((F.count("*") * 0.35 + 0.65).alias("cost"))
    return planning.calendar(t, ["state_name"], "agency").select("state_name", "agency", "span", "day_from", "day_to")


# ------------------------------------------------------------------------------------------------ models


@query("""+ d AS (SELECT activity_category, duration_days AS day, count(*) AS n, sum(is_event) AS events FROM w WHERE duration_days >= 1 GROUP BY 1, 2),
a AS (SELECT *, sum(n) OVER (PARTITION BY activity_category ORDER BY day ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS at_risk FROM d)
SELECT activity_category, day, at_risk, events, round(exp(sum(CASE WHEN events < at_risk THEN ln(1 - events / at_risk::DOUBLE) ELSE -745.0 END) OVER (PARTITION BY activity_category ORDER BY day)), 6) AS survival FROM a""", WORKS)
def km_survival(spark, d):
    return models.kaplan_meier(A.conformed(spark, d), ["activity_category"], "duration_days", "is_event").select("activity_category", "day", "at_risk", "events", r("survival", 6))


@query()
def cox_fit(spark, d):
    names = ["log_amount", "is_sanctioned"]
    w = models.cox(A.conformed(spark, d).withColumn("is_sanctioned", F.col("is_sanctioned").cast("int")), names, "duration_days", "is_event")
    return A.conformed(spark, d).select("work_ref", (F.col("log_amount") * float(w[0]) + F.col("is_sanctioned").cast("int") * float(w[1])).alias("log_hazard"))


@query()
def cox_concordance(spark, d):
    w = A.conformed(spark, d).select("work_ref", "duration_days", "is_event")
    return models.concordance(w.join(cox_fit(spark, d), "work_ref"), "duration_days", "is_event", "log_hazard")


@query()
def iforest_flags(spark, d):
    return models.isolation(A.conformed(spark, d), ["log_amount", "age_days"], "work_ref").select("work_ref", "score", "outlier")


@query()
def kmeans_sizes(spark, d):
    found, _, _ = models.clustered(A.table(spark, d, "embeddings"), "embedding", [5, 10])
    return found.groupBy("cluster").agg(F.count("*").alias("n"))


@query("""WITH t AS (SELECT lang, unnest(regexp_split_to_array(lower(text), '[^\\p{L}\\p{N}]+')) AS term FROM documents), c AS (SELECT lang, term, count(*) AS n FROM t WHERE length(term) >= 2 GROUP BY 1, 2),
f AS (SELECT term, count(*) AS df FROM c GROUP BY 1), w AS (SELECT lang, term, n * (ln((1 + (SELECT count(DISTINCT lang) FROM documents)) / (1.0 + df)) + 1) AS weight FROM c JOIN f USING (term))
SELECT lang, place, term, round(weight, 4) AS weight FROM (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY round(weight, 9) DESC, term) AS place FROM w) WHERE place <= 8""")
def cluster_terms(spark, d):
    return models.class_terms(A.table(spark, d, "documents"), "lang", "text").select("lang", "place", "term", r("weight"))


@query("SELECT band, n, round(predicted, 6) AS predicted, round(actual, 6) AS actual FROM (SELECT (risk >= 0.2)::INT + (risk >= 0.4)::INT + (risk >= 0.6)::INT + (risk >= 0.8)::INT AS band, count(*) AS n, avg(risk) AS predicted, avg(is_event) AS actual FROM scored GROUP BY 1)", SCORED)
def risk_calibration(spark, d):
    return models.risk_bands(A.scored(spark, d), "risk", "is_event").select("band", "n", r("predicted", 6), r("actual", 6))


@query()
def planted_recall(spark, d):
    w = A.conformed(spark, d)
    kinds = {"inflated": {"recommended_amount": F.col("recommended_amount") * 8}, "stalled": {"duration_days": F.lit(4000), "is_open": F.lit(1)}, "broken": {"is_orphan": F.lit(True)}}
    p = models.planted(w, "work_ref", kinds, 100)
    p = stored(peers.backed_off(p, A.PEER_LEVELS, min_peers=A.MIN_PEERS))
    p = stored(peers.robust_z(peers.leave_one_out_percentile(p, ["peer_group"], "recommended_amount", "amount_pct"), ["peer_group"], "recommended_amount", "amount_z"))
    p = peers.leave_one_out_percentile(p, ["peer_group", "is_open"], "duration_days", "open_pct")
    age = F.least(F.lit(1.0), F.coalesce(F.col("duration_days"), F.lit(0)) / 4000)
    p = p.withColumns({"risk": F.when(F.col("is_open") == 1, age).otherwise(0.0), "outlier": F.abs("amount_z") > 3, "similarity": F.lit(None).cast("double"), "change": F.lit(0.0)})
    return models.recall_at(signals.fused(p), "work_ref", "priority", 1000)


# ------------------------------------------------------------------------------------------------ text


@query("""WITH k AS (SELECT DISTINCT o_orderkey::VARCHAR AS k FROM orders),
v AS (SELECT k, substr(k, 1, i - 1) || d || substr(k, i + 1) AS m FROM (SELECT k, unnest(range(1, length(k) + 1)) AS i FROM k), (SELECT unnest(range(10)) AS d))
SELECT DISTINCT v.k AS key, v.m AS match FROM v JOIN k ON k.k = v.m WHERE v.k <> v.m""")
def key_near_misses(spark, d):
    k = A.table(spark, d, "orders").select(F.col("o_orderkey").cast("string").alias("k"))
    return extract.near_misses(k, "k", k, "k")


@query("""SELECT l_orderkey, l_linenumber, concat('MP', l_suppkey, '-W', l_partkey) AS reference, round(CASE l_linenumber % 3 WHEN 0 THEN l_extendedprice WHEN 1 THEN round(l_extendedprice, 2) * 100000 ELSE round(l_extendedprice, 2) * 10000000 END, 2) AS amount,
CASE WHEN second = concat('MP', l_suppkey, '-W', l_partkey) THEN 1 ELSE 2 END::INT AS found, nullif(second, concat('MP', l_suppkey, '-W', l_partkey)) AS second
FROM (SELECT *, CASE WHEN l_linenumber % 2 = 0 THEN concat('MP', l_partkey, '-W', l_orderkey) ELSE concat('MP', l_orderkey, '-W', l_suppkey) END AS second FROM lineitem)""")
def field_extraction(spark, d):
    """References and amounts out of texts as readers misread them: letters for digits, several dashes, units, a reference said twice."""
    line = A.table(spark, d, "lineitem")
    odd, unit = F.col("l_linenumber") % 2 == 1, F.col("l_linenumber") % 3
    misread = lambda c: F.when(odd, F.translate(F.col(c).cast("string"), "01258", "OlZSB")).otherwise(F.col(c).cast("string"))
    dash = F.when(odd, "\u2013").when(unit == 0, "-").otherwise("\u2014")
    price = F.when(unit == 0, F.format_number("l_extendedprice", 2)).otherwise(F.concat(F.format_number("l_extendedprice", 2), F.when(unit == 1, " Lakh").otherwise(" crore")))
    first = F.concat(F.lit("mp "), misread("l_suppkey"), F.lit(" "), dash, F.lit(" w"), misread("l_partkey"))
    other = F.when(odd, F.concat(F.lit("MP"), "l_orderkey", F.lit("-W"), "l_suppkey")).otherwise(F.concat(F.lit("MP"), "l_partkey", F.lit("-W"), "l_orderkey"))
    text = F.concat(F.lit("seen at 12 places, ref "), first, F.lit(", paid Rs. "), price, F.lit(" of INR 7; also "), other, F.lit(" and again "), first)
    read = line.select("l_orderkey", "l_linenumber", extract.references(text).alias("found"), extract.amounts(text).alias("paid"))
    return read.select("l_orderkey", "l_linenumber", F.col("found")[0].alias("reference"), r(F.col("paid")[0], 2, "amount"), F.size("found").alias("found"), F.get("found", F.lit(1)).alias("second"))


@query("""+ s AS (SELECT l_orderkey AS serial, l_partkey AS part, l_extendedprice * 4 AS claimed FROM lineitem
UNION ALL SELECT o_orderkey, 0, o_totalprice FROM orders UNION ALL SELECT -o_orderkey, 0, o_totalprice FROM orders),
j AS (SELECT s.*, recommended_amount AS k, amount_pct, checks_fired, risk FROM s LEFT JOIN scored w USING (serial))
SELECT serial, part, CASE WHEN k IS NULL THEN 'REJECT' WHEN abs(claimed - k) > greatest(k * 0.01, 1) OR amount_pct >= 0.9 OR checks_fired > 0 OR risk >= 0.6 THEN 'CHECK'
WHEN amount_pct IS NULL THEN 'UNKNOWN' ELSE 'OK' END AS status FROM j""", SCORED)
def submission_assessment(spark, d):
    lines, orders = A.table(spark, d, "lineitem"), A.table(spark, d, "orders")
    claims = lines.select(F.col("l_orderkey").alias("serial"), F.col("l_partkey").alias("part"), (F.col("l_extendedprice") * 4).alias("claimed"))
    whole = orders.selectExpr("o_orderkey AS serial", "0L AS part", "o_totalprice AS claimed")
    lost = orders.selectExpr("-o_orderkey AS serial", "0L AS part", "o_totalprice AS claimed")
    return assess.assessed(claims.unionByName(whole).unionByName(lost), A.scored(spark, d), "serial", "claimed").select("serial", "part", "status")
