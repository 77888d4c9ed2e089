"""Queries of the summaries, registered beside the others, with the SQL that must give the same rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import adapters as A
from ..operators import duplicates, portfolio, reports, summaries
from .base_sql import PAYMENTS, SCORED, WORKS, wilson
from .registry import NEAR, query, r

LEADS = "count(*) FILTER (band IN ('MEDIUM', 'HIGH'))"


@query(f"""SELECT count(*) AS works, sum(is_completed) AS completed, sum(is_open) AS open, count(DISTINCT state_name) AS states, count(DISTINCT mp_id) AS constituencies, count(DISTINCT implementing_agency) AS agencies,
round(sum(recommended_amount), 2) AS amount, round(sum(exposure), 2) AS exposure, {LEADS} AS leads, count(*) FILTER (band = 'HIGH') AS band_high, count(*) FILTER (band = 'MEDIUM') AS band_medium,
count(*) FILTER (band = 'LOW') AS band_low, count(*) FILTER (band = 'NONE') AS band_none FROM scored""", SCORED)
def national_stats(spark, d):
    return summaries.national(A.scored(spark, d)).withColumns({"amount": F.round("amount", 2), "exposure": F.round("exposure", 2)})


@query(f"""+ m AS (SELECT activity_category, state_name AS top_state FROM (SELECT activity_category, state_name, row_number() OVER (PARTITION BY activity_category ORDER BY count(*) DESC, state_name) AS k FROM scored GROUP BY 1, 2) WHERE k = 1)
SELECT activity_category, count(*) AS works, count(DISTINCT state_name) AS states, count(DISTINCT implementing_agency) AS agencies, round(quantile_cont(recommended_amount, 0.5), 2) AS median_amount,
round(avg(is_completed), 6) AS completion_rate, quantile_cont(duration_days, 0.5) FILTER (is_completed = 1) AS median_days, round({LEADS} / count(*)::DOUBLE, 6) AS lead_rate, round(sum(exposure), 2) AS exposure,
any_value(top_state) AS top_state FROM scored JOIN m USING (activity_category) GROUP BY 1""", SCORED)
def archetype_profile(spark, d):
    out = summaries.archetypes(A.scored(spark, d), "activity_category")
    return out.withColumns({"median_amount": F.round("median_amount", 2), "completion_rate": F.round("completion_rate", 6), "lead_rate": F.round("lead_rate", 6), "exposure": F.round("exposure", 2)})


@query(NEAR + """, f AS (SELECT vec_id, vec_id % 10 AS owner, label, 100.0 + vec_id % 50 AS amount FROM embeddings), j AS (SELECT m.s, x.owner = y.owner AS same_owner, x.label = y.label AS same_text,
x.owner = y.owner AND round(s, 4) >= 0.35 AND abs(x.amount - y.amount) / greatest(x.amount, y.amount, 1.0) <= 0.02 AS concern FROM m JOIN f x ON x.vec_id = a JOIN f y ON y.vec_id = b)
SELECT 'total' AS part, 'all' AS name, count(*) AS pairs FROM j UNION ALL SELECT 'total', 'same_owner', count(*) FILTER (same_owner) FROM j UNION ALL SELECT 'total', 'same_text', count(*) FILTER (same_text) FROM j
UNION ALL SELECT 'total', 'concerning', count(*) FILTER (concern) FROM j
UNION ALL SELECT 'class', CASE WHEN s >= 0.995 THEN 'EXACT' WHEN s >= 0.97 THEN 'NEAR_EXACT' WHEN s >= 0.92 THEN 'HIGH_SIMILARITY' WHEN s >= 0.86 THEN 'POSSIBLE_REPEAT' ELSE 'NORMAL' END, count(*) FROM j GROUP BY 2""")
def duplicate_summary(spark, d):
    vectors = A.table(spark, d, "embeddings")
    facts = vectors.select("vec_id", (F.col("vec_id") % 10).alias("owner"), "label", (F.col("vec_id") % 50 + 100.0).alias("amount"))
    pairs = A.stored(duplicates.block_pairs(vectors, "vec_id", ["label"], "embedding", least=0.30))
    return summaries.pair_summary(pairs, duplicates.concerning(pairs, facts, "vec_id", "owner", "amount", least=0.35), facts, "vec_id", "owner", "label")


RATES = """round(CASE WHEN {0} THEN count(*) FILTER (band = 'HIGH') / count(*)::DOUBLE END, 6) AS high_rate, round(CASE WHEN {0} THEN count(*) FILTER (band IN ('MEDIUM', 'HIGH')) / count(*)::DOUBLE END, 6) AS lead_rate"""
COUNTS = f"count(*) AS works, count(*) FILTER (band = 'HIGH') AS high, {LEADS} AS leads, round(sum(exposure), 2) AS exposure, count(DISTINCT implementing_agency) AS agencies"


@query(f"""SELECT state_name, {COUNTS}, {RATES.format('count(*) >= 500')}, round(CASE WHEN count(*) >= 500 THEN sum(exposure) / count(*) END, 4) AS exposure_a_work FROM scored GROUP BY 1
UNION ALL SELECT 'ALL', {COUNTS}, {RATES.format('true')}, round(sum(exposure) / count(*), 4) FROM scored""", SCORED)
def map_states(spark, d):
    out = summaries.with_total(A.scored(spark, d), "state_name", "ALL", 500)
    return out.withColumns({"exposure": F.round("exposure", 2), "high_rate": F.round("high_rate", 6), "lead_rate": F.round("lead_rate", 6), "exposure_a_work": F.round("exposure_a_work", 4)})


@query(f"""+ g AS (SELECT state_name, mp_id % 12 AS seat, {COUNTS}, min_by(mp_id, work_ref) AS first_name, {RATES.format('count(*) >= 50')}, count(*) < 50 AS rate_withheld FROM scored GROUP BY 1, 2)
SELECT *, row_number() OVER (ORDER BY lead_rate DESC NULLS LAST, exposure DESC, state_name, seat) AS place FROM g""", SCORED)
def map_seats(spark, d):
    """The twelve seats of each state, by lead rate; those of too few works for a rate come last."""
    works = A.scored(spark, d).withColumn("seat", F.col("mp_id") % 12)
    out = summaries.drill_down(works, ["state_name", "seat"], "mp_id").withColumns({"exposure": F.round("exposure", 2), "high_rate": F.round("high_rate", 6), "lead_rate": F.round("lead_rate", 6)})
    return portfolio.placed(out, "state_name", "seat")


@query("SELECT state_name, mp_id, count(*) AS works, sum(is_completed) AS completed, count(DISTINCT implementing_agency) AS agencies FROM w GROUP BY 1, 2", WORKS)
def public_index(spark, d):
    return A.conformed(spark, d).groupBy("state_name", "mp_id").agg(F.count("*").alias("works"), F.sum("is_completed").alias("completed"), F.countDistinct("implementing_agency").alias("agencies"))


def reading(hits: str, overall: str) -> str:
    low, high = wilson(hits, "works")
    return f"CASE WHEN works < 30 THEN 'no_rate' WHEN {low} > {overall} THEN 'above' WHEN {high} < {overall} THEN 'below' ELSE 'inconclusive' END"


@query(f"""+ g AS (SELECT implementing_agency, count(*) AS works, sum(recommended_amount) AS amount, sum(exposure) AS exposure, sum(is_open) AS open, sum(is_completed) AS done, {LEADS} AS leads FROM scored GROUP BY 1),
o AS (SELECT avg(is_completed) AS c, avg((band IN ('MEDIUM', 'HIGH'))::INT) AS l FROM scored),
t AS (SELECT implementing_agency, string_agg(work_ref, ',' ORDER BY k) AS first_leads FROM (SELECT implementing_agency, work_ref, row_number() OVER (PARTITION BY implementing_agency ORDER BY audit_roi DESC, work_ref) AS k
FROM scored WHERE band IN ('MEDIUM', 'HIGH')) WHERE k <= 8 GROUP BY 1),
n AS (SELECT implementing_agency, string_agg(concat(activity_category, ':', n), ',' ORDER BY k) AS categories FROM (SELECT *, row_number() OVER (PARTITION BY implementing_agency ORDER BY n DESC, activity_category) AS k
FROM (SELECT implementing_agency, activity_category, count(*) AS n FROM scored GROUP BY 1, 2)) WHERE k <= 5 GROUP BY 1)
SELECT implementing_agency, works, round(amount, 2) AS amount, round(exposure, 2) AS exposure, open, round(done / works::DOUBLE, 6) AS completion_rate, {reading('done', 'c')} AS completion_reading, leads,
round(leads / works::DOUBLE, 6) AS lead_rate, {reading('leads', 'l')} AS lead_reading, first_leads, categories FROM g JOIN n USING (implementing_agency) LEFT JOIN t USING (implementing_agency), o""", SCORED)
def agency_dossiers(spark, d):
    out = summaries.dossiers(A.scored(spark, d))
    kinds = F.array_join(F.transform("categories", lambda x: F.concat_ws(":", x.category, x.works)), ",")
    return out.withColumns({"amount": F.round("amount", 2), "exposure": F.round("exposure", 2), "completion_rate": F.round("completion_rate", 6), "lead_rate": F.round("lead_rate", 6), "first_leads": F.array_join("first_leads", ","), "categories": kinds})


@query("""+ n AS (SELECT implementing_agency, string_agg(activity_category, ',' ORDER BY activity_category) AS names FROM (SELECT implementing_agency, activity_category, row_number() OVER (PARTITION BY implementing_agency ORDER BY activity_category) AS k
FROM (SELECT DISTINCT implementing_agency, activity_category FROM w)) WHERE k <= 5 GROUP BY 1)
SELECT implementing_agency, count(*) AS works, round(sum(recommended_amount), 2) AS amount, round(avg(is_completed), 6) AS completion_rate, any_value(names) AS names FROM w JOIN n USING (implementing_agency) GROUP BY 1""", WORKS)
def agency_profile(spark, d):
    return reports.profile(A.conformed(spark, d), "implementing_agency", "activity_category").select("implementing_agency", "works", r("amount", 2), r("completion_rate", 6), "names")


@query("""SELECT activity_category, works, round(rupees, 2) AS rupees, round(rate, 6) AS completion_rate, leads FROM (SELECT activity_category, count(*) AS works, sum(recommended_amount) AS rupees, avg(is_completed) AS rate,
count(*) FILTER (band <> 'NONE') AS leads FROM scored GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 12)""", SCORED)
def category_breakdown(spark, d):
    g = A.scored(spark, d).groupBy("activity_category").agg(F.count("*").alias("works"), F.sum("recommended_amount").alias("rupees"), F.avg("is_completed").alias("rate"), F.count_if(F.col("band") != "NONE").alias("leads"))
    return reports.top(g, 12, F.desc("works"), F.asc("activity_category")).select("activity_category", "works", r("rupees", 2), r("rate", 6, "completion_rate"), "leads")


@query("""SELECT count(*) FILTER (NOT demo) AS visits, count(DISTINCT doc_id) FILTER (NOT demo) AS works, count(*) FILTER (demo) AS demo_excluded, count(*) FILTER (NOT demo AND quality <> 1) AS confirmed,
greatest(0, 500 - count(*) FILTER (NOT demo)) AS labels_needed, count(*) FILTER (NOT demo) >= 500 AS ready FROM (SELECT *, doc_id % 10 = 0 AS demo FROM labels)""")
def label_readiness(spark, d):
    visits, _ = A.verifications(spark, d)
    return summaries.label_readiness(visits.withColumn("demo", F.col("work") % 10 == 0), ["NOT_STARTED", "NOT_FOUND", "RECORD_MISMATCH"])


TIERED = """+ e AS (SELECT *, CASE WHEN x >= 50000000 THEN 'Ministry Review' WHEN x >= 5000000 THEN 'State Nodal' ELSE 'District Monitoring' END AS tier,
CASE WHEN x >= 50000000 THEN 7 WHEN x >= 5000000 THEN 14 ELSE 30 END * CASE band WHEN 'HIGH' THEN 1 WHEN 'LOW' THEN 3 ELSE 2 END AS wait
FROM (SELECT *, exposure * 100 AS x FROM scored WHERE band IN ('MEDIUM', 'HIGH')))"""


def leads(spark, d):
    """Leads with ``x``, their exposure in hundreds: amounts here are of another size than rupees."""
    return A.scored(spark, d).where(summaries.is_lead()).withColumn("x", F.col("exposure") * 100)


@query(TIERED + " SELECT work_ref, tier, (snapshot + wait::INT)::VARCHAR AS review_due FROM e", SCORED)
def escalations(spark, d):
    last = A.table(spark, d, "orders").select(F.max("o_orderdate").cast("date")).scalar()
    return summaries.escalated(leads(spark, d), last, "x").select("work_ref", "tier", F.col("review_due").cast("string"))


@query(TIERED + """ SELECT part, name, cases, round(exposure, 2) AS exposure FROM (SELECT 'tier' AS part, tier AS name, count(*) AS cases, sum(exposure) AS exposure FROM e GROUP BY 2
UNION ALL SELECT 'band', band, count(*), sum(exposure) FROM e GROUP BY 2 UNION ALL (SELECT 'state', state_name, count(*), sum(exposure) FROM e GROUP BY 2 ORDER BY 4 DESC, 2 LIMIT 10))""", SCORED)
def case_overview(spark, d):
    return summaries.case_overview(A.stored(summaries.escalated(leads(spark, d), F.current_date(), "x"))).withColumn("exposure", F.round("exposure", 2))


@query("""SELECT work_ref, concat_ws(',', CASE WHEN sig_duplicate > 0 THEN 'COMPARE_RECORDS' END, CASE WHEN checks_fired > 0 THEN 'REVIEW_LIFECYCLE' END, CASE WHEN sig_amount > 0 THEN 'COMPARE_ESTIMATE' END,
CASE WHEN warning_level IN ('HIGH', 'CRITICAL') THEN 'REQUEST_PROGRESS' END, 'VERIFY_EVIDENCE') AS actions FROM scored""", SCORED)
def next_actions(spark, d):
    return A.scored(spark, d).select("work_ref", F.array_join(summaries.actions(), ",").alias("actions"))


@query("""+ t AS (SELECT work_ref, is_open, warning_level, concat_ws('; ', CASE WHEN stall_ratio >= 1.2 THEN concat('open ', printf('%.1f', stall_ratio), ' times as long as usual in ', state_name) END,
CASE WHEN risk >= 0.4 THEN concat('risk of ', round_even(risk * 100, 0)::BIGINT, ' % not to be done in time') END) AS said FROM scored)
SELECT work_ref, CASE WHEN is_open <> 1 THEN 'completed' WHEN said = '' THEN 'in its usual range' ELSE concat(warning_level, ': ', said) END AS reason FROM t""", SCORED)
def warning_reasons(spark, d):
    return A.scored(spark, d).select("work_ref", summaries.warning_reason().alias("reason"))


@query("""SELECT digest, owners, files, first_owner, last_owner FROM (SELECT sha256(text) AS digest, count(DISTINCT doc_id) AS owners, count(*) AS files, min(doc_id) AS first_owner, max(doc_id) AS last_owner
FROM documents WHERE text IS NOT NULL GROUP BY 1 HAVING count(DISTINCT doc_id) > 1 ORDER BY 2 DESC, 3 DESC, 1 LIMIT 200)""")
def content_reuse(spark, d):
    files = A.table(spark, d, "documents").select("doc_id", F.sha2("text", 256).alias("digest"))
    return summaries.equal_content(files, "digest", "doc_id")


@query("""SELECT source, count(*) AS entries, count(text) AS with_content, count(DISTINCT sha256(text)) AS contents, sum(strlen(text))::BIGINT AS bytes, count(text) - count(DISTINCT sha256(text)) AS duplicates FROM documents GROUP BY 1""")
def content_coverage(spark, d):
    files = A.table(spark, d, "documents").select("source", F.sha2("text", 256).alias("digest"), F.octet_length("text").alias("size"))
    return summaries.coverage(files, "source", "digest", "size")


@query("""+ g AS (SELECT serial, count(*) AS n, sum(amount) AS v FROM pay GROUP BY 1)
SELECT count(*) AS owners, round(avg(n), 6) AS mean_items, max(n) AS most_items, round(avg(v), 2) AS mean_value, round(quantile_cont(v, 0.5), 2) AS median_value FROM g""", PAYMENTS)
def payment_coverage(spark, d):
    out = summaries.per_owner(A.payments(spark, d), "serial", "amount")
    return out.withColumns({"mean_items": F.round("mean_items", 6), "mean_value": F.round("mean_value", 2), "median_value": F.round("median_value", 2)})


FLAGS = ["is_orphan", "has_nonpositive_amount", "is_backdated", "is_future_dated", "completed_without_sanction"]


@query("""SELECT 'rows' AS section, 'all' AS reason, count(*) AS count FROM w UNION ALL SELECT 'rows', 'clean', count(*) FILTER (NOT (""" + " OR ".join(FLAGS) + ")) FROM w " + " ".join(f"UNION ALL SELECT 'flagged', '{c}', count(*) FILTER ({c}) FROM w" for c in FLAGS), WORKS)
def ingest_report(spark, d):
    return summaries.ingest_report(A.conformed(spark, d), FLAGS)


@query("""WITH m AS (SELECT max(ts) AS t FROM events), u AS (SELECT user_id, max(ts) AS last FROM events GROUP BY 1)
SELECT (SELECT count(*) FROM events) AS entries, count(*) AS keys, epoch_us(max(last)) AS last_entry, epoch_us(min(last)) AS oldest_check, (SELECT count(*) FROM events, m WHERE ts > t - INTERVAL 24 HOURS) AS last_day FROM u""")
def live_status(spark, d):
    out = summaries.live_status(A.table(spark, d, "events"), "user_id", "ts")
    return out.withColumns({c: F.unix_micros(F.col(c).cast("timestamp")) for c in ("last_entry", "oldest_check")})


SIDES = """+ own AS (SELECT o_custkey AS mp_id, count(*) AS own_count, sum(o_totalprice::DECIMAL(18, 2)) AS own_sum FROM orders WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem) AND o_custkey IN (SELECT c_custkey FROM customer WHERE c_nationkey IN (SELECT n_nationkey FROM nation)) GROUP BY 1),
tot AS (SELECT o_custkey AS mp_id, sum(o_totalprice::DECIMAL(18, 2)) AS grand_total FROM orders GROUP BY 1),
til AS (SELECT o_custkey AS mp_id, count(*) AS tile_count, floor(sum(o_totalprice::DECIMAL(18, 2))::DOUBLE) AS tile_amount FROM orders WHERE o_orderstatus <> 'P' GROUP BY 1),
f AS (SELECT mp_id, round((own_sum - grand_total)::DOUBLE, 2) AS sum_delta, round(grand_total::DOUBLE - tile_amount, 2) AS tile_delta, own_count - tile_count AS count_delta FROM own FULL JOIN tot USING (mp_id) FULL JOIN til USING (mp_id)),
c AS (SELECT *, abs(sum_delta) < 0.01 AS sum_matches, abs(tile_delta) < 1 AS total_matches_tile, count_delta = 0 AS count_matches_tile FROM f)"""


def sides(spark, d):
    """Three sides of each owner that come from different rows: works that have stages as our own, all orders as the server's total,
    and orders that are not pending, in whole units, as the published tile."""
    orders, keys = A.table(spark, d, "orders").select(F.col("o_custkey").alias("mp_id"), "o_orderstatus", F.col("o_totalprice").cast("decimal(18,2)").alias("v")), ["mp_id"]
    works = A.conformed(spark, d).where(~F.col("is_orphan")).withColumn("v", F.col("recommended_amount").cast("decimal(18,2)"))
    own = works.groupBy(*keys).agg(F.count("*").alias("own_count"), F.sum("v").alias("own_sum"))
    tiles = orders.where("o_orderstatus <> 'P'").groupBy(*keys).agg(F.count("*").alias("tile_count"), F.floor(F.sum("v")).alias("tile_amount"))
    return summaries.three_way(own, orders.groupBy(*keys).agg(F.sum("v").alias("grand_total")), tiles, keys)


@query(SIDES + " SELECT * FROM c", WORKS)
def reconciliation(spark, d):
    out = sides(spark, d).withColumns({"sum_delta": F.col("sum_delta").cast("double"), "tile_delta": F.col("tile_delta").cast("double")})
    return out.select("mp_id", "sum_delta", "tile_delta", "count_delta", "sum_matches", "total_matches_tile", "count_matches_tile")


@query(SIDES + """ SELECT mp_id, failed FROM (SELECT *, coalesce((NOT sum_matches)::INT, 0) + coalesce((NOT total_matches_tile)::INT, 0) + coalesce((NOT count_matches_tile)::INT, 0) AS failed FROM c) WHERE failed > 0""", WORKS)
def reconciliation_mismatches(spark, d):
    return summaries.mismatches(sides(spark, d)).select("mp_id", "failed")
