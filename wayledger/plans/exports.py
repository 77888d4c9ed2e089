"""Queries on rows for import elsewhere, with the SQL that must give the same rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import adapters as A
from ..operators import casework, planning
from ..operators.ordering import ranked
from ..sources import exports
from .base_sql import SCORED, WORKS
from .pages import STAGE
from .registry import query


@query(r"""WITH f AS (SELECT doc_id, trim(regexp_replace(replace(replace(replace(translate(coalesce(text, ''), '‘’“”"–—·•×⁄', '''''''''''----x/'), '…', '...'), '₹', 'Rs '), '°', ' deg '), '[^\x21-\x7E]+', ' ', 'g')) AS t FROM documents)
SELECT doc_id, length(t) AS length, sha256(t) AS digest FROM f""")
def ascii_lines(spark, d):
    """Every whole text as one line of ASCII."""
    t = exports.ascii_line("text")
    return A.table(spark, d, "documents").select("doc_id", F.length(t).alias("length"), F.sha2(t, 256).alias("digest"))


@query(f"""SELECT work_ref, coalesce(work_description, '') AS description, state_name AS state, band, warning_level AS warning, printf('%.2f', round(recommended_amount, 2)) AS amount, families::VARCHAR AS families, recommendation_date::VARCHAR AS since,
CASE WHEN round(exposure) >= 50000000 THEN 'Ministry Review' WHEN round(exposure) >= 5000000 THEN 'State Nodal' ELSE 'District Monitoring' END AS tier,
(snapshot + (CASE WHEN round(exposure) >= 50000000 THEN 7 WHEN round(exposure) >= 5000000 THEN 14 ELSE 30 END * CASE band WHEN 'HIGH' THEN 1 ELSE 2 END)::INT)::VARCHAR AS review_due, CASE WHEN {STAGE} = 'Completed' THEN 'Completed' ELSE 'Open' END AS status,
concat_ws('; ', CASE WHEN sig_amount > 0 THEN 'amount' END, CASE WHEN sig_duration > 0 THEN 'duration' END, CASE WHEN sig_risk > 0 THEN 'risk' END, CASE WHEN sig_conformance > 0 THEN 'conformance' END,
  CASE WHEN sig_change > 0 THEN 'change' END, CASE WHEN sig_anomaly > 0 THEN 'anomaly' END) AS evidence FROM scored WHERE band IN ('MEDIUM', 'HIGH')""", SCORED)
def exported_cases(spark, d):
    """Cases as rows to import; of the evidence the signals alone."""
    last = A.table(spark, d, "orders").select(F.max("o_orderdate").cast("date")).scalar()
    out = exports.cases(casework.documents(A.scored(spark, d).withColumn("recommended_amount", F.round("recommended_amount", 2))), last)
    return out.withColumn("evidence", F.regexp_replace("evidence", r": [^;]*", "")).select("work_ref", "description", "state", "band", "warning", "amount", "families", "since", "tier", "review_due", "status", "evidence")


@query("""SELECT work_ref, signal, row_number() OVER (PARTITION BY work_ref ORDER BY k)::VARCHAR AS place FROM (SELECT work_ref, unnest(['amount', 'duration', 'risk', 'conformance', 'change', 'anomaly']) AS signal, unnest([1, 2, 3, 4, 5, 6]) AS k,
unnest([sig_amount, sig_duration, sig_risk, sig_conformance, sig_change, sig_anomaly]) AS v FROM scored WHERE band IN ('MEDIUM', 'HIGH')) WHERE v > 0""", SCORED)
def exported_evidence(spark, d):
    """Each piece of evidence of each case, in its place."""
    return exports.evidence(casework.documents(A.scored(spark, d))).select("work_ref", "signal", "place")


@query("""+ t AS (SELECT implementing_agency AS agency, state_name, count(*) * 0.35 + 0.65 AS cost FROM w GROUP BY 1, 2), s AS (SELECT *, ceil(cost - 1e-9) AS span FROM t),
c AS (SELECT state_name, agency, (sum(span) OVER o - span + 1)::BIGINT AS day_from, (sum(span) OVER o)::BIGINT AS day_to FROM s WINDOW o AS (PARTITION BY state_name ORDER BY agency)),
v AS (SELECT *, row_number() OVER (PARTITION BY implementing_agency ORDER BY work_ref) AS place FROM scored)
SELECT '10d-4a-' || work_ref AS assignment, CASE WHEN band IN ('MEDIUM', 'HIGH') THEN work_ref ELSE '' END AS "case", place::VARCHAR AS place, day_from::VARCHAR AS day_from, day_to::VARCHAR AS day_to, CASE WHEN place = 1 THEN '1.00' ELSE '0.35' END AS cost,
CASE WHEN place = 1 THEN 'FALSE' ELSE 'TRUE' END AS repeat_visit FROM v JOIN c ON v.implementing_agency = c.agency AND v.state_name = c.state_name""", SCORED)
def exported_assignments(spark, d):
    """Every work as a visit on its agency's trip; those of leads name their case."""
    s = A.scored(spark, d)
    trips = s.groupBy(F.col("implementing_agency").alias("agency"), F.col("state_name").alias("state")).agg((F.count("*") * 0.35 + 0.65).alias("cost"))
    trips = planning.calendar(trips, ["state"], "agency").select("state", "agency", "day_from", "day_to")
    place = ranked(s.select("work_ref", F.col("implementing_agency").alias("agency"), F.col("state_name").alias("state"), "exposure", "band"), "_all", F.asc("agency"), F.asc("work_ref"))
    first = place.groupBy("agency").agg(F.min("_all").alias("_first"))
    visits = place.join(first, "agency").withColumn("place", F.col("_all") - F.col("_first") + 1).join(trips, ["agency", "state"])
    visits = visits.withColumns({"cost": F.when(F.col("place") == 1, 1.0).otherwise(0.35), "auditor": F.lit("one")})
    return exports.assignments(visits, s.where("band IN ('MEDIUM', 'HIGH')"), 10, 4, 1.0).select("assignment", "case", "place", "day_from", "day_to", "cost", "repeat_visit")


@query("""+ e AS (SELECT event_id, user_id::VARCHAR AS work_ref, json_extract_string(props, '$.k') AS board_ref, ts, event_type, value FROM events)
SELECT event_id::VARCHAR AS actor, CASE WHEN work_ref IN (SELECT serial::VARCHAR FROM w) THEN work_ref ELSE '' END AS "case", event_type AS outcome, ts::DATE::VARCHAR AS created_at, board_ref, CASE WHEN event_id % 3 <> 0 THEN printf('%.2f', event_id / 4.0) ELSE '' END AS board_amount,
CASE WHEN value > 0 THEN 'TRUE' ELSE 'FALSE' END AS demo, CASE WHEN board_ref <> work_ref THEN 'TRUE' ELSE 'FALSE' END AS board_disagrees FROM e""", WORKS)
def exported_verifications(spark, d):
    """Events as visits made, with what a board at the place says."""
    e = A.table(spark, d, "events").select(
        F.col("user_id").cast("string").alias("work_ref"), F.col("event_type").alias("outcome"), F.col("ts").cast("string").alias("created_at"), F.col("event_id").cast("string").alias("actor"), F.get_json_object("props", "$.k").alias("board_ref"),
        F.when(F.col("event_id") % 3 != 0, F.col("event_id") / 4).alias("board_amount"), F.lit(0.5).alias("confidence"), F.lit(None).cast("int").alias("needed_confirmation"), (F.col("value") > 0).alias("demo"), F.lit(None).cast("int").alias("reuse"),
    )
    known = A.conformed(spark, d).select(F.col("serial").cast("string").alias("work_ref"))
    return exports.verifications(e, known).select("actor", "case", "outcome", "created_at", "board_ref", "board_amount", "demo", "board_disagrees")
