"""Queries on case documents, casework, export tiers, lookups and pages, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import adapters as A
from ..operators import casework, duplicates, pages, planning
from ..operators.ordering import ranked
from ..sources.tables import settled, stored
from .base_sql import SCORED
from .leads import PICTURES
from .registry import NEAR, query, r

# ------------------------------------------------------------------------------------------------ casework

STAGE = "CASE WHEN is_completed = 1 THEN 'Completed' WHEN is_sanctioned THEN 'Sanctioned' ELSE 'Recommended' END"


@query(f"""SELECT work_ref, work_description AS description, {STAGE} AS stage, activity_category AS kind, peer_level, peer_group_size AS peers, round(amount_pct, 3) AS percentile, round(risk::DECIMAL(18, 8), 3)::DOUBLE AS risk,
round(priority, 4) AS priority, round(exposure) AS exposure, warning_level, round(stall_ratio, 2) AS stall_ratio, duration_days AS days,
concat_ws(',', CASE WHEN sig_amount > 0 THEN 'amount' END, CASE WHEN sig_duration > 0 THEN 'duration' END, CASE WHEN sig_risk > 0 THEN 'risk' END, CASE WHEN sig_conformance > 0 THEN 'conformance' END,
  CASE WHEN sig_change > 0 THEN 'change' END, CASE WHEN sig_anomaly > 0 THEN 'anomaly' END) AS evidence,
concat_ws(',', CASE WHEN is_orphan THEN 'orphan' END, CASE WHEN is_backdated THEN 'backdated' END, CASE WHEN is_future_dated THEN 'future_dated' END, CASE WHEN completed_without_sanction THEN 'no_sanction' END,
  CASE WHEN has_nonpositive_amount THEN 'nonpositive' END, CASE WHEN chk_no_text THEN 'no_text' END, CASE WHEN chk_stalled THEN 'stalled' END, CASE WHEN chk_amount THEN 'amount' END) AS findings,
CASE WHEN is_backdated OR completed_without_sanction OR is_future_dated THEN 'CHECK_STAGES' WHEN sig_amount > 0 THEN 'CHECK_ESTIMATE' WHEN sig_risk > 0 OR sig_duration > 0 THEN 'ASK_FOR_PROGRESS' ELSE 'REVIEW_EVIDENCE' END AS first_step,
concat_ws(',', CASE WHEN checks_fired > 0 THEN 'REVIEW_STAGES' END, CASE WHEN sig_amount > 0 THEN 'COMPARE_WITH_PEERS' END, CASE WHEN warning_level IN ('HIGH', 'CRITICAL') THEN 'ASK_FOR_PROGRESS' END, 'VERIFY_DOCUMENTS') AS actions
FROM scored WHERE band IN ('MEDIUM', 'HIGH')""", SCORED)  # fmt: skip
def case_documents(spark, d):
    """The nested document of every lead, its parts laid out in columns."""
    c = casework.documents(A.scored(spark, d))
    names = lambda of, part: F.array_join(F.transform(of, lambda x: x[part]), ",")
    return c.select(
        "work_ref", "case.identity.description", "case.lifecycle.stage", "case.kind", F.col("case.peers.level").alias("peer_level"), F.col("case.peers.size").alias("peers"), F.col("case.peers.amount_percentile").alias("percentile"),
        "case.risk", "case.scores.priority", "case.scores.exposure", F.col("case.warning.level").alias("warning_level"), "case.warning.stall_ratio", "case.lifecycle.days", names("case.evidence", "signal").alias("evidence"),
        names("case.findings", "check").alias("findings"), "case.first_step", F.array_join("case.actions", ",").alias("actions"),
    )


@query("""+ v AS (SELECT user_id AS serial, event_type, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS k FROM events),
g AS (SELECT serial, count(*) AS n, string_agg(event_type, ',' ORDER BY k) FILTER (k <= 5) AS l, max(event_type) FILTER (k = 1) AS o FROM v GROUP BY 1)
SELECT work_ref, coalesce(n, 0) AS visits, o AS outcome, coalesce(l, '') AS outcomes FROM scored LEFT JOIN g USING (serial) WHERE band IN ('MEDIUM', 'HIGH')""", SCORED)
def cases_with_visits(spark, d):
    """Leads with the visits to them: how many, and the last outcomes."""
    cases = A.scored(spark, d).where(F.col("band").isin("MEDIUM", "HIGH")).select("work_ref", "serial")
    visits = A.table(spark, d, "events").select(F.col("user_id").alias("serial"), "event_type", "ts", "event_id")
    out = casework.with_visits(cases, visits, "serial", "event_type", F.desc("ts"), F.desc("event_id"))
    return out.select("work_ref", "visits", "outcome", F.array_join("outcomes", ",").alias("outcomes"))


@query("SELECT event_id, CASE WHEN user_id IN (SELECT serial FROM scored WHERE band IN ('MEDIUM', 'HIGH')) THEN user_id END AS parent FROM events", SCORED)
def visits_with_parent(spark, d):
    """All visits, with the case they belong to where there is one."""
    cases = A.scored(spark, d).where(F.col("band").isin("MEDIUM", "HIGH")).select("serial")
    rows = A.table(spark, d, "events").select("event_id", F.col("user_id").alias("serial"))
    return casework.with_parent(rows, cases, "serial").select("event_id", "parent")


TIERS = """+ pl AS (SELECT work_ref FROM scored WHERE state_name IN ('NATION_1', 'NATION_2', 'NATION_3') AND audit_roi > 0),
ti AS (SELECT work_ref, audit_roi, CASE WHEN work_ref IN (SELECT work_ref FROM pl) THEN '1 plan' WHEN band = 'HIGH' THEN '2 rest of HIGH' WHEN band = 'MEDIUM' THEN '3 MEDIUM' END AS tier, nullif(serial % 4, 0) AS attach FROM scored)"""


def tiered(spark, d):
    s = A.scored(spark, d).withColumn("attach", F.nullif(F.col("serial") % 4, F.lit(0)))
    return s, s.where(F.col("state_name").isin("NATION_1", "NATION_2", "NATION_3") & (F.col("audit_roi") > 0))


@query(TIERS + """ SELECT tier, count(*) AS works, count(attach) AS with_files, round(count(attach) * 0.84 / 1024, 3) AS gb, round(count(attach) * 20.4 / 3600, 1) AS slow_hours, round(count(attach) * 2.0 / 3600, 1) AS fast_hours
FROM ti WHERE tier IS NOT NULL GROUP BY 1""", SCORED)
def tier_costs(spark, d):
    """What fetching and reading the files of each export tier takes."""
    works, plan = tiered(spark, d)
    return casework.tier_costs(casework.export_tiers(works, plan), "attach")


@query(TIERS + " SELECT work_ref, attach FROM ti WHERE tier = '1 plan' AND attach IS NOT NULL", SCORED)
def files_to_fetch(spark, d):
    """The planned works that have files."""
    works, plan = tiered(spark, d)
    return casework.to_fetch(plan, works, "work_ref", "attach", F.desc("audit_roi"), F.asc("work_ref")).select("work_ref", "attach")


@query()
def plan_totals(spark, d):
    """Works, agencies, days, exposure and repeat visits of each state's plans."""
    leads = A.scored(spark, d).where(F.col("band").isin("MEDIUM", "HIGH"))
    plan = planning.plans(leads, "state_name", [3.0, 10.0], "implementing_agency", "exposure", "work_ref")
    return casework.plan_totals(plan, ["state_name", "budget"])


@query("""WITH f AS (SELECT event_id, user_id % 10 <> 0 AS attributed, event_type IN ('view', 'click') AS camera_read, json_extract_string(props, '$.k')::INT >= 50 AS readers_agreed, value > 0 AS chained FROM events)
SELECT event_id, attributed, camera_read, readers_agreed, coalesce(chained, false) AS chained, 1 + attributed::INT + camera_read::INT + readers_agreed::INT + coalesce(chained, false)::INT AS reached FROM f""")
def evidence_steps(spark, d):
    """Five facts that follow from each field record."""
    e = A.table(spark, d, "events")
    rows = e.select(
        "event_id", F.when(F.col("user_id") % 10 == 0, "anonymous").otherwise(F.col("user_id").cast("string")).alias("actor"), F.when(F.col("event_type") == "view", "p.jpg").alias("photo"), F.when(F.col("event_type") == "click", "d.pdf").alias("document"),
        F.lit("").alias("ocr_text"), (F.get_json_object("props", "$.k").cast("int") >= 50).cast("int").alias("readers_agree"), F.when(F.col("value") > 0, F.sha2(F.col("event_id").cast("string"), 256)).alias("row_hash"),
    )
    return casework.evidence_steps(rows).select("event_id", "attributed", "camera_read", "readers_agreed", "chained", "reached")


@query("""+ v AS (SELECT doc_id, CASE WHEN distance <= 8 THEN 'x' ELSE 'UNSETTLED' END AS verdict, a, b FROM near, (SELECT 0 AS doc_id) WHERE distance <= 14),
s AS (SELECT k, bool_or(verdict <> 'UNSETTLED') AS reuse FROM (SELECT a AS k, verdict FROM v UNION ALL SELECT b, verdict FROM v) GROUP BY 1)
SELECT count(*) AS records, count(*) FILTER (n_chars > 500) AS with_picture, count(*) FILTER (d.doc_id % 3 = 0) AS disagreeing, count(*) FILTER (d.doc_id % 7 = 0) AS to_confirm,
count(*) FILTER (reuse) AS reused, count(*) FILTER (NOT reuse) AS unsettled FROM documents d LEFT JOIN s ON s.k = d.doc_id""", PICTURES)
def forensic_summary(spark, d):
    """How many records have pictures, readers that disagree, and pictures that look like others'."""
    docs = A.table(spark, d, "documents")
    rows = docs.select(F.col("doc_id").alias("id"), F.when(F.col("n_chars") > 500, "p.jpg").alias("photo"), (F.col("doc_id") % 3 != 0).cast("int").alias("readers_agree"), (F.col("doc_id") % 7 == 0).cast("int").alias("needed_confirmation"))
    return casework.forensic_summary(rows, duplicates.image_pairs(settled(spark, lambda: A.pictures(spark, d)), "picture", "owner", "first", "second"), "id")


# ------------------------------------------------------------------------------------------------ pages and lookups


@query("""SELECT work_ref, stage FROM (SELECT work_ref, audit_roi, """ + STAGE + """ AS stage, state_name, work_description, implementing_agency FROM scored WHERE band IN ('MEDIUM', 'HIGH'))
WHERE stage = 'Sanctioned' AND (contains(lower(work_description), 'nation_1/') OR contains(lower(implementing_agency), 'nation_1/')) ORDER BY audit_roi DESC, work_ref LIMIT 40 OFFSET 5""", SCORED)
def case_page(spark, d):
    """A page of the sanctioned leads that name one nation's agencies."""
    c = A.scored(spark, d).where(F.col("band").isin("MEDIUM", "HIGH")).withColumn("stage", casework.stage())
    page = pages.case_page(c, [F.desc("audit_roi"), F.asc("work_ref")], {"stage": "Sanctioned"}, "Nation_1/", ("work_description", "implementing_agency"), 5, 40)
    return page.select("work_ref", "stage")


@query("""SELECT work_ref, CASE WHEN band IN ('MEDIUM', 'HIGH') THEN band ELSE 'NONE' END AS band, CASE WHEN band IN ('MEDIUM', 'HIGH') THEN round(priority, 6) ELSE 0 END AS priority, band IN ('MEDIUM', 'HIGH') AS is_case FROM scored WHERE serial % 50 = 0""", SCORED)
def looked_up_works(spark, d):
    """Works asked for by key: their case, or a record without signals."""
    s = A.scored(spark, d)
    cases = s.where(F.col("band").isin("MEDIUM", "HIGH")).select("work_ref", "band", r("priority", 6))
    wanted = s.where("serial % 50 = 0").select("work_ref").unionByName(spark.createDataFrame([("no such work",)], "work_ref string"))
    return pages.looked_up(s, cases, wanted, "work_ref", {"band": "NONE", "priority": 0.0}).select("work_ref", "band", "priority", "is_case")


@query(NEAR + """, x AS (SELECT p.*, a.label, a.vec_id % 3 = b.vec_id % 3 AS same_agency, a.vec_id % 4 = b.vec_id % 4 AS same_seat, a.vec_id % 5 = b.vec_id % 5 AS same_owner FROM pairs p JOIN embeddings a ON a.vec_id = p.a JOIN embeddings b ON b.vec_id = p.b)
SELECT a, b, row_number() OVER (ORDER BY similarity DESC, same_agency DESC, same_seat DESC, a, b)::BIGINT AS place,
concat_ws(', ', printf('texts are %.2f%% alike', similarity * 100), 'both in S' || label, CASE WHEN same_seat THEN 'the same seat' END, CASE WHEN same_agency THEN 'the same agency' END, CASE WHEN same_owner THEN 'the same owner' END) AS why FROM x""")
def explained_pairs(spark, d):
    """Pairs in the order in which people should see them, each with a sentence that says why."""
    e = A.table(spark, d, "embeddings")
    pairs = stored(duplicates.block_pairs(e, "vec_id", ["label"], "embedding", least=0.30))
    x = pairs.join(e.select(F.col("vec_id").alias("a"), F.concat(F.lit("S"), "label").alias("state")), "a")
    same = lambda n: F.col("a") % n == F.col("b") % n
    x = x.withColumns({"same_agency": same(3), "same_seat": same(4), "same_owner": same(5), "same_text": F.lit(False)})
    return ranked(x, "place", *pages.pair_order()).select("a", "b", "place", pages.pair_sentence().alias("why"))


@query("""WITH x AS (SELECT o_orderkey, CASE WHEN o_orderkey % 9 = 0 THEN o_orderpriority ELSE 'WS/MP' || o_custkey || '/2019-2020/' || o_orderkey || '-' || o_orderpriority || CASE WHEN o_orderkey % 5 = 0 THEN chr(10) || 'more ' ELSE ' ' END END AS t FROM orders),
n AS (SELECT lower(trim(c_name)) AS name, min(c_custkey) AS id FROM customer WHERE trim(c_name) <> '' GROUP BY 1),
l AS (SELECT o_orderkey AS w, CASE WHEN o_orderkey % 11 <> 0 THEN upper(c_name) || '  ' END AS owner, CASE WHEN o_orderkey % 6 <> 0 THEN n_name END AS state FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey)
SELECT CASE WHEN id IS NOT NULL THEN 'MP' || id ELSE 'S7' END || '-W' || w AS work_ref, coalesce(state, 'HOME') AS state, CASE WHEN w % 9 = 0 THEN 'Uncategorised' ELSE trim(regexp_extract(t, '(?s)^WS/MP\\d+/\\d{4}-\\d{4}/\\d+-(.+)$', 1)) END AS category
FROM l JOIN x ON x.o_orderkey = l.w LEFT JOIN n ON n.name = lower(trim(coalesce(owner, '')))""")
def live_works(spark, d):
    """Orders as rows that a portal sends, shaped as works: references, categories, states."""
    o, c, n = (A.table(spark, d, t) for t in ("orders", "customer", "nation"))
    sent = o.join(c, F.col("o_custkey") == F.col("c_custkey")).join(n, F.col("c_nationkey") == F.col("n_nationkey"))
    more = F.when(F.col("o_orderkey") % 5 == 0, "\nmore ").otherwise(" ")
    activity = F.when(F.col("o_orderkey") % 9 == 0, F.col("o_orderpriority")).otherwise(F.concat(F.lit("WS/MP"), "o_custkey", F.lit("/2019-2020/"), "o_orderkey", F.lit("-"), "o_orderpriority", more))
    raw = sent.select(
        F.col("o_orderkey").alias("work_id"), F.when(F.col("o_orderkey") % 11 != 0, F.concat(F.upper("c_name"), F.lit("  "))).alias("owner_name"), activity.alias("activity"), F.when(F.col("o_orderkey") % 6 != 0, F.col("n_name")).alias("state_name"),
        F.lit(7).alias("scope_id"), F.lit("HOME").alias("scope_state"),
    )
    return pages.live_works(raw, pages.ids_by_name(c, "c_name", "c_custkey"), "scope_id", "scope_state").select("work_ref", "state", "category")


@query("""SELECT l_orderkey, l_linenumber, coalesce(nullif(l_linenumber % 2, 0), 1) AS flag FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_extendedprice) AS k FROM lineitem WHERE l_linenumber % 3 <> 0) WHERE k = 1""")
def attachment_bearing(spark, d):
    """Each order's first line that bears an attachment."""
    lines = A.table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", (F.col("l_linenumber") % 3).alias("attach"), F.nullif(F.col("l_linenumber") % 2, F.lit(0)).alias("flag"), "l_extendedprice")
    return pages.attachment_bearing(lines, "l_orderkey", "attach", F.asc("l_linenumber"), F.asc("l_extendedprice")).select("l_orderkey", "l_linenumber", "flag")


@query("""WITH a AS (SELECT text, min(label) AS kind FROM (SELECT text, length(text) % 5 AS label FROM documents WHERE text IS NOT NULL UNION ALL SELECT text, length(text) % 3 + 2 FROM documents WHERE text IS NOT NULL AND doc_id % 2 = 0) GROUP BY 1)
SELECT doc_id, kind, CASE WHEN kind IN (0, 1, 2) THEN 'kind ' || kind ELSE 'Unclassified' END AS label FROM documents LEFT JOIN a USING (text)""")
def kinds_of_documents(spark, d):
    """Each document's kind by its text, and the kind's label in a catalogue that lacks some."""
    docs = A.table(spark, d, "documents").select("doc_id", "text")
    one = docs.select("text", (F.length("text") % 5).alias("kind"))
    assigned = one.unionByName(docs.where("doc_id % 2 = 0").select("text", (F.length("text") % 3 + 2).alias("kind")))
    catalogue = spark.createDataFrame([(k, f"kind {k}") for k in range(3)], "kind int, label string")
    return pages.kinds_of(docs, assigned, catalogue, "text", "kind", "label").select("doc_id", "kind", "label")
