"""Queries on worklists, lateness, vendors, files and checks, with the SQL that must give the same rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import adapters as A
from ..operators import canonical, casework, portfolio, reports, summaries
from .base_sql import PAYMENTS, SCORED, WORKS
from .pages import STAGE
from .registry import CHIGH, CLOW, HHI, query, r
from .summaries import TIERED, leads

# ------------------------------------------------------------------------------------------------ worklists and scopes


@query("""SELECT work_ref, band, warning_level FROM scored WHERE band IN ('MEDIUM', 'HIGH') AND severity = 'MEDIUM' AND sig_amount > 0 AND (contains(lower(work_description), 'nation_1') OR contains(lower(implementing_agency), 'nation_1'))""", SCORED)
def filtered_worklist(spark, d):
    """Leads of one severity, with one signal, that name the nations whose names begin alike."""
    return portfolio.worklist(A.scored(spark, d), {"severity": "MEDIUM"}, "amount", "Nation_1").select("work_ref", "band", "warning_level")


@query("""SELECT state_name, count(*) FILTER (band IN ('MEDIUM', 'HIGH')) AS leads, round(coalesce(sum(exposure) FILTER (band IN ('MEDIUM', 'HIGH')), 0), 2) AS exposure, count(*) FILTER (band = 'HIGH') AS high, count(*) FILTER (band = 'MEDIUM') AS medium FROM scored GROUP BY 1""", SCORED)
def scope_totals(spark, d):
    """Leads and exposure in each state's scope."""
    return portfolio.scope_totals(A.scored(spark, d), "state_name").withColumn("exposure", F.round("exposure", 2))


@query("""SELECT count(*) AS works, round(avg((band IN ('MEDIUM', 'HIGH'))::INT), 6) AS surfaced_rate, round(avg(is_open), 6) AS open_rate, round(quantile_cont(recommended_amount, 0.5), 2) AS median_amount FROM scored""", SCORED)
def national_baselines(spark, d):
    """What every agency's figures are read against."""
    return portfolio.baselines(A.scored(spark, d)).select("works", r("surfaced_rate", 6), r("open_rate", 6), r("median_amount", 2))


@query("""+ g AS (SELECT implementing_agency, count(*) AS works, sum(recommended_amount) AS amount, sum(exposure) AS exposure, min_by(state_name, work_ref) AS state FROM scored GROUP BY 1)
SELECT implementing_agency, works, round(amount, 2) AS amount, round(exposure, 2) AS exposure, state FROM g ORDER BY g.works DESC, g.exposure DESC, 1 LIMIT 40""", SCORED)
def agency_first_states(spark, d):
    """The agencies with most works and the state of each one's first work."""
    return portfolio.first_states(A.scored(spark, d)).select("implementing_agency", "works", r("amount", 2), r("exposure", 2), "state")


@query("""SELECT mp_id, work_ref FROM (SELECT mp_id, work_ref, row_number() OVER (PARTITION BY mp_id ORDER BY recommendation_date DESC, work_ref) AS k FROM w) WHERE k <= 5""", WORKS)
def newest_works(spark, d):
    """The newest works of each owner."""
    return reports.top_of_each(A.conformed(spark, d), ["mp_id"], 5, F.desc("recommendation_date"), F.asc("work_ref")).select("mp_id", "work_ref")


# ------------------------------------------------------------------------------------------------ casework


@query(f"""WITH v AS (SELECT quality, CASE WHEN n_chars >= 3000 THEN 'HIGH' WHEN n_chars >= 1000 THEN 'MEDIUM' ELSE 'NOT SURFACED' END AS band FROM labels l LEFT JOIN documents d ON d.doc_id = l.doc_id),
g AS (SELECT band, count(*) AS visits, count(*) FILTER (quality <> 1) AS confirmed FROM v GROUP BY 1),
c AS (SELECT CASE band WHEN 'HIGH' THEN 1 WHEN 'MEDIUM' THEN 2 ELSE 3 END AS place, round(confirmed / visits::DOUBLE, 3) AS rate, round({CLOW}, 3) AS low, round({CHIGH}, 3) AS high FROM g WHERE visits >= 10),
n AS (SELECT *, lead(rate) OVER (ORDER BY place) AS next_rate, lead(high) OVER (ORDER BY place) AS next_high FROM c)
SELECT count(*)::INT AS reportable, count(*) >= 2 AS testable, bool_and(rate >= next_rate) AS holds, bool_and(low > next_high) AS separated FROM n""")
def calibration_ordering(spark, d):
    """Whether what visits confirmed falls in the order of the bands."""
    visits, bands = A.verifications(spark, d)
    return portfolio.band_ordering(reports.calibration(visits, bands, "work", ["NOT_STARTED", "NOT_FOUND", "RECORD_MISMATCH"]), ("HIGH", "MEDIUM", "LOW", "NONE", "NOT SURFACED"))


@query("""SELECT CASE WHEN quality = 1 THEN 'VERIFIED_COMPLETE' ELSE 'RECORD_MISMATCH' END AS outcome, count(*) FILTER (doc_id % 10 <> 0) AS visits, count(DISTINCT doc_id) FILTER (doc_id % 10 <> 0) AS works, count(*) FILTER (doc_id % 10 = 0) AS demo_excluded FROM labels GROUP BY 1""")
def outcome_counts(spark, d):
    """Visits and works by outcome, demonstrations apart."""
    visits, _ = A.verifications(spark, d)
    return portfolio.outcome_counts(visits.withColumn("demo", F.col("work") % 10 == 0), "outcome", "work", "demo")


#: Cases move when an event of their number is recorded, and are read twenty days after the snapshot.
MOVED = TIERED + """, m AS (SELECT user_id, max(ts) AS moved_at FROM events WHERE event_type = 'purchase' GROUP BY 1),
cs AS (SELECT e.*, """ + STAGE + """ AS stage, moved_at, date_diff('day', snapshot + wait::INT, snapshot + 20) AS late FROM e LEFT JOIN m ON user_id = serial)"""  # fmt: skip


def moved_cases(spark, d):
    last = A.table(spark, d, "orders").select(F.max("o_orderdate").cast("date")).scalar()
    moves = A.table(spark, d, "events").where("event_type = 'purchase'").groupBy(F.col("user_id").alias("serial")).agg(F.max("ts").alias("moved_at"))
    cases = summaries.escalated(leads(spark, d), last, "x").withColumn("stage", casework.stage()).join(moves, "serial", "left")
    return cases, F.date_add(last, 20)


@query(MOVED + """ SELECT count(*) AS cases, count(*) FILTER (stage <> 'Completed') AS open_cases, count(*) FILTER (stage <> 'Completed' AND late > 0) AS late, round(coalesce(sum(exposure) FILTER (stage <> 'Completed' AND late > 0), 0), 2) AS late_exposure,
count(*) FILTER (stage <> 'Completed' AND moved_at IS NULL) AS never_picked_up, coalesce(max(late) FILTER (stage <> 'Completed' AND late > 0), 0)::INT AS oldest, CASE WHEN count(*) FILTER (stage <> 'Completed') > 0 AND count(*) FILTER (stage <> 'Completed' AND moved_at IS NULL)
= count(*) FILTER (stage <> 'Completed') THEN 'first day' WHEN count(*) FILTER (stage <> 'Completed' AND late > 0) = 0 THEN 'none late' ELSE 'late' END AS reading FROM cs""", SCORED)
def case_lateness(spark, d):
    """Open cases past their date, and those that nobody picked up."""
    cases, as_of = moved_cases(spark, d)
    return portfolio.lateness(cases, ("Recommended", "Sanctioned"), as_of).withColumn("late_exposure", F.round("late_exposure", 2))


@query("""+ s AS (SELECT unnest(['Recommended', 'Sanctioned', 'Under review', 'OTHER']) AS stage, unnest([1, 2, 3, 4]) AS place), c AS (SELECT CASE WHEN stage IN ('Recommended', 'Sanctioned', 'Under review') THEN stage ELSE 'OTHER' END AS stage, exposure
FROM (SELECT """ + STAGE + """ AS stage, exposure FROM scored WHERE band IN ('MEDIUM', 'HIGH')))
SELECT s.stage, place, count(c.stage) AS cases, round(coalesce(sum(exposure), 0), 2) AS exposure FROM s LEFT JOIN c USING (stage) GROUP BY 1, 2""", SCORED)
def case_stages(spark, d):
    """Cases and exposure of each stage, empty ones too."""
    cases = A.scored(spark, d).where(summaries.is_lead()).withColumn("stage", casework.stage())
    return portfolio.stage_table(cases, ("Recommended", "Sanctioned", "Under review")).withColumn("exposure", F.round("exposure", 2))


@query("""SELECT event_type AS outcome, count(*) AS records, count(DISTINCT user_id) AS works, epoch_us(min(ts)) AS first_at, epoch_us(max(ts)) AS last_at, max_by(user_id, (ts, user_id)) AS last_work FROM events GROUP BY 1""")
def field_activity(spark, d):
    """What was recorded, by outcome."""
    out = portfolio.activity(A.table(spark, d, "events"), "event_type", "user_id", "ts").withColumnRenamed("event_type", "outcome")
    return out.withColumns({c: F.unix_micros(F.col(c).cast("timestamp")) for c in ("first_at", "last_at")})


# ------------------------------------------------------------------------------------------------ payments


#: What is kept back of a line's price is the payment here, so that lines without a discount are payments of nothing.
KEPT = """WITH k0 AS (SELECT CASE WHEN l_linenumber < 7 THEN flags END AS authority, CASE WHEN l_returnflag <> 'A' OR l_linenumber > 2 THEN l_suppkey END AS vendor, l_extendedprice * l_discount AS amount FROM (SELECT *, concat(l_returnflag, l_linestatus) AS flags FROM lineitem))"""


@query(KEPT + """ SELECT CASE WHEN authority IS NULL THEN 'no authority' WHEN vendor IS NULL THEN 'no vendor' WHEN amount <= 0 THEN 'no amount' ELSE 'usable' END AS reason, count(*) AS payments, round(sum(amount), 2) AS amount FROM k0 GROUP BY 1""")
def unusable_payments(spark, d):
    """Payments that an index can't use, by the first reason."""
    line = A.table(spark, d, "lineitem")
    kept = line.select(
        F.when(F.col("l_linenumber") < 7, F.concat("l_returnflag", "l_linestatus")).alias("authority"), F.when((F.col("l_returnflag") != "A") | (F.col("l_linenumber") > 2), F.col("l_suppkey")).alias("vendor"),
        (F.col("l_extendedprice") * F.col("l_discount")).alias("amount"),
    )
    return portfolio.unusable(kept, "authority", "vendor", "amount").withColumn("amount", F.round("amount", 2))


@query(HHI + """, l AS (SELECT authority, string_agg(vendor, ',' ORDER BY place) AS listed, round(sum(paid), 2) AS listed_paid FROM k WHERE place <= 10 GROUP BY 1), t AS (SELECT authority, sum(n)::BIGINT AS payments, count(*) AS vendors, sum(paid) AS paid FROM v GROUP BY 1)
SELECT authority, payments, vendors, round(paid, 2) AS paid, listed, round(listed_paid / paid, 6) AS listed_share, CASE WHEN payments < 20 THEN 'only ' || payments || ' payments' END AS withheld FROM t JOIN l USING (authority)""", PAYMENTS)
def vendor_lists(spark, d):
    """The ten most paid vendors of each authority and their share of all."""
    out = portfolio.vendor_lists(A.payments(spark, d), "authority", "vendor", "amount")
    share = F.aggregate("listed", F.lit(0.0), lambda a, x: a + x.share)
    return out.select("authority", "payments", "vendors", r("paid", 2), F.array_join(F.transform("listed", lambda x: x.vendor.cast("string")), ",").alias("listed"), F.round(share, 6).alias("listed_share"), "withheld")


@query("""+ p2 AS (SELECT serial % 2003 AS authority, CASE WHEN serial % 5 = 0 THEN vendor ELSE vendor % 6 END AS vendor, amount FROM pay), v AS (SELECT authority, vendor, sum(amount) AS paid, count(*) AS n FROM p2 WHERE amount > 0 GROUP BY 1, 2),
h AS (SELECT authority, sum(n) AS payments, sum(paid * paid) / (sum(paid) * sum(paid)) AS x FROM v GROUP BY 1), b AS (SELECT payments, CASE WHEN payments < 20 THEN 'WITHHELD' WHEN x >= 0.25 THEN 'CONCENTRATED' WHEN x >= 0.15 THEN 'MODERATE' ELSE 'SPREAD' END AS band FROM h),
l AS (SELECT unnest(['CONCENTRATED', 'MODERATE', 'SPREAD', 'WITHHELD']) AS band) SELECT l.band, count(payments) AS authorities, coalesce(sum(payments), 0)::BIGINT AS payments FROM l LEFT JOIN b USING (band) GROUP BY 1""", PAYMENTS)
def vendor_band_counts(spark, d):
    """Authorities in each band of concentration."""
    p = A.payments(spark, d).select((F.col("serial") % 2003).cast("string").alias("authority"), F.when(F.col("serial") % 5 == 0, F.col("vendor")).otherwise(F.col("vendor") % 6).alias("vendor"), "amount")
    return portfolio.band_counts(reports.concentration(p, "authority", "vendor", "amount"))


@query("""+ g AS (SELECT l_orderkey, sum(l_extendedprice) AS own FROM lineitem GROUP BY 1), j AS (SELECT CASE WHEN o_totalprice <> 0 THEN own / o_totalprice END AS ratio FROM g JOIN orders ON l_orderkey = o_orderkey)
SELECT count(*) AS keys, count(ratio) AS compared, round(avg((abs(ratio - 1) <= 0.1)::INT), 6) AS share_within, round(quantile_cont(ratio, 0.5), 6) AS median_ratio FROM j""", WORKS)
def ratio_summary(spark, d):
    """How own sums compare with published totals over all orders."""
    published = A.table(spark, d, "orders").withColumnRenamed("o_orderkey", "l_orderkey")
    out = A.stored(canonical.reconciled(A.table(spark, d, "lineitem"), published, "l_orderkey", "l_extendedprice", "o_totalprice"))
    return portfolio.ratio_summary(out, 0.1).select("keys", "compared", r("share_within", 6), r("median_ratio", 6))


# ------------------------------------------------------------------------------------------------ files, rows and checks


@query("""WITH s AS (SELECT concat(l_returnflag, l_linestatus, '.json') AS file, l_orderkey AS id, l_linenumber % 4 AS attach, n_name AS state FROM lineitem LEFT JOIN supplier ON l_suppkey = s_suppkey LEFT JOIN nation ON s_nationkey = n_nationkey),
f AS (SELECT file, string_agg(state, ',' ORDER BY state) AS first_states FROM (SELECT file, state, row_number() OVER (PARTITION BY file ORDER BY state) AS k FROM (SELECT DISTINCT file, state FROM s WHERE state <> '')) WHERE k <= 5 GROUP BY 1)
SELECT s.file, count(*) AS rows, count(DISTINCT id) AS ids, count(DISTINCT id) FILTER (attach <> 0) AS with_attachment, count(DISTINCT state) AS states, any_value(first_states) AS first_states FROM s LEFT JOIN f USING (file) GROUP BY 1""")
def file_manifest(spark, d):
    """Rows, ids, ids with attachments and states of each file of a crawl: lines by their flags as files."""
    line, supplier, nation = (A.table(spark, d, t) for t in ("lineitem", "supplier", "nation"))
    rows = line.join(supplier, F.col("l_suppkey") == F.col("s_suppkey"), "left").join(nation, F.col("s_nationkey") == F.col("n_nationkey"), "left")
    rows = rows.select(F.concat("l_returnflag", "l_linestatus", F.lit(".json")).alias("file"), F.col("l_orderkey").alias("id"), (F.col("l_linenumber") % 4).alias("attach"), F.col("n_name").alias("state"))
    return portfolio.file_manifest(rows, "file", "id", "attach", "state").withColumn("first_states", F.array_join("first_states", ","))


@query("""WITH f AS (SELECT doc_id AS serial, CASE WHEN n_chars > 500 THEN sha256(text) END AS digest, strlen(text) AS size FROM documents), o AS (SELECT o_orderkey AS serial FROM orders)
SELECT (SELECT count(DISTINCT serial) FROM o) AS works, (SELECT count(DISTINCT serial) FROM o WHERE serial IN (SELECT serial FROM f)) AS with_files, count(*) AS files, count(digest) AS indexed, sum(size)::BIGINT AS bytes,
count(*) FILTER (serial IS NULL OR serial NOT IN (SELECT serial FROM o)) AS of_unknown_works, count(DISTINCT digest) AS contents, round((SELECT count(DISTINCT serial) FROM o WHERE serial IN (SELECT serial FROM f)) / (SELECT count(DISTINCT serial) FROM o), 6) AS covered,
round(count(digest) / count(*), 6) AS indexed_share FROM f""")
def evidence_coverage(spark, d):
    """How many works have files, and what the files hold."""
    files = A.table(spark, d, "documents").select(F.col("doc_id").alias("serial"), F.when(F.col("n_chars") > 500, F.sha2("text", 256)).alias("digest"), F.octet_length("text").alias("size"))
    out = portfolio.evidence_coverage(A.table(spark, d, "orders").select(F.col("o_orderkey").alias("serial")), files, "serial", "digest", "size")
    return out.withColumns({"covered": F.round("covered", 6), "indexed_share": F.round("indexed_share", 6)})


@query("""WITH g AS (SELECT l_partkey AS digest, count(DISTINCT l_suppkey) AS owners, count(*) AS files FROM lineitem GROUP BY 1 HAVING count(DISTINCT l_suppkey) > 1 ORDER BY 2 DESC, 3 DESC, 1 LIMIT 200),
o AS (SELECT digest, l_suppkey, row_number() OVER (PARTITION BY digest ORDER BY l_suppkey) AS k FROM (SELECT DISTINCT l_partkey AS digest, l_suppkey FROM lineitem WHERE l_partkey IN (SELECT digest FROM g)))
SELECT g.digest, owners, files, string_agg(l_suppkey, ',' ORDER BY k) AS listed FROM g JOIN o USING (digest) WHERE k <= 10 GROUP BY ALL""")
def shared_contents(spark, d):
    """Parts as contents: those that most suppliers hold, with the first of them."""
    files = A.table(spark, d, "lineitem").select(F.col("l_partkey").alias("digest"), F.col("l_suppkey").alias("owner"))
    return portfolio.shared_contents(files, "digest", "owner").withColumn("listed", F.array_join(F.transform("listed", lambda x: x.cast("string")), ","))


@query(" UNION ALL ".join(f"SELECT '{t}' AS \"table\", count(*) AS rows, max({at})::DATE::VARCHAR AS last FROM {t}" for t, at in (("orders", "o_orderdate"), ("lineitem", "l_shipdate"), ("events", "ts"))))
def table_counts(spark, d):
    """Rows and newest day of the tables that grow."""
    days = {"orders": "o_orderdate", "lineitem": "l_shipdate", "events": "ts"}
    return portfolio.table_counts({t: (A.table(spark, d, t).withColumn("day", F.col(at).cast("date")), "day") for t, at in days.items()})


@query("""WITH s AS (SELECT CASE WHEN l_linenumber < 7 THEN l_orderkey END AS k, l_returnflag = 'A' AND l_linestatus = 'F' AND l_linenumber = 1 AS summary FROM lineitem), g AS (SELECT k, count(*) FILTER (NOT summary) AS n, count(*) FILTER (summary) AS s FROM s GROUP BY 1)
SELECT 'rows' AS section, 'raw' AS reason, count(*) AS count FROM s UNION ALL SELECT 'moved', 'summary rows', count(*) FILTER (summary) FROM s UNION ALL SELECT 'moved', 'rows without a key', count(*) FILTER (k IS NULL AND NOT summary) FROM s
UNION ALL SELECT 'moved', 'collapsed into one row a work', (sum(n - 1) FILTER (k IS NOT NULL AND n > 0))::BIGINT FROM g UNION ALL SELECT 'rows', 'works', count(*) FILTER (k IS NOT NULL AND n > 0) FROM g""")
def rows_moved(spark, d):
    """What became of all lines on the way to one row an order."""
    rows = A.table(spark, d, "lineitem").withColumn("k", F.when(F.col("l_linenumber") < 7, F.col("l_orderkey")))
    return portfolio.grain_report(rows, "k", (F.col("l_returnflag") == "A") & (F.col("l_linestatus") == "F") & (F.col("l_linenumber") == 1))


@query("""WITH e AS (SELECT user_id, count(*) AS checks, date_diff('second', date_trunc('second', max(ts)), TIMESTAMP '2030-01-01 00:00:00') AS seconds FROM events GROUP BY 1) SELECT user_id, checks, seconds, row_number() OVER (ORDER BY seconds DESC, user_id) AS place FROM e""")
def scope_freshness(spark, d):
    """How long ago each user was last seen, the longest wait first."""
    return portfolio.scope_freshness(A.table(spark, d, "events"), "user_id", "ts", F.lit("2030-01-01 00:00:00"))
