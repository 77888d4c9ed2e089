"""Queries over the live feed and the ledger: what the streaming jobs keep, as batch twins with SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import adapters as A
from ..operators import changes
from .registry import FEED, query

PAY_KEY = """sha256(concat_ws('|', l_orderkey, l_suppkey, l_shipdate::DATE, regexp_replace(l_extendedprice::DECIMAL(18, 2)::VARCHAR, '^(-?\\d+)\\.0+$', '\\1')))"""


@query(f"""WITH cut AS (SELECT max(l_shipdate)::DATE - 400 AS day FROM lineitem), p AS (SELECT {PAY_KEY} AS key, l_shipdate::DATE AS day, min(l_returnflag) AS r, max(l_linestatus) AS s FROM lineitem GROUP BY 1, 2),
o AS (SELECT key, 'N' AS r, s FROM p, cut WHERE p.day <= cut.day)
SELECT p.key, 'appeared' AS change_type, NULL AS field, NULL AS old_value, NULL AS new_value FROM p WHERE key NOT IN (SELECT key FROM o)
UNION ALL SELECT p.key, 'changed', 'r', o.r, p.r FROM p JOIN o USING (key) WHERE o.r IS DISTINCT FROM p.r
UNION ALL SELECT p.key, 'changed', 's', o.s, p.s FROM p JOIN o USING (key) WHERE o.s IS DISTINCT FROM p.s""")
def payment_feed(spark, d):
    """Payments without a key of their own, by a hash of order, vendor, day and amount: the feed from an early snapshot to the whole."""
    lines = A.table(spark, d, "lineitem").withColumns({"day": F.col("l_shipdate").cast("date"), "paid": F.col("l_extendedprice").cast("decimal(18,2)")})
    p = lines.groupBy(changes.composite("l_orderkey", "l_suppkey", "day", "paid").alias("key"), "day").agg(F.min("l_returnflag").alias("r"), F.max("l_linestatus").alias("s"))
    cut = lines.select(F.date_sub(F.max("day"), 400)).scalar()
    return changes.diffed(p.where(F.col("day") <= cut).withColumn("r", F.lit("N")), p, "key", ["r", "s"])


@query("""WITH v AS (SELECT ts::DATE::VARCHAR AS run, user_id, count(*) AS seen, max_by(event_type, (ts, event_id)) AS e, max_by(json_extract_string(props, '$.k'), (ts, event_id)) AS k FROM events GROUP BY 1, 2),
o AS (SELECT *, lag(e) OVER w AS pe, lag(k) OVER w AS pk, row_number() OVER w AS n FROM v WINDOW w AS (PARTITION BY user_id ORDER BY run))
SELECT run, sum(seen)::BIGINT AS seen, count(*) AS keys, count(*) FILTER (n = 1) AS appeared, sum(CASE WHEN n > 1 THEN (e IS DISTINCT FROM pe)::INT + (k IS DISTINCT FROM pk)::INT ELSE 0 END)::BIGINT AS changed FROM o GROUP BY 1""")
def run_counters(spark, d):
    """Rows, keys, appearances and changed fields of each day's run."""
    v = A.versions(spark, d).withColumn("run", F.col("ts").cast("date").cast("string"))
    return changes.run_counters(v, "run", "user_id", ["ts", "event_id"], ["event_type", "k"])


@query(FEED + " SELECT user_id, event_id, change_type, field FROM feed WHERE user_id = (SELECT user_id FROM feed GROUP BY 1 ORDER BY count(*) DESC, user_id LIMIT 1)")
def entity_history(spark, d):
    """All changes of the entity that changed most."""
    f = A.stored(changes.feed_of(A.versions(spark, d), "user_id", ["ts", "event_id"], ["event_type", "k"]))
    most = f.groupBy("user_id").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "user_id").limit(1).select("user_id").scalar()
    return changes.history(f, "user_id", most, F.desc("ts"), F.desc("event_id")).select("user_id", "event_id", "change_type", "field")


@query("""WITH e AS (SELECT user_id, max(ts) AS t FROM events GROUP BY 1) SELECT count(*) AS scopes, date_diff('second', max(t), TIMESTAMP '2030-01-01 00:00:00') AS since_last,
date_diff('second', min(t), TIMESTAMP '2030-01-01 00:00:00') AS since_oldest FROM (SELECT date_trunc('second', t) AS t FROM e)""")
def freshness(spark, d):
    """Seconds up to a given moment since the last check, and since that of the scope that waits longest."""
    return changes.freshness(A.table(spark, d, "events"), "user_id", "ts", F.lit("2030-01-01 00:00:00"))


@query("""SELECT event_id, CASE WHEN event_type IN ('view', 'click', 'purchase') THEN sha256(concat_ws('|', event_id, user_id, event_type)) END AS row_hash,
CASE WHEN event_type IS NULL THEN 'no outcome' WHEN event_type NOT IN ('view', 'click', 'purchase') THEN 'unknown outcome: ' || event_type END AS reason FROM events""")
def ledger_entries(spark, d):
    """Entries of a known outcome with their hash, and the others with the reason against them."""
    out = changes.judged_entries(A.table(spark, d, "events"), "event_type", ("view", "click", "purchase"), ["event_id", "user_id", "event_type"])
    return out.select("event_id", F.when(F.col("reason").isNull(), F.col("row_hash")).alias("row_hash"), "reason")
