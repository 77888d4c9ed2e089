"""Quality rules by host: rule failures by domain, rates shrunk by an empirical beta prior, verdicts joined back.

DataFrame functions only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACE_CHARS, small, written

SYMBOLS = "#*$%&|<>"
WINDOW = 8


def _neighbours(array: str, f) -> Column:
    """f of each two neighbours of an array column."""
    short = F.greatest(F.size(array) - 1, F.lit(0))
    return F.zip_with(F.slice(array, F.lit(1), short), F.slice(array, F.lit(2), short), f)


def measured(docs: DataFrame, key: str = "doc_id", text: str = "text", domain: str = "source") -> DataFrame:
    """(key, domain, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed) of every row's whole text.

    ``n_repeat_words`` counts the words inside 8-word windows found twice or more in the text.  A window is known by a
    64-bit hash of its words; equal hashes are found by sorting within the row, so nothing is shuffled.
    Null and empty texts have no words and fail.  Other columns are ignored, repeated rows stay.
    """
    t = F.coalesce(F.col(text), F.lit(""))
    lines = F.filter(F.split(t, "\n"), lambda x: F.length(F.translate(x, SPACE_CHARS, "")) > 0)
    words = F.filter(F.split(F.translate(t, SPACE_CHARS, " " * len(SPACE_CHARS)), " "), lambda w: w != "")
    d = docs.select(
        F.col(key).alias("key"),
        F.col(domain).alias("domain"),
        F.length(F.translate(t, SPACE_CHARS, "")).cast("long").alias("word_chars"),
        (F.length(t) - F.length(F.translate(t, SYMBOLS, ""))).cast("long").alias("n_symbols"),
        lines.alias("lines"),
        F.transform(words, lambda w: F.xxhash64(w)).alias("h1"),
    ).withColumn("n_dup_lines", (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long")).drop("lines")
    d = d.withColumn("n_words", F.size("h1").cast("long"))
    for span in (1, 2, 4):  # hashes of 2, 4 and 8 words from two of half as many
        n = F.greatest(F.size(f"h{span}") - span, F.lit(0))
        both = F.zip_with(F.slice(f"h{span}", F.lit(1), n), F.slice(f"h{span}", F.lit(1 + span), n), lambda a, b: F.xxhash64(a, b))
        d = d.withColumn(f"h{2 * span}", both).drop(f"h{span}")
    repeats = F.size(F.array_distinct("h8")) < F.size("h8")
    d = d.withColumn("sorted", F.when(repeats, F.array_sort(F.transform("h8", lambda h, i: F.struct(h.alias("h"), i.alias("i")))))).drop("h8")
    same = F.filter(_neighbours("sorted", lambda a, b: F.when(a.h == b.h, F.array(a.i, b.i))), lambda x: x.isNotNull())
    d = d.withColumn("at", F.array_sort(F.array_distinct(F.flatten(same)))).drop("sorted")
    steps = _neighbours("at", lambda a, b: F.least(F.lit(WINDOW), b - a))
    repeated = F.when(F.size("at") > 0, F.aggregate(steps, F.lit(0), lambda a, b: a + b) + WINDOW).otherwise(0).cast("long")
    d = d.withColumn("n_repeat_words", F.coalesce(repeated, F.lit(0).cast("long"))).drop("at")
    failed = (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    return d.select(F.col("key").alias(key), "domain", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", failed.alias("base_failed"))


def host_rates(rows: DataFrame) -> DataFrame:
    """(domain, n, failed, rate): failure rates shrunk towards the overall rate by a beta prior fitted to all domains.

    The prior's mean is the overall rate; its strength comes from the variance between domains beyond what chance would
    give, by the method of moments, between 1 and 10,000 rows' worth.  Null is a domain of its own.
    """
    hosts = rows.groupBy("domain").agg(F.count("*").alias("n"), F.sum(F.col("base_failed").cast("long")).alias("failed"))
    total = hosts.agg(F.sum("n").alias("n"), F.sum("failed").alias("k"), F.count("*").alias("h"), F.sum(F.col("failed") * F.col("failed") / F.col("n")).alias("kk")).first()
    if not total["n"]:
        return hosts.withColumn("rate", F.lit(0.0))
    n, mean = float(total["n"]), float(total["k"]) / float(total["n"])
    between = float(total["kk"]) / n - mean * mean - mean * (1 - mean) * (total["h"] - 1) / n
    strength = min(max(mean * (1 - mean) / between - 1, 1.0), 1e4) if between > 1e-12 else 1e4
    return hosts.withColumn("rate", (F.col("failed") + mean * strength) / (F.col("n") + strength))


def judged(docs: DataFrame, key: str = "doc_id", text: str = "text", domain: str = "source", max_rate: float = 0.5, max_broadcast: int = 100_000) -> DataFrame:
    """``measured`` rows with the domain's shrunken ``host_rate`` and ``kept``.

    Rows that fail the base rules go, and so do all rows of domains whose rate is above ``max_rate``.  The rates are
    broadcast only if a count finds at most ``max_broadcast`` domains.
    """
    rows = written(measured(docs, key, text, domain), "measured")
    rates = host_rates(rows).select(F.col("domain").alias("_domain"), F.col("rate").alias("host_rate"))
    out = rows.join(small(written(rates, "rates"), max_broadcast), F.col("domain").eqNullSafe(F.col("_domain"))).drop("_domain")
    return out.withColumn("kept", ~F.col("base_failed") & (F.col("host_rate") <= max_rate))


ORACLE_SQL = r"""
WITH d AS (SELECT doc_id, source AS domain, coalesce(text, '') AS t FROM documents),
w AS (SELECT doc_id, domain, t, list_filter(regexp_split_to_array(t, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM d),
lines AS (
  SELECT doc_id, count(*) - count(DISTINCT l) AS n_dup_lines
  FROM (SELECT doc_id, unnest(string_split(t, chr(10))) AS l FROM d) WHERE regexp_matches(l, '[^\x20\x09-\x0D]') GROUP BY doc_id),
wins AS (
  SELECT doc_id, i, array_to_string(ws[i:i + 7], ' ') AS win
  FROM (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 6, 1))) AS i FROM w)),
hits AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, win) AS n FROM wins) WHERE n > 1),
reps AS (
  SELECT doc_id, sum(least(8, coalesce(nxt - i, 8))) AS n_repeat_words
  FROM (SELECT doc_id, i, lead(i) OVER (PARTITION BY doc_id ORDER BY i) AS nxt FROM hits) GROUP BY doc_id),
m AS (
  SELECT w.doc_id, w.domain, len(ws)::BIGINT AS n_words, length(regexp_replace(t, '[\x20\x09-\x0D]+', '', 'g'))::BIGINT AS word_chars,
    (length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols, coalesce(n_dup_lines, 0)::BIGINT AS n_dup_lines,
    coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words
  FROM w LEFT JOIN lines USING (doc_id) LEFT JOIN reps USING (doc_id)),
b AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM m),
h AS (SELECT domain, count(*) AS n, sum(base_failed::INT) AS k FROM b GROUP BY domain),
t AS (SELECT sum(n)::DOUBLE AS n, sum(k)::DOUBLE / sum(n) AS mu, count(*) AS h, sum(k * k / n::DOUBLE) AS kk FROM h),
v AS (SELECT mu, kk / n - mu * mu - mu * (1 - mu) * (h - 1) / n AS between_ FROM t),
s AS (SELECT mu, CASE WHEN between_ > 1e-12 THEN least(greatest(mu * (1 - mu) / between_ - 1, 1.0), 1e4) ELSE 1e4 END AS strength FROM v),
r AS (SELECT h.domain, (k + mu * strength) / (n + strength) AS rate FROM h, s)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND rate <= 0.5 AS kept
FROM b JOIN r ON b.domain IS NOT DISTINCT FROM r.domain
"""
