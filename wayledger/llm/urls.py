"""URL filtering by host rules and, where none fits, by the ratio of two character language models.

DataFrame functions only.  The models are variable-order Markov models of accepted and of rejected URLs: a character's
probability mixes the counts after the longest contexts seen with those after shorter ones.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W

from .common import written

START, END = "\x02", "\x03"
MICRO = 1_000_000  # contributions are whole millionths of a nat, so that sums don't depend on their order
ALLOW, BLOCK = "allow", "block"


def parsed(pages: DataFrame, url: str = "url") -> DataFrame:
    """``pages`` with host and path: host after the first ``://`` up to / ? # or the end, ASCII lower-cased; path then up to ? or #."""
    u = F.coalesce(F.col(url), F.lit(""))
    at = F.instr(u, "://")
    rest = F.when(at > 0, F.substr(u, at + 3)).otherwise("")
    host = F.translate(F.regexp_extract(rest, r"^([^/?#]*)", 1), string.ascii_uppercase, string.ascii_lowercase)
    return pages.withColumns({"host": host, "path": F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)})


def rule_of(rules: list[tuple[str, str]]) -> tuple[Column, Column]:
    """(rule, verdict) columns over host and path: the longest of the rules (``host/path``, verdict) that fits, else null.

    A rule fits its host and its subdomains where the path starts with the rule's.  The rules, a short list, are part of
    the plan.
    """
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for name, says in sorted(rules, key=lambda r: len(r[0])):  # the longest is tested first
        host, slash, path = name.partition("/")
        fits = ((F.col("host") == host) | F.col("host").endswith("." + host)) & F.col("path").startswith(slash + path)
        rule, verdict = F.when(fits, name).otherwise(rule), F.when(fits, says).otherwise(verdict)
    return rule, verdict


def grams(urls: DataFrame, order: int) -> DataFrame:
    """Every substring ``g`` of up to ``order`` characters of each ``u`` between a start and an end mark."""
    marked = F.concat(F.lit(START), F.col("u"), F.lit(END))
    at = urls.withColumn("m", marked).withColumn("i", F.explode(F.sequence(F.lit(1), F.length("m"))))
    pieces = [F.when(F.length("m") - F.col("i") + 1 >= n, F.substr("m", "i", F.lit(n))) for n in range(1, order + 1)]
    return at.select(*[c for c in urls.columns if c != "u"], "u", F.explode(F.array_compact(F.array(*pieces))).alias("g"))


def model(labelled: DataFrame, order: int = 4, prior: float = 8.0, hot_per_order: int = 50_000, alphabet: int = 256, seen: int = 2) -> DataFrame:
    """(g, value, hot) from (u, accepted): what each occurrence of ``g`` adds to a URL's log-likelihood difference, in micronats.

    P(c | x) = (n(xc) + prior P(c | x without its first character)) / (n(x) + prior), down to even chances.  Every substring
    met ``seen`` times is kept (1: every one), so the table grows with the input; ``hot`` are those that make up at least one in
    ``hot_per_order`` of their length's occurrences, so at most ``order`` x ``hot_per_order``.  Where a kept context is followed by a
    character not kept after it, the shorter context decides; the terms are arranged so that a URL's score is one sum.
    """
    counts = grams(labelled, order).groupBy("g").agg(F.count_if("accepted").alias("a"), F.count_if(~F.col("accepted")).alias("r")).withColumn("n", F.length("g"))
    counts = written(counts, "url-grams")
    sizes = {r.n: (r.a, r.r) for r in counts.where(F.col("g") != START).groupBy("n").agg(F.sum("a").alias("a"), F.sum("r").alias("r")).collect()}
    least = F.coalesce(*[F.when(F.col("n") == n, F.lit(sum(s) / hot_per_order)) for n, s in sizes.items()], F.lit(0.0))
    kept = counts.where(F.col("a") + F.col("r") >= seen).withColumn("hot", F.col("a") + F.col("r") >= least)
    na, nr = sizes.get(1, (0, 0))
    even = prior / alphabet
    back = F.when(F.col("g").endswith(END), 0.0).otherwise(F.log(F.col("r") + prior) - F.log(F.col("a") + prior))
    kept = kept.withColumn("back", back)
    level = kept.where("n = 1").select("g", "a", "r", "back", "hot", ((F.col("a") + even) / (na + prior)).alias("pa"), ((F.col("r") + even) / (nr + prior)).alias("pr"))
    own = F.when(F.col("g") == START, 0.0).otherwise(F.log("pa") - F.log("pr"))
    level = written(level.withColumn("delta", own), "url-model")
    out = level
    for n in range(2, order + 1):
        shorter = level.select(F.col("g").alias("tail"), F.col("pa").alias("qa"), F.col("pr").alias("qr"))
        context = level.select(F.col("g").alias("head"), F.col("a").alias("ca"), F.col("r").alias("cr"), F.col("back").alias("behind"))
        grown = kept.where(F.col("n") == n).withColumns({"tail": F.substring("g", 2, n), "head": F.substring("g", 1, n - 1)})
        grown = grown.join(shorter, "tail").join(context, "head")
        pa, pr = (F.col("a") + prior * F.col("qa")) / (F.col("ca") + prior), (F.col("r") + prior * F.col("qr")) / (F.col("cr") + prior)
        grown = grown.withColumns({"pa": pa, "pr": pr})
        delta = F.log("pa") - F.log("pr") - (F.log("qa") - F.log("qr")) - F.col("behind")
        level = written(grown.withColumn("delta", delta).select(*out.columns), "url-model")
        out = out.unionByName(level)
    behind = F.when(F.length("g") < order, F.col("back")).otherwise(0.0)  # the longest substrings are no contexts
    return out.select("g", F.round((F.col("delta") + behind) * MICRO).cast("long").alias("value"), "hot")


def scored(urls: DataFrame, values: DataFrame, order: int = 4) -> DataFrame:
    """(u, score): the mean log-likelihood difference a character, in nats, of the distinct ``u``; above 0 likelier accepted.

    The hot part of the model is broadcast, its size is bounded by construction; other substrings meet theirs in a shuffle.
    """
    # few bytes become many rows, so the number of tasks is set here instead of by the bytes shuffled
    tasks = int(urls.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    once = written(urls.select("u").repartition(tasks, "u").distinct().withColumn("id", F.monotonically_increasing_id()), "urls")
    hot, other = F.broadcast(values.where("hot").select("g", F.col("value").alias("known"))), values.where("not hot").select("g", "value")
    looked = grams(once.repartition(tasks, "id"), order).select("id", "g").join(hot, "g", "left")
    known = looked.groupBy("id").agg(F.coalesce(F.sum("known"), F.lit(0)).alias("value"))
    rest = looked.where("known is null").select("id", "g").join(other, "g").groupBy("id").agg(F.sum("value").alias("value"))
    total = known.unionByName(rest).groupBy("id").agg(F.sum("value").alias("total")).join(once, "id")
    return total.select("u", (F.col("total") / MICRO / (F.length("u") + 1)).alias("score"))


def calibrated_cut(scores: DataFrame, step: float = 0.001) -> float:
    """The score, in steps, from which accepting makes the mean of both classes' hit rates largest; 0 if a class is missing.

    It lies midway between that step and the next lower one with a score; of equally good steps the lowest counts.
    """
    bins = scores.groupBy(F.floor(F.col("score") / step).alias("bin")).agg(F.count_if("accepted").alias("a"), F.count_if(~F.col("accepted")).alias("r"))
    below = W.Window.orderBy("bin").rowsBetween(W.Window.unboundedPreceding, -1)
    everything = W.Window.partitionBy()
    ranked = bins.select(
        "bin",
        (F.sum("a").over(everything) - F.coalesce(F.sum("a").over(below), F.lit(0))).alias("kept"),
        F.coalesce(F.sum("r").over(below), F.lit(0)).alias("gone"),
        F.sum("a").over(everything).alias("na"),
        F.sum("r").over(everything).alias("nr"),
        F.coalesce(F.lag("bin").over(W.Window.orderBy("bin")), "bin").alias("lower"),
    ).where("na > 0 and nr > 0")
    best = ranked.withColumn("good", F.col("kept") / F.col("na") + F.col("gone") / F.col("nr")).orderBy(F.desc("good"), "bin").first()
    return (best.bin + best.lower) / 2 * step if best else 0.0


def judged(pages: DataFrame, rules: list[tuple[str, str]], key: str = "page_id", url: str = "url", order: int = 4, learn: Column | None = None) -> DataFrame:
    """(key, host, path, rule, verdict, score) of every page.

    URLs that a rule decides are the models' accepted and rejected examples: four fifths of them, by the URL's md5, are
    learnt from and the rest set the threshold.  All other URLs are allowed if their score is at or above it.  Null URLs
    count as empty: no host, no path, and the score of an empty text.  Where the rules give no example of a verdict, the
    threshold is 0.  Repeated rows stay; other columns are ignored.
    """
    rule, says = rule_of(rules)
    rows = parsed(pages.select(F.col(key).alias("key"), F.lower(F.coalesce(F.col(url), F.lit(""))).alias("u"), F.col(url).alias("_url")), "_url")
    rows = written(rows.select("key", "u", "host", "path", rule.alias("rule"), says.alias("says")), "pages")
    examples = rows.where("says is not null").select("u", (F.col("says") == ALLOW).alias("accepted"))
    fifth = F.conv(F.substring(F.md5(F.col("u").cast("binary")), 1, 8), 16, 10).cast("long") % 5
    values = written(model(examples.where(fifth != 0), order), "url-values")
    scores = written(scored(rows, values, order), "url-scores")
    cut = calibrated_cut(examples.where(fifth == 0).join(scores, "u"))
    verdict = F.coalesce("says", F.when(F.col("score") >= cut, ALLOW).otherwise(BLOCK))
    return rows.join(scores, "u").select(F.col("key").alias(key), "host", "path", "rule", verdict.alias("verdict"), "score")


ORACLE_SQL = r"""
WITH p0 AS (SELECT page_id, coalesce(url, '') AS url FROM pages),
p1 AS (SELECT page_id, lower(url) AS u, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM p0),
p2 AS (
  SELECT page_id, u, translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM p1),
p AS (
  SELECT *, CASE
    WHEN (host = 'example.net' OR ends_with(host, '.example.net')) AND starts_with(path, '/en/') THEN 'example.net/en/'
    WHEN (host = 'example.com' OR ends_with(host, '.example.com')) AND starts_with(path, '/de/') THEN 'example.com/de/'
    WHEN (host = 'org' OR ends_with(host, '.org')) AND starts_with(path, '/fr/') THEN 'org/fr/'
    WHEN (host = 'net' OR ends_with(host, '.net')) AND starts_with(path, '/') THEN 'net/' END AS rule
  FROM p2),
e AS (
  SELECT u, rule IN ('example.net/en/', 'org/fr/') AS ok, ('0x' || substr(md5(u), 1, 8))::BIGINT % 5 AS fifth FROM p WHERE rule IS NOT NULL),
lm AS (SELECT u, ok, chr(2) || u || chr(3) AS m FROM e WHERE fifth <> 0),
lg AS (
  SELECT ok, substr(m, i, n) AS g, n
  FROM (SELECT ok, m, unnest(range(1, length(m) + 1)) AS i FROM lm), (SELECT unnest(range(1, 5)) AS n) WHERE length(m) - i + 1 >= n),
c AS (SELECT g, n, count(*) FILTER (ok) AS a, count(*) FILTER (NOT ok) AS r FROM lg GROUP BY g, n),
sz AS (SELECT n, sum(a)::DOUBLE AS a, sum(r)::DOUBLE AS r FROM c WHERE g <> chr(2) GROUP BY n),
k AS (
  SELECT c.*, CASE WHEN ends_with(g, chr(3)) THEN 0.0 ELSE ln(c.r + 8.0) - ln(c.a + 8.0) END AS back
  FROM c WHERE c.a + c.r >= 2),
l1 AS (
  SELECT g, k.a, k.r, back, (k.a + 0.03125) / (sz.a + 8.0) AS pa, (k.r + 0.03125) / (sz.r + 8.0) AS pr,
    CASE WHEN g = chr(2) THEN 0.0 ELSE ln((k.a + 0.03125) / (sz.a + 8.0)) - ln((k.r + 0.03125) / (sz.r + 8.0)) END AS delta
  FROM k JOIN sz USING (n) WHERE n = 1),
LEVELS
m AS (SELECT g, round((delta + CASE WHEN length(g) < 4 THEN back ELSE 0.0 END) * 1000000)::BIGINT AS v FROM (SELECT * FROM l1 UNION ALL SELECT * FROM l2 UNION ALL SELECT * FROM l3 UNION ALL SELECT * FROM l4)),
us AS (SELECT DISTINCT u, chr(2) || u || chr(3) AS t FROM p),
ug AS (
  SELECT u, substr(t, i, n) AS g
  FROM (SELECT u, t, unnest(range(1, length(t) + 1)) AS i FROM us), (SELECT unnest(range(1, 5)) AS n) WHERE length(t) - i + 1 >= n),
s AS (SELECT u, coalesce(sum(v), 0)::DOUBLE / 1000000 / (length(u) + 1) AS score FROM ug LEFT JOIN m USING (g) GROUP BY u),
b AS (SELECT floor(score / 0.001) AS bin, count(*) FILTER (ok) AS a, count(*) FILTER (NOT ok) AS r FROM e JOIN s USING (u) WHERE fifth = 0 GROUP BY 1),
w AS (
  SELECT bin, sum(a) OVER () - coalesce(sum(a) OVER o, 0) AS kept, coalesce(sum(r) OVER o, 0) AS gone, sum(a) OVER () AS na, sum(r) OVER () AS nr,
    coalesce(lag(bin) OVER (ORDER BY bin), bin) AS lower
  FROM b WINDOW o AS (ORDER BY bin ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
cut AS (
  SELECT coalesce((SELECT (bin + lower) / 2 * 0.001 FROM w WHERE na > 0 AND nr > 0 ORDER BY kept / na::DOUBLE + gone / nr::DOUBLE DESC, bin LIMIT 1), 0.0) AS cut)
SELECT page_id, host, path, rule, CASE WHEN rule IN ('example.net/en/', 'org/fr/') THEN 'allow' WHEN rule IS NOT NULL THEN 'block'
  WHEN score >= cut THEN 'allow' ELSE 'block' END AS verdict, score
FROM p JOIN s USING (u), cut
""".replace(
    "LEVELS",
    "\n".join(
        f"""g{n} AS (
  SELECT k.g, k.a, k.r, k.back, (k.a + 8.0 * t.pa) / (h.a + 8.0) AS pa, (k.r + 8.0 * t.pr) / (h.r + 8.0) AS pr, t.pa AS qa, t.pr AS qr, h.back AS behind
  FROM k JOIN l{n - 1} t ON t.g = substr(k.g, 2) JOIN l{n - 1} h ON h.g = substr(k.g, 1, {n - 1}) WHERE k.n = {n}),
l{n} AS (SELECT g, a, r, back, pa, pr, ln(pa) - ln(pr) - (ln(qa) - ln(qr)) - behind AS delta FROM g{n}),"""
        for n in (2, 3, 4)
    ),
)
