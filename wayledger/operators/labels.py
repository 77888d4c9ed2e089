"""Terms that tell clusters of texts apart, and readable labels made of them."""

from __future__ import annotations

from pyspark.ml.feature import NGram, RegexTokenizer, StopWordsRemover
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W

# Words that carry no kind of work; translations; spellings; words too weak to stand alone.
GLUE = (
    "ke", "ki", "ka", "ko", "se", "me", "mein", "par", "aur", "hai", "tak", "ke liye", "liye", "wale", "wali", "vala", "vali", "yah", "vah", "is", "us", "jo", "ho", "kar",
    "karne", "hetu", "evam", "tatha", "sthit", "lai", "lai ki", "che", "chi", "cha", "ek", "do", "pas", "pass", "wala", "tha", "ki sthapana", "ke pas", "pas ek",
    "nu", "ni", "no", "na", "game", "thi", "mate", "ane",
    "work", "works", "new", "old", "various", "etc", "nos", "shri", "smt", "district", "block", "area", "place", "side", "front", "back", "upto",
    "from", "to", "at", "in", "of", "the", "and", "for", "with", "const", "ward", "near", "house",
)
GLOSS = {
    "nirman": "construction", "ka nirman": "construction", "sthapana": "installation", "ki sthapana": "installation", "marg": "road", "sadak": "road", "rasta": "road", "ghar": "house",
    "ke ghar": "house", "makan": "house", "ke makan": "house", "bhavan": "building", "mandir": "temple", "vidyalaya": "school", "shauchalaya": "toilet", "samudayik": "community",
    "chabutaro": "bird feeder", "smashan": "crematorium", "kabristan": "graveyard", "talab": "pond", "naali": "drain", "nali": "drain", "pulia": "culvert", "boring": "borewell",
    "prakash": "lighting", "vyayamshala": "gym", "mandap": "hall", "kalyan mandap": "community hall", "rungmanch": "stage", "manch": "stage",
}
PLACES = ("gram", "panchayat", "anganwadi", "sthal", "chowk", "tola", "nagar", "puram")
WEAK = ("construction", "installation", "purchase", "repair", "providing", "village", "gp", "panchayat", "gram", "public", "gram panchayat")
PRETTY = {"cc": "CC", "cc road": "CC road", "rcc": "RCC", "led": "LED", "gp": "gram panchayat", "pcc": "PCC"}


def cluster_terms(df: DataFrame, cluster: str, text: str, top: int = 8, grams: int = 2, min_clusters: int = 3, stop: list[str] | None = None, most: int = 5000) -> DataFrame:
    """(cluster, place, term, weight): runs of up to ``grams`` words, by count x (ln((1 + n) / (1 + clusters with it)) + 1).

    Words have two letters or digits at least and are lower-cased; stop words (the usual English ones if not given) go before
    runs are made.  Only terms in ``min_clusters`` clusters count, of these the ``most`` commonest; a cluster's weights are
    scaled to a sum of squares of 1.  Null clusters and texts are left out.  Counts meet in partial aggregates by term.
    """
    rows = df.where(F.col(cluster).isNotNull() & F.col(text).isNotNull()).select(F.col(cluster).alias("_c"), F.col(text).alias("_t"))
    words = RegexTokenizer(inputCol="_t", outputCol="_w", gaps=False, pattern=r"[\p{L}\p{N}]{2,}").transform(rows)
    words = StopWordsRemover(inputCol="_w", outputCol="_1", **({} if stop is None else {"stopWords": stop})).transform(words)
    for n in range(2, grams + 1):
        words = NGram(n=n, inputCol="_1", outputCol=f"_{n}").transform(words)
    counts = words.select("_c", F.explode(F.concat(*[f"_{n}" for n in range(1, grams + 1)])).alias("term")).groupBy("_c", "term").agg(F.count("*").alias("n"))
    spread = counts.groupBy("term").agg(F.count("*").alias("df"), F.sum("n").alias("total")).where(F.col("df") >= min_clusters)
    known = spread.orderBy(F.desc("total"), "term").limit(most)
    k = rows.select(F.countDistinct("_c")).scalar()
    weight = F.col("n") * (F.log((1 + k) / (1 + F.col("df"))) + 1)
    weighed = counts.join(known, "term").withColumn("w", weight)
    norm = weighed.groupBy("_c").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))
    scaled = weighed.join(norm, "_c").withColumn("weight", F.col("w") / F.col("norm"))
    place = F.row_number().over(W.Window.partitionBy("_c").orderBy(F.desc(F.round("weight", 9)), "term"))
    return scaled.withColumn("place", place).where(F.col("place") <= top).select(F.col("_c").alias(cluster), "place", "term", "weight")


def labelled(catalogue: DataFrame, terms: str, parts: int = 3, glue=GLUE, gloss=None, pretty=None, weak=WEAK, places=PLACES, foreign: float = 0.55) -> DataFrame:
    """The catalogue (a row a cluster) with ``label``, ``interpretable``, ``language_share`` and ``note`` from its ranked ``terms``.

    Terms are translated, stripped of glue words and of repeats, and those inside a longer one are dropped.  The label is the
    first ``parts``, such as can stand alone before the others; without any the cluster is called uninterpretable.
    """
    gloss, pretty = GLOSS if gloss is None else gloss, PRETTY if pretty is None else pretty
    mapped = lambda d: F.create_map(*[F.lit(x) for kv in d.items() for x in kv]) if d else F.create_map().cast("map<string,string>")
    names, spelt = mapped(gloss), mapped(pretty)
    filler, marks = list(glue), sorted({*gloss, *places, *glue})
    split = lambda t: F.split(t, " ")

    def clean(t: Column) -> Column:
        t = F.regexp_replace(F.lower(F.trim(t)), r"\s+", " ")
        words = F.transform(F.filter(split(t), lambda w: ~w.isin(*filler)), lambda w: F.coalesce(F.try_element_at(names, w), w))
        whole = F.array_join(F.array_distinct(words), " ")
        other = F.coalesce(F.try_element_at(spelt, whole), F.when(whole != "", whole), t)
        return F.coalesce(F.try_element_at(names, t), other)

    words = F.flatten(F.transform(terms, split))
    share = F.when(F.size(words) > 0, F.size(F.filter(words, lambda w: w.isin(*marks))) / F.size(words)).otherwise(0.0)
    d = catalogue.withColumn("language_share", share)
    d = d.withColumn("_clean", F.filter(F.array_distinct(F.transform(terms, clean)), lambda t: (t != "") & F.exists(split(t), lambda w: ~w.isin(*filler))))
    inside = lambda t, o: (F.length(o) > F.length(t)) & F.contains(F.concat(F.lit(" "), o, F.lit(" ")), F.concat(F.lit(" "), t, F.lit(" ")))
    d = d.withColumn("_own", F.filter("_clean", lambda t: ~F.exists("_clean", lambda o: inside(t, o))))
    d = d.withColumn("_strong", F.filter("_own", lambda t: ~t.isin(*weak)))
    chosen = F.array_join(F.slice(F.array_union(F.slice("_strong", 1, parts), F.array_union("_strong", "_own")), 1, parts), " · ")
    hint = F.array_join(F.slice("_own", 1, 2), " · ")
    none = F.when(hint != "", F.concat(F.lit("Mixed / uninterpretable ("), hint, F.lit(")"))).otherwise("Mixed / uninterpretable")
    good = F.size("_strong") > 0
    label = F.when(good, F.concat(F.upper(F.substring(chosen, 1, 1)), F.expr("substring(_l, 2)"))).otherwise(none)
    note = F.when(F.col("language_share") >= foreign, "grouped partly by language").when(~good, "no term names a kind of work").otherwise("")
    out = d.withColumn("_l", chosen).withColumns({"label": label, "interpretable": good, "note": note})
    return out.drop("_clean", "_own", "_strong", "_l")
