"""Fields read from text: references, amounts and near misses of keys."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import col
from ..sources.tables import settled

#: Letters that readers confuse with digits, and the digits meant.
CONFUSED, MEANT = "OoIlZSB", "0011258"
#: Words for units of rupees.
UNITS = {"crore": 1e7, "lakh": 1e5}


def references(text: Column | str) -> Column:
    """Distinct references MPn-Wn in order of appearance, any dash, confusable letters read as digits."""
    pattern = r"(?i)MP\s*([0-9OoIlZSB]+)\s*[-\x{2010}-\x{2015}]\s*W\s*([0-9OoIlZSB]+)"
    owner, serial = F.regexp_extract_all(col(text), F.lit(pattern), 1), F.regexp_extract_all(col(text), F.lit(pattern), 2)
    digits = lambda x: F.translate(x, CONFUSED, MEANT)
    return F.array_distinct(F.zip_with(owner, serial, lambda a, b: F.concat(F.lit("MP"), digits(a), F.lit("-W"), digits(b))))


def amounts(text: Column | str) -> Column:
    """Amounts in rupees, in order: numbers with thousands' commas, times lakh or crore where they say so."""
    pattern = r"(?i)(?:rs\.?|inr)\s*([0-9][0-9,]*(?:\.[0-9]+)?)\s*(crore|lakh)?"
    number, unit = F.regexp_extract_all(col(text), F.lit(pattern), 1), F.lower(F.array_join(F.regexp_extract_all(col(text), F.lit(pattern), 2), "|"))
    factor = lambda u: F.when(u == "crore", UNITS["crore"]).when(u == "lakh", UNITS["lakh"]).otherwise(1.0)
    return F.zip_with(number, F.split(unit, r"\|"), lambda n, u: F.translate(n, ",", "").cast("double") * factor(u))


def near_misses(df: DataFrame, key: str, known: DataFrame, known_key: str, rounds: int = 1) -> DataFrame:
    """(key, match): known keys that differ from an unknown one in exactly one digit, each pair once.

    Keys that differ in one place alone agree in the place and in the rest.  So every key names its rests, one a digit, and for each rest
    the digits asked for and known are two sets of bits: one aggregate without a join, a row a digit, and of copies nothing is left.
    With ``rounds`` the places are dealt over as many such aggregates, each stored before the next, so that less is shuffled at a time.
    """
    if rounds > 1:
        parts = [settled(df.sparkSession, lambda at=at: _near_misses(df, key, known, known_key, F.col("_i") % rounds == at)) for at in range(rounds)]
        return reduce(DataFrame.unionByName, parts)
    return _near_misses(df, key, known, known_key, F.lit(True))


def _near_misses(df: DataFrame, key: str, known: DataFrame, known_key: str, wanted: Column) -> DataFrame:
    """As ``near_misses``, of the ``wanted`` places ``_i`` alone."""

    def rests(d: DataFrame, name: str, put: str) -> DataFrame:
        each = d.select(F.col(name).alias("_k")).where(F.length("_k") > 0).select("_k", F.explode(F.sequence(F.lit(1), F.length("_k"))).alias("_i"))
        digit = F.substr("_k", "_i", F.lit(1))
        each = each.where(wanted & digit.between("0", "9"))
        bit = F.call_function("shiftleft", F.lit(1), digit.cast("int"))
        rest = F.concat(F.substr("_k", F.lit(1), F.col("_i") - 1), F.substr("_k", F.col("_i") + 1))
        return each.select("_i", rest.alias("_rest"), *[(bit if c == put else F.lit(0)).alias(c) for c in ("_asked", "_known")])

    both = rests(df, key, "_asked").unionByName(rests(known, known_key, "_known"))
    found = both.groupBy("_i", "_rest").agg(F.bit_or("_asked").alias("_asked"), F.bit_or("_known").alias("_known")).where("_asked <> 0 AND _known <> 0 AND (_asked <> _known OR bit_count(_known) > 1)")
    digits = lambda c: F.expr(f"explode(filter(sequence(0, 9), d -> ({c} & shiftleft(1, d)) <> 0))")
    pairs = found.select("_i", "_rest", "_known", digits("_asked").alias("_a")).select("_i", "_rest", "_a", digits("_known").alias("_b")).where("_a <> _b")
    whole = lambda d: F.concat(F.substr("_rest", F.lit(1), F.col("_i") - 1), F.col(d).cast("string"), F.substr("_rest", F.col("_i")))
    return pairs.select(whole("_a").alias("key"), whole("_b").alias("match"))
