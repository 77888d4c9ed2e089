"""Column expressions that several operators share.  All are built-in functions underneath."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..config import DEFAULT, Thresholds


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def parsed_date(c: Column | str, *formats: str) -> Column:
    """The first format that fits a text, as a date; null where none does."""
    return F.coalesce(*[F.try_to_timestamp(col(c), F.lit(f)).cast("date") for f in formats or ("dd-MMM-yyyy",)])


def parsed_amount(c: Column | str) -> Column:
    """Digits and the dot of a text as a number; null where there is none or more than one dot."""
    digits = F.regexp_replace(col(c), r"[^0-9.]", "")
    return F.when(digits.rlike(r"^(\d+\.?\d*|\.\d+)$"), digits.cast("double"))


def parsed_flag(c: Column | str) -> Column:
    """true and false in any case, with white space around; anything else is null."""
    t = F.lower(F.trim(col(c)))
    return F.when(t == "true", True).when(t == "false", False)


def whole_number(c: Column | str) -> Column:
    """A text rounded to a whole number; null where it is none."""
    return F.round(col(c).try_cast("double")).cast("long")


def surrogate(prefix: str, owner: Column | str, serial: Column | str) -> Column:
    """``prefix`` owner -W serial; null without a serial."""
    return F.when(col(serial).isNotNull(), F.concat(F.lit(prefix), col(owner).cast("string"), F.lit("-W"), col(serial).cast("string")))


def ratio(a: Column | str, b: Column | str) -> Column:
    """a / b, null where b is 0 or null."""
    return F.when(col(b) != 0, col(a) / col(b))


def clipped(c: Column | str, low: float, high: float) -> Column:
    return F.least(F.greatest(col(c), F.lit(low)), F.lit(high))


def share(condition: Column) -> Column:
    """The share of rows for which a condition holds; null counts as no."""
    return F.avg(F.coalesce(condition, F.lit(False)).cast("double"))


def flattened(c: Column | str, most: int | None = None) -> Column:
    """Runs of white space as one space; beyond ``most`` characters cut, with an ellipsis."""
    t = F.trim(F.regexp_replace(col(c), r"\s+", " "))
    return t if most is None else F.when(F.length(t) > most, F.concat(F.substring(t, 1, most - 1), F.lit("…"))).otherwise(t)


def printed(c: Column | str, places: int = 0) -> Column:
    """A double with so many places (3 at most) as C's printf has it: by its exact value, exact ties to the even digit.

    Java's formatter rounds the shortest decimal that names the double, half up.  Here twice the value in units of the last
    place is two doubles without an error: the value is split in halves of 26 bits, whose products and sum leave no rest.
    """
    x, unit = col(c).cast("double"), 10**places
    of = F.abs(x)
    high = of * 134217729.0 - (of * 134217729.0 - of)
    p, q = high * (2.0 * unit), (of - high) * (2.0 * unit)
    twice = p + q
    back = twice - p
    rest = (p - (twice - back)) + (q - back)
    half, odd = F.floor(twice / 2), twice % 2 == 1
    units = F.when(odd & (rest < 0), half).when(odd & (rest > 0), half + 1).otherwise(F.rint(twice / 2)).cast("long")
    whole = F.floor(units / unit).cast("string")
    text = F.concat(whole, F.lit("."), F.lpad((units % unit).cast("string"), places, "0")) if places else whole
    exact = F.concat(F.when(x < 0, "-").otherwise(""), text)
    return F.when(of < 1e12, exact).when(x.isNotNull(), F.format_string(f"%.{places}f", x))


def money(c: Column | str) -> Column:
    """Rupees in crore or lakh with two places, or whole."""
    x = col(c)
    return F.when(x >= 1e7, F.concat(printed(x / 1e7, 2), F.lit(" crore"))).when(x >= 1e5, F.concat(printed(x / 1e5, 2), F.lit(" lakh"))).otherwise(printed(x))


def duplicate_class(similarity: Column | str, t: Thresholds = DEFAULT) -> Column:
    out = F.lit("NORMAL")
    for name, least in reversed(t.duplicate_classes):
        out = F.when(col(similarity) >= least, name).otherwise(out)
    return out


def wilson(successes: Column | str, trials: Column | str, t: Thresholds = DEFAULT) -> tuple[Column, Column]:
    """Lower and upper end of the score interval, clamped to [0, 1]; (0, 1) without a trial."""
    n, z = col(trials).cast("double"), t.z
    p = col(successes) / n
    middle = (p + z * z / (2 * n)) / (1 + z * z / n)
    half = z * F.sqrt(p * (1 - p) / n + z * z / (4 * n * n)) / (1 + z * z / n)
    some = n > 0
    return F.when(some, F.greatest(middle - half, F.lit(0.0))).otherwise(0.0), F.when(some, F.least(middle + half, F.lit(1.0))).otherwise(1.0)


def cosine(a: Column | str, b: Column | str) -> Column:
    """Cosine of two vectors of doubles; a norm below 1e-9 counts as 1e-9."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    norm = lambda x: F.greatest(F.sqrt(dot(x, x)), F.lit(1e-9))
    return dot(col(a), col(b)) / (norm(col(a)) * norm(col(b)))


def hamming(a: Column | str, b: Column | str) -> Column:
    """Differing bits of two 64-bit longs."""
    return F.bit_count(col(a).bitwiseXOR(col(b)))
