"""Column functions on text. All stay in the JVM; offsets are 0-based and in code points."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def strip(c: Column | str) -> Column:
    """Without outer white space of any kind (SQL trim takes only spaces)."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def blank_to_null(c: Column) -> Column:
    """Null for empty text, so that coalesce takes the first non-empty value."""
    return F.when(c != "", c)


def first_filled(*cs: Column) -> Column:
    """The first of the columns that is neither null nor empty."""
    return F.coalesce(*[blank_to_null(c) for c in cs])


def words(c: Column | str) -> Column:
    """Runs of non-space characters in order; null for null."""
    return F.regexp_extract_all(c, F.lit(r"\S+"), F.lit(0))


def offsets(text: Column, needle: Column) -> Column:
    """All start offsets of needle in text, overlapping ones too; empty for an empty or longer needle, null for nulls.

    Jumps from one occurrence to the next with ``locate``; once none is left the remaining steps only pass the
    result on, so the cost is that of the searches.
    """
    n = F.length(text) - F.length(needle) + 1
    start = F.expr("named_struct('at', 0, 'out', cast(array() as array<int>))")

    def step(acc: Column, _: Column) -> Column:
        at = F.position(needle, text, acc["at"] + 1)
        found = F.struct(at.alias("at"), F.array_append(acc["out"], at - 1).alias("out"))
        return F.when(acc["at"] < 0, acc).when(at > 0, found).otherwise(F.struct(F.lit(-1).alias("at"), acc["out"].alias("out")))

    walked = F.aggregate(F.sequence(F.lit(1), n + 1), start, step)["out"]
    found = F.when((F.length(needle) > 0) & (n > 0) & text.contains(needle), walked).otherwise(F.array().cast("array<int>"))
    return F.when(text.isNotNull() & needle.isNotNull(), found)


def extract(c: Column | str, pattern: str, group: int = 1) -> Column:
    """The group of the first match, or null without one (regexp_extract gives '')."""
    col = F.col(c) if isinstance(c, str) else c
    return F.when(col.rlike(pattern), F.regexp_extract(col, pattern, group))


def alnum_count(c: Column) -> Column:
    """The number of ASCII letters and digits; null for null."""
    return F.regexp_count(c, F.lit("[A-Za-z0-9]"))


def to_int(c: Column) -> Column:
    """A whole number: of text one that is written as such, of a number what it is without its fraction; null otherwise."""
    return c.try_cast("int")


def title_case(c: Column) -> Column:
    """Underscores as spaces, each word capitalised."""
    return F.initcap(F.replace(c, F.lit("_"), F.lit(" ")))


def pretty(c: Column, names: dict[str, str]) -> Column:
    """The name listed for a value, else the value in title case."""
    listed = F.coalesce(*[F.when(c == k, F.lit(v)) for k, v in names.items()]) if names else F.lit(None).cast("string")
    return F.coalesce(listed, title_case(c))


def is_missing(c: Column) -> Column:
    """Null, NaN, or one of the usual spellings of no value."""
    return c.isNull() | F.lower(strip(c.cast("string"))).isin("", "nan", "none", "null", "n/a", "na")


def to_boolean(c: Column) -> Column:
    """true/1/yes and false/0/no in any case; anything else is null."""
    v = F.lower(strip(c.cast("string")))
    return F.when(v.isin("true", "1", "yes"), True).when(v.isin("false", "0", "no"), False)


def seeded_order(seed: int, *cs: str) -> Column:
    """A random order that every engine reproduces: the md5 of the seed and the key."""
    return F.md5(F.concat_ws("|", F.lit(str(seed)), *[F.col(c).cast("string") for c in cs]))


def parse_date(c: Column) -> Column:
    """A date in one of several common spellings, month before day where both fit, names of months in any case; null otherwise."""
    formats = ("yyyy-MM-dd", "M/d/yyyy", "d/M/yyyy", "yyyy/M/d", "M-d-yyyy", "d-MMM-yyyy")
    return F.coalesce(*[F.try_to_timestamp(F.initcap(c) if "MMM" in f else c, F.lit(f)).cast("date") for f in formats])


def iso_timestamp(c: Column) -> Column:
    """A timestamp as text, with a T between date and time and microseconds only where it has some; null for null."""
    whole = F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss")
    return F.when(F.date_format(c, "SSSSSS") == "000000", whole).otherwise(F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"))


def age_at(c: Column, day: str = "2024-01-01") -> Column:
    """Years from a spelled date of birth to a day, null outside (0, 130)."""
    age = F.datediff(F.lit(day).cast("date"), parse_date(c)) / 365.25
    return F.when((age > 0) & (age < 130), age)
