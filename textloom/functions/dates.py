"""Date phrases: an ordered set of patterns, the first that matches wins."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

MONTHS = {m: i for i, m in enumerate("january february march april may june july august september october november december".split(), 1)}
_MONTH = "|".join([*MONTHS, *(m[:3] for m in MONTHS), "sept"])
_DAYS = "|".join(d for w in ("monday", "tuesday", "wednesday", "thursday", "friday", "saturday", "sunday") for d in (w, w[:3]))
#: pattern, and which group is year, month, day (0: none)
GRAMMAR = (
    (r"\b([0-9]{4})-([0-9]{1,2})-([0-9]{1,2})\b", 1, 2, 3),
    (r"\b([0-9]{1,2})[/-]([0-9]{1,2})[/-]([0-9]{2,4})\b", 3, 1, 2),
    (rf"(?:(?:{_DAYS})\.?,? )?\b([0-9]{{1,2}})(?:st|nd|rd|th)? ({_MONTH})\.?,? ([0-9]{{4}})\b", 3, 2, 1),
    (rf"\b({_MONTH})\.? ([0-9]{{1,2}})(?:st|nd|rd|th)?,? ([0-9]{{4}})\b", 3, 1, 2),
    (rf"\b({_MONTH})\.?,? ([0-9]{{4}})\b", 2, 1, 0),
    (r"\b(?:in|since|until|by|from|during) ([0-9]{4})\b", 1, 0, 0),
)


def normalise_year(year: Column) -> Column:
    """Two digits: below 20 are of this century, below 100 of the last."""
    return F.when(year < 20, year + 2000).when(year < 100, year + 1900).otherwise(year)


def signed_year(year: Column, era: Column) -> Column:
    return F.when(F.upper(era).startswith("B"), -year).otherwise(year)


def month_number(name: Column) -> Column:
    out = name.try_cast("int")
    for m, i in MONTHS.items():
        out = F.when(F.lower(F.substring(name, 1, 3)) == m[:3], F.lit(i)).otherwise(out)
    return out


def date_phrase(text: Column) -> Column:
    """struct(year, month, day) of the first pattern that matches; nulls for parts that it lacks; null if none does."""
    lowered, out = F.lower(text), F.lit(None).cast("struct<year:int,month:int,day:int>")
    for pattern, y, m, d in reversed(GRAMMAR):
        part = lambda g, p=pattern: F.regexp_extract(lowered, p, g) if g else F.lit(None).cast("string")
        found = F.struct(normalise_year(part(y).try_cast("int")).alias("year"), month_number(part(m)).alias("month"), part(d).try_cast("int").alias("day"))
        out = F.when(lowered.rlike(pattern), found).otherwise(out)
    return out


def to_date(phrase: Column) -> Column:
    """A date of a full phrase, null if a part is missing or out of range."""
    return F.try_make_timestamp(phrase["year"], phrase["month"], phrase["day"], F.lit(0), F.lit(0), F.lit(0)).cast("date")


def min_max(value: Column, low: Column, high: Column) -> Column:
    return F.when(high > low, (value - low) / (high - low)).otherwise(0.0)
