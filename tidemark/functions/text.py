"""Titles, pair keys, rounded hours and card checks, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def plain_title(title: Column) -> Column:
    """Without pictographs and modifier symbols; runs of blanks are one blank."""
    bare = F.regexp_replace(title, r"[\p{So}\p{Sk}\x{FE0F}\x{200D}]", "")
    return F.trim(F.regexp_replace(bare, r"[ \t\n\r\f]+", " "))


def pair_key(a: Column, b: Column) -> Column:
    """The same key for (a, b) and (b, a)."""
    return F.concat_ws("|", F.least(a, b).cast("string"), F.greatest(a, b).cast("string"))


def quarter_hours(minutes: Column) -> Column:
    """Hours, rounded to quarters; a quarter at least."""
    return F.greatest(F.lit(1), F.floor(minutes / 15 + 0.5)) / 4


def passes_luhn(digits: Column) -> Column:
    """Whether a string of digits passes the Luhn check; empty text does not."""
    values = F.transform(F.split(F.reverse(digits), ""), lambda d: d.cast("int"))
    doubled = F.transform(values, lambda v, i: F.when(i % 2 == 0, v).otherwise(F.when(v > 4, 2 * v - 9).otherwise(2 * v)))
    return (digits != "") & (F.aggregate(doubled, F.lit(0), lambda s, v: s + F.coalesce(v, F.lit(0))) % 10 == 0)


def mentions(word: str, *columns: Column) -> Column:
    """Whether any of the columns has the word in it, whatever the case; nulls have none."""
    out = F.lit(False)
    for c in columns:
        out = out | F.contains(F.lower(F.coalesce(c, F.lit(""))), F.lit(word.lower()))
    return out
