"""Durations, step lists, signatures and labels, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_BLANKS = r"^[ \t\r\n]+|[ \t\r\n]+$"


def duration_text(ms: Column) -> Column:
    """`1h 2m 3s`, without leading units that are zero."""
    s = F.floor(ms / 1000)
    h, m = F.floor(s / 3600), F.floor(s % 3600 / 60)
    part = lambda c, unit: F.concat(c.cast("string"), F.lit(unit))
    return F.concat(F.when(h > 0, part(h, "h ")).otherwise(""), F.when((h > 0) | (m > 0), part(m, "m ")).otherwise(""), part(s % 60, "s"))


def step_list(steps: Column, most: int = 15, chars: int = 200) -> Column:
    """Steps without blanks around, cut to so many characters; empty and null ones go, then all beyond the first `most`. A null list is empty."""
    cut = F.transform(F.coalesce(steps, F.array().cast("array<string>")), lambda s: F.substring(F.regexp_replace(s, _BLANKS, ""), 1, chars))
    return F.slice(F.filter(cut, lambda s: s != ""), 1, most)


def signature_text(*columns: Column) -> Column:
    """The columns that aren't blank, joined by `. `."""
    return F.concat_ws(". ", *(F.nullif(F.trim(c), F.lit("")) for c in columns))


def viewed_label(title: Column, host: Column, app: Column) -> Column:
    """What a view without input is called: by its title, else its host, else its app."""
    return F.concat(F.lit("Viewed "), F.coalesce(F.nullif(F.trim(title), F.lit("")), F.nullif(F.trim(host), F.lit("")), app))


def run_apps(apps: Column, browsers: list[str]) -> Column:
    """The apps of a run, each once and none empty; browsers only where there is nothing else."""
    named = F.array_distinct(F.filter(apps, lambda a: a != ""))
    others = F.filter(named, lambda a: ~a.isin(browsers))
    return F.when(F.size(others) > 0, others).otherwise(named)
