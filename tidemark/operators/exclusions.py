"""Which addresses a list of excluded domains and wildcards names."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidemark.functions.web import host


def excluded_by(url: Column, patterns: list[str]) -> Column:
    """The first of the patterns that names the address, null if none does.

    A pattern with `*` may match anywhere in the address, each `*` any run of characters; another one is a domain, which names its subdomains
    too. Patterns are lower case. A null address is named by none.
    """
    bare = F.regexp_replace(host(url), r":[0-9]+$", "")
    out = F.lit(None).cast("string")
    for p in reversed(patterns):
        if "*" in p:
            hit = F.lower(url).rlike(".*".join(re.escape(x) for x in p.split("*")))
        else:
            hit = (bare == p) | F.endswith(bare, F.lit(f".{p}"))
        out = F.when(hit, p).otherwise(out)
    return out
