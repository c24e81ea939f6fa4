"""Hosts, domains and private networks of addresses, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def host(url: Column) -> Column:
    """Lower-cased host with its port, without `www.`; null if there is none."""
    h = F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#]+)", 1))
    return F.when(h != "", F.regexp_replace(h, r"^www\.", ""))


def domain(host_: Column) -> Column:
    """The last two labels of a host; addresses stay whole."""
    bare = F.regexp_replace(host_, r":[0-9]+$", "")
    return F.when(bare.rlike(r"^[0-9.]+$|^\["), bare).otherwise(F.regexp_extract(bare, r"([^.]+\.)?[^.]+$", 0))


_PART = "(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])"


def is_private(host_: Column) -> Column:
    """Whether a host is this machine or an address of a private network: four parts of at most 255; a name that only begins like one is none."""
    bare = F.regexp_replace(host_, r":[0-9]+$", "")
    two = rf"\.{_PART}\.{_PART}"
    return bare.rlike(rf"^(localhost|(127|10)\.{_PART}{two}|(192\.168|169\.254|172\.(1[6-9]|2[0-9]|3[01])){two}|\[::1\])$")
