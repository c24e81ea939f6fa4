"""Times as people say them, and calendar days of a zone, as column expressions that don't depend on the session's zone.

Times are whole milliseconds since 1970. A wall-clock time that a zone skips counts with the offset from before the change; one that it has
twice is the first, unless the later is asked for.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_EPOCH = "timestamp_ntz'1970-01-01 00:00:00'"


def wall(ms: Column, zone: str) -> Column:
    """The zone's wall clock (timestamp_ntz) at a time."""
    utc = F.expr(_EPOCH) + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), (ms / F.lit(1000).cast("decimal(20,0)")).cast("decimal(18,6)"))
    return F.convert_timezone(F.lit("UTC"), F.lit(zone), utc)


def _since_epoch(clock: Column) -> Column:
    return F.floor(F.timestamp_diff("MICROSECOND", F.expr(_EPOCH), clock) / 1000).cast("bigint")


def instant(clock: Column, zone: str, later: bool = False) -> Column:
    """The time at which the zone's wall clock shows this; the last such time if the later is asked for."""
    first = _since_epoch(F.convert_timezone(F.lit(zone), F.lit("UTC"), clock))
    if not later:
        return first
    # the offset a day on is that after a change, if there is one
    after = first + 86_400_000
    again = _since_epoch(clock) - (_since_epoch(wall(after, zone)) - after)
    return F.when((again > first) & (_since_epoch(wall(again, zone)) == _since_epoch(clock)), again).otherwise(first)


def local_day(ms: Column, zone: str) -> Column:
    """Days from 1 January 1970 to the zone's day."""
    return F.unix_date(wall(ms, zone).cast("date"))


def _midnight(day: Column, zone: str) -> Column:
    return instant(F.date_from_unix_date(day.cast("int")).cast("timestamp_ntz"), zone)


def day_start(ms: Column, zone: str) -> Column:
    return _midnight(local_day(ms, zone), zone)


def day_end(ms: Column, zone: str) -> Column:
    """The last millisecond of the day, which has 23 or 25 hours where clocks change."""
    return _midnight(local_day(ms, zone) + 1, zone) - 1


def week_of(day: Column) -> Column:
    """Weeks by their Mondays, as the number of the Monday's day; day 0 was a Thursday."""
    return (F.floor((day + 3) / 7) * 7 - 3).cast("bigint")


def day_heading(ms: Column, now_ms: Column, zone: str) -> Column:
    """Today, Yesterday, or the date as `Mon, Jan 1`."""
    back = local_day(now_ms, zone) - local_day(ms, zone)
    return F.when(back == 0, "Today").when(back == 1, "Yesterday").otherwise(F.date_format(wall(ms, zone), "EEE, MMM d"))


def clock(ms: Column, zone: str) -> Column:
    """Hours and minutes as `09:05`."""
    return F.date_format(wall(ms, zone), "HH:mm")


def _ago(now: Column, amount: Column, unit: Column) -> Column:
    """Wall-clock time before now. A month back keeps the day's number; days that the month lacks run on into the next."""
    day = F.day(now)
    month = F.add_months(F.trunc(now.cast("date"), "month"), -F.when(unit == "month", amount).otherwise(0).cast("int"))
    since = now - now.cast("date").cast("timestamp_ntz")
    by_month = F.date_add(month, day - 1).cast("timestamp_ntz") + since
    n = F.when(unit == "month", 0).otherwise(amount).cast("int")
    of = lambda name, many=1: F.when(unit == name, n * many).otherwise(0)
    by_time = now - F.make_dt_interval(of("day") + of("week", 7), of("hour"), of("minute"))
    return F.when(unit == "month", by_month).otherwise(by_time)


def parse_time(text: Column, now_ms: Column, zone: str, later: bool = False) -> Column:
    """Milliseconds of `now`, `today`, `yesterday` (the day's start), `N minutes/hours/days/weeks/months ago` or an ISO 8601 time; else null.

    Case and white space around don't matter. Units count by the wall clock. A date alone is in UTC, a time without an offset is the zone's. Days
    up to 31 that a month lacks run on into the next. Amounts of more than seven digits (five for months) are null. Where counting back ends at a
    wall-clock time that the zone has twice, that is the first, or the one nearer to now if the later is asked for.
    """
    t = F.lower(F.regexp_replace(text, r"^\s+|\s+$", ""))
    now = wall(now_ms, zone)
    today = local_day(now_ms, zone)
    ago = r"^([0-9]{1,7})\s*(minute|hour|day|week|month)s?\s*ago$"
    unit = F.regexp_extract(t, ago, 2)
    amount = F.coalesce(F.regexp_extract(t, ago, 1).try_cast("int"), F.lit(0))
    fits = (unit != "month") | (amount < 100_000)
    back = instant(_ago(now, F.when(fits, amount).otherwise(0), unit), zone, later)

    iso = r"^([0-9]{4})(?:-([0-9]{2})(?:-([0-9]{2}))?)?(?:t([0-9]{2}):([0-9]{2})(?::([0-9]{2})(?:\.([0-9]{1,9}))?)?(z|[+-][0-9]{2}:?[0-9]{2})?)?$"
    part = lambda i, empty: F.coalesce(F.regexp_extract(t, iso, i).try_cast("int"), F.lit(empty))
    year, month, day, hour, minute, second = part(1, 0), part(2, 1), part(3, 1), part(4, 0), part(5, 0), part(6, 0)
    sound = t.rlike(iso) & month.between(1, 12) & day.between(1, 31) & (minute < 60) & (second < 60) & ((hour < 24) | ((hour == 24) & (minute == 0) & (second == 0))) & (year > 0)
    sound = sound & ((F.regexp_extract(t, iso, 4) == "") | (F.regexp_extract(t, iso, 3) != ""))
    date = F.date_add(F.make_date(F.when(sound, year).otherwise(2000), F.when(sound, month).otherwise(1), F.lit(1)), F.when(sound, day).otherwise(1) - 1)
    fraction = F.rpad(F.substring(F.regexp_extract(t, iso, 7), 1, 3), 3, "0").cast("int")
    into = ((hour * 60 + minute) * 60 + second).cast("bigint") * 1000 + fraction
    clock_ = date.cast("timestamp_ntz") + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), (into / F.lit(1000).cast("decimal(20,0)")).cast("decimal(18,6)"))
    offset = F.regexp_extract(t, iso, 8)
    minutes = F.coalesce(F.substring(F.regexp_replace(offset, ":", ""), 2, 2).try_cast("int"), F.lit(0)) * 60 + F.coalesce(F.substring(F.regexp_replace(offset, ":", ""), 4, 2).try_cast("int"), F.lit(0))
    shift = F.when(F.startswith(offset, F.lit("-")), -minutes).otherwise(minutes).cast("bigint") * 60_000
    local = (F.regexp_extract(t, iso, 4) != "") & (offset == "")
    at = F.when(local, instant(clock_, zone)).otherwise(instant(clock_, "UTC") - shift)

    out = F.when(t == "now", now_ms).when(t == "today", _midnight(today, zone)).when(t == "yesterday", _midnight(today - 1, zone))
    return out.when((unit != "") & fits, back).when((unit == "") & sound, at).cast("bigint")
