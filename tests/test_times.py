"""Times as said and days of zones, against Python's calendar."""

from datetime import datetime, timedelta
from zoneinfo import ZoneInfo

import pytest
from pyspark.sql import functions as F

from tidemark.functions import times

BERLIN, NEW_YORK = "Europe/Berlin", "America/New_York"


def ms(*args, zone="UTC"):
    return round(datetime(*args, tzinfo=ZoneInfo(zone)).timestamp() * 1000)


def parsed(spark, texts, now, zone):
    df = spark.createDataFrame([(i, x, now) for i, x in enumerate(texts)], "i int, t string, now long")
    return [r.v for r in df.select("i", times.parse_time(F.col("t"), F.col("now"), zone).alias("v")).orderBy("i").collect()]


@pytest.mark.parametrize("zone", ["UTC", NEW_YORK])
def test_parse(spark, zone):
    now = ms(2024, 2, 15, 14, 30)
    here = datetime(2024, 2, 15, 14, 30, tzinfo=ZoneInfo("UTC")).astimezone(ZoneInfo(zone))
    of = lambda **kw: ms(*(here.replace(tzinfo=None) - timedelta(**kw)).timetuple()[:6], zone=zone)
    cases = {
        "now": now, "NOW": now, "  now  ": now, "today": ms(2024, 2, 15, zone=zone), "Yesterday": ms(2024, 2, 14, zone=zone),
        "1 minute ago": of(minutes=1), "5minutes ago": of(minutes=5), "2  HOURS  ago": of(hours=2), "0 days ago": now, "100 days ago": of(days=100), "2 weeks ago": of(days=14),
        "1 month ago": ms(*here.replace(month=1, tzinfo=None).timetuple()[:6], zone=zone), "6 months ago": ms(2023, 8, *here.timetuple()[2:6], zone=zone),
        "2024-01-15T10:30:00": ms(2024, 1, 15, 10, 30, zone=zone), "2024-01-15T10:30:00Z": ms(2024, 1, 15, 10, 30), "2024-01-15t10:30:00+05:00": ms(2024, 1, 15, 5, 30),
        "2024-06-15T12:00:00-08:00": ms(2024, 6, 15, 20), "2024-01-15": ms(2024, 1, 15), "2024-03": ms(2024, 3, 1), "2024-12-31T23:59:59.999Z": ms(2025, 1, 1) - 1, "2024-02-30": ms(2024, 3, 1), "2024-01-15T24:00": ms(2024, 1, 16, zone=zone),
    }
    assert dict(zip(cases, parsed(spark, list(cases), now, zone), strict=True)) == cases
    wrong = ["", None, "not a date", "ago", "5 ago", "hours ago", "2 seconds ago", "1 year ago", "-1 days ago", "5 days", "ago 5 days", "2024-13-01", "2024-99-99", "now please", "2024-01-32", "2024-01-15T25:00", "2024-01T10:00", "9" * 30 + " days ago", "100000 months ago"]
    assert parsed(spark, wrong, now, zone) == [None] * len(wrong)
    assert None not in parsed(spark, ["9999999 weeks ago", "99999 months ago", "9999999 minutes ago"], now, zone)


def test_month_and_year_ends(spark):
    assert parsed(spark, ["1 month ago"], ms(2024, 3, 31, 12), "UTC") == [ms(2024, 3, 2, 12)]
    assert parsed(spark, ["1 month ago"], ms(2024, 1, 15, 12), "UTC") == [ms(2023, 12, 15, 12)]


def test_clock_changes(spark):
    """By the wall clock: a day back across a change has 23 or 25 hours, and a skipped time runs on."""
    noon = ms(2024, 3, 10, 12, zone=NEW_YORK)
    assert parsed(spark, ["1 day ago", "yesterday", "today", "24 hours ago"], noon, NEW_YORK) == [ms(2024, 3, 9, 12, zone=NEW_YORK), ms(2024, 3, 9, zone=NEW_YORK), ms(2024, 3, 10, zone=NEW_YORK), ms(2024, 3, 9, 12, zone=NEW_YORK)]
    assert noon - ms(2024, 3, 9, 12, zone=NEW_YORK) == 23 * 3_600_000
    assert parsed(spark, ["2024-03-10T02:30:00"], noon, NEW_YORK) == [ms(2024, 3, 10, 3, 30, zone=NEW_YORK)]
    assert parsed(spark, ["2024-11-03T01:30:00"], noon, NEW_YORK) == [ms(2024, 11, 3, 1, 30, zone=NEW_YORK)]


def test_counting_back_into_a_time_shown_twice(spark):
    """Asked for, the later of two times: all minutes and hours around changes of clocks, against Python's calendar."""
    for now, zone in ((ms(2023, 10, 29, 12, 20, zone=BERLIN), BERLIN), (ms(2024, 11, 3, 9, 5, zone=NEW_YORK), NEW_YORK), (ms(2024, 4, 7, 12, zone="Australia/Lord_Howe"), "Australia/Lord_Howe"), (ms(2024, 3, 31, 6, zone=BERLIN), BERLIN)):
        here = datetime.fromtimestamp(now / 1000, ZoneInfo(zone)).replace(tzinfo=None)
        texts = [f"{n} minutes ago" for n in range(0, 780, 7)] + [f"{n} hours ago" for n in range(24)]
        clocks = [here - timedelta(**{x.split()[1]: int(x.split()[0])}) for x in texts]
        # a skipped time counts with the offset from before the change, which is that of fold 0
        skipped = lambda t: datetime.fromtimestamp(t.replace(tzinfo=ZoneInfo(zone)).timestamp(), ZoneInfo(zone)).replace(tzinfo=None) != t
        want = [round(t.replace(tzinfo=ZoneInfo(zone), fold=0 if skipped(t) else 1).timestamp() * 1000) for t in clocks]
        df = spark.createDataFrame([(i, x) for i, x in enumerate(texts)], "i int, t string")
        got = [r.v for r in df.select("i", times.parse_time(F.col("t"), F.lit(now), zone, later=True).alias("v")).orderBy("i").collect()]
        assert got == want


def test_days(spark):
    at = [ms(2024, m, d, h, 59, zone=BERLIN) for m, d in ((3, 30), (3, 31), (4, 1), (10, 26), (10, 27), (10, 28), (1, 1)) for h in (0, 1, 2, 3, 12, 23)] + [-1, 0, -86_400_000 * 400]
    rows = spark.createDataFrame([(x,) for x in at], "t long")
    t = F.col("t")
    got = rows.select("t", times.local_day(t, BERLIN).alias("day"), times.day_start(t, BERLIN).alias("a"), times.day_end(t, BERLIN).alias("b"), times.clock(t, BERLIN).alias("clock")).collect()
    for r in got:
        here = datetime.fromtimestamp(r.t / 1000, ZoneInfo(BERLIN))
        start, after = (datetime.combine(here.date() + timedelta(k), datetime.min.time(), ZoneInfo(BERLIN)) for k in (0, 1))
        assert (r.day, r.a, r.b, r.clock) == ((here.date() - datetime(1970, 1, 1).date()).days, round(start.timestamp() * 1000), round(after.timestamp() * 1000) - 1, here.strftime("%H:%M"))
    assert {round((r.b + 1 - r.a) / 3_600_000) for r in got} == {23, 24, 25}
    weeks = spark.createDataFrame([(x,) for x in (-4, -3, 0, 3, 4, 10, 11)], "d long").select(times.week_of(F.col("d")).alias("w")).collect()
    assert [r.w for r in weeks] == [-10, -3, -3, -3, 4, 4, 11]


def test_headings(spark):
    now = ms(2024, 4, 1, 0, 30, zone=BERLIN)
    rows = spark.createDataFrame([(i, now, x) for i, x in enumerate([now, now - 3_600_000, now - 25 * 3_600_000, ms(2024, 3, 25, zone=BERLIN)])], "i int, now long, t long")
    got = [r.h for r in rows.select("i", times.day_heading(F.col("t"), F.col("now"), BERLIN).alias("h")).orderBy("i").collect()]
    assert got == ["Today", "Yesterday", "Sat, Mar 30", "Mon, Mar 25"]  # yesterday had 23 hours
