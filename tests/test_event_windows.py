"""Event windows: the machine's rules, batch against one machine for each key, and a stream of shuffled, late input against the batch."""

import random

import pytest
from pyspark.sql import functions as F

from tidemark.streaming import folds, windows
from tidemark.streaming.windows import Rules, WindowMachine, typed_edit

RULES = Rules(max_ms=500, grace_ms=0, idle_ms=None)


def rec(at, kind, ts=None, app=None, title=None, typed=False):
    return (at, at, kind, at if ts is None else ts, app, title, typed)


def told(records, rules=RULES, until=None, end=False):
    """(start, end, closed_by, n, app, title) of what a machine gives."""
    m = WindowMachine(rules)
    out = [x for r in records for x in m.take(r)]
    out += m.advance(until) if until is not None else []
    out += m.end() if end else []
    return [(*x[:4], x[5], x[6]) for x in out]


def bounds(*args, **kw):
    return [x[:4] for x in told(*args, **kw)]


def test_idle_and_length():
    assert bounds([rec(1000, "keyboard"), rec(1050, "keyboard"), rec(1350, "idle", 1050)]) == [(1000, 1050, "gap", 2)]
    keys = [rec(1000 + 80 * i, "keyboard") for i in range(11)]
    assert bounds([*keys, rec(1801, "idle", 1800)]) == [(1000, 1500, "max_duration", 7), (1500, 1800, "gap", 4)]
    assert bounds([rec(1000, "app"), rec(1300, "idle", 1200)]) == [(1000, 1200, "gap", 1)]
    assert bounds([rec(1000, "click"), rec(1001, "idle", 900)]) == [(1000, 1000, "gap", 1)]
    assert bounds([rec(1000, "app"), rec(1800, "idle", 1650)]) == [(1000, 1500, "max_duration", 1), (1500, 1650, "gap", 0)]
    assert bounds([rec(1000, "app"), rec(1500, "idle", 1050)]) == [(1000, 1500, "max_duration", 1)]
    assert bounds([rec(8000, "keyboard"), rec(8100, "idle", 8000), rec(9000, "click"), rec(9001, "idle", 9000)]) == [(8000, 8000, "gap", 1), (9000, 9000, "gap", 1)]


def test_flush():
    assert bounds([rec(1000, "click"), rec(1400, "flush")]) == [(1000, 1400, "flush", 1)]
    assert bounds([rec(1000, "click"), rec(1400, "flush", 1300)]) == [(1000, 1300, "flush", 1)]
    assert bounds([rec(1000, "flush")]) == [] == bounds([rec(1000, "click")])
    assert bounds([rec(1000, "click")], end=True) == [(1000, 1000, "flush", 1)]


def test_switches():
    assert bounds([rec(10000, "keyboard"), rec(10050, "keyboard"), rec(10100, "app"), rec(10101, "flush", 10100)]) == [(10000, 10100, "app_change", 2), (10100, 10100, "flush", 1)]
    assert bounds([rec(12000, "keyboard"), rec(12100, "app"), rec(12110, "scroll", 11900), rec(12120, "flush", 11950)], Rules(500, 80, None)) == [(12000, 12100, "app_change", 2), (12100, 12100, "flush", 1)]


def test_away():
    away = [rec(1000, "click"), rec(1000, "idle", 1000), rec(2000, "app", app="saver"), rec(3000, "app", app="chrome", title="Inbox")]
    assert bounds(away, until=9000) == [(1000, 1000, "gap", 1)]
    assert told([*away, rec(5000, "click"), rec(5000, "idle", 5000)])[1:] == [(5000, 5000, "gap", 2, "chrome", "Inbox")]
    assert told([*away, rec(3000, "return"), rec(3400, "idle", 3400)])[1:] == [(3000, 3400, "gap", 1, "chrome", "Inbox")]
    assert bounds([rec(1000, "idle"), rec(3000, "return"), rec(3400, "idle", 3400)]) == [(3000, 3400, "gap", 0)]
    assert bounds([rec(1000, "idle"), rec(2000, "click"), rec(2000, "return"), rec(2400, "app")]) == [(2000, 2400, "app_change", 1)]
    # a switch at full length closes the full window only: the one that opened then has nothing in it
    assert bounds([rec(2000, "click"), rec(2500, "app"), rec(2600, "flush")]) == [(2000, 2500, "max_duration", 1), (2500, 2600, "flush", 1)]
    assert bounds([rec(1000, "idle"), rec(2000, "click"), rec(2400, "app")]) == [(2000, 2400, "app_change", 1)]


def test_late_events():
    rules = Rules(5000, 80, None)
    first = [rec(2000, "keyboard", 1000), rec(2000, "app", app="new"), rec(2010, "click", 1700)]
    assert bounds(first, rules) == []
    assert bounds(first, rules, until=2079) == [] and bounds(first, rules, until=2080) == [(1000, 2000, "app_change", 2)]
    assert bounds([*first, rec(2500, "flush")], rules) == [(1000, 2000, "app_change", 2), (2000, 2500, "flush", 1)]
    # at the boundary itself an event is the new window's; past the grace too
    assert bounds([rec(1000, "keyboard"), rec(2000, "app"), rec(2001, "click", 2000), rec(2500, "flush")], rules) == [(1000, 2000, "app_change", 1), (2000, 2500, "flush", 2)]
    assert bounds([rec(1000, "keyboard"), rec(2000, "app"), rec(2100, "click", 1700), rec(2500, "flush")], rules) == [(1000, 2000, "app_change", 1), (2000, 2500, "flush", 2)]
    # a window that is flushed takes the ones before it along, in order
    got = told([rec(1000, "keyboard"), rec(2000, "app", app="ghost"), rec(3000, "scroll"), rec(4000, "app", app="elec"), rec(4010, "flush")], rules)
    assert [(x[2], x[4]) for x in got] == [("app_change", None), ("app_change", "ghost"), ("flush", "elec")]


def test_typed_titles():
    def notepad(at, title, app="Notepad"):
        return rec(at, "app", app=app, title=title)

    titles = [notepad(1000, "I - Notepad"), rec(1050, "keyboard", typed=True), notepad(1100, "I n - Notepad"), notepad(1150, "I ne - Notepad"), notepad(1200, "*I ne - Notepad"), notepad(1300, "other.txt - Notepad")]
    assert [(x[3], x[5]) for x in told(titles, end=True)] == [(2, "*I ne - Notepad"), (1, "other.txt - Notepad")]
    for second in (rec(1050, "click"), rec(1050, "keyboard")):
        assert len(told([notepad(1000, "report - Notepad"), second, notepad(1100, "report draft - Notepad")])) == 1
    assert len(told([notepad(1000, "report"), rec(1050, "keyboard", typed=True), notepad(4000, "report draft")], Rules(9000, 0, None))) == 1
    assert bounds([notepad(1000, "I - Notepad"), rec(1050, "keyboard", typed=True), notepad(1100, "I n - Notepad"), rec(1101, "flush", 1060)]) == [(1000, 1100, "flush", 2)]
    assert len(told([notepad(1000, "Slack", "Slack"), rec(1010, "keyboard", typed=True), notepad(1100, "(3) Slack", "Slack")], end=True)) == 2
    assert [typed_edit(*x) for x in (("ab", "axb"), ("axb", "ab"), ("aa", "aaa"), ("a", "a"), ("", "a"), (None, "a"), ("abc", "axxc"), ("ab", "ba"))] == [True, True, True, False, False, False, False, False]


def made(seed, users=6, n=120):
    r = random.Random(seed)
    rows, i = [], 0
    for user in range(users):
        at = 1000
        for _ in range(n):
            at += r.choice([0, 5, 20, 60, 150, 400, 1200, 3000])
            kind = r.choice(["click", "keyboard", "keyboard", "app", "app"])
            i += 1
            rows.append((user, at, i, kind, at - r.choice([0, 0, 10, 90]), r.choice("ab") if kind == "app" else None, r.choice(["x", "xy", "xyz"]), r.random() < 0.5))
    return rows


RECORDS = "user_id long, at long, id long, kind string, ts long, app string, title string, typed boolean"
MADE = Rules(max_ms=900, grace_ms=80, idle_ms=500, typed_ms=100, typed_apps=frozenset("a"))


@pytest.mark.parametrize("seed", [1, 2])
def test_batch(spark, seed):
    """A key divided at idle times gives what one machine gives for the whole key."""
    rows = made(seed)
    want = []
    for user in {r[0] for r in rows}:
        m = WindowMachine(MADE)
        out = [x for r in sorted(r[1:] for r in rows if r[0] == user) for x in m.take(r)] + m.end()
        want += [(user, *x) for x in out]
    got = windows.event_windows(spark.createDataFrame(rows, RECORDS).repartition(5), rules=MADE)
    assert sorted(map(repr, map(tuple, got.collect()))) == sorted(map(repr, want))
    assert windows.event_windows(spark.createDataFrame([], RECORDS), rules=MADE).count() == 0


def test_stream_equals_batch(spark, tmp_path):
    """Append mode, many small files whose rows are shuffled and late within the watermark."""
    rows = made(3)
    last = max(r[1] for r in rows)
    r = random.Random(4)
    shuffled = sorted(rows, key=lambda x: x[1] + r.randint(0, 900))
    late = "timestamp_millis(at) AS ts_at"
    frame = spark.createDataFrame(rows, RECORDS).selectExpr("*", late)
    src = tmp_path / "in"
    for k in range(0, len(shuffled), 90):
        spark.createDataFrame(shuffled[k : k + 90], RECORDS).selectExpr("*", late).coalesce(1).write.parquet(str(src / f"{k:05}"))
    far = [(99, last + 100_000, 0, "click", last + 100_000, None, None, False), (99, last + 200_000, 1, "click", last + 200_000, None, None, False)]
    for k, row in enumerate(far):
        spark.createDataFrame([row], RECORDS).selectExpr("*", late).coalesce(1).write.parquet(str(src / f"x{k}"))
    source = spark.readStream.schema(frame.schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(str(src))
    out = windows.stream_windows(source.withWatermark("ts_at", "1 second"), rules=MADE)
    q = out.writeStream.format("memory").queryName("windows_out").outputMode("append").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    assert q.awaitTermination(400)
    got = spark.table("windows_out").where("user_id <> 99")
    # On the stream idle time closes what a batch flushes at its end.
    want = windows.event_windows(frame, rules=MADE)
    keys = [c for c in want.columns if c != "emitted_ms"]
    a, b = (sorted(map(repr, map(tuple, x.select(keys).collect()))) for x in (got.where("closed_by <> 'gap'"), want.where("closed_by not in ('gap', 'flush')")))
    assert a == b and len(a) > 50
    a, b = (sorted(map(repr, map(tuple, x.where("closed_by in ('gap', 'flush')").select("user_id", "start_ms", "ids").collect()))) for x in (got, want))
    assert a == b and len(a) > 20
    assert got.select(F.explode("ids")).count() == want.select(F.explode("ids")).count()


def test_hot_key_is_divided(spark):
    """One user with all records: idle times make parts that go to several tasks."""
    rows = [x for x in made(5, users=1, n=400)]
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        tasks = windows.event_windows(spark.createDataFrame(rows, RECORDS), rules=MADE).select(F.spark_partition_id()).distinct().count()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert tasks > 1


def test_runner_orders_equal_times(spark):
    class Order:
        def take(self, r):
            return [(r[1],)]

        def advance(self, now):
            return []

        def due(self):
            return folds.NEVER

        def end(self):
            return []

    df = spark.createDataFrame([("k", 1, "b"), ("k", 1, None), ("k", 1, "a"), ("k", 0, "z")], "k string, at long, x string").repartition(4)
    got = folds.batch(df, ["k"], ["at", "x"], lambda k: Order(), "x string").collect()
    assert [r.x for r in got] == ["z", None, "a", "b"]


def test_query_over_the_table(spark, sf_dir):
    """The registered query gives what one machine for each user gives."""
    from tidemark.plans import activity
    from tidemark.plans.queries import _acts

    rules = Rules(max_ms=24 * 3_600_000, grace_ms=60_000, idle_ms=6 * 3_600_000)
    records, want = {}, []
    for r in windows.from_activities(_acts(spark, sf_dir)).collect():
        records.setdefault(r[0], []).append(tuple(r[1:]))
    for user, rows in records.items():
        m = WindowMachine(rules)
        want += [(user, *x) for r in sorted(rows, key=lambda r: r[:2]) for x in m.take(r)] + [(user, *x) for x in m.end()]
    got = activity.event_windows(spark, sf_dir).collect()
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, want)) and len(got) > 100
