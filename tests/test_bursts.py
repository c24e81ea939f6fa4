"""Bursts, merged activities and frames of windows: by rules told in small, batch against machine, stream against batch."""

import random

import pytest
from pyspark.sql import functions as F

from tidemark.operators import intervals
from tidemark.streaming import bursts, joins, merging
from tidemark.streaming.bursts import BurstMachine
from tidemark.streaming.merging import MergeMachine, goes_with

EVENTS = "user_id long, at long, id long, kind string"
QUIET = {"click": 3_000, "keyboard": 2_000}


def one(records):
    m = BurstMachine(QUIET, 4_000, "app")
    return [x for r in records for x in m.take(r)] + m.end()


def test_burst_rules():
    assert one([(0, 1, "click"), (1000, 2, "click"), (3999, 3, "click")]) == [("click", 0, 3999, 3, 4000)]
    # quiet for just as long is another burst
    assert one([(0, 1, "keyboard"), (2000, 2, "keyboard")]) == [("keyboard", 0, 0, 1, 2000), ("keyboard", 2000, 2000, 1, 4000)]
    # a long burst is told in parts, the next of which begins at the last event before it
    assert one([(i * 1000, i, "keyboard") for i in range(10)]) == [("keyboard", 0, 3000, 4, 4000), ("keyboard", 3000, 7000, 4, 8000), ("keyboard", 7000, 9000, 2, 11000)]
    # a switch ends what goes on
    assert one([(0, 1, "click"), (10, 2, "keyboard"), (500, 3, "app"), (600, 4, "click")]) == [("click", 0, 0, 1, 500), ("keyboard", 10, 10, 1, 500), ("click", 600, 600, 1, 3600)]
    # nothing is told where nothing came since the last time
    assert one([(0, 1, "click"), (3900, 2, "mouse")]) == [("click", 0, 0, 1, 3000)]


def made(seed, users=4, n=200):
    r, rows = random.Random(seed), []
    for user in range(users):
        at = 0
        for i in range(n):
            at += r.choice([0, 1, 300, 700, 1000, 1500, 2000, 2999, 3000, 9000])
            rows.append((user, at, i, r.choice(["click", "click", "keyboard", "keyboard", "app", "mouse"])))
    return rows


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_bursts_are_the_machine(spark, seed):
    rows = made(seed)
    want = [(u, *x) for u in range(4) for x in one(sorted(r[1:] for r in rows if r[0] == u))]
    got = bursts.bursts(spark.createDataFrame(rows, EVENTS).repartition(3), quiet_ms=QUIET)
    assert sorted(map(tuple, got.collect())) == sorted(want)


def streamed(spark, tmp_path, rows, schema, time, make, name, files=6):
    src = tmp_path / name
    stamp = f"timestamp_millis({time}) AS ts_at"
    far = max(r[1] for r in rows) + 10**11
    for k in range(files):
        spark.createDataFrame(rows[k::files], schema).selectExpr("*", stamp).coalesce(1).write.parquet(str(src / f"a{k}"))
    for k in (1, 2):
        spark.createDataFrame([(99, far * k, *rows[0][2:])], schema).selectExpr("*", stamp).coalesce(1).write.parquet(str(src / f"z{k}"))
    frame = spark.createDataFrame(rows, schema).selectExpr("*", stamp)
    source = spark.readStream.schema(frame.schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(str(src))
    out = make(source.withWatermark("ts_at", "100 days"))
    q = out.writeStream.format("memory").queryName(name).outputMode("append").option("checkpointLocation", str(tmp_path / f"c_{name}")).trigger(availableNow=True).start()
    assert q.awaitTermination(400)
    return spark.table(name).where("user_id <> 99")


def test_stream_bursts(spark, tmp_path):
    rows = made(7, users=3, n=60)
    got = streamed(spark, tmp_path, rows, EVENTS, "at", lambda s: bursts.stream_bursts(s, quiet_ms=QUIET), "bursts_out")
    want = bursts.bursts(spark.createDataFrame(rows, EVENTS), quiet_ms=QUIET)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


CHUNKS = "user_id long, at long, window long, start_ms long, end_ms long, chunk_end long, app string, bundle string, host string, display long, browser boolean, flush boolean"


def test_contexts():
    def c(app="a", bundle=None, host=None, display=None, browser=False):
        return [app, bundle, host, display, browser]

    assert goes_with(c(), c()) and not goes_with(c(), c("b"))
    assert not goes_with(c(display=1), c(display=2)) and goes_with(c(display=1), c())
    assert goes_with(c("a", "x"), c("b", "x")) and not goes_with(c("a", "x"), c("a", "y")) and goes_with(c("a", "x"), c("a"))
    assert goes_with(c(browser=True, host="h"), c(browser=True, host="h")) and not goes_with(c(browser=True), c(browser=True)) and not goes_with(c(browser=True, host="h"), c(browser=True, host="i"))


def machine(records, min_ms=3, max_ms=100):
    m = MergeMachine(min_ms, max_ms)
    return [x for r in records for x in m.take(r)] + m.end()


def test_merge_rules():
    def r(at, end, app="a", window=None, flush=False):
        return (at, at if window is None else window, end, app, None, None, None, False, flush)

    assert machine([r(0, 40), r(41, 100), r(101, 140)]) == [(0, 100, "a", None, 2, [0, 41], "max_duration"), (101, 140, "a", None, 1, [101], "flush")]
    assert machine([r(0, 40), r(41, 60, "b"), r(61, 62), r(63, 80, "c")]) == [(0, 40, "a", None, 1, [0], "context_change"), (41, 60, "b", None, 1, [41], "context_change"), (63, 80, "c", None, 1, [63], "flush")]
    assert machine([r(0, 40, flush=True), r(41, 60)]) == [(0, 40, "a", None, 1, [0], "flush"), (41, 60, "a", None, 1, [41], "flush")]
    assert machine([r(0, 50), r(10, 20)]) == [(0, 50, "a", None, 2, [0, 10], "flush")]


def chunk_rows(seed, users=3, n=150):
    r, rows = random.Random(seed), []
    for user in range(users):
        at = 0
        for i in range(n):
            at += r.choice([1, 10, 30, 60, 200])
            rows.append((user, at, i, at, at + r.choice([0, 1, 5, 20, 60]), 0, r.choice("aab"), r.choice([None, "x", "y"]), r.choice([None, "h", "i"]), r.choice([None, 1, 1, 2]), r.random() < 0.2, r.random() < 0.1))
    return rows


def plain_merged(rows, max_ms):
    out = []
    for user in {x[0] for x in rows}:
        records = []
        for _, _, window, start, end, _, *context, flush in (x for x in rows if x[0] == user):
            s = start
            while s <= end:
                e = min(end, s + max_ms - 1)
                records.append((s, window, e, *context, flush and e == end))
                s = e + 1
        out += [(user, *x) for x in machine(sorted(records, key=lambda x: x[:2]), max_ms=max_ms)]
    return sorted(map(repr, out))


@pytest.mark.parametrize("max_ms", [25, 100])
def test_merged_batch(spark, max_ms):
    rows = chunk_rows(max_ms)
    windows = spark.createDataFrame(rows, CHUNKS).drop("at", "chunk_end").repartition(4)
    got = merging.merged(merging.chunks(windows, max_ms), min_ms=3, max_ms=max_ms)
    assert sorted(map(repr, map(tuple, got.collect()))) == plain_merged(rows, max_ms)


def test_stream_merged(spark, tmp_path):
    rows = chunk_rows(11, users=2, n=50)
    parts = [tuple(x) for x in merging.chunks(spark.createDataFrame(rows, CHUNKS).drop("at", "chunk_end"), 100).select([c.split()[0] for c in CHUNKS.split(", ")]).collect()]
    got = streamed(spark, tmp_path, parts, CHUNKS, "at", lambda s: merging.stream_merged(s, min_ms=3, max_ms=100), "merged_out")
    want = merging.merged(spark.createDataFrame(parts, CHUNKS), min_ms=3, max_ms=100)
    # what is pending at the end of a batch stays pending on a stream
    a, b = sorted(map(repr, map(tuple, got.collect()))), sorted(map(repr, map(tuple, want.collect())))
    assert set(a) <= set(b) and len(b) - len(a) <= 2 and len(a) > 20


def test_chunks_with_frames(spark):
    windows = spark.createDataFrame([(1, 1, 0, 250, "a"), (1, 2, 251, 260, "a"), (1, 3, 300, 290, "a"), (2, 4, 0, 99, "b")], "user_id long, window long, start_ms long, end_ms long, app string")
    parts = merging.chunks(windows, 100)
    assert sorted((r.window, r.at, r.chunk_end) for r in parts.collect()) == [(1, 0, 99), (1, 100, 199), (1, 200, 250), (2, 251, 260), (4, 0, 99)]
    frames = spark.createDataFrame([(1, 99), (1, 250), (1, 250), (1, 300), (2, 100)], "user_id long, t long")
    assert sorted((r.window, r.at) for r in merging.with_frames(parts, frames, "user_id", 64).collect()) == [(1, 0), (1, 200)]


def test_contained_of_long_windows(spark):
    """Windows from a point to all time: none goes to more than two slots."""
    r = random.Random(5)
    points = [(r.randint(0, 2), r.randint(0, 10_000), i) for i in range(300)]
    windows = [(r.randint(0, 2), a, a + r.choice([0, 1, 9, 10, 11, 100, 5000, 10**9, 10**12]), i) for i, a in enumerate(r.randint(0, 10_000) for _ in range(80))] + [(1, 50, 40, 99), (None, 0, 9, 98)]
    got = intervals.contained(spark.createDataFrame(points, "k long, t long, id long"), spark.createDataFrame(windows, "k long, start_ms long, end_ms long, window long"), "k", 10)
    want = sorted((k, t, i, w) for k, t, i in points for k2, a, b, w in windows if k == k2 and a <= t <= b)
    assert sorted((x.k, x.t, x.id, x.window) for x in got.collect()) == want
    dealt = intervals.dealt_windows(spark.createDataFrame(windows, "k long, start_ms long, end_ms long, window long"), "k", 10)
    assert dealt.groupBy("window").count().agg(F.max("count")).first()[0] <= 2


def test_stream_join(spark, tmp_path):
    r = random.Random(6)
    frames = sorted([(r.randint(0, 2), i, r.randint(0, 60_000)) for i in range(200)], key=lambda x: x[2])
    windows = sorted([(r.randint(0, 2), i, a, a + r.randint(0, 4_000)) for i, a in enumerate(r.randint(0, 60_000) for _ in range(40))], key=lambda x: x[3])
    stamps = {"f": ("k long, id long, t long", "timestamp_millis(t) AS ts"), "w": ("k long, window long, start_ms long, end_ms long", "timestamp_millis(start_ms) AS start_ts, timestamp_millis(end_ms) AS end_ts")}
    sources = {}
    for name, rows in (("f", frames), ("w", windows)):
        schema, stamp = stamps[name]
        for k in range(4):
            part = rows[k * len(rows) // 4 : (k + 1) * len(rows) // 4]
            r.shuffle(part)
            spark.createDataFrame(part, schema).selectExpr("*", *stamp.split(", ")).coalesce(1).write.parquet(str(tmp_path / name / str(k)))
        kind = spark.read.option("recursiveFileLookup", True).parquet(str(tmp_path / name)).schema
        sources[name] = spark.readStream.schema(kind).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(str(tmp_path / name))
    out = joins.frames_in_windows(sources["f"], sources["w"], "k", "4 seconds", "30 seconds", "30 seconds")
    q = out.writeStream.format("memory").queryName("joined").outputMode("append").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    assert q.awaitTermination(300)
    want = intervals.contained(spark.createDataFrame(frames, "k long, id long, t long"), spark.createDataFrame(windows, stamps["w"][0]), "k", 1000)
    assert sorted((x.k, x.id, x.window) for x in spark.table("joined").collect()) == sorted((x.k, x.id, x.window) for x in want.collect())
