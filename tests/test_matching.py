"""Matching, claims, thinning, sinks, exports and replies, by plain versions."""

import random

import pytest
from pyspark.sql import functions as F

from tidemark.functions import replies
from tidemark.operators import frames, matching
from tidemark.streaming import sink

SEGMENT = "k long, id long, start_ms long, end_ms long, title string"


def segments(r, n, first):
    out = []
    for i in range(n):
        a = r.randint(0, 3000)
        out.append((r.randint(0, 2), first + i, a, a + r.choice([-5, 0, 1, 40, 200, 900]), r.choice(["x", "y", "", None])))
    return out


def plain_matches(golden, produced, least):
    pairs = []
    for k, g, g0, g1, gt in golden:
        for k2, p, p0, p1, pt in produced:
            over = min(g1, p1) - max(g0, p0)
            if k == k2 and over > 0 and (ratio := over / max(1, min(g1 - g0, p1 - p0))) >= least:
                pairs.append((-ratio, -bool(gt and gt == pt), g, p, k, over))
    taken, out = set(), []
    for ratio, _, g, p, k, over in sorted(pairs):
        if not {("g", g), ("p", p)} & taken:
            taken |= {("g", g), ("p", p)}
            out.append((k, g, p, over, round(-ratio, 9)))
    return sorted(out)


@pytest.mark.parametrize("seed", [1, 2])
def test_segments(spark, seed):
    r = random.Random(seed)
    golden, produced = segments(r, 60, 0), segments(r, 70, 1000)
    a, b = (spark.createDataFrame(x, SEGMENT).repartition(3) for x in (golden, produced))
    found = matching.matched_segments(a, b, "k", 100)
    got = sorted((*x[:4], round(x[4], 9)) for x in map(tuple, found.collect()))
    want = plain_matches(golden, produced, 0.3)
    assert got == want
    report = {x.k: x for x in matching.segment_report(a, b, found, "k").collect()}
    for k in range(3):
        g, p, m = (sum(x[0] == k for x in y) for y in (golden, produced, want))
        assert tuple(report[k])[1:4] == (g, p, m) and report[k].coverage == round(m / g, 6) and (report[k].missed, report[k].extra) == (g - m, p - m)


def test_claims(spark):
    steps = spark.createDataFrame([(1, 0, 10, "a"), (1, 1, 50, "b"), (1, 2, 50, "a"), (2, 3, 0, "a")], "k long, step long, at long, app string")
    blocks = spark.createDataFrame([(1, 100, 5, 90, "a"), (1, 101, 10, 20, "a"), (1, 102, 30, 49, "a"), (1, 103, 40, 59, "a"), (1, 104, 45, 99, "b"), (1, 105, 50, 51, "a")], "k long, id long, start_ms long, end_ms long, app string")
    assert sorted(map(tuple, matching.claimed_blocks(steps, blocks, "k").collect())) == [(1, 0, 3, 102), (1, 1, 0, None), (1, 2, 1, 105), (2, 3, 0, None)]


def plain_thinned(rows, least):
    if len(rows) <= 2 or least <= 0:
        return rows
    unlike = lambda a, b: None if not a or not b or len(a) != len(b) else 100 * sum(x != y for x, y in zip(a, b, strict=True)) / len(a)
    out = [rows[0]]
    for x in rows[1:-1]:
        d = unlike(out[-1][2], x[2])
        if d is None or d >= least:
            out.append(x)
    d = unlike(out[-1][2], rows[-1][2])
    if d is not None and d < least and len(out) > 1:
        out[-1] = rows[-1]
    else:
        out.append(rows[-1])
    return out


@pytest.mark.parametrize("least", [0.0, 30.0, 60.0])
def test_thinned(spark, least):
    r, rows = random.Random(4), []
    for k in range(12):
        rows += [(k, t, 100 * k + t, r.choice([None, "", "111", *(f"{r.randrange(16):04b}" for _ in range(9))])) for t in range(k)]
    got = frames.thinned(spark.createDataFrame(rows, "k long, at long, id long, hash string").repartition(3), "k", least)
    want = [(k, t, i) for k in range(12) for t, i, _ in plain_thinned([x[1:] for x in rows if x[0] == k], least)]
    assert sorted(map(tuple, got.collect())) == sorted(want)


def test_hashes(spark):
    df = spark.createDataFrame([([1, 2, 2, 9], [0, 0, 255, 255]), ([5], [5]), ([], None)], "a array<int>, b array<int>")
    got = df.select(frames.difference_hash(F.col("a")).alias("h"), frames.luminance_difference(F.col("a"), F.col("b")).alias("l"), frames.hash_difference(frames.difference_hash(F.col("a")), frames.difference_hash(F.col("b"))).alias("d")).collect()
    assert [x.h for x in got] == ["101", "", ""]
    assert [None if x.l is None else round(x.l, 6) for x in got] == [round((1 + 2 + 253 + 246) / 4 / 255 * 100, 6), 0.0, None]
    assert got[0].d == 100.0 and got[1].d is None and got[2].d is None


def test_sink(spark, tmp_path):
    """Replays, repeated and null ids; only the days of a batch are read."""
    path, day = str(tmp_path / "table"), 86_400_000
    for rows in ([(1, 5), (2, day), (2, day), (None, 5)], [(2, day), (3, 3 * day)], [(2, day), (3, 3 * day)], [(None, 1)]):
        sink.append_once(spark.createDataFrame(rows, "id long, start_ms long"), path)
    assert sorted(r.id for r in spark.read.parquet(path).collect()) == [1, 2, 3]
    assert sorted(p.name for p in (tmp_path / "table").glob("day=*")) == ["day=0", "day=1", "day=3"]
    # the batch of day 1 doesn't read day 0: a broken file there does no harm
    for f in (tmp_path / "table/day=0").glob("*.parquet"):
        f.write_bytes(b"broken")
    sink.append_once(spark.createDataFrame([(2, day), (4, day + 1)], "id long, start_ms long"), path)
    assert sorted(r.id for r in spark.read.schema("id long, start_ms long, day long").parquet(path).where("day > 0").collect()) == [2, 3, 4]


def test_stream_into_sink(spark, tmp_path):
    src, path = tmp_path / "in", str(tmp_path / "out")
    rows = [(i, i * 30_000_000) for i in range(40)]
    for k in range(3):
        spark.createDataFrame(rows[k * 10 : k * 10 + 20], "id long, start_ms long").coalesce(1).write.parquet(str(src / str(k)))
    stream = spark.readStream.schema("id long, start_ms long").option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(str(src))
    for k in range(2):  # a second run without the checkpoint replays all
        q = stream.writeStream.foreachBatch(lambda batch, _: sink.append_once(batch, path)).option("checkpointLocation", str(tmp_path / f"c{k}")).trigger(availableNow=True).start()
        assert q.awaitTermination(120)
    assert sorted(r.id for r in spark.read.parquet(path).collect()) == list(range(40))


def test_export(spark, tmp_path):
    target, hour = str(tmp_path / "export"), 3_600_000
    table = lambda ends: spark.createDataFrame([(i, e) for i, e in enumerate(ends)], "id long, end_ms long")
    ids = lambda df: sorted(r.id for r in df.collect())
    assert sink.export_delta(table([]), target) is None and sink.stored_mark(spark, target + "/marks") is None
    assert ids(sink.export_delta(table([hour, 2 * hour, 9 * hour]), target)) == [0, 1, 2]
    assert sink.stored_mark(spark, target + "/marks") == 9 * hour
    assert sink.export_delta(table([hour, 2 * hour, 9 * hour]), target) is None
    assert ids(sink.export_delta(table([hour, 8 * hour - 1, 8 * hour, 10 * hour]), target)) == [2, 3]
    assert sink.stored_mark(spark, target + "/marks") == 10 * hour and list((tmp_path / "export/delta").glob("from=*/*.json.gz"))


def test_replies(spark):
    cases = {
        'Sure:\n```json\n{"a": 1}\n```\nand ```[2]```': '{"a": 1}', '```\n[1, 2]\n```': "[1, 2]", ' {"a": {"b": 2}} \n': '{"a": {"b": 2}}', 'x {"a": [1]} y': '{"a": [1]}', 'so [1, {"b": 2}] it is': '[1, {"b": 2}]',
        "```json\nnot it\n``` but {\"c\": 3}": '{"c": 3}', "no": None, "{broken": None, "": None, None: None, '"text"': None, "12": None, "[1] and {2": "[1]", "[1], [2]": None, "[1] and [2]": None, '{"a": 1} {"a": 2}': None,
    }
    df = spark.createDataFrame([(i, x) for i, x in enumerate(cases)], "i int, t string")
    got = [r.v for r in df.select("i", replies.reply_json(F.col("t")).alias("v")).orderBy("i").collect()]
    assert dict(zip(cases, got, strict=True)) == cases
    arrays = {'["a", "b"]': ["a", "b"], '["a", 1, null, {"x": 2}, "c"]': ["a", "c"], "[]": [], '{"a": 1}': [], "nope": [], None: [], '"a"': []}
    df = spark.createDataFrame([(i, x) for i, x in enumerate(arrays)], "i int, t string")
    assert [r.v for r in df.select("i", replies.string_array(F.col("t")).alias("v")).orderBy("i").collect()] == list(arrays.values())


@pytest.mark.parametrize("seed", [1, 2])
def test_leaked_tails(spark, seed):
    r = random.Random(seed)
    gray = lambda: r.choice([None, [], [r.choice([0, 40, 250]) for _ in range(2)], [r.choice([0, 40, 250]) for _ in range(2)], [r.choice([0, 3, 250]) for _ in range(2)], [9]])
    rows = [(k, t, 100 * k + t, gray()) for k in range(60) for t in range(r.randint(0, 7))]
    after = [(k, 50 + t, 9000 + 100 * k + t, gray()) for k in range(60) for t in range(r.randint(0, 4))]

    def apart(a, b):
        return None if not a or not b or len(a) != len(b) else sum(abs(x - y) for x, y in zip(a, b, strict=True)) / len(a) / 255 * 100

    want = []
    for k in range(60):
        own, nxt = ([x[3] for x in s if x[0] == k] for s in (rows, after))
        many = min(3, len(own) - 1)
        body, tail = own[: len(own) - many] if many > 0 else own, own[len(own) - many :] if many > 0 else []
        for back, g in enumerate(reversed(tail)):
            near = [[d for d in (apart(g, x) for x in refs) if d is not None] for refs in (nxt[:2], body[-2:])]
            if not all(near) or min(near[0]) - min(near[1]) >= -0.5:
                break
            want.append((k, 100 * k + len(own) - 1 - back))
    schema = "k long, at long, id long, gray array<int>"
    got = frames.leaked_tails(spark.createDataFrame(rows, schema).repartition(3), spark.createDataFrame(after, schema), ["k"])
    assert sorted(map(tuple, got.collect())) == sorted(want) and want


@pytest.mark.parametrize("most,least", [(1, 0.0), (3, 0.0), (4, 40.0), (50, 0.0)])
def test_snapshots(spark, most, least):
    r = random.Random(most)
    rows = [(k, r.randint(0, 60), 100 * k + i, f"{r.randrange(16):04b}") for k in range(6) for i in range(3 * k)]
    asked = [(k, r.randint(-5, 70)) for k in range(8) for _ in range(7)]
    want = []
    for k in range(6):
        own = {}
        for _, t, i, h in sorted(x for x in rows if x[0] == k):
            own.setdefault(t, (t, i, h))
        if own:
            times = {min(own), max(own)} | {min(own, key=lambda t: (abs(t - a), t)) for g, a in asked if g == k}
            thin = plain_thinned([own[t] for t in sorted(times)], least)
            n = len(thin)
            if n > most:
                slots = max(most - 2, 0)
                places = {0} | ({n - 1} if most > 1 else set()) | {int(j * (n - 3) / max(slots - 1, 1) + 0.5) + 1 for j in range(slots)}
                thin = [thin[p] for p in sorted(places)]
            want += [(k, t, i) for t, i, _ in thin]
    schema = "k long, at long, id long, hash string"
    got = frames.snapshots(spark.createDataFrame(rows, schema).repartition(3), spark.createDataFrame(asked, "k long, t long"), "k", most, least)
    assert sorted(map(tuple, got.collect())) == sorted(want)
