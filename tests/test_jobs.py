"""The ledger of jobs: each rule, and jobs of the table by the query's SQL (see test_queries)."""

from tidemark.streaming import jobs

EVENTS = "day long, at long, id long, what string, error string"


def state(*steps, most=3):
    m = jobs.JobMachine(most, 100)
    for i, (at, what, *error) in enumerate(steps):
        m.take((at, i, what, error[0] if error else None))
    return m.end()[0] if m.end() else None


def test_rules():
    assert state((0, "claim")) is None
    assert state((0, "enqueue"), (5, "enqueue")) == ("pending", 0, 0, None, None, None, None)
    assert state((0, "enqueue"), (5, "claim"), (9, "complete")) == ("completed", 1, 0, 5, 9, None, None)
    assert state((0, "enqueue"), (5, "claim"), (6, "claim"), (9, "fail", "x")) == ("pending", 1, 0, 5, None, 109, "x")
    assert state((0, "enqueue"), (5, "claim"), (9, "fail", "x"), (50, "claim")) == ("pending", 1, 0, 5, None, 109, "x")
    assert state((0, "enqueue"), (5, "claim"), (9, "fail", "x"), (109, "claim"), (110, "complete")) == ("completed", 2, 0, 109, 110, None, None)
    assert state((0, "enqueue"), (5, "claim"), (9, "fail", "x"), most=1) == ("failed", 1, 0, 5, None, None, "x")
    assert state((0, "enqueue"), (5, "claim"), (9, "release", "busy"), (10, "claim")) == ("running", 1, 0, 10, None, None, "busy")
    assert state((0, "enqueue"), (5, "claim"), (9, "restart")) == ("pending", 1, 0, 5, None, None, "interrupted")
    assert state((0, "enqueue"), (5, "claim"), (9, "restart"), most=1) == ("failed", 1, 0, 5, None, None, "interrupted")
    assert state((0, "enqueue"), (5, "claim"), (9, "complete"), (10, "fail", "x"), (11, "claim")) == ("completed", 1, 0, 5, 9, None, None)


def test_states(spark):
    rows = [(1, 0, 0, "enqueue", None), (1, 5, 1, "claim", None), (2, 5, 3, "claim", None), (2, 5, 2, "enqueue", None), (3, 0, 0, "claim", None), (4, 1, 0, "enqueue", None), (4, 2, 1, "noise", None), (None, 1, 0, "enqueue", None)]
    df = spark.createDataFrame(rows, EVENTS).repartition(3)
    got = jobs.job_states(df, ["day"])
    assert sorted((r.day or -1, r.status, r.attempts) for r in got.collect()) == [(-1, "pending", 0), (1, "running", 1), (2, "running", 1), (4, "pending", 0)]
    assert tuple(jobs.status_totals(got).first()) == (2, 2, 0, 0, 0)
    assert tuple(jobs.status_totals(got.limit(0)).first()) == (0, 0, 0, 0, None)
