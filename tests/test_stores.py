"""Nulls, ties and empty inputs of stored rows, and check digits of known numbers."""

from pyspark.sql import functions as F

from tidemark.functions import checks
from tidemark.operators import stores
from tidemark.plans.stores import check_digits

LEDGER = "day long, status string, attempts long, next_ms long, started_ms long"


def test_lookups(spark):
    rows = spark.createDataFrame([(1, 5), (2, None), (None, 9)], "id long, start_ms long")
    assert [r.id for r in stores.by_ids(rows, "id", [2, 2, 8]).collect()] == [2]
    assert stores.by_ids(rows, "id", []).collect() == []
    present = lambda r, lo, hi: stores.has_between(r, "start_ms", lo, hi).first().present
    assert (present(rows, 5, 5), present(rows, 6, 8), present(rows.limit(0), 0, 9)) == (True, False, False)
    tied = spark.createDataFrame([(1, "a", 4), (2, "a", 4), (3, "a", 9), (4, None, 4)], "id long, k string, start_ms long")
    assert sorted((r.id, r.turn) for r in stores.newest(tied, ["k"], 0, 8, 1).collect()) == [(1, 1), (4, 1)]


def test_claims(spark):
    rows = [(3, "pending", 0, None, None), (2, "pending", 1, 50, None), (1, "completed", 1, None, 7), (None, "pending", 0, None, None)]
    ledger = spark.createDataFrame(rows, LEDGER)
    got = {r.day: (r.status, r.attempts, r.started_ms) for r in stores.claimed(ledger, 40).collect()}
    assert got == {3: ("running", 1, 40), 2: ("pending", 1, None), 1: ("completed", 1, 7), None: ("pending", 0, None)}
    assert {r.day for r in stores.claimed(ledger, 50).where("status = 'running'").collect()} == {2}
    assert stores.claimed(ledger.where("day = 1"), 40).first().status == "completed"
    assert stores.next_claimable(ledger).first().next_ms == 0
    assert stores.next_claimable(ledger.limit(0)).first().next_ms is None


def test_updates(spark):
    rows = spark.createDataFrame([(1, "a"), (2, "b"), (None, "c")], "k int, v string")
    changes = spark.createDataFrame([(1, "z"), (2, None), (9, "y")], "k int, v string")
    assert sorted(r.v for r in stores.updated(rows, changes, "k", "v").collect()) == ["b", "c", "z"]


def test_carried_prefix(spark):
    steps = spark.createDataFrame([(1, 1, "go"), (1, 2, "Mail: open"), (1, 3, "send"), (1, 4, None), (2, 1, "x")], "k int, i int, s string")
    got = sorted((r.k, r.i, r.s) for r in stores.carried_prefix(steps, "k", "i", "s").where("s is not null").collect())
    assert got == [(1, 1, "go"), (1, 2, "Mail: open"), (1, 3, "Mail: send"), (2, 1, "x")]


def test_check_digits(spark):
    row = spark.sql("SELECT '123 456 782' AS tfn, '51 824 753 556' AS abn, '004 085 616' AS acn, '2123 45670 1' AS medicare, '' AS none")
    every = [checks.passes_tfn, checks.passes_abn, checks.passes_acn, checks.passes_medicare]
    assert tuple(row.select(*(f(F.col(c)) for f, c in zip(every, row.columns))).first()) == (True, True, True, True)
    assert tuple(row.select(*(f(F.col("none")) for f in every)).first()) == (False, False, False, False)


def test_new_zealand_numbers(spark):
    rows = spark.createDataFrame([("49-091-850", "ZZZ0016"), ("136410132", "jbx 3656"), ("9125568", "ZZZ0044"), ("49091851", "ZIZ0016"), ("", ""), (None, None)], "ird string, nhi string").coalesce(1)
    got = [tuple(r) for r in rows.select(checks.passes_ird(F.col("ird")), checks.passes_nhi(F.col("nhi"))).collect()]
    assert got[:5] == [(True, True), (True, True), (False, False), (False, False), (False, False)]
    assert not any(got[5])


def test_check_digits_of_numbers_beyond_their_kind(spark, tmp_path):
    """The query looks at check digits alone, as its SQL does, also where keys make numbers longer than their kinds."""
    keys = [0, 7, 5_135_147, 5_135_209, 6_400_000, *range(8_990_000, 8_990_300), *range(10_110_000, 10_110_400), 36_000_000]
    spark.createDataFrame([(k,) for k in keys], "o_orderkey long").write.parquet(str(tmp_path / "orders.parquet"))
    dot = lambda digits, weights: sum(int(x) * w for x, w in zip(digits, weights, strict=False))
    want = {}
    for k in keys:
        v, i = str(20_000_000_000 + k * 7919), str(10_000_000 + k * 37)
        t, base = v[2:11], i[:-1].rjust(8, "0")[:8]
        first, second = ((11 - dot(base, w) % 11) % 11 for w in (checks.IRD, checks.IRD_SECOND))
        acn = (10 - dot(t, checks.ACN) % 10) % 10 == int(t[8])
        want[k] = ((second if first == 10 else first) == int(i[-1]), dot(t, checks.TFN) % 11 == 0, (dot(v, checks.ABN) - 10) % 89 == 0, acn, dot(v, checks.MEDICARE) % 10 == int(v[8]))
    got = {r.o_orderkey: (r.ird, r.tfn, r.abn, r.acn, r.medicare) for r in check_digits(spark, str(tmp_path)).collect()}
    assert got == want
    assert all(any(x[c] for k, x in want.items() if k > 8_000_000) for c in range(5))
