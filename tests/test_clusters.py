"""The store of clusters: odd rows and empty sides."""

from tidemark.operators import clusters


def test_pruned(spark):
    own = spark.createDataFrame([(1, "a"), (2, "b"), (3, None)], "cluster long, label string")
    members = spark.createDataFrame([(1, 10), (1, 11), (2, 20), (3, 30)], "cluster long, id long")
    left = spark.createDataFrame([(10, 5), (30, 1), (30, 1)], "id long, start_ms long")
    p = clusters.pruned(own, members, members.select("id"), left)
    assert sorted(map(tuple, p.memberships.select("cluster", "id").collect())) == [(1, 10), (3, 30)]
    assert sorted(r.id for r in p.signatures.collect()) == [10, 30]
    assert sorted(r.cluster for r in p.clusters.collect()) == [1, 3] and [r.cluster for r in p.touched.collect()] == [1]
    assert [tuple(r) for r in clusters.recurring_labels(own, members).collect()] == [(1, "a", 2)]
    assert clusters.pruned(own, members, members.select("id"), left.limit(0)).clusters.count() == 0
    assert sorted((r.cluster, r.id, r.place) for r in clusters.digest(members, left.distinct()).collect()) == [(1, 10, 1), (3, 30, 1)]
    assert [r.id for r in clusters.digest(members, left.distinct(), 3).collect()] == [30]


def test_cited(spark):
    told = spark.createDataFrame([(1, ["c", "a", "x", "a"], "t"), (1, ["x"], "u"), (2, ["a"], "v"), (1, [], "w"), (1, None, "z"), (1, ["a"], "t")], "day long, ids array<string>, title string")
    known = spark.createDataFrame([(1, "a"), (1, "c"), (1, "c"), (3, "x")], "day long, id string")
    assert sorted((r.title, r.ids) for r in clusters.cited(told, known, ["day"]).collect()) == [("t", ["a"]), ("t", ["c", "a"])]


def test_lists_and_aliases(spark):
    parts = spark.createDataFrame([(1, [3, 1], None), (1, [2, 3, None], ["b"]), (2, [], [])], "k long, a array<int>, b array<string>")
    assert sorted((r.k, r.a, r.b) for r in clusters.merged_lists(parts, ["k"], ["a", "b"]).collect()) == [(1, [1, 2, 3], ["b"]), (2, [], [])]
    rows = spark.createDataFrame([(1, 0, "z"), (1, 1, "y"), (1, 2, "z"), (2, 0, "y"), (1, 1, "b"), (1, 5, None)], "g long, pos long, id string")
    names = clusters.aliases(rows, ["g"], ["pos"])
    assert sorted(map(tuple, names.collect())) == [(1, "b", "a2"), (1, "y", "a3"), (1, "z", "a1"), (2, "y", "a1")]
    said = spark.createDataFrame([(1, " A1 "), (1, "a9"), (2, "a1"), (2, None)], "g long, alias string")
    assert sorted((r.g, r.id) for r in clusters.unaliased(said, names, ["g"]).collect()) == [(1, "z"), (2, "y")]
