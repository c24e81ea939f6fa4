"""Scores of detections against golden sets: every bucket, ties, empty sides."""

from tidemark.operators import scores

GOLD, FOUND = "fixture string, g long, verdict string, item long", "fixture string, d long, item long"


def rows(sets, *more):
    return [(f, i, *([v] if v else []), x) for f, i, v, items in sets for x in items]


def test_buckets(spark):
    golden = [("a", 1, "keep", [1, 2, 3, 4]), ("a", 2, "keep", [5, 6]), ("a", 3, "keep", [90, 91]), ("a", 4, "reject", [10, 11]), ("a", 5, "unreviewed", [20, 21]), ("b", 6, "reject", [1])]
    detected = [
        ("a", 1, None, [1, 2, 5, 6, 100]), ("a", 2, None, [3, 4]), ("a", 3, None, [10, 11]), ("a", 4, None, [10]), ("a", 5, None, [20]), ("a", 6, None, [77, 78, 78]), ("a", 7, None, [1]), ("c", 8, None, [1]),
    ]
    g, d = spark.createDataFrame(rows(golden) * 2, GOLD), spark.createDataFrame(rows(detected), FOUND)
    got = {r.fixture: r.asDict() for r in scores.task_scores(g, d).collect()}
    a = got["a"]
    assert (a["positives"], a["found"], a["recall"], a["negatives"], a["rejected_again"]) == (3, 2, round(2 / 3, 6), 1, 1)
    assert (a["detections"], a["explained"], a["bundled"], a["rejects"], a["unreviewed"], a["new"], a["grazes"]) == (7, 1, 1, 2, 1, 1, 2)
    assert (a["cited"], a["cited_keep"], a["cited_reject"], a["id_precision"]) == (14, 7, 3, 0.5)
    assert (a["recall_of_found"], a["precision"], a["iou"]) == (0.75, 0.4, round((2 / 7 + 2 / 5) / 2, 6))
    assert got["b"]["negatives"] == 1 and got["b"]["recall"] == 0 and got["b"]["id_precision"] is None and got["b"]["iou"] is None
    assert got["c"]["new"] == 1 and got["c"]["positives"] == 0
    means = scores.mean_scores(scores.task_scores(g, d), ["recall", "iou"]).first()
    assert (means["rows"], means["recall"], means["iou"]) == (3, round(2 / 9, 6), a["iou"])
    assert scores.task_scores(g.limit(0), d.limit(0)).count() == 0
    assert scores.mean_scores(scores.task_scores(g.limit(0), d.limit(0)), ["iou"]).first().iou is None
