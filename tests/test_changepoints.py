"""Change points against a plain fold, in any order of arrival."""

import random

import pytest
from pyspark.sql import functions as F

from epochal.operators import asof, changepoints, intervals, series


def fold(rows):
    """[(t, state)] in time order -> the points at which the state changed."""
    out = []
    for t, s in sorted(rows):
        if not out or out[-1][1] != s:
            out.append((t, s))
    return out


def test_any_order_gives_the_series_of_time(spark):
    rng = random.Random(20260906)
    rows = [(k, t, rng.choice(["A", "B", None])) for k in range(40) for t in rng.sample(range(60), rng.randrange(1, 14))]
    shuffled = rows + rng.sample(rows, len(rows) // 2)
    rng.shuffle(shuffled)
    cut = sorted(rng.sample(range(len(shuffled)), 3))
    parts = [shuffled[a:b] for a, b in zip([0, *cut], [*cut, None])]
    schema = "k int, t long, s string"
    merged = changepoints.merge_observations(*[spark.createDataFrame(p, schema) for p in parts], key=["k", "t"])
    got = {}
    for r in changepoints.change_points(merged, ["k"], "t", ["s"]).collect():
        got.setdefault(r.k, []).append((r.t, r.s))
    want = {}
    for k, t, s in rows:
        want.setdefault(k, []).append((t, s))
    key = lambda x: (x[0], x[1] or "")
    plain = {}
    for k, v in want.items():
        out = []
        for t, s in sorted(v, key=key):
            if not out or out[-1][1] != s:
                out.append((t, s))
        plain[k] = out
    assert {k: sorted(v, key=key) for k, v in got.items()} == plain
    points = changepoints.change_points(merged, ["k"], "t", ["s"])
    assert changepoints.unchanged_neighbours(points, ["k"], "t", ["s"]).count() == 0


def test_presence_without_a_grid(spark):
    seen = spark.createDataFrame([("p", 1), ("p", 2), ("p", 5), ("q", 3)], "k string, run int")
    got = sorted((r.k, r.run, r.present) for r in changepoints.presence_points(seen, ["k"], "run", 5).collect())
    assert got == [("p", 1, True), ("p", 3, False), ("p", 5, True), ("q", 3, True), ("q", 4, False)]
    runs = changepoints.present_runs(changepoints.presence_points(seen, ["k"], "run", 5), ["k"], "run", 5)
    assert sorted(map(tuple, runs.collect())) == [("p", 1), ("p", 2), ("p", 5), ("q", 3)]


def test_conflicts_are_named(spark):
    rows = spark.createDataFrame([(1, 5, "A"), (1, 5, "A"), (2, 5, "A"), (2, 5, None)], "k int, t long, s string")
    assert [(r.k, r.t) for r in changepoints.conflicts(rows, ["k"], "t", ["s"]).collect()] == [(2, 5)]


def test_asof_ties_and_gaps(spark):
    left = spark.createDataFrame([(1, 5), (1, 9), (2, 1)], "k int, t long")
    right = spark.createDataFrame([(1, 5, "a"), (1, 7, "b"), (1, 10, "c")], "k int, t long, s string")
    got = sorted((r.k, r.t, r.s) for r in asof.asof(left, right, ["k"], "t", ["s"]).where("k = 1").collect())
    assert got == [(1, 5, "a"), (1, 9, "b")]
    assert asof.asof(left, right, ["k"], "t", ["s"]).where("k = 2").first().s is None


def test_nearest_prefers_the_earlier(spark):
    left = spark.createDataFrame([(1, 10), (1, 100)], "k int, t long")
    right = spark.createDataFrame([(1, 8, "a"), (1, 12, "b")], "k int, t long, s string")
    got = {r.t: (r.s, r.distance) for r in asof.nearest(left, right, ["k"], "t", ["s"], 5).collect()}
    assert got == {10: ("a", 2), 100: (None, None)}


@pytest.mark.parametrize(
    ("prices", "listed", "window", "want"),
    [
        ([(1, 100), (5, 80), (9, 120)], [(1, True)], (6, 12), (80, 120)), ([(1, 100), (5, 80), (9, 120)], [(1, True)], (9, 9), (120, 120)), ([(1, 100), (5, 80), (9, 120)], [(1, True)], (5, 5), (80, 80)),
        ([(1, 100), (8, 300)], [(1, True), (3, False), (8, True)], (3, 7), None), ([(1, 100), (8, 300)], [(1, True), (3, False), (8, True)], (4, 9), (300, 300)), ([(1, 100), (8, 300)], [(1, True), (3, False), (8, True)], (0, 9), (100, 300)),
        ([(1, 100), (4, None), (7, 50)], [(1, True)], (4, 6), None), ([(1, 100), (4, None), (7, 50)], [(1, True)], (2, 8), (50, 100)),
    ],
)
def test_window_statistics(spark, prices, listed, window, want):
    p = spark.createDataFrame([(1, *x) for x in prices], "k int, t long, cents long")
    q = spark.createDataFrame([(1, *x) for x in listed], "k int, t long, present boolean")
    start, end = window
    spans = intervals.listed_spans(p, q, ["k"], "t", ["cents"], F.lit(100))
    r = intervals.window_stats(spans, ["k"], "cents", "cents", F.lit(end), {"w": end - start}).first()
    assert (None if r is None or r.min_w is None else (r.min_w, r.max_w)) == want


def test_estimated_sales_of_a_known_series(spark):
    counts = [150, 149, 145, 142, 127, 138, 134, 130]
    rows = spark.createDataFrame([(1, t, q) for t, q in enumerate(counts)], "k int, t long, quantity long")
    r = series.estimated_sales(rows, ["k"], "t", F.lit(0), F.lit(100)).first()
    assert (r.sold, r.decreases, r.added, r.at_least, r.since) == (31, 6, 11, 0, 0)


def test_unknown_counts_break_steps_and_stock_outs_read_as_zero(spark):
    counts = spark.createDataFrame([(1, 0, 5), (1, 1, None), (1, 2, 3), (1, 3, None)], "k int, t long, quantity long")
    state = spark.createDataFrame([(1, 3, "out_of_stock")], "k int, t long, availability string")
    r = series.estimated_sales(series.read_counts(counts, state, ["k"], "t"), ["k"], "t", F.lit(0), F.lit(9), 3).first()
    assert (r.sold, r.decreases, r.at_least) == (3, 1, 1)


def test_tasks_of_series_follow_the_table(spark, monkeypatch):
    from epochal.plans import temporal
    from epochal.sources import tables

    monkeypatch.setattr(tables, "TASK_ROWS", 500)
    for rows in (tables.daily_prices(spark, "/root/testdata/sf0.001"), temporal.offer_presence(spark, "/root/testdata/sf0.001")):
        assert rows.rdd.getNumPartitions() >= 12
