"""Statistics of runs, gaps, first hits after and summaries on small fixtures."""

from pyspark.sql import functions as F

from epochal.operators import asof, changepoints, imports, intervals


def rows_of(df, *cols):
    return sorted(tuple(r[c] for c in cols) for r in df.collect())


def test_run_statistics(spark):
    rows = spark.createDataFrame([("a", 1, 5), ("a", 2, 5), ("a", 4, None), ("b", 2, None), ("b", 3, None)], "k string, run int, v int")
    got = imports.run_statistics(rows, ["k"], "run", ["v"])
    assert rows_of(got, "run", "items", "fresh", "returned", "changed") == [(1, 1, 1, 0, 0), (2, 2, 1, 0, 0), (3, 1, 0, 0, 0), (4, 1, 0, 1, 1)]


def test_gaps(spark):
    rows = spark.createDataFrame([("a", 1, 3), ("a", 4, 5), ("a", 9, 9), ("b", 2, 2)], "k string, start long, stop long")
    assert rows_of(intervals.gaps(rows, ["k"]), "k", "start", "stop") == [("a", 6, 8)]


def test_first_after_is_strict_and_bounded(spark):
    rows = spark.createDataFrame([("a", 1, "x"), ("a", 1, "y"), ("a", 4, "y"), ("a", 20, "x"), ("b", 2, "x")], "k string, t long, e string")
    got = asof.first_after(rows, ["k"], "t", F.col("e") == "y", 10, "n").where("e = 'x'")
    assert {(r.k, r.t, r.n) for r in got.collect()} == {("a", 1, 4), ("a", 20, None), ("b", 2, None)}


def test_leading_absence_and_latest(spark):
    p = spark.createDataFrame([("a", 1, 1, False), ("a", 1, 2, True), ("a", 2, 3, False), ("b", 1, 4, False)], "k string, t long, i int, present boolean")
    assert rows_of(changepoints.drop_leading_absent(p, ["k"], "t", "present", ["i"]), "k", "i") == [("a", 2), ("a", 3)]
    s = spark.createDataFrame([("a", 1, 1, 5), ("a", 2, 9, 7), ("a", 2, 8, 9)], "k string, run int, offer int, v int")
    assert rows_of(imports.latest_summary(s, ["k"], "run", ["offer", "v"]), "k", "run", "offer", "v") == [("a", 2, 8, 9)]
