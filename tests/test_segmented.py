"""Entities that are cut into parts, hubs, common codes and streams with neighbour state, against the plain forms."""

import random

import pytest
from pyspark.sql import functions as F

from epochal.operators import asof, changepoints, graph, intervals, matching, segmented
from epochal.streaming import neighbours

KEY = ["k"]


@pytest.fixture
def hot(spark):
    """(k, t, state, value): one entity holds half of all rows; some times are repeated, states and values may be null."""
    rng = random.Random(7)
    rows = {(0 if i % 2 else 1 + i % 37, rng.randrange(4000)) for i in range(3000)}
    rows = [(k, t, rng.choice(["a", "b", None]), rng.choice([1, 2, 2, None])) for k, t in rows]
    return spark.createDataFrame(rows, "k int, t long, state string, value int").repartition(5)


def same(a, b):
    columns = sorted(a.columns)
    assert sorted(map(repr, a.select(columns).collect())) == sorted(map(repr, b.select(columns).collect()))


@pytest.mark.parametrize("most", [60, 10**6])
def test_cut_entities_give_the_plain_result(spark, hot, most):
    same(segmented.change_points(hot, KEY, "t", ["state", "value"], most=most), changepoints.change_points(hot, KEY, "t", ["state", "value"]))
    points = changepoints.change_points(hot, KEY, "t", ["value"])
    same(segmented.spans(points, KEY, "t", F.lit(5000), most), intervals.spans(points, KEY, "t", F.lit(5000)))
    presence = hot.where("t % 3 = 0").select("k", (F.col("t") + F.col("t") % 2).alias("t"), (F.col("state") == "a").alias("present")).where("present is not null").dropDuplicates(["k", "t"])
    same(segmented.listed_spans(points, presence, KEY, "t", ["value"], F.lit(5000), most), intervals.listed_spans(points, presence, KEY, "t", ["value"], F.lit(5000)))
    left = hot.where("t % 5 = 0").select("k", "t", F.lit("x").alias("mark"))
    same(segmented.asof(left, points, KEY, "t", ["value"], most), asof.asof(left, points, KEY, "t", ["value"]))
    spans = intervals.spans(points, KEY, "t", F.lit(5000)).withColumn("half", F.col("value") > 1).select("k", "start", "stop", "half")
    same(segmented.islands(spans, KEY, ["half"], most), intervals.islands(spans, KEY, ["half"]))


def test_parts_of_a_hot_entity_are_even_and_empty_tables_stay_empty(spark, hot):
    rows = segmented.cut(hot, KEY, "t", 200)
    sizes = [r["count"] for r in rows.groupBy("k", segmented.PART).count().collect()]
    assert max(sizes) <= 200 and len([1 for r in rows.select("k", segmented.PART).distinct().collect() if r.k == 0]) >= 7
    assert {r[segmented.PART] for r in rows.where("k > 0").select(segmented.PART).distinct().collect()} == {0}
    assert segmented.change_points(hot.limit(0), KEY, "t", ["state"], most=1).count() == 0


def test_parts_spread_over_tasks(spark):
    """One entity with half of the rows: no task sorts more than twice the median."""
    rows = spark.range(200_000).select(F.when(F.col("id") % 2 == 0, 0).otherwise(F.col("id")).alias("k"), F.col("id").alias("t"), (F.col("id") % 7).alias("v"))
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        sized = segmented.cut(rows, KEY, "t", 4_000).repartition(16, "k", segmented.PART).groupBy(F.spark_partition_id()).count().collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
    sizes = sorted(r["count"] for r in sized)
    assert sizes[-1] <= 2 * sizes[len(sizes) // 2]


# ---- hubs ------------------------------------------------------------------------------------------------------------


def test_hubs_are_split_with_the_same_components(spark, monkeypatch):
    monkeypatch.setattr(graph, "HUB", 8)
    rng = random.Random(1)
    edges = [(0, i) for i in range(1, 200)] + [(1000 + i, 1001 + i) for i in range(50)] + [(2000, rng.randrange(2001, 2100)) for _ in range(300)] + [(199, 2000)]
    got = {r.node: r.component for r in graph.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert {got[i] for i in range(200)} == {0} and got[2000] == 0 and {got[1000 + i] for i in range(51)} == {1000}


def test_a_star_of_a_million_links_is_dealt_evenly(spark, monkeypatch):
    monkeypatch.setattr(graph, "HUB", 20_000)
    star = spark.range(1, 1_000_001).select(F.col("id").alias("v"), F.lit(0).cast("long").alias("u"))
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        sized = [r["count"] for r in graph.joined_to_least(star.select("u", "v"), 1_000_000).groupBy(F.spark_partition_id()).count().collect()]
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert sum(sized) == 1_000_000 and max(sized) <= 2 * sorted(sized)[len(sized) // 2]


# ---- common codes ----------------------------------------------------------------------------------------------------


def test_classes_stand_for_all_pairs(spark):
    rng = random.Random(3)
    rows = [(i, rng.randrange(4), rng.choice(["m1", "m2", "", None]), ["AB-12"] if i % 3 else ["AB-12", "ZZ-99"]) for i in range(120)]
    listings = spark.createDataFrame(rows, "id int, store int, maker string, codes array<string>")
    pairs, members = matching.common_code_candidates(listings, most=10)
    want = {(r.a, r.b, k) for r in matching.key_pairs(matching.coded(listings)).collect() for k in r["keys"]}
    got = [(r.a, r.b, r.key) for r in matching.expanded(pairs, members).collect()]
    assert len(got) == len(set(got)) and set(got) == want and len(want) > 1000
    assert matching.code_candidates(listings, most=10).count() == 0


def test_a_code_of_very_many_listings_makes_few_rows(spark):
    n = 100_000
    listings = spark.range(n).select("id", (F.col("id") % 5).cast("int").alias("store"), F.when(F.col("id") % 11 != 0, F.concat(F.lit("m"), (F.col("id") % 2000).cast("string"))).alias("maker"), F.array(F.lit("0000-0")).alias("codes"))
    pairs, members = matching.common_code_candidates(listings)
    assert members.count() == n and pairs.count() < 3 * n


# ---- streams ---------------------------------------------------------------------------------------------------------


def test_times_know_their_neighbours_and_write_little():
    rng = random.Random(2)
    store, writes = {}, []
    times = neighbours.Times(lambda *k: store.get(k), lambda level, prefix, v: (writes.append(level), store.__setitem__((level, prefix), v)))
    have, most = [], []
    for i in range(3000):
        t = rng.choice([rng.randrange(-50, 50), rng.randrange(10**12), -(2**63) + rng.randrange(3), 2**63 - 1 - rng.randrange(3)])
        want = (max((x for x in have if x < t), default=None), min((x for x in have if x > t), default=None)) if i % 50 == 0 else None
        if want:
            assert (times.beside(t, False), times.beside(t, True)) == want
        if not times.state(t)[0]:
            writes.clear()
            times.add(t, "s")
            most.append(len(writes))
            have.append(t)
    assert max(most[100:]) <= neighbours.LEVELS + 1 and sum(most[-200:]) <= 1.1 * sum(most[100:300])


def test_late_observations_change_what_a_batch_would():
    rng = random.Random(5)
    for _ in range(30):
        store, stands, told = {}, {}, {}
        times = neighbours.Times(lambda *k: store.get(k), lambda level, prefix, v: store.__setitem__((level, prefix), v))
        for _ in range(40):
            t, s = rng.randrange(30), rng.choice(["A", "B", None])
            told.setdefault(t, s)
            for at, state, added in neighbours.insert(times, t, s):
                stands[at] = state
                if not added:
                    del stands[at]
        rows = sorted(told.items())
        assert stands == {t: s for i, (t, s) in enumerate(rows) if i == 0 or rows[i - 1][1] != s}


def test_stream_with_neighbour_state_equals_batch(spark, tmp_path):
    rng = random.Random(4)
    rows = [(k, t, rng.choice("AB")) for k in range(5) for t in rng.sample(range(40), 12)]
    rng.shuffle(rows)
    for i in range(3):
        spark.createDataFrame(rows[i * 20 : i * 20 + 25], "key int, t long, state string").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    with neighbours.state_store(spark, 3):
        stream = spark.readStream.schema("key int, t long, state string").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
        q = neighbours.updates(stream).writeStream.foreachBatch(neighbours.batches_into(f"{tmp_path}/out")).outputMode("update")
        assert q.trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "c")).start().awaitTermination(120)
    got = neighbours.settled(spark.read.parquet(str(tmp_path / "out")))
    used = {r for i in range(3) for r in rows[i * 20 : i * 20 + 25]}
    same(got, changepoints.change_points(spark.createDataFrame(sorted(used), "key int, t long, state string"), ["key"], "t", ["state"]))


@pytest.mark.parametrize("block", [4, 512])
def test_blocks_change_what_a_batch_would(monkeypatch, block):
    monkeypatch.setattr(neighbours, "BLOCK", block)
    rng = random.Random(6)
    for _ in range(40):
        store, stands, told, count = {}, {}, {}, 0
        edge = rng.choice([0, -(2**63), 2**63 - 60])
        for _ in range(12):
            rows = sorted(((edge + rng.randrange(60), rng.choice(["A", "B", None])) for _ in range(rng.randrange(1, 12))), key=lambda r: r[0])
            for t, s in rows:
                told.setdefault(t, s)
            for t, s, added, n in neighbours.Blocks(lambda *k: store.get(k), lambda level, prefix, v: store.__setitem__((level, prefix), v)).insert(rows):
                count += 1
                assert n == count and added != (t in stands)
                stands[t] = s
                if not added:
                    del stands[t]
            want = sorted(told.items())
            assert stands == {t: s for i, (t, s) in enumerate(want) if i == 0 or want[i - 1][1] != s}


def test_a_batch_reads_and_writes_an_entity_once():
    store, reads, writes = {}, [], []
    put = lambda level, prefix, v: (writes.append(level), store.__setitem__((level, prefix), v))
    insert = lambda rows: neighbours.Blocks(lambda *k: (reads.append(k), store.get(k))[1], put).insert(rows)
    for k in range(4):
        reads.clear(), writes.clear()
        insert([(t, "AB"[t % 2]) for t in range(k, 400, 4)])
        assert len(reads) == len(writes) == 1
    reads.clear(), writes.clear()
    assert insert([(t, "A") for t in range(0, 400, 2)]) == [] and len(reads) == 1 and not writes  # known already
    insert([(t * 10, "AB"[t % 2]) for t in range(100, 60_000)])
    reads.clear(), writes.clear()
    assert [r[:3] for r in insert([(300_001, "B")])] == [(300_001, "B", True), (300_010, "B", False)]
    assert len(reads) < 4 * neighbours.LEVELS and len(writes) <= 2 and max(len(v[1] or "") for v in store.values()) < 20 * neighbours.BLOCK


def test_no_row_carries_or_walks_all_cuts(spark, hot):
    plan = segmented.cut(hot, KEY, "t", 20)._jdf.queryExecution().optimizedPlan().toString()
    assert "__cuts" in plan and "lambda" not in plan
    assert plan.count("percentile") == 0  # cuts are found once
