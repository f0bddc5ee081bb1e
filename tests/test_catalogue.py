"""Imports, matching, graphs and comparison on small fixtures."""

import html
import random

import pytest
from pyspark.sql import functions as F

from epochal.operators import alerts, compare, graph, imports, matching
from epochal.plans import catalogue


def rows_of(df, *cols):
    return sorted(tuple(r[c] for c in cols) for r in df.collect())


def test_run_comparison_thresholds_are_strict(spark):
    def compare_counts(before, now):
        b = spark.createDataFrame([(i, 1) for i in range(before)], "k int, v int")
        n = spark.createDataFrame([(i, 1) for i in range(now)], "k int, v int")
        return imports.compare_runs(b, n, ["k"], "v").first()

    assert compare_counts(10, 8).drop_error == 0
    r = compare_counts(10, 7)
    assert (r.drop_error, r.missing_error, r.missing) == (1, 1, 3)


def test_price_changes_between_runs(spark):
    b = spark.createDataFrame([(i, 1) for i in range(10)], "k int, v int")
    for changed, error in ((3, 0), (4, 1)):
        n = spark.createDataFrame([(i, 2 if i < changed else 1) for i in range(10)], "k int, v int")
        assert imports.compare_runs(b, n, ["k"], "v").first().price_error == error


def test_issues_are_listed_up_to_a_cap_and_counted(spark):
    rows = spark.range(30)
    got = imports.issues(rows, "id", {"even": F.col("id") % 2 == 0, "never": F.lit(False), "unknown": F.lit(None).cast("boolean")}, listed=5)
    assert sum(r.n for r in got.collect()) == 15
    assert got.where("subject is null").first().n == 10


def test_upsert_keeps_first_and_last_and_the_newest_attributes(spark):
    known = spark.createDataFrame([("a", 5, 9, "old")], "k string, first_seen long, last_seen long, page string")
    seen = spark.createDataFrame([("a", 3, "late"), ("b", 4, "new")], "k string, t long, page string")
    assert rows_of(imports.upsert_seen(known, seen, ["k"], "t", ["page"]), "k", "first_seen", "last_seen", "page") == [("a", 3, 9, "old"), ("b", 4, 4, "new")]


def test_components_against_union_find(spark):
    rng = random.Random(3)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(220)] + [(i, i + 1) for i in range(1000, 1060)]
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        x, y = find(a), find(b)
        parent[max(x, y)] = min(x, y)
    got = {r.node: r.component for r in graph.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {n: find(n) for n in {x for e in edges for x in e}}
    assert graph.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_greedy_cover_and_rotation(spark):
    m = spark.createDataFrame([("a", 1), ("a", 2), ("a", 3), ("b", 3), ("b", 4), ("c", 4)], "g string, i int")
    cost = spark.createDataFrame([("a", 1), ("b", 1), ("c", 1)], "g string, cost int")
    assert rows_of(graph.greedy_cover(spark, m, cost, "g", "i", 9), "round", "g", "gain") == [(1, "a", 3), (2, "b", 1)]
    keys = spark.createDataFrame([(f"k{i}",) for i in range(40)], "key string")
    slices = [graph.rotation_slice(keys, "key", r, 5, 100) for r in range(5)]
    assert sum(s.count() for s in slices) == 40
    assert graph.fill_shards({5: 1, 4: 1, 3: 1}, 2) == {5: [(0, 1, 0)], 4: [(0, 1, 1)], 3: [(0, 1, 1)]}


def test_pairs_stay_within_blocks_and_makers(spark):
    rows = spark.createDataFrame([(1, 1, "M", "AB12"), (2, 2, "M", "AB12"), (3, 2, "N", "AB12"), (4, 3, "", "AB12"), (5, 1, "", "AB")], "id int, store int, maker string, code string")
    got = matching.code_candidates(rows.withColumn("codes", F.array("code")))
    assert rows_of(got, "a", "b") == [(1, 2), (1, 4), (2, 4), (3, 4)]
    tokens = rows.withColumn("tokens", F.array("code"))
    assert matching.token_pairs(tokens, most=3).count() == 0


def test_families_and_reviews(spark):
    m = spark.createDataFrame([("f", 1, 1, "x"), ("f", 2, 2, "y"), ("f", 3, 2, "x"), ("big", 4, 1, "x"), ("big", 5, 2, "y"), ("big", 6, 3, "z"), ("big", 7, 3, "q")], "family string, id int, store int, variant string")
    got = matching.family_pairs(m, most=3)
    assert rows_of(got.where("a is not null"), "family", "a", "b") == [("f", 1, 2)]
    assert got.where("a is null").first().family == "big"
    c = spark.createDataFrame([(1, "p"), (2, "p"), (3, "p")], "k int, fingerprint string")
    r = spark.createDataFrame([(1, "p", "accepted"), (2, "old", "accepted"), (9, "p", "rejected")], "k int, fingerprint string, decision string")
    assert rows_of(matching.apply_reviews(c, r, ["k"]), "k", "decision") == [(1, "accepted"), (2, "stale"), (3, "pending")]
    assert matching.orphan_reviews(c, r, ["k"]).count() == 1


def test_comparison_fails_closed_and_in_order(spark):
    base = dict(kind="same_product", status="verified", loaded=True, own_matches=True, other_matches=True, policy=True, own_offers=1, other_offers=1, own_listed=True, other_listed=True, own_offer_reviewed=True, other_offer_reviewed=True, own_currency="JPY", other_currency="JPY", same_basis=True, newest_at=1, verified_at=1, stale=False)
    cases = [({}, None), ({"kind": "similar_product", "stale": True}, "not the same product"), ({"loaded": None}, "not loaded"), ({"other_currency": "USD"}, "another basis"), ({"newest_at": 91 * 86_400_000}, "review expired"), ({"stale": True}, "stale")]
    for change, want in cases:
        values = base | change
        row = spark.range(1).select(*[(F.lit(v) if v is not None else F.lit(None).cast("boolean")).alias(k) for k, v in values.items()])
        assert row.select(compare.eligibility(compare.comparison_rules()).alias("r")).first().r == want


def test_cheapest_keeps_ties_and_yields_to_a_cheaper_viewed_offer(spark):
    rows = spark.createDataFrame([(1, "a", -5, 0, None), (1, "b", -5, 0, None), (1, "c", -9, 2, None), (2, "d", 3, 0, None), (3, "e", -1, 0, "stale")], "k int, o string, difference long, tier int, reason string")
    assert rows_of(compare.cheapest(rows, ["k"]), "k", "o") == [(1, "a"), (1, "b")]


def test_alert_actions(spark):
    v = spark.createDataFrame([("a", "alert"), ("b", "alert"), ("c", "alert"), ("d", "observed"), ("e", "observed"), ("f", "not_attempted")], "s string, verdict string")
    o = spark.createDataFrame([("b", False), ("c", True), ("d", False), ("f", False)], "s string, reported boolean")
    assert rows_of(alerts.actions(v, o, "s"), "s", "action") == [("a", "create"), ("b", "comment"), ("c", "skip"), ("d", "close"), ("e", "none"), ("f", "none")]
    text = spark.range(1).select(alerts.printable(F.lit("a\x00`b`<!-- c\n d")).alias("x"), alerts.capped(F.array(*[F.lit(str(i)) for i in range(14)])).alias("y")).first()
    assert text.x == "a 'b'<! -- c d"
    assert text.y == [*map(str, range(9)), "… 5 more"]


def test_cover_plan_against_a_greedy_loop(spark):
    def plain(sets, cost, pools):
        covered, out = set(), []
        for pool in pools:
            while best := min((g for g in pool if sets[g] - covered), key=lambda g: (-len(sets[g] - covered) / cost[g], -len(sets[g] - covered), g), default=None):
                out.append((len(out) + 1, best, len(sets[best] - covered)))
                covered |= sets[best]
        return out

    rng = random.Random(5)
    sets = {g: {rng.randrange(300) for _ in range(rng.randrange(1, 25))} for g in range(1, 90)}
    cost = {g: rng.randrange(1, 9) for g in sets}
    m = spark.createDataFrame([(g, i) for g, x in sets.items() for i in x] + [(None, 1), (1, None)], "g long, i long")
    c = spark.createDataFrame(list(cost.items()), "g long, cost long")
    assert [tuple(r) for r in graph.greedy_cover(spark, m, c, "g", "i").orderBy("round").collect()] == plain(sets, cost, [sets])
    even = [[g for g in sets if g % 2 == 0], [g for g in sets if g % 2]]
    assert [tuple(r) for r in graph.greedy_cover(spark, m, c, "g", "i", stable=F.col("g") % 2 == 0).orderBy("round").collect()] == plain(sets, cost, even)


def test_cover_takes_many_picks_a_step(spark, monkeypatch):
    """Groups that all share items with others: a plan of many picks takes few rounds of jobs, and is the same however small a step is."""
    rng = random.Random(8)
    rows = [(g, i) for g in range(120) for i in rng.sample(range(400), rng.randrange(10, 30))]
    m = spark.createDataFrame(rows, "g long, i long")
    c = m.groupBy("g").agg(F.count("*").alias("cost"))
    cuts, old = [], graph.cut
    monkeypatch.setattr(graph, "cut", lambda df: cuts.append(1) or old(df))
    got = [tuple(r) for r in graph.greedy_cover(spark, m, c, "g", "i").orderBy("round").collect()]
    assert sum(n for *_, n in got) == len({i for _, i in rows}) and len(got) > 15 and len(cuts) <= 3
    for groups, items in ((10_000, 900), (20, 4_000_000), (10_000, 1)):
        monkeypatch.setattr(graph, "STEP_GROUPS", groups)
        monkeypatch.setattr(graph, "STEP_ITEMS", items)
        assert [tuple(r) for r in graph.greedy_cover(spark, m, c, "g", "i", rounds=8).orderBy("round").collect()] == got[:8]
        cuts.clear()


def test_cover_plan_covers_every_part(spark):
    rows = spark.read.parquet("/root/testdata/sf0.01/lineitem.parquet").select("l_suppkey", "l_partkey").collect()
    got = catalogue.set_cover_plan(spark, "/root/testdata/sf0.01").collect()
    assert sum(r.gain for r in got) == len({r.l_partkey for r in rows}) and len({r.s for r in got}) == len(got) > 3


def test_references_are_decoded_in_whole_pages(spark, tmp_path):
    rows = [(1, "<p>a &amp; b &eacute;</p><footer>&copy; x</footer>"), (2, "no footer: &#8364;5 &lt;b&gt; &unknown; &#x1F600;"), (3, ""), (4, None), (5, "plain")]
    spark.createDataFrame(rows, "page_id long, html string").write.parquet(f"{tmp_path}/pages.parquet")
    want = [(i, t if t is None else html.unescape(t), t if t is None else len(html.unescape(t))) for i, t in rows]
    assert rows_of(catalogue.html_entities(spark, str(tmp_path)).where("page_id <> 4"), "page_id", "text", "n") == [r for r in want if r[0] != 4]
    assert tuple(catalogue.html_entities(spark, str(tmp_path)).where("page_id = 4").first()) == want[3]


def test_tiered_candidates_meet_codes_of_any_number_of_listings(spark, tmp_path):
    """A code of more than 1,000 listings loses no pair, and pairs are told in their first tier without a shuffle of pairs."""
    rows = [(97 * i, f"name {i // 2}", "STANDARD TIN", "Brand#11", 15 if i == 1000 else 5) for i in range(1001)] + [(1, "name 500", "PROMO TIN", "Brand#11", 25)]
    spark.createDataFrame(rows, "p_partkey long, p_name string, p_type string, p_brand string, p_size int").write.parquet(f"{tmp_path}/part.parquet")
    got = sorted(tuple(r) for r in catalogue.tiered_candidates(spark, str(tmp_path)).collect())
    assert got == sorted([(97 * i, 97_000, 1) for i in range(1000)] + [(97_000, 1, 2)])


def test_words_of_names_are_told_once_and_on_all_cores(spark):
    from epochal.plans import catalogue

    from .conftest import DATA

    assert catalogue._named(spark, f"{DATA}/sf0.001").rdd.getNumPartitions() >= 4 * spark.sparkContext.defaultParallelism
    assert "EvalPython" not in catalogue.token_blocks(spark, f"{DATA}/sf0.001")._jdf.queryExecution().optimizedPlan().toString()  # they are read, not told again for each side
