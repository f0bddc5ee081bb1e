"""Report folders, catalogue files, contracts, snapshots, charts and digests."""

import json

import pytest
from pyspark.sql import functions as F

from epochal.functions import keys, money
from epochal.operators import chartview, contract, digests, readside, snapshotchecks
from epochal.plans import readside as readside_plans
from epochal.plans import served
from epochal.sources import catalogues, covers, html, reports


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


def report(store, outcome, stages=(), warnings=()):
    return json.dumps({"storeId": store, "outcome": outcome, "stages": list(stages), "warnings": list(warnings)}, indent=1)


def test_a_folder_of_reports(spark, tmp_path):
    failed = {"name": "im`port", "status": "failed", "error": "x" * 400}
    files = {
        "a.json": report("a", "published", [{"name": "collect", "status": "ok"}]), "b.json": report("b", "published", [{"name": "collect", "status": "ok"}]), "b.failed-run.json": report("b", "failed", [failed]), "c.json": report("c", "quarantined", (), [f"quarantined: {i}" for i in range(12)]),
        "d.json": report("d", "failed"), "e.json": report("e", "quarantined", (), ["nothing"]), "bad1.json": "{", "bad2.json": "[]", "bad3.json": report("No Id", "failed"), "bad4.json": report("x", "lost"), "bad5.json": report("x", "failed").replace('"warnings": []', '"warnings": 1'), "bad6.json": "",
    }
    for name, text in files.items():
        (tmp_path / name).write_text(text)
    found = reports.checked(reports.read_reports(spark, str(tmp_path)))
    assert {r.file.rsplit("/", 1)[1]: r.fault for r in found.where("fault is not null").collect()} == {"bad1.json": "no JSON", "bad2.json": "not an object", "bad3.json": "invalid store", "bad4.json": "invalid outcome", "bad5.json": "warnings is no array", "bad6.json": "no JSON"}
    got = {r.store: (r.verdict, r.outcome, r.stage, r.reasons) for r in reports.verdicts(found, spark.createDataFrame([("a",), ("c",), ("z",)], "store string")).collect()}
    assert got["b"] == ("alert", "failed", "im'port", ["im'port: " + "x" * 290 + "…"])
    assert got["a"] == got["z"] == ("alert", "failed", None, [reports.NO_REPORT])
    assert got["c"][:2] == ("alert", "quarantined") and got["c"][3] == [*map(str, range(9)), "… 3 more"]
    assert got["d"][3] == [reports.NO_STAGE] and got["e"][3] == [reports.NO_REASON] and len(got) == 6


def test_a_catalogue_is_read_as_it_was_written(spark, tmp_path):
    rows = [("s", f"k{i}", f"name {i}\n\"x\"", [f"C{i}"]) for i in range(50)] + [("t", "k", None, [])]
    listings = spark.createDataFrame(rows, catalogues.LISTING).repartition(4)
    sources = spark.createDataFrame([("s", "s.json", "h", "t", 50), ("t", "t.json", "h", "t", 1)], catalogues.SOURCE)
    catalogues.write_catalogue(listings, sources, str(tmp_path / "c"))
    lines = [line for f in sorted((tmp_path / "c").glob("part-*")) for line in f.read_text().splitlines()]
    assert json.loads(lines[0])["schemaVersion"] == 1 and [json.loads(x)["storeId"] for x in lines[1:]] == ["s"] * 50 + ["t"]
    known, back = catalogues.read_catalogue(spark, str(tmp_path / "c"))
    assert sorted(map(tuple, known.collect())) == sorted(map(tuple, sources.collect()))
    assert sorted((r.storeId, r.pageKey, r.name, r["codes"]) for r in back.collect()) == sorted((*r[:3], r[3]) for r in rows if r[2]) + [("t", "k", None, [])]
    assert catalogues.catalogue_faults(known, back).count() == 0


def test_only_complete_catalogues_are_sources(spark):
    text = lambda **x: json.dumps({"complete": True, "retrievedAt": "now", "items": [1, {"a": 2}]} | x)
    saved = spark.createDataFrame([("s", "a", text()), ("s", "b", text(complete=False)), ("s", "c", text(items=None)), ("s", "d", "{")], "storeId string, file string, text string")
    assert {r.file: (r["count"], r.fault) for r in catalogues.complete(saved).collect()} == {"a": (2, None), "b": (None, "incomplete"), "c": (None, "no items"), "d": (None, "no JSON")}
    assert catalogues.items(saved.where("file = 'a'")).select(F.to_json("item")).count() == 2


def test_sound_files_keep_the_contract_and_manifests_have_paths_too(spark):
    text = json.dumps(served._FILE)
    docs = spark.createDataFrame([(1, text), (2, None), (3, "[]")], "k int, json string")
    assert [(r.k, r.issue) for r in contract.violations(docs, "json").orderBy("k").collect()] == [(2, "$: no JSON"), (3, "$: expected an object")]
    manifest = {
        "contractVersion": "1.0", "storeId": "s", "datasetVersion": "v", "generatedAt": "t", "productCount": 1, "productPathTemplate": contract.PLACE, "versions": {"contract": "1", "sqliteSchema": 2, "sourceSchema": None},
        "capabilities": {**{x: True for x in contract.FLAGS}, "inventoryQuantitySemantics": "unknown", "primaryQuote": {"quoteKind": "selling", "taxTreatment": "unknown"}}, "observation": {"runCount": 1, "firstObservedAt": None, "latestObservedAt": 5, "latestCoverageId": None},
    }
    bad = manifest | {"productPathTemplate": "x", "observation": manifest["observation"] | {"samplingIntervalDays": 0}, "capabilities": manifest["capabilities"] | {"supportsVariants": "yes"}}
    docs = spark.createDataFrame([(1, json.dumps(manifest)), (2, json.dumps(bad))], "k int, json string")
    got = sorted((r.k, r.issue) for r in contract.violations(docs, "json", contract.MANIFEST).collect())
    assert got == [(2, "$.capabilities.supportsVariants: expected a boolean"), (2, "$.observation.samplingIntervalDays: expected positive days"), (2, "$.productPathTemplate: unexpected template")]


def test_times_rise_over_points_that_are_none(spark):
    spec = contract.Each(contract.Row((contract.time,), "expected [t]"), rising=True)
    v = F.parse_json(F.lit('[[5], "x", [3], [9], [9]]'))
    assert one(spark, spec.issues(v, F.lit("$"))) == ["$[1]: expected [t]", "$[2]: times must rise", "$[4]: times must rise"]


def test_snapshots_say_what_is_wrong(spark):
    good = json.dumps(served._SNAPSHOT)
    rows = [(1, good), (2, "7"), (3, good.replace('"schemaVersion": 3', '"schemaVersion": 2').replace('"catalog"', '"other"')), (4, good.replace('"listings"', '"genres"')), (5, good.replace('{"name": "A"', '5, {"name": "A"')), (6, None)]
    got = sorted((r.k, r.code, r.subject) for r in snapshotchecks.snapshot_issues(spark.createDataFrame(rows, "k int, json string"), "k", "json").collect())
    assert got == [(2, "raw.not_object", None), (5, "raw.listing_shape", "0"), (6, "raw.not_object", None)]
    assert [one(spark, snapshotchecks.listing_id(F.lit(u))) for u in ("https://x/catalog/c/a-b_p12/", "/catalog/r/x", "/catalog/g/g1/", "/catalog/c/a/b")] == ["c/a-b", "r/x", None, None]


def test_segments_have_common_borders(spark):
    price = spark.createDataFrame([(1, 10, 5), (1, 30, None), (2, 10, 1)], "k int, t long, p int")
    listed = spark.createDataFrame([(1, 20, True), (1, 40, False), (1, 40, False)], "k int, t long, l boolean")
    stock = spark.createDataFrame([(1, 20, 9), (1, 25, 4), (1, 27, 6), (1, 60, 1)], "k int, t long, s int")
    rows = chartview.sold(chartview.segments({"price": (price, "p"), "listed": (listed, "l"), "stock": (stock, "s")}, ["k"], "t", F.lit(50)), ["k"], "stock", "listed")
    got = [tuple(r) for r in rows.where("k = 1").orderBy("start").collect()]
    assert got == [(1, 10, 19, 5, None, None, 0), (1, 20, 24, 5, True, 9, 0), (1, 25, 26, 5, True, 4, 5), (1, 27, 29, 5, True, 6, 0), (1, 30, 39, None, True, 6, 0), (1, 40, 59, None, False, 6, 0)]


def test_stock_steps_break_at_nothing(spark):
    points = spark.createDataFrame([(1, 10, 3), (1, 20, None), (1, 30, 4), (1, 90, 5)], "k int, t long, n int")
    windows = spark.createDataFrame([(1, 15, 50)], "k int, start long, end long")
    assert sorted(tuple(r) for r in chartview.stock_steps(points, windows, ["k"], "t", "n").collect()) == [(1, 15, 20, 3), (1, 30, 50, 4)]


@pytest.mark.parametrize("change", ["none", "changed", "lost", "doubled", "swapped"])
def test_digests_find_what_differs(spark, change):
    rows = [("a", i, f"v{i}") for i in range(40)] + [("b", i, f"w{i}") for i in range(30)]
    other = {"none": rows[::-1], "changed": [*rows[1:], ("a", 0, "x")], "lost": rows[1:], "doubled": [*rows, rows[0]], "swapped": [("a", 0, "v1"), ("a", 1, "v0"), *rows[2:]]}[change]
    schema = "s string, k int, v string"
    got = {r.s: r.fault for r in digests.disagreements(spark.createDataFrame(rows, schema), spark.createDataFrame(other, schema), ["s"], ["k", "v"]).collect()}
    assert got == {"none": {}, "changed": {"a": "other contents"}, "lost": {"a": "another number"}, "doubled": {"a": "another number"}, "swapped": {"a": "other contents"}}[change]


def test_forms(spark):
    assert [one(spark, money.percent_text(F.lit(x))) for x in (1.25, -0.04, 0.0, -12.0)] == ["+1.3%", "−0.0%", "±0.0%", "−12.0%"]
    assert [one(spark, money.signed_money(F.lit(a), F.lit(c))) for a, c in ((1234, "JPY"), (-123456, "USD"), (0, "CHF"))] == ["+￥1,234", "−$1,234.56", "±0.00 CHF"]
    assert one(spark, keys.in_locale_order(F.array(*map(F.lit, ["b", "B", "a", "Á", "A", "ab"])))) == ["a", "A", "Á", "ab", "b", "B"]
    assert one(spark, keys.base_address(F.lit("https://x/a///?q#f"))) == "https://x/a"
    page = one(spark, html.sanitized(F.lit('<!doctype html>\n<SCRIPT>x</script><input name="api_key" value="s"><meta name="csrf-token" content="c">'), F.lit("<!-- b -->")))
    assert page == '<!doctype html>\n<!-- b --><input name="api_key" value=""><meta name="csrf-token" content="">'


def test_relations_whose_ids_repeat_stay_single(spark, tmp_path):
    parts = [(n, "N", "B", "T", s, 1.0) for s, n in enumerate((66, 100_066, 1_000_666, 1_000_660, 1_000_661))]
    spark.createDataFrame(parts, "p_partkey long, p_name string, p_brand string, p_type string, p_size int, p_retailprice double").write.parquet(f"{tmp_path}/part.parquet")
    assert sorted((r.id, r.kept) for r in readside_plans.relation_drift(spark, str(tmp_path)).collect()) == [("r000066", False), *[("r100066", False)] * 3, ("r100066", True)]


def test_relations_of_one_id_have_an_order(spark):
    schema = "id string, a long, b long, kind string, verified boolean, family string, distance int, differences array<string>, n int"
    rows = spark.createDataFrame([("r1", 1, 51, "similar_product", False, f"f{n % 5}", 1, [f"size: {n % 5} ↔ 9"], n) for n in range(9, -1, -1)], schema)
    cards = [r.card for r in readside.related(rows.coalesce(1), ["n"]).where("viewer = 1").orderBy("place").collect()]
    assert cards == [1, 2, 3, 4, 5] * 2


def test_documents_are_parsed_once_and_dealt_over_tasks(spark):
    assert str(covers.cover_fault(F.col("text"))).count("try_parse_json") == 1
    for query in (served.contract_paths, served.contract_report):
        plan = query(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
        assert plan.count("try_parse_json") <= 1
    assert served.contract_paths(spark, "/root/testdata/sf0.001").rdd.getNumPartitions() >= 4 * spark.sparkContext.defaultParallelism


def test_chart_tasks_follow_the_size_of_the_table(spark, monkeypatch):
    from epochal.plans import registry
    from epochal.sources import tables

    from .conftest import DATA

    monkeypatch.setattr(tables, "TASK_ROWS", 500)
    lines = spark.read.parquet(f"{DATA}/sf0.001/lineitem.parquet").count()
    assert registry.QUERIES["chart_segments"](spark, f"{DATA}/sf0.001").rdd.getNumPartitions() >= lines // 500
