"""Snapshots in, state and dataset out; streams against batches."""

import json
import random
import uuid

import pytest
from pyspark.sql import functions as F

from epochal.operators import normalize
from epochal.plans import history
from epochal.sources import snapshots
from epochal.streaming import history as streaming

DAY = 86_400_000


def snapshot(day, prices, store="shop", complete=True):
    quote = lambda p: {"quoteKind": "selling", "taxTreatment": "tax_included", "currency": "JPY", "state": "exact" if p is not None else "unavailable", "minAmountMinor": p, "maxAmountMinor": p, "unitLabel": "1個"}
    stock = {"state": "in_stock", "purchasable": True, "quantity": 5, "quantitySemantics": "site_reported", "quantityUnobserved": False, "rawStatus": None}
    products = [
        {"externalProductId": k, "pageKey": k, "aliases": [], "metadata": {"name": k, "modelNumber": None, "category": None, "canonicalUrl": "/"}, "offers": [{"externalOfferId": "o", "offerKind": "default", "sku": None, "variantName": None, "priceQuotes": [quote(p)], "availability": stock}]}
        for k, p in prices.items()
    ]
    return {"storeId": store, "observedAt": f"2026-01-{day:02d}T00:00:00.000Z", "sourceSchemaVersion": "1", "complete": complete, "coverageId": "all", "rawSha256": "", "normalizedHash": json.dumps(prices, sort_keys=True), "products": products}


@pytest.fixture
def load(spark, tmp_path):
    def one(s):
        path = tmp_path / f"snapshot-{len(list(tmp_path.glob('*.json')))}.json"
        path.write_text(json.dumps(s))
        return snapshots.read_normalized(spark, str(path))

    return one


def test_import_in_any_order_and_publish(spark, tmp_path, load):
    same = {"b": 50, "d": 1, "e": 2}
    days = {1: {"a": 100, "c": 7} | same, 2: {"a": 100, "c": 7} | same, 3: {"a": 120, "c": 7} | same, 4: {"a": 120, "c": None} | same}
    seen = []
    for name, order in (("x", [1, 2, 3, 4]), ("y", [1, 3, 2, 3, 4])):
        state = history.State(spark, str(tmp_path / name))
        codes = [history.import_snapshot(state, load(snapshot(d, days[d]))).exit_code() for d in order]
        assert set(codes) == {0}
        seen.append(sorted(map(str, history.price_series(state).collect())))
    assert seen[0] == seen[1] and len(seen[0]) == 7
    assert state.verify() == []
    out = history.publish(state, str(tmp_path / "site"))
    assert out == {"shop": {"products": 5, "ok": True}}
    row = history.published(state).where("product = 'a'").first()
    s = row.offers[0].segments[0]
    assert (s.current.low, s.min_d30, s.max_d30, [p.low for p in s.prices]) == (120, 100, 120, [100, 120])


def test_bad_snapshots_are_kept_out(spark, tmp_path, load):
    state = history.State(spark, str(tmp_path / "z"))
    good = {f"p{i}": i for i in range(10)}
    assert history.import_snapshot(state, load(snapshot(1, good))).outcome == "ok"
    r = history.import_snapshot(state, load(snapshot(2, dict(list(good.items())[:5]))))
    assert r.outcome == "quarantined" and "drop" in r.markdown()
    assert history.import_snapshot(state, load(snapshot(3, good, complete=False))).exit_code() == 3
    assert history.import_snapshot(state, load(snapshot(1, good))).stages[0]["status"] == "skipped"
    assert history.import_snapshot(state, load(snapshot(1, good | {"p1": 99}))).outcome == "failed"
    assert state.read("runs").count() == 1 and state.read("rejected").count() == 2


def test_an_import_writes_its_own_files_only_and_a_cut_off_one_changes_nothing(spark, tmp_path, load):
    state = history.State.acquire(spark, str(tmp_path / "s"), bootstrap=True)
    files = lambda: {p: p.stat().st_mtime_ns for p in (tmp_path / "s").rglob("*.parquet")}
    sizes, seen = [], {}
    for day in range(1, 5):
        assert history.import_snapshot(state, load(snapshot(day, {"a": day} | {f"p{i}": i for i in range(9)}))).outcome == "ok"
        now = files()
        assert all(now[p] == at for p, at in seen.items())  # older files are never touched
        sizes.append(sum(p.stat().st_size for p in now if p not in seen))
        seen = now
    assert max(sizes) < 1.5 * min(sizes)
    with pytest.raises(ValueError, match="already"):
        history.State.acquire(spark, str(tmp_path / "s"), bootstrap=True)
    with pytest.raises(ValueError, match="no state"):
        history.State.acquire(spark, str(tmp_path / "none"))
    (tmp_path / "s" / "manifests" / "00000009.json").write_text('{"format": 2, "ver')  # a run that was cut off
    assert history.State.acquire(spark, str(tmp_path / "s")).manifest()["version"] == 4 and state.read("runs").count() == 4


def test_two_writers_of_one_version_keep_what_the_first_committed(spark, tmp_path, monkeypatch):
    root = str(tmp_path / "w")
    rows = lambda a, b: spark.range(a, b).selectExpr("id AS x")
    first, second = history.State(spark, root), history.State(spark, root)
    first.commit({"t": rows(0, 3)})
    seen = second.manifest()
    first.commit({"t": rows(3, 103)})
    monkeypatch.setattr(second, "manifest", lambda: seen)  # the second writer read the state before the first committed
    monkeypatch.setattr(second, "manifests", lambda: ["00000001.json"])
    with pytest.raises(Exception, match="exists"):
        second.commit({"t": rows(900, 907)})
    assert history.State(spark, root).read("t").count() == 103 and first.verify() == []


def test_a_state_goes_on_after_a_manifest_that_was_cut_off(spark, tmp_path, load):
    state = history.State(spark, str(tmp_path / "c"))
    same = {f"p{i}": i for i in range(9)}
    assert history.import_snapshot(state, load(snapshot(1, {"a": 1} | same))).outcome == "ok"
    (tmp_path / "c" / "manifests" / "00000002.json").write_text('{"format": 2, "ver')
    assert history.import_snapshot(state, load(snapshot(2, {"a": 2} | same))).outcome == "ok"
    assert state.manifest()["version"] == 3 and state.verify() == []
    assert history.price_series(state).count() == 11


def test_an_older_format_is_brought_up_to_date_and_a_newer_one_refused(spark, tmp_path, load):
    state = history.State(spark, str(tmp_path / "m"))
    for day in (1, 2):
        history.import_snapshot(state, load(snapshot(day, {"a": 1, "b": 2})))
    path = tmp_path / "m" / "manifests"
    m = state.manifest()
    for t in ("parts", "rows"):
        m[t].pop("offers")
    (path / "00000003.json").write_text(json.dumps(m | {"format": 1, "version": 3}))
    assert state.migrate() == (1, 2)
    assert sorted(map(tuple, state.read("offers").select("product", "first_seen", "last_seen").collect())) == [(k, 1_767_225_600_000, 1_767_312_000_000) for k in "ab"]
    (path / "00000099.json").write_text(json.dumps(m | {"format": 9}))
    with pytest.raises(ValueError, match="newer"):
        state.manifest()


def test_shapes_normalize(spark, tmp_path):
    item = {"listing": {"salesCode": "123", "name": " A ", "prices": [{"amountYen": 100, "display": "100", "quantityUnit": "1個", "taxIncluded": True}], "stock": {"status": "在庫 5", "availableQuantity": 5, "purchasable": True}}}
    item["catalogue"] = {"handle": "h", "productId": 1, "title": "T", "variants": [{"variantId": 2, "sku": "S2", "priceYen": 5, "available": False, "position": 2}, {"variantId": 1, "sku": "S1", "priceYen": 4, "compareAtPriceYen": 6, "available": True, "position": 1}]}
    item["storefront"] = {"id": 1, "handle": "x", "title": "T", "variants": [{"id": 9, "sku": "K", "title": "Default Title", "price": "12.50", "available": True}]}
    item["api"] = {"id": 7, "name": "N", "model": "M", "price": 99_999_999, "stock": 0, "status": {"id": 1, "name": "販売予定品"}}
    item["category"] = {"code": "A-1", "name": "N", "priceLines": [{"minQuantity": 1, "quantityUnit": "個", "label": "単価", "amountYen": 10}, {"minQuantity": 1, "quantityUnit": "個", "label": "単価", "amountYen": 12}], "outOfStockClass": True, "stockMark": "×"}
    got = {}
    for shape, i in item.items():
        path = tmp_path / f"{shape}.json"
        path.write_text(json.dumps({"storeId": "s", "schemaVersion": 1, "observedAt": "2026-01-01T00:00:00Z", "complete": True, "items": [i], "pageInventory": {"quantities": {"1": 3}}}))
        got[shape] = normalize.normalize(snapshots.read_raw(spark, str(path), shape), shape).first().products[0]
    q = {k: v.offers[0].priceQuotes[0] for k, v in got.items()}
    assert (q["listing"].minAmountMinor, q["storefront"].minAmountMinor, q["api"].state, q["category"].state, q["category"].maxAmountMinor) == (100, 1250, "unavailable", "range", 12)
    a = {k: v.offers[0].availability for k, v in got.items()}
    assert {k: v.state for k, v in a.items()} == {"listing": "in_stock", "catalogue": "in_stock", "storefront": "in_stock", "api": "preparing", "category": "out_of_stock"}
    assert a["catalogue"].quantity == 3 and not got["catalogue"].offers[1].availability.quantityUnobserved and len(got["catalogue"].offers[0].priceQuotes) == 2
    assert got["listing"].metadata.name == "A" and q["category"].unitLabel == "1個"


def test_a_file_that_is_no_snapshot_fails(spark, tmp_path):
    (tmp_path / "bad.json").write_text("{not json")
    with pytest.raises(Exception):  # noqa: B017
        snapshots.read_normalized(spark, str(tmp_path / "bad.json")).collect()


def test_stream_equals_batch_on_shuffled_batches(spark, tmp_path):
    rng = random.Random(4)
    rows = [(k, t, rng.choice("AB")) for k in range(6) for t in rng.sample(range(40), 15)]
    rng.shuffle(rows)
    for i in range(3):
        spark.createDataFrame(rows[i * 30 : i * 30 + 40], "key int, t long, state string").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("key int, t long, state string").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    q = streaming.updates(stream).writeStream.format("memory").queryName("points").outputMode("update").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "c")).start()
    assert q.awaitTermination(120)
    net = spark.table("points").groupBy("key", "t", "state").agg(F.sum(F.when(F.col("added"), 1).otherwise(-1)).alias("n")).where("n > 0")
    used = {r for i in range(3) for r in rows[i * 30 : i * 30 + 40]}
    batch = streaming.series(spark.createDataFrame(sorted(used), "key int, t long, state string"), ["key"], "t", ["state"])
    assert sorted((r.key, r.t, r.state) for r in net.collect()) == sorted((r.key, r.t, r.state) for r in batch.collect())


def test_late_observations_split_spans():
    rows, added, gone = streaming.changed([(1, "A"), (9, "A")], [(5, "B")])
    assert (added, gone) == ([5, 9], []) and streaming.changed(rows, [(7, "A")])[1:] == ([7], [9])


def test_a_snapshot_is_read_twice_and_dealt(spark, tmp_path):
    rows = snapshot(1, {f"p{i}": i for i in range(2_000)})
    source = spark.createDataFrame([rows], snapshots.NORMALIZED)
    reads = tmp_path / "reads"
    reads.mkdir()

    def told(batches):
        (reads / uuid.uuid4().hex).touch()
        yield from batches

    state = history.State(spark, str(tmp_path / "s"))
    assert history.import_snapshot(state, source.coalesce(1).mapInArrow(told, source.schema)).outcome == "ok"
    assert len(list(reads.iterdir())) <= 2  # what run it is, and the products
    assert {t: state.read(t).count() for t in ("runs", "prices", "stock", "offers")} == {"runs": 1, "prices": 2_000, "stock": 2_000, "offers": 2_000}
    kept = history.dealt(source)
    assert kept.count() == 2_000 and len(kept.inputFiles()) > 4 and kept.select(F.explode("products.pageKey")).distinct().count() == 2_000
    assert history.check(history.dealt(spark.createDataFrame([rows | {"products": []}], snapshots.NORMALIZED)), None) == ["empty"]
