"""Registered queries on what runs report, what is published and what readers' charts draw. Suppliers and parts stand for shops and products, with faults at fixed keys."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import keys, money
from ..functions.times import DAY_MS
from ..operators import changepoints, chartview, contract, digests, graph, normalize, publication, snapshotchecks
from ..sources import catalogues, covers, html, reports
from ..sources.tables import PRICES_SQL, by_size, daily_prices, price_stream, spread, table
from . import temporal
from .registry import query


def _replaced(n: Column, cases: int, whole: dict, changes: list[tuple[str, str]]) -> Column:
    """A document as JSON; of `cases` in turn, the k-th has the k-th change made in its text."""
    text = json.dumps(whole, ensure_ascii=False)
    out = F.lit(text)
    for k, (old, new) in enumerate(changes):
        assert text.count(old) == 1, old
        out = F.when(n % cases == k + 1, text.replace(old, new)).otherwise(out)
    return out


# ---- reports ---------------------------------------------------------------------------------------------------------


@query("run_reports", f"""WITH s AS (SELECT s_suppkey AS n, 's' || s_suppkey AS store, s_suppkey % 7 AS k, s_suppkey % 4 = 1 AS f FROM supplier)
SELECT store, CASE WHEN k IN (2, 3, 5) OR f THEN 'alert' WHEN k = 0 THEN 'observed' ELSE 'not_attempted' END AS verdict, CASE WHEN k = 2 THEN 'quarantined' WHEN k IN (3, 5) OR f THEN 'failed' END AS outcome, CASE k WHEN 3 THEN 'import' WHEN 5 THEN 'validate' END AS stage,
CASE WHEN k = 2 THEN 'too few ''x'' | collect error: page <! -- 3' WHEN k = 3 THEN 'import: boom' WHEN k = 5 THEN 'validate: no error recorded' WHEN f THEN '{reports.NO_REPORT}' END AS reasons FROM s WHERE k NOT IN (4, 6) OR f
UNION ALL SELECT NULL, 'unusable', NULL, NULL, CASE n % 3 WHEN 0 THEN 'no JSON' WHEN 1 THEN 'invalid outcome' ELSE 'stages is no array' END || ' x ' || count(*) FROM s WHERE k = 4 GROUP BY n % 3""")
def run_reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdicts over a folder of reports, a file each: good, quarantined, failed, broken and missing ones, and copies from before a repair."""
    n = F.col("s_suppkey")
    s = spread(table(spark, sf_dir, "supplier").select(n, F.concat(F.lit("s"), n.cast("string")).alias("store")), "s_suppkey")
    say = lambda outcome, stages, warnings="[]": F.concat(F.lit('{"storeId":"'), "store", F.lit(f'","outcome":"{outcome}","stages":{stages},"warnings":{warnings}}}'))
    ok = '[{"name":"collect","status":"ok"},7]'
    broken = F.when(n % 3 == 0, '{"storeId":').when(n % 3 == 1, say("gone", "[]")).otherwise(say("failed", "{}"))
    first = (
        F.when(n % 7 == 0, say("published", ok)).when(n % 7 == 1, say("unchanged", '[{"name":"collect","status":"skipped"}]')).when(n % 7 == 2, say("quarantined", ok, '["collect error: page <!-- 3","other",5,"quarantined: too few `x`"]'))
        .when(n % 7 == 3, say("failed", '[{"name":"collect","status":"ok"},{"name":"import","status":"failed","error":"boom"}]')).when(n % 7 == 4, broken).when(n % 7 == 5, say("published", ok))
    )
    again = F.when(n % 7 == 5, say("failed", '[{"name":"validate","status":"failed"}]'))
    path = graph.scratch(spark, "reports")
    rows = s.select(F.lit("last").alias("run"), first.alias("value")).unionByName(s.select(F.lit("failed").alias("run"), again.alias("value"))).where("value is not null")
    rows.write.option("maxRecordsPerFile", 1).partitionBy("run").text(path)
    found = reports.checked(reports.read_reports(spark, path))
    said = reports.verdicts(found, s.where("s_suppkey % 4 = 1"), F.col("file").contains("/run=failed/"))
    out = said.select("store", "verdict", "outcome", "stage", F.array_join("reasons", " | ").alias("reasons"))
    unusable = found.where("fault is not null").groupBy("fault").count()
    none = F.lit(None).cast("string")
    return out.unionByName(unusable.select(none.alias("store"), F.lit("unusable").alias("verdict"), none.alias("outcome"), none.alias("stage"), F.concat_ws(" x ", "fault", F.col("count").cast("string")).alias("reasons")))


# ---- catalogues ------------------------------------------------------------------------------------------------------


@query("catalogue_lines", """WITH p AS (SELECT p_partkey AS n, 'shop' || p_size % 3 AS store FROM part WHERE p_size % 3 < 3), c AS (SELECT store, count(*) AS n FROM p GROUP BY store)
SELECT store AS subject, 'listings' AS what, n FROM c UNION ALL SELECT 'shop2', 'count disagrees', 1 WHERE EXISTS (SELECT 1 FROM c WHERE store = 'shop2') UNION ALL SELECT 'empty', 'count disagrees', 1
UNION ALL SELECT 'shop0/p' || n, 'key twice', 1 FROM p WHERE store = 'shop0' AND n % 100 = 3 UNION ALL SELECT 'gone' || s_suppkey, 'no source', 1 FROM supplier WHERE s_suppkey % 50 = 2 UNION ALL SELECT 'broken ' || s_suppkey, 'no listing', 1 FROM supplier WHERE s_suppkey % 50 = 1
UNION ALL SELECT 'shop0', 'count disagrees', 1 WHERE EXISTS (SELECT 1 FROM p WHERE store = 'shop0' AND n % 100 = 3)""")
def catalogue_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A catalogue written with its header and read back: listings by shop, and what doesn't agree: counts, keys, shops without a source, and lines that are no listings."""
    n = F.col("p_partkey")
    listings = table(spark, sf_dir, "part").select(F.concat(F.lit("shop"), (F.col("p_size") % 3).cast("string")).alias("storeId"), F.concat(F.lit("p"), n.cast("string")).alias("pageKey"), F.col("p_name").alias("name"), F.array(F.concat(F.lit("C-"), n.cast("string"))).alias("codes"))
    text = F.lit("x")
    sources = listings.groupBy("storeId").agg((F.count("*") + F.when(F.col("storeId") == "shop2", 1).otherwise(0)).alias("count")).unionByName(listings.limit(1).select(F.lit("empty").alias("storeId"), F.lit(1).cast("long").alias("count")))
    sources = sources.select("storeId", F.concat("storeId", F.lit(".json")).alias("file"), F.sha2(text, 256).alias("sha256"), F.lit("2026-01-01T00:00:00.000Z").alias("observedAt"), "count")
    path = graph.scratch(spark, "catalogue")
    catalogues.write_catalogue(listings, sources, path)
    s = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("n"))
    more = s.where("n % 50 = 1").select(F.concat(F.lit("broken "), F.col("n").cast("string")).alias("value")).unionByName(s.where("n % 50 = 2").select(F.concat(F.lit('{"storeId":"gone'), F.col("n").cast("string"), F.lit('","pageKey":"g"}')).alias("value")))
    twice = listings.where("storeId = 'shop0' and cast(substring(pageKey, 2, 20) as long) % 100 = 3").select(F.to_json(F.struct("storeId", "pageKey")).alias("value"))
    more.unionByName(twice).write.mode("append").text(path)
    known, lines = catalogues.read_catalogue(spark, path)
    faults = catalogues.catalogue_faults(known, lines).select("subject", F.col("fault").alias("what"), F.lit(1).cast("long").alias("n"))
    good = lines.where("name is not null").groupBy(F.col("storeId").alias("subject")).agg(F.count("*").alias("n")).select("subject", F.lit("listings").alias("what"), "n")
    return good.unionByName(faults)


# ---- contract --------------------------------------------------------------------------------------------------------

_BASIS = {"quoteKind": "selling", "taxTreatment": "tax_included", "currency": "JPY", "unitLabel": None}
_EXACT = {"state": "exact", "minAmountMinor": 7, "maxAmountMinor": 8}
_STATS = {
    "current": _EXACT, "currentSinceAt": 11, "previousDistinct": None, "change": {"differenceMinor": 1, "percent": 12.5, "direction": "up"}, "observedMinMinor": 3, "observedMaxMinor": 9, "segmentStartAt": 12, "changePointCount": 2, "windows": {"d30": {"minMinor": 21, "maxMinor": 22}, "d90": None, "d365": None},
}
_OFFER = {
    "externalOfferId": "o", "offerKind": "default", "sku": None, "variantName": None, "presence": [[41, 1], [42, 0]],
    "segments": [{"basis": _BASIS, "primary": True, "presence": [], "points": [[51, "exact", 61, 62], [52, "unavailable", None, None]], "stats": _STATS}, {"basis": _BASIS | {"quoteKind": "compare_at"}, "primary": False, "presence": [], "points": [[53, "range", 63, 64]], "stats": _STATS | {"segmentStartAt": 13}}],
    "availability": [[71, "in_stock", None, "site_reported", "raw"]], "inventory": {"semantics": "reference", "truncated": False, "totalPoints": 2, "cappedAt": 100, "points": [[81, 5], [82, None]]},
}
_CURRENT = {"name": "N", "modelNumber": None, "category": None, "canonicalUrl": "/n"}
_FILE = {
    "contractVersion": "1.2.0", "datasetVersion": "v", "storeId": "s", "pageKey": "k", "externalProductId": "i", "generatedAt": "now", "observation": {"runCount": 3, "firstObservedAt": 14, "latestObservedAt": None},
    "product": {"firstSeenAt": 15, "lastSeenAt": 16, "listed": True, "aliases": [{"kind": "a", "value": "b"}], "presence": [[43, 1]], "metadata": [{"t": 17, **_CURRENT, "canonicalUrl": "/m", "suspicious": False}], "current": _CURRENT}, "offers": [_OFFER], "caveats": [],
}
#: What is changed in a sound file, and what must be said of it.
_BREAKS = [
    ('"contractVersion": "1.2.0"', '"contractVersion": "10.0"', "$.contractVersion: expected major 1"), ('"runCount": 3', '"runCount": "3"', "$.observation.runCount: expected an integer"), ('"firstObservedAt": 14', '"firstObservedAt": 0', "$.observation.firstObservedAt: expected a time"),
    ('"listed": true', '"listed": 1', "$.product.listed: expected a boolean"), ('[[43, 1]]', "[[43, 2]]", "$.product.presence[0][1]: expected 0 or 1"), ('[42, 0]', "[41, 0]", "$.offers[0].presence[1]: times must rise"),
    ('[52, "unavailable", null, null]', '[52, "unavailable", null]', "$.offers[0].segments[0].points[1]: expected [t, state, min, max]"), ('[53, "range", 63, 64]', '[53, "about", 63, 64]', "$.offers[0].segments[1].points[0][1]: expected one of exact, range, unavailable"),
    ('"primary": false', '"primary": true', "$.offers[0].segments: more than one primary segment"), ('"cappedAt": 100', '"cappedAt": 0', "$.offers[0].inventory.cappedAt: expected a positive integer"), ('[82, null]', "[80, null]", "$.offers[0].inventory.points[1]: times must rise"),
    ('[71, "in_stock", null, "site_reported", "raw"]', '[71, "in_stock", null, "exact", "raw"]', "$.offers[0].availability[0][3]: expected one of site_reported, reference, not_exposed, unknown"), ('"aliases": [{"kind": "a", "value": "b"}]', '"aliases": {}', "$.product.aliases: expected an array"),
    ('"offers": [', '"offers_": [', "$.offers: expected an array"), ('"externalOfferId": "o"', '"externalOfferId": null', "$.offers[0].externalOfferId: expected a string"), ('"t": 17', '"t": 17.5', "$.product.metadata[0].t: expected a time"), ('{"contractVersion"', '{contractVersion"', "$: no JSON"),
]


@query("contract_paths", "WITH b(k, issue) AS (VALUES " + ", ".join(f"({k + 1}, '{x[2]}')" for k, x in enumerate(_BREAKS)) + f") SELECT p_partkey AS part, issue FROM part JOIN b ON p_partkey % {len(_BREAKS) + 3} = k")
def contract_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Product files, most with one thing that breaks the contract somewhere inside them: each violation with its path. Sound files have none."""
    n = F.col("p_partkey")
    files = spread(table(spark, sf_dir, "part").select("p_partkey"), "p_partkey").select(n.alias("part"), _replaced(n, len(_BREAKS) + 3, _FILE, [x[:2] for x in _BREAKS]).alias("json"))
    return contract.violations(files, "json").select("part", "issue")


@query("contract_report", "WITH b(k, issue) AS (VALUES " + ", ".join(f"({k + 1}, '{x[2]}')" for k, x in enumerate(_BREAKS)) + f"""), i AS (SELECT p_partkey AS part, issue FROM part JOIN b ON p_partkey % {len(_BREAKS) + 3} = k)
SELECT CAST(row_number() OVER (ORDER BY part, issue) AS INTEGER) AS rank, part, issue, (SELECT count(*) FROM i) AS total FROM i ORDER BY part, issue LIMIT 50""")
def contract_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first 50 violations, and how many there are."""
    return contract.listed(contract_paths(spark, sf_dir), ["part"], 50)


# ---- snapshots -------------------------------------------------------------------------------------------------------

_SNAPSHOT = {
    "schemaVersion": 3, "retrievedAt": "2026-01-02T03:04:05Z", "complete": True, "validation": {"errors": [], "listingMismatches": 0, "warnings": []}, "catalog": {"productTotal": 5, "uncovered": 0},
    "listings": [{"name": "A", "url": "https://shop.example/catalog/c/a/", "failedPages": 0, "matchesListedTotal": True}, {"name": "B", "url": "https://shop.example/catalog/r/b_p2/", "failedPages": 0, "matchesListedTotal": True}], "items": [{"x": 1}, {"x": 2}], "extractedTotal": 2,
}
_RAW = [
    ('"schemaVersion": 3', '"schemaVersion": 9', "raw.schema_version", None), ('"retrievedAt": "2026-01-02T03:04:05Z"', '"retrievedAt": "2026-01-02"', "raw.retrieved_at", None), ('"complete": true', '"complete": 1', "raw.incomplete", None), ('"errors": []', '"errors": ["page 3", "x"]', "raw.collector_errors", "page 3"),
    ('"listingMismatches": 0', '"genreMismatches": 2', "raw.listing_mismatch", None), ('"warnings": []', '"warnings": ["slow"]', "warn.collector_warning", "slow"), ('"validation": {', '"checks": {', "raw.validation_missing", None), ('"productTotal": 5', '"productTotal": 0', "raw.catalog_total", None),
    ('"uncovered": 0', '"uncovered": 3', "warn.catalog_gap", None), ('"uncovered": 0', '"uncovered": null', "raw.catalog_uncovered", None), ('"catalog": {', '"catalogue": {', "raw.catalog_missing", None), ('catalog/r/b_p2/', "catalog/c/a_p2/", "raw.listing_duplicate", "c/a"), ('catalog/r/b_p2/', "catalog/x/b/", "raw.listing_url", "B"),
    ('r/b_p2/", "failedPages": 0', 'r/b_p2/", "failedPages": 1', "raw.listing_failed_pages", "r/b"), ('"failedPages": 0, "matchesListedTotal": true}]', '"failedPages": 0}]', "raw.listing_total_mismatch", "r/b"), ('"listings": [', '"lists": [', "raw.listings", None), ('"items": [{"x": 1}, {"x": 2}]', '"items": []', "raw.items_empty", None),
    ('"extractedTotal": 2', '"extractedTotal": 3', "raw.extracted_total", None), ('{"schemaVersion"', '[{"schemaVersion"', "raw.not_object", None),
]


@query("snapshot_issues", "WITH b(k, code, subject) AS (VALUES " + ", ".join(f"({k + 1}, '{x[2]}', {'NULL' if x[3] is None else repr(x[3])})" for k, x in enumerate(_RAW)) + f", ({[x[2] for x in _RAW].index('raw.items_empty') + 1}, 'raw.extracted_total', NULL)) SELECT s_suppkey AS supplier, code, subject FROM supplier JOIN b ON s_suppkey % {len(_RAW) + 2} = k")
def snapshot_issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole snapshots, each of which breaks one rule of what a snapshot must say of itself; some break none."""
    n = F.col("s_suppkey")
    text = _replaced(n, len(_RAW) + 2, _SNAPSHOT, [x[:2] for x in _RAW])
    return snapshotchecks.snapshot_issues(table(spark, sf_dir, "supplier").select(n.alias("supplier"), text.alias("json")), "supplier", "json")


# ---- charts ----------------------------------------------------------------------------------------------------------

_VIEW = f"""m AS (SELECT part, epoch_ms(make_timestamp((run - 1) // 12, (run - 1) % 12 + 1, 1, 0, 0, 0.0)) AS t, present FROM r), st AS (SELECT part, t, min(quantity) AS stock FROM x GROUP BY ALL),
b AS (SELECT part, t FROM q UNION SELECT part, t FROM m UNION SELECT part, t FROM st), b1 AS (SELECT b.part, b.t, q.cents FROM b ASOF LEFT JOIN q ON b.part = q.part AND b.t >= q.t), b2 AS (SELECT b1.*, m.present AS listed FROM b1 ASOF LEFT JOIN m ON b1.part = m.part AND b1.t >= m.t),
b3 AS (SELECT b2.*, st.stock FROM b2 ASOF LEFT JOIN st ON b2.part = st.part AND b2.t >= st.t), v0 AS (SELECT part, t AS start, coalesce(lead(t) OVER (PARTITION BY part ORDER BY t) - 1, {temporal.PRICE_END_MS}) AS stop, cents, listed, stock FROM b3),
v AS (SELECT *, lag(stock) OVER w - stock AS fall, lag(listed) OVER w AS was FROM v0 WHERE start <= stop WINDOW w AS (PARTITION BY part ORDER BY start))"""


@query("chart_segments", f"WITH {PRICES_SQL}, {temporal._DAILY}, {temporal._PRESENCE}, {_VIEW} SELECT part, start, stop, cents, listed, stock, CASE WHEN was AND listed AND fall > 0 THEN fall ELSE 0 END AS sold FROM v")
def chart_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a product's chart draws between any two borders: price, whether it is listed, its count, and what was sold at the border."""
    prices = changepoints.change_points(daily_prices(spark, sf_dir), ["part"], "t", ["cents"])
    whole = table(spark, sf_dir, "lineitem")
    stock = by_size(price_stream(spark, sf_dir).select("part", "t", "quantity"), whole, "part").groupBy("part", "t").agg(F.min("quantity").alias("stock"))
    rows = chartview.segments({"cents": (prices, "cents"), "listed": (temporal._month_ms(spark, sf_dir), "present"), "stock": (stock, "stock")}, ["part"], "t", F.lit(temporal.PRICE_END_MS), whole)
    return chartview.sold(rows, ["part"], "stock", "listed")


@query("stock_chart_steps", f"""WITH {PRICES_SQL}, s AS (SELECT part, t, CASE WHEN min(quantity) % 10 > 0 THEN min(quantity) END AS n, lead(t) OVER (PARTITION BY part ORDER BY t) AS next FROM x GROUP BY part, t),
w AS (SELECT *, {temporal.PRICE_MID_MS} - part % 3 * 90 * {DAY_MS} AS start, {temporal.PRICE_END_MS} - part % 5 * 30 * {DAY_MS} AS stop FROM s)
SELECT part, greatest(t, start) AS "from", least(coalesce(next, stop), stop) AS "to", n AS count FROM w WHERE n IS NOT NULL AND t <= stop AND least(coalesce(next, stop), stop) >= greatest(t, start)""")
def stock_chart_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Steps of a product's count within its window; counts that are multiples of ten stand for pages that show none, and break the line."""
    n = F.min("quantity")
    points = price_stream(spark, sf_dir).groupBy("part", "t").agg(F.when(n % 10 > 0, n).alias("n"))
    p = F.col("part")
    windows = points.select("part").distinct().select("part", (F.lit(temporal.PRICE_MID_MS) - p % 3 * 90 * DAY_MS).alias("start"), (F.lit(temporal.PRICE_END_MS) - p % 5 * 30 * DAY_MS).alias("end"))
    return chartview.stock_steps(points, windows, ["part"], "t", "n")


# ---- order, digests, forms -------------------------------------------------------------------------------------------


@query("locale_order", """WITH k AS (SELECT p_size AS size, CASE p_partkey % 3 WHEN 0 THEN k WHEN 1 THEN upper(k) ELSE upper(substr(k, 1, 1)) || substr(k, 2) END AS key FROM (SELECT *, regexp_replace(lower(p_name), '[^a-z]', '', 'g') || p_partkey % 10 AS k FROM part)),
o AS (SELECT *, translate(key, 'abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ', 'ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz') AS turned FROM k)
SELECT size, sha256(string_agg(key, chr(10) ORDER BY lower(key), turned)) AS hash, arg_min(key, (lower(key), turned)) AS first FROM o GROUP BY size""")
def locale_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keys of each size in the order of an English dictionary (letters before case, small before capital), which is not that of their bytes, and the hash over them."""
    k = F.concat(F.regexp_replace(F.lower("p_name"), "[^a-z]", ""), (F.col("p_partkey") % 10).cast("string"))
    key = F.when(F.col("p_partkey") % 3 == 0, k).when(F.col("p_partkey") % 3 == 1, F.upper(k)).otherwise(F.concat(F.upper(F.substring(k, 1, 1)), F.substring(k, 2, 1000)))
    rows = table(spark, sf_dir, "part").groupBy(F.col("p_size").alias("size")).agg(keys.in_locale_order(F.collect_list(key)).alias("keys"))
    return rows.select("size", F.sha2(F.array_join("keys", "\n"), 256).alias("hash"), F.get("keys", F.lit(0)).alias("first"))


@query("dataset_digests", """WITH p AS (SELECT p_partkey AS n, 's' || p_size % 6 AS store FROM part), c AS (SELECT store, count(*) AS n, count(*) FILTER (WHERE n % 100 = 7) AS few FROM p GROUP BY store)
SELECT store, CASE store WHEN 's2' THEN n - few WHEN 's3' THEN n + few WHEN 's0' THEN 0 ELSE n END AS other_rows, CASE WHEN store = 's5' THEN 0 ELSE n END AS rows, CASE store WHEN 's0' THEN 'missing' WHEN 's1' THEN 'other contents' WHEN 's5' THEN 'unknown' ELSE 'another number' END AS fault
FROM c WHERE store IN ('s0', 's5') OR (store IN ('s1', 's2', 's3') AND few > 0)""")
def dataset_digests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What was published beside the state that it came from: a shop that is missing, one too many, changed, lost and doubled products are each found without joining rows."""
    n = F.col("p_partkey")
    rows = table(spark, sf_dir, "part").select(F.concat(F.lit("s"), (F.col("p_size") % 6).cast("string")).alias("store"), n, "p_name", F.col("p_retailprice").cast("decimal(15,2)").alias("price"))
    few, s = n % 100 == 7, F.col("store")
    changed = F.when(few & (s == "s1"), F.col("price") + 1).otherwise(F.col("price")).cast("decimal(15,2)")
    published = rows.where((s != "s0") & ~(few & (s == "s2"))).withColumn("price", changed).unionByName(rows.where(few & (s == "s3")))
    return digests.disagreements(rows.where("store <> 's5'"), published, ["store"], ["p_partkey", "p_name", "price"])


@query("small_forms", """WITH p AS (SELECT p_partkey AS n, 's' || p_size % 5 AS store, p_partkey % 2000 - 900 AS m, CASE p_partkey % 4 WHEN 0 THEN 'JPY' WHEN 1 THEN 'USD' WHEN 2 THEN 'EUR' ELSE 'CHF' END AS c FROM part), a AS (SELECT *, abs(m) AS a, CASE WHEN m > 0 THEN '+' WHEN m < 0 THEN '−' ELSE '±' END AS sign FROM p)
SELECT n AS part, store || ':' || n AS product_key, 'eph:1:' || store || ':p' || n AS cache_key, store || '-2026-01-02T03-04-05-' || lpad((n % 1000)::VARCHAR, 3, '0') || 'Z.json.gz' AS file, 'https://x.example/a' || n AS base, CASE WHEN n % 5 < 2 AND n % 7 > 0 THEN 'https://x.example/catalog/' || CASE n % 5 WHEN 0 THEN 'c' ELSE 'r' END || '/k' || n || CASE WHEN n % 7 > 1 THEN '_p' || n % 7 ELSE '' END || '/' END AS listing,
n % 3 = 0 OR n % 9 = 1 AS fetch, sign || CASE c WHEN 'JPY' THEN '￥' || format('{:,}', a) WHEN 'CHF' THEN (a // 100) || '.' || lpad((a % 100)::VARCHAR, 2, '0') || ' CHF' ELSE CASE c WHEN 'USD' THEN '$' ELSE '€' END || format('{:,}', a // 100) || '.' || lpad((a % 100)::VARCHAR, 2, '0') END AS money,
sign || (a + 5) // 10 // 10 || '.' || (a + 5) // 10 % 10 || '%' AS percent, n % 3 > 0 AS at_end, n % 4 > 1 AS shows FROM a""")
def small_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keys, names, addresses and texts in the forms that the rest of the world sees."""
    n = F.col("p_partkey")
    t = n.cast("string")
    p = table(spark, sf_dir, "part").select(n, F.concat(F.lit("s"), (F.col("p_size") % 5).cast("string")).alias("store"), (n % 2000 - 900).alias("m"), F.when(n % 4 == 0, "JPY").when(n % 4 == 1, "USD").when(n % 4 == 2, "EUR").otherwise("CHF").alias("c"))
    at = F.concat(F.lit("2026-01-02T03:04:05."), F.lpad((n % 1000).cast("string"), 3, "0"), F.lit("Z"))
    kind = F.when(n % 5 == 0, "c").when(n % 5 == 1, "r").otherwise("x")
    url = F.when(n % 3 == 0, "https://data.example/v1/a.json").when(n % 9 == 1, "https://rate.example/latest?base=JPY").when(n % 9 == 2, "http://data.example/").when(n % 9 == 4, "https://rate.example/latest").when(n % 9 == 5, "https://data.example.evil.example/").otherwise("no address")
    ended = F.array(F.struct(F.lit(1).alias("t"), F.lit(True).alias("present")), F.struct(F.lit(2).alias("t"), (n % 3 > 0).alias("present")))
    return p.select(
        n.alias("part"), keys.product_key(F.col("store"), t).alias("product_key"), keys.cache_key(1, F.col("store"), F.concat(F.lit("p"), t)).alias("cache_key"), keys.snapshot_file(F.col("store"), at).alias("file"), keys.base_address(F.concat(F.lit("https://x.example/a"), t, F.lit("//?q=1#top"))).alias("base"),
        keys.listing_address(F.lit("https://x.example"), kind, F.concat(F.lit("k"), t), (n % 7).cast("int")).alias("listing"), keys.may_fetch(url, ("data.example",), "https://rate.example/latest?base=JPY").alias("fetch"), money.signed_money(F.col("m"), F.col("c")).alias("money"), money.percent_text(F.col("m") / 100).alias("percent"),
        chartview.present_at_end(ended).alias("at_end"), chartview.shows_quantities(F.when(n % 4 == 1, "not_exposed").otherwise("reference"), F.array(F.lit(None).cast("int"), F.when(n % 4 != 0, F.lit(1)))).alias("shows"),
    )


@query("sanitized_pages", r"""WITH p AS (SELECT page_id, '<!DOCTYPE html>' || chr(10) || '<meta name="csrf-token" content="abc' || page_id || '">' || html AS h FROM pages)
SELECT page_id, sha256('<!DOCTYPE html>' || chr(10) || '<!-- kept -->' || chr(10) || substr(replace(regexp_replace(h, '<script.*?</script>', '', 'gsi'), 'content="abc' || page_id || '"', 'content=""'), 17)) AS hash FROM p""")
def sanitized_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page as a fixture: scripts out, tokens blank, a banner in place."""
    h = F.concat(F.lit('<!DOCTYPE html>\n<meta name="csrf-token" content="abc'), F.col("page_id").cast("string"), F.lit('">'), "html")
    return table(spark, sf_dir, "pages").select("page_id", F.sha2(html.sanitized(h, F.lit("<!-- kept -->\n")), 256).alias("hash"))


_COVER = {
    "version": 1, "builtAt": "2026-01-02T03:04:05Z", "families": ["c", "r"], "products": ["100", "200", "300"],
    "listings": [{"id": "c/a", "pages": 2, "layout": "card", "truncated": False, "codes": [0, 1]}, {"id": "r/b", "pages": 50, "layout": "table", "truncated": True, "codes": [1, 2]}],
}
_COVER_BREAKS = [
    ('"version": 1', '"version": 2', "version"), ("2026-01-02T03:04:05Z", "soon", "date"), ('["c", "r"]', '["r", "c"]', "families"), ('["c", "r"]', '["c", "c"]', "families"), ('["c", "r"]', "[]", "families"), ('"200"', '"300"', "products"), ('"300"', '"x"', "products"), ('"listings"', '"lists"', "no listings"),
    ('"r/b"', '"c/a"', "bad or repeated id"), ('"r/b"', '"x/b"', "bad or repeated id"), ('"pages": 50', '"pages": 51', "r/b: pages"), ('"layout": "table"', '"layout": "grid"', "r/b: layout"), ('"truncated": true', '"truncated": 1', "r/b: truncated"), ("[1, 2]", "[2, 1]", "r/b: codes"), ("[1, 2]", "[1, 3]", "r/b: codes"),
    ("[1, 2]", "[1]", "a product is shown by no listing"), ('{"version"', '{version"', "unreadable"),
]


@query("cover_sources", "WITH b(k, fault) AS (VALUES " + ", ".join(f"({k + 1}, '{x[2]}')" for k, x in enumerate(_COVER_BREAKS)) + f"""), s AS (SELECT p_partkey AS part, p_partkey % {len(_COVER_BREAKS) + 2} AS k FROM part)
SELECT part, fault, NULL AS listings, NULL AS shown FROM s JOIN b USING (k) UNION ALL SELECT part, NULL, 2, '100,200,200,300' FROM s WHERE k NOT IN (SELECT k FROM b)""")
def cover_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stored cover sources, written and read again: what is wrong with each, and the listings and products of the sound ones."""
    n = F.col("p_partkey")
    text = _replaced(n, len(_COVER_BREAKS) + 2, _COVER, [x[:2] for x in _COVER_BREAKS])
    path = graph.scratch(spark, "covers")
    covers.write_covers(spread(table(spark, sf_dir, "part").select("p_partkey"), "p_partkey").select(F.concat(n.cast("string"), F.lit("\t"), text).alias("text")), path)
    rows = covers.read_covers(spark, path).select(F.substring_index("text", "\t", 1).cast("long").alias("part"), F.substring_index("text", "\t", -1).alias("text"))
    rows = graph.cut(rows.withColumn("fault", covers.cover_fault(F.col("text"))))
    listings = covers.stable_listings(rows, "part", F.col("fault")).groupBy("part").agg(F.count("*").cast("int").alias("listings"), F.array_join(F.array_sort(F.flatten(F.collect_list("products"))), ",").alias("shown"))
    return rows.select("part", "fault").join(listings, "part", "left").select("part", "fault", "listings", "shown")


_RECORD = {
    "recordVersion": 1, "storeId": "s", "snapshotFile": "s-1.json.gz", "rawSha256": "ab" * 32, "bytes": 12, "retrievedAt": "2026-01-02T03:04:05Z", "complete": True, "errors": ["e"], "warnings": [], "metrics": {"a": 1, "b": 2.5}, "startedAt": "2026-01-02T03:04:04+09:00", "durationMs": 7,
}
_RECORD_BREAKS = [
    ('"recordVersion": 1', '"recordVersion": "1"', "recordVersion must be 1"), ('"storeId": "s"', '"storeId": ""', "storeId must be a non-empty text"), ('"s-1.json.gz"', "null", "snapshotFile must be a non-empty text"), ('"s-1.json.gz"', '"a/s-1.json.gz"', "snapshotFile must be without a directory"),
    ("ab" * 32, "AB" * 32, "rawSha256 must be 64 lowercase hex digits"), ('"bytes": 12', '"bytes": 1.5', "bytes must be a whole number from 0"), ("03:04:05Z", "03:04:05", "retrievedAt must be a time with an offset"), ('"complete": true', '"complete": "true"', "complete must be true or false"),
    ('["e"]', "[1]", "errors must be texts"), ('"warnings": []', '"warnings": {}', "warnings must be texts"), ("2.5", '"x"', "metrics must be numbers"), ("03:04:04+09:00", "soon", "startedAt must be a time with an offset"), ('"durationMs": 7', '"durationMs": -7', "durationMs must be a number from 0"), ('{"recordVersion"', '[{"recordVersion"', "the record is not an object"),
]


@query("collect_records", "WITH b(k, fault) AS (VALUES " + ", ".join(f"({k + 1}, '{x[2]}')" for k, x in enumerate(_RECORD_BREAKS)) + f") SELECT p_partkey AS part, fault FROM part LEFT JOIN b ON p_partkey % {len(_RECORD_BREAKS) + 2} = k")
def collect_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is the first thing wrong with each record of a collect run."""
    n = F.col("p_partkey")
    return table(spark, sf_dir, "part").select(n.alias("part"), reports.record_fault(_replaced(n, len(_RECORD_BREAKS) + 2, _RECORD, [x[:2] for x in _RECORD_BREAKS])).alias("fault"))


@query("tuple_projections", f"""WITH {PRICES_SQL}, {temporal._DAILY}, {temporal._PRESENCE}, a AS (SELECT part, '[' || string_agg('[' || run || ',' || CASE WHEN present THEN 1 ELSE 0 END || ']', ',' ORDER BY run) || ']' AS presence FROM r GROUP BY part),
b AS (SELECT part, '[' || string_agg('[' || t || ',"exact",' || cents || ',' || cents || ']', ',' ORDER BY t) || ']' AS points FROM q GROUP BY part) SELECT part, presence, points FROM a JOIN b USING (part)""")
def tuple_projections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Presence and price points of each part in the short form in which they are published."""
    presence = changepoints.presence_points(price_stream(spark, sf_dir), ["part"], "run", temporal.LAST_RUN)
    prices = changepoints.change_points(daily_prices(spark, sf_dir), ["part"], "t", ["cents"])
    a = presence.groupBy("part").agg(publication.presence_tuples(F.collect_list(F.struct(F.col("run").alias("t"), "present"))).alias("presence"))
    point = F.struct("t", F.lit("exact").alias("state"), F.col("cents").alias("low"), F.col("cents").alias("high"))
    return a.join(prices.groupBy("part").agg(publication.price_tuples(F.collect_list(point)).alias("points")), "part")


@query("coverage_ids", """WITH s AS (SELECT s_suppkey AS n, s_suppkey % 7 AS k FROM supplier) SELECT n AS supplier, CASE k WHEN 0 THEN 'sitemap:c+r' WHEN 1 THEN 'sitemap:r' WHEN 2 THEN 'a' || n % 10 || '+x' WHEN 3 THEN 'shopify:collections/c' || n WHEN 4 THEN 'shopify:products' WHEN 5 THEN 'list:public' ELSE 'category:3000' END AS coverage FROM s""")
def coverage_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What snapshots of each shape claim to cover: families from the crawl or from the listings' addresses, names of genres, a collection, or always the same."""
    n = F.col("s_suppkey")
    url = lambda tail: F.struct(tail.alias("url"))
    listings = F.array(url(F.lit("https://shop.example/catalog/r/X_p2/")), url(F.concat(F.lit("https://shop.example/catalog/r/A"), (n % 10).cast("string"), F.lit("/"))), url(F.lit("https://shop.example/other/")))
    rows = table(spark, sf_dir, "supplier").select(
        n.alias("supplier"), (n % 7).alias("k"), F.when(n % 7 == 2, 2).otherwise(3).alias("schemaVersion"), F.when(n % 7 == 0, F.struct(F.array(F.lit("r"), F.lit("c"), F.lit("r")).alias("families"))).alias("crawl"),
        F.when(n % 7 != 2, listings).alias("listings"), F.when(n % 7 == 2, listings).alias("genres"), F.concat(F.lit("c"), n.cast("string")).alias("collection"),
    )
    shapes = {3: "catalogue", 4: "storefront", 5: "api", 6: "category"}
    found = normalize.coverage_id("listing")
    for k, shape in shapes.items():
        found = F.when(F.col("k") == k, normalize.coverage_id(shape)).otherwise(found)
    return rows.select("supplier", found.alias("coverage"))
