"""Registered queries on the write path, streams, shops' pages and sitemaps, and what is published. Parts and suppliers stand for products and pages, with faults put in at fixed keys."""

from __future__ import annotations

import gzip

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.times import DAY_MS
from ..operators import compare, graph, publication, rawchecks
from ..sources import sitemaps, snapshots
from ..sources.html import sitemap_locations
from ..sources.tables import EVENTS_SQL, event_stream, spread, table
from ..streaming import neighbours
from . import history
from .registry import query

SHARDS = 4
REVIEWED_FOR = 60
STORED_DAYS = (1, 3, 2, 3, 4, 5)  # the third comes twice, the fourth is cut off and must be kept out
FIRST_DAY = 1_767_225_600_000


@query("dataset_checks", """WITH r AS (SELECT p_partkey AS n, CASE WHEN p_partkey % 101 = 1 THEN p_partkey + 1 ELSE p_partkey END AS product FROM part), c AS (SELECT *, count(*) OVER (PARTITION BY product) AS k FROM r),
i AS (SELECT 'repeated key' AS issue FROM c WHERE k > 1 UNION ALL SELECT 'another version' FROM c WHERE n % 97 = 1 UNION ALL SELECT 'times do not rise' FROM c WHERE n % 89 = 1 OR n % 89 = 2
 UNION ALL SELECT 'amounts do not fit' FROM c WHERE n % 83 = 1 OR n % 79 = 1 OR n % 73 = 1 OR n % 71 = 1) SELECT issue, count(*) AS n FROM i GROUP BY issue""")
def dataset_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Product files of nested offers, some with repeated keys, another version, times that stand still and amounts that contradict their state."""
    n, cents = F.col("p_partkey"), F.col("p_size").cast("long")
    null = F.lit(None).cast("long")
    kind = F.when(n % 83 == 1, F.struct(F.lit("exact").alias("state"), cents.alias("low"), (cents + 1).alias("high"))).when(n % 79 == 1, F.struct(F.lit("unavailable").alias("state"), cents.alias("low"), cents.alias("high")))
    kind = kind.when(n % 73 == 1, F.struct(F.lit("range").alias("state"), cents.alias("low"), cents.alias("high"))).when(n % 71 == 1, F.struct(F.lit("exact").alias("state"), null.alias("low"), cents.alias("high")))
    kind = kind.when(n % 3 == 0, F.struct(F.lit("unavailable").alias("state"), null.alias("low"), null.alias("high"))).when(n % 3 == 1, F.struct(F.lit("range").alias("state"), cents.alias("low"), (cents + 5).alias("high")))
    kind = kind.otherwise(F.struct(F.lit("exact").alias("state"), cents.alias("low"), cents.alias("high")))
    point = lambda t: F.struct(t.cast("long").alias("t"), kind["state"].alias("state"), kind["low"].alias("low"), kind["high"].alias("high"))
    prices = F.array(point(F.lit(1)), point(F.when(n % 89 == 1, 1).otherwise(2)))
    presence = F.array(F.struct(F.lit(5).cast("long").alias("t")), F.struct(F.when(n % 89 == 2, 4).otherwise(6).cast("long").alias("t")))
    offers = F.array(F.struct(F.array(F.struct(prices.alias("prices"), presence.alias("presence"))).alias("segments")))
    files = table(spark, sf_dir, "part").select(F.lit("shop").alias("store"), F.when(n % 101 == 1, n + 1).otherwise(n).alias("product"), F.when(n % 97 == 1, "v2").otherwise("v1").alias("version"), offers.alias("offers"))
    return publication.dataset_issues(files, "v1")


@query("relation_shards", f"""WITH RECURSIVE r AS (SELECT p_partkey AS a FROM part WHERE p_partkey % 5 <> 0 AND p_partkey % 7 <> 0), s AS (SELECT a, a - row_number() OVER (ORDER BY a) AS run FROM r),
c AS (SELECT count(*) AS w FROM s GROUP BY run), o AS (SELECT w, row_number() OVER (ORDER BY w DESC) AS i FROM c),
g(i, loads, w, shard) AS (SELECT 0::BIGINT, list_transform(range({SHARDS}), lambda x: 0::BIGINT), NULL::BIGINT, NULL::BIGINT UNION ALL
 SELECT o.i, list_transform(g.loads, lambda x, j: CASE WHEN j = list_position(g.loads, list_min(g.loads)) THEN x + o.w ELSE x END), o.w, list_position(g.loads, list_min(g.loads)) - 1 FROM g JOIN o ON o.i = g.i + 1)
SELECT CAST(shard AS INTEGER) AS shard, w AS relations, count(*) AS components, CAST(sum(w + 1) AS BIGINT) AS nodes FROM g WHERE i > 0 GROUP BY ALL""")
def relation_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chains of related parts dealt to shards: per shard and number of relations, how many components and nodes. Which of two equal components a shard has is free."""
    n = F.col("p_partkey")
    relations = table(spark, sf_dir, "part").where((n % 5 != 0) & (n % 7 != 0)).select(n.alias("a"), (n + 1).alias("b"))
    found = publication.shards(relations, SHARDS).groupBy("component", "shard").agg(F.count("*").alias("nodes"))
    return found.groupBy("shard", (F.col("nodes") - 1).alias("relations")).agg(F.count("*").alias("components"), F.sum("nodes").alias("nodes"))


@query("comparison_reasons", f"""WITH q AS (SELECT p_partkey AS n, CAST(floor(p_retailprice) AS BIGINT) AS amount, 1 + (p_partkey % 11 = 0)::INT AS offers, p_partkey % 11 = 0 OR p_partkey % 3 <> 0 AS listed, p_partkey % 17 <> 1 AS matches, p_partkey % 19 <> 1 AS reviewed,
 CASE WHEN p_partkey % 7 = 0 THEN 'USD' ELSE 'JPY' END AS currency, p_partkey // 8 AS basis, (p_partkey % 100) * {DAY_MS}::BIGINT AS at, CASE p_partkey % 9 WHEN 0 THEN 2 WHEN 1 THEN 1 ELSE 0 END AS stock, (p_partkey % 11 = 0 AND p_partkey % 3 = 0)::INT AS offer FROM part),
e AS (SELECT n AS rel, n AS source, n + 1 AS target FROM q UNION ALL SELECT n, n + 1, n FROM q),
j AS (SELECT e.*, o.amount AS own_amount, t.amount AS amount, t.offer AS offer, CASE WHEN t.listed THEN t.stock ELSE 3 END AS tier, greatest(o.at, t.at) AS newest, CASE
 WHEN rel % 13 = 0 THEN 'not the same product' WHEN rel % 23 = 1 THEN 'not verified' WHEN t.n IS NULL THEN 'not loaded' WHEN NOT coalesce(o.matches AND t.matches, false) THEN 'product changed' WHEN rel % 29 IN (1, 2) THEN 'conditions not reviewed'
 WHEN o.offers > 1 OR t.offers > 1 THEN 'several offers' WHEN NOT (o.listed AND t.listed) THEN 'not listed' WHEN NOT (o.reviewed AND t.reviewed) THEN 'another offer' WHEN o.currency <> t.currency OR o.basis <> t.basis THEN 'another basis'
 WHEN greatest(o.at, t.at) > (rel % 31 + {REVIEWED_FOR}) * {DAY_MS}::BIGINT THEN 'review expired' WHEN rel % 37 = 1 THEN 'stale' END AS reason FROM e LEFT JOIN q o ON o.n = source LEFT JOIN q t ON t.n = target),
m AS (SELECT source, min(amount - own_amount) AS low FROM j WHERE reason IS NULL AND tier = 0 GROUP BY source)
SELECT j.source, target, offer, CAST(CASE WHEN amount IS NULL THEN 3 ELSE tier END AS INTEGER) AS tier, reason, CASE WHEN reason IS NULL THEN amount - own_amount END AS difference,
coalesce(reason IS NULL AND tier = 0 AND amount - own_amount = low AND low <= 0, false) AS cheapest FROM j LEFT JOIN m ON m.source = j.source""")
def comparison_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Relations between neighbouring parts seen from both ends: the first rule that keeps each from being compared, the difference where none does, the cheapest."""
    n, day = F.col("p_partkey"), F.lit(DAY_MS)
    offers = table(spark, sf_dir, "part").withColumn("offer", F.explode(F.when(n % 11 == 0, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))))
    offers = offers.withColumns({"present": (n + F.col("offer")) % 3 != 0, "last_present": F.col("offer") * 1000})
    state = F.when(n % 9 == 0, "out_of_stock").when(n % 9 == 1, "restocking").otherwise("in_stock")
    quotes = compare.current_offer(offers, ["p_partkey"]).select(
        n.alias("n"), "offer", F.col("present").alias("listed"), F.when(n % 11 == 0, 2).otherwise(1).alias("offers"), F.floor("p_retailprice").alias("amount"), (n % 17 != 1).alias("matches"), (n % 19 != 1).alias("offer_reviewed"),
        F.when(n % 7 == 0, "USD").otherwise("JPY").alias("currency"), F.floor(n / 8).alias("basis"), (n % 100 * day).alias("at"), state.alias("state"),
    )
    rel = F.col("rel")
    relations = table(spark, sf_dir, "part").select(n.alias("rel"), n.alias("a"), (n + 1).alias("b")).withColumns({
        "kind": F.when(rel % 13 == 0, "compatible").otherwise("same_product"), "status": F.when(rel % 23 == 1, "draft").otherwise("verified"), "verified_at": rel % 31 * day,
        "policy": F.when(rel % 29 != 2, rel % 29 != 1), "stale": rel % 37 == 1,
    })
    side = lambda name: quotes.select(*[F.col(c).alias(f"{name}_{c}") for c in quotes.columns])
    rows = compare.other_side(relations, "source").join(side("own"), F.col("source") == F.col("own_n"), "left").join(side("other"), F.col("target") == F.col("other_n"), "left")
    rows = rows.withColumns({"loaded": F.col("other_n").isNotNull(), "same_basis": F.col("own_basis") == F.col("other_basis"), "newest_at": F.greatest("own_at", "other_at"), "tier": compare.stock_tier(F.col("other_state"), F.coalesce("other_listed", F.lit(False)))})
    rows = rows.withColumn("reason", compare.eligibility(compare.comparison_rules(REVIEWED_FOR)))
    rows = rows.withColumn("difference", F.when(F.col("reason").isNull(), F.col("other_amount") - F.col("own_amount")))
    best = compare.cheapest(rows, ["source"]).select("source", "target", F.lit(True).alias("cheapest"))
    return rows.join(best, ["source", "target"], "left").select("source", "target", F.col("other_offer").alias("offer"), "tier", "reason", "difference", F.coalesce("cheapest", F.lit(False)).alias("cheapest"))


@query("streamed_change_points", f"""WITH {EVENTS_SQL}, b AS (SELECT user_id, t, event_id, event_type, lag(event_type) OVER (PARTITION BY user_id ORDER BY t, event_id) AS before, row_number() OVER (PARTITION BY user_id ORDER BY t, event_id) AS n FROM e)
SELECT user_id AS key, t * 1048576 + event_id % 1048576 AS t, event_type AS state FROM b WHERE n = 1 OR event_type IS DISTINCT FROM before""")
def streamed_change_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as a stream of four slices whose state is read and written beside what comes in: each user's times out of order and some of them twice; what the stream settles on is what a batch gives."""
    e, base = event_stream(spark, sf_dir), graph.scratch(spark, "stream")
    at = F.col("t") * 1_048_576 + F.col("event_id") % 1_048_576  # rows of one time follow each other by event
    own, again = F.col("event_id") % 4, F.col("event_id") % 5
    e.select(F.col("user_id").alias("key"), at.alias("t"), F.col("event_type").alias("state"), F.explode(F.array_distinct(F.array(own, F.when(again < 4, again).otherwise(own)))).alias("slice")).write.partitionBy("slice").parquet(f"{base}/in")
    schema = f"key {e.schema['user_id'].dataType.simpleString()}, t long, state string, slice int"
    files = len(spark.read.schema(schema).parquet(f"{base}/in").inputFiles())
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", max(1, files // 4)).parquet(f"{base}/in")
    with neighbours.state_store(spark, spark.sparkContext.defaultParallelism):
        sink = neighbours.updates(stream).writeStream.outputMode("update").foreachBatch(neighbours.batches_into(f"{base}/out"))
        sink.option("checkpointLocation", f"{base}/progress").trigger(availableNow=True).start().awaitTermination()
    return neighbours.settled(spark.read.parquet(f"{base}/out"))


def _snapshot(spark: SparkSession, sf_dir: str, day: int) -> DataFrame:
    """A day's snapshot in rows of 1,000 parts: prices step up on one day each, a few parts are missing on the third day, the fourth has every other part only."""
    n = F.col("p_partkey")
    p = table(spark, sf_dir, "part").where(n % 2 == 0 if day == 4 else (n % 41 != 0) | F.lit(day != 3))
    cents = (F.floor("p_retailprice") + F.when(n % 29 >= 29 - day, 100).otherwise(0)).cast("long")
    null = F.lit(None).cast("string")
    quote = F.struct(F.lit("selling"), F.lit("tax_included"), F.lit("JPY"), F.lit("exact"), cents, cents, F.lit("1個")).cast(snapshots.QUOTE)
    stock = F.struct(F.lit("in_stock"), F.lit(True), F.col("p_size").cast("long"), F.lit("site_reported"), F.lit(False), null).cast(snapshots.AVAILABILITY)
    offer = F.struct(F.lit("o"), F.lit("default"), null, null, F.array(quote), stock).cast(snapshots.OFFER)
    names = F.struct(F.col("p_name"), null, null, F.lit("/"))
    key = F.concat(F.lit("p"), n.cast("string"))
    product = F.struct(key, key, F.array().cast("array<struct<kind:string,value:string>>"), names, F.array(offer)).cast(snapshots.PRODUCT)
    rows = spread(p.withColumn("g", F.floor(n / 1000)), "g").groupBy("g").agg(F.collect_list(product).alias("products"))
    return rows.select(F.lit("shop").alias("storeId"), F.lit(f"2026-01-{day:02d}T00:00:00.000Z").alias("observedAt"), F.lit("1").alias("sourceSchemaVersion"), F.lit(True).alias("complete"), F.lit("all").alias("coverageId"), F.lit("").alias("rawSha256"), F.lit(f"day {day}").alias("normalizedHash"), "products")


@query("imported_history", f"""WITH o AS (SELECT 'p' || p_partkey AS product, p_partkey AS n, d, row_number() OVER (PARTITION BY p_partkey ORDER BY d) AS k, {FIRST_DAY} + (d - 1) * {DAY_MS}::BIGINT AS t, CAST(floor(p_retailprice) AS BIGINT) + CASE WHEN p_partkey % 29 >= 29 - d THEN 100 ELSE 0 END AS cents
 FROM part, (VALUES (1), (2), (3), (5)) v(d) WHERE d <> 3 OR p_partkey % 41 <> 0), b AS (SELECT *, lag(cents) OVER (PARTITION BY n ORDER BY d) AS before FROM o)
SELECT 'price' AS kind, product, t, cents AS value FROM b WHERE before IS NULL OR before <> cents UNION ALL SELECT 'present', product, t, 1 FROM o WHERE k = 1 OR (n % 41 = 0 AND d = 5)
UNION ALL SELECT 'present', product, t + {DAY_MS}, 0 FROM o WHERE n % 41 = 0 AND d = 2 UNION ALL SELECT 'rejected', NULL, {FIRST_DAY} + 3 * {DAY_MS}::BIGINT, 1""")
def imported_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Snapshots imported out of order, one of them twice, into a state of its own: its price points, its presence and what it kept out."""
    state = history.State(spark, graph.scratch(spark, "state"))
    for day in STORED_DAYS:
        history.import_snapshot(state, _snapshot(spark, sf_dir, day))
    row = lambda df, kind, product, value: df.select(F.lit(kind).alias("kind"), product.alias("product"), "t", value.cast("long").alias("value"))
    prices = row(history.price_series(state), "price", F.col("product"), F.col("low"))
    present = row(history.segment_presence(state), "present", F.col("product"), F.col("present"))
    return prices.unionByName(present).unionByName(row(state.read("rejected"), "rejected", F.lit(None).cast("string"), F.lit(1)))


@F.pandas_udf(T.BinaryType())
def _zipped(text: pd.Series) -> pd.Series:
    return text.map(lambda t: gzip.compress(t.encode()))


def _sitemaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A sitemap for each 100 parts, every other one gzipped: products, categories, genres, handles plain and escaped, and addresses that name nothing."""
    n = F.col("p_partkey")
    text, few = n.cast("string"), (n % 50).cast("string")
    forms = [
        ("/catalog/g/g", text, "/"), ("/catalog/g/gx", text, "/"), ("/catalog/c/c", few, "_p2/"), ("/catalog/r/r-", few, ""), ("/products/part-", text, ""),
        ("/products/%E8%B5%A4+", text, "/"), ("/products/%21bad &amp; ", text, ""), ("/products/%E8%ZZ", text, ""), ("/products/%E8", text, ""),
    ]
    path = F.lit(None).cast("string")
    for i, (before, value, after) in enumerate(forms):
        path = F.when(n % len(forms) == i, F.concat(F.lit(f"https://shop.example{before}"), value, F.lit(after))).otherwise(path)
    rows = table(spark, sf_dir, "part").select((n / 100).cast("long").alias("g"), n.alias("n"), F.concat(F.lit("<url><loc> "), path, F.lit(" </loc></url>")).alias("x"))
    xml = F.concat(F.lit("<urlset>"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n", "x"))), lambda r: r["x"]), "\n"), F.lit("</urlset>"))
    maps = rows.groupBy("g").agg(xml.alias("xml"))
    return maps.select("g", F.when(F.col("g") % 2 == 0, _zipped("xml")).otherwise(F.col("xml").cast("binary")).alias("body"))


@query("sitemap_addresses", """WITH r AS (SELECT CASE p_partkey % 9 WHEN 0 THEN 'product' WHEN 2 THEN 'category' WHEN 3 THEN 'genre' WHEN 4 THEN 'handle' WHEN 5 THEN 'handle' WHEN 6 THEN 'unsupported' END AS kind,
 CASE p_partkey % 9 WHEN 0 THEN p_partkey::VARCHAR WHEN 2 THEN 'c' || p_partkey % 50 WHEN 3 THEN 'r-' || p_partkey % 50 WHEN 4 THEN 'part-' || p_partkey WHEN 5 THEN '赤+' || p_partkey WHEN 6 THEN '!bad & ' || p_partkey END AS id FROM part)
SELECT kind, id, count(*) AS n FROM r WHERE kind IS NOT NULL GROUP BY ALL""")
def sitemap_addresses(spark: SparkSession, sf_dir: str) -> DataFrame:
    maps = _sitemaps(spark, sf_dir).select("g", sitemaps.body_text("body").alias("xml"))
    return sitemaps.addressed(sitemap_locations(maps, "g", "xml"), "loc")


@query("sitemap_indexes", f"""SELECT s_suppkey AS supplier, count(n_nationkey) AS maps, min('https://shop.example/m?a=' || n_nationkey || '&b=1') AS first, max(CASE WHEN n_nationkey % 3 <> 0 THEN strftime(DATE '2026-01-01' + CAST(n_nationkey + s_suppkey % 28 AS INTEGER), '%Y-%m-%d') END) AS modified
FROM supplier JOIN nation ON n_nationkey % 5 = s_suppkey % 5 WHERE n_nationkey % 10 <> 9 GROUP BY s_suppkey""")
def sitemap_indexes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per supplier's index: its sub-sitemaps, the first address and the newest date; some entries have no date, some no address."""
    k, s = F.col("n_nationkey"), F.col("s_suppkey")
    nations = F.broadcast(table(spark, sf_dir, "nation").select("n_nationkey", (k % 5).alias("m")))  # a table of 25 rows
    date = F.date_format(F.date_add(F.lit("2026-01-01").cast("date"), (k + s % 28).cast("int")), "yyyy-MM-dd")
    loc = F.when(k % 10 != 9, F.concat(F.lit("<loc>https://shop.example/m?a="), k.cast("string"), F.lit("&amp;b=1</loc>"))).otherwise("")
    entry = F.concat(F.lit("<sitemap>"), loc, F.when(k % 3 != 0, F.concat(F.lit("\n<lastmod>"), date, F.lit("</lastmod>"))).otherwise(""), F.lit("</sitemap>"))
    rows = table(spark, sf_dir, "supplier").select("s_suppkey", (s % 5).alias("m")).join(nations, "m").groupBy(s.alias("supplier")).agg(F.array_join(F.collect_list(entry), "").alias("xml"))
    found = sitemaps.index_entries(rows, "supplier", "xml")
    return found.groupBy("supplier").agg(F.count("*").alias("maps"), F.min("url").alias("first")).join(sitemaps.newest(found, "supplier"), "supplier")


@query("crawl_choices", f"""WITH p AS (SELECT DISTINCT l_suppkey AS s, l_partkey AS p FROM lineitem WHERE l_partkey % 40 = 3), a AS (SELECT s, count(*) AS listings, sum(p % 7 + 1) AS pages, count(*) FILTER (WHERE p % 200 = 43) AS gone FROM p GROUP BY s),
r AS (SELECT s_suppkey AS s, coalesce(listings, 0) AS listings, coalesce(pages, 0) AS pages, CASE WHEN s_suppkey % 17 = 1 THEN 'not configured' WHEN s_suppkey % 13 = 1 THEN 'listings given' WHEN s_suppkey % 11 = 1 THEN 'no full run' WHEN s_suppkey % 7 = 1 THEN 'other families'
 WHEN s_suppkey % 9 = 0 THEN 'dated ahead' WHEN (s_suppkey % 9) * {DAY_MS // 2}::BIGINT >= 3 * {DAY_MS}::BIGINT - {rawchecks.FULL_RUN_SLACK_MS} THEN 'full run due' WHEN gone > 0 THEN 'listings gone' END AS reason FROM supplier LEFT JOIN a ON a.s = s_suppkey)
SELECT s AS supplier, CASE WHEN reason IS NULL THEN 'cover' ELSE 'full' END AS mode, reason, listings, CAST(pages AS BIGINT) AS pages FROM r""")
def crawl_choices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers as shops: whether the next crawl may walk the planned listings alone, and what speaks against it."""
    s, p = F.col("s_suppkey"), F.col("l_partkey")
    both, one = F.array(F.lit("r"), F.lit("c")), F.array(F.lit("c"))
    shops = table(spark, sf_dir, "supplier").select(
        s.alias("supplier"), (s % 17 != 1).alias("configured"), (s % 13 == 1).alias("named"), F.when(s % 11 != 1, F.when(s % 7 == 1, one).otherwise(both)).alias("families"), F.array_sort(both).alias("wanted"),
        F.when(s % 9 == 0, -1).otherwise(s % 9 * (DAY_MS // 2)).cast("long").alias("age"), F.lit(3).alias("every_days"),
    )
    shown = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("supplier"), p.alias("id")).distinct()
    planned = shown.where(F.col("id") % 40 == 3).withColumn("pages", F.col("id") % 7 + 1)
    return rawchecks.crawl_choice(shops, planned, shown.where(F.col("id") % 200 != 43), "supplier")
