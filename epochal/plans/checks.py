"""Registered queries on raw snapshots' rules: parts stand for a shop's items, with faults put in at fixed keys."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import rawchecks
from ..sources.tables import spread, table
from .registry import query


def _counts(issues: DataFrame) -> DataFrame:
    """Per code: how many subjects, the least and the greatest of them."""
    return issues.groupBy("code").agg(F.count("*").alias("n"), F.min("subject").alias("first"), F.max("subject").alias("last"))


_COUNTED = "SELECT code, count(*) AS n, min(subject) AS first, max(subject) AS last FROM i GROUP BY code"


def _rules_sql(rows: str, subject: str, rules: dict[str, str]) -> str:
    each = " UNION ALL ".join(f"SELECT '{k}' AS code, ({subject})::VARCHAR AS subject FROM r WHERE {c}" for k, c in rules.items())
    return f"WITH {rows}, i AS ({each}) {_COUNTED}"


@query("raw_listing_issues", _rules_sql("""r0 AS (SELECT p_partkey AS n, p_name, p_size, p_retailprice FROM part), r1 AS (SELECT * FROM r0 UNION ALL SELECT * FROM r0 WHERE n % 301 = 300),
r AS (SELECT *, CASE WHEN n % 401 = 400 THEN 'x' || n ELSE n::VARCHAR END AS code, n % 401 <> 400 AS ok FROM r1)""", "code", {
    "item.sales_code": "NOT ok", "item.duplicate": "ok AND n % 301 = 300", "item.name": "ok AND n % 97 = 1", "item.url": "ok AND n % 89 = 1", "item.prices": "ok AND n % 83 = 1", "warn.multiple_prices": "ok AND n % 83 <> 1 AND p_size % 10 = 3",
    "item.price_amount": "ok AND n % 83 <> 1 AND n % 79 = 1", "warn.price_zero": "ok AND n % 83 <> 1 AND n % 79 = 2", "item.price_unit": "ok AND n % 83 <> 1 AND n % 73 = 1", "item.price_tax": "ok AND n % 83 <> 1 AND n % 71 = 1 AND n % 79 <> 3",
    "item.stock": "ok AND n % 67 = 1", "item.status": "ok AND n % 67 <> 1 AND n % 61 = 1", "item.quantity": "ok AND n % 67 <> 1 AND n % 59 = 1", "warn.quantity_not_purchasable": "ok AND n % 67 <> 1 AND n % 59 <> 1 AND n % 53 <> 1 AND p_size > 0 AND n % 7 = 0"}))
def raw_listing_issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part")
    p = p.unionByName(p.where("p_partkey % 301 = 300"))
    n = F.col("p_partkey")
    at = lambda m, k=1: n % m == k
    code = F.when(at(401, 400), F.concat(F.lit("x"), n.cast("string"))).otherwise(n.cast("string"))
    amount = F.when(at(79), -1).when(at(79, 2), 0).when(~at(79, 3), F.floor("p_retailprice")).cast("long")
    price = F.struct(amount.alias("amountYen"), F.when(at(73), "").otherwise("1個").alias("quantityUnit"), (~at(71)).alias("taxIncluded"))
    prices = F.when(at(83), F.array().cast("array<struct<amountYen:bigint,quantityUnit:string,taxIncluded:boolean>>")).when(F.col("p_size") % 10 == 3, F.array(price, price)).otherwise(F.array(price))
    stock = F.struct(F.when(~at(61), "在庫").alias("status"), F.when(at(59), -5).when(~at(53), F.col("p_size")).cast("long").alias("availableQuantity"), (n % 7 != 0).alias("purchasable"))
    url = F.concat(F.lit("/catalog/g/g"), code)
    items = p.select(code.alias("salesCode"), F.when(at(97), " ").otherwise(F.col("p_name")).alias("name"), F.when(at(89), "/elsewhere").otherwise(url).alias("url"), prices.alias("prices"), F.when(~at(67), stock).alias("stock"))
    return _counts(rawchecks.found(items, "salesCode", rawchecks.listing_rules(F.concat(F.lit("/catalog/g/g"), F.col("salesCode")))))


@query("raw_catalogue_issues", _rules_sql("r AS (SELECT p_partkey AS n, p_size AS s, CASE p_partkey % 97 WHEN 1 THEN 'Upper' || p_partkey WHEN 2 THEN '-x' || p_partkey WHEN 3 THEN 'same' WHEN 4 THEN repeat('h', 64) || p_partkey WHEN 5 THEN 'foo.bar_' || p_partkey ELSE 'h' || p_partkey END AS handle FROM part)", "handle", {
    "item.handle": "n % 97 IN (1, 2, 4)", "item.duplicate": "n % 97 = 3", "item.product_id": "n % 89 = 1", "item.product_duplicate": "n % 89 = 1", "item.title": "n % 83 = 1", "item.variants": "n % 79 = 1", "item.variant_duplicate": "n % 79 <> 1 AND n % 73 = 1",
    "item.price": "n % 79 <> 1 AND n % 71 = 1", "warn.price_zero": "n % 79 <> 1 AND n % 71 = 2", "warn.compare_at": "n % 79 <> 1 AND n % 71 NOT IN (1) AND n % 5 = 0 AND CASE WHEN n % 71 = 2 THEN 0 ELSE s END >= 20", "item.available": "n % 79 <> 1 AND n % 67 = 1"}))
def raw_catalogue_issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("p_partkey")
    at = lambda m, k=1: n % m == k
    text = n.cast("string")
    handle = F.when(at(97), F.concat(F.lit("Upper"), text)).when(at(97, 2), F.concat(F.lit("-x"), text)).when(at(97, 3), "same").when(at(97, 4), F.concat(F.lit("h" * 64), text)).when(at(97, 5), F.concat(F.lit("foo.bar_"), text)).otherwise(F.concat(F.lit("h"), text))
    price = F.when(at(71, 2), 0).when(~at(71), F.col("p_size")).cast("long")
    one = lambda i: F.struct((n * 10 + i).alias("variantId"), price.alias("priceYen"), F.when(n % 5 == 0, F.lit(20).cast("long")).alias("compareAtPriceYen"), F.when(~at(67), n % 2 == 0).alias("available"))
    variants = F.when(at(79), F.slice(F.array(one(0)), 1, 0)).when(at(73), F.array(one(0), one(0))).otherwise(F.array(one(0), one(1)))
    items = table(spark, sf_dir, "part").select(handle.alias("handle"), F.when(at(89), F.lit(0).cast("long")).otherwise(n + 1).alias("productId"), F.when(at(83), "").otherwise(F.col("p_name")).alias("title"), variants.alias("variants"))
    return _counts(rawchecks.found(items, "handle", rawchecks.catalogue_rules()))


_SITE = """h AS (SELECT p_partkey AS n, 'h' || p_partkey AS handle FROM part), m AS (SELECT handle FROM h WHERE n % 3 = 0 UNION ALL SELECT handle FROM h WHERE n % 60 = 0 UNION ALL SELECT 'gone' || n FROM h WHERE n % 400 = 7)"""


@query("raw_storefront_issues", f"""WITH {_SITE}, i AS (SELECT 'item.price' AS code, handle AS subject FROM h WHERE n % 41 = 1 AND n % 43 <> 1 UNION ALL SELECT 'item.id_duplicate', handle FROM h WHERE n % 211 = 5 AND (SELECT count(*) FROM part WHERE p_partkey % 211 = 5) > 1 UNION ALL SELECT 'item.variants', handle FROM h WHERE n % 43 = 1
UNION ALL SELECT 'sitemap.uncovered', 'gone' || n FROM h WHERE n % 400 = 7 UNION ALL SELECT 'sitemap.duplicate', handle FROM h WHERE n % 60 = 0 UNION ALL SELECT 'pages.stray', (n * 10 + 7)::VARCHAR FROM h WHERE n % 100 = 1) {_COUNTED}""")
def raw_storefront_issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items against their own rules, the sitemap's pages against the items, and read counts against their variants."""
    p = table(spark, sf_dir, "part")
    n = F.col("p_partkey")
    handle = F.concat(F.lit("h"), n.cast("string"))
    v = F.array(F.struct((n * 10).alias("id"), F.when(n % 41 == 1, "12.345").otherwise("12.50").alias("price"), F.when(n % 2 == 0, "20").alias("compare_at_price")))
    items = p.select(F.when(n % 211 == 5, F.lit(-1).cast("long")).otherwise(n).alias("id"), handle.alias("handle"), F.when(n % 43 == 1, F.slice(v, 1, 0)).otherwise(v).alias("variants"), n.alias("__n"))
    site = p.where(n % 3 == 0).select(handle.alias("handle")).unionByName(p.where(n % 60 == 0).select(handle.alias("handle"))).unionByName(p.where(n % 400 == 7).select(F.concat(F.lit("gone"), n.cast("string")).alias("handle")))
    pages = p.where((n % 50 == 1) & (n % 43 != 1)).select(F.create_map((n * 10 + F.when(n % 100 == 1, 7).otherwise(0)).cast("string"), F.lit(3).cast("long")).alias("quantities"))
    strays = p.where(n % 100 == 1).select(F.create_map((n * 10 + 7).cast("string"), F.lit(3).cast("long")).alias("quantities"))
    found = rawchecks.found(items, "handle", rawchecks.storefront_rules())
    return _counts(found.unionByName(rawchecks.uncovered(items, site)).unionByName(rawchecks.stray_counts(pages.unionByName(strays), items)))


@query("raw_api_issues", _rules_sql("r AS (SELECT p_partkey AS n, p_size, CAST(floor(p_retailprice) AS BIGINT) AS price FROM part)", "CASE WHEN n % 97 = 1 THEN 0 ELSE n END", {
    "item.id": "n % 97 = 1 OR n = 0", "item.duplicate": "n % 97 = 1 OR n = 0", "item.name": "n % 89 = 1", "item.price": "n % 83 = 1", "item.taxrate": "n % 79 = 1", "item.tax": "n % 83 <> 1 AND n % 73 = 1 AND n % 79 <> 1", "item.stock": "n % 71 = 1", "item.onlist": "n % 67 = 1", "item.make": "n % 61 = 1", "item.model": "n % 59 = 1", "item.status": "n % 53 IN (1, 2)"}))
def raw_api_issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Taxes are those contained in the prices, one yen more or less, but for some that were put on top."""
    n, price = F.col("p_partkey"), F.floor("p_retailprice")
    at = lambda m: n % m == 1
    contained = F.floor(price - price / 1.1 + 0.5)
    items = table(spark, sf_dir, "part").select(
        F.when(at(97), F.lit(0).cast("long")).otherwise(n).alias("id"), F.when(at(89), " ").otherwise(F.col("p_name")).alias("name"), F.when(at(83), -1).otherwise(price).cast("long").alias("price"),
        F.when(at(79), F.lit(1.0)).otherwise(F.lit(1.1)).alias("taxrate"), F.when(at(79), F.lit(0)).when(at(73), F.floor(price / 10)).otherwise(contained + n % 3 - 1).cast("long").alias("tax"),
        F.when(at(71), -1).otherwise(F.col("p_size")).cast("long").alias("stock"), F.when(at(67), 0).otherwise(1).alias("onlist"),
        F.when(~at(61), "").alias("make"), F.when(~at(59), n.cast("string")).alias("model"), F.struct(F.when(n % 53 == 2, -1).otherwise(3).alias("id"), F.when(at(53), " ").otherwise("on sale").alias("name")).alias("status"),
    )
    return _counts(rawchecks.found(items, "id", rawchecks.api_rules()))


@query("raw_category_issues", f"""WITH q AS (SELECT p_partkey AS n, p_size AS s, CASE WHEN p_partkey % 97 = 1 THEN 'low-' || p_partkey ELSE 'C-' || p_partkey END AS code FROM part),
a AS (SELECT s AS cid, count(*) AS c FROM (SELECT s, n FROM q UNION SELECT s + 100, n FROM q WHERE n % 2 = 0) GROUP BY s),
t AS (SELECT cid, CASE cid % 11 WHEN 1 THEN c + 1 WHEN 2 THEN 2000 ELSE c END AS total, c FROM a WHERE cid % 13 <> 5),
i AS (SELECT 'item.code' AS code, code AS subject FROM q WHERE n % 97 = 1 UNION ALL SELECT 'item.listings', code FROM q WHERE n % 89 = 1 AND n % 2 = 0 UNION ALL SELECT 'item.line_unit', code FROM q WHERE n % 83 = 1 UNION ALL SELECT 'item.line_amount', code FROM q WHERE n % 79 = 1
UNION ALL SELECT 'listing.total', cid::VARCHAR FROM t WHERE total >= 2000 UNION ALL SELECT 'listing.pages', cid::VARCHAR FROM t WHERE cid % 7 = 3 UNION ALL SELECT 'listing.products', cid::VARCHAR FROM t WHERE total <> c UNION ALL SELECT 'listing.unread', cid::VARCHAR FROM a WHERE cid % 13 = 5
UNION ALL SELECT 'listing.split', cid::VARCHAR FROM t WHERE cid = 4) {_COUNTED}""")
def raw_category_issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A product is in the listing of its size and, if its key is even, in a second one; listings' own totals and pages are wrong at some ids."""
    n, s = F.col("p_partkey"), F.col("p_size").cast("long")
    two = F.array(s, s + 100)
    line = F.struct(F.when(n % 83 != 1, F.lit(1)).alias("minQuantity"), F.lit("個").alias("quantityUnit"), F.lit("単価").alias("label"), F.when(n % 79 != 1, F.lit(10)).alias("amountYen"))
    items = table(spark, sf_dir, "part").select(
        F.concat(F.when(n % 97 == 1, "low-").otherwise("C-"), n.cast("string")).alias("code"), F.col("p_name").alias("name"), F.when(n % 2 == 1, F.array(s)).when(n % 89 == 1, F.reverse(two)).otherwise(two).alias("listings"), F.array(line).alias("priceLines"),
    )
    c = items.select("code", F.explode("listings").alias("cid")).groupBy("cid").agg(F.count("*").alias("c")).where("cid % 13 <> 5")
    total = F.when(F.col("cid") % 11 == 1, F.col("c") + 1).when(F.col("cid") % 11 == 2, 2000).otherwise(F.col("c"))
    listings = c.select("cid", total.alias("total")).withColumn("pages", F.ceil(F.col("total") / 40) + (F.col("cid") % 7 == 3).cast("int"))
    split = spark.range(4, 5).select(F.col("id").alias("cid"))
    return _counts(rawchecks.found(items, "code", rawchecks.category_rules()).unionByName(rawchecks.listing_totals(items, listings, split)))


@query("page_sections", """WITH r AS (SELECT s_suppkey AS n FROM supplier), i AS (SELECT 'pages.shards' AS code, n::VARCHAR AS subject FROM r WHERE n % 17 = 1 UNION ALL SELECT 'pages.shard', n::VARCHAR FROM r WHERE n % 17 = 1 OR n % 13 = 1 UNION ALL SELECT 'pages.counts', n::VARCHAR FROM r WHERE n % 11 IN (1, 2)
UNION ALL SELECT 'pages.quantity', n::VARCHAR FROM r WHERE n % 7 = 1 UNION ALL SELECT 'pages.round', n::VARCHAR FROM r WHERE n % 19 = 1 UNION ALL SELECT 'warning: ' || CASE WHEN n % 5 = 0 THEN '' ELSE (n % 5)::VARCHAR || ' pages failed: ' || 'k1: r; k2: r; k3: r'[1:7 * least(n % 5, 3) - 2]
|| CASE WHEN n % 5 > 3 THEN '; and ' || (n % 5 - 3) || ' more' ELSE '' END END || CASE WHEN n % 5 > 0 AND n % 3 = 0 THEN ' / ' ELSE '' END || CASE WHEN n % 3 = 0 THEN 'stopped: limit' ELSE '' END, n::VARCHAR FROM r WHERE n % 5 > 0 OR n % 3 = 0) SELECT code, count(*) AS n, min(subject) AS first, max(subject) AS last FROM i GROUP BY code""")
def page_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("s_suppkey")
    failures = F.transform(F.slice(F.array(*map(F.lit, ("k1", "k2", "k3", "k4"))), F.lit(1), (n % 5).cast("int")), lambda k: F.struct(k.alias("key"), F.lit("r").alias("reason")))
    pages = table(spark, sf_dir, "supplier").select(
        n.alias("id"), F.when(n % 17 != 1, 7).otherwise(0).alias("shards"), F.when(n % 13 == 1, 7).otherwise(n % 7).alias("shard"), F.lit(20).alias("eligible"), F.when(n % 11 == 1, 21).otherwise(10).alias("selected"), F.when(n % 11 == 2, 11).otherwise(5).alias("read"),
        F.create_map(F.lit("a"), F.when(n % 7 == 1, -1).when(n % 7 == 2, None).otherwise(4)).alias("quantities"), F.when(n % 19 != 1, n).alias("round"), failures.alias("failures"), F.when(n % 3 == 0, "limit").alias("stopped"),
    )
    told = rawchecks.page_warnings(pages).where(F.size("warnings") > 0).select(F.concat(F.lit("warning: "), F.array_join("warnings", " / ")).alias("code"), F.col("id").cast("string").alias("subject"))
    return _counts(rawchecks.found(pages, "id", rawchecks.page_section_rules()).unionByName(told))


@query("capability_switches", """SELECT s_suppkey, CASE WHEN s_suppkey % 5 = 1 OR s_suppkey % 7 = 1 OR s_suppkey % 11 = 1 THEN NULL ELSE s_suppkey % 2 = 0 END AS variants, CASE WHEN s_suppkey % 5 = 1 OR s_suppkey % 7 = 1 OR s_suppkey % 11 = 1 THEN NULL WHEN s_suppkey % 3 = 0 THEN 100 END::BIGINT AS cap FROM supplier""")
def capability_switches(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("s_suppkey")
    flag = lambda c: F.concat(F.lit(f'"{c}":'), F.when(F.lit(c == "supportsTaxExcluded") & (n % 5 == 1), '"yes"').when(F.lit(c == "supportsVariants"), (n % 2 == 0).cast("string")).otherwise("true"))
    cap = F.when(n % 7 == 1, ',"inventoryQuantityCap":0').when(n % 3 == 0, ',"inventoryQuantityCap":100').otherwise("")
    quote = F.when(n % 11 == 1, ',"primaryQuote":{"quoteKind":"selling"}}').otherwise(',"primaryQuote":{"quoteKind":"selling","taxTreatment":"unknown"}}')
    text = F.concat(F.lit("{"), F.concat_ws(",", *[flag(c) for c in rawchecks.CAPABILITIES]), F.lit(',"inventoryQuantitySemantics":"site_reported"'), cap, quote)
    c = table(spark, sf_dir, "supplier").select("s_suppkey", rawchecks.capabilities(text).alias("c"))
    return c.select("s_suppkey", F.col("c.supportsVariants").alias("variants"), F.col("c.inventoryQuantityCap").alias("cap"))


@query("crawl_quality", """WITH o AS (SELECT l_partkey AS key, count(*) AS n, bool_or(l_quantity < 2) AS name, bool_or(l_tax = 0) AS model, max(l_linenumber) AS v, bool_or(l_returnflag = 'A' AND l_discount = 0.1) AS u FROM lineitem GROUP BY 1)
SELECT count(*) AS items, CAST(sum(n - 1) AS BIGINT) AS duplicates, count(*) FILTER (WHERE name) AS missing_name, count(*) FILTER (WHERE model) AS missing_model, count(*) FILTER (WHERE v > 1) AS multi_variant, count(*) FILTER (WHERE u) AS unavailable FROM o""")
def crawl_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = table(spark, sf_dir, "lineitem")
    return rawchecks.crawl_quality(x.select(F.col("l_partkey").alias("key"), F.when(F.col("l_quantity") < 2, "").otherwise("n").alias("name"), F.when(F.col("l_tax") != 0, "m").alias("model"), F.col("l_linenumber").alias("variants"), ((F.col("l_returnflag") == "A") & (F.col("l_discount") == 0.1)).alias("unavailable")))


@query("run_budget", """SELECT o_orderkey, CAST(ceil(o_custkey / 60.0) AS BIGINT) AS minutes, CAST(floor(o_custkey / (20 * 60.0::DOUBLE) * 100 + 0.5) AS BIGINT) AS percent, o_custkey > 960 AS over FROM orders""")
def run_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select("o_orderkey", rawchecks.run_budget(F.col("o_custkey"), F.lit(20)).alias("b")).select("o_orderkey", "b.*")


@query("cover_cache", """WITH m AS (SELECT DISTINCT l_suppkey AS s, l_partkey AS p FROM lineitem WHERE l_partkey % 50 <> 7), s AS (SELECT DISTINCT s FROM m),
i AS (SELECT 'cover.id' AS code, CASE WHEN s % 23 = 1 THEN 'x/' ELSE 'c/' END || s AS subject FROM s WHERE s % 23 = 1 UNION ALL SELECT 'cover.pages', CASE WHEN s % 23 = 1 THEN 'x/' ELSE 'c/' END || s FROM s WHERE s % 19 = 1 UNION ALL SELECT 'cover.layout', CASE WHEN s % 23 = 1 THEN 'x/' ELSE 'c/' END || s FROM s WHERE s % 17 = 1
UNION ALL SELECT DISTINCT 'cover.unknown', p::VARCHAR FROM m WHERE p % 60 = 11 UNION ALL SELECT 'cover.hidden', p_partkey::VARCHAR FROM part WHERE p_partkey % 60 <> 11 AND p_partkey NOT IN (SELECT p FROM m)) SELECT code, count(*) AS n, min(subject) AS first, max(subject) AS last FROM i GROUP BY code""")
def cover_cache(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = F.col("l_suppkey")
    shown = table(spark, sf_dir, "lineitem").where("l_partkey % 50 <> 7").groupBy("l_suppkey").agg(F.collect_set("l_partkey").alias("items"))
    listings = shown.select(F.concat(F.when(s % 23 == 1, "x/").otherwise("c/"), s.cast("string")).alias("id"), F.when(s % 19 == 1, 0).otherwise(s % 50 + 1).alias("pages"), F.when(s % 17 == 1, "grid").otherwise("card").alias("layout"), F.lit(False).alias("truncated"), "items")
    return _counts(rawchecks.cover_cache_issues(listings, table(spark, sf_dir, "part").where("p_partkey % 60 <> 11").select(F.col("p_partkey").alias("product"))))


@query("repair_pick", """WITH m AS (SELECT DISTINCT l_suppkey AS id, l_partkey AS product FROM lineitem), g AS (SELECT id, count(*) AS gain, id % 9 + 1 AS pages, id % 2 = 1 AS stable FROM m WHERE id % 3 <> 0 AND product % 40 = 3 GROUP BY id)
SELECT id, gain, pages, stable FROM g ORDER BY stable DESC, gain / pages::DOUBLE DESC, gain DESC, id LIMIT 1""")
def repair_pick(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("id"), F.col("l_partkey").alias("product"))
    s = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id"))
    missing = table(spark, sf_dir, "part").where("p_partkey % 40 = 3").select(F.col("p_partkey").alias("product"))
    return rawchecks.repair_pick(m, missing, s.where("id % 3 = 0"), s.select("id", (F.col("id") % 9 + 1).alias("pages"), (F.col("id") % 2 == 1).alias("stable")))


@query("same_listings", """SELECT l_partkey, count(*) AS pairs, count(*) FILTER (WHERE a AND b AND c) AS same FROM (SELECT l_partkey, l_quantity = lag(l_quantity) OVER w AS a, l_returnflag = lag(l_returnflag) OVER w AS b, l_linestatus = 'O' OR lag(l_linestatus) OVER w = 'O' OR (l_tax > 0.04) = lag(l_tax > 0.04) OVER w AS c, row_number() OVER w AS n FROM lineitem
WINDOW w AS (PARTITION BY l_partkey ORDER BY l_orderkey, l_linenumber, l_suppkey, l_quantity, l_extendedprice)) WHERE n > 1 GROUP BY l_partkey""")
def same_listings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many neighbouring occurrences of each product state the same."""
    from pyspark.sql import Window

    x = table(spark, sf_dir, "lineitem")
    facts = F.struct(F.array("l_quantity").alias("prices"), F.col("l_returnflag").alias("status"), F.when(F.col("l_linestatus") != "O", F.col("l_tax") > 0.04).alias("purchasable"))
    w = Window.partitionBy("l_partkey").orderBy("l_orderkey", "l_linenumber", "l_suppkey", "l_quantity", "l_extendedprice")
    pairs = x.select("l_partkey", facts.alias("b"), F.lag(facts).over(w).alias("a")).where("a is not null")
    return pairs.groupBy("l_partkey").agg(F.count("*").alias("pairs"), F.count_if(rawchecks.same_listing(F.col("a"), F.col("b"))).alias("same"))


@query("id_shapes", r"""SELECT doc_id, regexp_matches(w, '^[1-9][0-9]{0,8}$') AS api, regexp_matches(w, '^[0-9A-Z]{1,12}(-[0-9A-Z]{1,12}){0,3}$') AS category, regexp_matches(w, '^[0-9]{1,12}$') AS sales, NOT starts_with(w, '《お取り寄せ商品》') AS counted
FROM (SELECT doc_id, CASE doc_id % 9 WHEN 0 THEN doc_id::VARCHAR WHEN 1 THEN '0' || doc_id WHEN 2 THEN 'AB-' || doc_id WHEN 3 THEN 'AB--' || doc_id WHEN 4 THEN '《お取り寄せ商品》' || doc_id WHEN 5 THEN 'A-B-C-' || doc_id WHEN 6 THEN 'A-B-C-D-' || doc_id WHEN 7 THEN 'ABCDEFGHIJKL' || doc_id ELSE coalesce(text, '') END AS w FROM documents)""")
def id_shapes(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = F.col("doc_id")
    t = d.cast("string")
    w = F.coalesce("text", F.lit(""))
    for k, head in ((7, "ABCDEFGHIJKL"), (6, "A-B-C-D-"), (5, "A-B-C-"), (4, "《お取り寄せ商品》"), (3, "AB--"), (2, "AB-"), (1, "0"), (0, "")):
        w = F.when(d % 9 == k, F.concat(F.lit(head), t)).otherwise(w)
    rows = table(spark, sf_dir, "documents").select("doc_id", w.alias("w"))
    return rows.select("doc_id", F.col("w").rlike(rawchecks.API_ID).alias("api"), F.col("w").rlike(rawchecks.CATEGORY_CODE).alias("category"), F.col("w").rlike(rawchecks.SALES_CODE).alias("sales"), rawchecks.shows_count(F.col("w")).alias("counted"))


@query("price_lines", """WITH b AS (SELECT p_partkey AS n, p_size AS s, CAST(floor(p_retailprice) AS BIGINT) AS y FROM part), l AS (SELECT n, 0 AS pos, 1::BIGINT AS least, '個' AS unit, '単価' AS label, s::BIGINT AS amount FROM b WHERE n % 7 <> 0 AND n % 11 <> 0
UNION ALL SELECT n, 1, 10, '個', '10個以上単価', y FROM b WHERE n % 7 <> 0 AND n % 11 <> 0 UNION ALL SELECT n, 0, NULL, NULL, '価格お見積り', NULL FROM b WHERE n % 7 = 0 AND n % 11 <> 0) SELECT n AS p_partkey, pos, least, unit, label, amount FROM l UNION ALL SELECT n, NULL, NULL, NULL, 'unreadable', NULL FROM b WHERE n % 11 = 0""")
def price_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Price blocks as a shop prints them, read line by line; a block with any other text is unreadable as a whole."""
    from ..sources import html

    n = F.col("p_partkey")
    whole = F.concat(F.lit("<p>【数量1個〜】単価&nbsp;¥"), F.col("p_size").cast("string"), F.lit("<br>\n【数量10個〜】10個以上単価&nbsp;&yen;"), F.format_number(F.floor("p_retailprice"), 0), F.lit("<br /></p>"))
    block = F.when(n % 11 == 0, F.concat(whole, F.lit("new"))).when(n % 7 == 0, "価格お見積り&nbsp;¥0<br>").otherwise(whole)
    rows = spread(table(spark, sf_dir, "part").select("p_partkey", "p_size", "p_retailprice"), "p_partkey").select("p_partkey", html.price_lines(block).alias("lines"))
    lines = F.transform("lines", lambda x, i: F.struct(i.alias("pos"), x["least"].alias("least"), x["unit"].alias("unit"), x["label"].alias("label"), x["amount"].alias("amount")))
    none = F.from_json(F.lit('{"label":"unreadable"}'), "pos int, least bigint, unit string, label string, amount bigint")
    return rows.select("p_partkey", F.explode(F.coalesce(lines, F.array(none))).alias("x")).select("p_partkey", "x.*")


@query("stock_card_items", """WITH b AS (SELECT p_partkey AS n, p_name, p_size, CAST(floor(p_retailprice) AS BIGINT) AS y FROM part) SELECT n % 10 AS page, CASE WHEN n % 13 = 0 THEN (n + 1)::VARCHAR ELSE n::VARCHAR END AS code, p_name || ' & more' AS name, CASE WHEN n % 3 = 0 THEN NULL ELSE 'M-' || n END AS model, CASE WHEN n % 5 = 0 THEN NULL ELSE y END AS price,
CASE WHEN n % 4 = 0 THEN NULL ELSE p_size END::BIGINT AS quantity, CASE WHEN n % 6 = 0 THEN '' ELSE '在庫 / あり' END AS status, concat_ws('; ', CASE WHEN n % 17 = 0 AND n % 13 <> 0 THEN 'unusable code text' END, CASE WHEN n % 13 = 0 THEN 'code disagrees with link' END, CASE WHEN n % 5 = 0 THEN 'no price' END, CASE WHEN n % 6 = 0 THEN 'no stock status' END) AS issues FROM b""")
def stock_card_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Listing pages of cards, ten of all parts; what a card lacks is an issue of its row."""
    from ..sources import stockpages

    n = F.col("p_partkey")
    t = n.cast("string")
    card = F.concat(
        F.lit('<div class="block-cart-i--item"><div class="block-cart-i--goods-name"> <a href="/catalog/g/g'), t, F.lit('/" data-category="x">'), "p_name", F.lit(' &amp; more</a></div><div class="block-cart-i--code"><strong>c</strong> '), F.when(n % 13 == 0, (n + 1).cast("string")).when(n % 17 == 0, "??").otherwise(t),
        F.lit("</div>"), F.when(n % 3 != 0, F.concat(F.lit('<div class="block-cart-i--model_number"><strong>m</strong> M-'), t, F.lit("</div>"))).otherwise(""), F.when(n % 5 != 0, F.concat(F.lit('<div class="block-cart-i--price price">¥'), F.format_number(F.floor("p_retailprice"), 0), F.lit("(税込)</div>"))).otherwise(""),
        F.when(n % 4 != 0, F.concat(F.lit('<dl class="block-cart-i--available_purchase"><dt>n</dt><dd>'), F.col("p_size").cast("string"), F.lit(" sets</dd></dl>"))).otherwise(""), F.when(n % 6 != 0, '<div class="block-cart-i--stock-info-a">在庫</div><div class="block-cart-i--stock-info-b"> <b>あり</b></div>').otherwise(""), F.lit("</div>"),
    )
    pages = table(spark, sf_dir, "part").groupBy((n % 10).alias("page")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(n.alias("n"), card.alias("c")))), lambda x: x["c"]), "").alias("html"))
    items = stockpages.listing_items(pages.withColumn("html", F.concat(F.lit("<h1>list</h1>"), "html")), "page", "html")
    return items.select("page", "code", "name", "model", "price", "quantity", "status", F.array_join("issues", "; ").alias("issues"))


@query("normalized_products", """WITH b AS (SELECT p_partkey AS n, p_name, p_size, CASE WHEN p_partkey % 9 = 0 THEN 0 WHEN p_partkey % 9 = 1 THEN 99999999 ELSE CAST(floor(p_retailprice) AS BIGINT) END AS y, p_size % 5 * 3 AS stock FROM part)
SELECT 'api' AS shape, n::VARCHAR AS product, p_name AS name, CASE WHEN n % 4 = 0 THEN NULL ELSE 'M-' || n END AS model, CASE WHEN n % 9 < 2 THEN 'unavailable' ELSE 'exact' END AS price, CASE WHEN n % 9 >= 2 THEN y END AS low, CASE WHEN n % 6 = 0 THEN 'discontinued' WHEN stock > 0 THEN 'in_stock' WHEN n % 6 = 1 THEN 'preparing' ELSE 'out_of_stock' END AS state, stock::BIGINT AS quantity FROM b
UNION ALL SELECT 'listing', n::VARCHAR, p_name, CASE WHEN n % 4 = 0 THEN NULL ELSE 'M-' || n END, CASE WHEN n % 8 = 0 THEN 'unavailable' ELSE 'exact' END, CASE WHEN n % 8 <> 0 THEN y END,
CASE n % 6 WHEN 0 THEN 'discontinued' WHEN 1 THEN CASE WHEN n % 2 = 1 THEN 'restocking' END WHEN 2 THEN 'out_of_stock' WHEN 3 THEN 'in_stock' WHEN 4 THEN 'unknown' ELSE 'in_stock' END, CASE WHEN n % 7 <> 0 THEN stock END FROM b""")
def normalized_products(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items of two shapes as products: sentinel prices, stock words beside the cart, counts of the shop's own."""
    from ..operators import normalize

    n = F.col("p_partkey")
    t = n.cast("string")
    price = F.when(n % 9 == 0, 0).when(n % 9 == 1, 99_999_999).otherwise(F.floor("p_retailprice")).cast("long")
    stock = (F.col("p_size") % 5 * 3).cast("long")
    model = F.when(n % 4 != 0, F.concat(F.lit("M-"), t)).otherwise("")
    word = F.when(n % 6 == 0, "終了品").when(n % 6 == 1, "販売予定品").otherwise("通常品")
    api = F.struct(n.alias("id"), F.concat(F.lit(" "), "p_name").alias("name"), model.alias("model"), price.alias("price"), stock.alias("stock"), F.struct(word.alias("name")).alias("status"))
    said = F.when(n % 6 == 0, "販売終了").when(n % 6 == 1, "入荷予定").when(n % 6 == 2, "納期未定").when(n % 6 == 4, "").otherwise("在庫あり")
    one = F.struct(F.when(n % 8 != 0, price).alias("amountYen"), F.lit("1個").alias("quantityUnit"), F.lit(True).alias("taxIncluded"))
    listing = F.struct(t.alias("salesCode"), model.alias("modelNumber"), F.col("p_name").alias("name"), F.lit("").alias("category"), F.lit("/").alias("url"), F.array(one).alias("prices"), F.struct(said.alias("status"), F.when(n % 7 != 0, stock).alias("availableQuantity"), (n % 2 == 1).alias("purchasable")).alias("stock"))
    p = table(spark, sf_dir, "part").select(api.alias("api"), listing.alias("listing"))
    out = None
    for shape, made in (("api", normalize.of_api(F.col("api"))), ("listing", normalize.of_listing(F.col("listing")))):
        x = p.select(made.alias("p")).select("p", F.col("p.offers")[0].alias("o"))
        quote = F.col("o.priceQuotes")[0]
        rows = x.select(F.lit(shape).alias("shape"), F.col("p.externalProductId").alias("product"), F.col("p.metadata.name").alias("name"), F.col("p.metadata.modelNumber").alias("model"), quote["state"].alias("price"), quote["minAmountMinor"].alias("low"), F.col("o.availability.state").alias("state"), F.col("o.availability.quantity").alias("quantity"))
        out = rows if out is None else out.unionByName(rows)
    return out


@query("dictionary_codes", """WITH s AS (SELECT s, row_number() OVER (ORDER BY count(*) DESC, s) - 1 AS i FROM (SELECT p_brand AS s FROM part UNION ALL SELECT p_type FROM part UNION ALL SELECT p_name FROM part) GROUP BY s)
SELECT p_partkey, b.i AS p_brand_i, t.i AS p_type_i, n.i AS p_name_i, p_brand, p_type, p_name FROM part JOIN s b ON b.s = p_brand JOIN s t ON t.s = p_type JOIN s n ON n.s = p_name""")
def dictionary_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Strings as indexes by falling frequency, and the strings that the indexes give back."""
    from ..operators import publication

    columns = ["p_brand", "p_type", "p_name"]
    rows, strings = publication.encode(table(spark, sf_dir, "part").select("p_partkey", *columns), columns)
    codes = rows.select("p_partkey", *[f"{c}_i" for c in columns])
    return codes.join(publication.decode(rows, strings, columns), "p_partkey")
