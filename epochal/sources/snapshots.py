"""Snapshots of a shop's catalogue: one schema for all shops once normalized, five for what shops give; readers never infer a schema."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

QUOTE = "struct<quoteKind:string,taxTreatment:string,currency:string,state:string,minAmountMinor:bigint,maxAmountMinor:bigint,unitLabel:string>"
AVAILABILITY = "struct<state:string,purchasable:boolean,quantity:bigint,quantitySemantics:string,quantityUnobserved:boolean,rawStatus:string>"
OFFER = f"struct<externalOfferId:string,offerKind:string,sku:string,variantName:string,priceQuotes:array<{QUOTE}>,availability:{AVAILABILITY}>"
PRODUCT = f"struct<externalProductId:string,pageKey:string,aliases:array<struct<kind:string,value:string>>,metadata:struct<name:string,modelNumber:string,category:string,canonicalUrl:string>,offers:array<{OFFER}>>"
NORMALIZED = f"storeId string, observedAt string, sourceSchemaVersion string, complete boolean, coverageId string, rawSha256 string, normalizedHash string, products array<{PRODUCT}>"

#: Items as shops give them.
LISTING_ITEM = "array<struct<salesCode:string,modelNumber:string,name:string,category:string,url:string,prices:array<struct<amountYen:bigint,display:string,quantityUnit:string,taxIncluded:boolean>>,stock:struct<status:string,availableQuantity:bigint,purchasable:boolean>>>"
CATALOGUE_ITEM = "array<struct<handle:string,productId:bigint,title:string,vendor:string,tags:array<string>,variants:array<struct<variantId:bigint,sku:string,priceYen:bigint,priceRaw:string,compareAtPriceYen:bigint,available:boolean,position:int>>>>"
STOREFRONT_ITEM = "array<struct<id:bigint,handle:string,title:string,vendor:string,product_type:string,variants:array<struct<id:bigint,sku:string,title:string,price:string,compare_at_price:string,available:boolean>>>>"
API_ITEM = "array<struct<id:bigint,name:string,make:string,model:string,price:bigint,tax:bigint,taxrate:double,stock:bigint,status:struct<id:bigint,name:string>>>"
CATEGORY_ITEM = "array<struct<code:string,name:string,maker:string,model:string,priceLines:array<struct<minQuantity:bigint,quantityUnit:string,label:string,amountYen:bigint>>,outOfStockClass:boolean,stockMark:string,listings:array<bigint>>>"
SHAPES = {"listing": LISTING_ITEM, "catalogue": CATALOGUE_ITEM, "storefront": STOREFRONT_ITEM, "api": API_ITEM, "category": CATEGORY_ITEM}
#: What a snapshot was read from: families of listings or the listings, or a collection.
SCOPE = "crawl struct<families:array<string>>, listings array<struct<url:string>>, genres array<struct<url:string>>, collection string"
PAGE_COUNTS = "struct<round:bigint,shards:int,shard:int,eligible:int,selected:int,read:int,quantities:map<string,bigint>>"


def read_raw(spark: SparkSession, path: str, shape: str) -> DataFrame:
    """Raw snapshots, plain or gzipped: (storeId, schemaVersion, observedAt, items, pageInventory) and what they were read from; a file that isn't such JSON fails the
    read."""
    schema = f"storeId string, schemaVersion int, observedAt string, complete boolean, items {SHAPES[shape]}, pageInventory {PAGE_COUNTS}, {SCOPE}"
    return spark.read.schema(schema).option("multiLine", True).option("mode", "FAILFAST").json(path)


def read_normalized(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(NORMALIZED).option("multiLine", True).option("mode", "FAILFAST").json(path)


def file_hashes(spark: SparkSession, path: str) -> DataFrame:
    """(path, sha256) of files as they lie there."""
    return spark.read.format("binaryFile").load(path).select("path", F.sha2("content", 256).alias("sha256"))


def basis_key(q: Column) -> Column:
    """What prices may be compared within: kind, tax, currency and unit, joined by NUL; an unknown unit differs from an empty one."""
    return F.concat_ws("\0", q["quoteKind"], q["taxTreatment"], q["currency"], F.coalesce(q["unitLabel"], F.lit("\1")))


def observations(snapshots: DataFrame) -> DataFrame:
    """(store, t, product, offer, basis, state, low, high): a row for each quote of each offer of each snapshot."""
    p = snapshots.select(F.col("storeId").alias("store"), F.col("observedAt"), F.explode("products").alias("p"))
    o = p.select("store", "observedAt", F.col("p.externalProductId").alias("product"), F.explode("p.offers").alias("o"))
    q = o.select("store", "observedAt", "product", F.col("o.externalOfferId").alias("offer"), F.explode("o.priceQuotes").alias("q"))
    from ..functions.times import parse_iso

    return q.select("store", parse_iso(F.col("observedAt")).alias("t"), "product", "offer", basis_key(F.col("q")).alias("basis"), F.col("q.state").alias("state"), F.col("q.minAmountMinor").alias("low"), F.col("q.maxAmountMinor").alias("high"))


def stock_observations(snapshots: DataFrame) -> DataFrame:
    """(store, t, product, offer, availability, quantity, unobserved): a count that was not read is no observation of the quantity."""
    from ..functions.times import parse_iso

    p = snapshots.select(F.col("storeId").alias("store"), F.col("observedAt"), F.explode("products").alias("p"))
    o = p.select("store", "observedAt", F.col("p.externalProductId").alias("product"), F.explode("p.offers").alias("o"))
    a = F.col("o.availability")
    return o.select("store", parse_iso(F.col("observedAt")).alias("t"), "product", F.col("o.externalOfferId").alias("offer"), a["state"].alias("availability"), a["quantity"].alias("quantity"), F.coalesce(a["quantityUnobserved"], F.lit(False)).alias("unobserved"))


def is_valid_price(q: Column) -> Column:
    """Unavailable prices have no amounts, exact ones one, ranges a lower and a higher."""
    low, high = q["minAmountMinor"], q["maxAmountMinor"]
    return F.coalesce(F.when(q["state"] == "unavailable", low.isNull() & high.isNull()).when(q["state"] == "exact", (low == high) & (low >= 0)).when(q["state"] == "range", (low >= 0) & (low < high)), F.lit(False))
