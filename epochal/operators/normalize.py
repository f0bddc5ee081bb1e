"""From what a shop gives to products, offers, quotes and availability: expressions by item shape, no row at a time."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.money import decimal_minor
from ..sources.snapshots import AVAILABILITY, OFFER, QUOTE
from .snapshotchecks import listing_id

# Stock words of the shops and the price that stands for none.
NO_PRICE = (0, 99_999_999)
NOT_YET = ("入荷未定", "納期未定", "納期確認中")


def listing_state(status: Column, purchasable: Column) -> Column:
    """A stock text and the cart beside it as a state, in order of rules."""
    return (
        F.when(status.contains("販売終了"), "discontinued").when(purchasable & status.contains("入荷予定"), "restocking").when(purchasable, "in_stock").when(status.contains("入荷予定"), "restocking")
        .when(status.contains(NOT_YET[0]) | status.contains(NOT_YET[1]) | status.contains(NOT_YET[2]), "out_of_stock").when(F.coalesce(status, F.lit("")) == "", "unknown").otherwise("out_of_stock")
    )


def flag_state(available: Column) -> Column:
    return F.when(available, "in_stock").otherwise("out_of_stock")


def api_state(status: Column, stock: Column) -> Column:
    return F.when(status == "終了品", "discontinued").when(stock > 0, "in_stock").when(status == "販売予定品", "preparing").otherwise("out_of_stock")


def two_signal_state(marked_class: Column, mark: Column) -> Column:
    """Both signs say out: out; neither: in; else unknown."""
    shown = mark.isNotNull()
    return F.when(marked_class & shown, "out_of_stock").when(~marked_class & ~shown, "in_stock").otherwise("unknown")


def availability(state: Column, purchasable: Column, quantity: Column, semantics: Column, unobserved: Column, raw: Column) -> Column:
    return F.struct(state.alias("state"), purchasable.alias("purchasable"), quantity.alias("quantity"), semantics.alias("quantitySemantics"), unobserved.alias("quantityUnobserved"), raw.alias("rawStatus")).cast(AVAILABILITY)


def exact_quote(kind: str, tax: str, currency: Column, amount: Column, unit: Column) -> Column:
    """A quote of one amount; without one it is unavailable."""
    state = F.when(amount.isNull(), "unavailable").otherwise("exact")
    return F.struct(F.lit(kind).alias("quoteKind"), F.lit(tax).alias("taxTreatment"), currency.alias("currency"), state.alias("state"), amount.alias("minAmountMinor"), amount.alias("maxAmountMinor"), unit.alias("unitLabel")).cast(QUOTE)


def page_count(counts: Column, offer: Column, purchasable: Column) -> tuple[Column, Column]:
    """(quantity, unobserved) of an offer from a product page section: read, unread and unbuyable (unknown), or not looked at."""
    read = F.map_contains_key(counts, offer)
    return F.when(read, F.try_element_at(counts, offer)), F.coalesce(~read & purchasable, F.lit(False))


def offer(id_: Column, kind: str, sku: Column, name: Column, quotes: Column, stock: Column) -> Column:
    return F.struct(id_.alias("externalOfferId"), F.lit(kind).alias("offerKind"), sku.alias("sku"), name.alias("variantName"), quotes.alias("priceQuotes"), stock.alias("availability")).cast(OFFER)


def product(id_: Column, page: Column, aliases: Column, name: Column, model: Column, category: Column, url: Column, offers: Column) -> Column:
    meta = F.struct(F.trim(name).alias("name"), F.nullif(F.trim(model), F.lit("")).alias("modelNumber"), F.nullif(F.trim(category), F.lit("")).alias("category"), url.alias("canonicalUrl"))
    return F.struct(id_.alias("externalProductId"), page.alias("pageKey"), aliases.alias("aliases"), meta.alias("metadata"), offers.alias("offers"))


def _alias(kind: str, value: Column) -> Column:
    return F.filter(F.array(F.struct(F.lit(kind).alias("kind"), value.alias("value"))), lambda a: a["value"].isNotNull() & (a["value"] != ""))


def of_listing(item: Column) -> Column:
    """One offer a product; the first price counts; a count is the shop's own."""
    price, stock = F.try_element_at(item["prices"], F.lit(1)), item["stock"]
    quantity = F.when(stock["availableQuantity"] >= 0, stock["availableQuantity"])
    tax = F.when(price["taxIncluded"], "tax_included").otherwise("unknown")
    quote = exact_quote("selling", "unknown", F.lit("JPY"), price["amountYen"], price["quantityUnit"]).withField("taxTreatment", tax)
    a = availability(listing_state(stock["status"], stock["purchasable"]), stock["purchasable"], quantity, F.when(quantity.isNotNull(), "site_reported").otherwise("unknown"), F.lit(False), stock["status"])
    return product(item["salesCode"], item["salesCode"], _alias("modelNumber", item["modelNumber"]), item["name"], item["modelNumber"], item["category"], item["url"], F.array(offer(item["salesCode"], "default", item["modelNumber"], F.lit(None), F.array(quote), a)))


def of_catalogue(item: Column, counts: Column) -> Column:
    """An offer a variant, in order of position and id; a compare-at price is a quote of its own."""

    def one(v: Column) -> Column:
        id_ = v["variantId"].cast("string")
        quotes = F.array_compact(F.array(exact_quote("selling", "tax_included", F.lit("JPY"), v["priceYen"], F.lit(None).cast("string")), F.when(v["compareAtPriceYen"].isNotNull(), exact_quote("compare_at", "tax_included", F.lit("JPY"), v["compareAtPriceYen"], F.lit(None).cast("string")))))
        quantity, unread = page_count(counts, id_, v["available"])
        return offer(id_, "variant", v["sku"], F.lit(None).cast("string"), quotes, availability(flag_state(v["available"]), F.coalesce(v["available"], F.lit(False)), quantity, F.when(counts.isNull(), "not_exposed").otherwise("site_reported"), unread, F.lit(None).cast("string")))

    order = F.array_sort(F.transform(item["variants"], lambda v: F.struct(v["position"].alias("p"), v["variantId"].alias("i"), v.alias("v"))))
    variants = F.transform(order, lambda x: x["v"])
    skus = F.array_distinct(F.filter(F.transform(variants, lambda v: v["sku"]), lambda s: s.isNotNull() & (s != "")))
    aliases = F.transform(skus, lambda s: F.struct(F.lit("sku").alias("kind"), s.alias("value")))
    return product(item["productId"].cast("string"), item["handle"], aliases, item["title"], F.try_element_at(skus, F.lit(1)), F.lit(None).cast("string"), F.concat(F.lit("/products/"), item["handle"]), F.transform(variants, one))


def of_storefront(item: Column, currency: Column) -> Column:
    """Decimal prices in the shop's own currency, tax unknown; a model only where there is one variant."""
    none = F.lit(None).cast("string")

    def one(v: Column) -> Column:
        quotes = F.array_compact(F.array(exact_quote("selling", "unknown", currency, decimal_minor(v["price"]), none), F.when(v["compare_at_price"].isNotNull(), exact_quote("compare_at", "unknown", currency, decimal_minor(v["compare_at_price"]), none))))
        name = F.when(v["title"] != "Default Title", v["title"])
        return offer(v["id"].cast("string"), "variant", v["sku"], name, quotes, availability(flag_state(v["available"]), v["available"], F.lit(None).cast("bigint"), F.lit("not_exposed"), F.lit(False), none))

    model = F.when(F.size(item["variants"]) == 1, item["variants"][0]["sku"])
    return product(item["id"].cast("string"), F.concat(F.lit("h-"), item["handle"]), _alias("sku", model), item["title"], model, item["product_type"], F.concat(F.lit("/products/"), item["handle"]), F.transform(item["variants"], one))


def of_api(item: Column) -> Column:
    id_ = item["id"].cast("string")
    price = F.when(~item["price"].isin(*NO_PRICE), item["price"])
    quantity = F.when(item["stock"] >= 0, item["stock"])
    a = availability(api_state(item["status"]["name"], item["stock"]), item["stock"] > 0, quantity, F.lit("site_reported"), F.lit(False), item["status"]["name"])
    return product(id_, id_, _alias("modelNumber", item["model"]), item["name"], item["model"], F.lit(None).cast("string"), F.concat(F.lit("/items/"), id_), F.array(offer(id_, "default", item["model"], F.lit(None), F.array(exact_quote("selling", "tax_included", F.lit("JPY"), price, F.lit(None).cast("string"))), a)))


def line_unit(line: Column) -> Column:
    """A price line's unit: of a price for each piece, `1<unit>`, with the least quantity where that is more than one."""
    base = F.when(line["label"] == "単価", F.concat(F.lit("1"), F.coalesce(line["quantityUnit"], F.lit("個")))).otherwise(F.regexp_replace(line["label"], "単価$", ""))
    return F.when(line["minQuantity"] > 1, F.concat(base, F.lit("（"), line["minQuantity"].cast("string"), F.coalesce(line["quantityUnit"], F.lit("個")), F.lit("から）"))).otherwise(base)


def of_category(item: Column) -> Column:
    """Lines of the first line's basis are one quote: a range where their amounts differ."""
    lines = item["priceLines"]
    unit = line_unit(F.try_element_at(lines, F.lit(1)))
    amounts = F.filter(F.transform(F.filter(lines, lambda x: line_unit(x) == unit), lambda x: x["amountYen"]), lambda a: a.isNotNull())
    low, high = F.array_min(amounts), F.array_max(amounts)
    state = F.when(low.isNull(), "unavailable").when(low == high, "exact").otherwise("range")
    quote = F.struct(F.lit("selling").alias("quoteKind"), F.lit("tax_included").alias("taxTreatment"), F.lit("JPY").alias("currency"), state.alias("state"), low.alias("minAmountMinor"), high.alias("maxAmountMinor"), unit.alias("unitLabel")).cast(QUOTE)
    stock = two_signal_state(item["outOfStockClass"], item["stockMark"])
    a = availability(stock, F.when(stock != "unknown", stock == "in_stock"), F.lit(None).cast("bigint"), F.lit("not_exposed"), F.lit(False), item["stockMark"])
    return product(item["code"], item["code"], _alias("managementCode", item["code"]), item["name"], item["model"], F.lit(None).cast("string"), F.concat(F.lit("/detail?code="), item["code"]), F.array(offer(item["code"], "default", F.lit(None).cast("string"), F.lit(None), F.array(quote), a)))


#: Which expression reads which shape.
SHAPE_OF = {"listing": lambda i, s: of_listing(i), "catalogue": lambda i, s: of_catalogue(i, s["pageInventory.quantities"]), "storefront": lambda i, s: of_storefront(i, F.when(s["storeId"] == "gbp", "GBP").otherwise("USD")), "api": lambda i, s: of_api(i), "category": lambda i, s: of_category(i)}


# What a shop's snapshot covers, where that is always the same, and how what it covers begins.
COVERS = {"storefront": "shopify:products", "api": "list:public", "category": "category:3000"}
BY_SITEMAP, BY_COLLECTION, BY_GENRE = "sitemap:", "shopify:collections/", 2


def coverage_id(shape: str) -> Column:
    """What a snapshot claims to have observed, from its `schemaVersion`, `crawl`, `listings`, `genres` and `collection`: two that differ in it are not compared. Of the
    listing shop the families of listings, in the order of their names; in version 2 the listings' own names."""
    if shape in COVERS:
        return F.lit(COVERS[shape])
    if shape == "catalogue":
        return F.concat(F.lit(BY_COLLECTION), "collection")
    urls = F.transform(F.coalesce("listings", "genres", F.array().cast("array<struct<url:string>>")), lambda x: listing_id(x["url"]))
    ids = F.filter(urls, lambda i: i.isNotNull())
    joined = lambda names: F.array_join(F.array_sort(F.array_distinct(names)), "+")
    families = F.coalesce(F.when(F.col("schemaVersion") == 3, F.col("crawl.families")), F.transform(ids, lambda i: F.substring(i, 1, 1)))
    return F.when(F.col("schemaVersion") == BY_GENRE, joined(F.transform(ids, lambda i: F.substring(i, 3, 1000)))).otherwise(F.concat(F.lit(BY_SITEMAP), joined(families)))


#: What a shape's products are sorted by: their ids, or page keys as numbers, as texts or in a dictionary's order.
ORDER = {"listing": lambda p: p["externalProductId"], "catalogue": lambda p: p["externalProductId"], "storefront": lambda p: F.collate(p["pageKey"], "en"), "api": lambda p: p["pageKey"].try_cast("bigint"), "category": lambda p: p["pageKey"]}


def normalize(raw: DataFrame, shape: str) -> DataFrame:
    """Raw snapshots of a shape in the normalized one, products in the shape's order; the hash is of the products as JSON."""
    one = SHAPE_OF[shape]
    columns = {c: F.col(c) for c in ("storeId", "pageInventory.quantities")}
    keyed = F.array_sort(F.transform(F.transform("items", lambda i: one(i, columns)), lambda p: F.struct(ORDER[shape](p).alias("k"), p.alias("p"))))
    out = raw.select("storeId", "observedAt", F.col("schemaVersion").cast("string").alias("sourceSchemaVersion"), "complete", coverage_id(shape).alias("coverageId"), F.transform(keyed, lambda x: x["p"]).alias("products"))
    return out.withColumn("normalizedHash", F.sha2(F.to_json("products", {"ignoreNullFields": "false"}), 256))
