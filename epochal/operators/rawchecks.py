"""What a shop's raw snapshot must satisfy before it is taken: rules over its items, its listings and its coverage. Every rule is a named condition; all are read at once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.keys import is_handle, is_safe_key
from ..functions.money import half_up
from ..functions.times import DAY_MS
from .compare import eligibility

# Shapes of ids, the least and most of a shop's tax rate, a listing's page and search limits, capabilities, the mark of titles without a shown count.
SALES_CODE, API_ID, CATEGORY_CODE, SLUG = r"^[0-9]{1,12}\z", r"^[1-9][0-9]{0,8}\z", r"^[0-9A-Z]{1,12}(-[0-9A-Z]{1,12}){0,3}\z", r"^[a-z0-9][a-z0-9._-]{0,63}\z"
TAX_RATE = (1.0, 1.25)
PAGE_SIZE, SEARCH_CAP = 40, 2000
CAPABILITIES = "supportsExactPrice supportsPriceRange supportsVariants supportsCompareAtPrice supportsTaxIncluded supportsTaxExcluded supportsAvailability supportsInventoryQuantity".split()
ORDERED_ON_REQUEST = "《お取り寄せ商品》"
WARN_RATIO = 0.8
FULL_RUN_SLACK_MS = 6 * 3_600_000


def found(rows: DataFrame, subject: str, rules: dict[str, Column]) -> DataFrame:
    """(code, subject): a row for each rule that holds of a row; a rule that can't be judged doesn't hold."""
    hits = F.array_compact(F.array(*[F.when(F.coalesce(c, F.lit(False)), F.lit(k)) for k, c in rules.items()]))
    return rows.select(hits.alias("__hits"), F.col(subject).cast("string").alias("subject")).select(F.explode("__hits").alias("code"), "subject")


def repeated(*columns: str) -> Column:
    return F.count("*").over(Window.partitionBy(*columns)) > 1


def blank(c: str) -> Column:
    return F.trim(F.coalesce(F.col(c), F.lit(""))) == ""


def listing_rules(url: Column) -> dict[str, Column]:
    """Items of the listing shop (salesCode, name, url, prices, stock): errors, and warnings under `warn.`."""
    code, p, s = F.col("salesCode"), F.get("prices", F.lit(0)), F.col("stock")
    amount, n = p["amountYen"], s["availableQuantity"]
    ok = F.coalesce(code.rlike(SALES_CODE), F.lit(False))
    priced = F.coalesce(F.size("prices"), F.lit(0)) > 0
    rules = {
        "item.sales_code": ~ok, "item.duplicate": ok & repeated("salesCode"), "item.name": ok & blank("name"), "item.url": ok & ~F.col("url").eqNullSafe(url), "item.prices": ok & ~priced,
        "warn.multiple_prices": ok & (F.size("prices") > 1), "item.price_amount": ok & (amount < 0), "warn.price_zero": ok & (amount == 0), "item.price_unit": ok & priced & (F.coalesce(p["quantityUnit"], F.lit("")) == ""),
        "item.price_tax": ok & amount.isNotNull() & ~F.coalesce(p["taxIncluded"], F.lit(False)), "item.stock": ok & s.isNull(), "item.status": ok & s.isNotNull() & s["status"].isNull(), "item.quantity": ok & (n < 0),
        "warn.quantity_not_purchasable": ok & (n > 0) & ~s["purchasable"],
    }
    return rules


def catalogue_rules() -> dict[str, Column]:
    """Items of the catalogue shop (handle, productId, title, variants): handles are narrow and safe, ids and variants unique, prices whole."""
    ids = F.transform("variants", lambda v: v["variantId"])
    v = F.col("variants")
    return {
        "item.handle": ~F.coalesce(F.col("handle").rlike(SLUG) & is_safe_key(F.col("handle")), F.lit(False)), "item.duplicate": repeated("handle"), "item.product_id": F.coalesce(F.col("productId"), F.lit(0)) <= 0, "item.product_duplicate": repeated("productId"), "item.title": blank("title"),
        "item.variants": F.coalesce(F.size(v), F.lit(0)) < 1, "item.variant_duplicate": F.size(F.array_distinct(ids)) < F.size(ids), "item.price": F.exists(v, lambda x: x["priceYen"].isNull() | (x["priceYen"] < 0)), "warn.price_zero": F.exists(v, lambda x: x["priceYen"] == 0),
        "warn.compare_at": F.exists(v, lambda x: x["compareAtPriceYen"] <= x["priceYen"]), "item.available": F.exists(v, lambda x: x["available"].isNull()),
    }


def storefront_rules() -> dict[str, Column]:
    """Items of a storefront (id, handle, variants): decimal prices, unique ids, handles and variants."""
    price = lambda p: p.rlike(r"^\d{1,12}(\.\d{1,2})?$")
    ids = F.transform("variants", lambda v: v["id"])
    return {
        "item.handle": ~is_handle(F.col("handle")), "item.duplicate": repeated("handle"), "item.id_duplicate": repeated("id"), "item.variants": F.coalesce(F.size("variants"), F.lit(0)) < 1,
        "item.variant_duplicate": F.size(F.array_distinct(ids)) < F.size(ids), "item.price": F.exists("variants", lambda v: ~F.coalesce(price(v["price"]), F.lit(False)) | ~F.coalesce(price(v["compare_at_price"]), F.lit(True))),
    }


def api_rules() -> dict[str, Column]:
    """Items of the list API (id, name, make, model, price, tax, taxrate, stock, onlist, status): the tax must be contained in the price, to the yen next to it."""
    price, rate = F.col("price"), F.col("taxrate")
    return {
        "item.id": ~F.coalesce(F.col("id").cast("string").rlike(API_ID), F.lit(False)), "item.duplicate": repeated("id"), "item.name": blank("name"), "item.price": F.coalesce(price < 0, F.lit(True)), "item.taxrate": ~F.coalesce((rate > TAX_RATE[0]) & (rate < TAX_RATE[1]), F.lit(False)),
        "item.tax": (price > 0) & (F.abs(F.col("tax") - half_up(price - price / rate)) > 1), "item.stock": F.coalesce(F.col("stock") < 0, F.lit(True)), "item.onlist": F.coalesce(F.col("onlist") != 1, F.lit(True)),
        "item.make": F.col("make").isNull(), "item.model": F.col("model").isNull(), "item.status": F.coalesce(F.col("status.id") < 0, F.lit(True)) | (F.trim(F.coalesce("status.name", F.lit(""))) == ""),
    }


def category_rules() -> dict[str, Column]:
    """Items of the category shop (code, name, listings, priceLines): a quantity goes with a unit, only a request for a quote has no amount, listings rise."""
    rises = F.forall(F.sequence(F.lit(1), F.greatest(F.size("listings") - 1, F.lit(1))), lambda i: (i >= F.size("listings")) | (F.get("listings", i) > F.get("listings", i - 1)))
    lines = F.col("priceLines")
    return {
        "item.code": ~F.coalesce(F.col("code").rlike(CATEGORY_CODE), F.lit(False)), "item.duplicate": repeated("code"), "item.name": blank("name"), "item.listings": (F.coalesce(F.size("listings"), F.lit(0)) < 1) | ~rises,
        "item.line_unit": F.exists(lines, lambda x: x["minQuantity"].isNull() != x["quantityUnit"].isNull()), "item.line_amount": F.exists(lines, lambda x: x["amountYen"].isNull() != (x["label"] == "価格お見積り")),
    }


def listing_totals(items: DataFrame, listings: DataFrame, split: DataFrame) -> DataFrame:
    """(code, subject): each listing read (cid, total, pages) is below the search cap, has the pages that its total asks for and holds as many distinct products as
    it says; products name only listings that were read; listings that were split are none of these."""
    rules = {"listing.duplicate": repeated("cid"), "listing.total": ~F.coalesce((F.col("total") >= 1) & (F.col("total") < SEARCH_CAP), F.lit(False)), "listing.pages": F.col("pages") != F.ceil(F.col("total") / PAGE_SIZE)}
    own = found(listings, "cid", rules)
    at = items.select("code", F.explode("listings").alias("cid")).distinct()
    counts = at.groupBy("cid").agg(F.count("*").alias("__n"))
    both = listings.select("cid", "total").join(counts, "cid", "full_outer")
    wrong = both.select(F.when(F.col("total").isNull(), "listing.unread").when(F.coalesce("__n", F.lit(0)) != F.col("total"), "listing.products").alias("code"), F.col("cid").cast("string").alias("subject")).where("code is not null")
    mixed = split.join(listings, "cid", "left_semi").select(F.lit("listing.split").alias("code"), F.col("cid").cast("string").alias("subject"))
    return own.unionByName(wrong).unionByName(mixed)


def uncovered(items: DataFrame, handles: DataFrame) -> DataFrame:
    """(code, subject): pages that the sitemap names and no item has, and repeated ones."""
    gone = handles.select("handle").distinct().join(items.select("handle").distinct(), "handle", "left_anti").select(F.lit("sitemap.uncovered").alias("code"), F.col("handle").alias("subject"))
    twice = handles.groupBy("handle").count().where("count > 1").select(F.lit("sitemap.duplicate").alias("code"), F.col("handle").alias("subject"))
    return gone.unionByName(twice)


def page_section_rules() -> dict[str, Column]:
    """A product page section (round, shards, shard, eligible, selected, read, quantities, stopped): its counts fit each other."""
    least = lambda c, n: F.coalesce(F.col(c) < n, F.lit(True))
    return {
        "pages.shards": least("shards", 1), "pages.shard": least("shard", 0) | (F.col("shard") >= F.col("shards")), "pages.counts": least("read", 0) | (F.col("read") > F.col("selected")) | (F.col("selected") > F.col("eligible")) | F.col("eligible").isNull(),
        "pages.quantity": F.exists(F.map_values("quantities"), lambda n: n < 0), "pages.round": F.col("round").isNull(),
    }


def stray_counts(pages: DataFrame, items: DataFrame) -> DataFrame:
    """(code, subject): counts for variants that no item has."""
    ids = items.select(F.explode(F.transform("variants", lambda v: v["id"].cast("string"))).alias("subject")).distinct()
    return pages.select(F.explode(F.map_keys("quantities")).alias("subject")).distinct().join(ids, "subject", "left_anti").select(F.lit("pages.stray").alias("code"), "subject")


def page_warnings(pages: DataFrame, shown: int = 3) -> DataFrame:
    """pages with `warnings`: how many failed and the first reasons, and why reading stopped."""
    n = F.size("failures")
    first = F.array_join(F.transform(F.slice("failures", 1, shown), lambda f: F.concat_ws(": ", f["key"], f["reason"])), "; ")
    more = F.when(n > shown, F.concat(F.lit("; and "), (n - shown).cast("string"), F.lit(" more"))).otherwise("")
    return pages.withColumn("warnings", F.array_compact(F.array(F.when(n > 0, F.concat(n.cast("string"), F.lit(" pages failed: "), first, more)), F.when(F.col("stopped").isNotNull(), F.concat(F.lit("stopped: "), "stopped")))))


def capabilities(text: Column) -> Column:
    """A shop's capabilities from JSON, or null where a switch is missing, the cap isn't positive or the primary quote isn't named."""
    schema = "struct<" + ",".join(f"{c}:boolean" for c in CAPABILITIES) + ",inventoryQuantitySemantics:string,inventoryQuantityCap:bigint,primaryQuote:struct<quoteKind:string,taxTreatment:string>>"
    c = F.from_json(text, schema)
    whole = F.get_json_object(text, "$.inventoryQuantityCap")
    ok = F.forall(F.array(*[c[k] for k in CAPABILITIES]), lambda x: x.isNotNull()) & c["inventoryQuantitySemantics"].isNotNull() & (whole.isNull() | F.coalesce(c["inventoryQuantityCap"] > 0, F.lit(False)))
    ok = ok & c["primaryQuote"]["quoteKind"].isNotNull() & c["primaryQuote"]["taxTreatment"].isNotNull()
    return F.when(ok, c)


def shows_count(title: Column) -> Column:
    return ~F.coalesce(title.startswith(ORDERED_ON_REQUEST), F.lit(False))


def same_listing(a: Column, b: Column) -> Column:
    """Whether two occurrences of a product state the same prices and stock; being purchasable is compared only where both say so."""
    known = a["purchasable"].isNull() | b["purchasable"].isNull() | (a["purchasable"] == b["purchasable"])
    return a["prices"].eqNullSafe(b["prices"]) & a["status"].eqNullSafe(b["status"]) & known


def crawl_quality(items: DataFrame) -> DataFrame:
    """One row of what a crawl's occurrences lack: names, models, more variants than one, unavailable, and how many were repeated."""
    one = items.groupBy("key").agg(F.count("*").alias("n"), F.max(F.col("name") == "").alias("name"), F.max(F.col("model").isNull()).alias("model"), F.max("variants").alias("variants"), F.max("unavailable").alias("unavailable"))
    return one.agg(F.count("*").alias("items"), F.sum(F.col("n") - 1).alias("duplicates"), F.count_if("name").alias("missing_name"), F.count_if("model").alias("missing_model"), F.count_if(F.col("variants") > 1).alias("multi_variant"), F.count_if("unavailable").alias("unavailable"))


def run_budget(seconds: Column, limit_minutes: Column, ratio: float = WARN_RATIO) -> Column:
    """struct<minutes, percent, over>: minutes begun, percent of the limit, and whether the run is strictly above the warning mark."""
    return F.struct(F.ceil(seconds / 60).cast("long").alias("minutes"), half_up(seconds / (limit_minutes * 60) * 100).alias("percent"), (seconds > limit_minutes * 60 * ratio).alias("over"))


def cover_cache_issues(listings: DataFrame, products: DataFrame) -> DataFrame:
    """(code, subject): what makes a stored cover (id, pages, layout, truncated, items) useless: ids, pages, layouts, items unknown, and products that no listing shows."""
    rules = {
        "cover.id": ~F.coalesce(F.col("id").rlike("^[cr]/[A-Za-z0-9][A-Za-z0-9_-]{0,60}$"), F.lit(False)) | repeated("id"), "cover.pages": ~F.coalesce(F.col("pages").between(1, 50), F.lit(False)),
        "cover.layout": ~F.coalesce(F.col("layout").isin("card", "table"), F.lit(False)), "cover.truncated": F.col("truncated").isNull(), "cover.items": F.coalesce(F.size("items"), F.lit(0)) < 1,
    }
    shown = listings.select("id", F.explode("items").alias("product")).distinct()
    unknown = shown.join(products.select("product"), "product", "left_anti").select(F.lit("cover.unknown").alias("code"), F.col("product").cast("string").alias("subject")).distinct()
    hidden = products.select("product").join(shown, "product", "left_anti").select(F.lit("cover.hidden").alias("code"), F.col("product").cast("string").alias("subject"))
    return found(listings, "id", rules).unionByName(unknown).unionByName(hidden)


def repair_pick(membership: DataFrame, missing: DataFrame, read: DataFrame, pages: DataFrame) -> DataFrame:
    """(id, gain, pages, stable) of the unread listing that shows most missing products a page, stable ones first; membership is (id, product), pages (id, pages, stable)."""
    left = membership.join(read.select("id"), "id", "left_anti").join(missing.select("product").distinct(), "product", "left_semi").distinct()
    gains = left.groupBy("id").agg(F.count("*").alias("gain")).join(pages, "id")
    return gains.orderBy(F.col("stable").desc(), (F.col("gain") / F.col("pages")).desc(), F.col("gain").desc(), "id").limit(1).select("id", "gain", "pages", "stable")


def crawl_choice(shops: DataFrame, planned: DataFrame, known: DataFrame, shop: str) -> DataFrame:
    """(shop, mode, reason, listings, pages): a cover crawl where nothing speaks against it, else a full one and the first reason why; a doubt is a reason.

    shops has configured, named (the caller gave the listings), families, wanted, age (milliseconds since the full run, null without one) and every_days; planned
    is (shop, id, pages), known (shop, id) what the sitemap still has.
    """
    gone = planned.join(known.select(shop, "id").distinct().withColumn("__k", F.lit(True)), [shop, "id"], "left")
    plan = gone.groupBy(shop).agg(F.count("*").alias("listings"), F.sum("pages").alias("pages"), F.count_if(F.col("__k").isNull()).alias("gone"))
    rows = shops.join(plan, shop, "left").fillna(0, ["listings", "pages", "gone"])
    reason = eligibility([
        (F.col("configured"), "not configured"), (~F.col("named"), "listings given"), (F.col("families").isNotNull(), "no full run"), (F.array_sort("families") == F.array_sort("wanted"), "other families"),
        (F.col("age") >= 0, "dated ahead"), (F.col("age") < F.col("every_days") * DAY_MS - FULL_RUN_SLACK_MS, "full run due"), (F.col("gone") == 0, "listings gone"),
    ])
    return rows.select(shop, F.when(reason.isNull(), "cover").otherwise("full").alias("mode"), reason.alias("reason"), "listings", "pages")
