"""Identity evidence of what shops list, one shape for all shops, and what binds reviews to it: fingerprints, aliases, dismissals, supplements, endpoints."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.keys import normal_code, page_key_of_handle, useful_code
from ..functions.times import parse_iso
from . import matching
from .codes import derived_codes, identity_codes, page_reference, resale_reference, tag_value

VARIANTS = "array<struct<offer:string,sku:string,name:string>>"
#: A listing's columns in the order that its fingerprint takes them.
COLUMNS = ("store", "page", "name", "model", "url", "maker", "maker_name", "maker_code", "product_code", "sku", "codes", "models", "vendor", "variants")
# Makers by the labels of a shop, the vendor label of a maker's own shop, labels whose bracket is a page or a part number.
PREFIX_MAKERS = {"M5STACK": "M5Stack", "Raspberry Pi": "Raspberry Pi Trading", "Arduino": "Arduino", "DFROBOT": "DFRobot"}
OWN_SHOP = {"m5stack-store": "M5Stack"}
RESALE_LABELS = ("M5STACK", "スイッチサイエンス", "DFROBOT", "Pololu", "SONY (ソニー)", "D-Robotics", "DAMIAO", "Arduino", "ALIENTEK")
LEAST_EVIDENCE = 20


def lookup(table: dict[str, str], key: Column) -> Column:
    """The value of a key in a small fixed table; empty without one."""
    out = F.when(F.lit(False), "")
    for k, v in table.items():
        out = out.when(key == k, v)
    return out.otherwise("")


def _listing(store: Column, page: Column, name: Column, model: Column, url: Column, codes: Column, models: Column, **more: Column) -> list[Column]:
    out = {"store": store, "page": page, "name": name, "model": model, "url": url, "codes": codes, "models": models, "variants": F.lit(None).cast(VARIANTS)} | more
    return [out.get(c, F.lit("")).alias(c) for c in COLUMNS]


def _own(values: list[Column], store: Column, maker: Column) -> Column:
    return identity_codes(F.array(*[normal_code(v) for v in values]), store, maker)


def of_listing(items: DataFrame) -> DataFrame:
    """Rows of (store, salesCode, modelNumber, name, url): the model is all that the shop knows of the maker."""
    model = F.coalesce("modelNumber", F.lit(""))
    maker = F.when(model.startswith("M5STACK-"), "M5Stack").otherwise("")
    return items.select(*_listing(F.col("store"), F.col("salesCode"), F.col("name"), model, F.col("url"), _own([model], F.col("store"), maker), F.array(model), maker=maker))


def of_catalogue(items: DataFrame) -> DataFrame:
    """Rows of (store, handle, title, url, vendor, tags, variants): tags carry the maker's evidence; numeric codes that are the shop's own are left out."""
    tag = {k: tag_value(F.col("tags"), p) for k, p in (("maker", "mfr:name:"), ("code", "mfr:prod:code:"), ("name", "mfr:prod:name:"), ("own", "code:"))}
    rows = items.withColumns({f"__{k}": v for k, v in tag.items()})
    model = F.when(F.col("__code") != "", F.col("__code")).otherwise(F.col("__own"))
    maker = F.when(F.col("__maker") != "", F.col("__maker")).otherwise(F.coalesce("vendor", F.lit("")))
    sku = F.coalesce(F.get("variants", F.lit(0))["sku"], F.lit(""))
    rows = rows.withColumns({"__model": model, "__by": maker, "__sku": sku})
    told = lambda v: F.when(~(v.rlike(r"^\d+$") & ((v == F.col("__sku")) | (v == F.col("handle")))), v)
    codes = _own([told(F.col(c)) for c in ("__model", "__code", "__own")], F.col("store"), F.col("__by"))
    models = F.array_distinct(F.array_compact(F.array(F.col("__model"), F.nullif(F.col("__sku"), F.lit("")))))
    name = F.trim(F.regexp_replace("title", r"\s+", " "))
    return rows.select(*_listing(F.col("store"), F.col("handle"), name, F.col("__model"), F.col("url"), codes, models, maker=F.col("__by"), maker_name=F.col("__name"), maker_code=F.col("__code"), product_code=F.col("__own"), sku=F.col("__sku")))


def of_storefront(items: DataFrame, maker_shop: bool) -> DataFrame:
    """Rows of (store, handle, title, url, vendor, variants<id, sku, title>): every variant's SKU is a code. A maker's own shop names the maker; a reseller's vendor
    label is its own and rules nothing out."""
    vendor = F.coalesce("vendor", F.lit(""))
    own = lookup(OWN_SHOP, F.lower(vendor))
    maker = F.when(own != "", own).otherwise(vendor) if maker_shop else F.lit("")
    by = vendor if maker_shop else F.lit("")
    variants = F.transform("variants", lambda v: F.struct(v["id"].cast("string").alias("offer"), F.coalesce(v["sku"], F.lit("")).alias("sku"), v["title"].alias("name")))
    rows = items.withColumns({"__v": variants, "__maker": maker, "__by": by, "__vendor": vendor})
    model = F.when(F.size("__v") == 1, F.get("__v", F.lit(0))["sku"]).otherwise("")
    codes = identity_codes(F.transform("__v", lambda v: F.regexp_replace(F.upper(v["sku"]), r"\s+", "")), F.col("store"), F.col("__by"))
    evidence = {"maker_name": F.col("title"), "maker_code": model} if maker_shop else {}
    return rows.select(*_listing(F.col("store"), page_key_of_handle(F.col("handle")), F.col("title"), model, F.col("url"), codes, F.array(model), maker=F.col("__maker"), vendor=F.col("__vendor"), variants=F.col("__v"), **evidence))


def of_api(items: DataFrame) -> DataFrame:
    """Rows of (store, id, name, model, make, url): the shop's label of the maker is kept for review only."""
    model = F.trim(F.coalesce(F.col("model").cast("string"), F.lit("")))
    return items.select(*_listing(F.col("store"), F.col("id").cast("string"), F.trim("name"), model, F.col("url"), _own([model], F.col("store"), F.lit("")), F.array(model), vendor=F.trim("make")))


def of_category(items: DataFrame) -> DataFrame:
    """Rows of (store, code, name, maker, model, url): some labels say which maker's prefix a model may carry."""
    vendor, model = F.trim(F.coalesce("maker", F.lit(""))), F.trim(F.coalesce("model", F.lit("")))
    # codes are made before the listing: within a function's body, `maker` would be the listing's
    rows = items.withColumn("__codes", _own([model], F.col("store"), lookup(PREFIX_MAKERS, vendor)))
    return rows.select(*_listing(F.col("store"), F.col("code"), F.trim("name"), model, F.col("url"), F.col("__codes"), F.array(model), vendor=vendor))


#: Which projection reads which shape of items.
PROJECTIONS: dict[str, Callable[[DataFrame], DataFrame]] = {
    "listing": of_listing, "catalogue": of_catalogue, "maker storefront": lambda i: of_storefront(i, True), "storefront": lambda i: of_storefront(i, False), "api": of_api, "category": of_category,
}


def project(shape: str, items: DataFrame, issues: DataFrame | None = None) -> DataFrame:
    """Listings of a snapshot's items, after its own validation: with any issue nothing of it is taken."""
    if issues is not None and not issues.isEmpty():
        raise ValueError(f"a {shape} snapshot with issues gives no listings")
    return PROJECTIONS[shape](items)


def listing_key() -> Column:
    return F.concat_ws("/", "store", "page")


def fingerprint() -> Column:
    """SHA-256 of the listing as JSON, columns in their fixed order: a review holds for what it saw."""
    return F.sha2(F.to_json(F.struct(*COLUMNS), {"ignoreNullFields": "false"}), 256)


def maker_claim(own_labels: dict[str, str]) -> Column:
    """The maker that a listing claims: a shop's own name says nothing about it."""
    return F.when(lookup(own_labels, F.col("store")) == F.col("maker"), "").otherwise(F.col("maker"))


def variant_codes(sku: Column) -> Column:
    """What one variant's SKU can meet: its own codes and what they give."""
    own = identity_codes(F.array(normal_code(sku)), F.col("store"), F.col("maker"))
    return F.array_sort(F.array_union(own, derived_codes(own, F.col("store"), F.col("vendor"))))


def reference_keys(resale_of: dict[str, str]) -> Column:
    """Pages that a listing stands for: its own, and those of the shop that its shop resells, named behind its model or in brackets by certain labels."""
    target = lookup(resale_of, F.col("store"))
    code = lambda c: F.regexp_extract(normal_code(F.col(c)), r"【(\d{3,5})】", 1)
    bracket = F.when(F.regexp_extract(normal_code(F.col("model")), r"^【(\d{3,5})】", 1) != "", F.regexp_extract(normal_code(F.col("model")), r"^【(\d{3,5})】", 1)).otherwise(code("name"))
    resold = resale_reference(F.col("model"))["page"]
    cited = F.array_compact(F.array(resold, F.when((bracket != "") & F.col("vendor").isin(*RESALE_LABELS), bracket)))
    own = F.array(page_reference(F.col("store"), F.col("page")))
    return F.when(target == "", own).otherwise(F.array_distinct(F.concat(own, F.transform(cited, lambda p: F.upper(F.concat_ws("/", target, p))))))


def bind_aliases(listings: DataFrame, aliases: DataFrame) -> DataFrame:
    """(key, codes, status) of reviewed aliases (key, fingerprint, codes, evidence, reviewed_at): bound, or the first reason why not.

    listings have key, fingerprint and own_keys. An alias must be the only one of a present listing that it saw as it is, and add usable codes the listing lacks.
    """
    n = aliases.withColumn("__n", F.count("*").over(Window.partitionBy("key"))).withColumn("codes", F.transform("codes", lambda c: F.regexp_replace(F.upper(c), r"\s+", "")))
    rows = n.join(listings.select("key", F.col("fingerprint").alias("__f"), "own_keys"), "key", "left")
    status = (
        F.when(F.col("__n") > 1, "repeated").when(F.col("__f").isNull(), "no such listing").when(F.col("__f") != F.col("fingerprint"), "stale").when(F.size("codes") == 0, "no codes")
        .when(F.exists("codes", lambda c: ~useful_code(c)), "unusable code").when(F.arrays_overlap("codes", "own_keys"), "known code").when(F.char_length("evidence") < LEAST_EVIDENCE, "no evidence").when(parse_iso(F.col("reviewed_at")).isNull(), "no date").otherwise("bound")
    )
    return rows.select("key", "codes", status.alias("status"))


def extra_keys(listings: DataFrame, aliases: DataFrame) -> DataFrame:
    """listings with `extra`: keys that their own fields give beyond their codes, and those of bound aliases."""
    a = aliases.where("status = 'bound'").select("key", F.col("codes").alias("__a"))
    none = F.array().cast("array<string>")
    rows = listings.withColumn("__d", derived_codes(F.col("codes"), F.col("store"), F.col("vendor"))).join(a, "key", "left")
    return rows.withColumn("extra", F.array_union("__d", F.coalesce("__a", none))).drop("__a", "__d")


def bind_dismissals(leads: DataFrame, listings: DataFrame, dismissals: DataFrame) -> DataFrame:
    """(a, b, status) of dismissals (a, b, fingerprint, decision, evidence): a dismissal names a present lead whose listings it saw as they are, once."""
    f = lambda side: listings.select(F.col("id").alias(side), F.col("fingerprint").alias(f"__f{side}"))
    rows = dismissals.withColumn("__n", F.count("*").over(Window.partitionBy("a", "b"))).join(leads.select("a", "b", F.lit(True).alias("__lead")), ["a", "b"], "left").join(f("a"), "a", "left").join(f("b"), "b", "left")
    seen = F.sha2(F.concat("__fa", "__fb"), 256)
    status = (
        F.when(F.col("__n") > 1, "repeated").when(F.col("__lead").isNull(), "no such lead").when(~F.coalesce(seen == F.col("fingerprint"), F.lit(False)), "stale")
        .when(~F.col("decision").isin("different", "identity") | (F.char_length("evidence") < LEAST_EVIDENCE), "no evidence").otherwise("bound")
    )
    return rows.select("a", "b", "decision", status.alias("status"))


def open_leads(leads: DataFrame, bound: DataFrame) -> DataFrame:
    return leads.join(bound.where("status = 'bound'").select("a", "b"), ["a", "b"], "left_anti")


def catalogue_issues(listings: DataFrame, sources: DataFrame) -> DataFrame:
    """(issue, subject): what a catalogue of listings (store, page, name, url, observed, variants) and sources (store, observed, count, retired) breaks.

    Listings are unique, named, of a known source and a safe address; variants have distinct ids; a source has as many listings as it counts, retired ones
    included, which a later source of its store replaced.
    """
    key = listing_key()
    rows = listings.withColumn("__key", key).withColumn("__n", F.count("*").over(Window.partitionBy("__key")))
    rows = rows.join(sources.select("store", "observed", F.lit(True).alias("__source")), ["store", "observed"], "left")
    offers = F.transform("variants", lambda v: v["offer"])
    bad_variants = F.col("variants").isNotNull() & ((F.size("variants") == 0) | (F.size(F.array_distinct(offers)) < F.size(offers)) | F.exists("variants", lambda v: (F.coalesce(v["offer"], F.lit("")) == "") | (F.coalesce(v["name"], F.lit("")) == "")))
    checks = [(F.col("__source").isNull(), "unknown source"), (F.col("__n") > 1, "repeated listing"), ((F.coalesce("name", F.lit("")) == "") | (F.coalesce("page", F.lit("")) == ""), "unnamed"), (~F.coalesce(F.col("url").rlike("^https://[^/@]+(/|$)"), F.lit(False)), "unsafe address"), (bad_variants, "variants")]
    found = rows.select(F.explode(F.array_compact(F.array(*[F.when(c, n) for c, n in checks]))).alias("issue"), F.col("__key").alias("subject"))
    counts = listings.groupBy("store", "observed").agg(F.count("*").alias("__c"))
    gone = sources.select("store", F.col("observed").alias("__from"), F.explode("retired").alias("__key"))
    gone = gone.join(rows.select("__key", F.col("store").alias("__s"), F.col("observed").alias("__at")), "__key", "left").where(F.col("__s").isNull() | (F.col("__s") != F.col("store")) | (F.col("__at") <= F.col("__from")))
    short = sources.join(counts, ["store", "observed"], "left").where(F.coalesce("__c", F.lit(0)) + F.size("retired") != F.col("count"))
    name = F.concat_ws("@", "store", "observed")
    return found.unionByName(gone.select(F.lit("retired").alias("issue"), F.col("__key").alias("subject"))).unionByName(short.select(F.lit("incomplete source").alias("issue"), name.alias("subject")))


def supplement_chain(known: DataFrame, steps: list[DataFrame], key: list[str], replace: DataFrame, value: list[str]) -> tuple[DataFrame, DataFrame]:
    """(rows, log): known supplemented by each step in order; the log has (key, action, step), with step null for keys of `replace` that no step replaced.

    Each step is a full outer join by key, so the chain is planned as one job.
    """
    log, rows = None, known
    for i, step in enumerate(steps):
        out = matching.supplement(rows, step, key, replace, value)
        rows = out.select(*key, *value)
        part = out.select(*key, "action", F.lit(i + 1).alias("step"))
        log = part if log is None else log.unionByName(part)
    unused = replace.select(*key).distinct().join(log.where("action = 'replaced'"), key, "left_anti")
    return rows, log.unionByName(unused.select(*key, F.lit("unused").alias("action"), F.lit(None).cast("int").alias("step")))


def append_store(known: DataFrame, listings: DataFrame) -> DataFrame:
    """known with a new shop's listings; a shop that is known already takes supplements instead."""
    if not known.join(F.broadcast(listings.select("store").distinct()), "store", "left_semi").limit(1).isEmpty():
        raise ValueError("the shop is in the catalogue; a newer snapshot is a supplement")
    return known.unionByName(listings)


def endpoints(relations: DataFrame, listings: DataFrame, side: str) -> DataFrame:
    """relations with `endpoint` of a side (key in column `side`, variant in `side`_offer): its address, and the variant's, which a listing with variants must name."""
    offer = F.col(f"{side}_offer")
    rows = relations.join(listings.select(F.col("key").alias(side), F.col("url").alias("__url"), F.col("variants").alias("__v"), F.col("name").alias("__name")), side, "left")
    one = F.get(F.filter("__v", lambda v: v["offer"] == offer), F.lit(0))
    bad = F.when(F.col("__url").isNull(), "no such listing").when(F.coalesce(offer, F.lit("")).eqNullSafe(F.lit("")) & F.col("__v").isNotNull(), "variant required").when((F.coalesce(offer, F.lit("")) != "") & one.isNull(), "no such variant")
    url = F.when(one.isNotNull(), F.concat("__url", F.lit("?variant="), F.url_encode(one["offer"]))).otherwise(F.col("__url"))
    good = F.struct(F.col("__name").alias("name"), url.alias("url"), one["sku"].alias("sku"))
    return rows.withColumn("endpoint", F.when(bad.isNull(), good)).withColumn("issue", bad).drop("__url", "__v", "__name")
