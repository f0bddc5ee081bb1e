"""The stored source of a cover crawl: a gzipped JSON document that is a cache, so that anything wrong with it is a reason to read everything, never a failure."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.contract import get, is_true, kind, let

# The document's version, families of listings, shapes of ids and codes, pages and layouts of a listing.
VERSION, FAMILIES = 1, ("c", "r")
ID, CODE = r"^[cr]/[A-Za-z0-9][A-Za-z0-9_-]{0,60}\z", r"^[0-9]{1,12}\z"
PAGES, LAYOUTS = (1, 50), ("card", "table")


def write_covers(documents: DataFrame, path: str) -> None:
    """Documents (a JSON text a row, `text`) as gzipped lines."""
    documents.select("text").write.text(path, compression="gzip")


def read_covers(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path).withColumnRenamed("value", "text")


def _texts(v: Column) -> Column:
    """An array of texts; null if it is no array or holds anything else."""
    parts = F.try_variant_get(v, "$", "array<variant>")
    return F.when((kind(v) == "ARRAY") & F.forall(parts, lambda x: kind(x) == "STRING"), F.transform(parts, lambda x: F.try_variant_get(x, "$", "string")))


def _whole(v: Column) -> Column:
    return F.when(kind(v) == "BIGINT", F.try_variant_get(v, "$", "bigint"))


def _rising(a: Column) -> Column:
    """Whether an array without nulls rises strictly."""
    return F.forall(F.sequence(F.lit(1), F.greatest(F.size(a) - 1, F.lit(1))), lambda i: (i >= F.size(a)) | (F.get(a, i - 1) < F.get(a, i)))


def cover_fault(text: Column) -> Column:
    """The first thing that is wrong with a document; null for a sound one. It is parsed once, and its parts are taken out once."""

    def parts(v: Column) -> Column:
        listings = F.try_variant_get(get(v, "listings"), "$", "array<variant>")
        ids = F.transform(listings, lambda x: F.when(kind(get(x, "id")) == "STRING", F.try_variant_get(x, "$.id", "string")))
        codes = F.transform(listings, lambda x: F.transform(F.try_variant_get(get(x, "codes"), "$", "array<variant>"), _whole))
        return F.struct(v.alias("v"), _texts(get(v, "families")).alias("families"), _texts(get(v, "products")).alias("products"), listings.alias("listings"), ids.alias("ids"), codes.alias("codes"))

    return let(F.try_parse_json(text), lambda v: let(parts(v), _first_fault))


def _first_fault(d: Column) -> Column:
    v, families, products, listings, ids, codes = (d[c] for c in ("v", "families", "products", "listings", "ids", "codes"))
    built = F.when(kind(get(v, "builtAt")) == "STRING", F.try_to_timestamp(F.try_variant_get(v, "$.builtAt", "string")))
    bad_families = families.isNull() | (F.size(families) == 0) | ~F.forall(families, lambda f: f.isin(*FAMILIES)) | ~_rising(families)
    bad_products = products.isNull() | (F.size(products) == 0) | ~F.forall(products, lambda p: p.rlike(CODE)) | ~_rising(products)

    def listing(x: Column, i: Column) -> Column:
        own, pages, c = F.get(ids, i), _whole(get(x, "pages")), F.get(codes, i)
        wrong = lambda says: F.concat_ws(": ", own, F.lit(says))
        unfit = c.isNull() | (F.size(c) == 0) | F.exists(c, lambda n: n.isNull() | (n < 0) | (n >= F.size(products))) | ~_rising(c)
        return (
            F.when(kind(x) != "OBJECT", "listing is no object").when(own.isNull() | ~own.rlike(ID) | (F.array_position(ids, own) < i + 1), "bad or repeated id").when(~F.coalesce(pages.between(*PAGES), F.lit(False)), wrong("pages"))
            .when(~F.coalesce(F.try_variant_get(x, "$.layout", "string").isin(*LAYOUTS), F.lit(False)), wrong("layout")).when(kind(get(x, "truncated")) != "BOOLEAN", wrong("truncated")).when(F.coalesce(unfit, F.lit(True)), wrong("codes"))
        )

    first = F.get(F.filter(F.transform(listings, listing), lambda f: f.isNotNull()), F.lit(0))
    shown = F.size(F.array_distinct(F.flatten(codes)))
    return (
        F.when(v.isNull(), "unreadable").when(kind(v) != "OBJECT", "not an object").when(~F.coalesce(_whole(get(v, "version")) == VERSION, F.lit(False)), "version").when(built.isNull(), "date").when(F.coalesce(bad_families, F.lit(True)), "families")
        .when(F.coalesce(bad_products, F.lit(True)), "products").when(listings.isNull() | (F.size(listings) == 0), "no listings").otherwise(let(first, lambda first: F.when(first.isNotNull(), first).when(shown < F.size(products), "a product is shown by no listing")))
    )


def stable_listings(documents: DataFrame, key: str, fault: Column | None = None) -> DataFrame:
    """(key, id, pages, layout, truncated, products) of sound documents' listings: the products that each shows, by code. `fault` is cover_fault, where it is known."""
    v = F.try_parse_json("text")
    rows = documents.where((cover_fault(F.col("text")) if fault is None else fault).isNull()).select(key, _texts(get(v, "products")).alias("p"), F.explode(F.try_variant_get(get(v, "listings"), "$", "array<variant>")).alias("x"))
    shown = F.transform(F.try_variant_get(F.col("x"), "$.codes", "array<int>"), lambda i: F.get("p", i))
    return rows.select(key, F.try_variant_get("x", "$.id", "string").alias("id"), F.try_variant_get("x", "$.pages", "int").alias("pages"), F.try_variant_get("x", "$.layout", "string").alias("layout"), is_true(get(F.col("x"), "truncated")).alias("truncated"), shown.alias("products"))
