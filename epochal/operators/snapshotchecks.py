"""What a listing shop's snapshot must say of itself before any item is read: its version, time and completeness, what the collector reports, its listings and catalogue."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.times import parse_iso
from .contract import get, is_true, kind

# Versions that are read, the one that has no catalogue block, and how many of the collector's warnings are passed on.
VERSIONS, WITHOUT_CATALOGUE, PASSED_ON = (2, 3), 2, 5
LISTING = r"/catalog/([cr])/([A-Za-z0-9][A-Za-z0-9_-]{0,60}?)(?:_p\d+)?/?\z"


def _number(v: Column) -> Column:
    return F.when(kind(v).isin("BIGINT", "DECIMAL", "DOUBLE"), F.try_variant_get(v, "$", "double"))


def _said(code: str, bad: Column, subject: Column | None = None) -> Column:
    return F.when(F.coalesce(bad, F.lit(False)), F.struct(F.lit(code).alias("code"), (F.lit(None).cast("string") if subject is None else subject).alias("subject")))


def listing_id(url: Column) -> Column:
    """`c/name` of a listing's address, without the number of its page; null for any other."""
    found = F.regexp_extract(url, LISTING, 2)
    return F.when(found != "", F.concat(F.regexp_extract(url, LISTING, 1), F.lit("/"), F.lower(found)))


def snapshot_issues(snapshots: DataFrame, key: str, json: str) -> DataFrame:
    """(key, code, subject): errors of whole snapshots, a JSON text each, and warnings under `warn.`. One that is no object, or of another version, has that fault alone."""
    v = F.col("__v")
    field = lambda *names: _path(v, names)
    version = _number(field("schemaVersion"))
    at, checks = field("retrievedAt"), field("validation")
    errors, warnings = F.try_variant_get(checks, "$.errors", "array<variant>"), F.try_variant_get(checks, "$.warnings", "array<variant>")
    missed = _number(F.coalesce(get(checks, "listingMismatches"), get(checks, "genreMismatches")))
    catalogue, items = field("catalog"), F.try_variant_get(field("items"), "$", "array<variant>")
    checked, has_catalogue = kind(checks) == "OBJECT", kind(catalogue) == "OBJECT"
    total, uncovered, extracted = _number(get(catalogue, "productTotal")), _number(get(catalogue, "uncovered")), _number(field("extractedTotal"))
    text = lambda x: F.coalesce(F.try_variant_get(x, "$", "string"), F.to_json(x))
    single = F.array(
        _said("raw.retrieved_at", F.coalesce((kind(at) != "STRING") | parse_iso(F.try_variant_get(at, "$", "string")).isNull(), F.lit(True))), _said("raw.incomplete", ~is_true(field("complete"))),
        _said("raw.validation_missing", ~checked), _said("raw.collector_errors", F.size(errors) > 0, text(F.get(errors, F.lit(0)))), _said("raw.listing_mismatch", missed > 0),
        _said("raw.catalog_missing", ~has_catalogue & (version != WITHOUT_CATALOGUE)), _said("raw.catalog_total", has_catalogue & F.coalesce(total <= 0, F.lit(True))), _said("raw.catalog_uncovered", has_catalogue & F.coalesce(uncovered < 0, F.lit(True))),
        _said("warn.catalog_gap", has_catalogue & (uncovered > 0)), _said("raw.items", items.isNull()), _said("raw.items_empty", F.size(items) == 0), _said("raw.extracted_total", items.isNotNull() & (extracted != F.size(items))),
    )
    passed = F.transform(F.slice(warnings, 1, PASSED_ON), lambda w: _said("warn.collector_warning", F.lit(True), text(w)))
    listings = F.try_variant_get(F.coalesce(field("listings"), field("genres")), "$", "array<variant>")
    ids = F.transform(listings, lambda x: listing_id(F.try_variant_get(x, "$.url", "string")))
    of_listings = F.transform(listings, lambda x, i: F.struct(x.alias("x"), i.alias("i"), F.get(ids, i).alias("id"), F.array_position(ids, F.get(ids, i)).alias("first")))
    shape = lambda x: kind(x["x"]) == "OBJECT"
    name = lambda x: F.coalesce(x["id"], x["i"].cast("string"))
    each = F.flatten(F.transform(of_listings, lambda x: F.array(
        _said("raw.listing_shape", ~shape(x), x["i"].cast("string")), _said("raw.listing_url", shape(x) & x["id"].isNull(), F.try_variant_get(x["x"], "$.name", "string")), _said("raw.listing_duplicate", shape(x) & (x["first"] < x["i"] + 1), x["id"]),
        _said("raw.listing_failed_pages", shape(x) & ~F.coalesce(_number(get(x["x"], "failedPages")) == 0, F.lit(False)), name(x)), _said("raw.listing_total_mismatch", shape(x) & ~is_true(get(x["x"], "matchesListedTotal")), name(x)),
    )))
    nothing = F.array(_said("raw.listings", F.coalesce(F.size(listings) == 0, F.lit(True)) | listings.isNull()))
    empty = F.array().cast("array<struct<code:string,subject:string>>")
    whole = F.concat(single, F.coalesce(passed, empty), nothing, F.coalesce(each, empty))
    found = F.when(F.coalesce(kind(v) != "OBJECT", F.lit(True)), F.array(_said("raw.not_object", F.lit(True)))).when(~F.coalesce(version.isin(*VERSIONS), F.lit(False)), F.array(_said("raw.schema_version", F.lit(True)))).otherwise(whole)
    rows = snapshots.select(key, F.try_parse_json(json).alias("__v"))
    return rows.select(key, F.explode(F.array_compact(found)).alias("x")).select(key, "x.code", "x.subject")


def _path(v: Column, names: tuple[str, ...]) -> Column:
    for n in names:
        v = get(v, n)
    return v
