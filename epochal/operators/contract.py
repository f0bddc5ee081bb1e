"""Published files against their contract: every violation with its path in the document, found in one pass over JSON values by a description of what must be where."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .graph import cut

Rule = Callable[[Column], Column]


def get(v: Column, name: str) -> Column:
    return F.try_variant_get(v, f"$['{name}']", "variant")


def kind(v: Column) -> Column:
    return F.coalesce(F.regexp_extract(F.schema_of_variant(v), "^[A-Z]+", 0), F.lit("MISSING"))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of a value that is found once, however often body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def is_true(v: Column) -> Column:
    """Whether a value is true, not a number or text that could be taken for it."""
    return F.coalesce((kind(v) == "BOOLEAN") & F.try_variant_get(v, "$", "boolean"), F.lit(False))


def none() -> Column:
    return F.array().cast("array<string>")


def fault(bad: Column, path: Column, what: str) -> Column:
    return F.when(bad, F.array(F.concat(path, F.lit(f": {what}")))).otherwise(none())


@dataclass(frozen=True)
class Is:
    """A value of some kinds; with `among`, one of these texts; with `least` and `most`, a number between them."""

    kinds: tuple[str, ...]
    says: str
    among: tuple[str, ...] = ()
    least: int | None = None
    most: int | None = None

    def issues(self, v: Column, path: Column) -> Column:
        return let(v, lambda v: self._issues(v, path))

    def _issues(self, v: Column, path: Column) -> Column:
        ok = kind(v).isin(*self.kinds)
        if self.among:
            ok = ok & F.coalesce(F.try_variant_get(v, "$", "string").isin(*self.among), F.lit(False))
        if self.least is not None:
            n = F.try_variant_get(v, "$", "bigint")
            ok = ok & ((kind(v) != "BIGINT") | F.coalesce((n >= self.least) & (n <= (2**53 if self.most is None else self.most)), F.lit(False)))
        return fault(~ok, path, self.says)


@dataclass(frozen=True)
class Has:
    """An object with these fields, and rules of its own: (field, or empty for the object itself; whether it is broken; what is said)."""

    fields: dict
    rules: tuple[tuple[str, Rule, str], ...] = field(default=())
    or_null: bool = False

    def issues(self, v: Column, path: Column) -> Column:
        return let(v, lambda v: self._issues(v, path))

    def _issues(self, v: Column, path: Column) -> Column:
        inside = [spec.issues(get(v, name), F.concat(path, F.lit(f".{name}"))) for name, spec in self.fields.items()]
        own = [fault(F.coalesce(rule(v), F.lit(False)), F.concat(path, F.lit(f".{name}" if name else "")), says) for name, rule, says in self.rules]
        out = F.when(F.try_variant_get(v, "$", "map<string,variant>").isNull(), fault(F.lit(True), path, "expected an object")).otherwise(F.concat(*inside, *own) if inside or own else none())
        return F.when(F.coalesce(F.is_variant_null(v), F.lit(False)), none()).otherwise(out) if self.or_null else out


@dataclass(frozen=True)
class Each:
    """An array of such elements; `filled` if it must have one, `rising` if the first parts of its elements must rise."""

    of: object
    filled: str = ""
    rising: bool = False
    rules: tuple[tuple[Rule, str], ...] = ()

    def issues(self, v: Column, path: Column) -> Column:
        return let(F.try_variant_get(v, "$", "array<variant>"), lambda parts: self._issues(parts, path))

    def _issues(self, parts: Column, path: Column) -> Column:
        inside = F.flatten(F.transform(parts, lambda x, i: self.of.issues(x, F.concat(path, F.lit("["), i.cast("string"), F.lit("]")))))
        out = [inside]
        if self.filled:
            out.append(fault(F.size(parts) == 0, path, self.filled))
        if self.rising:
            at = F.filter(F.transform(parts, lambda x, i: F.struct(F.when(kind(F.try_variant_get(x, "$[0]", "variant")) == "BIGINT", F.try_variant_get(x, "$[0]", "bigint")).alias("t"), i.alias("i"))), lambda x: x["t"].isNotNull())
            out.append(let(at, lambda at: F.flatten(F.transform(at, lambda x, i: fault((i > 0) & F.coalesce(F.get(at, i - 1)["t"] >= x["t"], F.lit(False)), F.concat(path, F.lit("["), x["i"].cast("string"), F.lit("]")), "times must rise")))))
        out += [fault(F.coalesce(rule(parts), F.lit(False)), path, says) for rule, says in self.rules]
        return F.when(parts.isNull(), fault(F.lit(True), path, "expected an array")).otherwise(F.concat(*out))


@dataclass(frozen=True)
class Row:
    """An array with just these elements."""

    of: tuple
    says: str

    def issues(self, v: Column, path: Column) -> Column:
        return let(F.try_variant_get(v, "$", "array<variant>"), lambda parts: self._issues(parts, path))

    def _issues(self, parts: Column, path: Column) -> Column:
        inside = [spec.issues(F.get(parts, F.lit(i)), F.concat(path, F.lit(f"[{i}]"))) for i, spec in enumerate(self.of)]
        return F.when(parts.isNull() | (F.size(parts) != len(self.of)), fault(F.lit(True), path, self.says)).otherwise(F.concat(*inside))


# States, meanings of counts, caveats, capabilities and the number of the contract, and the place of a product's file.
MAJOR = 1
PRICES = ("exact", "range", "unavailable")
STATES = ("in_stock", "low_stock", "out_of_stock", "restocking", "preparing", "checking", "discontinued", "unknown", "not_displayed")
MEANINGS = ("site_reported", "reference", "not_exposed", "unknown")
FLAGS = ("supportsExactPrice", "supportsPriceRange", "supportsVariants", "supportsCompareAtPrice", "supportsTaxIncluded", "supportsTaxExcluded", "supportsAvailability", "supportsInventoryQuantity")
PLACE = "products/{pageKey}.json"

text, text_or_null = Is(("STRING",), "expected a string"), Is(("STRING", "VOID"), "expected a string or null")
whole, whole_or_null = Is(("BIGINT",), "expected an integer"), Is(("BIGINT", "VOID"), "expected an integer or null")
flag, flag_or_null = Is(("BOOLEAN",), "expected a boolean"), Is(("BOOLEAN", "VOID"), "expected a boolean or null")
time = Is(("BIGINT",), "expected a time", least=1)


def among(*values: str) -> Is:
    return Is(("STRING",), "expected one of " + ", ".join(values), among=values)


present = Is(("BIGINT",), "expected 0 or 1", least=0, most=1)
presence = Each(Row((time, present), "expected [t, 0 or 1]"), rising=True)
basis = Has({"quoteKind": among("selling", "compare_at"), "taxTreatment": among("tax_included", "tax_excluded", "unknown"), "currency": text, "unitLabel": text_or_null})
points = Each(Row((time, among(*PRICES), whole_or_null, whole_or_null), "expected [t, state, min, max]"), "a segment has a point", True)
price = Has(
    {"state": among(*PRICES), "minAmountMinor": whole_or_null, "maxAmountMinor": whole_or_null},
    (
        ("", lambda v: (F.try_variant_get(v, "$.state", "string") == "unavailable") & ((kind(get(v, "minAmountMinor")) != "VOID") | (kind(get(v, "maxAmountMinor")) != "VOID")), "unavailable price must have no amounts"),
        ("", lambda v: (F.coalesce(F.try_variant_get(v, "$.state", "string"), F.lit("")) != "unavailable") & ((kind(get(v, "minAmountMinor")) == "VOID") | (kind(get(v, "maxAmountMinor")) == "VOID")), "priced state needs amounts"),
    ),
)
window = Has({"minMinor": whole, "maxMinor": whole}, or_null=True)
number_or_null = Is(("BIGINT", "DECIMAL", "DOUBLE", "VOID"), "expected a number or null")
change = Has({"differenceMinor": whole_or_null, "percent": number_or_null, "direction": among("up", "down", "flat", "unknown")})
stats = Has({
    "current": price, "currentSinceAt": time, "previousDistinct": Has(price.fields, price.rules, or_null=True), "change": change, "observedMinMinor": whole_or_null, "observedMaxMinor": whole_or_null, "segmentStartAt": time,
    "changePointCount": whole, "windows": Has({w: window for w in ("d30", "d90", "d365")}),
})
segment = Has({"basis": basis, "primary": flag, "presence": presence, "points": points, "stats": stats})
availability = Each(Row((time, among(*STATES), flag_or_null, among(*MEANINGS), text_or_null), "expected [t, state, purchasable, semantics, status]"), rising=True)
_cap: Rule = lambda v: (kind(get(v, "cappedAt")) != "MISSING") & ~F.coalesce((kind(get(v, "cappedAt")) == "BIGINT") & (F.try_variant_get(v, "$.cappedAt", "bigint") > 0), F.lit(False))
inventory = Has({"semantics": among(*MEANINGS), "truncated": flag, "totalPoints": whole, "points": Each(Row((time, whole_or_null), "expected [t, quantity]"), rising=True)}, (("cappedAt", _cap, "expected a positive integer"),))
_primary: Rule = lambda parts: F.size(F.filter(parts, lambda s: is_true(get(s, "primary")))) > 1
offer = Has({"externalOfferId": text, "offerKind": text, "sku": text_or_null, "variantName": text_or_null, "presence": presence, "segments": Each(segment, rules=((_primary, "more than one primary segment"),)), "availability": availability, "inventory": inventory})
_version: Rule = lambda v: ~F.coalesce((kind(get(v, "contractVersion")) == "STRING") & F.try_variant_get(v, "$.contractVersion", "string").startswith(f"{MAJOR}."), F.lit(False))
_time_or_null = Is(("BIGINT", "VOID"), "expected a time", least=1)
observation = Has({"runCount": whole, "firstObservedAt": _time_or_null, "latestObservedAt": _time_or_null})
named = Has({"name": text, "modelNumber": text_or_null, "category": text_or_null, "canonicalUrl": text})
metadata = Each(Has({"t": time, **named.fields, "suspicious": flag}), "at least one metadata point")
product = Has({"firstSeenAt": time, "lastSeenAt": time, "listed": flag, "aliases": Each(Has({"kind": text, "value": text})), "presence": presence, "metadata": metadata, "current": named})
PRODUCT_FILE = Has({"datasetVersion": text, "storeId": text, "pageKey": text, "externalProductId": text, "generatedAt": text, "observation": observation, "product": product, "offers": Each(offer, "at least one offer")}, (("contractVersion", _version, f"expected major {MAJOR}"),))


_days: Rule = lambda v: (kind(get(v, "samplingIntervalDays")) != "MISSING") & ~F.coalesce((kind(get(v, "samplingIntervalDays")) == "BIGINT") & (F.try_variant_get(v, "$.samplingIntervalDays", "bigint") > 0), F.lit(False))
_place: Rule = lambda v: ~F.coalesce((kind(get(v, "productPathTemplate")) == "STRING") & (F.try_variant_get(v, "$.productPathTemplate", "string") == PLACE), F.lit(False))
capabilities = Has({**{x: flag for x in FLAGS}, "inventoryQuantitySemantics": among(*MEANINGS), "primaryQuote": Has({"quoteKind": among("selling", "compare_at"), "taxTreatment": among("tax_included", "tax_excluded", "unknown")})})
MANIFEST = Has(
    {
        "storeId": text, "datasetVersion": text, "generatedAt": text, "capabilities": capabilities, "observation": Has({**observation.fields, "latestCoverageId": text_or_null}, (("samplingIntervalDays", _days, "expected positive days"),)), "productCount": whole,
        "versions": Has({"contract": text, "sqliteSchema": whole, "sourceSchema": text_or_null}),
    },
    (("contractVersion", _version, f"expected major {MAJOR}"), ("productPathTemplate", _place, "unexpected template")),
)


def violations(files: DataFrame, json: str, spec=PRODUCT_FILE) -> DataFrame:
    """files with `issue`: a row for each violation, as `path: what is wrong`. A text that is no JSON has one."""
    v = F.col("__v")
    rows = files.withColumn("__v", F.try_parse_json(json))
    found = F.when(v.isNull(), F.array(F.lit("$: no JSON"))).otherwise(spec.issues(v, F.lit("$")))
    return rows.select(*files.columns, F.explode(found).alias("issue"))


def listed(issues: DataFrame, order: list[str], most: int = 50) -> DataFrame:
    """(rank, order, issue, total): the first `most` violations and how many there are; the rest is counted and not carried."""
    issues = cut(issues)  # they are found once
    total = issues.agg(F.count("*").alias("total"))
    first = issues.orderBy(*order, "issue").limit(most)
    ranked = first.withColumn("rank", F.row_number().over(Window.orderBy(*order, "issue")))  # `most` rows
    return ranked.join(F.broadcast(total)).select("rank", *order, "issue", "total")
