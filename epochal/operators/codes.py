"""Codes by which listings of different shops are known to be one product: own codes without shop prefixes, forms derived from them, pages they cite."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.keys import normal_code, part_number

# Prefixes that shops put before a maker's code, by maker; forms of resold makers; labels whose bracket is a page or a part number.
MAKER_CODE = {"M5Stack": ("^M5STACK-", 8), "Raspberry Pi Trading": (r"^RPI-SC\d+$", 4), "DFRobot": (r"^DFROBOT-(DFR|SEN|FIT|DRI)\d", 8), "Arduino": (r"^ARDUINO-(ABX|A|AKX|AFX|ASX|K|X)\d", 8)}
PREFIXES = "SFE DFROBOT ADA POLOLU WAVESHARE PIMORONI ARDUINO FEETECH KITRONIK UCTRONICS DIGI ATMEL MICROCHIP M5STACK ALIENTEK BENEWAKE".split()
RESOLD_FORMS = {"Adafruit": (r"^ADA(\d+)$", "ADA-"), "Pololu": (r"^POL-(\d+)$", "POLOLU-"), "Kitronik": (r"^KIT-(\d.*)$", "KITRONIK-")}


def without_shop_prefix(code: Column, store: Column, maker: Column) -> Column:
    """A code as its maker writes it: the first rule that fits its shop or maker takes its prefix away."""
    out = F.when((store == "akizuki") & code.startswith("M5STACK-"), F.substring(code, 9, 1 << 20))
    for name, (shape, skip) in MAKER_CODE.items():
        out = out.when((maker == name) & code.rlike(shape), F.substring(code, skip + 1, 1 << 20))
    return out.when((store == "akizuki") & code.rlike(r"^SKU:?\d+$"), F.regexp_replace(code, "^SKU:?", "")).otherwise(code)


def identity_codes(values: Column, store: Column, maker: Column) -> Column:
    """Distinct codes in order; values are already in normal form (see normal_code), blanks are left out."""
    full = F.filter(values, lambda v: v.isNotNull() & (v != ""))
    return F.array_sort(F.array_distinct(F.transform(full, lambda v: without_shop_prefix(v, store, maker))))


def plain_of_annotated(code: Column) -> Column:
    """The part number before an annotation in brackets or `/NOPB`, or null."""
    head = F.when(code.rlike(r"^[^(]+\("), F.regexp_extract(code, r"^([^(]+)\(", 1)).when(code.rlike("^.+/NOPB$"), F.regexp_extract(code, "^(.+)/NOPB$", 1))
    return F.when(part_number(head), head)


def alternatives(code: Column) -> Column:
    """Part numbers joined by `/`, if each has five characters; a short tail is a package."""
    parts = F.split(code, "/")
    return F.when((F.size(parts) > 1) & F.forall(parts, lambda p: (F.char_length(p) >= 5) & part_number(p)), parts).otherwise(F.array().cast("array<string>"))


def rewritten(codes: Column, shape: str, prefix: str) -> Column:
    """What the codes of a shape hold in its group, behind a prefix."""
    return F.transform(F.filter(codes, lambda c: c.rlike(shape)), lambda c: F.concat(F.lit(prefix), F.regexp_extract(c, shape, 1)))


def derived_codes(codes: Column, store: Column, vendor: Column) -> Column:
    """Keys that codes give beyond themselves: annotations and alternatives, resold makers' forms, maker prefixes, nine-digit numbers; none of the codes."""
    plain = F.array_compact(F.transform(codes, plain_of_annotated))
    parts = F.flatten(F.transform(codes, alternatives))
    seeed = F.filter(F.transform(codes, lambda c: F.regexp_extract(c, r"^SEEED-(\d{9})$", 1)), lambda c: c != "")
    numbers = F.when(store == "akizuki", F.concat(
        F.filter(F.transform(codes, lambda c: F.regexp_extract(c, r"^(?:SKU-)?(\d{9})(?:\([0-9A-Z]+\))?$", 1)), lambda c: c != ""),
        F.flatten(F.transform(codes, lambda c: F.when(c.rlike(r"^\d{9}(/\d{9})+$"), F.split(c, "/")).otherwise(F.array().cast("array<string>")))),
    )).otherwise(F.array().cast("array<string>"))
    resold = F.array().cast("array<string>")
    for name, (shape, prefix) in RESOLD_FORMS.items():
        resold = F.when((store == "pimoroni") & (vendor == name), rewritten(codes, shape, prefix)).otherwise(resold)
    forms = F.concat(codes, plain, parts)
    rest = F.filter(F.transform(forms, lambda c: F.regexp_extract(c, f"^(?:{'|'.join(PREFIXES)})-(.+)$", 1)), lambda c: part_number(c))
    return F.array_except(F.array_distinct(F.concat(plain, parts, seeed, numbers, resold, rest)), codes)


def resale_reference(model: Column) -> Column:
    """struct<code, page> of a model written `<code>/<page number>`, or null."""
    m = normal_code(model)
    shape = r"^([^【/]+)/(\d{4,5})$"
    code = F.regexp_extract(m, shape, 1)
    return F.when(m.rlike(shape) & code.rlike("[A-Z]") & code.rlike("[0-9]"), F.struct(code.alias("code"), F.regexp_extract(m, shape, 2).alias("page")))


def page_reference(store: Column, page: Column) -> Column:
    return normal_code(F.concat_ws("/", store, page))


def tag_value(tags: Column, prefix: str) -> Column:
    """What follows a prefix in the first tag that has it, grouping tags left out; empty without one."""
    found = F.filter(tags, lambda t: t.startswith(prefix) & ~t.startswith("code:prefix:"))
    return F.coalesce(F.substring(F.try_element_at(found, F.lit(1)), len(prefix) + 1, 1 << 20), F.lit(""))
