"""Amounts are whole minor units (long); nothing is rounded on the way in."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Currencies without minor digits, and the words that stand before an amount.
WHOLE_CURRENCIES = ("JPY", "KRW")


def half_up(x: Column, digits: int = 0) -> Column:
    """Rounds to `digits` places, halves towards +infinity."""
    scale = 10**digits
    return F.floor(x * scale + 0.5) / scale if digits else F.floor(x + 0.5).cast("long")


def minor_digits(currency: Column) -> Column:
    return F.when(currency.isin(*WHOLE_CURRENCIES), 0).otherwise(2)


def whole_yen(raw: Column) -> Column:
    """An amount of at most 12 digits whose fraction, if written, is zero; else null."""
    return F.when(raw.rlike(r"^\d{1,12}(\.0+)?$"), F.regexp_extract(raw, r"^(\d+)", 1).cast("long"))


def decimal_minor(raw: Column) -> Column:
    """`12.3` and `12.30` are 1230; more than two decimals or anything else is null."""
    ok = raw.rlike(r"^\d{1,12}(\.\d{1,2})?$")
    fraction = F.rpad(F.regexp_extract(raw, r"\.(\d+)$", 1), 2, "0").cast("long")
    return F.when(ok, F.regexp_extract(raw, r"^(\d+)", 1).cast("long") * 100 + F.when(raw.contains("."), fraction).otherwise(0))


def display_amount(text: Column) -> Column:
    """The first run of digits and commas in a displayed price, as a number; null without one."""
    run = F.regexp_extract(text, r"(\d[\d,]*)", 1)
    return F.when(run != "", F.regexp_replace(run, ",", "").cast("long"))


def display_quantity(text: Column) -> Column:
    """`2362 sets` -> (2362, `sets`)."""
    run = F.regexp_extract(text, r"^\s*(\d[\d,]*)", 1)
    return F.struct(F.when(run != "", F.regexp_replace(run, ",", "").cast("long")).alias("quantity"), F.nullif(F.trim(F.regexp_extract(text, r"^\s*\d[\d,]*(.*)$", 1)), F.lit("")).alias("unit"))


def converted(minor: Column, digits: Column, rate: Column, fee_percent: Column) -> Column:
    """Whole home-currency units of an amount: half up of minor / 10^digits * rate * (1 + fee / 100)."""
    return half_up(minor / F.pow(F.lit(10), digits) * rate * (1 + fee_percent / 100))


def price_change(before: Column, now: Column) -> Column:
    """struct<difference, percent, direction> of two exact amounts; percent has two places and is null from zero, all but direction are null without a side."""
    both = before.isNotNull() & now.isNotNull()
    difference = F.when(both, now - before)
    percent = F.when(both & (before != 0), half_up(100.0 * difference / before, 2))
    direction = F.when(~both, "unknown").when(difference > 0, "up").when(difference < 0, "down").otherwise("same")
    return F.struct(difference.alias("difference"), percent.alias("percent"), direction.alias("direction"))


def signed_amount(minor: Column) -> Column:
    return F.when(minor > 0, F.concat(F.lit("+"), minor.cast("string"))).when(minor < 0, F.concat(F.lit("−"), F.abs(minor).cast("string"))).otherwise("±0")


# How an amount in a currency is written; others are written as digits and the currency.
SIGNS = {"JPY": "￥", "USD": "$", "EUR": "€", "KRW": "₩"}


def money_text(minor: Column, currency: Column) -> Column:
    """An amount of minor units with its currency's sign, thousands apart and as many decimals as the currency has."""
    digits = minor_digits(currency)
    number = F.when(digits == 0, F.format_number(minor / F.pow(F.lit(10), digits), 0)).otherwise(F.format_number(minor / F.pow(F.lit(10), digits), 2))
    signs = F.create_map(*[F.lit(x) for kv in SIGNS.items() for x in kv])
    return F.when(signs[currency].isNotNull(), F.concat(signs[currency], number)).otherwise(F.concat(F.regexp_replace(number, ",", ""), F.lit(" "), currency))


def signed_money(minor: Column, currency: Column) -> Column:
    """An amount with its sign before it, `±` for none."""
    return F.concat(F.when(minor > 0, "+").when(minor < 0, "−").otherwise("±"), money_text(F.abs(minor), currency))


def percent_text(percent: Column) -> Column:
    """`+1.5%`: one decimal, halves away from zero, with its sign before it."""
    shown = F.format_string("%.1f", (F.floor(F.abs(percent) * 10 + 0.5) / 10).cast("double"))
    return F.concat(F.when(percent > 0, "+").when(percent < 0, "−").otherwise("±"), shown, F.lit("%"))


def four_places(x: Column) -> Column:
    return half_up(x, 4)


def capped_count(count: Column, cap: Column) -> Column:
    """`100+` at or above the cap that a shop shows."""
    return F.when(cap.isNotNull() & (count >= cap), F.concat(cap.cast("string"), F.lit("+"))).otherwise(count.cast("string"))
