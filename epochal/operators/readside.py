"""What a reader is shown of a product: offers and quotes, charts as steps, readouts, related products in groups, and amounts as text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.money import capped_count, half_up, minor_digits
from ..functions.times import to_iso

# Signs and labels that readers see, rows shown before the rest is folded, related products whose history is loaded.
SIGNS = {"JPY": "￥", "USD": "$", "GBP": "£", "EUR": "€"}
TAX_LABELS = {"tax_included": "税込", "tax_excluded": "税抜", "unknown": "税区分不明"}
QUOTE_LABELS = {"selling": "販売価格", "compare_at": "参考価格"}
NO_PRICE, OUTSIDE, NO_RECORD = "価格表示なし", "観測期間外", "価格の記録なし"
VISIBLE_ROWS, VISIBLE_CARDS, HISTORY_TARGETS = 3, 3, 8


def choose(table: dict[str, str], key: Column, other: Column | str = "") -> Column:
    out = F.when(F.lit(False), "")
    for k, v in table.items():
        out = out.when(key == k, v)
    return out.otherwise(other)


# ---- text ------------------------------------------------------------------------------------------------------------


def money_text(minor: Column, currency: Column) -> Column:
    """An amount with its currency's sign, thousands and minor digits."""
    whole = F.format_number(F.floor(F.abs(minor) / 100), 0)
    pair = F.concat(whole, F.lit("."), F.lpad((F.abs(minor) % 100).cast("string"), 2, "0"))
    text = F.when(minor_digits(currency) == 0, F.format_number(F.abs(minor), 0)).otherwise(pair)
    return F.concat(F.when(minor < 0, "-").otherwise(""), choose(SIGNS, currency, F.concat(currency, F.lit(" "))), text)


def price_text(state: Column, low: Column, high: Column, currency: Column) -> Column:
    one = money_text(low, currency)
    return F.when((state == "unavailable") | low.isNull() | high.isNull(), NO_PRICE).when((state == "range") & (low != high), F.concat(one, F.lit("〜"), money_text(high, currency))).otherwise(one)


def basis_label(kind: Column, tax: Column, currency: Column, unit: Column) -> Column:
    return F.concat_ws(" / ", choose(QUOTE_LABELS, kind), choose(TAX_LABELS, tax), unit, F.when(currency != "JPY", currency))


def date_text(t: Column, zone_minutes: int = 0) -> Column:
    return F.substring(to_iso(t + zone_minutes * 60_000), 1, 10)


def time_text(t: Column, zone_minutes: int = 0) -> Column:
    return F.translate(F.substring(to_iso(t + zone_minutes * 60_000), 1, 16), "T", " ")


def sold_text(sold: Column, at_least: Column) -> Column:
    """None sold, about so many, or so many and more where a count stood at its cap."""
    n = F.concat(F.format_number(sold, 0), F.lit("個"))
    return F.when(sold == 0, n).when(at_least, F.concat(n, F.lit("以上"))).otherwise(F.concat(F.lit("約"), n))


def sales_details(decreases: Column, increases: Column, added: Column, since: Column, start: Column) -> Column:
    first = F.when(decreases == 0, "在庫数の減少は記録されていません").otherwise(F.concat(F.lit("在庫数の減少 "), decreases.cast("string"), F.lit(" 回")))
    more = F.when(increases > 0, F.concat(F.lit("増加 "), increases.cast("string"), F.lit(" 回（+"), F.format_number(added, 0), F.lit("個）")))
    late = F.when(since > start, F.concat(F.lit("記録は "), date_text(since), F.lit(" から")))
    return F.concat_ws(" · ", first, more, late)


# ---- offers ----------------------------------------------------------------------------------------------------------


def shown_offer(offers: DataFrame, key: list[str], selected: str) -> DataFrame:
    """The offer of each product to show: the selected one where the product has it, else the first present one, else the one present last, then the least id."""
    w = Window.partitionBy(*key).orderBy(F.coalesce(F.col("offer") == F.col(selected), F.lit(False)).desc(), F.col("present").desc(), F.when(~F.col("present"), -F.coalesce("last_present", F.lit(-(2**62)))), "offer")
    return offers.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n")


def primary_quote(offers: DataFrame, segments: DataFrame, key: list[str]) -> DataFrame:
    """offers with their primary segment, or the first one: segments have `primary` and `place`."""
    w = Window.partitionBy(*key).orderBy(F.col("primary").desc(), "place")
    first = segments.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n", "primary")
    return offers.join(first, key, "left")


def has_drifted(names: Column, models: Column, name: Column, model: Column, suspicious: Column) -> Column:
    """Whether a reviewed product is no longer as it was: neither name nor model may be another than expected, no point of its history suspicious."""
    form = lambda x: F.upper(F.trim(F.regexp_replace(x, r"\s+", " ")))
    same = lambda expected, now: F.exists(expected, lambda e: form(e) == form(F.coalesce(now, F.lit(""))))
    return ~(same(names, name) & same(models, model) & ~F.coalesce(suspicious, F.lit(False)))


def of_offer(offer: Column, sku: Column) -> Column:
    """Whether an entry's own side (own_offer, own_sku) names no offer, or the given one by id and SKU."""
    return F.col("own_offer").isNull() | (F.col("own_offer").eqNullSafe(offer) & F.col("own_sku").eqNullSafe(sku))


def for_offer(entries: DataFrame, offer: str, sku: str) -> DataFrame:
    """Entries whose own side names no offer, or the shown one by id and SKU."""
    return entries.where(of_offer(F.col(offer), F.col(sku)))


# ---- charts ----------------------------------------------------------------------------------------------------------


def clipped(spans: DataFrame, start: Column, end: Column) -> DataFrame:
    """Spans (start, stop inclusive) within a window, cut at its edges."""
    inside = spans.where((F.col("stop") >= start) & (F.col("start") <= end))
    return inside.withColumns({"start": F.greatest("start", start), "stop": F.least("stop", end)})


def gaps(steps: DataFrame, key: list[str]) -> DataFrame:
    """(key, start, stop) between steps of a series that don't meet."""
    w = Window.partitionBy(*key).orderBy("start")
    return steps.select(*key, (F.col("stop") + 1).alias("start"), (F.lead("start").over(w) - 1).alias("stop")).where("stop >= start")


def chart_totals(steps: DataFrame, markers: DataFrame, key: list[str]) -> DataFrame:
    """A row a series of what its chart draws: steps, gaps between them, markers, the range of values and of time."""
    w = Window.partitionBy(*key).orderBy("start")
    s = steps.withColumn("__gap", F.coalesce(F.lag("stop").over(w) + 1 < F.col("start"), F.lit(False)))
    out = s.groupBy(*key).agg(F.count("*").alias("steps"), F.count_if("__gap").alias("gaps"), F.min("value").alias("low"), F.max("value").alias("high"), F.min("start").alias("start"), F.max("stop").alias("stop"))
    return out.join(markers.groupBy(*key).agg(F.count("*").alias("markers")), key, "left").fillna(0, ["markers"])


def readout(targets: DataFrame, points: DataFrame, steps: DataFrame, ends: DataFrame, key: list[str], tolerance: int) -> DataFrame:
    """targets (key, at) with `value` and `source`: the nearest point within the tolerance (the earlier of two), else the step in effect, the later one where two
    meet; outside what was observed (first, last of `ends`), or without a record, none.

    Points and steps are carried to the targets by one sort of each series.
    """
    from . import asof

    near = asof.nearest(targets, points.select(*key, F.col("t").alias("at"), F.col("value").alias("dot")), key, "at", ["dot"], tolerance).drop("distance")
    out = asof.asof(near, steps.select(*key, F.col("start").alias("at"), F.col("stop").alias("until"), F.col("value").alias("step")), key, "at", ["until", "step"]).join(ends, key, "left")
    outside = F.col("first").isNull() | (F.col("at") < F.col("first") - tolerance) | (F.col("at") > F.col("last") + tolerance)
    step = F.when(F.col("at") <= F.col("until"), F.col("step"))
    source = F.when(outside, "outside").when(F.col("dot").isNotNull(), "point").when(step.isNotNull(), "step").otherwise("none")
    return out.select(*targets.columns, F.when(~outside, F.coalesce("dot", step)).alias("value"), source.alias("source"))


def cap_notes(steps: DataFrame, key: list[str], cap: str) -> DataFrame:
    """(key, caps): the distinct caps at which a count is drawn, as they are written."""
    at = steps.where(F.col("value") >= F.col(cap))
    return at.groupBy(*key).agg(F.array_sort(F.collect_set(capped_count(F.col("value"), F.col(cap)))).alias("caps"))


# ---- related products ------------------------------------------------------------------------------------------------


def directed(difference: Column, source_first: Column) -> Column:
    """`size: a ↔ b` as seen from one side: from the viewed product to the other."""
    shape = r"^([^:]*): (.*) ↔ (.*)$"
    part = lambda i: F.regexp_extract(difference, shape, i)
    turned = F.when(source_first, F.concat(part(1), F.lit(": "), part(2), F.lit(" → "), part(3))).otherwise(F.concat(part(1), F.lit(": "), part(3), F.lit(" → "), part(2)))
    return F.when(difference.rlike(shape), turned).otherwise(difference)


def related(relations: DataFrame, tie: list[str] = ()) -> DataFrame:
    """Relations (id, a, b, kind, verified, family, distance, differences) as each of their products shows them: (viewer, target, place, group, card, shown, loaded).

    Verified same products come first, then other candidates, similar ones, unresolved ones; within these the nearest. Similar products that differ alike share
    a card, in order of their first; cards beyond VISIBLE_CARDS are folded; the history of the first HISTORY_TARGETS different targets is loaded.
    Where ids may repeat, the columns in `tie` say which of two comes first.
    """
    ends = F.explode(F.array(F.struct(F.col("a").alias("viewer"), F.col("b").alias("target"), F.lit(True).alias("first")), F.struct(F.col("b").alias("viewer"), F.col("a").alias("target"), F.lit(False).alias("first"))))
    rows = relations.withColumn("__e", ends).select("*", "__e.*").drop("__e").where("viewer <> target or first")
    rank = F.when((F.col("kind") == "same_product") & F.col("verified"), 0).when(F.col("kind") == "same_product", 1).when(F.col("kind") == "similar_product", 2).otherwise(3)
    distance = F.coalesce("distance", F.size("differences"))
    rows = rows.withColumn("place", F.row_number().over(Window.partitionBy("viewer").orderBy(rank, distance, "id", *tie)))
    group = F.when(rank == 0, "verified").when(rank == 1, "same").when(rank == 2, "similar").otherwise("unresolved")
    alike = F.concat_ws("\n", F.col("family"), F.array_join(F.array_sort(F.transform("differences", lambda d: directed(d, F.col("first")))), "\n"))
    rows = rows.withColumns({"group": group, "__key": F.when((rank == 2) & F.col("family").isNotNull() & (F.size("differences") > 0), alike).otherwise(F.col("id"))})
    rows = rows.withColumn("__at", F.min("place").over(Window.partitionBy("viewer", "group", "__key")))
    rows = rows.withColumn("card", F.dense_rank().over(Window.partitionBy("viewer", "group").orderBy("__at")))
    rows = rows.withColumn("__first", F.min("place").over(Window.partitionBy("viewer", "target")))
    rows = rows.withColumn("loaded", F.dense_rank().over(Window.partitionBy("viewer").orderBy("__first")) <= HISTORY_TARGETS)
    return rows.select("viewer", "target", "id", "place", "group", "card", (F.col("card") <= VISIBLE_CARDS).alias("shown"), "loaded")


def home_amounts(rows: DataFrame, rates: DataFrame, fee_percent: float) -> DataFrame:
    """rows (currency, low, high) with home_low, home_high and whether a rate was used; currencies without a rate have none."""
    r = rates.select("currency", F.col("rate").alias("__r"))
    out = rows.join(F.broadcast(r), "currency", "left")  # a row a currency
    digits = minor_digits(F.col("currency"))
    home = lambda c: F.when(F.col("currency") == "JPY", F.col(c)).otherwise(half_up(F.col(c) / F.pow(F.lit(10), digits) * F.col("__r") * (1 + fee_percent / 100)))
    return out.withColumns({"home_low": home("low"), "home_high": home("high"), "converted": (F.col("currency") != "JPY") & F.col("__r").isNotNull()}).drop("__r")


# ---- parsed settings -------------------------------------------------------------------------------------------------


def preferences(text: Column) -> Column:
    """struct<theme, fee, days>: each part falls back by itself where the text has none or a bad one; a fee is 0 to 10 with two places."""
    p = F.from_json(text, "theme string, fee double, days int")
    fee_ok = p["fee"].between(0, 10) & (F.abs(p["fee"] * 100 - F.round(p["fee"] * 100)) < 1e-9)
    return F.struct(F.when(p["theme"].isin("light", "dark"), p["theme"]).otherwise("auto").alias("theme"), F.when(fee_ok, p["fee"]).otherwise(0.0).alias("fee"), F.when(p["days"].isin(30, 90, 365), p["days"]).otherwise(90).alias("days"))


def cross_rates(text: Column, base: str, home: str) -> Column:
    """map<currency, home units of one> of a rate service's answer, home by its rate against the base; null where the answer is no success or of another base."""
    r = F.from_json(text, "result string, base_code string, time_last_update_unix bigint, rates map<string,double>")
    at_home = F.try_element_at(r["rates"], F.lit(home))
    usable = F.map_filter(r["rates"], lambda k, v: (v > 0) & (k != home))
    ok = (r["result"] == "success") & (r["base_code"] == base) & r["time_last_update_unix"].isNotNull() & (at_home > 0)
    return F.when(ok, F.transform_values(usable, lambda k, v: at_home / v))
