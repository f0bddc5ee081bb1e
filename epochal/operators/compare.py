"""Read-side comparison: which offers may be compared, in what order they are shown, which is cheapest."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Stock states by how they rank, and how long a review of selling conditions holds.
STOCK_TIER = {"in_stock": 0, "low_stock": 0, "restocking": 1, "preparing": 1, "checking": 1, "unknown": 1, "not_displayed": 1, "out_of_stock": 2, "discontinued": 2}
UNLISTED_TIER = 3
REVIEW_DAYS = 90
HOME_CURRENCY = "JPY"


def stock_tier(state: Column, listed: Column) -> Column:
    table = F.create_map(*[F.lit(x) for kv in STOCK_TIER.items() for x in kv])
    return F.when(~listed, UNLISTED_TIER).otherwise(F.coalesce(F.try_element_at(table, state), F.lit(UNLISTED_TIER)))


def eligibility(rules: list[tuple[Column, str]]) -> Column:
    """The reason of the first rule that fails, or null: a comparison is allowed only where every rule is known to hold."""
    out = None
    for ok, reason in rules:
        fails = ~F.coalesce(ok, F.lit(False))
        out = F.when(fails, F.lit(reason)) if out is None else out.when(fails, F.lit(reason))
    return out


def comparison_rules(review_days: int = REVIEW_DAYS) -> list[tuple[Column, str]]:
    """The rules in order, over columns of a relation joined with both quotes (prefix own_ and other_)."""
    c = F.col
    return [
        (c("kind") == "same_product", "not the same product"), (c("status") == "verified", "not verified"), (c("loaded"), "not loaded"), (c("own_matches") & c("other_matches"), "product changed"),
        (c("policy"), "conditions not reviewed"), ((c("own_offers") == 1) & (c("other_offers") == 1), "several offers"), (c("own_listed") & c("other_listed"), "not listed"),
        (c("own_offer_reviewed") & c("other_offer_reviewed"), "another offer"), ((c("own_currency") == c("other_currency")) & c("same_basis"), "another basis"),
        (c("newest_at") <= c("verified_at") + review_days * 86_400_000, "review expired"), (~c("stale"), "stale"),
    ]


def price_order(home: str = HOME_CURRENCY) -> list[Column]:
    """Sort keys: home currency, others, none; stock tier; price, unknown last; newest first."""
    group = F.when(F.col("currency") == home, 0).when(F.col("currency").isNotNull(), 1).otherwise(2)
    return [group, F.col("tier"), F.col("amount").asc_nulls_last(), F.col("observed_at").desc()]


def ranked_offers(rows: DataFrame, key: list[str], tie: list[str], home: str = HOME_CURRENCY) -> DataFrame:
    """Rows with their place in the order in which a product's offers are shown."""
    return rows.withColumn("place", F.row_number().over(Window.partitionBy(*key).orderBy(*price_order(home), *tie)))


def cheapest(rows: DataFrame, key: list[str], difference: str = "difference") -> DataFrame:
    """Rows that are cheapest of the eligible ones in stock, ties kept, where they are no dearer than the viewed offer."""
    able = rows.where(F.col("reason").isNull() & F.col(difference).isNotNull() & (F.col("tier") == 0))
    able = able.withColumn("__r", F.rank().over(Window.partitionBy(*key).orderBy(difference)))
    return able.where((F.col("__r") == 1) & (F.col(difference) <= 0)).drop("__r")


def other_side(relations: DataFrame, source: str, left: str = "a", right: str = "b") -> DataFrame:
    """Relations seen from both of their ends: (source, target)."""
    ends = F.explode(F.array(F.struct(F.col(left).alias("s"), F.col(right).alias("t")), F.struct(F.col(right).alias("s"), F.col(left).alias("t"))))
    return relations.withColumn("__e", ends).withColumns({source: F.col("__e.s"), "target": F.col("__e.t")}).drop("__e")


def current_offer(offers: DataFrame, key: list[str]) -> DataFrame:
    """An offer a product: the first present one, else the most recently present, then the least id."""
    w = Window.partitionBy(*key).orderBy(F.col("present").desc(), F.when(~F.col("present"), -F.col("last_present")), "offer")
    return offers.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n")
