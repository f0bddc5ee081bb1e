"""Statistics of series: segments, estimated sales, rollups, tails."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.money import price_change
from . import asof
from .changepoints import change_points


# Points of a series that a reader gets at most.
TAIL = 730


def segment_stats(obs: DataFrame, key: list[str], t: str, value: str, tie: list[str] = ()) -> DataFrame:
    """(key, current, previous, difference, percent, direction, low, high, first_t, last_t, n_points) of a series of exact amounts; null amounts are unavailable
    prices: they are points, but no amounts."""
    points = change_points(obs, key, t, [value], tie)
    w = Window.partitionBy(*key).orderBy(t, *tie)
    points = points.select(*key, F.col(t).alias("__t"), value, F.lag(value).over(w).alias("__previous"))
    out = points.groupBy(*key).agg(
        F.max_by(value, "__t").alias("current"), F.max_by("__previous", "__t").alias("previous"), F.min(value).alias("low"), F.max(value).alias("high"),
        F.min("__t").alias("first_t"), F.max("__t").alias("last_t"), F.count("*").alias("n_points"),
    )
    return out.withColumn("__c", price_change(F.col("previous"), F.col("current"))).select("*", "__c.*").drop("__c")


def read_counts(counts: DataFrame, availability: DataFrame, key: list[str], t: str) -> DataFrame:
    """Counts with a null read as 0 while the availability in effect is out of stock."""
    rows = asof.asof(counts, availability, key, t, ["availability"])
    return rows.withColumn("quantity", F.when(F.col("quantity").isNull() & (F.col("availability") == "out_of_stock"), F.lit(0).cast("long")).otherwise(F.col("quantity")))


def estimated_sales(counts: DataFrame, key: list[str], t: str, start: Column, end: Column, cap: int | None = None, tie: list[str] = ()) -> DataFrame:
    """(key, sold, decreases, added, increases, at_least, since): falls of the count within the window are sales, rises are additions.

    A step counts if it ends from `start` to `end` and both its counts are known; at_least is set where a fall starts at the shop's cap. Keys without a
    known count by `end` are left out; since is the window's start or the first known count, whichever is later.
    """
    w = Window.partitionBy(*key).orderBy(t, *tie)
    rows = counts.withColumn("__before", F.lag("quantity").over(w)).where(F.col(t) <= end)
    step = F.when(F.col(t) >= start, F.col("quantity") - F.col("__before"))
    fall, rise = F.when(step < 0, -step), F.when(step > 0, step)
    capped = F.max((fall.isNotNull() & (F.col("__before") >= cap)).cast("int")) if cap is not None else F.lit(0)
    zero = lambda c: F.coalesce(c, F.lit(0).cast("long"))
    out = rows.groupBy(*key).agg(
        zero(F.sum(fall)).alias("sold"), F.count(fall).alias("decreases"), zero(F.sum(rise)).alias("added"), F.count(rise).alias("increases"), capped.alias("at_least"),
        F.min(F.when(F.col("quantity").isNotNull(), F.col(t))).alias("__first"),
    )
    return out.where("__first is not null").withColumn("since", F.greatest("__first", start)).drop("__first")


def daily_rollup(samples: DataFrame, key: list[str], t: str, day: Column, value: str, tie: list[str] = ()) -> DataFrame:
    """(key, day, low, high, last, n) of samples a day."""
    return samples.withColumn("day", day).groupBy(*key, "day").agg(F.min(value).alias("low"), F.max(value).alias("high"), F.max_by(value, F.struct(t, *tie)).alias("last"), F.count("*").alias("n"))


def to_compact(samples: DataFrame, key: list[str], t: str, cutoff: Column, tie: list[str] = ()) -> DataFrame:
    """Samples before the cutoff but for each key's last one, which still says what is in effect at it."""
    old = samples.where(F.col(t) < cutoff)
    w = Window.partitionBy(*key).orderBy(F.col(t).desc(), *[F.col(c).desc() for c in tie])
    return old.withColumn("__n", F.row_number().over(w)).where("__n > 1").drop("__n")


def tail(points: DataFrame, key: list[str], t: str, n: int, tie: list[str] = ()) -> DataFrame:
    """The last n points of each key, with how many there are."""
    w = Window.partitionBy(*key)
    order = w.orderBy(F.col(t).desc(), *[F.col(c).desc() for c in tie])
    return points.withColumn("total", F.count("*").over(w)).withColumn("__n", F.row_number().over(order)).where(F.col("__n") <= n).drop("__n")


def steps(points: DataFrame, key: list[str], t: str, value: str, start: Column, end: Column, tie: list[str] = ()) -> DataFrame:
    """(key, from_t, to_t, value): a value holds to the next point; a null breaks the line; clipped to the window."""
    w = Window.partitionBy(*key).orderBy(t, *tie)
    rows = points.withColumn("to_t", F.least(F.coalesce(F.lead(t).over(w), end), end)).withColumn("from_t", F.greatest(F.col(t), start))
    return rows.where(F.col(value).isNotNull() & (F.col("from_t") < F.col("to_t"))).select(*key, "from_t", "to_t", value)
