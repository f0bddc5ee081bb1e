"""Interval algebra on change points: spans, intersections, islands and statistics over windows. Intervals are closed and in milliseconds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def spans(points: DataFrame, key: list[str], t: str, end: Column) -> DataFrame:
    """Points with `start` and `stop`: a state holds to the millisecond before the next point, the last one to `end`; spans without length are left out."""
    w = Window.partitionBy(*key).orderBy(t)
    out = points.withColumn("start", F.col(t)).withColumn("stop", F.coalesce(F.lead(t).over(w) - 1, end))
    return out.where("start <= stop")


def listed_spans(prices: DataFrame, presence: DataFrame, key: list[str], t: str, state: list[str], end: Column) -> DataFrame:
    """(key, start, stop, state): prices while listed.

    Boundaries of both series are sorted together, presence first on equal times; the last price and the last presence are carried forward, and the last row of
    each time says what holds to the next one.
    """
    s = F.struct(*state)
    kind = prices.select(s).schema[0].dataType
    p = prices.select(*key, F.col(t).alias("start"), F.lit(1).alias("__o"), s.alias("__s"), F.lit(None).cast("boolean").alias("__p"))
    q = presence.select(*key, F.col(t).alias("start"), F.lit(0).alias("__o"), F.lit(None).cast(kind).alias("__s"), F.col("present").alias("__p"))
    w = Window.partitionBy(*key).orderBy("start", "__o", "__s")
    run = w.rowsBetween(Window.unboundedPreceding, 0)
    rows = p.unionByName(q).withColumn("__s", F.last("__s", ignorenulls=True).over(run)).withColumn("__p", F.last("__p", ignorenulls=True).over(run))
    rows = rows.withColumn("__next", F.lead("start").over(w)).withColumn("stop", F.coalesce(F.col("__next") - 1, end))
    return rows.where(F.col("__p") & F.col("__s").isNotNull() & (F.col("start") <= F.col("stop"))).select(*key, "start", "stop", "__s.*")


def islands(rows: DataFrame, key: list[str], state: list[str]) -> DataFrame:
    """Touching spans of one state merged into one."""
    w = Window.partitionBy(*key).orderBy("start")
    new = F.lag("stop").over(w).isNull() | (F.lag("stop").over(w) + 1 < F.col("start")) | ~F.lag(F.struct(*state)).over(w).eqNullSafe(F.struct(*state))
    rows = rows.withColumn("__i", F.sum(new.cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return rows.groupBy(*key, "__i", *state).agg(F.min("start").alias("start"), F.max("stop").alias("stop")).drop("__i")


def window_stats(rows: DataFrame, key: list[str], low: str, high: str, end: Column, windows: dict[str, int]) -> DataFrame:
    """(key, min_<w>, max_<w>): least and greatest of spans that overlap [end - length, end], all windows in one pass; null for an empty one."""
    aggs = []
    for name, length in windows.items():
        inside = (F.col("stop") >= end - length) & (F.col("start") <= end)
        aggs += [F.min(F.when(inside, F.col(low))).alias(f"min_{name}"), F.max(F.when(inside, F.col(high))).alias(f"max_{name}")]
    return rows.groupBy(*key).agg(*aggs)


def clipped(rows: DataFrame, start: Column, end: Column) -> DataFrame:
    """Spans cut to [start, end]; those outside are left out."""
    return rows.withColumn("start", F.greatest("start", start)).withColumn("stop", F.least("stop", end)).where("start <= stop")


def gaps(rows: DataFrame, key: list[str]) -> DataFrame:
    """(key, start, stop) of what lies between the spans of a key, which do not overlap."""
    w = Window.partitionBy(*key).orderBy("start")
    return rows.select(*key, (F.lag("stop").over(w) + 1).alias("__from"), (F.col("start") - 1).alias("stop")).select(*key, F.col("__from").alias("start"), "stop").where("start <= stop")
