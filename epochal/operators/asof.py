"""As-of reads: the state in effect at a time, of one series, beside another, or at many targets. Built on one sort by key, never on an inequality join."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def state_at(points: DataFrame, key: list[str], t: str, state: list[str], at: Column) -> DataFrame:
    """(key, t, state) of the last point at or before `at`; keys without one are left out."""
    found = points.where(F.col(t) <= at).groupBy(*key).agg(F.max_by(F.struct(t, *state), F.struct(t, *state)).alias("__s"))
    return found.select(*key, "__s.*")


def asof(left: DataFrame, right: DataFrame, key: list[str], t: str, state: list[str]) -> DataFrame:
    """Rows of left with the `state` columns of the last row of right at or before their time (null without one).

    Both sides are sorted together by key and time, right before left on equal times, and the last state is carried forward: one shuffle, linear work, and no
    more rows than both sides have. Ties within right are settled by the state columns.
    """
    names = left.columns
    s = F.struct(*state)
    l_ = left.select(*key, F.col(t).alias("__t"), F.lit(1).alias("__side"), F.lit(None).cast(right.select(s).schema[0].dataType).alias("__s"), F.struct(*names).alias("__row"))
    r_ = right.select(*key, F.col(t).alias("__t"), F.lit(0).alias("__side"), s.alias("__s"), F.lit(None).cast(left.select(F.struct(*names)).schema[0].dataType).alias("__row"))
    w = Window.partitionBy(*key).orderBy("__t", "__side", "__s").rowsBetween(Window.unboundedPreceding, 0)
    both = l_.unionByName(r_).withColumn("__s", F.last("__s", ignorenulls=True).over(w)).where("__side = 1")
    return both.select("__row.*", *[F.col(f"__s.{c}").alias(c) for c in state])


def nearest(left: DataFrame, right: DataFrame, key: list[str], t: str, state: list[str], tolerance: int) -> DataFrame:
    """Rows of left with the nearest row of right within `tolerance` of their time, the earlier one of two equally near, and its distance."""
    names = left.columns
    s = F.struct(F.col(t).alias("at"), *state)
    l_ = left.select(*key, F.col(t).alias("__t"), F.lit(1).alias("__side"), F.lit(None).cast(right.select(s).schema[0].dataType).alias("__s"), F.struct(*names).alias("__row"))
    r_ = right.select(*key, F.col(t).alias("__t"), F.lit(0).alias("__side"), s.alias("__s"), F.lit(None).cast(left.select(F.struct(*names)).schema[0].dataType).alias("__row"))
    w = Window.partitionBy(*key).orderBy("__t", "__side", "__s")
    both = l_.unionByName(r_)
    both = both.withColumn("__b", F.last("__s", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    both = both.withColumn("__a", F.first("__s", ignorenulls=True).over(w.rowsBetween(0, Window.unboundedFollowing))).where("__side = 1")
    before, after = F.col("__t") - F.col("__b.at"), F.col("__a.at") - F.col("__t")
    pick = F.when(before.isNotNull() & (before <= tolerance) & (after.isNull() | (before <= after)), F.col("__b")).when(after <= tolerance, F.col("__a"))
    both = both.withColumn("__n", pick)
    return both.select("__row.*", *[F.col(f"__n.{c}").alias(c) for c in state], F.abs(F.col("__n.at") - F.col("__t")).alias("distance"))


def first_after(rows: DataFrame, key: list[str], t: str, hit: Column, within: int, name: str) -> DataFrame:
    """Rows with the time of the first hit of their key strictly after them, at most `within` later: a minimum over a range of times."""
    w = Window.partitionBy(*key).orderBy(t).rangeBetween(1, within)
    return rows.withColumn(name, F.min(F.when(hit, F.col(t))).over(w))
