"""Change-point series: observations in, the times at which a state was first seen out. A state holds until the next point."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def change_points(obs: DataFrame, key: list[str], t: str, state: list[str], tie: list[str] = ()) -> DataFrame:
    """Observations whose state differs from the one before, null-safe; the order of rows doesn't matter, repeated observations add nothing.

    One shuffle by key and a sort; `tie` orders rows of one time.
    """
    w = Window.partitionBy(*key).orderBy(t, *tie)
    now = F.struct(*state)
    before = F.lag(now).over(w)
    return obs.withColumn("__before", before).where(F.col("__before").isNull() | ~F.col("__before").eqNullSafe(now)).drop("__before")


def merge_observations(*batches: DataFrame, key: list[str]) -> DataFrame:
    """All observations once, in whatever order and however often batches bring them: importing is this, then change_points."""
    out = batches[0]
    for b in batches[1:]:
        out = out.unionByName(b)
    return out.dropDuplicates(key)


def conflicts(obs: DataFrame, key: list[str], t: str, state: list[str]) -> DataFrame:
    """(key, t, n) of times with more than one state: an import must stop at these."""
    return obs.groupBy(*key, t).agg(F.count_distinct(F.struct(*state)).alias("n_states")).where("n_states > 1")


def presence_points(seen: DataFrame, key: list[str], run: str, last_run: Column | int) -> DataFrame:
    """(key, run, present): presence by dense run numbers, from the runs an entity was seen in.

    Present where it appears after a gap (or first), absent in the run after its last sighting before a gap. Gaps are differences of run numbers, so the grid of
    entities by runs is never made; there is no point before the first sighting.
    """
    w = Window.partitionBy(*key).orderBy(run)
    rows = seen.select(*key, run).distinct().select(*key, run, F.lag(run).over(w).alias("__prev"), F.lead(run).over(w).alias("__next"))
    starts = F.when(F.col("__prev").isNull() | (F.col("__prev") + 1 < F.col(run)), F.struct(F.col(run).alias("run"), F.lit(True).alias("present")))
    ends = F.when(F.coalesce(F.col("__next"), F.lit(last_run) + 1) > F.col(run) + 1, F.struct((F.col(run) + 1).alias("run"), F.lit(False).alias("present")))
    ends = F.when(F.col(run) < F.lit(last_run), ends)
    points = F.explode(F.array_compact(F.array(starts, ends)))
    return rows.select(*key, points.alias("__p")).select(*key, F.col("__p.run").alias(run), F.col("__p.present").alias("present"))


def drop_leading_absent(points: DataFrame, key: list[str], t: str, present: str = "present", tie: list[str] = ()) -> DataFrame:
    """Presence points from the first sighting on."""
    w = Window.partitionBy(*key).orderBy(t, *tie).rowsBetween(Window.unboundedPreceding, 0)
    return points.withColumn("__seen", F.max(present).over(w)).where("__seen").drop("__seen")


def present_runs(points: DataFrame, key: list[str], run: str, last_run: Column | int) -> DataFrame:
    """(key, run) of every run in which an entity was present: spans between points, expanded by run number."""
    w = Window.partitionBy(*key).orderBy(run)
    spans = points.select(*key, run, "present", F.coalesce(F.lead(run).over(w) - 1, F.lit(last_run)).alias("__to")).where("present")
    return spans.select(*key, F.explode(F.sequence(F.col(run), F.col("__to"))).alias(run))


def current_state(obs: DataFrame, key: list[str], t: str, value: str, tie: list[str] = ()) -> DataFrame:
    """(key, value, since, previous, n_points, first_t): the value in effect, since when, and the distinct value before it."""
    points = change_points(obs, key, t, [value], tie)
    w = Window.partitionBy(*key).orderBy(t, *tie)
    points = points.select(*key, F.col(t).alias("__t"), value, F.lag(value).over(w).alias("__previous"))
    last = lambda c: F.max_by(c, "__t")
    return points.groupBy(*key).agg(last(value).alias("value"), F.max("__t").alias("since"), last("__previous").alias("previous"), F.count("*").alias("n_points"), F.min("__t").alias("first_t"))


def broken_order(rows: DataFrame, key: list[str], t: str) -> DataFrame:
    """(key, n_broken): rows whose position doesn't rise strictly over the one before in arrival order `t`; none means a valid series."""
    w = Window.partitionBy(*key).orderBy(t)
    return rows.withColumn("__bad", (F.lag(t).over(w) >= F.col(t)).cast("long")).groupBy(*key).agg(F.coalesce(F.sum("__bad"), F.lit(0)).alias("n_broken"), F.count("*").alias("n_rows"))


def unchanged_neighbours(points: DataFrame, key: list[str], t: str, state: list[str]) -> DataFrame:
    """Points equal to the one before: none in a valid change-point series."""
    w = Window.partitionBy(*key).orderBy(t)
    return points.withColumn("__same", F.lag(F.struct(*state)).over(w).eqNullSafe(F.struct(*state))).where("__same").drop("__same")
