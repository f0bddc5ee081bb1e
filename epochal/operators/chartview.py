"""What a product's charts draw: segments of price, listing and stock on common borders, made in one sweep; steps of counts within a window."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.tables import by_size


def segments(series: dict[str, tuple[DataFrame, str]], key: list[str], t: str, end: Column, whole: DataFrame | None = None) -> DataFrame:
    """(key, start, stop, one column a series): what each series says between two borders, from the first border of any to `end`.

    series names change points and the column that they change; all are dealt and sorted by key once. At a border every series that has a point there has changed;
    `stop` is the millisecond before the next border. Segments without length are left out; neighbours may be alike where a series repeats itself. `whole` is the table
    that the series come from: tasks are as many as it needs.
    """
    rows = None
    for name, (points, column) in series.items():
        mine = [F.struct(F.col(column).alias("v")).alias(n) if n == name else F.lit(None).cast(f"struct<v:{p.schema[c].dataType.simpleString()}>").alias(n) for n, (p, c) in series.items()]
        own = points.select(*key, F.col(t).alias("start"), *mine)
        rows = own if rows is None else rows.unionByName(own)
    rows = rows if whole is None else by_size(rows, whole, *key)
    rows = rows.groupBy(*key, "start").agg(*[F.max(n).alias(n) for n in series])  # one row a border: the same key, so it sorts once
    w = Window.partitionBy(*key).orderBy("start")
    before = w.rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumns({**{n: F.last(n, ignorenulls=True).over(before)["v"] for n in series}, "stop": F.coalesce(F.lead("start").over(w) - 1, end)})
    return rows.where("start <= stop").select(*key, "start", "stop", *series)


def sold(rows: DataFrame, key: list[str], count: str, listed: str) -> DataFrame:
    """rows with `sold`: by how much the count of the segment before exceeds this one's, where both are known and the product was listed; a rise sells nothing."""
    w = Window.partitionBy(*key).orderBy("start")
    fall = F.lag(count).over(w) - F.col(count)
    return rows.withColumn("sold", F.when(F.coalesce(F.lag(listed).over(w) & F.col(listed), F.lit(False)) & (fall > 0), fall).otherwise(0))


def stock_steps(points: DataFrame, windows: DataFrame, key: list[str], t: str, count: str) -> DataFrame:
    """(key, from, to, count): a count holds from its point (or the window's start) to the next point or the window's end; a null count breaks the line. windows
    has (key, start, end)."""
    w = Window.partitionBy(*key).orderBy(t)
    rows = points.withColumn("__next", F.lead(t).over(w)).join(windows, key)
    rows = rows.select(*key, F.greatest(t, "start").alias("from"), F.least(F.coalesce("__next", "end"), "end").alias("to"), F.col(count).alias("count"), F.col(t).alias("__t"), "end")
    return rows.where("count is not null and to >= from and __t <= end").drop("__t", "end")


def present_at_end(points: Column) -> Column:
    """Whether the last of an array of presence points says present."""
    return F.coalesce(F.try_element_at(points, F.lit(-1))["present"], F.lit(False))


def shows_quantities(meaning: Column, counts: Column) -> Column:
    """Whether a shop shows counts at all, and any was read."""
    return (meaning != "not_exposed") & F.exists(counts, lambda n: n.isNotNull())
