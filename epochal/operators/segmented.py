"""Series of entities with more observations than a task can sort: their time is cut into parts, each a task's work, and what holds at a part's edge is carried over it.

A part needs one row of its neighbour: the last before it, or the first after it. These rows are found by a combined maximum, carried past parts without any by a
window over the parts, and added to the part's own rows as its edge; then the plain operators do the rest with the part as one more column of the key.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import changepoints, intervals
from .graph import cut as kept

#: Rows of an entity that one task sorts; an entity with more is cut. Entities that are cut (as many as the rows divided by this, at most) that may be broadcast.
MOST_ROWS, BROADCAST_KEYS = 1_000_000, 100_000
PART, EDGE = "__part", "__edge"


def cut(rows: DataFrame, key: list[str], t: str, most: int = MOST_ROWS) -> DataFrame:
    """rows with PART: 0, or for an entity of more than `most` rows the part of its time, about `most` / 2 rows each. Rows of one time stay together.

    A row finds its part by halving, so that many parts cost a row little. Sizes are counts that combine before the shuffle; the cuts of an entity are approximate quantiles of its times, and only entities that are cut have any.
    """
    big = kept(rows.groupBy(*key).agg(F.count("*").alias("__n")).where(F.col("__n") > most).select(*key, F.ceil(F.col("__n") * 2 / most).cast("int").alias("__k")))
    found, parts = big.agg(F.count("*"), F.max("__k")).first()
    if not found:
        return rows.withColumn(PART, F.lit(0))
    hint = F.broadcast if found <= BROADCAST_KEYS else lambda df: df
    share = F.split(F.lit(",".join(str(i / parts) for i in range(1, parts))), ",").cast("array<double>")
    cuts = rows.join(hint(big.select(*key)), key).groupBy(*key).agg(F.percentile_approx(t, share, 20 * parts).alias("__cuts"))
    cuts = kept(cuts.select(*key, F.array_sort(F.array_distinct("__cuts")).alias("__cuts")))
    rows = rows.join(hint(cuts), key, "left").withColumn(PART, F.lit(0))
    for i in range(parts.bit_length() - 1, -1, -1):  # how many cuts are at or before t, by halving: plain columns, so that the array is never copied beside a row
        beyond = F.get("__cuts", F.col(PART) + (2**i - 1)) <= F.col(t)
        rows = rows.withColumn(PART, F.when(beyond, F.col(PART) + 2**i).otherwise(F.col(PART)))
    return rows.drop("__cuts")


def edged(rows: DataFrame, key: list[str], order: list[str], carried: list[str], ahead: bool = False, what: Column | None = None) -> DataFrame:
    """rows with EDGE 0, and a row for each part with EDGE -1 (1 if `ahead`): the columns in `carried` of the last row before it (the first after it), others null.

    With `what`, only rows where that holds are carried.
    """
    value, place = F.struct(*carried), F.struct(*order)
    pick = (F.min_by if ahead else F.max_by)(F.when(what, value) if what is not None else value, F.when(what, place) if what is not None else place)
    parts = rows.groupBy(*key, PART).agg(pick.alias("__v"))
    w = Window.partitionBy(*key).orderBy(F.col(PART).desc() if ahead else F.col(PART)).rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select(*key, PART, F.last("__v", ignorenulls=True).over(w).alias("__v")).where("__v is not null")
    others = [F.lit(None).cast(f.dataType).alias(f.name) for f in rows.schema.fields if f.name not in (*key, PART, *carried)]
    edges = parts.select(*key, PART, *[F.col(f"__v.{c}").alias(c) for c in carried], *others, F.lit(1 if ahead else -1).alias(EDGE))
    return rows.withColumn(EDGE, F.lit(0)).unionByName(edges)


def change_points(obs: DataFrame, key: list[str], t: str, state: list[str], tie: list[str] = (), most: int = MOST_ROWS) -> DataFrame:
    """As changepoints.change_points, whatever the size of an entity."""
    rows = edged(cut(obs, key, t, most), key, [t, *tie], state)
    return changepoints.change_points(rows, [*key, PART], EDGE, state, [t, *tie]).where(f"{EDGE} = 0").drop(PART, EDGE)


def spans(points: DataFrame, key: list[str], t: str, end: Column, most: int = MOST_ROWS) -> DataFrame:
    """As intervals.spans, whatever the size of an entity."""
    rows = edged(cut(points, key, t, most), key, [t], [t], ahead=True)
    w = Window.partitionBy(*key, PART).orderBy(EDGE, t)
    rows = rows.withColumn("start", F.col(t)).withColumn("stop", F.coalesce(F.lead(t).over(w) - 1, end))
    return rows.where(f"{EDGE} = 0 and start <= stop").drop(PART, EDGE)


def asof(left: DataFrame, right: DataFrame, key: list[str], t: str, state: list[str], most: int = MOST_ROWS) -> DataFrame:
    """As asof.asof: rows of left with the state columns of the last row of right at or before their time, whatever the size of an entity."""
    names = left.columns
    l_ = left.select(*key, F.col(t).alias("__t"), F.lit(1).alias("__side"), F.lit(None).cast(right.select(F.struct(*state)).schema[0].dataType).alias("__s"), F.struct(*names).alias("__row"))
    r_ = right.select(*key, F.col(t).alias("__t"), F.lit(0).alias("__side"), F.struct(*state).alias("__s"), F.lit(None).cast(left.select(F.struct(*names)).schema[0].dataType).alias("__row"))
    rows = edged(cut(l_.unionByName(r_), key, "__t", most), key, ["__t", "__side", "__s"], ["__s"], what=F.col("__s").isNotNull())
    w = Window.partitionBy(*key, PART).orderBy(EDGE, "__t", "__side", "__s").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("__s", F.last("__s", ignorenulls=True).over(w)).where(f"__side = 1 and {EDGE} = 0")
    return rows.select("__row.*", *[F.col(f"__s.{c}").alias(c) for c in state])


def listed_spans(prices: DataFrame, presence: DataFrame, key: list[str], t: str, state: list[str], end: Column, most: int = MOST_ROWS) -> DataFrame:
    """As intervals.listed_spans, whatever the size of an entity: the last price and the last presence are carried in, the next boundary is carried back."""
    kind = prices.select(F.struct(*state)).schema[0].dataType
    p = prices.select(*key, F.col(t).alias("start"), F.lit(1).alias("__o"), F.struct(*state).alias("__s"), F.lit(None).cast("boolean").alias("__p"))
    q = presence.select(*key, F.col(t).alias("start"), F.lit(0).alias("__o"), F.lit(None).cast(kind).alias("__s"), F.col("present").alias("__p"))
    rows = cut(p.unionByName(q), key, "start", most)
    order = ["start", "__o", "__s"]
    priced, listed, after = F.col("__s").isNotNull(), F.col("__p").isNotNull(), edged(rows, key, order, ["start"], ahead=True).where(f"{EDGE} = 1")
    before = [edged(rows, key, order, ["__s"], what=priced).where(f"{EDGE} = -1"), edged(rows, key, order, ["__p"], what=listed).where(f"{EDGE} = -1")]
    rows = rows.withColumn(EDGE, F.lit(0))
    for edge in (*before, after):
        rows = rows.unionByName(edge)
    w = Window.partitionBy(*key, PART).orderBy(EDGE, *order)
    run = w.rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumns({"__s": F.last("__s", ignorenulls=True).over(run), "__p": F.last("__p", ignorenulls=True).over(run), "__next": F.lead("start").over(w)})
    rows = rows.withColumn("stop", F.coalesce(F.col("__next") - 1, end)).where(f"{EDGE} = 0")
    return rows.where(F.col("__p") & F.col("__s").isNotNull() & (F.col("start") <= F.col("stop"))).select(*key, "start", "stop", "__s.*")


def islands(rows: DataFrame, key: list[str], state: list[str], most: int = MOST_ROWS) -> DataFrame:
    """As intervals.islands: touching spans of one state merged, also across parts. Islands of a part are merged first; those that touch an edge are few, and are
    merged by the plain operator, whose rows are the islands of parts and no longer the spans."""
    within = intervals.islands(cut(rows, key, "start", most), [*key, PART], state).drop(PART)
    return intervals.islands(within, key, state)
