"""Registered queries on series: an entity is a user of `events`, or a part of `lineitem` whose price is observed on shipping dates."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.money import price_change
from ..functions.times import DAY_MS, utc_day
from ..operators import asof, changepoints, intervals, segmented, series
from ..sources.tables import EVENTS_SQL, PRICES_SQL, by_size, daily_prices, event_stream, price_stream, table
from .registry import query

#: 2024-01-16T00:00:00Z, within the events; 2000-01-01 and the end of the price observations.
MID_MS, PRICE_MID_MS, PRICE_END_MS = 1_705_363_200_000, 946_684_800_000, 1_009_756_800_000
LAST_RUN = 2001 * 12 + 12
#: Rows of an entity above which the queries on hot entities cut its time.
HOT_ROWS = 500

_POINTS = """p AS (SELECT * FROM (SELECT *, lag(event_type) OVER w AS before, row_number() OVER w AS n FROM e WINDOW w AS (PARTITION BY user_id ORDER BY t, event_id)) WHERE n = 1 OR before IS DISTINCT FROM event_type)"""
_CENTS = """p AS (SELECT * FROM (SELECT *, lag(cents) OVER w AS before, row_number() OVER w AS n FROM e WINDOW w AS (PARTITION BY user_id ORDER BY t, event_id)) WHERE n = 1 OR before IS DISTINCT FROM cents)"""
_DAILY = """q AS (SELECT part, t, cents FROM (SELECT *, lag(cents) OVER w AS before, row_number() OVER w AS n FROM d WINDOW w AS (PARTITION BY part ORDER BY t)) WHERE n = 1 OR before IS DISTINCT FROM cents)"""
_PRESENCE = f"""s AS (SELECT DISTINCT part, run FROM x),
g AS (SELECT *, lag(run) OVER w AS prev, lead(run) OVER w AS next FROM s WINDOW w AS (PARTITION BY part ORDER BY run)),
r AS (SELECT part, run, true AS present FROM g WHERE prev IS NULL OR prev + 1 < run UNION ALL SELECT part, run + 1, false FROM g WHERE coalesce(next, {LAST_RUN} + 1) > run + 1 AND run < {LAST_RUN})"""
_CHANGE = """a - b AS difference, CASE WHEN b <> 0 THEN floor(100.0::DOUBLE * (a - b) / b * 100 + 0.5) / 100 END AS percent, CASE WHEN a IS NULL OR b IS NULL THEN 'unknown' WHEN a > b THEN 'up' WHEN a < b THEN 'down' ELSE 'same' END AS direction"""


@query("current_state", f"""WITH {EVENTS_SQL}, {_CENTS}, l AS (SELECT *, lag(cents) OVER (PARTITION BY user_id ORDER BY t, event_id) AS previous FROM p),
m AS (SELECT user_id, arg_max(cents, t) AS a, max(t) AS since, arg_max_null(previous, t) AS b, count(*) AS n_points, min(t) AS first_t FROM l GROUP BY user_id)
SELECT user_id, a AS value, since, b AS previous, n_points, first_t, {_CHANGE} FROM m""")
def current_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = changepoints.current_state(event_stream(spark, sf_dir).withColumnRenamed("cents", "v"), ["user_id"], "t", "v", ["event_id"])
    return out.withColumn("__c", price_change(F.col("previous"), F.col("value"))).select("*", "__c.*").drop("__c")


@query("change_points", f"WITH {EVENTS_SQL}, {_POINTS} SELECT user_id, t, event_type, event_id FROM p")
def change_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    return changepoints.change_points(event_stream(spark, sf_dir), ["user_id"], "t", ["event_type"], ["event_id"]).select("user_id", "t", "event_type", "event_id")


@query("import_idempotent", f"WITH {EVENTS_SQL}, {_POINTS} SELECT user_id, t, event_type, event_id FROM p")
def import_idempotent(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Batches that overlap, in an order that is not that of time: the same series."""
    e = event_stream(spark, sf_dir)
    batches = [e.where("event_id % 3 = 2"), e.where("event_id % 3 <> 1"), e.where("event_id % 3 <> 2"), e.where("event_id % 2 = 0")]
    merged = changepoints.merge_observations(*batches, key=["event_id"])
    return changepoints.change_points(merged, ["user_id"], "t", ["event_type"], ["event_id"]).select("user_id", "t", "event_type", "event_id")


@query("observation_conflicts", f"WITH {PRICES_SQL} SELECT part, t, count(DISTINCT cents) AS n_states FROM x GROUP BY part, t HAVING count(DISTINCT cents) > 1")
def observation_conflicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return changepoints.conflicts(price_stream(spark, sf_dir), ["part"], "t", ["cents"])


@query("presence_series", f"WITH {PRICES_SQL}, {_PRESENCE} SELECT part, run, present FROM r")
def presence_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    return changepoints.presence_points(price_stream(spark, sf_dir), ["part"], "run", LAST_RUN)


@query("present_runs", f"WITH {PRICES_SQL} SELECT DISTINCT part, run FROM x")
def present_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return changepoints.present_runs(changepoints.presence_points(price_stream(spark, sf_dir), ["part"], "run", LAST_RUN), ["part"], "run", LAST_RUN)


@query("offer_presence", f"""WITH {PRICES_SQL}, o AS (SELECT DISTINCT part, offer, run FROM x), pr AS (SELECT part, run, dense_rank() OVER (PARTITION BY part ORDER BY run) AS k FROM (SELECT DISTINCT part, run FROM x)),
j AS (SELECT o.part, offer, k, (SELECT max(k) FROM pr p2 WHERE p2.part = o.part) AS last FROM o JOIN pr ON pr.part = o.part AND pr.run = o.run),
g AS (SELECT *, lag(k) OVER w AS prev, lead(k) OVER w AS next FROM j WINDOW w AS (PARTITION BY part, offer ORDER BY k))
SELECT part, offer, CAST(k AS INTEGER) AS k, true AS present FROM g WHERE prev IS NULL OR prev + 1 < k UNION ALL SELECT part, offer, CAST(k + 1 AS INTEGER), false FROM g WHERE coalesce(next, last + 1) > k + 1 AND k < last""")
def offer_presence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Presence of offers over the runs in which their product was present: run numbers are counted within the product."""
    from pyspark.sql import Window

    # one shuffle by part: its runs are numbered by a dense rank, and the last of them is known beside each row
    x = by_size(price_stream(spark, sf_dir).select("part", "offer", "run"), table(spark, sf_dir, "lineitem"), "part")
    seen = x.distinct().withColumn("k", F.dense_rank().over(Window.partitionBy("part").orderBy("run")))
    seen = seen.withColumn("last", F.max("k").over(Window.partitionBy("part")))
    w = Window.partitionBy("part", "offer").orderBy("k")
    rows = seen.select("part", "offer", "k", "last", F.lag("k").over(w).alias("before"), F.lead("k").over(w).alias("next"))
    start = F.when(F.col("before").isNull() | (F.col("before") + 1 < F.col("k")), F.struct("k", F.lit(True).alias("present")))
    end = F.when((F.coalesce("next", F.col("last") + 1) > F.col("k") + 1) & (F.col("k") < F.col("last")), F.struct((F.col("k") + 1).alias("k"), F.lit(False).alias("present")))
    return rows.select("part", "offer", F.explode(F.array_compact(F.array(start, end))).alias("p")).select("part", "offer", "p.*")


@query("series_invariants", """SELECT conv_id, count(*) FILTER (WHERE prev >= turn) AS n_broken, count(*) AS n_rows FROM (SELECT *, lag(turn) OVER (PARTITION BY conv_id ORDER BY turn) AS prev FROM conversations) GROUP BY conv_id""")
def series_invariants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return changepoints.broken_order(table(spark, sf_dir, "conversations"), ["conv_id"], "turn")


@query("state_asof", f"WITH {EVENTS_SQL} SELECT user_id, arg_max(event_type, (t, event_id)) AS event_type, max(t) AS t FROM e WHERE t <= {MID_MS} GROUP BY user_id")
def state_asof(spark: SparkSession, sf_dir: str) -> DataFrame:
    return asof.state_at(event_stream(spark, sf_dir), ["user_id"], "t", ["event_id", "event_type"], F.lit(MID_MS)).drop("event_id")


@query("asof_two_series", f"""WITH {EVENTS_SQL}, v AS (SELECT * FROM e WHERE event_type = 'purchase'), k AS (SELECT user_id, t, max(cents) AS cents FROM e WHERE event_type = 'view' GROUP BY user_id, t)
SELECT v.event_id, v.user_id, v.t, v.cents, k.cents AS seen FROM v ASOF LEFT JOIN k ON v.user_id = k.user_id AND v.t >= k.t""")
def asof_two_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = event_stream(spark, sf_dir)
    views = e.where("event_type = 'view'").select("user_id", "t", F.col("cents").alias("seen"))
    return asof.asof(e.where("event_type = 'purchase'").select("event_id", "user_id", "t", "cents"), views, ["user_id"], "t", ["seen"])


@query("nearest_point", f"""WITH {EVENTS_SQL}, v AS (SELECT * FROM e WHERE event_type = 'error'), k AS (SELECT user_id, t, min(event_id) AS near FROM e WHERE event_type = 'click' GROUP BY user_id, t),
j AS (SELECT v.event_id, v.user_id, v.t, k.near, abs(k.t - v.t) AS distance, row_number() OVER (PARTITION BY v.event_id ORDER BY abs(k.t - v.t), k.t) AS n FROM v JOIN k ON k.user_id = v.user_id AND abs(k.t - v.t) <= {2 * DAY_MS})
SELECT v.event_id, v.user_id, v.t, near, distance FROM v LEFT JOIN (SELECT * FROM j WHERE n = 1) j ON j.event_id = v.event_id""")
def nearest_point(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = event_stream(spark, sf_dir)
    clicks = e.where("event_type = 'click'").groupBy("user_id", "t").agg(F.min("event_id").alias("near"))
    return asof.nearest(e.where("event_type = 'error'").select("event_id", "user_id", "t"), clicks, ["user_id"], "t", ["near"], 2 * DAY_MS)


@query("price_intervals", f"""WITH {PRICES_SQL}, s AS (SELECT *, coalesce(lead(t) OVER w - 1, {PRICE_END_MS}) AS stop FROM d WINDOW w AS (PARTITION BY part ORDER BY t)),
n AS (SELECT *, CASE WHEN lag(cents) OVER w IS DISTINCT FROM cents OR lag(stop) OVER w + 1 < t THEN 1 ELSE 0 END AS fresh FROM s WINDOW w AS (PARTITION BY part ORDER BY t)),
i AS (SELECT *, sum(fresh) OVER (PARTITION BY part ORDER BY t) AS i FROM n)
SELECT part, cents, min(t) AS start, max(stop) AS stop FROM i GROUP BY part, cents, i""")
def price_intervals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return intervals.islands(intervals.spans(daily_prices(spark, sf_dir), ["part"], "t", F.lit(PRICE_END_MS)).select("part", "cents", "start", "stop"), ["part"], ["cents"])


_HOT = """h AS (SELECT CASE WHEN event_id % 2 = 0 THEN 0 ELSE user_id END AS entity, t, event_id, event_type FROM e)"""


def _hot_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events of which one entity has half."""
    return event_stream(spark, sf_dir).select(F.when(F.col("event_id") % 2 == 0, 0).otherwise(F.col("user_id")).alias("entity"), "t", "event_id", "event_type")


@query("hot_change_points", f"""WITH {EVENTS_SQL}, {_HOT}, p AS (SELECT *, lag(event_type) OVER w AS before, row_number() OVER w AS n FROM h WINDOW w AS (PARTITION BY entity ORDER BY t, event_id))
SELECT entity, t, event_id, event_type FROM p WHERE n = 1 OR before IS DISTINCT FROM event_type""")
def hot_change_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Change points where one entity is cut into parts of its time."""
    return segmented.change_points(_hot_events(spark, sf_dir), ["entity"], "t", ["event_type"], ["event_id"], HOT_ROWS).select("entity", "t", "event_id", "event_type")


@query("hot_asof", f"""WITH {EVENTS_SQL}, {_HOT}, c AS (SELECT entity, t, max(event_id) AS click FROM h WHERE event_type = 'click' GROUP BY ALL)
SELECT l.event_id, c.click FROM (SELECT * FROM h WHERE event_type = 'error') l ASOF LEFT JOIN c ON l.entity = c.entity AND l.t >= c.t""")
def hot_asof(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last click at or before each error, of entities one of which has half of all events."""
    e = _hot_events(spark, sf_dir)
    clicks = e.where("event_type = 'click'").groupBy("entity", "t").agg(F.max("event_id").alias("click"))
    return segmented.asof(e.where("event_type = 'error'").select("event_id", "entity", "t"), clicks, ["entity"], "t", ["click"], HOT_ROWS).select("event_id", "click")


@query("hot_price_intervals", f"""WITH {PRICES_SQL}, y AS (SELECT CASE WHEN part % 2 = 0 THEN 0 ELSE part END AS entity, t, min(cents) // 20000 AS band FROM d GROUP BY ALL),
s AS (SELECT *, coalesce(lead(t) OVER w - 1, {PRICE_END_MS}) AS stop FROM y WINDOW w AS (PARTITION BY entity ORDER BY t)),
n AS (SELECT *, CASE WHEN lag(band) OVER w IS DISTINCT FROM band OR lag(stop) OVER w + 1 < t THEN 1 ELSE 0 END AS fresh FROM s WHERE t <= stop WINDOW w AS (PARTITION BY entity ORDER BY t)),
i AS (SELECT *, sum(fresh) OVER (PARTITION BY entity ORDER BY t) AS i FROM n)
SELECT entity, band, min(t) AS start, max(stop) AS stop FROM i GROUP BY entity, band, i""")
def hot_price_intervals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How long prices stayed within a band, where one entity has half of the parts: spans end in the next part of its time, and islands reach across parts."""
    entity = F.when(F.col("part") % 2 == 0, 0).otherwise(F.col("part")).alias("entity")
    bands = daily_prices(spark, sf_dir).groupBy(entity, "t").agg(F.floor(F.min("cents") / 20000).alias("band"))
    spans = segmented.spans(bands, ["entity"], "t", F.lit(PRICE_END_MS), HOT_ROWS).select("entity", "band", "start", "stop")
    return segmented.islands(spans, ["entity"], ["band"], HOT_ROWS).select("entity", "band", "start", "stop")


def _month_ms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Presence points of parts, at the first millisecond of their runs."""
    seen = by_size(price_stream(spark, sf_dir).select("part", "run"), table(spark, sf_dir, "lineitem"), "part")
    points = changepoints.presence_points(seen, ["part"], "run", LAST_RUN)
    first = F.make_date(F.floor((F.col("run") - 1) / 12).cast("int"), ((F.col("run") - 1) % 12 + 1).cast("int"), F.lit(1))
    return points.select("part", (F.datediff(first, F.lit("1970-01-01").cast("date")).cast("long") * DAY_MS).alias("t"), "present")


_LISTED = f"""m AS (SELECT part, epoch_ms(make_timestamp((run - 1) // 12, (run - 1) % 12 + 1, 1, 0, 0, 0.0)) AS t, present FROM r),
b AS (SELECT part, t FROM q UNION SELECT part, t FROM m),
y AS (SELECT b.part, b.t, q.cents FROM b ASOF LEFT JOIN q ON b.part = q.part AND b.t >= q.t),
z AS (SELECT y.part, y.t AS start, coalesce(lead(y.t) OVER (PARTITION BY y.part ORDER BY y.t) - 1, {PRICE_END_MS}) AS stop, y.cents, m.present FROM y ASOF LEFT JOIN m ON y.part = m.part AND y.t >= m.t),
l AS (SELECT part, start, stop, cents FROM z WHERE present AND cents IS NOT NULL AND start <= stop)"""


@query("listed_prices", f"WITH {PRICES_SQL}, {_DAILY}, {_PRESENCE}, {_LISTED} SELECT part, start, stop, cents FROM l")
def listed_prices(spark: SparkSession, sf_dir: str) -> DataFrame:
    prices = changepoints.change_points(daily_prices(spark, sf_dir), ["part"], "t", ["cents"])
    return intervals.listed_spans(prices, _month_ms(spark, sf_dir), ["part"], "t", ["cents"], F.lit(PRICE_END_MS))


@query("window_stats_30_90_365", f"""WITH {PRICES_SQL}, {_DAILY}, {_PRESENCE}, {_LISTED}
SELECT part, {', '.join(f"{f}(cents) FILTER (WHERE stop >= {PRICE_MID_MS} - {n * DAY_MS} AND start <= {PRICE_MID_MS}) AS {f}_d{n}" for n in (30, 90, 365) for f in ("min", "max"))} FROM l GROUP BY part""")
def window_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return intervals.window_stats(listed_prices(spark, sf_dir), ["part"], "cents", "cents", F.lit(PRICE_MID_MS), {"d30": 30 * DAY_MS, "d90": 90 * DAY_MS, "d365": 365 * DAY_MS})


@query("segment_stats", f"""WITH {PRICES_SQL}, {_DAILY}, l AS (SELECT *, lag(cents) OVER (PARTITION BY part ORDER BY t) AS previous FROM q),
m AS (SELECT part, arg_max(cents, t) AS a, arg_max_null(previous, t) AS b, min(cents) AS low, max(cents) AS high, min(t) AS first_t, max(t) AS last_t, count(*) AS n_points FROM l GROUP BY part)
SELECT part, a AS current, b AS previous, low, high, first_t, last_t, n_points, {_CHANGE} FROM m""")
def segment_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return series.segment_stats(daily_prices(spark, sf_dir), ["part"], "t", "cents")


@query("daily_rollup", f"WITH {EVENTS_SQL} SELECT user_id, CAST(make_timestamp(t * 1000) AS DATE) AS day, min(cents) AS low, max(cents) AS high, arg_max(cents, (t, event_id)) AS last, count(*) AS n FROM e GROUP BY ALL")
def daily_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return series.daily_rollup(event_stream(spark, sf_dir), ["user_id"], "t", utc_day(F.col("t")), "cents", ["event_id"])


@query("retention_keep_last", f"""WITH {EVENTS_SQL}, o AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY t DESC, event_id DESC) AS n FROM e WHERE t < {MID_MS}) SELECT event_id, user_id, t, cents FROM o WHERE n > 1""")
def retention_keep_last(spark: SparkSession, sf_dir: str) -> DataFrame:
    return series.to_compact(event_stream(spark, sf_dir), ["user_id"], "t", F.lit(MID_MS), ["event_id"]).select("event_id", "user_id", "t", "cents")


_COUNTS = """c AS (SELECT event_id, user_id, t, CASE WHEN event_type IN ('view', 'click', 'purchase') THEN cents WHEN event_type = 'error' THEN NULL ELSE cents END AS raw,
  last_value(CASE WHEN event_type IN ('error', 'signup') THEN CASE WHEN cents % 2 = 0 THEN 'out_of_stock' ELSE 'in_stock' END END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY t, event_id) AS state FROM e),
k AS (SELECT *, CASE WHEN raw IS NULL AND state = 'out_of_stock' THEN 0 ELSE raw END AS q FROM c),
f AS (SELECT *, lag(q) OVER (PARTITION BY user_id ORDER BY t, event_id) AS before FROM k)"""


@query("estimated_sales", f"""WITH {EVENTS_SQL}, {_COUNTS}, g AS (SELECT *, CASE WHEN t >= {MID_MS} - {7 * DAY_MS} THEN q - before END AS step FROM f WHERE t <= {MID_MS})
SELECT user_id, CAST(coalesce(sum(-step) FILTER (WHERE step < 0), 0) AS BIGINT) AS sold, count(*) FILTER (WHERE step < 0) AS decreases, CAST(coalesce(sum(step) FILTER (WHERE step > 0), 0) AS BIGINT) AS added,
count(*) FILTER (WHERE step > 0) AS increases, coalesce(max(CASE WHEN step < 0 AND before >= 20000 THEN 1 ELSE 0 END), 0) AS at_least, greatest(min(t) FILTER (WHERE q IS NOT NULL), {MID_MS} - {7 * DAY_MS}) AS since
FROM g GROUP BY user_id HAVING count(q) > 0""")
def estimated_sales(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = event_stream(spark, sf_dir)
    counts = e.select("event_id", "user_id", "t", F.when(F.col("event_type") != "error", F.col("cents")).alias("quantity"))
    state = F.when(F.col("cents") % 2 == 0, "out_of_stock").otherwise("in_stock")
    read = series.read_counts(counts, e.where("event_type in ('error', 'signup')").select("user_id", "t", state.alias("availability")), ["user_id"], "t")
    return series.estimated_sales(read, ["user_id"], "t", F.lit(MID_MS - 7 * DAY_MS), F.lit(MID_MS), 20_000, ["event_id"])


@query("stock_steps", f"""WITH {EVENTS_SQL}, s AS (SELECT user_id, greatest(t, {MID_MS} - {7 * DAY_MS}) AS from_t, least(coalesce(lead(t) OVER (PARTITION BY user_id ORDER BY t, event_id), {MID_MS}), {MID_MS}) AS to_t,
CASE WHEN event_type <> 'error' THEN cents END AS cents FROM e) SELECT user_id, from_t, to_t, cents FROM s WHERE cents IS NOT NULL AND from_t < to_t""")
def stock_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = event_stream(spark, sf_dir).withColumn("cents", F.when(F.col("event_type") != "error", F.col("cents")))
    return series.steps(rows, ["user_id"], "t", "cents", F.lit(MID_MS - 7 * DAY_MS), F.lit(MID_MS), ["event_id"])


@query("tail_points", f"""WITH {EVENTS_SQL} SELECT event_id, user_id, t, total FROM (SELECT *, count(*) OVER (PARTITION BY user_id) AS total, row_number() OVER (PARTITION BY user_id ORDER BY t DESC, event_id DESC) AS n FROM e) WHERE n <= 730""")
def tail_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    return series.tail(event_stream(spark, sf_dir), ["user_id"], "t", series.TAIL, ["event_id"]).select("event_id", "user_id", "t", "total")


@query("last_non_null", f"""WITH {EVENTS_SQL} SELECT user_id, coalesce(arg_max(event_type, (t, event_id)) FILTER (WHERE event_type <> 'error'), 'unknown') AS last_known, max(t) AS latest FROM e GROUP BY user_id""")
def last_non_null(spark: SparkSession, sf_dir: str) -> DataFrame:
    known = F.max_by(F.when(F.col("event_type") != "error", F.col("event_type")), F.when(F.col("event_type") != "error", F.struct("t", "event_id")))
    return event_stream(spark, sf_dir).groupBy("user_id").agg(F.coalesce(known, F.lit("unknown")).alias("last_known"), F.max("t").alias("latest"))


@query("percentile_nearest_rank", f"WITH {EVENTS_SQL} SELECT event_type, quantile_disc(cents, 0.5) AS p50, quantile_disc(cents, 0.95) AS p95, max(cents) AS top FROM e GROUP BY event_type")
def percentile_nearest_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    disc = lambda p: F.expr(f"CAST(percentile_disc({p}) WITHIN GROUP (ORDER BY cents) AS BIGINT)")
    return event_stream(spark, sf_dir).groupBy("event_type").agg(disc(0.5).alias("p50"), disc(0.95).alias("p95"), F.max("cents").alias("top"))
