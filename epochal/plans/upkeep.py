"""Registered queries on runs and their upkeep: statistics of imports, gaps, first runs between, summaries, shards and displayed forms."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import keys, money
from ..functions.times import DAY_MS
from ..operators import asof, changepoints, imports, intervals
from ..sources.tables import EVENTS_SQL, PRICES_SQL, cents, event_stream, fnv_sql, price_stream, table
from .registry import query

PERIODS = (7, 30, 90, 180, 365, 1095, 1825)
SHARDS = 64
END_MS = 1_706_659_200_000


@query("import_statistics", f"""WITH {PRICES_SQL}, r AS (SELECT part, run, min(cents) AS cents FROM x GROUP BY part, run), l AS (SELECT *, lag(run) OVER w AS last, lag(cents) OVER w AS before FROM r WINDOW w AS (PARTITION BY part ORDER BY run))
SELECT run, count(*) AS items, count(*) FILTER (WHERE last IS NULL) AS fresh, count(*) FILTER (WHERE last + 1 < run) AS returned, count(*) FILTER (WHERE last IS NOT NULL AND before IS DISTINCT FROM cents) AS changed FROM l GROUP BY run""")
def import_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    runs = price_stream(spark, sf_dir).groupBy("part", "run").agg(F.min("cents").alias("cents"))
    return imports.run_statistics(runs, ["part"], "run", ["cents"])


@query("listing_gaps", f"""WITH {PRICES_SQL}, r AS (SELECT DISTINCT part, run FROM x), g AS (SELECT part, lag(run) OVER (PARTITION BY part ORDER BY run) + 1 AS start, run - 1 AS stop FROM r)
SELECT part, start, stop FROM g WHERE start <= stop""")
def listing_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    runs = price_stream(spark, sf_dir).select("part", F.col("run").alias("start"), F.col("run").alias("stop")).distinct()
    return intervals.gaps(runs, ["part"])


@query("first_between", f"""WITH {EVENTS_SQL}, f AS (SELECT event_id, user_id, t, event_type, min(CASE WHEN event_type = 'view' THEN t END) OVER (PARTITION BY user_id ORDER BY t RANGE BETWEEN 1 FOLLOWING AND {DAY_MS} FOLLOWING) AS next_t FROM e)
SELECT event_id, user_id, t, next_t FROM f WHERE event_type = 'purchase'""")
def first_between(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first view strictly after a purchase, within a day."""
    e = event_stream(spark, sf_dir)
    out = asof.first_after(e, ["user_id"], "t", F.col("event_type") == "view", DAY_MS, "next_t")
    return out.where("event_type = 'purchase'").select("event_id", "user_id", "t", "next_t")


@query("canonical_presence", f"""WITH {EVENTS_SQL}, p AS (SELECT *, event_type <> 'error' AS present FROM e), k AS (SELECT *, max(CAST(present AS INTEGER)) OVER (PARTITION BY user_id ORDER BY t, event_id ROWS UNBOUNDED PRECEDING) AS seen FROM p),
c AS (SELECT *, lag(present) OVER (PARTITION BY user_id ORDER BY t, event_id) AS before FROM k WHERE seen = 1) SELECT event_id, user_id, t, present FROM c WHERE before IS DISTINCT FROM present""")
def canonical_presence(spark: SparkSession, sf_dir: str) -> DataFrame:
    points = event_stream(spark, sf_dir).withColumn("present", F.col("event_type") != "error")
    seen = changepoints.drop_leading_absent(points, ["user_id"], "t", "present", ["event_id"])
    return changepoints.change_points(seen, ["user_id"], "t", ["present"], ["event_id"]).select("event_id", "user_id", "t", "present")


@query("latest_summary", f"""WITH {PRICES_SQL}, r AS (SELECT part, run, offer, cents, row_number() OVER (PARTITION BY part ORDER BY run DESC, offer, cents) AS n FROM x) SELECT part, run, offer, cents FROM r WHERE n = 1""")
def latest_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of each part's latest run, the least offer and its price."""
    return imports.latest_summary(price_stream(spark, sf_dir), ["part"], "run", ["offer", "cents"])


@query("chart_windows", f"""WITH {EVENTS_SQL}, m AS (SELECT user_id, min(t) AS first_t FROM e GROUP BY user_id) SELECT user_id, days, greatest(first_t, {END_MS} - days::BIGINT * {DAY_MS}) AS start FROM m, (SELECT unnest([{', '.join(map(str, PERIODS))}]) AS days)""")
def chart_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    first = event_stream(spark, sf_dir).groupBy("user_id").agg(F.min("t").alias("first_t"))
    periods = F.explode(F.array(*map(F.lit, PERIODS)))
    return first.withColumn("days", periods).select("user_id", "days", F.greatest("first_t", F.lit(END_MS) - F.col("days").cast("long") * DAY_MS).alias("start"))


@query("key_shards", f"SELECT s_suppkey, {fnv_sql('s_name')} AS hash, {fnv_sql('s_name')} % {SHARDS} AS shard FROM supplier")
def key_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    h = keys.fnv1a(F.col("s_name"))
    return table(spark, sf_dir, "supplier").select("s_suppkey", h.alias("hash"), (h % SHARDS).alias("shard"))


@query("displayed_forms", """WITH b AS (SELECT c_custkey, CAST(floor(c_acctbal * 100 + 0.5) AS BIGINT) AS m, c_custkey % 150 AS n FROM customer)
SELECT c_custkey, CASE WHEN m > 0 THEN '+' || m WHEN m < 0 THEN '−' || abs(m) ELSE '±0' END AS signed, CASE WHEN n >= 100 THEN '100+' ELSE n::VARCHAR END AS shown FROM b""")
def displayed_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Amounts with their sign, and counts as a shop shows them up to its cap."""
    c = table(spark, sf_dir, "customer")
    return c.select("c_custkey", money.signed_amount(cents("c_acctbal")).alias("signed"), money.capped_count(F.col("c_custkey") % 150, F.lit(100)).alias("shown"))
