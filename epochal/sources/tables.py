"""The driver's tables in the shapes that the operators take: observation streams, runs and listings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.money import half_up
from ..functions.times import epoch_ms


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(rows: DataFrame, *key: str) -> DataFrame:
    """rows dealt over the whole cluster by a key. A table of some MB is read by a task or two, which would then do all costly work on its rows."""
    spark = rows.sparkSession
    return rows.repartition(max(4 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions"))), *key)


#: Rows of a series table that one task takes.
TASK_ROWS = 500_000


def by_size(rows: DataFrame, whole: DataFrame, *key: str) -> DataFrame:
    """rows dealt by a key into tasks of about TASK_ROWS, as many as `whole`, the table they come from, needs: a task's memory does not grow with the table."""
    return rows.repartition(max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-whole.count() // TASK_ROWS)), *key)


def cents(c: str) -> Column:
    return half_up(F.col(c) * 100)


def event_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(event_id, user_id, t, event_type, cents): an entity is a user; rows of one time follow each other by event_id."""
    e = table(spark, sf_dir, "events")
    return e.select("event_id", "user_id", epoch_ms(F.col("ts")).alias("t"), "event_type", cents("value").alias("cents"))


def price_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(part, offer, run, t, cents): unit prices by shipping date; a run is a month, an offer a supplier of a part."""
    x = table(spark, sf_dir, "lineitem")
    run = (F.year("l_shipdate") * 12 + F.month("l_shipdate")).cast("int")
    return x.select(
        F.col("l_partkey").alias("part"), F.col("l_suppkey").alias("offer"), run.alias("run"), epoch_ms(F.col("l_shipdate")).alias("t"),
        half_up(F.col("l_extendedprice") * 100 / F.col("l_quantity")).alias("cents"), half_up(F.col("l_quantity")).alias("quantity"),
    )


def daily_prices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One price a part and day: the least of the day, so that no time has two states."""
    x = by_size(price_stream(spark, sf_dir).select("part", "t", "cents", "run"), table(spark, sf_dir, "lineitem"), "part")
    return x.groupBy("part", "t").agg(F.min("cents").alias("cents"), F.min("run").alias("run"))


#: The same shapes in SQL, for the registered queries.
EVENTS_SQL = "e AS (SELECT event_id, user_id, epoch_us(ts) // 1000 AS t, event_type, CAST(floor(value * 100 + 0.5) AS BIGINT) AS cents FROM events)"
PRICES_SQL = """x AS (SELECT l_partkey AS part, l_suppkey AS offer, CAST(year(l_shipdate) * 12 + month(l_shipdate) AS INTEGER) AS run, epoch_ms(l_shipdate) AS t,
  CAST(floor(l_extendedprice * 100 / l_quantity + 0.5) AS BIGINT) AS cents, CAST(floor(l_quantity + 0.5) AS BIGINT) AS quantity FROM lineitem),
d AS (SELECT part, t, min(cents) AS cents, min(run) AS run FROM x GROUP BY part, t)"""


def fnv_sql(text: str) -> str:
    """32-bit FNV-1a of an ASCII text in SQL."""
    return f"list_reduce(list_prepend(2166136261::BIGINT, list_transform(string_split({text}, ''), lambda c: CAST(ord(c) AS BIGINT))), lambda h, b: (xor(h, b) * 16777619) & 4294967295)"
