"""What a published dataset promises: its checks, dictionary-encoded relations, shards that keep components together."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import graph


def is_ascending(times: Column) -> Column:
    """Whether an array rises strictly."""
    return F.forall(F.sequence(F.lit(1), F.greatest(F.size(times) - 1, F.lit(1))), lambda i: (i >= F.size(times)) | (F.get(times, i) > F.get(times, i - 1)))


def dataset_issues(files: DataFrame, manifest_version: str, key: str = "product") -> DataFrame:
    """(issue, n) of a published dataset (product, version, offers): repeated keys, another version, times that do not rise, amounts that do not fit their state."""
    times_ok = F.forall("offers", lambda o: F.forall(o["segments"], lambda s: is_ascending(F.transform(s["prices"], lambda p: p["t"])) & is_ascending(F.transform(s["presence"], lambda p: p["t"]))))
    fits = lambda p: F.when(p["state"] == "unavailable", p["low"].isNull() & p["high"].isNull()).when(p["state"] == "exact", p["low"] == p["high"]).otherwise(p["low"] < p["high"])
    prices_ok = F.forall("offers", lambda o: F.forall(o["segments"], lambda s: F.forall(s["prices"], fits)))
    counted = files.withColumn("__n", F.count("*").over(Window.partitionBy("store", key)))
    bad = F.array_compact(F.array(F.when(F.col("__n") > 1, "repeated key"), F.when(F.col("version") != manifest_version, "another version"), F.when(~times_ok, "times do not rise"), F.when(~F.coalesce(prices_ok, F.lit(False)), "amounts do not fit")))
    return counted.select(F.explode(bad).alias("issue")).groupBy("issue").agg(F.count("*").alias("n"))


def presence_tuples(points: Column) -> Column:
    """JSON of presence points as `[t, 0 or 1]`, by time."""
    return F.to_json(F.transform(F.array_sort(points), lambda p: F.array(p["t"].cast("long"), p["present"].cast("long"))))


def price_tuples(points: Column) -> Column:
    """JSON of price points as `[t, state, low, high]`, by time."""
    amount = lambda x: F.coalesce(x.cast("string"), F.lit("null"))
    one = lambda p: F.concat(F.lit("["), p["t"].cast("string"), F.lit(',"'), p["state"], F.lit('",'), amount(p["low"]), F.lit(","), amount(p["high"]), F.lit("]"))
    return F.concat(F.lit("["), F.array_join(F.transform(F.array_sort(points), one), ","), F.lit("]"))


def global_rank(rows: DataFrame, order: list[Column], name: str) -> DataFrame:
    """rows with their place from 0 in this order: rows are dealt by ranges of it, written so, and counted within and before each range. No task holds more than one
    range, however many rows are alike in what comes first."""
    dealt = graph.cut(rows.repartitionByRange(*order).withColumn("__range", F.spark_partition_id()))
    sizes = dealt.groupBy("__range").agg(F.count("*").alias("__k"))  # a row a range
    before = sizes.select("__range", F.coalesce(F.sum("__k").over(Window.orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__before"))
    own = F.row_number().over(Window.partitionBy("__range").orderBy(*order)) - 1
    return dealt.withColumn("__own", own).join(F.broadcast(before), "__range").withColumn(name, F.col("__own") + F.col("__before")).drop("__range", "__own", "__before")


def encode(rows: DataFrame, columns: list[str]) -> tuple[DataFrame, DataFrame]:
    """(rows with an index for each string, dictionary): strings by falling frequency, then by text. Most strings of a dictionary are equally frequent, which is why
    ranks are made by ranges of both."""
    strings = rows.select(F.explode(F.array(*columns)).alias("s")).where("s is not null").groupBy("s").agg(F.count("*").alias("n"))
    table = global_rank(strings, [F.col("n").desc(), F.col("s")], "i").select("s", "i")
    out = rows
    for c in columns:
        out = out.join(table.select(F.col("s").alias(c), F.col("i").alias(f"{c}_i")), c, "left").drop(c)
    return out, table


def decode(rows: DataFrame, table: DataFrame, columns: list[str]) -> DataFrame:
    for c in columns:
        rows = rows.join(table.select(F.col("i").alias(f"{c}_i"), F.col("s").alias(c)), f"{c}_i", "left").drop(f"{c}_i")
    return rows


def shards(relations: DataFrame, n: int, buckets: int = 256) -> DataFrame:
    """(node, component, shard): components are whole in a shard, the heaviest first to the least loaded, whatever their number.

    Components of one weight can take each other's places, so the plan is made from how many there are of each weight, and they take its places by rank, which is
    counted within buckets.
    """
    comp = graph.components(relations)
    weights = relations.select(F.col("a").alias("node")).join(comp, "node").groupBy("component").agg(F.count("*").alias("w"))
    weights = graph.cut(weights.withColumn("bucket", F.pmod(F.xxhash64("component"), F.lit(buckets)).cast("int")))
    counts = weights.groupBy("w", "bucket").agg(F.count("*").alias("k"))
    plan = graph.fill_shards({r.w: r.k for r in counts.groupBy("w").agg(F.sum("k").alias("k")).collect()}, n)  # a row a weight, of which a graph has few
    places = relations.sparkSession.createDataFrame([(w, at, at + k, s) for w, x in plan.items() for at, k, s in x], "w long, first long, last long, shard int")
    before = counts.select("w", "bucket", F.coalesce(F.sum("k").over(Window.partitionBy("w").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    rank = F.row_number().over(Window.partitionBy("w", "bucket").orderBy("component")) - 1
    ranked = weights.withColumn("rank", rank).join(before, ["w", "bucket"]).select("component", "w", (F.col("rank") + F.col("before")).alias("rank"))
    spots = places.groupBy("w").agg(F.array_sort(F.collect_list(F.struct("first", "shard"))).alias("spots"))
    at = F.element_at(F.filter("spots", lambda s: s["first"] <= F.col("rank")), -1)
    return comp.join(ranked.join(F.broadcast(spots), "w").select("component", at["shard"].alias("shard")), "component")


def caveats(flags: dict[str, Column]) -> Column:
    """The names of the flags that hold, in order."""
    return F.array_compact(F.array(*[F.when(F.coalesce(c, F.lit(False)), F.lit(k)) for k, c in flags.items()]))
