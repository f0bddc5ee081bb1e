"""Catalogue files: a header that lists the sources, then a listing a line, in order of their keys. Large ones are many parts that read as one."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Fixed value: the version of the header.
VERSION = 1
SOURCE = "storeId string, file string, sha256 string, observedAt string, count long"
LISTING = "storeId string, pageKey string, name string, codes array<string>"


def complete(snapshots: DataFrame) -> DataFrame:
    """(storeId, file, sha256, observedAt, count, fault) of saved catalogues (storeId, file, text): a source each, with the reason why one can't be taken."""
    v = F.try_parse_json("text")
    items = F.try_variant_get(v, "$.items", "array<variant>")
    fault = F.when(v.isNull(), "no JSON").when(~F.coalesce(F.try_variant_get(v, "$.complete", "boolean"), F.lit(False)), "incomplete").when(items.isNull(), "no items")
    rows = snapshots.select("storeId", "file", F.sha2("text", 256).alias("sha256"), F.try_variant_get(v, "$.retrievedAt", "string").alias("observedAt"), F.size(items).cast("long").alias("count"), fault.alias("fault"))
    return rows.withColumn("count", F.when(F.col("fault").isNull(), F.col("count")))


def items(snapshots: DataFrame) -> DataFrame:
    """(storeId, item) of saved catalogues, an item a row, as JSON values."""
    return snapshots.select("storeId", F.explode(F.try_variant_get(F.try_parse_json("text"), "$.items", "array<variant>")).alias("item"))


def write_catalogue(listings: DataFrame, sources: DataFrame, path: str, key: tuple[str, ...] = ("storeId", "pageKey")) -> None:
    """Writes the header and the listings by key, in parts whose names follow each other. Only the header, a row a source, is one row."""
    named = F.array_sort(F.collect_list(F.struct("storeId", "file", "sha256", "observedAt", "count")))
    header = sources.agg(F.to_json(F.struct(F.lit(VERSION).alias("schemaVersion"), named.alias("sources"))).alias("value"))
    first = header.select(F.lit(0).alias("o"), *[F.lit(None).cast("string").alias(f"k{i}") for i in range(len(key))], "value")
    rows = listings.select(F.lit(1).alias("o"), *[F.col(c).cast("string").alias(f"k{i}") for i, c in enumerate(key)], F.to_json(F.struct(*listings.columns)).alias("value"))
    first.unionByName(rows).orderBy("o", *[f"k{i}" for i in range(len(key))]).select("value").write.text(path)


def read_catalogue(spark: SparkSession, path: str, listing: str = LISTING) -> tuple[DataFrame, DataFrame]:
    """(sources, listings) of a catalogue. The header is the line that has sources; a line that is no listing comes back with its text as `fault`."""
    lines = spark.read.text(path).withColumn("__v", F.try_parse_json("value"))
    is_header = F.coalesce(F.schema_of_variant(F.try_variant_get("__v", "$.sources", "variant")).startswith("ARRAY"), F.lit(False))
    sources = lines.where(is_header).select(F.explode(F.from_json(F.get_json_object("value", "$.sources"), f"array<struct<{SOURCE}>>")).alias("s")).select("s.*")
    rows = lines.where(~is_header & (F.trim("value") != "")).select(F.from_json("value", listing).alias("r"), F.when(~F.coalesce(F.schema_of_variant("__v").startswith("OBJECT"), F.lit(False)), F.col("value")).alias("fault"))
    return sources, rows.select("r.*", "fault")


def catalogue_faults(sources: DataFrame, listings: DataFrame, key: tuple[str, ...] = ("storeId", "pageKey")) -> DataFrame:
    """(subject, fault): lines that are no listings, sources whose count is not that of their listings, stores without a source, and keys that two listings have."""
    n = listings.where("fault is null").groupBy("storeId").agg(F.count("*").alias("__n"))
    both = sources.select("storeId", "count").join(n, "storeId", "full_outer")
    wrong = F.when(F.col("count").isNull(), "no source").when(F.coalesce("__n", F.lit(0)) != F.col("count"), "count disagrees")
    counted = both.select(F.col("storeId").alias("subject"), wrong.alias("fault")).where("fault is not null")
    twice = listings.where("fault is null").groupBy(*key).count().where("count > 1").select(F.concat_ws("/", *key).alias("subject"), F.lit("key twice").alias("fault"))
    unread = listings.where("fault is not null").select(F.col("fault").alias("subject"), F.lit("no listing").alias("fault"))
    return counted.unionByName(twice).unionByName(unread)
