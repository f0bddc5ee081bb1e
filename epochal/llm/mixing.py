"""Mixing sources to target weights, with DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import BROADCAST_IDS, WORD, Scratch, plain, salted_left_join, table

WEIGHTS = (5, 2, 1)
#: Of all sizes, as a ratio of integers.
SHARE = (3, 2)
CAP = 2
SEED = "mix-1"
#: Parts that a source's documents are dealt into by hash, for their draws.
PARTS = 4096


def size_of(text: str) -> Column:
    """Number of words of a text; null has none."""
    return F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(sized: DataFrame) -> DataFrame:
    """(source, source_size, target) from (source, size): one row a source, null among them.

    Weights repeat over the sources in code point order, null last. A target is min(CAP * source_size, level * weight) with the one level at which the targets
    sum to the share: sharing the excess of capped sources out again by weight, until none is above its cap, ends there. Sources in order of cap by weight are
    capped up to the first whose cap is above the level left for it; that is a running sum over the sources, of which there is one row each.
    """
    src = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    every = Window.orderBy(F.col("source").asc_nulls_last())
    k = len(WEIGHTS)
    weight = F.element_at(F.array(*map(F.lit, WEIGHTS)), ((F.row_number().over(every) - 1) % k + 1).cast("int")).cast("long")
    src = src.withColumn("weight", weight).withColumn("cap", F.lit(CAP) * F.col("source_size"))
    scale = 1
    for w in WEIGHTS:
        scale *= w
    by_ratio = Window.orderBy((F.col("cap") * F.lit(scale) / F.col("weight")).cast("long"), F.col("source").asc_nulls_last())
    whole = Window.partitionBy()
    before = by_ratio.rowsBetween(Window.unboundedPreceding, -1)
    src = src.withColumns({
        "total": F.sum("source_size").over(whole) * F.lit(SHARE[0]), "spent": F.coalesce(F.sum("cap").over(before), F.lit(0)),
        "left": F.sum("weight").over(by_ratio.rowsBetween(0, Window.unboundedFollowing)),
    })
    # amounts times SHARE[1], so that all of them are integers
    src = src.withColumn("rest", F.col("total") - F.lit(SHARE[1]) * F.col("spent"))
    src = src.withColumn("open", F.lit(SHARE[1]) * F.col("cap") * F.col("left") > F.col("weight") * F.col("rest"))
    first = F.min(F.when(F.col("open"), F.struct(F.lit(-1) * F.col("left"), F.col("rest").alias("rest"), F.col("left").alias("left")))).over(whole)
    src = src.withColumn("at", first)
    level = F.col("weight").cast("double") * F.col("at.rest").cast("double") / (F.lit(float(SHARE[1])) * F.col("at.left").cast("double"))
    return src.select("source", "source_size", F.when(F.col("open"), level).otherwise(F.col("cap").cast("double")).alias("target"))


def hash_bits(value: Column, digits: int) -> Column:
    """The first hexadecimal digits of md5(seed:value), as a number."""
    return F.conv(F.substring(F.md5(F.concat(F.lit(SEED + ":"), F.coalesce(value.cast("string"), F.lit("null"))).cast("binary")), 1, digits), 16, 10).cast("long")


def with_draws(parts: DataFrame, targets: DataFrame) -> DataFrame:
    """targets with floor(rate) and the circular run [draw_from, draw_to) of parts whose documents are taken once more.

    parts has the words of each (source, part). Lay the parts of a source, in order of hash, round a circle as long as its words; from a place that the seed
    chooses, from the next part's edge on, take as much of it as the rate's fraction: the parts whose middles lie there. Each document is so taken with the
    fraction's probability, and a source's taken words miss its target by half of one part's words at most (a document's, in a source of some thousands).
    """
    own = Window.partitionBy("__key")
    before = F.coalesce(F.sum("words").over(own.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).cast("double")
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size").cast("double")).otherwise(F.lit(0.0))
    side = targets.select(F.struct("source").alias("__key"), "source_size", "target", F.floor(rate).alias("times"), (rate - F.floor(rate)).alias("fraction"), hash_bits(F.col("source"), 8).alias("start"))
    whole = F.col("source_size").cast("double")
    rows = parts.withColumn("before", before).withColumn("middle", F.col("before") + F.col("words") / 2).join(side, "__key")
    chosen = F.col("middle") >= F.floor(F.col("start") / F.lit(4294967296.0) * whole)
    rows = rows.withColumn("begin", F.coalesce(F.min(F.when(chosen, F.col("before"))).over(own), whole))
    end = F.col("begin") + F.col("fraction") * whole
    first = lambda x: F.coalesce(F.min(F.when(x, F.col("part"))), F.lit(PARTS))
    stop = F.col("middle") >= F.when(end > whole, end - whole).otherwise(end)
    return rows.groupBy("__key", "source_size", "target", "times").agg(first(chosen).alias("draw_from"), first(stop).alias("draw_to"), F.first(end > whole).alias("round"))


def with_copies(docs: DataFrame, scratch: Scratch, text: str = "text") -> DataFrame:
    """docs with __size, __source_size, __target and __copies: floor(rate) of them, and one more with the fraction's probability (see with_draws).

    Draws hang on md5(seed:doc_id) and md5(seed:source), so reruns agree. Rows that repeat a doc_id are each taken alike. Null and empty texts have size 0 and
    are taken by their source's rate as well; a source whose texts are all empty has rate 0. Input columns whose names start with two underscores are left behind.
    """
    sized = plain(docs).withColumns({"__size": size_of(text), "__part": hash_bits(F.col("doc_id"), 3), "__key": F.struct("source")})
    parts = scratch.write(sized.groupBy("__key", F.col("__part").alias("part")).agg(F.sum("__size").alias("words")))  # at most PARTS rows a source
    targets = scratch.write(source_targets(parts.select("__key.source", F.col("words").alias("size"))))
    side = scratch.write(with_draws(parts, targets)).withColumnsRenamed({"source_size": "__source_size", "target": "__target", "times": "__times", "draw_from": "__from", "draw_to": "__to", "round": "__round"})
    if side.count() <= BROADCAST_IDS // 10:
        out = sized.join(F.broadcast(side), "__key", "left")
    else:
        out = salted_left_join(sized, side, ["__key"], ["doc_id"])
    after, before = F.col("__part") >= F.col("__from"), F.col("__part") < F.col("__to")
    extra = F.when(F.col("__round"), after | before).otherwise(after & before).cast("long")
    return out.withColumn("__copies", F.col("__times") + extra).drop("__key", "__part", "__times", "__from", "__to", "__round")


def mix_documents(docs: DataFrame, scratch: Scratch) -> DataFrame:
    """The mix itself: each document as often as its copies say, in the columns of docs."""
    out = with_copies(docs, scratch)
    return out.withColumn("__copy", F.explode(F.sequence(F.lit(1), F.greatest("__copies", F.lit(1))))).where("__copies > 0").select(*[F.col(f"`{c}`") for c in plain(docs).columns])


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document: its words, its source's words and target, and the words that the mix takes of it."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    out = with_copies(docs, Scratch(spark))
    return out.select("doc_id", F.col("__size").alias("size"), F.col("__source_size").alias("source_size"), F.col("__target").alias("target"), (F.col("__copies") * F.col("__size")).alias("taken"))


SQL = """
WITH d AS (SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0) AS BIGINT) AS size FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size, row_number() OVER (ORDER BY source NULLS LAST) AS k FROM d GROUP BY source),
w AS (SELECT *, [5, 2, 1][(k - 1) % 3 + 1] AS weight, 2 * source_size AS cap FROM s),
o AS (SELECT *, row_number() OVER (ORDER BY cap * 10 // weight, source NULLS LAST) AS n FROM w),
r AS (SELECT *, sum(source_size) OVER () * 3 - 2 * coalesce(sum(cap) OVER (ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS rest,
  sum(weight) OVER (ORDER BY n ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS remaining FROM o),
f AS (SELECT *, 2 * cap * remaining > weight * rest AS open FROM r),
a AS (SELECT rest, remaining FROM f WHERE open ORDER BY n LIMIT 1),
t AS (SELECT f.source, f.source_size, CASE WHEN open THEN CAST(weight AS DOUBLE) * CAST(a.rest AS DOUBLE) / (2.0::DOUBLE * CAST(a.remaining AS DOUBLE)) ELSE CAST(cap AS DOUBLE) END AS target FROM f LEFT JOIN a ON true),
f2 AS (SELECT *, CASE WHEN source_size > 0 THEN target / CAST(source_size AS DOUBLE) ELSE 0.0::DOUBLE END AS rate,
  floor(CAST(CAST('0x' || substr(md5('mix-1:' || coalesce(source, 'null')), 1, 8) AS BIGINT) AS DOUBLE) / 4294967296.0::DOUBLE * source_size) AS start FROM t),
h AS (SELECT *, CAST('0x' || substr(md5('mix-1:' || coalesce(CAST(doc_id AS VARCHAR), 'null')), 1, 3) AS BIGINT) AS part FROM d),
p AS (SELECT source, part, sum(sum(size)) OVER (PARTITION BY source ORDER BY part) - sum(size) / 2.0::DOUBLE AS middle, sum(sum(size)) OVER (PARTITION BY source ORDER BY part) - sum(size) AS edge FROM h GROUP BY source, part),
b AS (SELECT f2.*, coalesce((SELECT min(edge) FROM p WHERE p.source IS NOT DISTINCT FROM f2.source AND middle >= start), source_size) AS begin FROM f2),
m AS (SELECT h.doc_id, size, source_size, target, rate, (middle - begin + CASE WHEN middle < begin THEN source_size ELSE 0 END) < (rate - floor(rate)) * source_size AS more
  FROM h JOIN b ON h.source IS NOT DISTINCT FROM b.source JOIN p ON h.source IS NOT DISTINCT FROM p.source AND h.part = p.part)
SELECT doc_id, size, source_size, target, CAST(floor(rate) + CASE WHEN more THEN 1 ELSE 0 END AS BIGINT) * size AS taken FROM m
"""
