"""Document fingerprints by winnowing, with DataFrame functions only."""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import table

#: Code points of a gram, and grams of a window (a power of 2): a run of GRAM + WINDOW - 1 code points that two texts share gives both a common fingerprint.
GRAM, WINDOW = 16, 16
#: Rows of a range of ids, and the most ranges. Only the bounds and first ids of ranges pass the driver, and each range's first row is repeated.
RANGE_ROWS, MOST_RANGES = 256, 100_000
#: Bits of a place: a text that is laid out with four bytes a code point, in an array of less than 2^31, has fewer than 2^29 of them.
PLACE_BITS = 29
MASK = (1 << PLACE_BITS) - 1
LEAST_ID = -(2**63)


def let(value: Column, then: Callable[[Column], Column]) -> Column:
    """then(value) with value computed once, even where `then` uses it in the lambda of another function."""
    return F.element_at(F.transform(F.array(value), then), 1)


def grams(text: Column, k: int) -> Column:
    """A number for each k-gram of code points: 35 bits of its hash above its place, which counts backwards. A shorter text is one gram, an empty has none.

    The text is laid out with four bytes a code point, so that a gram is cut out in the time of its length wherever it stands.
    """
    last = F.greatest(F.char_length(text) - k, F.lit(0))

    def run(wide: Column) -> Column:
        return F.transform(F.sequence(F.lit(0), last), lambda p: F.shiftleft(F.xxhash64(F.substring(wide, p * 4 + 1, F.lit(4 * k))), PLACE_BITS) - p)

    return F.when(F.char_length(text) > 0, let(F.encode(text, "UTF-32"), run)).otherwise(F.array().cast("array<bigint>"))


def minima(numbers: Column, w: int) -> Column:
    """The least number of each window of w numbers; fewer numbers are one window. Windows double in each step: there are log2(w) steps."""

    def run(a: Column, shift: int) -> Column:
        if shift == w:
            return F.slice(a, 1, F.greatest(F.size(a) - (w - 1), F.least(F.size(a), F.lit(1))))
        return let(F.zip_with(a, F.slice(a, shift + 1, F.size(a)), lambda x, y: F.least(x, y)), lambda b: run(b, 2 * shift))

    return let(numbers, lambda a: run(a, 1))


def fingerprint(text: Column, k: int = GRAM, w: int = WINDOW) -> Column:
    """array<long>: the chosen grams of a text in order of place, each as 35 bits of hash above its place (see grams).

    Of every window the least hash is chosen, the rightmost of equal ones: as places count backwards, that is the least number. Null and empty texts have no
    fingerprints; equal texts have equal ones.
    """
    return F.array_distinct(minima(grams(F.coalesce(text, F.lit("")), k), w))


def place(x: Column) -> Column:
    return (-x).bitwiseAND(F.lit(MASK))


def hash_part(x: Column) -> Column:
    return F.shiftright(x + MASK, PLACE_BITS)


def spliced(text: Column, prints: Column, keep: Column, after: Column, after_prints: Column, more: Column, k: int = GRAM, w: int = WINDOW) -> Column:
    """The fingerprint of the first `keep` code points of text followed by the first `more` of after, from the fingerprints of both.

    What a text's windows choose at a place depends on the windows that hold it: w of them, which reach from w - 1 code points before it to k + w - 2 after. So
    choices far enough from the seam and from the end are those of the two texts; those near them are made anew, from the code points that they depend on.
    """
    span, near = k + w - 1, k + 2 * w - 2  # code points of a window, and of the windows that hold a place
    cut, stop = keep - span, more - span  # the last places that only windows within the first part hold, and those within the second
    seam = F.concat(F.substring(text, keep - near + 1, F.lit(near)), F.substring(after, F.lit(1), F.lit(near)))
    tail = F.substring(after, more - near + 1, F.lit(near))
    first = F.filter(prints, lambda x: place(x) <= cut)
    middle = F.filter(F.transform(fingerprint(seam, k, w), lambda x: x - (keep - near)), lambda x: (place(x) > cut) & (place(x) < keep + w - 1))
    second = F.transform(F.filter(after_prints, lambda x: (place(x) >= w - 1) & (place(x) <= stop)), lambda x: x - keep)
    last = F.filter(F.transform(fingerprint(tail, k, w), lambda x: x - (more - near)), lambda x: place(x) > stop)
    whole = fingerprint(F.concat(F.substring(text, F.lit(1), keep), F.substring(after, F.lit(1), more)), k, w)
    return F.when((keep >= near) & (more >= near), F.concat(first, middle, second, F.transform(last, lambda x: x - keep))).otherwise(whole)


def places(prints: Column) -> Column:
    """array<struct<place, hash>> of a fingerprint, places in code points from 0."""
    return F.transform(prints, lambda x: F.struct(place(x).alias("place"), hash_part(x).alias("hash")))


def hashes(prints: Column) -> Column:
    return F.array_distinct(F.transform(prints, hash_part))


def likeness(a: Column, b: Column) -> Column:
    """Jaccard similarity of two arrays of hashes; 1 for two empty ones."""
    common = F.size(F.array_intersect(a, b)).cast("double")
    return F.when((F.size(a) == 0) & (F.size(b) == 0), 1.0).otherwise(common / (F.size(a) + F.size(b) - common))


def ranges_before(value: Column, cuts: list[int]) -> Column:
    """How many of the rising cuts are not above the value: found among every so many of them, then between two of these."""
    step = max(int(len(cuts) ** 0.5), 1)
    numbers = lambda x: F.from_json(F.lit(json.dumps(x)), "array<bigint>")  # noqa: E731  one literal, whatever its length
    block = F.size(F.filter(numbers(cuts[::step]), lambda c: c <= value))
    within = lambda k: (k - 1) * step + F.size(F.filter(F.slice(numbers(cuts), (k - 1) * step + 1, F.lit(step)), lambda c: c <= value))
    return F.when(block == 0, 0).otherwise(let(block, within)).cast("int")


def beside_next(docs: DataFrame, key: str = "doc_id") -> DataFrame:
    """docs dealt by ranges of ids, with __range, __ghost and __id: sorted by these, each row's next one follows it in its range.

    A range's first row is also put, as a ghost, at the end of the range before it, and the very first one at the end of the last. Ranges are cut at approximate
    quantiles, so they hold about as many rows each; a null id is the least.
    """
    spark = docs.sparkSession
    rows = docs.withColumn("__id", F.coalesce(F.col(key).cast("long"), F.lit(LEAST_ID)))
    n = rows.count()
    ranges = max(1, min(-(-n // RANGE_ROWS), MOST_RANGES))
    cuts = rows.agg(F.percentile_approx("__id", [i / ranges for i in range(1, ranges)] or [0.5], 10 * MOST_RANGES).alias("c")).first().c or []
    cuts = sorted(set(cuts)) if ranges > 1 else []
    rows = rows.withColumn("__range", ranges_before(F.col("__id"), cuts) if cuts else F.lit(0))
    firsts = [tuple(r) for r in rows.groupBy("__range").agg(F.min("__id")).orderBy("__range").collect()]  # at most MOST_RANGES
    schema = T.StructType([T.StructField("__id", T.LongType()), T.StructField("__before", T.IntegerType())])
    before = spark.createDataFrame([(first, firsts[i - 1][0]) for i, (_, first) in enumerate(firsts)], schema)
    rows = rows.join(F.broadcast(before), "__id", "left")
    spot = lambda r, g: F.struct(F.col(r).alias("__range"), F.lit(g).alias("__ghost"))
    spots = F.when(F.col("__before").isNull(), F.array(spot("__range", False))).otherwise(F.array(spot("__range", False), spot("__before", True)))
    rows = rows.withColumn("__spot", F.explode(spots)).withColumns({"__range": F.col("__spot.__range"), "__ghost": F.col("__spot.__ghost")})
    return rows.drop("__spot", "__before").repartition("__range")


def with_fingerprints(docs: DataFrame, k: int = GRAM, w: int = WINDOW) -> DataFrame:
    """doc_id, the text, its edited form (see op6) and the fingerprints of both and of the next document, a row for each row of docs.

    The next document is the one with the next doc_id, after the last the first; rows that repeat a doc_id follow each other in order of their texts' hashes. A
    single document is its own next one. Texts shuffle once, by ranges of doc_id; fingerprints are made after that and do not shuffle.
    """
    rows = beside_next(docs.select("doc_id", "text"))
    rows = rows.select("__range", "__ghost", "__id", "doc_id", F.coalesce("text", F.lit("")).alias("text")).withColumn("prints", fingerprint(F.col("text"), k, w))
    order = Window.partitionBy("__range").orderBy("__ghost", "__id", F.xxhash64("text"))
    rows = rows.withColumns({"next": F.lead("text").over(order), "next_prints": F.lead("prints").over(order)}).where(~F.col("__ghost"))
    n = F.char_length("text")
    half = F.floor(n / 2).cast("int")
    rows = rows.withColumns({"__keep": n - half, "__more": F.least(half, F.char_length("next"))})
    edited = F.concat(F.substring("text", F.lit(1), F.col("__keep")), F.substring("next", F.lit(1), F.col("__more")))
    prints = spliced(F.col("text"), F.col("prints"), F.col("__keep"), F.col("next"), F.col("next_prints"), F.col("__more"), k, w)
    return rows.select("doc_id", "text", "prints", "next_prints", edited.alias("edited"), prints.alias("edited_prints"))


def op6_winnowing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document: digests of its fingerprints and of its edited text's, and how alike both, and it and the next document, are.

    Edited: the last floor(n / 2) code points give way to as many from the start of the next document (or all that it has).
    """
    out = with_fingerprints(table(spark, sf_dir, "documents"))
    digest = lambda c: F.sha2(F.col(c).cast("string").cast("binary"), 256)
    own = hashes(F.col("prints"))
    return out.select(
        "doc_id", F.char_length("text").cast("long").alias("n_chars"), F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"), digest("prints").alias("fingerprint"), digest("edited_prints").alias("edited_fingerprint"),
        let(own, lambda a: likeness(a, hashes(F.col("edited_prints")))).alias("near_edited"), let(own, lambda a: likeness(a, hashes(F.col("next_prints")))).alias("near_next"),
    )
