"""Whether two tables hold the same rows, group by group: sums that do not depend on order, so that no row of one is joined with one of the other."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def digest(rows: DataFrame, by: list[str], columns: list[str]) -> DataFrame:
    """(by, n, sum, mix): how many rows, and the sum and the exclusive or of their 64-bit hashes, each combined before the shuffle. The sum tells a doubled row from
    none, the exclusive or goes by other bits."""
    rows = rows.select(*by, F.xxhash64(*columns).alias("__a"), F.xxhash64(F.lit(1), *columns).alias("__b"))
    return rows.groupBy(*by).agg(F.count("*").alias("n"), F.sum(F.col("__a").cast("decimal(38,0)")).alias("sum"), F.bit_xor("__b").alias("mix"))


def disagreements(a: DataFrame, b: DataFrame, by: list[str], columns: list[str]) -> DataFrame:
    """(by, rows, other_rows, fault): groups whose rows are not the same in both tables: missing in one, of another number, or of other contents."""
    x, y = digest(a, by, columns), digest(b, by, columns).withColumnsRenamed({"n": "__n", "sum": "__sum", "mix": "__mix"})
    both = x.join(y, by, "full_outer")
    fault = F.when(F.col("__n").isNull(), "missing").when(F.col("n").isNull(), "unknown").when(F.col("n") != F.col("__n"), "another number").when((F.col("sum") != F.col("__sum")) | (F.col("mix") != F.col("__mix")), "other contents")
    return both.select(*by, F.coalesce("n", F.lit(0)).alias("rows"), F.coalesce("__n", F.lit(0)).alias("other_rows"), fault.alias("fault")).where("fault is not null")
