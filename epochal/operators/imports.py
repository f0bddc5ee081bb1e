"""Imports, validation and upkeep of a catalogue: upserts, occurrence dedupe, drift against the run before, capped issues, quarantine."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.money import half_up

# The most that a run may differ from the one before; all are strict.
THRESHOLDS = {"drop": 0.2, "missing": 0.2, "price": 0.3, "unavailable": 0.5}
ISSUES_LISTED = 20


def upsert_seen(known: DataFrame, seen: DataFrame, key: list[str], t: str, newest: list[str]) -> DataFrame:
    """(key, first_seen, last_seen, newest...) of entities known before (in this shape) and of a batch's sightings; attributes come from the newest observation."""
    batch = seen.select(*key, F.col(t).alias("first_seen"), F.col(t).alias("last_seen"), *newest)
    both = known.unionByName(batch)
    attrs = F.max_by(F.struct(*newest), F.struct("last_seen", *newest)).alias("__n")
    return both.groupBy(*key).agg(F.min("first_seen").alias("first_seen"), F.max("last_seen").alias("last_seen"), attrs).select(*key, "first_seen", "last_seen", "__n.*")


def dedupe_occurrences(rows: DataFrame, key: list[str], rich: Column, order: list[str], source: str, facts: list[str]) -> DataFrame:
    """One row a key: the first that is rich, else the first; with its sources, how many occurrences it had and how many of them disagreed with it."""
    w = Window.partitionBy(*key)
    first = w.orderBy(rich.desc(), *order)
    rows = rows.withColumns({"__n": F.row_number().over(first), "occurrences": F.count("*").over(w), "__source": F.dense_rank().over(w.orderBy(source)), "__facts": F.first(F.struct(*facts)).over(first)})
    rows = rows.withColumns({"n_sources": F.max("__source").over(w), "disagreeing": F.sum((~F.col("__facts").eqNullSafe(F.struct(*facts))).cast("long")).over(w)})
    return rows.where("__n = 1").drop("__n", "__facts", "__source")


def compare_runs(before: DataFrame, now: DataFrame, key: list[str], value: str) -> DataFrame:
    """One row of what changed between two runs (one row a product each): counts, ratios to four places and the thresholds that are passed."""
    b = before.select(*key, F.col(value).alias("__b"), F.lit(1).alias("__in_b"))
    n = now.select(*key, F.col(value).alias("__n"), F.lit(1).alias("__in_n"))
    both = b.join(n, key, "full_outer")
    count = lambda c: F.coalesce(F.sum(F.when(c, 1).otherwise(0)), F.lit(0)).cast("long")
    in_b, in_n = F.col("__in_b").isNotNull(), F.col("__in_n").isNotNull()
    out = both.agg(
        count(in_n).alias("items"), count(in_b).alias("items_before"), count(in_b & ~in_n & F.col("__b").isNotNull()).alias("missing"), count(in_n & (~in_b | F.col("__b").isNull())).alias("added"),
        count(in_b & in_n & F.col("__b").isNotNull()).alias("common"), count(in_b & in_n & F.col("__b").isNotNull() & ~F.col("__b").eqNullSafe(F.col("__n"))).alias("changed"), count(in_n & F.col("__n").isNull()).alias("unavailable"),
    )
    ratio = lambda a, b: F.when(F.col(b) > 0, a / F.col(b))
    drop, missing, price, gone = ratio(F.col("items_before") - F.col("items"), "items_before"), ratio(F.col("missing"), "items_before"), ratio(F.col("changed"), "common"), ratio(F.col("unavailable"), "items")
    over = lambda x, name: F.coalesce(x > THRESHOLDS[name], F.lit(False)).cast("int")
    return out.select(
        "*", half_up(drop, 4).alias("drop_ratio"), half_up(missing, 4).alias("missing_ratio"), half_up(price, 4).alias("price_ratio"),
        over(drop, "drop").alias("drop_error"), over(missing, "missing").alias("missing_error"), over(price, "price").alias("price_error"), over(gone, "unavailable").alias("unavailable_error"),
    )


def issues(rows: DataFrame, subject: str, rules: dict[str, Column], listed: int = ISSUES_LISTED) -> DataFrame:
    """(code, subject, n): for each rule that holds, the first `listed` subjects and one row without a subject that counts the others.

    All rules are read in one pass; Spark keeps `listed` rows a task and code, the counts are summed before the shuffle.
    """
    found = F.array_compact(F.array(*[F.when(F.coalesce(c, F.lit(False)), F.lit(code)) for code, c in rules.items()]))
    hits = rows.select(F.col(subject).alias("subject"), F.explode(found).alias("code"))
    counts = hits.groupBy("code").agg(F.count("*").alias("n"))
    w = Window.partitionBy("code").orderBy("subject")
    shown = hits.withColumn("__n", F.row_number().over(w)).where(F.col("__n") <= listed).select("code", "subject", F.lit(1).cast("long").alias("n"))
    rest = counts.where(F.col("n") > listed).select("code", F.lit(None).cast(shown.schema["subject"].dataType).alias("subject"), (F.col("n") - listed).alias("n"))
    return shown.unionByName(rest)


def coverage(claimed: DataFrame, observed: DataFrame, key: str) -> DataFrame:
    """(side, n): keys that are claimed and not observed, observed and not claimed, and both."""
    a, b = claimed.select(key).distinct().withColumn("__a", F.lit(1)), observed.select(key).distinct().withColumn("__b", F.lit(1))
    side = F.when(F.col("__b").isNull(), "missing").when(F.col("__a").isNull(), "extra").otherwise("covered")
    return a.join(b, key, "full_outer").groupBy(side.alias("side")).agg(F.count("*").alias("n"))


def split_quarantine(runs: DataFrame, checks: DataFrame, key: list[str]) -> tuple[DataFrame, DataFrame]:
    """(runs to import, rejected runs with their reasons): a run with any failed check is kept out whole."""
    reasons = checks.groupBy(*key).agg(F.array_sort(F.collect_set("reason")).alias("reasons"))
    return runs.join(reasons, key, "left_anti"), runs.join(reasons, key)


def run_counts(runs: DataFrame, stores: DataFrame, key: str, t: str) -> DataFrame:
    """(store, n_runs, latest), stores without a run included."""
    return stores.join(runs.groupBy(key).agg(F.count("*").alias("n_runs"), F.max(t).alias("latest")), key, "left").select(key, F.coalesce("n_runs", F.lit(0)).alias("n_runs"), "latest")


def suspicious(points: DataFrame, key: list[str], t: str, name: str, model: str, tie: list[str] = ()) -> DataFrame:
    """Points at which name and model both changed, both known before and after: the id may have been given to another product."""
    w = Window.partitionBy(*key).orderBy(t, *tie)
    old_name, old_model = F.lag(name).over(w), F.lag(model).over(w)
    return points.withColumn("suspicious", F.coalesce((old_name != F.col(name)) & (old_model != F.col(model)), F.lit(False)))


def primary_segment(segments: DataFrame, key: list[str], listed: str, last: str, basis: str) -> DataFrame:
    """One segment a key: listed now before not, then the last listed, then the least basis."""
    w = Window.partitionBy(*key).orderBy(F.col(listed).desc(), F.col(last).desc(), F.col(basis))
    return segments.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n")


def run_statistics(rows: DataFrame, key: list[str], run: str, state: list[str]) -> DataFrame:
    """(run, items, fresh, returned, changed): per run, entities seen, seen for the first time, seen again after a gap, and seen in another state than last time.

    rows has one row for each entity and run; runs are numbered without holes.
    """
    w = Window.partitionBy(*key).orderBy(run)
    last, before, now = F.lag(run).over(w), F.lag(F.struct(*state)).over(w), F.struct(*state)
    flags = rows.select(run, last.isNull().alias("fresh"), (last + 1 < F.col(run)).alias("returned"), (last.isNotNull() & ~before.eqNullSafe(now)).alias("changed"))
    return flags.groupBy(run).agg(F.count("*").alias("items"), *[F.count_if(c).alias(c) for c in ("fresh", "returned", "changed")])


def latest_summary(rows: DataFrame, key: list[str], run: str, order: list[str]) -> DataFrame:
    """(key, run, order...): of each key's latest run, its least row; combined before the shuffle."""
    return rows.groupBy(*key).agg(F.min_by(F.struct(run, *order), F.struct(-F.col(run), *order)).alias("__r")).select(*key, "__r.*")
