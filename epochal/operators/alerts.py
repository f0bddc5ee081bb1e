"""What a run's reports ask for: verdicts, alerts to open, comment on or close, and reasons fit to print."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The length of a printed reason and how many of them are listed.
REASON_CHARS, REASONS = 300, 10


def printable(text: Column) -> Column:
    """One line without control characters, code marks or comment openers, cut to REASON_CHARS."""
    t = F.regexp_replace(text, r"[\u0000-\u001f\u007f-\u009f]", " ")
    t = F.trim(F.regexp_replace(F.regexp_replace(F.regexp_replace(t, "`", "'"), "<!--", "<! --"), r"\s+", " "))
    return F.when(F.char_length(t) > REASON_CHARS, F.concat(F.substring(t, 1, REASON_CHARS - 1), F.lit("…"))).otherwise(t)


def capped(reasons: Column, most: int = REASONS) -> Column:
    """The first reasons and how many more there are."""
    more = F.size(reasons) - (most - 1)
    return F.when(F.size(reasons) <= most, reasons).otherwise(F.concat(F.slice(reasons, 1, most - 1), F.array(F.concat(F.lit("… "), more.cast("string"), F.lit(" more")))))


def actions(verdicts: DataFrame, open_alerts: DataFrame, store: str) -> DataFrame:
    """(store, verdict, action): an alert opens one, or comments on the open one unless it was reported already; an observed store's open ones close."""
    a = open_alerts.select(store, F.lit(True).alias("__open"), F.col("reported").alias("__reported"))
    alert, is_open = F.col("verdict") == "alert", F.coalesce("__open", F.lit(False))
    action = F.when(alert & ~is_open, "create").when(alert & F.col("__reported"), "skip").when(alert, "comment").when((F.col("verdict") == "observed") & is_open, "close").otherwise("none")
    return verdicts.join(a, store, "left").select(store, "verdict", action.alias("action"))
