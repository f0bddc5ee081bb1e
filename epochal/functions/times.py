"""Times are epoch milliseconds inside and ISO text with an explicit offset at the edges."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

DAY_MS = 86_400_000
# The first day that observation days are counted from, and the range of years that times must lie in.
DAY_ZERO_MS = 1_789_070_400_000
LEAST_MS, MOST_MS = 946_684_800_000, 4_102_444_800_000
_ISO = r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}(\.\d{1,9})?(Z|[+-]\d{2}:\d{2})$"


def epoch_ms(ts: Column) -> Column:
    """Milliseconds of a time without a zone, read as UTC whatever the session's zone is."""
    return F.timestamp_diff("MILLISECOND", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"), ts)


def to_iso(ms: Column) -> Column:
    """`2026-01-01T00:00:00.000Z`, from plain arithmetic, so that no session zone enters."""
    days = F.floor(ms / DAY_MS).cast("int")
    left = ms - days.cast("long") * DAY_MS
    part = lambda div, mod, n: F.lpad((F.floor(left / div) % mod).cast("string"), n, "0")
    date = F.date_add(F.lit("1970-01-01").cast("date"), days)
    return F.concat(date.cast("string"), F.lit("T"), part(3_600_000, 24, 2), F.lit(":"), part(60_000, 60, 2), F.lit(":"), part(1_000, 60, 2), F.lit("."), part(1, 1000, 3), F.lit("Z"))


def parse_iso(text: Column) -> Column:
    """Milliseconds, or null: the offset must be written, fractions below a millisecond are cut off."""
    t = F.when(text.rlike(_ISO), text)
    wall = F.concat_ws(" ", F.substring(t, 1, 10), F.substring(t, 12, 8))
    whole = epoch_ms(F.try_to_timestamp(wall, F.lit("yyyy-MM-dd HH:mm:ss")).cast("timestamp_ntz"))
    ms = F.rpad(F.substring(F.regexp_extract(t, r"\.(\d+)", 1), 1, 3), 3, "0").cast("long")
    sign = F.when(F.regexp_extract(t, r"([+-])\d{2}:\d{2}$", 1) == "-", -1).otherwise(1)
    zone = F.regexp_extract(t, r"[+-](\d{2}):\d{2}$", 1)
    minutes = F.when(zone != "", zone.cast("long") * 60 + F.regexp_extract(t, r"[+-]\d{2}:(\d{2})$", 1).cast("long")).otherwise(0)
    return whole + F.coalesce(F.when(t.contains("."), ms), F.lit(0)) - sign * minutes * 60_000


def observation_day(ms: Column) -> Column:
    return F.floor((ms - DAY_ZERO_MS) / DAY_MS).cast("long")


def utc_day(ms: Column) -> Column:
    return F.date_add(F.lit("1970-01-01").cast("date"), F.floor(ms / DAY_MS).cast("int"))


def is_valid_ms(ms: Column) -> Column:
    return F.coalesce((ms >= LEAST_MS) & (ms < MOST_MS), F.lit(False))
