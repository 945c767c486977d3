"""Column expressions for times."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The bins of a day, [from, to) in hours.
BINS = ((0, 6), (6, 12), (12, 18), (18, 24))
DATE_PATTERNS = ("yyyy-MM-dd", "yyyy/MM/dd")
#: Patterns of dates whose form isn't known, the likelier first; a day before a month only with dashes or dots.
ANY_DATE = (*DATE_PATTERNS, "yyyy-M-d", "dd-MM-yyyy", "dd.MM.yyyy", "M/d/yyyy", "yyyyMMdd", "d MMM yyyy", "MMM d, yyyy", "yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd'T'HH:mm:ss")


def parse_date(c: Column, patterns: Sequence[str] = DATE_PATTERNS) -> Column:
    """The first pattern that fits, else null."""
    return F.coalesce(*(F.try_to_timestamp(c, F.lit(p)).cast("date") for p in patterns))


def parse_any_date(c: Column) -> Column:
    """A date in one of many forms, else null."""
    return parse_date(c, ANY_DATE)


def parse_time(c: Column, pattern: str = "yyyy-MM-dd HH:mm:ss") -> Column:
    """A time of the given form, else null; with H in place of HH an hour may have one digit."""
    return F.try_to_timestamp(c, F.lit(pattern))


def hour_bin(hour: Column) -> Column:
    """0-6, 6-12, 12-18, 18-24 or unknown."""
    out = F.lit("unknown")
    for a, b in reversed(BINS):
        out = F.when((hour >= a) & (hour < b), f"{a}-{b}").otherwise(out)
    return out


def epoch(c: Column) -> Column:
    """Seconds since 1970; also for times without a zone, which count as UTC where the session's zone is."""
    return c.cast("timestamp").cast("long")


def minutes_apart(a: Column, b: Column, wrap_midnight: bool = False) -> Column:
    """Minutes between two times of day. By default their plain difference; with wrap_midnight the shorter way round."""
    apart = F.abs(epoch(a) - epoch(b)) / 60
    return F.least(apart, F.lit(1440.0) - apart) if wrap_midnight else apart
