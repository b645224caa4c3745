"""Column helpers that carry the warehouse dialect's meaning into Spark.

Each helper fixes one rule that would otherwise change results silently
(NULL ordering, calendar-boundary differences, week starts, time-zone
conversion, lenient number parsing, NULL-skipping labels).
"""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column
from pyspark.sql import functions as F


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


# -- ordering: ascending puts NULL last, descending puts NULL first ----------

def asc(c: Column | str) -> Column:
    return col(c).asc_nulls_last()


def desc(c: Column | str) -> Column:
    return col(c).desc_nulls_first()


# -- calendar-boundary differences --------------------------------------------

def day_diff(start: Column | str, end: Column | str) -> Column:
    """Number of midnights crossed from ``start`` to ``end`` (23:00 -> 01:00 is 1)."""
    return F.datediff(F.to_date(col(end)), F.to_date(col(start)))


def month_diff(start: Column | str, end: Column | str) -> Column:
    """Number of month starts crossed (Jan 31 -> Feb 1 is 1)."""
    s, e = col(start), col(end)
    return (F.year(e) * 12 + F.month(e)) - (F.year(s) * 12 + F.month(s))


def epoch_seconds(c: Column | str) -> Column:
    """Whole seconds since 1970-01-01 00:00:00 of a TIMESTAMP_NTZ wall clock.

    Calendar arithmetic on the NTZ fields, so the session time zone (and its
    DST jumps) never enters.
    """
    x = col(c)
    days = F.datediff(F.to_date(x), F.lit("1970-01-01").cast("date")).cast("bigint")
    return days * 86400 + F.hour(x) * 3600 + F.minute(x) * 60 + F.second(x)


def second_diff(start: Column | str, end: Column | str) -> Column:
    """Number of whole-second boundaries crossed (.9 -> 1.1 is 1)."""
    return epoch_seconds(end) - epoch_seconds(start)


# -- dates and times ------------------------------------------------------------

def week_start(c: Column | str) -> Column:
    """Monday of the ISO week holding ``c``, as DATE (time zone free)."""
    d = F.to_date(col(c))
    return F.date_sub(d, (F.dayofweek(d) + 5) % 7)


def local_time(c: Column | str, tz: str) -> Column:
    """UTC wall clock (TIMESTAMP_NTZ) -> wall clock in ``tz`` (TIMESTAMP_NTZ)."""
    return F.convert_timezone(F.lit("UTC"), F.lit(tz), col(c))


def minute_start(c: Column | str) -> Column:
    """``c`` truncated to the minute, as TIMESTAMP_NTZ (time zone free)."""
    x = col(c)
    return F.make_timestamp_ntz(F.year(x), F.month(x), F.dayofmonth(x), F.hour(x), F.minute(x), F.lit(0))


# -- numbers and text -------------------------------------------------------------

def safe_number(c: Column | str) -> Column:
    """Lenient text -> integer: rounds '12.5' to 13, NULL for malformed text and beyond BIGINT."""
    return col(c).try_cast("decimal(38,0)").try_cast("bigint")


def labelled(prefix: str, *parts: Column | str) -> Column:
    """``prefix || parts`` or '' when any part is NULL."""
    return F.coalesce(F.concat(F.lit(prefix), *[col(p) for p in parts]), F.lit(""))


def ilike_any(c: Column | str, substrings) -> Column:
    """OR of ``c ILIKE '%s%'`` over ``substrings``."""
    return reduce(or_, [col(c).ilike(f"%{s}%") for s in substrings])


def money(c: Column | str) -> Column:
    return col(c).cast("decimal(18,2)")


def money_sum(c: Column | str) -> Column:
    return F.sum(col(c)).cast("decimal(38,2)")
