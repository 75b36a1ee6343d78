"""Commit dates, written in many styles, as UTC instants."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The date styles of git's --date option that carry an offset,
# after the name of the day is removed.
GIT_FORMATS = (
    "yyyy-MM-dd'T'HH:mm:ss[.SSSSSS][.SSS]XXX",
    "yyyy-MM-dd'T'HH:mm:ssxx",
    "yyyy-MM-dd HH:mm:ss xx",
    "yyyy-MM-dd HH:mm:ssXXX",
    "MMM d HH:mm:ss yyyy xx",
    "d MMM yyyy HH:mm:ss xx",
)


def date_text(date: Column) -> Column:
    """A date string without the name of its day and with single blanks."""
    text = F.regexp_replace(F.trim(date), r"^(?:Mon|Tue|Wed|Thu|Fri|Sat|Sun),? +", "")
    return F.regexp_replace(text, r" {2,}", " ")


def instant_of(text: Column) -> Column:
    """The instant that a :func:`date_text` names, or null. ``text`` occurs many times in the result, so it had better be a column of its own."""
    raw = F.regexp_extract(text, r"^@?(\d{9,11}) [+-]\d{4}$", 1)
    parsed = [F.try_to_timestamp(text, F.lit(f)) for f in GIT_FORMATS]
    return F.coalesce(*parsed, F.when(raw != "", F.timestamp_seconds(raw.cast("bigint"))))


def to_instant(date: Column) -> Column:
    """The instant a date string names, or null.

    Accepts ISO 8601 with ``Z`` or an offset, and git's default, iso, rfc and raw
    styles. Text that names no real instant (words, impossible days, a day
    without a time, null, empty) gives null, never an error.
    """
    return instant_of(date_text(date))
