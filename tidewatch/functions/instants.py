"""Instants: parsing the log formats, buckets and ISO text. The session's time zone is UTC."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SYSLOG = r"(?U)^([A-Z][a-z]{2})\s+(\d{1,2})\s+(\d{2}:\d{2}:\d{2})"


def syslog(parts: Column, year: int) -> Column:
    """"Mon D HH:MM:SS" in the given year, of the parts that text.cut makes of a line by SYSLOG; null for a date that doesn't exist or without one."""
    some = F.concat_ws(" ", F.lit(f"{year:04d}"), *(F.get(parts, i) for i in range(3)))
    return F.when(F.size(parts) == 4, F.try_to_timestamp(some, F.lit("yyyy MMM d HH:mm:ss")))


def after_syslog(parts: Column) -> Column:
    return F.get(parts, 3)


def common_log(text: Column) -> Column:
    """"dd/Mon/yyyy:HH:MM:SS zone" with a zone as +HHMM or +HH:MM."""
    return F.try_to_timestamp(F.regexp_replace(text, r"([+-]\d{2}):(\d{2})$", "$1$2"), F.lit("dd/MMM/yyyy:HH:mm:ss Z"))


def iso(text: Column) -> Column:
    """ISO 8601 dates and times, extended or compact, with at most microseconds kept; without a zone UTC is meant."""
    t = F.regexp_replace(F.regexp_replace(text, r"(?U)^\s+|\s+$", ""), "[zZ]$", "+00:00")
    t = F.regexp_replace(t, r"^(\d{4})(\d{2})(\d{2})(?=$|[T ])", "$1-$2-$3")
    t = F.regexp_replace(t, r"([T ])(\d{2})(\d{2})(?:(\d{2}))?(?=$|[.,+-])", "$1$2:$3:$4")
    t = F.regexp_replace(F.regexp_replace(t, r":(?=$|[.,+-])", ":00"), r"([T ]\d{2}:\d{2}:\d{2}),", "$1.")
    t = F.regexp_replace(t, r"([T ].*[+-]\d{2})(\d{2})$", "$1:$2")
    return F.when(t.rlike(r"^\d{4}-\d{2}-\d{2}(?:[T ]\d{2}(?::\d{2}(?::\d{2}(?:\.\d+)?)?)?(?:[+-]\d{2}:\d{2}(?::\d{2})?)?)?$"), F.regexp_replace(t, r"^(\d{4}-\d{2}-\d{2}[T ]\d{2})(?=$|[+-])", "$1:00").try_cast("timestamp"))


def iso_text(t: Column) -> Column:
    """As Python's isoformat in UTC: microseconds only where there are any."""
    return F.concat(F.date_format(t, "yyyy-MM-dd'T'HH:mm:ss"), F.when(F.unix_micros(t) % 1_000_000 != 0, F.date_format(t, ".SSSSSS")).otherwise(""), F.lit("+00:00"))


def bucket(t: Column, seconds: int) -> Column:
    """The start of the epoch-aligned bucket that holds t."""
    us = seconds * 1_000_000
    return F.timestamp_micros(F.unix_micros(t) - F.pmod(F.unix_micros(t), F.lit(us)))
