"""Timestamps from feed text, and ages."""

from pyspark.sql import Column
from pyspark.sql import functions as F

from storyloom.functions.text import strip, text_or_empty


def as_of_column(as_of) -> Column:
    """An ``as_of`` given as text, datetime or Column as a TIMESTAMP column."""
    if isinstance(as_of, Column):
        return as_of
    return F.lit(as_of).cast("timestamp")


def parse_ts(c) -> Column:
    """RFC 822 date, then ISO-8601; text without a zone is UTC, bad text NULL."""
    raw = strip(text_or_empty(c))
    no_day = F.regexp_replace(raw, r"^[A-Za-z]{3,9},?\s+(?=\d)", "")
    zone = F.regexp_replace(no_day, r"\s(GMT|UTC|UT|Z)$", " +0000")
    zoned = F.when(zone.rlike(r"[+-]\d{4}$"), zone).otherwise(F.concat(zone, F.lit(" +0000")))
    is_rfc = no_day.rlike(r"^\d{1,2}\s+[A-Za-z]{3}\s+\d{4}\s+\d{1,2}:\d{2}")
    has_seconds = no_day.rlike(r"\d{1,2}:\d{2}:\d{2}")
    rfc = F.when(
        has_seconds, F.try_to_timestamp(zoned, F.lit("d MMM yyyy H:mm:ss xx"))
    ).otherwise(F.try_to_timestamp(zoned, F.lit("d MMM yyyy H:mm xx")))
    is_iso = raw.rlike(r"^\d{4}-\d{2}-\d{2}([T ]\d{2}:\d{2}(:\d{2}(\.\d{1,9})?)?\s?(Z|[+-]\d{2}:?\d{2})?)?$")
    iso = F.regexp_replace(raw, r"([+-]\d{2})(\d{2})$", "$1:$2")
    return F.when(is_rfc, rfc).when(is_iso, F.try_to_timestamp(iso))


def age_minutes(ts, as_of) -> Column:
    as_of = as_of_column(as_of)
    return (F.unix_micros(as_of) - F.unix_micros(ts)) / F.lit(60000000.0)


def age_label(ts, as_of) -> Column:
    """Short age text for a reader."""
    ts = ts if isinstance(ts, Column) else F.col(ts)
    as_of = as_of_column(as_of)
    secs = F.floor((F.unix_micros(as_of) - F.unix_micros(ts)) / 1000000)
    mins, hours, days = F.floor(secs / 60), F.floor(secs / 3600), F.floor(secs / 86400)
    return (
        F.when(ts.isNull(), F.lit("Recent Dispatch"))
        .when(secs < 60, F.lit("Just now"))
        .when(mins < 60, F.concat(mins.cast("string"), F.lit("m ago")))
        .when(hours < 24, F.concat(hours.cast("string"), F.lit("h ago")))
        .when(days == 1, F.lit("Yesterday"))
        .when(days < 7, F.concat(days.cast("string"), F.lit("d ago")))
        .otherwise(F.date_format(ts, "MMM d"))
    )
