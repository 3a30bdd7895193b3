"""Timestamps, durations and number formatting as Columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MILLIS_PER_HOUR = 3_600_000


def parse_iso(text: Column) -> Column:
    """ISO-8601 text to a UTC timestamp; a trailing Z is accepted and anything else unreadable gives null."""
    return F.try_to_timestamp(F.regexp_replace(text, "Z$", "+00:00")).cast("timestamp_ntz")


def render_iso(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")


def micros(ts: Column) -> Column:
    return F.unix_micros(ts.cast("timestamp"))


def seconds_between(start: Column, end: Column) -> Column:
    return (micros(end) - micros(start)) / F.lit(1e6)


def hours_to_millis(hours: Column) -> Column:
    return hours * F.lit(MILLIS_PER_HOUR).cast("bigint")


def millis_to_hours(millis: Column) -> Column:
    return millis / F.lit(float(MILLIS_PER_HOUR))


def percent(ratio: Column, digits: int = 1) -> Column:
    return F.concat(F.format_number(ratio * 100, digits), F.lit("%"))


def gibibytes(size: Column) -> Column:
    return F.round(size / F.lit(float(1024 ** 3)), 2)


def epoch_in_name(name: Column, position: int = 2) -> Column:
    """The whole number between dashes at ``position`` of a name such as ``aged-topic-<epoch>-<i>``, or null."""
    parts = F.split(name, "-")
    return F.get(parts, F.lit(position)).try_cast("bigint")
