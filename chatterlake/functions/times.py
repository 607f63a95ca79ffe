"""Time parsing. All times are zone-less UTC (TIMESTAMP_NTZ)."""

from __future__ import annotations

from datetime import date, datetime

from pyspark.sql import Column
from pyspark.sql import functions as F

_OFFSET = r"(Z|[+-]\d{2}:?\d{2})$"
_NUMBER = r"^[+-]?\d+(\.\d+)?([eE][+-]?\d+)?$"
_DAY = r"^\d{8}$"


def ntz(value: str | datetime) -> Column:
    return F.lit(str(value)).cast("timestamp_ntz")


def day(value: str | date) -> Column:
    return F.lit(str(value)).cast("date")


def _EPOCH() -> Column:
    return ntz("1970-01-01 00:00:00")


def to_utc(stamp: Column) -> Column:
    """Zoned timestamp to UTC wall clock, whatever zone the session uses."""
    micros = F.unix_micros(stamp)
    days, rest = F.floor(micros / 86_400_000_000), F.pmod(micros, F.lit(86_400_000_000))
    return _EPOCH() + F.make_dt_interval(
        days=days.cast("int"), secs=rest.cast("decimal(18,6)") / F.lit(1_000_000))


def epoch_micros(stamp: Column) -> Column:
    """Microseconds since the epoch of a zone-less UTC time."""
    return F.timestamp_diff("MICROSECOND", ntz("1970-01-01 00:00:00"), stamp)


def instant(stamp: Column) -> Column:
    """Zone-less UTC time as an instant, as watermarks need it."""
    return F.timestamp_micros(epoch_micros(stamp))


def epoch_to_ntz(seconds: Column) -> Column:
    """Epoch seconds to UTC; zero, negative and non-numeric give NULL."""
    s = seconds.try_cast("decimal(18,6)")
    return F.when(s > 0, ntz("1970-01-01 00:00:00") + F.make_dt_interval(secs=s))


def compact_day(text: Column) -> Column:
    """yyyyMMdd to a date; anything that is not a real day gives NULL."""
    return F.when(text.rlike(_DAY), F.try_to_date(text, "yyyyMMdd"))


def parse_posted_at(text: Column) -> Column:
    """Mixed payload time to UTC.

    Eight digits are a day, other numbers are epoch seconds, the rest is ISO 8601
    with or without an offset. Malformed values become NULL and never stop a job.
    """
    return (
        F.when(text.rlike(_DAY), compact_day(text).cast("timestamp_ntz"))
        .when(text.rlike(_NUMBER), epoch_to_ntz(text))
        .when(text.rlike(_OFFSET), to_utc(text.try_cast("timestamp")))
        .otherwise(text.try_cast("timestamp_ntz"))
    )


def iso_utc(stamp: Column) -> Column:
    return F.concat(F.date_format(stamp, "yyyy-MM-dd'T'HH:mm:ss"), F.lit("+00:00"))


def duration_days(start: Column, end: Column) -> Column:
    return F.datediff(end, start)


def in_closed_range(d: Column, start: Column, end: Column) -> Column:
    return d.between(start, end)
