"""Dates, times and durations. Durations are microseconds in a ``BIGINT``; the session zone is UTC."""

from __future__ import annotations

import re

from pyspark.sql import Column, functions as F

# Duration units in microseconds.
UNITS_US = {
    "us": 1,
    "ms": 1_000,
    "s": 1_000_000,
    "m": 60_000_000,
    "h": 3_600_000_000,
    "d": 86_400_000_000,
}

_INTERVAL_WORDS = {
    "microsecond": "us", "millisecond": "ms", "second": "s", "minute": "m", "hour": "h", "day": "d",
}


def duration_us(text) -> int:
    """``'12 hours'``, ``'12h'`` or ``'1d 12h'`` in microseconds; numbers pass through."""
    if isinstance(text, int):
        return text
    total, rest = 0, text.strip()
    while rest:
        found = re.match(r"(\d+)\s*([A-Za-z]+)\s*", rest)
        if not found:
            raise ValueError(f"not a duration: {text!r}")
        word = found.group(2).lower()
        unit = word if word in UNITS_US else _INTERVAL_WORDS.get(word.rstrip("s"))
        if unit is None:
            raise ValueError(f"unknown unit in duration: {text!r}")
        total += int(found.group(1)) * UNITS_US[unit]
        rest = rest[found.end():]
    if total <= 0:
        raise ValueError(f"a duration must be positive: {text!r}")
    return total


def _col(value) -> Column:
    return value if isinstance(value, Column) else F.lit(value)


def ticks_us(ts: Column) -> Column:
    """Microseconds since the epoch."""
    return F.unix_micros(ts.cast("timestamp"))


def from_us(us: Column) -> Column:
    return F.timestamp_micros(us.cast("bigint"))


def parse_datetime(text: Column) -> Column:
    return F.try_to_timestamp(text)


def now(reference_time=None) -> Column:
    """The current time, or a fixed one for repeatable runs."""
    return F.current_timestamp() if reference_time is None else _col(reference_time).cast("timestamp")


def _shift(ts: Column, offset_us) -> Column:
    return from_us(ticks_us(ts) + _col(offset_us))


# Part names and the field each one reads.
PARTS = {
    "year": F.year,
    "month": F.month,
    "day": F.dayofmonth,
    "hour": F.hour,
    "minute": F.minute,
    "second": F.second,
    "millisecond": lambda t: F.floor((ticks_us(t) % 1_000_000) / 1_000),
    "weekday": lambda t: F.dayofweek(t) - 1,
    "dayofyear": F.dayofyear,
    "week": F.weekofyear,
}


def date_part(ts: Column, part: str, offset_us=0) -> Column:
    """One field of a timestamp at an offset from UTC; an unknown part is undefined."""
    read = PARTS.get(part.lower())
    return F.lit(None).cast("bigint") if read is None else read(_shift(ts, offset_us)).cast("bigint")


def offset_in(zone: str, ts: Column) -> Column:
    """Offset from UTC of ``zone`` at an instant, in microseconds."""
    return ticks_us(F.from_utc_timestamp(ts, zone)) - ticks_us(ts)


def to_iso_string(ts: Column, offset_us: int = 0) -> Column:
    """ISO-8601 text with seven fraction digits and ``Z`` or the offset."""
    minutes = abs(offset_us) // UNITS_US["m"]
    sign = "-" if offset_us < 0 else "+"
    zone = "Z" if offset_us == 0 else f"{sign}{minutes // 60:02d}:{minutes % 60:02d}"
    return F.concat(F.date_format(_shift(ts, offset_us), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"), F.lit("0" + zone))


def time_of_day(ts: Column, offset_hours: float = 0) -> Column:
    """Time since midnight at an offset, in microseconds."""
    day = UNITS_US["d"]
    shifted = ticks_us(ts) + int(offset_hours * UNITS_US["h"])
    return F.pmod(shifted, F.lit(day))


_TIMESPAN = r"\A(-)?(?:(\d+)\.)?(\d{1,2}):(\d{2})(?::(\d{2})(?:\.(\d{1,7}))?)?\z"


def parse_timespan(text: Column) -> Column:
    """``d.HH:mm:ss.f`` in microseconds; undefined for other text."""
    def group(i):
        return F.coalesce(F.regexp_extract(text, _TIMESPAN, i).try_cast("bigint"), F.lit(0))

    fraction = F.rpad(F.regexp_extract(text, _TIMESPAN, 6), 7, "0").try_cast("bigint")
    size = (group(2) * UNITS_US["d"] + group(3) * UNITS_US["h"] + group(4) * UNITS_US["m"]
            + group(5) * UNITS_US["s"] + F.floor(F.coalesce(fraction, F.lit(0)) / 10))
    valid = text.rlike(_TIMESPAN) & (group(3) < 24) & (group(4) < 60) & (group(5) < 60)
    return F.when(valid, F.when(F.regexp_extract(text, _TIMESPAN, 1) == "-", -size).otherwise(size)).cast("bigint")


def to_time_string(us: Column) -> Column:
    """The inverse of :func:`parse_timespan`; days and fraction appear only when present."""
    size = F.abs(us)

    def whole(unit, modulo=None):
        part = F.floor(size / UNITS_US[unit])
        return part if modulo is None else part % modulo

    days, fraction = whole("d"), size % UNITS_US["s"]
    clock = F.format_string("%02d:%02d:%02d", whole("h", 24), whole("m", 60), whole("s", 60))
    return F.when(us.isNotNull(), F.concat(
        F.when(us < 0, F.lit("-")).otherwise(F.lit("")),
        F.when(days > 0, F.concat(days.cast("string"), F.lit("."))).otherwise(F.lit("")),
        clock,
        F.when(fraction > 0, F.format_string(".%06d0", fraction)).otherwise(F.lit("")),
    ))


def total_milliseconds(duration: Column, text: bool = False) -> Column:
    """Milliseconds of a duration in microseconds, or of ``d.HH:mm:ss.f`` text."""
    return (parse_timespan(duration) if text else duration) / 1000.0
