"""Time buckets in IANA zones.

Day and longer buckets start at the zone's first such instant; hours keep their members' own offset, so the
two hours of an autumn night stay apart.  Where a bucket's local start comes twice, the later is taken.
"""

from __future__ import annotations

import re
import zoneinfo

from pyspark.sql import Column
from pyspark.sql import functions as F

from siltstone.types import UNITS, EngineError

#: Zone names that are also abbreviations, and refused; fixed values.
REFUSED = frozenset("CET EET MET WET EST MST HST PST CST EDT CDT MDT PDT EST5EDT CST6CDT MST7MDT PST8PDT".split())
_UTC = frozenset("UTC UCT Zulu GMT Etc/UTC".split())


def resolve(zone: str) -> str:
    if zone in _UTC:
        return "Etc/UTC"
    if zone in REFUSED or not re.fullmatch(r"[A-Za-z]+(?:[/_+-][A-Za-z0-9]+)*", zone):
        raise EngineError("INVALID_ARGUMENT", f"{zone} is no IANA zone")
    try:
        zoneinfo.ZoneInfo(zone)
    except (zoneinfo.ZoneInfoNotFoundError, ValueError):
        raise EngineError("INVALID_ARGUMENT", f"{zone} is no IANA zone") from None
    return zone


def _micros(c: Column) -> Column:
    return F.unix_micros(c)


def local_start(ts: Column, unit: str, zone: str) -> Column:
    """The bucket's start by the zone's clock; for days and longer it names the bucket."""
    return F.date_trunc(unit, F.from_utc_timestamp(ts, F.lit(resolve(zone))))


def utc_start(local: Column, zone: str) -> Column:
    """The instant of a local start; where it comes twice, the later, and where it is skipped, what the clock goes on with."""
    zone = F.lit(resolve(zone))
    utc = F.to_utc_timestamp(local, zone)
    for minutes in (30, 60):
        later = utc + F.expr(f"INTERVAL {minutes} MINUTES")
        utc = F.when(F.from_utc_timestamp(later, zone) == local, later).otherwise(utc)
    return utc


def bucket(ts: Column, unit: str, zone: str) -> Column:
    """The bucket's start as a timestamp, the session's zone being UTC."""
    if unit not in UNITS:
        raise EngineError("INVALID_ARGUMENT", f"{unit} is no unit")
    start = local_start(ts, unit, zone)
    if unit == "hour":
        return F.timestamp_micros(_micros(start) - (_micros(F.from_utc_timestamp(ts, F.lit(resolve(zone)))) - _micros(ts)))
    return utc_start(start, zone)


def _clock(ts: Column) -> Column:
    """A timestamp to the second, with the year as the calendar counts it: 0000, and a sign and six digits beyond four."""
    year = F.year(ts)
    digits = F.when(year.between(0, 9999), F.format_string("%04d", year)).otherwise(F.concat(F.when(year < 0, "-").otherwise("+"), F.format_string("%06d", F.abs(year))))
    return F.concat(digits, F.date_format(ts, "-MM-dd'T'HH:mm:ss"))


def label(start: Column) -> Column:
    """The UTC start as an instant."""
    return F.concat(_clock(start), F.lit("Z"))


def local_label(start: Column, zone: str) -> Column:
    """The local start with its offset, in seconds where the zone's offset has some."""
    local = F.from_utc_timestamp(start, F.lit(resolve(zone)))
    offset = (F.unix_seconds(local) - F.unix_seconds(start)).cast("int")
    size = F.abs(offset)
    hours = F.format_string("%s%02d:%02d", F.when(offset < 0, "-").otherwise("+"), F.floor(size / 3600).cast("int"), F.floor(size / 60).cast("int") % 60)
    return F.concat(_clock(local), hours, F.when(size % 60 > 0, F.format_string(":%02d", size % 60)).otherwise(""))
