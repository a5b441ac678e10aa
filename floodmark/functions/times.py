"""Time columns read as UTC, whatever zone and format they are stored in."""

from __future__ import annotations

from dataclasses import dataclass
from datetime import UTC, datetime, timedelta
from zoneinfo import ZoneInfo

from pyspark.sql import Column
from pyspark.sql import functions as F

#: How far a zone's local time can be from UTC, and a clock change within it: bounds on stored values are widened by this.
WIDEST = timedelta(days=1)
GRAINS = ("second", "minute", "hour", "day")


@dataclass(frozen=True)
class TimeColumn:
    """A column, its pattern if it is text, how coarse it is written, and its zone."""

    column: str
    format: str | None = None
    granularity: str | None = None
    timezone: str | None = None

    def zone(self, default: str = "UTC") -> str:
        return self.timezone or default


def utc(time: TimeColumn, default_zone: str = "UTC") -> Column:
    """The column as a UTC timestamp; what can't be parsed is null, under ANSI mode too."""
    raw = F.col(time.column)
    local = F.try_to_timestamp(raw.cast("string"), F.lit(time.format)) if time.format else F.expr(f"try_cast(`{time.column}` AS TIMESTAMP)")
    return F.to_utc_timestamp(local, time.zone(default_zone))


def as_utc(value: datetime) -> datetime:
    """Aware and in UTC; a naive value is UTC already."""
    return value.replace(tzinfo=UTC) if value.tzinfo is None else value.astimezone(UTC)


def stamp(value: datetime) -> Column:
    """A UTC timestamp literal, whatever the process's own zone."""
    return F.lit(as_utc(value).strftime("%Y-%m-%d %H:%M:%S.%f")).cast("timestamp_ntz").cast("timestamp")


def within(value: Column, start: datetime, end: datetime) -> Column:
    """[start, end)."""
    return (value >= stamp(start)) & (value < stamp(end))


def loaded_within(time: TimeColumn, start: datetime, end: datetime, default_zone: str = "UTC") -> Column:
    """Rows whose UTC time lies in [start, end). A column stored as a timestamp is bounded as stored too, a day wider on
    either side, so that the scan can skip files and row groups; the exact condition stays."""
    exact = within(utc(time, default_zone), start, end)
    if time.format:
        return exact
    bound = lambda t: F.lit(as_utc(t).strftime("%Y-%m-%d %H:%M:%S")).cast("timestamp_ntz")
    return (F.col(time.column) >= bound(start - WIDEST)) & (F.col(time.column) < bound(end + WIDEST)) & exact


def truncate(value: datetime, granularity: str | None, zone: str) -> datetime:
    """Floor of a UTC time, counted on the clocks of its own zone."""
    value = as_utc(value)
    if granularity is None:
        return value
    if granularity not in GRAINS:
        raise ValueError(f"unknown granularity {granularity!r}")
    finer = {"second": {}, "minute": {"second": 0}, "hour": {"minute": 0, "second": 0}, "day": {"hour": 0, "minute": 0, "second": 0}}
    return value.astimezone(ZoneInfo(zone)).replace(microsecond=0, **finer[granularity]).astimezone(UTC)


def truncated(value: Column, granularity: str, zone: str) -> Column:
    """The same for a column of UTC timestamps."""
    return F.to_utc_timestamp(F.date_trunc(granularity, F.from_utc_timestamp(value, zone)), zone)
