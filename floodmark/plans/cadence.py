"""When loads are expected: slots on a zone's own clocks, as UTC instants."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field
from datetime import UTC, date, datetime, time, timedelta
from zoneinfo import ZoneInfo

from floodmark.functions.times import as_utc

KINDS, CALENDARS = ("times", "interval", "calendar_dates", "monthly"), ("EVERYDAY", "WEEKDAYS")


@dataclass(frozen=True)
class Cadence:
    """times: each day at each time; interval: every so many minutes from local midnight; calendar_dates: on listed dates;
    monthly: on listed days of the month, skipped where a month lacks them."""

    kind: str
    timezone: str = "UTC"
    times: list[str] = field(default_factory=list)
    interval_minutes: int | None = None
    dates: list[date] = field(default_factory=list)
    days_of_month: list[int] = field(default_factory=list)
    calendar: str = "EVERYDAY"


def _days(cadence: Cadence, first: date, last: date) -> Iterator[date]:
    if cadence.calendar not in CALENDARS:
        raise ValueError(f"calendar {cadence.calendar!r} isn't one of {', '.join(CALENDARS)}")
    for n in range((last - first).days + 1):
        day = first + timedelta(days=n)
        if cadence.kind == "calendar_dates":
            wanted = day in cadence.dates
        elif cadence.kind == "monthly":
            wanted = day.day in cadence.days_of_month
        else:
            wanted = cadence.calendar == "EVERYDAY" or day.weekday() < 5
        if wanted:
            yield day


def _times(cadence: Cadence) -> list[time]:
    if cadence.kind == "interval":
        return [time(*divmod(m, 60)) for m in range(0, 1440, cadence.interval_minutes)]
    return [time.fromisoformat(t) for t in cadence.times or ["00:00"]]


def slots(cadence: Cadence, start: datetime, end: datetime) -> list[datetime]:
    """Slots in [start, end), oldest first."""
    start, end, zone = as_utc(start), as_utc(end), ZoneInfo(cadence.timezone)
    if start >= end:
        return []
    days = _days(cadence, start.astimezone(zone).date() - timedelta(days=1), end.astimezone(zone).date() + timedelta(days=1))
    found = {datetime.combine(day, t, tzinfo=zone).astimezone(UTC) for day in days for t in _times(cadence)}
    return sorted(s for s in found if start <= s < end)


def previous_slot(cadence: Cadence, before: datetime) -> datetime | None:
    """The latest slot before an instant, sought 8, 63 and at last 740 days back."""
    before = as_utc(before)
    return next((found[-1] for back in (8, 63, 740) if (found := slots(cadence, before - timedelta(days=back), before))), None)


def slot_label(cadence: Cadence, slot: datetime) -> str:
    return as_utc(slot).astimezone(ZoneInfo(cadence.timezone)).strftime("%H:%M")
