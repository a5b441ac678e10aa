"""Events, evaluations and windows: which span of loads a check speaks of, and what names its results."""

from __future__ import annotations

import hashlib
from dataclasses import dataclass
from datetime import datetime, timedelta

from floodmark.functions.times import TimeColumn, as_utc, truncate

GAP = "WINDOW_GAP"


def digest(*parts: str) -> str:
    return hashlib.sha256("|".join(parts).encode()).hexdigest()


@dataclass(frozen=True)
class Event:
    """A dataset's loads in [start, end), UTC."""

    dataset: str
    start: datetime
    end: datetime

    @property
    def event_id(self) -> str:
        return digest(self.dataset, as_utc(self.start).isoformat(), as_utc(self.end).isoformat())


def evaluation_id(event_id: str, check_id: str, expectation_version: int, engine_version: str, groups: dict[str, str | None] | None = None) -> str:
    """Groups in order of their names, a null value as nothing."""
    listed = ",".join(f"{k}={groups[k] or ''}" for k in sorted(groups or {}))
    return digest(event_id, check_id, str(expectation_version), engine_version, listed)


@dataclass(frozen=True)
class History:
    """Where a dataset's windows stand; see store.views.window_history."""

    previous_end: datetime | None = None
    held_start: datetime | None = None
    first_held_end: datetime | None = None
    last_held_end: datetime | None = None
    held_by: tuple[str, ...] = ()


def fixed(dataset: str, start: datetime, end: datetime, load_time: TimeColumn | None, zone: str) -> Event:
    """A window with bounds on the load time's grain; never backwards."""
    grain, tz = (load_time.granularity, load_time.zone(zone)) if load_time else (None, "UTC")
    start, end = truncate(start, grain, tz), truncate(end, grain, tz)
    return Event(dataset, min(start, end), end)


def next_window(dataset: str, run_start: datetime, previous_end: datetime | None, settle: timedelta, lookback: timedelta, load_time: TimeColumn | None, zone: str, delay: timedelta = timedelta()) -> Event:
    end = as_utc(run_start) - settle - delay
    return fixed(dataset, previous_end or end - lookback, end, load_time, zone)


def release(history: History, dataset: str, window_end: datetime, longest: timedelta) -> tuple[datetime | None, Event | None]:
    """Where the window starts from, and the span given up, if any. A hold ends when `longest` has passed since the first held
    event's end; a first window that is held starts again where it started."""
    begin = history.previous_end or history.held_start
    if history.first_held_end is None:
        return history.previous_end, None
    if as_utc(window_end) - as_utc(history.first_held_end) < longest:
        return begin, None
    return history.last_held_end, Event(dataset, begin, history.last_held_end)


def replay(dataset: str, start: datetime, end: datetime, recorded: list[tuple[datetime, datetime]], load_time: TimeColumn | None, zone: str) -> list[Event]:
    """Recorded windows of [start, end) as they were, the longest of those with the same start, and what they leave open."""
    longest: dict[datetime, datetime] = {}
    for a, b in recorded:
        longest[as_utc(a)] = max(as_utc(b), longest.get(as_utc(a), as_utc(b)))
    out, at = [], as_utc(start)
    for a in sorted(longest):
        if a >= at:
            if a > at:
                out.append(fixed(dataset, at, a, load_time, zone))
            out.append(Event(dataset, a, longest[a]))
            at = longest[a]
    if at < as_utc(end):
        out.append(fixed(dataset, at, end, load_time, zone))
    return [e for e in out if e.start < e.end]
