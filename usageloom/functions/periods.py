"""Reporting periods (F-02, F-03): one constructor per kind of period, pure date arithmetic."""

from __future__ import annotations

import calendar
import datetime as dt

from usageloom.model import Window

Day = dt.date | str


def as_day(day: Day) -> dt.date:
    """A date, also as text (``2026-07-22``; no other form of ISO dates)."""
    if isinstance(day, str):
        return dt.datetime.strptime(day, "%Y-%m-%d").date()
    return day


def monday_of(day: dt.date) -> dt.date:
    return day - dt.timedelta(days=day.weekday())


def between(first: Day, last: Day, project: str | None = None) -> Window:
    """All days from ``first`` to ``last``, both included."""
    first, last = as_day(first), as_day(last)
    if last < first:
        raise ValueError("a period cannot end before its first day")
    return Window(first, last, project, f"{first} — {last}")


def last_days(until: Day, n: int = 14, project: str | None = None) -> Window:
    """The ``n`` days up to ``until``."""
    if n < 1:
        raise ValueError("a period has at least one day")
    until = as_day(until)
    return between(until - dt.timedelta(days=n - 1), until, project)


def iso_week(day: Day, back: int = 0, project: str | None = None) -> Window:
    """The ISO week that lies ``back`` weeks before the one of ``day``; the week of ``day`` itself ends with it."""
    day = as_day(day)
    year, week, _ = (day - dt.timedelta(weeks=back)).isocalendar()
    whole = dt.date.fromisocalendar(year, week, 1), dt.date.fromisocalendar(year, week, 7)
    return between(whole[0], min(whole[1], day), project)


def month_of(day: Day, back: int = 0, project: str | None = None) -> Window:
    """The calendar month that lies ``back`` months before the one of ``day``; its own month ends with ``day``."""
    day = as_day(day)
    year, month0 = divmod(day.year * 12 + day.month - 1 - back, 12)
    length = calendar.monthrange(year, month0 + 1)[1]
    return between(dt.date(year, month0 + 1, 1), min(dt.date(year, month0 + 1, length), day), project)


#: Periods of a date picker, each made from the current day.
PRESETS = {
    "yesterday": lambda today: last_days(today - dt.timedelta(days=1), 1),
    "today": lambda today: last_days(today, 1),
    "7d": lambda today: last_days(today, 7),
    "month": month_of,
    "last-month": lambda today: month_of(today, back=1),
}
