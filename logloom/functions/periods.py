"""Named time periods, resolved on the driver to literals so that scans can push them down."""

from __future__ import annotations

from datetime import datetime, timedelta

WEEKDAYS = ("Monday", "Tuesday", "Wednesday", "Thursday", "Friday", "Saturday", "Sunday")
LAST_HOURS = (1, 2, 3, 6, 8, 12, 16, 24)


def _month(start: datetime, by: int) -> datetime:
    months = start.year * 12 + start.month - 1 + by
    return start.replace(year=months // 12, month=months % 12 + 1)


def resolve(name: str, now: datetime) -> tuple[datetime | None, datetime | None, timedelta | None]:
    """(start, end, last) of a period: bounds are inclusive, last reaches back from now."""
    hour = now.replace(minute=0, second=0, microsecond=0)
    day = hour.replace(hour=0)
    month = day.replace(day=1)
    quarter = _month(month, -((month.month - 1) % 3))
    fixed = {
        "PastHour": (hour - timedelta(hours=1), hour), "CurrentHour": (hour, hour + timedelta(hours=1)),
        "PastDay": (day - timedelta(days=1), day), "Yesterday": (day - timedelta(days=1), day), "CurrentDay": (day, day + timedelta(days=1)), "Today": (day, day + timedelta(days=1)),
        "PastMonth": (_month(month, -1), month), "CurrentMonth": (month, _month(month, 1)), "PastQuarter": (_month(quarter, -3), quarter), "CurrentQuarter": (quarter, _month(quarter, 3)),
        "Everything": (None, None),
    }
    if name in fixed:
        return (*fixed[name], None)
    for n in (3, 7, 14):
        if name == f"Last{n}Days":
            return day - timedelta(days=n), None, None
    for n in LAST_HOURS:
        if name in (f"Last{n}Hours", f"Last{n}Hour"):
            return None, None, timedelta(hours=n)
    for i, weekday in enumerate(WEEKDAYS):
        if name == f"TillLast{weekday}":  # keeps the time of day; the same weekday is today
            return now - timedelta(days=(now.weekday() - i) % 7), None, None
    raise ValueError(f"unknown period {name!r}")


def bounds(name: str, now: datetime) -> tuple[datetime | None, datetime | None]:
    """(start, end) with a relative period turned into a start."""
    start, end, last = resolve(name, now)
    return (now - last if last else start), end
