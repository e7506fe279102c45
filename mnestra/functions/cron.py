"""Schedules of five fields (minute, hour, day of month, month, day of week)."""

from __future__ import annotations

import datetime as dt
import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

_PART = re.compile(r"(?:(\*)|(\d+)(?:-(\d+))?)(?:/(\d+))?$")
_FIELDS = ((0, 59), (0, 23), (1, 31), (1, 12), (0, 7))
MAX_DAYS_BACK = 366 * 5


def parse(expression: str | None) -> tuple[list[set[int]], bool, bool] | None:
    """Sets of the values of each field, and whether the day fields are restricted; null if it is no schedule."""
    fields = (expression or "").split()
    if len(fields) != 5:
        return None
    out = []
    for field, (low, high) in zip(fields, _FIELDS):
        values: set[int] = set()
        for part in field.split(","):
            found = _PART.match(part.strip())
            if not found:
                return None
            star, first, last, step = found.groups()
            lo = low if star else int(first)
            hi = high if star or (step and not last) else int(last or first)
            if not low <= lo <= hi <= high or (step and int(step) < 1):
                return None
            values.update(range(lo, hi + 1, int(step or 1)))
        out.append(values)
    out[4] = {0 if d == 7 else d for d in out[4]}
    return out, fields[2] != "*", fields[4] != "*"


def previous_fire(expression: str | None, now_ms: int) -> int | None:
    """The latest time at or before now at which the schedule fires, in milliseconds."""
    parsed = parse(expression)
    if parsed is None:
        return None
    (minutes, hours, days, months, weekdays), by_day, by_weekday = parsed
    times = sorted((h * 60 + m for h in hours for m in minutes), reverse=True)
    now = dt.datetime.fromtimestamp(now_ms // 1000, dt.timezone.utc)
    for back in range(MAX_DAYS_BACK):
        day = now.date() - dt.timedelta(days=back)
        in_days, in_week = day.day in days, (day.weekday() + 1) % 7 in weekdays
        if day.month not in months or not ((in_days or in_week) if by_day and by_weekday else (in_days and in_week)):
            continue
        latest = now.hour * 60 + now.minute if back == 0 else 24 * 60
        at = next((t for t in times if t <= latest), None)
        if at is not None:
            return ((day - dt.date(1970, 1, 1)).days * 1440 + at) * 60_000
    return None


def is_due(expression: Column, last_refreshed: Column, now_ms: int) -> Column:
    """Whether a schedule has fired since the last refresh; never refreshed is due, no schedule is not."""

    @F.pandas_udf("boolean")
    def run(expressions: pd.Series, refreshed: pd.Series) -> pd.Series:
        fired: dict[str | None, tuple[bool, int | None]] = {}
        out = []
        for e, r in zip(expressions, refreshed):
            if e not in fired:
                fired[e] = (parse(e) is not None, previous_fire(e, now_ms))
            valid, at = fired[e]
            out.append(valid and (pd.isna(r) or (at is not None and at > r)))
        return pd.Series(out, dtype=bool)

    return run(expression, last_refreshed)
