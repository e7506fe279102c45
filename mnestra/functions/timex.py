"""What a query says about time, as a window of whole days (UTC)."""

from __future__ import annotations

import calendar
import datetime as dt
import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

DAY_MS = 86_400_000

#: Phrases in the order in which they are tried, with the period they name.
PERIODS = (
    (("지지난 주말", "지지난주말"), "weekend", 2),
    (("last weekend", "지난 주말", "지난주말", "저번 주말"), "weekend", 1),
    (("day before yesterday", "그저께", "그제"), "day", -2),
    (("yesterday", "어제"), "day", -1),
    (("today", "오늘"), "day", 0),
    (("tomorrow", "내일"), "day", 1),
    (("couple of days ago", "couple days ago"), "days", (-3, -1)),
    (("few days ago", "며칠 전", "몇 일 전"), "days", (-5, -2)),
    (("지지난 주", "지지난주"), "week", -2),
    (("last week", "지난주", "지난 주", "저번주", "저번 주"), "week", -1),
    (("this week", "이번 주", "이번주", "금주"), "week", 0),
    (("next week", "다음 주", "다음주", "담주"), "week", 1),
    (("couple of weeks ago", "couple weeks ago"), "days", (-21, -7)),
    (("few weeks ago", "몇 주 전"), "days", (-35, -14)),
    (("지지난 달", "지지난달"), "month", -2),
    (("last month", "지난달", "지난 달", "저번달", "저번 달"), "month", -1),
    (("this month", "이번 달", "이번달", "금월"), "month", 0),
    (("next month", "다음 달", "다음달"), "month", 1),
    (("couple of months ago", "couple months ago"), "days", (-90, -30)),
    (("few months ago", "몇 달 전", "몇 개월 전"), "days", (-150, -60)),
    (("재작년", "지지난해", "지지난 해"), "year", -2),
    (("last year", "작년", "지난해", "지난 해"), "year", -1),
    (("this year", "올해", "금년"), "year", 0),
)
#: Words that make a time recur, bound it above or bound it below.
RECURRING = ("매일", "매주", "매달", "매월", "매년", "격일", "격주", "날마다", "주마다", "달마다", "해마다")
UNITS = ("day", "days", "week", "weeks", "weekend", "month", "months", "year", "years", "morning", "evening", "night", "monday", "tuesday", "wednesday", "thursday", "friday", "saturday", "sunday")
BEFORE = (("before", "until", "up to"), ("이전", "까지"))
SINCE = (("since", "after"), ("부터", "이후"))
#: Phrases of a fact in the order in which they are tried, with their offset in days.
RELATIVE_DAYS = (
    ("last night", -1), ("yesterday", -1), ("today", 0), ("this morning", 0), ("this afternoon", 0), ("this evening", 0), ("tonight", 0), ("tonigt", 0),
    ("tomorrow", 1), ("last week", -7), ("this week", 0), ("next week", 7), ("last month", -30), ("this month", 0), ("next month", 30),
)

_RECURS = re.compile(rf"(?:{'|'.join(RECURRING)})|(?<!\w)(?:every|each)(?!\w)\s*(?:{'|'.join(UNITS)})(?!\w)")
_ISO = re.compile(r"(\d{4})-(\d{2})-(\d{2})(?:[T ]\d{2}:\d{2}(?::\d{2}(?:\.\d+)?)?(Z|[+-]\d{2}:?\d{2})?)?$")
_KOREAN = re.compile(r"(?:(?<!\d)(\d{4})\s*년\s*)?(?<!\d)(\d{1,4})\s*월\s*(\d{1,4})\s*일")


def _phrase(phrase: str) -> re.Pattern:
    return re.compile(rf"(?<!\w){re.escape(phrase)}(?!\w)" if phrase.isascii() else re.escape(phrase))


_PERIODS = [([_phrase(p) for p in phrases], kind, n) for phrases, kind, n in PERIODS]


def period(kind: str, n, today: dt.date) -> tuple[dt.date, dt.date]:
    """First and last day of a named period."""
    day = dt.timedelta(days=1)
    if kind == "day":
        return today + n * day, today + n * day
    if kind == "days":
        return today + n[0] * day, today + n[1] * day
    if kind == "week":
        monday = today + (7 * n - today.weekday()) * day
        return monday, monday + 6 * day
    if kind == "weekend":
        back = (today.weekday() + 2) % 7 or 7
        saturday = today - (back + 7 * (n - 1)) * day
        return saturday, saturday + day
    months = today.year * 12 + (today.month - 1 + n if kind == "month" else 12 * n)
    year, month = divmod(months, 12)
    last = month if kind == "month" else 11
    return dt.date(year, month + 1, 1), dt.date(year, last + 1, calendar.monthrange(year, last + 1)[1])


def _written_day(query: str, today: dt.date) -> dt.date | None:
    for word in query.split():
        bare = re.sub(r"^[^\w+:-]+|[^\w+:-]+$", "", word)
        found = _ISO.match(bare)
        if found:
            try:
                if "T" not in bare:
                    return dt.date(*map(int, found.groups()[:3]))
                at = dt.datetime.fromisoformat(bare)
                return (at.astimezone(dt.timezone.utc) if at.tzinfo else at).date()
            except ValueError:
                continue
    for year, month, day in _KOREAN.findall(query):
        for back in (0,) if year else range(5):  # without a year, the latest that is past
            try:
                at = dt.date(int(year) if year else today.year - back, int(month), int(day))
            except ValueError:
                continue
            if year or at <= today:
                return at
    return None


def window(query: str | None, now_ms: int) -> tuple[str | None, int | None, int | None]:
    """(kind, first, last millisecond): kind is ``range``, ``unconstrainable`` or null."""
    if query is None:
        return None, None, None
    today = dt.datetime.fromtimestamp(now_ms // 1000, dt.timezone.utc).date()
    start_of = lambda d: (d - dt.date(1970, 1, 1)).days * DAY_MS
    lower = query.lower()
    if _RECURS.search(lower):
        return "unconstrainable", None, None
    for phrases, kind, n in _PERIODS:
        found = next((m for p in phrases if (m := p.search(lower))), None)
        if not found:
            continue
        head, tail = lower[: found.start()].rstrip(), lower[found.end() :].lstrip()
        marked = lambda words: bool(re.search(rf"(?<!\w)(?:{'|'.join(words[0])})$", head)) or tail.startswith(words[1])  # noqa: E731, B023
        if marked(BEFORE):
            return "unconstrainable", None, None
        first, last = period(kind, n, today)
        if marked(SINCE):
            return ("unconstrainable", None, None) if start_of(first) > now_ms else ("range", start_of(first), start_of(today) + DAY_MS - 1)
        return "range", start_of(first), start_of(last) + DAY_MS - 1
    day = _written_day(query, today)
    return ("range", start_of(day), start_of(day) + DAY_MS - 1) if day else (None, None, None)


def query_window(text: Column, now_ms: int) -> Column:
    """struct(kind, first_ms, last_ms) of a query text; Arrow batches over the (small) table of queries."""

    @F.pandas_udf("kind string, first_ms long, last_ms long")
    def run(texts: pd.Series) -> pd.DataFrame:
        found = pd.DataFrame([window(t, now_ms) for t in texts], columns=["kind", "first_ms", "last_ms"])
        return found.astype({"first_ms": "Int64", "last_ms": "Int64"})

    return run(text)


def relative_day(text: Column, event_ms: Column) -> Column:
    """Midnight of the day that a fact's relative phrase names, counted from its event date; null without either."""
    lower = F.lower(text)
    offset = None
    for phrase, days in RELATIVE_DAYS:
        hit = lower.rlike(rf"(?U)(?<!\w){phrase}(?!\w)")
        offset = F.when(hit, days) if offset is None else offset.when(hit, days)
    return (F.floor(event_ms / F.lit(DAY_MS)) + offset) * F.lit(DAY_MS)


def iso_ms(text: Column) -> Column:
    """An instant, a date and time without zone (UTC) or a date (midnight) as milliseconds; else null."""
    return F.floor(F.unix_micros(F.try_to_timestamp(F.trim(text))) / 1000)
