"""Dates as ISO strings: spans, validation, and dates told in Vietnamese phrases. 'today' is always passed in."""

from __future__ import annotations

import calendar
import re
import unicodedata
from datetime import UTC, date, datetime, timedelta
from zoneinfo import ZoneInfo

from pyspark.sql import Column
from pyspark.sql import functions as F

FIRST, LAST = "0000-01-01", "9999-12-31"


def is_iso_date(s: str) -> bool:
    try:
        return bool(re.fullmatch(r"\d{4}-\d{2}-\d{2}", s, re.ASCII)) and bool(date.fromisoformat(s))
    except ValueError:
        return False


def now_in(zone: str, moment: datetime | None = None) -> tuple[str, str]:
    """(date, HH:MM) of a moment, or of this one, in a time zone."""
    local = (moment or datetime.now(UTC)).astimezone(ZoneInfo(zone))
    return local.date().isoformat(), local.strftime("%H:%M")


def months_back(day: date, months: int) -> date:
    """A day number past the month's end runs over into the next month (Mar 31 less one month is Mar 3)."""
    total = day.year * 12 + day.month - 1 - months
    first = date(total // 12, total % 12 + 1, 1)
    return first + timedelta(days=day.day - 1)


def parse_since(value: str, today: date) -> tuple[str, str] | None:
    """(from, to) for '7d', '2w', '3m', '1y' or an ISO start."""
    if m := re.fullmatch(r"(\d+)([dwmy])", value.strip().lower(), re.ASCII):
        n = int(m[1])
        start = today - timedelta(days=n * (7 if m[2] == "w" else 1)) if m[2] in "dw" else months_back(today, n * (12 if m[2] == "y" else 1))
        return start.isoformat(), today.isoformat()
    return (value.strip(), today.isoformat()) if re.fullmatch(r"\d{4}-\d{2}-\d{2}", value.strip(), re.ASCII) else None


def middle(start: str, end: str) -> str:
    a, b = date.fromisoformat(start), date.fromisoformat(end)
    return (a + timedelta(days=(b - a).days // 2)).isoformat()


def in_range(day: Column, start: str | None, end: str | None) -> Column:
    """Inclusive, on ISO strings; an open range passes all."""
    return day.between(start or FIRST, end or LAST)


def day_gap(a: Column, b: Column) -> Column:
    """Whole days from b to a."""
    return F.datediff(F.try_to_date(a), F.try_to_date(b))


def _valid(y: int, m: int, d: int) -> str | None:
    return date(y, m, d).isoformat() if 1 <= m <= 12 and y >= 1 and 1 <= d <= calendar.monthrange(y, m)[1] else None


def _latest(today: date, m: int, d: int) -> str | None:
    """The year-less day in this year, or in the last if it is still to come."""
    this = _valid(today.year, m, d)
    return this if this is None or this <= today.isoformat() else _valid(today.year - 1, m, d)


def _weekday_before(today: date, weekday: int) -> str:
    """weekday: 0 is Sunday. Today's own weekday means a week ago."""
    return (today - timedelta(days=((today.isoweekday() % 7 - weekday) % 7) or 7)).isoformat()


_B, _E = r"(?<![A-Za-z0-9_])", r"(?![A-Za-z0-9_])"


def infer_event_date(text: str, today: date) -> tuple[str, str, bool] | None:
    """(date, phrase, year guessed) of the first rule that gives a calendar date."""
    plain = unicodedata.normalize("NFC", text)
    low = plain.lower()

    def find(pattern: str, where: str = low):
        return re.search(_B + pattern, where)

    def shifted(days: int):
        return (today - timedelta(days=days)).isoformat()

    def full(m):
        return _valid(int(m[3]), int(m[2]), int(m[1])), False

    def worded(m):
        return (_valid(int(m[3]), int(m[2]), int(m[1])), False) if m[3] else (_latest(today, int(m[2]), int(m[1])), True)

    def weekday(m):
        return _weekday_before(today, int(m[1]) - 1 if m[1] else 0), False

    # The phrases, in the order in which they are tried.
    rules = [
        (r"([0-9]{1,2})[/-]([0-9]{1,2})[/-]([0-9]{4})" + _E, plain, full, None),
        (r"ngày\s+([0-9]{1,2})\s+tháng\s+([0-9]{1,2})(?:\s+năm\s+([0-9]{4}))?" + _E, low, worded, None),
        (r"(?:hôm|ngày)\s+([0-9]{1,2})/([0-9]{1,2})" + _E + r"(?!\s*[/-]?[0-9])", low, lambda m: (_latest(today, int(m[2]), int(m[1])), True), None),
        (r"hôm\s+qua" + _E, low, lambda m: (shifted(1), False), "hôm qua"),
        (r"hôm\s+kia" + _E, low, lambda m: (shifted(2), False), "hôm kia"),
        (r"(?:thứ\s+([2-7])|chủ\s+nhật)\s+(?:vừa\s+rồi|tuần\s+trước)" + _E, low, weekday, None),
        (r"cuối\s+tuần(?:\s+trước)?" + _E, low, lambda m: (_weekday_before(today, 6), False), None),
        (r"tuần\s+trước" + _E, low, lambda m: (shifted(7), False), "tuần trước"),
        (r"tháng\s+trước" + _E, low, lambda m: (months_back(today, 1).isoformat(), False), "tháng trước"),
    ]
    for pattern, where, resolve, phrase in rules:
        if m := find(pattern, where):
            day, guessed = resolve(m)
            if day:
                return day, phrase or m[0], guessed
    return None


def _let(value: Column, use) -> Column:
    """use of value, which is evaluated once however often use names it."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _date(y: Column, m: Column, d: Column) -> Column:
    """An ISO date of three strings of digits, null where the calendar has none."""
    made = F.concat_ws("-", F.lpad(y, 4, "0"), F.lpad(m, 2, "0"), F.lpad(d, 2, "0"))
    return _let(made, lambda x: F.when(x.rlike("^[0-9]{4}-[0-9]{2}-[0-9]{2}$") & (F.substring(x, 1, 4) > "0000"), F.date_format(x.try_cast("date"), "yyyy-MM-dd")))


def _latest_of(today: Column, m: Column, d: Column) -> Column:
    last = _date((F.year(today) - 1).cast("string"), m, d)
    return _let(_date(F.year(today).cast("string"), m, d), lambda this: F.when(this <= F.date_format(today, "yyyy-MM-dd"), this).when(this.isNotNull(), last))


def event_date(text: Column, today: Column) -> Column:
    """infer_event_date as an expression: a struct of day, phrase and guessed, null where no rule gives a date.

    today is a date column. The first match of a rule counts; where it is no calendar date, the next rule is
    asked. Text whose letters are stored decomposed is not composed first.
    """
    low = F.lower(text)

    def rule(groups: int, pattern: str, where: Column, resolve, phrase: str | None = None, guessed=None) -> Column:
        whole = "(?U)" + _B + pattern
        matched = F.when(where.rlike(whole), F.array(*(F.regexp_extract(where, whole, k) for k in range(groups + 1))))

        def found(g: Column) -> Column:
            of = lambda k: F.get(g, F.lit(k))
            told = F.lit(phrase) if phrase else of(0)
            return _let(F.when(g.isNotNull(), resolve(of)), lambda day: F.when(day.isNotNull(), F.struct(day.alias("day"), told.alias("phrase"), (F.lit(False) if guessed is None else guessed(of)).alias("guessed"))))

        return _let(matched, found)

    iso = lambda c: F.date_format(c, "yyyy-MM-dd")
    back = lambda days: iso(F.date_sub(today, days))
    before = lambda weekday: back((F.dayofweek(today) - 2 - weekday + 7) % 7 + 1)  # noqa: E731  weekday: 0 is Sunday
    named = lambda g: F.when(g(1) == "", F.lit(0)).otherwise(g(1).try_cast("int") - 1)
    # The phrases, in the order in which they are tried.
    rules = [
        rule(3, r"([0-9]{1,2})[/-]([0-9]{1,2})[/-]([0-9]{4})" + _E, text, lambda g: _date(g(3), g(2), g(1))),
        rule(3, r"ngày\s+([0-9]{1,2})\s+tháng\s+([0-9]{1,2})(?:\s+năm\s+([0-9]{4}))?" + _E, low, lambda g: F.when(g(3) != "", _date(g(3), g(2), g(1))).otherwise(_latest_of(today, g(2), g(1))), guessed=lambda g: g(3) == ""),
        rule(2, r"(?:hôm|ngày)\s+([0-9]{1,2})/([0-9]{1,2})" + _E + r"(?!\s*[/-]?[0-9])", low, lambda g: _latest_of(today, g(2), g(1)), guessed=lambda g: F.lit(True)),
        rule(0, r"hôm\s+qua" + _E, low, lambda g: back(1), "hôm qua"),
        rule(0, r"hôm\s+kia" + _E, low, lambda g: back(2), "hôm kia"),
        rule(1, r"(?:thứ\s+([2-7])|chủ\s+nhật)\s+(?:vừa\s+rồi|tuần\s+trước)" + _E, low, lambda g: before(named(g))),
        rule(0, r"cuối\s+tuần(?:\s+trước)?" + _E, low, lambda g: before(F.lit(6))),
        rule(0, r"tuần\s+trước" + _E, low, lambda g: back(7), "tuần trước"),
        rule(0, r"tháng\s+trước" + _E, low, lambda g: iso(F.date_add(F.add_months(F.trunc(today, "month"), -1), F.dayofmonth(today) - 1)), "tháng trước"),
    ]
    return F.coalesce(*rules)
