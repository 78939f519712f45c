"""Date queries: ranges with open ends, and one day of the year over several years."""

from __future__ import annotations

import calendar
import datetime as dt
import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from firnline.errors import DateSyntaxError, QueryError


@dataclass(frozen=True)
class DateRange:
    """Dates from start to end, both included; None leaves that side open."""

    start: dt.date | None = None
    end: dt.date | None = None

    def predicate(self, date: Column) -> Column:
        """A comparison with literals only, so that it reaches the scan and prunes partitions."""
        out = F.lit(True)
        if self.start is not None:
            out = date >= F.lit(self.start)
        if self.end is not None:
            out = (out if self.start is not None else F.lit(True)) & (date <= F.lit(self.end))
        return out

    def fragment(self) -> str:
        """This query's part of a file name."""
        return "-".join("open" if d is None else d.isoformat() for d in (self.start, self.end))


@dataclass(frozen=True)
class DayOfYear:
    """One month and day in each year from first to last."""

    month: int
    day: int
    first: int
    last: int

    def __post_init__(self) -> None:
        if not 1 <= self.month <= 12:
            raise QueryError(f"month {self.month} is not one of 1 to 12")
        if not 1 <= self.day <= calendar.monthrange(2000, self.month)[1]:  # a leap year: 29 February is a day
            raise QueryError(f"month {self.month} has no day {self.day}")
        if not (1 <= self.first <= 9999 and 1 <= self.last <= 9999):
            raise QueryError("years must be 1 to 9999")
        if self.last < self.first:
            raise QueryError(f"the last year {self.last} is before the first, {self.first}")

    def predicate(self, date: Column) -> Column:
        """On a date column that partitions a table this prunes; the year bounds reach any scan as a range."""
        between = date.between(F.lit(dt.date(self.first, 1, 1)), F.lit(dt.date(self.last, 12, 31)))
        return between & (F.month(date) == self.month) & (F.dayofmonth(date) == self.day)

    def fragment(self) -> str:
        return f"{self.month}-{self.day}_{self.first}-{self.last}"


DateQuery = DateRange | DayOfYear

_DAY = re.compile(r"\d{4}-?\d{2}-?\d{2}")
_RECURRING = re.compile(r"(?P<month>\d\d)-(?P<day>\d\d)")


def parse_day(text: str) -> dt.date:
    """YYYYMMDD or YYYY-MM-DD; of an instant, its date part."""
    day = text.partition("T")[0]
    if not _DAY.fullmatch(day):
        raise DateSyntaxError(f"{text!r} is no date: write YYYYMMDD or YYYY-MM-DD")
    try:
        return dt.date.fromisoformat(day)
    except ValueError:
        raise DateSyntaxError(f"{text!r} is no date of the calendar") from None


def parse_years(text: str) -> tuple[int, int]:
    """The first and last year of YYYY or YYYY..YYYY."""
    ends = text.split("..")
    if len(ends) > 2 or not all(len(y) == 4 and y.isdecimal() and y.isascii() for y in ends):
        raise DateSyntaxError("years must be YYYY or YYYY..YYYY")
    return int(ends[0]), int(ends[-1])


def parse_interval(text: str) -> DateRange:
    """start/end, where .. or nothing leaves that end open, or a single day."""
    ends = text.split("/")
    if len(ends) == 1:
        day = parse_day(text)
        return DateRange(day, day)
    if len(ends) > 2:
        raise DateSyntaxError(f"{text!r} has more than two ends")
    start, end = (None if e in ("", "..") else parse_day(e) for e in ends)
    if start is not None and end is not None and start > end:
        raise DateSyntaxError(f"{text!r} ends before it starts")
    return DateRange(start, end)


def parse_dates(dates: str | None, years: str | None = None) -> DateQuery:
    """The query that a dates text (an interval, a day, or a recurring MM-DD) and a years text stand for.

    A recurring day needs years, and years need one. No texts: all dates.
    """
    recurring = _RECURRING.fullmatch(dates or "")
    if recurring and years is not None:
        return DayOfYear(int(recurring["month"]), int(recurring["day"]), *parse_years(years))
    if recurring:
        raise DateSyntaxError(f"{dates} recurs every year: give years too, or a full date")
    if years is not None:
        raise DateSyntaxError("years need a recurring day: dates as MM-DD")
    return DateRange() if dates is None else parse_interval(dates)


def selected_dates(available: DataFrame, query: DateQuery, date: str = "date") -> DataFrame:
    """The distinct available dates that a query selects."""
    return available.where(query.predicate(F.col(date))).select(date).distinct()
