"""Calendar months and local time, as SQL expression text.

Columns hold UTC in TIMESTAMP_NTZ. A month begins and ends at local midnight, and its
bounds are worked out here, in Python, so that a filter on them is a plain literal
comparison that reaches the file scan. Expressions are text because `where` and
`selectExpr` then take a whole condition in one call.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from datetime import date, datetime, timedelta, timezone
from zoneinfo import ZoneInfo

from tidemark.constants import BUSINESS_ZONE


def utc_literal(moment: datetime) -> str:
    """A UTC instant as a TIMESTAMP_NTZ literal, whatever the session zone is."""
    return f"timestamp_ntz '{moment.isoformat(sep=' ', timespec='microseconds')}'"


@dataclass(frozen=True)
class MonthWindow:
    """One calendar month in a business time zone, as half-open UTC bounds."""

    year: int
    month: int
    zone: str = BUSINESS_ZONE

    def __post_init__(self) -> None:
        if not re.fullmatch(r"[A-Za-z0-9_+/-]+", self.zone):
            raise ValueError(f"no time zone: {self.zone!r}")
        ZoneInfo(self.zone)
        date(self.year, self.month, 1)

    @property
    def first_day(self) -> date:
        return date(self.year, self.month, 1)

    @property
    def start(self) -> datetime:
        local = datetime(self.year, self.month, 1, tzinfo=ZoneInfo(self.zone))
        return local.astimezone(timezone.utc).replace(tzinfo=None)

    @property
    def end(self) -> datetime:
        return self.next().start

    def next(self) -> MonthWindow:
        if self.month == 12:
            return MonthWindow(self.year + 1, 1, self.zone)
        return MonthWindow(self.year, self.month + 1, self.zone)

    def previous(self) -> MonthWindow:
        if self.month == 1:
            return MonthWindow(self.year - 1, 12, self.zone)
        return MonthWindow(self.year, self.month - 1, self.zone)

    def contains(self, column: str) -> str:
        return between(column, self.start, self.end)

    def contains_short(self, column: str) -> str:
        """As `contains`, without the month's last microsecond (the weekly reports' bound)."""
        return between(column, self.start, self.end - timedelta(microseconds=1))

    def is_after(self, column: str) -> str:
        """True where the column lies before this month."""
        return f"({column} < {utc_literal(self.start)})"

    def local_day(self, column: str) -> str:
        return local_day(column, self.zone)


def between(column: str, start: datetime, end: datetime) -> str:
    return f"({column} >= {utc_literal(start)} and {column} < {utc_literal(end)})"


def local_day(column: str, zone: str) -> str:
    return f"to_date(convert_timezone('UTC', '{zone}', {column}))"


def monday(day: str) -> str:
    """The Monday on or before a date."""
    return f"trunc({day}, 'WEEK')"


def week_of_month(day: str) -> str:
    """1 for the Monday-to-Sunday week holding the 1st of the date's month, then 2, 3, ...

    Equal to numbering the month's distinct Mondays in order, since these are seven
    days apart; so no calendar has to be joined.
    """
    first_monday = monday(f"trunc({day}, 'MM')")
    return f"int(datediff({monday(day)}, {first_monday}) div 7 + 1)"
